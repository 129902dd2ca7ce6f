"""GIF (first picture) and BMP reading in numpy."""

from __future__ import annotations

import struct

import numpy as np

from ..sources.errors import RedactError


def gif_decode(data: bytes) -> np.ndarray:
    """(height, width, 3) of the first picture on its screen, white where it leaves the screen bare."""
    try:
        return _gif(data)
    except (IndexError, struct.error, ValueError) as e:
        raise RedactError(f"the GIF is broken: {e}") from e


def _gif(data: bytes) -> np.ndarray:
    if data[:4] != b"GIF8":
        raise RedactError("not a GIF")
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at, colors = 13, None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        colors, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    while data[at] != 0x2C:
        if data[at] != 0x21:
            raise RedactError("the GIF has no picture")
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    x0, y0, pw, ph, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
    at += 10
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        colors, at = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3), at + n
    if colors is None or not w or not h:
        raise RedactError("the GIF has no colours")
    first, at, parts = data[at], at + 1, []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    flat = np.frombuffer(unpacked(b"".join(parts), first, pw * ph), np.uint8)
    index = np.zeros(pw * ph, np.uint8)
    index[: len(flat)] = flat[: pw * ph]
    index = index.reshape(ph, pw)
    if flags & 0x40:  # every eighth line, then those between, then between these
        order = np.concatenate([np.arange(a, ph, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
        lines = np.empty_like(index)
        lines[order] = index
        index = lines
    out = np.full((h, w, 3), 255, np.uint8)
    table = np.zeros((256, 3), np.uint8)
    table[: len(colors)] = colors
    part = table[index][: max(0, h - y0), : max(0, w - x0)]
    out[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]] = part
    return out


def unpacked(data: bytes, first: int, most: int) -> bytes:
    """LZW with codes from the low bits up, which grow from first + 1 bits to 12; at most `most` bytes and one entry."""
    if not 1 < first < 12:
        raise RedactError("the GIF's codes are broken")
    clear, out, size = 1 << first, [], 0
    base = [bytes([i]) if i < 256 else b"" for i in range(clear)] + [b"", b""]
    table, width, last, held, bits = list(base), first + 1, b"", 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & ((1 << width) - 1)
            held >>= width
            bits -= width
            if code == clear:
                table, width, last = list(base), first + 1, b""
                continue
            if code == clear + 1 or size >= most:
                return b"".join(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise RedactError("the GIF's codes are broken")
            out.append(entry)
            size += len(entry)
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return b"".join(out)


def bmp_decode(data: bytes) -> np.ndarray:
    """(height, width, 3) of a BMP that is not compressed: 1, 4 or 8 bits with a palette, 16, 24 or 32 without."""
    try:
        return _bmp(data)
    except (IndexError, struct.error, ValueError) as e:
        raise RedactError(f"the BMP is broken: {e}") from e


def _bmp(data: bytes) -> np.ndarray:
    begin, size, w, h, _, bits, way = struct.unpack("<IIiiHHI", data[10:34])
    if data[:2] != b"BM" or size < 40 or w <= 0 or not h or way not in (0, 3):
        raise RedactError("BMPs of this kind can't be read")
    width, high = -(-w * bits // 32) * 4, abs(h)
    raw = np.frombuffer(data, np.uint8, width * high, begin).reshape(high, width)
    raw = raw if h < 0 else raw[::-1]
    if bits in (1, 4, 8):
        n = struct.unpack("<I", data[46:50])[0] or 1 << bits
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(data, np.uint8, 4 * n, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[samples(raw, bits)[:, :w]]
    if bits in (24, 32) and way == 0:
        return np.ascontiguousarray(raw[:, : w * bits // 8].reshape(high, w, bits // 8)[:, :, 2::-1])
    if bits in (16, 32):
        whole = np.ascontiguousarray(raw[:, : w * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        masks = struct.unpack("<III", data[54:66]) if way == 3 else (0x7C00, 0x3E0, 0x1F)
        low = [m & -m for m in masks]
        return np.stack([(whole & m) // a * 255 // (m // a) for m, a in zip(masks, low, strict=True)], 2).astype(np.uint8)
    raise RedactError("BMPs of this kind can't be read")


def samples(rows: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bytes as rows of numbers of 1, 2, 4 or 8 bits, the high ones first."""
    if bits == 8:
        return rows
    apart = np.unpackbits(rows, axis=1).reshape(len(rows), -1, bits)
    return (apart @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
