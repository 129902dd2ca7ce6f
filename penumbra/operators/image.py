"""Images as arrays: PNG and JPEG reading and writing, orientation, rotation, blacked-out boxes, image-only PDFs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.ingest import RedactError, Unsupported
from . import jpeg
from .raster import bmp_decode, gif_decode, samples

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Of JPEGs that are written.
JPEG_QUALITY = 90
#: Orders in which turned images are tried until something is found: right angles first, then slight slants.
LADDER = (90, 180, 270, 10, -10, 15, -15, 20, -20)


def png_encode(image: np.ndarray) -> bytes:
    """8-bit PNG of (height, width, 1 to 4 channels)."""
    h, w, c = image.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, w * c)], 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


#: First column and line, and steps, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_decode(data: bytes) -> np.ndarray:
    """(height, width, channels) of a PNG, in 8 bits; palettes are resolved."""
    if data[:8] != SIGNATURE:
        raise RedactError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
    if head is None or head[2] not in (1, 2, 4, 8, 16) or head[3] not in (0, 2, 3, 4, 6) or head[6] > 1:
        raise RedactError("the PNG has no head that can be read")
    w, h, depth, c = head[0], head[1], head[2], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    image = np.zeros((h, w, c), np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if head[6] else ((0, 0, 1, 1),):
        wide, high = len(range(x0, w, dx)), len(range(y0, h, dy))
        if not wide or not high:
            continue
        line = -(-wide * c * depth // 8)
        rows = _lines(raw[at : at + high * (1 + line)].reshape(high, 1 + line), max(1, c * depth // 8))
        at += high * (1 + line)
        values = rows[:, ::2] if depth == 16 else samples(rows, depth)
        if depth < 8 and head[3] != 3:
            values = values * (255 // ((1 << depth) - 1))
        image[y0::dy, x0::dx] = values[:, : wide * c].reshape(high, wide, c)
    if head[3] != 3 or palette is None:
        return image
    table = np.zeros((256, 3), np.uint8)
    table[: len(palette)] = palette
    return table[image[:, :, 0]]


def _lines(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes whose first says how they were stored: as they are, or as differences."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = out[0]
    for y in range(len(raw)):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 1:  # from the left: a running sum of each channel
            line = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = _unfiltered(line.tolist(), above.tolist(), step, kind == 4)
        out[y] = line
        above = out[y]
    return out


def _unfiltered(line: list[int], above: list[int], c: int, paeth: bool) -> list[int]:
    """A line whose pixels were stored as differences from what their left, upper and corner neighbours suggest."""
    for x in range(len(line)):
        left, up = line[x - c] if x >= c else 0, above[x]
        if paeth:
            corner = above[x - c] if x >= c else 0
            a, b, d = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= d else up if b <= d else corner
        else:
            guess = (left + up) >> 1
        line[x] = (line[x] + guess) & 255
    return line


def exif_orientation(data: bytes) -> int | None:
    """The orientation tag (1 to 8) of a JPEG's or PNG's EXIF block, or None."""
    try:
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF and data[at + 1] != 0xDA:
                size = struct.unpack(">H", data[at + 2 : at + 4])[0]
                if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    return _tag(data[at + 10 : at + 2 + size])
                at += 2 + size
        elif data[:8] == SIGNATURE:
            at = 8
            while at + 8 <= len(data):
                size, name = struct.unpack(">I4s", data[at : at + 8])
                if name == b"eXIf":
                    return _tag(data[at + 8 : at + 8 + size])
                at += size + 12
    except (IndexError, struct.error):
        pass
    return None


def _tag(tiff: bytes) -> int | None:
    order = "<" if tiff[:2] == b"II" else ">"
    first = struct.unpack(order + "I", tiff[4:8])[0]
    for i in range(struct.unpack(order + "H", tiff[first : first + 2])[0]):
        tag, _, _, value = struct.unpack(order + "HHIH", tiff[first + 2 + 12 * i : first + 12 + 12 * i])
        if tag == 0x0112:
            return value if 1 <= value <= 8 else None
    return None


def upright(image: np.ndarray, orientation: int | None) -> np.ndarray | None:
    """The image as its orientation tag means it; None if there is nothing to do."""
    flip, turn = {2: (True, 0), 3: (False, 2), 4: (True, 2), 5: (True, 1), 6: (False, 3), 7: (True, 3), 8: (False, 1)}.get(orientation or 1, (False, 0))
    if not flip and not turn:
        return None
    return np.rot90(image[:, ::-1] if flip else image, turn)


def turned(image: np.ndarray, degrees: int) -> np.ndarray | None:
    """Clockwise by a right angle; None for others."""
    return np.rot90(image, -degrees // 90) if degrees in (90, 180, 270) else None


def slanted(image: np.ndarray, degrees: float) -> np.ndarray:
    """Clockwise by any angle on a canvas that grows, white where nothing was.

    Each pixel takes the one that its place, turned back about the middle (half the size), falls into; in floats.
    """
    one = np.float32
    h, w = one(image.shape[0]), one(image.shape[1])
    a = np.radians(one(degrees))
    sin, cos = np.sin(a), np.cos(a)
    wide, high = max(one(1), np.ceil(w * abs(cos) + h * abs(sin))), max(one(1), np.ceil(w * abs(sin) + h * abs(cos)))
    y, x = np.mgrid[0 : int(high), 0 : int(wide)].astype(one)
    rx, ry = x - wide / one(2), y - high / one(2)
    sx, sy = rx * cos + ry * sin + w / one(2), -rx * sin + ry * cos + h / one(2)
    inside = (sx >= 0) & (sy >= 0) & (sx < w) & (sy < h)
    out = np.full((int(high), int(wide), *image.shape[2:]), 255, image.dtype)
    out[inside] = image[sy[inside].astype(int), sx[inside].astype(int)]
    return out


def cuts(width: int, height: int, grid: int, overlap: float) -> list[tuple[int, int, int, int]]:
    """(x, y, width, height) of a grid of tiles that reach over their neighbours, row by row; empty ones are left out."""
    grid = max(1, grid)
    wide, high = width // grid, height // grid
    pad_x, pad_y = int(np.float32(wide) * np.float32(overlap)), int(np.float32(high) * np.float32(overlap))
    out = []
    for row in range(grid):
        for col in range(grid):
            x0, y0 = max(col * wide - pad_x, 0), max(row * high - pad_y, 0)
            x1, y1 = min((col + 1) * wide + pad_x, width), min((row + 1) * high + pad_y, height)
            if x1 > x0 and y1 > y0:
                out.append((x0, y0, x1 - x0, y1 - y0))
    return out


def first_found(image: np.ndarray, look: Callable[[np.ndarray], list]) -> tuple[np.ndarray, list]:
    """The image as it is, or turned in the order of LADDER until `look` finds something, with what was found."""
    found = look(image)
    if found:
        return image, found
    for angle in LADDER:
        new = turned(image, angle) if angle in (90, 180, 270) else slanted(image, angle)
        if found := look(new):
            return new, found
    return image, []


def blacked(image: np.ndarray, boxes: list[dict], dpi: int, page: int | None = 1) -> np.ndarray:
    """A copy with the boxes of the page (None: of any) black, alpha kept opaque; boxes are in 72 units an inch."""
    out, (h, w) = image.copy(), image.shape[:2]
    s = np.float32(dpi) / np.float32(72)
    for b in boxes:
        if page is not None and b["page"] != page:
            continue
        x, y, bw, bh = (np.float32(b[k]) for k in ("x", "y", "width", "height"))
        x0, y0 = int(max(x * s, 0)), int(max(y * s, 0))
        x1, y1 = min(int(max((x + bw) * s, 0)), w), min(int(max((y + bh) * s, 0)), h)
        out[y0:y1, x0:x1] = 0
        if image.ndim == 3 and image.shape[2] in (2, 4):
            out[y0:y1, x0:x1, -1] = 255
    return out


def decode(content: bytes) -> np.ndarray:
    """Pixels of a PNG, JPEG, GIF or BMP."""
    for mark, read in ((b"\xff\xd8", jpeg.decode), (b"GIF8", gif_decode), (b"BM", bmp_decode)):
        if content.startswith(mark):
            return read(content)
    return png_decode(content)


def encode(picture: np.ndarray, source: bytes, quality: int = JPEG_QUALITY) -> bytes:
    """In the format of the file it came from: a JPEG stays one (without alpha), all else is a PNG."""
    return jpeg.encode(picture, quality) if source[:2] == b"\xff\xd8" else png_encode(picture)


def image_pdf(pages: list[np.ndarray], dpi: int = 150, quality: int | None = None) -> bytes:
    """A PDF of images only, so no text survives; lossless, or JPEGs of a quality."""
    parts: list[bytes] = []
    kids = " ".join(f"{3 + 3 * i} 0 R" for i in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode()]
    for i, p in enumerate(pages):
        rgb = np.ascontiguousarray(np.repeat(p, 3, 2) if p.shape[2] == 1 else p[:, :, :3], np.uint8)
        h, w = rgb.shape[:2]
        size = f"{w * 72 / dpi:.2f} {h * 72 / dpi:.2f}"
        draw = f"q {size.split()[0]} 0 0 {size.split()[1]} 0 0 cm /I Do Q".encode()
        data, way = (zlib.compress(rgb.tobytes()), "FlateDecode") if quality is None else (jpeg.encode(rgb, quality), "DCTDecode")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {size}] /Contents {4 + 3 * i} 0 R /Resources << /XObject << /I {5 + 3 * i} 0 R >> >> >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(draw), draw))
        objects.append(f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /{way} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    parts.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    return out + parts[0] + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def redact_images(df: DataFrame, content_col: str = "content", boxes_col: str = "boxes", dpi: int = 150, encode: Callable[[np.ndarray, bytes], bytes] | None = None, decode: Callable[[bytes], np.ndarray] = decode, render: Callable[[bytes, int], list[np.ndarray]] | None = None) -> DataFrame:
    """The rows with `redacted`, the image with its boxes black, and `error`; a row that fails has no bytes.

    PNG and JPEG by themselves, GIF and BMP become PNGs; give a codec for other formats. An image is one page, so all boxes are drawn. With `render`, rows that
    are PDFs become PDFs of page images, each with the boxes of its page.
    """
    out = T.StructType([*df.schema, T.StructField("redacted", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [drawn(bytes(content), plain_boxes(boxes), dpi, encode, decode, render) for content, boxes in zip(f[content_col], f[boxes_col], strict=True)]
            yield f.assign(redacted=[m[0] for m in made], error=[m[1] for m in made])

    return df.mapInPandas(run, out)


def plain_boxes(boxes) -> list[dict]:
    return [b if isinstance(b, dict) else b.asDict() for b in (boxes if boxes is not None else [])]


in_its_format = encode


def drawn(source: bytes, boxes: list[dict], dpi: int, encode=None, decode=decode, render=None, turned: bool = False, quality: int | None = None) -> tuple[bytes | None, str | None]:
    """(bytes, None) with the boxes black, or (None, reason). `turned`: decode gives the pixels as they are shown."""
    try:
        if source.startswith(b"%PDF"):
            if render is None:
                raise Unsupported("PDFs need a renderer")
            return image_pdf([blacked(p, boxes, dpi, i) for i, p in enumerate(render(source, dpi), 1)], dpi, quality), None
        image = decode(source)
        turned_ = None if turned else upright(image, exif_orientation(source))
        image = image if turned_ is None else turned_
        return (encode or in_its_format)(blacked(image, boxes, dpi, None), source), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"
