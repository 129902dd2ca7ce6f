"""JPEG in numpy: baseline and progressive images are read, baseline ones written.

Entropy-coded data is read bit by bit in plain Python, some 1.5 us a coefficient; transforms and colours are array
operations. Written images have one block of each colour a unit (no subsampling) and Huffman tables made for them.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

from ..sources.errors import RedactError

#: Order of the 64 coefficients, and the standard quantization tables in that order (luminance, chrominance).
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
LUMINANCE = np.array([16, 11, 12, 14, 12, 10, 16, 14, 13, 14, 18, 17, 16, 19, 24, 40, 26, 24, 22, 22, 24, 49, 35, 37, 29, 40, 58, 51, 61, 60, 57, 51, 56, 55, 64, 72, 92, 78, 64, 68, 87, 69, 55, 56, 80, 109, 81, 87, 95, 98, 103, 104, 103, 62, 77, 113, 121, 112, 100, 120, 92, 101, 103, 99])
CHROMINANCE = np.array([17, 18, 18, 24, 21, 24, 47, 26, 26, 47, 99, 66, 56, 66, 99, 99, *[99] * 48])

_k, _n = np.mgrid[0:8, 0:8]
#: The transform: rows are cosines.
COSINES = np.cos((2 * _n + 1) * _k * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)


# Reading ------------------------------------------------------------------------------------------------------------


class Bits:
    """The bits of one interval between restarts; beyond its end zeros."""

    __slots__ = ("data", "at", "held", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        self.held = (self.held & ((1 << self.n) - 1)) << 64 | int.from_bytes(self.data[self.at : self.at + 8].ljust(8, b"\0"), "big")
        self.at += 8
        self.n += 64
        if self.at > len(self.data) + 4096:
            raise RedactError("the JPEG ends too early")

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.n < n:
            self.fill()
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: list[int]) -> int:
        """The next code's symbol; a table has, for each 16 bits, length times 256 and symbol."""
        if self.n < 16:
            self.fill()
        own = table[self.held >> (self.n - 16) & 0xFFFF]
        if not own:
            raise RedactError("no such code in the JPEG")
        self.n -= own >> 8
        return own & 255

    def number(self, n: int) -> int:
        """A signed number of n bits."""
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


def _table(counts: bytes, symbols: bytes) -> list[int]:
    out, i = [], 0
    for n, count in enumerate(counts, 1):
        for s in symbols[i : i + count]:
            out += [n << 8 | s] * (1 << (16 - n))
        i += count
    if len(out) > 1 << 16:
        raise RedactError("the JPEG's codes overlap")
    return out + [0] * ((1 << 16) - len(out))


class Component:
    def __init__(self, id_: int, h: int, v: int, quant: int):
        self.id, self.h, self.v, self.quant = id_, h, v, quant


class Reader:
    def __init__(self, data: bytes):
        self.data, self.quants, self.codes = data, {}, {}
        self.parts: list[Component] = []
        self.restart, self.adobe, self.progressive, self.scans = 0, None, False, 0

    def read(self) -> np.ndarray:
        data, at = self.data, 2
        if data[:2] != b"\xff\xd8":
            raise RedactError("not a JPEG")
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
                at += 1 if mark == 0xFF else 2
                continue
            if mark == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == 0xDB:
                self._quants(body)
            elif mark == 0xC4:
                self._codes(body)
            elif mark in (0xC0, 0xC1, 0xC2):
                self._frame(body, mark == 0xC2)
            elif 0xC3 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
                raise RedactError("JPEGs of this kind can't be read")
            elif mark == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif mark == 0xDA:
                at = self._scan(body, at)
                self.scans += 1
        if not self.parts or not self.scans:
            raise RedactError("the JPEG has no picture")
        return self._picture()

    def _quants(self, body: bytes) -> None:
        i = 0
        while i < len(body):
            wide, n = body[i] >> 4, 128 if body[i] >> 4 else 64
            self.quants[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else "u1").astype(float)
            i += 1 + n

    def _codes(self, body: bytes) -> None:
        i = 0
        while i + 17 <= len(body):
            counts = body[i + 1 : i + 17]
            n = sum(counts)
            self.codes[body[i]] = _table(counts, body[i + 17 : i + 17 + n])
            i += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if bits != 8 or not self.height or not self.width:
            raise RedactError("JPEGs of this kind can't be read")
        self.progressive = progressive
        self.parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if not self.parts or any(not 0 < p.h < 5 or not 0 < p.v < 5 for p in self.parts):
            raise RedactError("the JPEG's sampling is broken")
        self.most_h, self.most_v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.most_h)), -(-self.height // (8 * self.most_v))
        for p in self.parts:
            p.wide, p.high = self.across * p.h, self.down * p.v
            p.blocks = [[0] * 64 for _ in range(p.wide * p.high)]
            # blocks of a scan of this component alone
            p.own_wide, p.own_high = -(-(-(-self.width * p.h // self.most_h)) // 8), -(-(-(-self.height * p.v // self.most_v)) // 8)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0]
        chosen = []
        for i in range(n):
            part = next((p for p in self.parts if p.id == body[1 + 2 * i]), None)
            if part is None:
                raise RedactError("the JPEG's scan is broken")
            chosen.append((part, self.codes.get(body[2 + 2 * i] >> 4), self.codes.get(16 | body[2 + 2 * i] & 15)))
        first, last, shift = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
        end = at
        while True:  # the next mark that is neither a stuffed byte nor a restart
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                end = len(self.data)
                break
            if self.data[end + 1] != 0 and not 0xD0 <= self.data[end + 1] <= 0xD7:
                break
            end += 2
        pieces, begun, i = [], at, at
        while (i := self.data.find(b"\xff", i, end)) >= 0 and i + 1 < end:
            if 0xD0 <= self.data[i + 1] <= 0xD7:
                pieces.append(self.data[begun:i])
                begun = i + 2
            i += 2
        pieces.append(self.data[begun:end])
        if n == 1:
            p, dc, ac = chosen[0]
            units = [[(p, dc, ac, y * p.wide + x)] for y in range(p.own_high) for x in range(p.own_wide)]
        else:
            units = [[(p, dc, ac, (my * p.v + v) * p.wide + mx * p.h + h) for p, dc, ac in chosen for v in range(p.v) for h in range(p.h)] for my in range(self.down) for mx in range(self.across)]
        step = self.restart or len(units)
        for k, lo in enumerate(range(0, len(units), step)):
            if k >= len(pieces):
                break
            self._interval(Bits(pieces[k]), units[lo : lo + step], first, last, shift >> 4, shift & 15)
        return end

    def _interval(self, bits: Bits, units: list, first: int, last: int, high: int, low: int) -> None:
        before = {id(p): 0 for p in self.parts}
        run = 0
        for unit in units:
            for p, dc, ac, at in unit:
                block = p.blocks[at]
                if not self.progressive:
                    before[id(p)] += bits.number(bits.symbol(dc))
                    block[0] = before[id(p)]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s & 15:
                            k += s >> 4
                            if k > 63:
                                break
                            block[k] = bits.number(s & 15)
                            k += 1
                        elif s == 0xF0:
                            k += 16
                        else:
                            break
                elif first == 0:
                    if high == 0:
                        before[id(p)] += bits.number(bits.symbol(dc))
                        block[0] = before[id(p)] << low
                    elif bits.take(1):
                        block[0] |= 1 << low
                elif high == 0:
                    run = self._first(bits, ac, block, first, last, low, run)
                else:
                    run = self._refined(bits, ac, block, first, last, low, run)

    @staticmethod
    def _first(bits: Bits, ac, block: list[int], k: int, last: int, low: int, run: int) -> int:
        if run:
            return run - 1
        while k <= last:
            s = bits.symbol(ac)
            n, zeros = s & 15, s >> 4
            if n:
                k += zeros
                if k > 63:
                    break
                block[k] = bits.number(n) * (1 << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    @staticmethod
    def _refined(bits: Bits, ac, block: list[int], k: int, last: int, low: int, run: int) -> int:
        one = 1 << low

        def more(k: int) -> None:
            if bits.take(1) and not abs(block[k]) & one:
                block[k] += one if block[k] > 0 else -one

        while not run and k <= last:
            s = bits.symbol(ac)
            n, zeros = s & 15, s >> 4
            new = 0
            if n:
                new = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                if block[k]:
                    more(k)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1
        if run:
            for i in range(k, last + 1):
                if block[i]:
                    more(i)
            return run - 1
        return 0

    def _picture(self) -> np.ndarray:
        planes = []
        for p in self.parts:
            quant = self.quants.get(p.quant)
            if quant is None or len(quant) < 64:
                raise RedactError("the JPEG lacks a table")
            flat = np.zeros((len(p.blocks), 64))
            flat[:, ZIGZAG] = np.array(p.blocks, float) * quant
            p.blocks = []
            made = COSINES.T @ flat.reshape(-1, 8, 8) @ COSINES
            plane = made.reshape(p.high, p.wide, 8, 8).swapaxes(1, 2).reshape(p.high * 8, p.wide * 8) + 128
            plane = np.clip(np.rint(plane), 0, 255)
            plane = plane[: -(-self.height * p.v // self.most_v), : -(-self.width * p.h // self.most_h)]
            plane = _widened(_widened(plane, self.most_h // p.h).T, self.most_v // p.v).T
            planes.append(plane[: self.height, : self.width])
        x = np.stack(planes, 2)
        if x.shape[2] == 3 and self.adobe != 0 or x.shape[2] == 4 and self.adobe == 2:
            y, b, r = x[:, :, 0], x[:, :, 1] - 128, x[:, :, 2] - 128
            x[:, :, 0], x[:, :, 1], x[:, :, 2] = y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b
        x = np.clip(np.rint(x), 0, 255)
        if x.shape[2] == 4:  # inks, stored as what is left white
            x = x if self.adobe is not None else 255 - x
            x = np.rint(x[:, :, :3] * x[:, :, 3:] / 255)
        return x.astype(np.uint8)


def _widened(plane: np.ndarray, times: int) -> np.ndarray:
    """More columns: doubled ones lean to their neighbours by a quarter, others repeat."""
    if times != 2:
        return np.repeat(plane, times, 1)
    out = np.repeat(0.75 * plane, 2, 1)
    out[:, ::2] += 0.25 * np.concatenate([plane[:, :1], plane[:, :-1]], 1)
    out[:, 1::2] += 0.25 * np.concatenate([plane[:, 1:], plane[:, -1:]], 1)
    return out


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width, 1 or 3)."""
    try:
        return Reader(data).read()
    except (IndexError, struct.error, TypeError, ValueError) as e:
        raise RedactError(f"the JPEG is broken: {e}") from e


# Writing ------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of at most 16 bits for the symbols that occur, none of them all ones."""
    heap = [(int(c), i, (int(s),)) for i, (s, c) in enumerate((s, counts[s]) for s in np.flatnonzero(counts))] + [(0, 256, (256,))]
    heapq.heapify(heap)
    length = {s: 0 for _, _, own in heap for s in own}
    if len(heap) == 1:
        return {}
    tie = 257
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            length[s] += 1
        heapq.heappush(heap, (a + b, tie, x + y))
        tie += 1
    # codes that are too long are shortened at the cost of the longest that isn't
    number = [0] * (max(length.values()) + 2)
    for n in length.values():
        number[n] += 1
    for n in range(len(number) - 1, 16, -1):
        while number[n] > 0:
            j = n - 2
            while not number[j]:
                j -= 1
            number[n] -= 2
            number[n - 1] += 1
            number[j + 1] += 2
            number[j] -= 1
    order = sorted((n, s == 256, s) for s, n in length.items())
    sizes = [n for n in range(1, 17) for _ in range(number[n] if n < len(number) else 0)]
    return {s: n for (_, _, s), n in zip(order, sizes, strict=True) if s != 256}


def encode(image: np.ndarray, quality: int = 90) -> bytes:
    """A baseline JPEG of gray or RGB pixels; an alpha channel is left out."""
    if image.ndim == 2:
        image = image[:, :, None]
    gray = image.shape[2] < 3
    pixels = image[:, :, :1].astype(float) if gray else image[:, :, :3].astype(float)
    h, w = pixels.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise RedactError("a JPEG has 1 to 65,535 pixels a side")
    if not gray:
        r, g, b = pixels[:, :, 0], pixels[:, :, 1], pixels[:, :, 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        pixels = np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], 2)
    pixels = np.pad(pixels, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge") - 128
    share = 5000 / quality if quality < 50 else 200 - 2 * quality
    quants = [np.clip((q * share + 50) // 100, 1, 255) for q in ((LUMINANCE,) if gray else (LUMINANCE, CHROMINANCE))]
    high, wide, n = pixels.shape[0] // 8, pixels.shape[1] // 8, pixels.shape[2]
    events = []  # (block, component, order in the block), table, symbol, bits, number of bits
    for c in range(n):
        blocks = pixels[:, :, c].reshape(high, 8, wide, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        made = (COSINES @ blocks @ COSINES.T).reshape(-1, 64)[:, ZIGZAG]
        coef = np.rint(made / quants[min(c, len(quants) - 1)]).astype(np.int64)
        table = min(c, 1)
        diff = np.diff(coef[:, 0], prepend=0)
        block = np.arange(len(coef))
        events.append((block * n + c, np.zeros(len(coef), int), np.full(len(coef), table), *_sized(diff, 0)))
        at, k = np.nonzero(coef[:, 1:])
        k = k + 1
        before = np.where(np.r_[True, at[1:] != at[:-1]], 0, np.r_[0, k[:-1]]) if len(at) else k
        zeros = k - before - 1
        events.append((at * n + c, 4 * k, np.full(len(at), 2 + table), *_sized(coef[at, k], zeros % 16)))
        long = np.repeat(np.arange(len(at)), zeros // 16)
        events.append((at[long] * n + c, 4 * k[long] - 1, np.full(len(long), 2 + table), np.full(len(long), 0xF0), np.zeros(len(long), int), np.zeros(len(long), int)))
        last = np.zeros(len(coef), int)
        np.maximum.at(last, at, k)
        short = np.flatnonzero(last < 63)
        events.append((short * n + c, np.full(len(short), 400), np.full(len(short), 2 + table), np.zeros(len(short), int), np.zeros(len(short), int), np.zeros(len(short), int)))
    unit, place, table, symbol, value, size = (np.concatenate(x) for x in zip(*events, strict=True))
    order = np.lexsort((place, unit))
    table, symbol, value, size = table[order], symbol[order], value[order], size[order]
    head, code, length = [], np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for t in range(4):
        own = code_lengths(np.bincount(symbol[table == t], minlength=256))
        if not own:
            continue
        ranked = sorted(own.items(), key=lambda x: (x[1], x[0]))
        next_, last_ = 0, ranked[0][1]
        for s, bits in ranked:
            next_ <<= bits - last_
            code[t, s], length[t, s], last_ = next_, bits, bits
            next_ += 1
        counts = bytes(sum(b == i for _, b in ranked) for i in range(1, 17))
        body = bytes([(t & 1) | (0x10 if t > 1 else 0)]) + counts + bytes(s for s, _ in ranked)
        head.append(b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body)
    bits = length[table, symbol] + size
    whole = code[table, symbol] << size | value
    ends = np.cumsum(bits)
    total = int(ends[-1])
    shift = np.repeat(ends, bits) - 1 - np.arange(total)
    stream = ((np.repeat(whole, bits) >> shift) & 1).astype(np.uint8)
    data = np.packbits(np.r_[stream, np.ones(-total % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\x00")
    out = [b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"]
    out += [b"\xff\xdb\x00\x43" + bytes([i]) + q.astype(np.uint8).tobytes() for i, q in enumerate(quants)]
    out.append(b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, h, w, n) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(n)))
    out += head
    out.append(b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(n)) + b"\x00\x3f\x00")
    return b"".join(out) + data + b"\xff\xd9"


def _sized(values: np.ndarray, zeros) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, bits, number of bits) of numbers after runs of zeros."""
    size = np.zeros(len(values), int)
    left = np.abs(values)
    while left.any():
        size += left > 0
        left = left >> 1
    return (np.asarray(zeros) << 4 | size) + np.zeros(len(values), int), np.where(values < 0, values + (1 << size) - 1, values), size
