"""PDFs with a text layer: objects, fonts and page contents in plain Python, words with their places, Markdown.

A file is read by its cross-reference tables and streams; where they are broken it is scanned for objects. Page contents
are run for what they show: each glyph's text, from the font's Unicode map or its encoding, and its rectangle, from the
text matrix and the font's widths. Glyphs that follow each other without a gap are a word. Words come in reading order: rows
from top to bottom, columns one after the other where rows share a free strip. Places are in 72 units an inch from the
top left of the page as it is shown.

Encrypted files are refused. Pages that show pictures and no text are named, since their words are not read here.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np

#: Nested arrays, dictionaries and forms, and bytes of one stream, beyond which a file is refused.
DEEPEST, LARGEST = 60, 1 << 28


class PdfError(ValueError):
    """A file that is no PDF, or one that can't be read."""


class Name(str):
    __slots__ = ()


class Word(bytes):
    """An operator or keyword."""

    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


# Syntax -------------------------------------------------------------------------------------------------------------

TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*)*(?:(?P<num>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?=[\x00\t\n\x0c\r \[\]()<>/%{}]|\Z))|/(?P<name>[^\x00\t\n\x0c\r \[\]()<>/%{}]*)"
    rb"|(?P<open><<)|(?P<close>>>)|<(?P<hex>[^>]*)>|(?P<text>\()|(?P<mark>[\[\]{}])|(?P<word>[^\x00\t\n\x0c\r \[\]()<>/%{}]+)|(?P<bad>[)>]))"
)
REFERENCE = re.compile(rb"[\x00\t\n\x0c\r ]+([0-9]+)[\x00\t\n\x0c\r ]+R(?=[\x00\t\n\x0c\r \[\]()<>/%{}]|\Z)")
#: The rest of an array of numbers alone, and of a table of objects.
NUMBERS = re.compile(rb"((?:[\t\n\x0c\r ]*[+-]?[0-9]+(?:\.[0-9]*)?(?=[\t\n\x0c\r \]]))++)[\t\n\x0c\r ]*\]")
ENTRIES = re.compile(rb"[\t\n\x0c\r ]*((?:[0-9]{10} [0-9]{5} [nf](?: \r| \n|\r\n))*+)")
TEXT_END = re.compile(rb"[()\\]")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
HEX_IN_NAME, NO_HEX = re.compile(rb"#([0-9A-Fa-f]{2})"), re.compile(rb"[^0-9A-Fa-f]")
CONSTANTS = {b"true": True, b"false": False, b"null": None}
END = object()


class Parser:
    """Objects one after the other; words (operators, keywords) among them. References only where `refs`."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def next(self, depth: int = 0):
        m = TOKEN.match(self.data, self.at)
        if m is None:
            self.at = len(self.data)
            return END
        self.at, kind = m.end(), m.lastgroup
        if kind == "num":
            raw = m["num"]
            if self.refs and raw.isdigit() and (r := REFERENCE.match(self.data, self.at)):
                self.at = r.end()
                return Ref(int(raw))
            return float(raw) if b"." in raw else int(raw)
        if kind == "name":
            name = m["name"]
            return Name((HEX_IN_NAME.sub(lambda h: bytes.fromhex(h[1].decode()), name) if b"#" in name else name).decode("latin-1"))
        if kind == "word":
            word = m["word"]
            return CONSTANTS[word] if word in CONSTANTS else Word(word)
        if kind == "hex":
            if not NO_HEX.search(m["hex"]) and not len(m["hex"]) % 2:
                return bytes.fromhex(m["hex"].decode())
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", m["hex"])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == "text":
            return self._text()
        if depth > DEEPEST:
            raise PdfError("objects are nested too deeply")
        if kind == "open":
            out = {}
            while (key := self.next(depth + 1)) is not END and key != Word(b">>"):
                if isinstance(key, Name):
                    value = self.next(depth + 1)
                    if value is END or value == Word(b">>"):
                        break
                    out[key] = value
            return out
        if kind == "mark" and m["mark"] == b"[":
            if plain := NUMBERS.match(self.data, self.at):
                self.at = plain.end()
                return [float(v) if b"." in v else int(v) for v in plain[1].split()]
            own = []
            while (x := self.next(depth + 1)) is not END and x != Word(b"]"):
                own.append(x)
            return own
        return Word(m[kind])

    def _text(self) -> bytes:
        out, depth, data = [], 1, self.data
        while True:
            m = TEXT_END.search(data, self.at)
            if m is None:
                out.append(data[self.at :])
                self.at = len(data)
                break
            out.append(data[self.at : m.start()])
            self.at = m.end()
            if m[0] == b"\\":
                c = data[self.at : self.at + 1]
                self.at += 1
                if c in ESCAPES:
                    out.append(ESCAPES[c])
                elif c and c in b"01234567":
                    o = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    self.at = o.end()
                    out.append(bytes([int(o[0], 8) & 255]))
                elif c == b"\r":
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif c != b"\n":
                    out.append(c)
                continue
            depth += 1 if m[0] == b"(" else -1
            if not depth:
                break
            out.append(m[0])
        return b"".join(out)


# Filters ------------------------------------------------------------------------------------------------------------


def inflated(raw: bytes) -> bytes:
    """What a damaged or cut stream still gives counts."""
    for bits in (15, -15):
        d, out = zlib.decompressobj(bits), b""
        try:
            out = d.decompress(raw if bits > 0 else raw[2:], LARGEST)
        except zlib.error:
            d, parts = zlib.decompressobj(bits), []
            try:
                for i in range(0, len(raw), 64):
                    parts.append(d.decompress(raw[i : i + 64], LARGEST))
            except zlib.error:
                pass
            out = b"".join(parts)
        if len(out) >= LARGEST:
            raise PdfError("a stream is too large")
        if out:
            return out
    return b""


def lzw(raw: bytes, early: int = 1) -> bytes:
    table, out, size = [bytes([i]) for i in range(256)] + [b"", b""], [], 0
    bits = held = 0
    width, last = 9, b""
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = table[:258], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif last:
            entry = last + last[:1]
        else:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        if size > LARGEST:
            raise PdfError("a stream is too large")
        last = entry
        width = min(12, max(9, (len(table) + early).bit_length()))
    return b"".join(out)


def ascii85(raw: bytes) -> bytes:
    raw = re.sub(rb"[\x00\t\n\x0c\r ]", b"", raw).removeprefix(b"<~").split(b"~")[0].replace(b"z", b"!!!!!")
    more = -len(raw) % 5
    raw += b"u" * more
    out = b"".join((sum(min(84, max(0, c - 33)) * 85 ** (4 - k) for k, c in enumerate(raw[i : i + 5])) & 0xFFFFFFFF).to_bytes(4, "big") for i in range(0, len(raw), 5))
    return out[: len(out) - more] if more else out


def run_lengths(raw: bytes) -> bytes:
    out, i = [], 0
    while i < len(raw) and raw[i] != 128:
        n = raw[i]
        out.append(raw[i + 1 : i + 2 + n] if n < 128 else raw[i + 1 : i + 2] * (257 - n))
        i += n + 2 if n < 128 else 2
    return b"".join(out)


def unpredicted(data: bytes, parms: dict) -> bytes:
    """Undo a predictor: PNG's filters line by line, or TIFF's differences of bytes."""
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out, before = [], bytes(width)
    if kind == 2:
        for i in range(0, len(data), width):
            line = bytearray(data[i : i + width])
            for k in range(step, len(line)) if bits == 8 else ():
                line[k] = (line[k] + line[k - step]) & 255
            out.append(bytes(line))
        return b"".join(out)
    for i in range(0, len(data), width + 1):
        way, line = data[i], bytearray(data[i + 1 : i + 1 + width].ljust(width, b"\0"))
        if way == 1:
            for k in range(step, width):
                line[k] = (line[k] + line[k - step]) & 255
        elif way == 2:
            line = bytearray((a + b) & 255 for a, b in zip(line, before, strict=True))
        elif way in (3, 4):
            for k in range(width):
                a, b, c = (line[k - step] if k >= step else 0), before[k], (before[k - step] if k >= step else 0)
                if way == 3:
                    line[k] = (line[k] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    line[k] = (line[k] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]) & 255
        before = bytes(line)
        out.append(before)
    return b"".join(out)


# The file -----------------------------------------------------------------------------------------------------------

OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})[\x00\t\n\x0c\r ]+[0-9]{1,5}[\x00\t\n\x0c\r ]+obj(?=[\x00\t\n\x0c\r \[\]()<>/%{}0-9])")
PICTURES = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode")


class File:
    """Objects by number."""

    def __init__(self, data: bytes):
        begin = data.find(b"%PDF-", 0, 1024)
        if begin < 0:
            raise PdfError("no PDF")
        self.data, self.kept, self.inside, self.trailer = data[begin:], {}, {}, {}
        self.at: dict[int, tuple[int, int, int]] = {}  # number to (kind, place or stream, index)
        try:
            self._tables()
            if not isinstance(self.of(self.of(self.trailer.get("Root")).get("Pages")), dict):
                raise PdfError("no pages")
        except Exception:
            self._scan()
        if self.trailer.get("Encrypt") is not None:
            raise PdfError("the PDF is encrypted")

    def _tables(self) -> None:
        starts = re.findall(rb"startxref[\x00\t\n\x0c\r ]+([0-9]+)", self.data[-4096:])
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            p = Parser(self.data, at)
            if (first := p.next()) == Word(b"xref"):
                while isinstance(start := p.next(), int):
                    n = p.next()
                    if isinstance(n, int) and len(rows := (m := ENTRIES.match(self.data, p.at))[1]) == 20 * n:
                        p.at = m.end()
                        for i, row in enumerate(range(0, 20 * n, 20), start):
                            self.at.setdefault(i, (1, int(rows[row : row + 10]), 0) if rows[row + 17] == 110 else (0, 0, 0))
                        continue
                    for i in range(n):
                        place, _, use = p.next(), p.next(), p.next()
                        if use == Word(b"n"):
                            self.at.setdefault(start + i, (1, place, 0))
                        else:
                            self.at.setdefault(start + i, (0, 0, 0))
                head = p.next()
                todo += [head["XRefStm"]] if isinstance(head.get("XRefStm"), int) else []
            elif isinstance(first, int):
                stream = self._object(at, None)
                head, data = stream.head, self.data_of(stream)
                w = head["W"]
                size, ranges = sum(w), head.get("Index") or [0, head["Size"]]
                i = 0
                for start, n in zip(ranges[::2], ranges[1::2], strict=True):
                    for number in range(start, start + n):
                        row = data[i : i + size]
                        a, b, c = (int.from_bytes(row[sum(w[:k]) : sum(w[: k + 1])], "big") for k in range(3))
                        self.at.setdefault(number, (a if w[0] else 1, b, c))
                        i += size
            else:
                raise PdfError("no table of objects")
            for k, v in head.items():
                self.trailer.setdefault(k, v)
            todo += [head["Prev"]] if isinstance(head.get("Prev"), int) else []

    def _scan(self) -> None:
        """Objects wherever they begin, the last of a number counts."""
        self.at, self.kept, self.inside = {int(m[1]): (1, m.start(), 0) for m in OBJECT.finditer(self.data)}, {}, {}
        self.trailer = {k: v for k, v in self.trailer.items() if k == "Encrypt"}
        for m in re.finditer(rb"trailer", self.data):
            head = Parser(self.data, m.end()).next()
            if isinstance(head, dict):
                self.trailer |= head
        root = None
        for number in list(self.at):
            try:
                own = self.of(Ref(number))
            except Exception:
                continue
            head = own.head if isinstance(own, Stream) else own
            if not isinstance(head, dict):
                continue
            if head.get("Type") == "ObjStm":
                for i, inner in enumerate(self._numbers(number)):
                    if inner not in self.at:
                        self.at[inner] = (2, number, i)
                        if isinstance(inside := self.of(Ref(inner)), dict) and inside.get("Type") == "Catalog":
                            root = Ref(inner)
            elif head.get("Type") == "Catalog":
                root = Ref(number)
            elif head.get("Type") == "XRef" and "Encrypt" in head:
                self.trailer["Encrypt"] = head["Encrypt"]
        if root is None and not isinstance(self.of(self.trailer.get("Root")), dict):
            raise PdfError("the PDF has no catalogue")
        self.trailer["Root"] = root or self.trailer["Root"]

    def _object(self, at: int, number: int | None):
        p = Parser(self.data, at)
        own, _, word = p.next(), p.next(), p.next()
        if word != Word(b"obj") or (number is not None and own != number):
            raise PdfError(f"object {number} is not where it should be")
        out = p.next()
        if isinstance(out, dict):
            after = p.at
            if p.next() == Word(b"stream"):
                begin = p.at + (2 if self.data[p.at : p.at + 2] == b"\r\n" else 1 if self.data[p.at : p.at + 1] in (b"\n", b"\r") else 0)
                n = self.of(out.get("Length"))
                if not isinstance(n, int) or n < 0 or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, begin + n):
                    end = self.data.find(b"endstream", begin)
                    n = (end if end >= 0 else len(self.data)) - begin
                return Stream(out, self.data[begin : begin + n])
            p.at = after
        return None if isinstance(out, Word) or out is END else out

    def _numbers(self, number: int) -> list[int]:
        """Of a stream of objects: their numbers; the objects are kept."""
        if number not in self.inside:
            self.inside[number] = ([], [])
            stream = self.of(Ref(number))
            data, n, first = self.data_of(stream), self.of(stream.head["N"]), self.of(stream.head["First"])
            p = Parser(data)
            pairs = [(p.next(), p.next()) for _ in range(min(n, len(data)))]
            self.inside[number] = ([a for a, _ in pairs], [Parser(data, first + b).next() for _, b in pairs])
        return self.inside[number][0]

    def of(self, x):
        """The object itself; null where there is none."""
        for _ in range(DEEPEST):
            if not isinstance(x, Ref):
                return x
            number = x.number
            if number not in self.kept:
                kind, a, b = self.at.get(number, (0, 0, 0))
                self.kept[number] = None  # an object that needs itself is null
                if kind == 1:
                    self.kept[number] = self._object(a, number)
                elif kind == 2:
                    numbers = self._numbers(a)
                    i = b if b < len(numbers) and numbers[b] == number else numbers.index(number) if number in numbers else None
                    self.kept[number] = None if i is None else self.inside[a][1][i]
            x = self.kept[number]
        return None

    def dict(self, x) -> dict:
        x = self.of(x)
        return x if isinstance(x, dict) else x.head if isinstance(x, Stream) else {}

    def list(self, x) -> list:
        x = self.of(x)
        return x if isinstance(x, list) else [] if x is None else [x]

    def numbers(self, x) -> list[float]:
        return [v if isinstance(v := self.of(i), (int, float)) else 0 for i in self.list(x)]

    def data_of(self, stream: Stream) -> bytes:
        data = stream.raw
        parms = self.list(stream.head.get("DecodeParms", stream.head.get("DP")))
        for i, way in enumerate(self.list(stream.head.get("Filter", stream.head.get("F")))):
            own = {k: self.of(v) for k, v in self.dict(parms[i]).items()} if i < len(parms) else {}
            way = self.of(way)
            if way in ("FlateDecode", "Fl"):
                data = unpredicted(inflated(data), own)
            elif way in ("LZWDecode", "LZW"):
                data = unpredicted(lzw(data, own.get("EarlyChange", 1)), own)
            elif way in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif way in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif way in ("RunLengthDecode", "RL"):
                data = run_lengths(data)
            elif way != "Crypt":
                raise PdfError(f"no filter {way}")
        return data

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""
        seen: set[int] = set()
        todo = [(self.dict(self.trailer.get("Root")).get("Pages"), {})]
        while todo:
            ref, given = todo.pop()
            if isinstance(ref, Ref):
                if ref.number in seen:
                    continue
                seen.add(ref.number)
            own = given | {k: v for k, v in self.dict(ref).items() if v is not None}
            if "Kids" in own and own.get("Type") != "Page":
                passed = {k: own[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in own}
                todo += [(kid, passed) for kid in reversed(self.list(own["Kids"]))]
            elif self.dict(ref):
                yield own


# Fonts --------------------------------------------------------------------------------------------------------------

#: The upper half of the standard encoding that differs from Latin-1, by code.
STANDARD = dict(zip(
    [0x27, 0x60, *range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xD0, 0xE1, 0xE3, *range(0xE8, 0xEC), 0xF1, 0xF5, *range(0xF8, 0xFC)],
    "’‘¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß", strict=True))
#: Names of glyphs that are neither letters with accents nor Unicode's names without spaces.
GLYPHS = dict(zip(
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot registered macron degree plusminus acute mu paragraph periodcentered cedilla ordmasculine guillemotright onequarter onehalf threequarters questiondown AE multiply Oslash Thorn germandbls ae divide oslash thorn Eth eth dotlessi Lslash lslash OE oe florin circumflex tilde breve dotaccent ring ogonek caron hungarumlaut endash emdash quoteleft quoteright quotesinglbase quotedblleft quotedblright quotedblbase dagger daggerdbl bullet ellipsis perthousand guilsinglleft guilsinglright fraction Euro trademark minus fi fl ff ffi ffl nbspace sfthyphen nonbreakingspace softhyphen".split(),
    [*" !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿Æ×ØÞßæ÷øþÐðıŁłŒœƒˆ˜˘˙˚˛ˇ˝–—‘’‚“”„†‡•…‰‹›⁄€™−", "fi", "fl", "ff", "ffi", "ffl", "\xa0", "\xad", "\xa0", "\xad"], strict=True))
#: Accents in glyph names, and their combining characters.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "commaaccent": "̧"}
#: Widths of space to tilde, in thousandths, of the two proportional standard fonts.
HELVETICA = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, *[556] * 10, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
TIMES = [250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, *[500] * 10, 278, 278, 564, 564, 564, 444, 921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500, 333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541]


@cache
def glyph_text(name: str) -> str | None:
    """The characters of a glyph's name."""
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    name, dot, _ = name.partition(".")
    if dot:
        return glyph_text(name) if name else None
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    if re.fullmatch("uni(?:[0-9A-F]{4})+", name):
        return bytes.fromhex(name[3:]).decode("utf-16-be", "replace")
    if re.fullmatch("u[0-9A-F]{4,6}", name) and int(name[1:], 16) < 0x110000:
        return chr(int(name[1:], 16))
    for accent, mark in ACCENTS.items():
        if name.endswith(accent) and len(name) == len(accent) + 1:
            return unicodedata.normalize("NFC", name[0] + mark)
    for form in (f"GREEK SMALL LETTER {name}", f"GREEK CAPITAL LETTER {name}", name):
        if form != f"GREEK SMALL LETTER {name}" or name.islower():
            try:
                return unicodedata.lookup(form.upper())
            except KeyError:
                continue
    return None


def encoding_named(name: str | None) -> dict[int, str]:
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        return {i: t for i in range(32, 256) if (t := bytes([i]).decode(codec, "ignore"))}
    return {i: chr(i) for i in range(32, 127)} | STANDARD


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


#: Whole sections of single characters, one after the other; codes in them.
SECTIONS = re.compile(rb"(?:[\t\n\x0c\r ]*[0-9]+[\t\n\x0c\r ]+beginbfchar(?:[\t\n\x0c\r ]*<(?:[0-9A-Fa-f]{2})*>[\t\n\x0c\r ]*<(?:[0-9A-Fa-f]{2})*>)*+[\t\n\x0c\r ]*endbfchar(?=[\t\n\x0c\r ]|\Z))++")
IN_HEX = re.compile(rb"<([0-9A-Fa-f]*)>")


class CMap:
    """Ranges of codes, and what codes map to: characters (bf) or glyph numbers (cid)."""

    def __init__(self, data: bytes = b""):
        self.spaces: list[tuple[bytes, bytes]] = []
        self.chars: dict[bytes, str] = {}
        self.cids: dict[bytes, int] = {}
        self.cid_ranges: list[tuple[bytes, bytes, int]] = []
        self.char_ranges: list[tuple[bytes, bytes, bytes]] = []
        p, held = Parser(data, refs=False), []
        while True:
            if not held and (m := SECTIONS.match(data, p.at)):
                codes, p.at = [bytes.fromhex(c.decode()) for c in IN_HEX.findall(data, p.at, m.end())], m.end()
                self.chars |= zip(codes[::2], map(utf16, codes[1::2]), strict=True)
            if (x := p.next()) is END:
                break
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == b"endcodespacerange":
                self.spaces += [(a, b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif x == b"endbfchar":
                self.chars |= {a: utf16(b) if isinstance(b, bytes) else glyph_text(b) or "" for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, (bytes, Name))}
            elif x == b"endcidchar":
                self.cids |= {a: b for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, int)}
            elif x in (b"endbfrange", b"endcidrange"):
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    if isinstance(c, list):
                        lo = int.from_bytes(a, "big")
                        self.chars |= {(lo + i).to_bytes(len(a), "big"): utf16(t) for i, t in enumerate(c) if isinstance(t, bytes) and lo + i < 256 ** len(a)}
                    elif isinstance(c, bytes):
                        self.char_ranges.append((a, b, c))
                    elif isinstance(c, int):
                        self.cid_ranges.append((a, b, c))
            held = []

    def text(self, code: bytes) -> str | None:
        if code in self.chars:
            return self.chars[code]
        for a, b, to in self.char_ranges:
            if len(a) == len(code) and a <= code <= b:
                up = int.from_bytes(to, "big") + int.from_bytes(code, "big") - int.from_bytes(a, "big")
                self.chars[code] = utf16(up.to_bytes(len(to) + 1, "big")[-len(to) :] if to else b"")
                return self.chars[code]
        return None

    def cid(self, code: bytes) -> int:
        if code in self.cids:
            return self.cids[code]
        for a, b, to in self.cid_ranges:
            if len(a) == len(code) and a <= code <= b:
                return to + int.from_bytes(code, "big") - int.from_bytes(a, "big")
        return int.from_bytes(code, "big")


class Font:
    """Codes of a shown string with their texts and widths."""

    def __init__(self, file: File, head: dict):
        self.kept: dict[bytes, tuple[str, float, bool]] = {}
        self.lines: dict[bytes, tuple[list[tuple], int, float, int, bool] | None] = {}
        self.plain: dict[bytes, tuple[str | None, float]] = {}  # codes' characters (NUL: white space, null: none or several) and widths
        to = file.of(head.get("ToUnicode"))
        self.unicode = CMap(file.data_of(to)) if isinstance(to, Stream) else None
        self.composite = head.get("Subtype") == "Type0"
        self.scale, self.size = 0.001, 0  # size: of all codes, if over one byte
        own = head
        if self.composite:
            own = file.dict((file.list(head.get("DescendantFonts")) or [{}])[0])
            coding = file.of(head.get("Encoding"))
            self.cmap = CMap(file.data_of(coding)) if isinstance(coding, Stream) else CMap()
            self.wide = isinstance(coding, str) and ("UCS2" in coding or "UTF16" in coding)
            self.spaces = self.cmap.spaces or [(b"\0\0", b"\xff\xff")]
            self.sizes = sorted({len(a) for a, _ in self.spaces if a}) or [2]
            self.size = self.sizes[0] if len(self.sizes) == 1 and self.sizes[0] > 1 else 0
            self.default = file.of(own.get("DW", 1000))
            self.widths: dict[int, float] = {}
            w, i = file.list(own.get("W")), 0
            while i + 1 < len(w):
                first, then = file.of(w[i]), file.of(w[i + 1])
                if isinstance(then, list):
                    self.widths |= {first + k: v for k, v in enumerate(file.numbers(then))}
                    i += 2
                elif i + 2 < len(w):
                    each = file.of(w[i + 2])
                    self.widths |= {k: each for k in range(first, min(then, first + 65536) + 1)}
                    i += 3
                else:
                    break
        else:
            coding = file.of(head.get("Encoding"))
            name = coding if isinstance(coding, str) else file.of(coding.get("BaseEncoding")) if isinstance(coding, dict) else None
            base = str(file.of(head.get("BaseFont")) or "")
            self.texts: dict[int, str | None] = dict(encoding_named(name))
            at = 0
            for x in file.list(coding.get("Differences")) if isinstance(coding, dict) else ():
                x = file.of(x)
                if isinstance(x, Name):
                    self.texts[at] = glyph_text(x)
                    at += 1
                elif isinstance(x, int):
                    at = x
            self.first, given = file.of(head.get("FirstChar", 0)), file.numbers(head.get("Widths"))
            self.default = file.dict(head.get("FontDescriptor")).get("MissingWidth", 0)
            if given:
                self.widths = {self.first + i: v for i, v in enumerate(given)}
            else:
                plain = [600] * 95 if "Courier" in base else TIMES if "Times" in base else HELVETICA
                self.widths, self.default = {32 + i: v for i, v in enumerate(plain)}, 600 if "Courier" in base else 556
            if head.get("Subtype") == "Type3":
                self.scale = abs((file.numbers(head.get("FontMatrix")) or [0.001])[0]) or 0.001
        about = file.dict(own.get("FontDescriptor"))
        up, down = file.of(about.get("Ascent")), file.of(about.get("Descent"))
        self.up = min(up, 1200) / 1000 if isinstance(up, (int, float)) and up > 300 else 0.8
        self.down = max(down, -500) / 1000 if isinstance(down, (int, float)) and down < 0 else -0.2

    def codes(self, raw: bytes) -> Iterator[bytes]:
        if not self.composite:
            for i in range(len(raw)):
                yield raw[i : i + 1]
            return
        i, sizes = 0, self.sizes
        if len(sizes) == 1:  # codes of one length are cut alike, in a range or not
            for i in range(0, len(raw), sizes[0]):
                yield raw[i : i + sizes[0]]
            return
        while i < len(raw):
            for n in sizes:
                code = raw[i : i + n]
                if any(len(a) == n and all(x <= c <= y for x, c, y in zip(a, code, b, strict=False)) for a, b in self.spaces) and len(code) == n:
                    break
            else:
                code = raw[i : i + sizes[0]]
            yield code
            i += len(code)

    def shown(self, raw: bytes) -> Iterator[tuple[str, float, bool]]:
        """(text, width in text units, whether word spacing applies) of each code."""
        kept = self.kept
        for code in self.codes(raw):
            if code not in kept:
                text = self.unicode.text(code) if self.unicode else None
                if self.composite:
                    if text is None:
                        text = code.decode("utf-16-be", "replace") if self.wide else "�"
                    width = self.widths.get(self.cmap.cid(code), self.default)
                else:
                    if text is None:
                        text = self.texts.get(code[0])
                    width = self.widths.get(code[0], self.default)
                    text = "�" if text is None else text
                kept[code] = (text.replace("\0", ""), (width or 0) * self.scale, code == b" ")
            yield kept[code]

    def line(self, raw: bytes) -> tuple[list[tuple], int, float, int, bool] | None:
        """The string's runs between white space, and of all of it: codes, width, codes with word spacing, whether white space
        ends it. A run: its text, codes, width and codes with word spacing before it, its own codes and width, whether
        white space is before it. None where glyphs must be placed one by one: those without a text, with white space among letters,
        of a width below zero, or with word spacing inside a run."""
        if raw not in self.lines:
            self.lines[raw] = self._line(raw)
        return self.lines[raw]

    def _even(self, raw: bytes) -> tuple[list[tuple], int, float, int, bool] | None:
        """line() for codes of one length over a byte that all stand for one character."""
        codes = [raw[i : i + self.size] for i in range(0, len(raw), self.size)]
        for code in {*codes} - self.plain.keys():
            ((text, width, space),) = self.shown(code)
            self.plain[code] = ("\0" if text.isspace() else text if len(text) == 1 and width >= 0 and not space else None, width)
        found = [self.plain[code] for code in codes]
        try:
            parts = "".join([t for t, _ in found]).split("\0")
        except TypeError:
            return None
        widths = [w for _, w in found]
        runs, at, before = [], 0, 0.0
        for i, text in enumerate(parts):
            own = sum(widths[at : at + len(text)])
            if text:
                runs.append((text, at, before, 0, len(text), own, i > 0))
            at += len(text) + 1
            before += own + (widths[at - 1] if at <= len(widths) else 0.0)
        return runs, len(widths), before, 0, len(parts) > 1 and not parts[-1]

    def bulk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Characters (0: white space) and widths of codes of one length; None where line() may have to place glyphs one by one."""
        unit = self.size or 1
        here = np.flatnonzero(np.bincount(codes)).tolist()
        chars, widths = np.zeros(here[-1] + 1, "<u4"), np.zeros(here[-1] + 1)
        for number in here:
            code = number.to_bytes(unit, "big")
            if code not in self.plain:
                ((text, width, space),) = self.shown(code)
                self.plain[code] = ("\0" if text.isspace() else text if len(text) == 1 and width >= 0 and not space else None, width)
            text, widths[number] = self.plain[code]
            if text is None:
                return None
            chars[number] = ord(text)
        return chars[codes], widths[codes]

    def _line(self, raw: bytes) -> tuple[list[tuple], int, float, int, bool] | None:
        if self.size and (runs := self._even(raw)) is not None:
            return runs
        runs, texts = [], []
        n, wide, spaced, parted, at, before = 0, 0.0, 0, False, 0, 0.0
        for text, width, space in self.shown(raw):
            if text.isspace():
                if texts:
                    runs.append(("".join(texts), at, before, spaced, n - at, wide - before, parted))
                    texts = []
                parted = True
                spaced += space
            elif space or width < 0 or not text or len(text) > 1 and WHITE.search(text):
                return None
            else:
                if not texts:
                    at, before = n, wide
                texts.append(text)
            n += 1
            wide += width
        if texts:
            runs.append(("".join(texts), at, before, spaced, n - at, wide - before, parted))
        return runs, n, wide, spaced, parted and not texts


# Contents -----------------------------------------------------------------------------------------------------------

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


@dataclass(slots=True)
class Shown:
    """A word: its text, rectangle, direction, size and where its last glyph ends."""

    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    along: tuple[float, float]
    size: float
    end: tuple[float, float]

    @property
    def height(self) -> float:
        return self.y1 - self.y0


@dataclass
class State:
    ctm: Matrix = UNIT
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    wide: float = 1.0
    lead: float = 0.0
    rise: float = 0.0


#: Parts of an em: a gap that parts words, steps back and aside that do.
GAP, BACK, ASIDE = 0.18, 0.5, 0.3
WHITE = re.compile(r"\s+")
#: An operator with what most have before it: a name, numbers, a string in hexadecimal digits.
OPERATION = re.compile(
    rb"[\t\n\x0c\r ]*(?:/([^\x00\t\n\x0c\r \[\]()<>/%{}#]*)[\t\n\x0c\r ]+)?((?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)[\t\n\x0c\r ]+)*)(?:<([0-9A-Fa-f]*)>[\t\n\x0c\r ]*)?"
    rb"([A-Za-z'\"][^\x00\t\n\x0c\r \[\]()<>/%{}]*)"
)
#: The rest of a text object of one string, and of as many as follow each other: font, size, place, string (hexadecimal or plain).
_ALONE = (
    rb"[\t\n\x0c\r ]+/([^\x00\t\n\x0c\r \[\]()<>/%{}#]*)[\t\n\x0c\r ]+([0-9]+\.?[0-9]*|\.[0-9]+)[\t\n\x0c\r ]+Tf[\t\n\x0c\r ]+([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))[\t\n\x0c\r ]+([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))"
    rb"[\t\n\x0c\r ]+Td[\t\n\x0c\r ]*(?:<((?:[0-9A-Fa-f]{2})*)>|\(([^()\\]*)\))[\t\n\x0c\r ]*Tj[\t\n\x0c\r ]+ET(?=[\t\n\x0c\r ]|\Z)"
)
ALONE = re.compile(_ALONE)
ALL_ALONE = re.compile(rb"%s(?:[\t\n\x0c\r ]+BT%s)*+" % (_ALONE, _ALONE))
#: Operators that matter here.
OPERATORS = frozenset(b"Tj ' \" TJ BT Td TD T* Tm Tf Tc Tw TL Ts Tz q Q cm Do ID".split())


@dataclass(slots=True)
class Batch:
    """Upright words as columns: texts, rectangles, sizes, where their last glyphs end; their direction, and whether the last
    may go on."""

    texts: list[str]
    box: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    sizes: np.ndarray
    ends: tuple[np.ndarray, np.ndarray]
    along: tuple[float, float]
    is_open: bool

    def shown(self) -> list[Shown]:
        return list(map(Shown, self.texts, *(v.tolist() for v in self.box), [self.along] * len(self.texts), self.sizes.tolist(), zip(*(v.tolist() for v in self.ends), strict=True)))


@dataclass
class Page:
    """What a page shows: words in the order drawn, and whether it shows pictures."""

    file: File
    base: Matrix
    drawn: list[Shown] = field(default_factory=list)
    batch: Batch | None = None  # words drawn after those, not yet made one by one
    pictures: bool = False
    fonts: dict[int, Font] = field(default_factory=dict)
    open: Shown | None = None
    running: set[int] = field(default_factory=set)
    under: tuple[Matrix, Matrix] | None = None  # what lies under the text's matrix, and what it gives with the page's

    @property
    def words(self) -> list[Shown]:
        if self.batch is not None:
            batch, self.batch = self.batch, None
            self.drawn += batch.shown()
            self.open = self.drawn[-1] if batch.is_open else None
        return self.drawn

    def glyph(self, text: str, state: State, tm: Matrix, width: float) -> None:
        words = self.words
        font, size = state.font, state.size
        m = times((size * state.wide, 0.0, 0.0, size, 0.0, state.rise), times(times(tm, state.ctm), self.base))
        a, b, c, d, e, f = m
        em = (c * c + d * d) ** 0.5
        if em < 1e-6 or not text:
            return
        if text.isspace():
            self.open = None
            return
        corners = [(a * x + c * y + e, b * x + d * y + f) for x in (0.0, width) for y in (font.down, font.up)]
        x0, x1, y0, y1 = min(p[0] for p in corners), max(p[0] for p in corners), min(p[1] for p in corners), max(p[1] for p in corners)
        length = (a * a + b * b) ** 0.5 or 1.0
        step = width + (state.char / size if size else 0.0)  # letters that are spaced out follow each other still
        along, end = (a / length, b / length), (a * step + e, b * step + f)
        w = self.open
        if w is not None:
            dx, dy = e - w.end[0], f - w.end[1]
            forward, aside = dx * w.along[0] + dy * w.along[1], abs(dx * w.along[1] - dy * w.along[0])
            if not (-BACK * em <= forward < GAP * em and aside < ASIDE * em and w.along[0] * along[0] + w.along[1] * along[1] > 0.9):
                w = None
        if w is None:
            self.open = Shown("", x0, y0, x1, y1, along, em, end)
            words.append(self.open)
            w = self.open
        for i, part in enumerate(WHITE.split(text)):  # a glyph may stand for several characters
            if i:
                w = self.open = Shown("", x0, y0, x1, y1, along, em, end)
                words.append(w)
            w.text += part
        w.x0, w.y0, w.x1, w.y1, w.end, w.size = min(w.x0, x0), min(w.y0, y0), max(w.x1, x1), max(w.y1, y1), end, max(w.size, em)

    def string(self, raw: bytes, state: State, tm: Matrix) -> Matrix | None:
        """Shows a string run by run, since the glyphs of a run follow each other without a gap, and gives the matrix behind it;
        None, with nothing shown, where glyphs must be placed one by one: see Font.line."""
        font, size, char = state.font, state.size, state.char
        if not size or char and (char < 0 or size < 0) or (made := font.line(raw)) is None:
            return None
        runs, n, wide, spaced, ends_open = made
        if self.under is None or self.under[0] is not state.ctm:
            self.under = (state.ctm, times(state.ctm, self.base))
        g, h, i, j, k, l = times(tm, self.under[1])  # noqa: E741
        a, b, c, d, e, f = size * state.wide * g, size * state.wide * h, size * i, size * j, state.rise * i + k, state.rise * j + l
        em, length = (c * c + d * d) ** 0.5, (a * a + b * b) ** 0.5
        if em < 1e-6 or not length:
            return None
        char, word, along, words = char / size, state.word / size, (a / length, b / length), self.words
        for text, at, before, blanks, own, width, parted in runs:
            u = before + at * char + blanks * word
            v, step = u + width + (own - 1) * char, u + width + own * char
            x, y, z, t = a * u + e, b * u + f, a * v + e, b * v + f
            if b == 0.0 and c == 0.0:
                x0, x1 = (x, z) if x < z else (z, x)
                y0, y1 = d * font.down + f, d * font.up + f
                if y1 < y0:
                    y0, y1 = y1, y0
            else:
                xs, ys = [p + c * h for p in (x, z) for h in (font.down, font.up)], [p + d * h for p in (y, t) for h in (font.down, font.up)]
                x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
            end = (a * step + e, b * step + f)
            w = None if parted else self.open
            if w is not None:
                dx, dy = x - w.end[0], y - w.end[1]
                forward, aside = dx * w.along[0] + dy * w.along[1], abs(dx * w.along[1] - dy * w.along[0])
                if not (-BACK * em <= forward < GAP * em and aside < ASIDE * em and w.along[0] * along[0] + w.along[1] * along[1] > 0.9):
                    w = None
            if w is None:
                self.open = Shown(text, x0, y0, x1, y1, along, em, end)
                words.append(self.open)
            else:
                w.text += text
                w.x0, w.y0, w.x1, w.y1, w.end, w.size = min(w.x0, x0), min(w.y0, y0), max(w.x1, x1), max(w.y1, y1), end, max(w.size, em)
        if ends_open:
            self.open = None
        step = (wide * size + n * state.char + spaced * state.word) * state.wide
        return (*tm[:4], step * tm[0] + tm[4], step * tm[1] + tm[5])

    def strings(self, found: list[tuple], fonts: dict, state: State) -> tuple[Matrix, Matrix] | None:
        """Shows text objects of one string each as string() does, all at once; gives the matrices before and behind the last and
        leaves its font and size in the state. None, with nothing shown, where one has another font, or string() is needed."""
        names, sizes, xs, ys, digits, plain = zip(*found, strict=True)
        if len({*names}) > 1:
            return None
        font, char = self.font_named(fonts, Name(names[0].decode("latin-1"))), state.char
        unit = font.size or 0 if font.composite else 1
        if unit not in (1, 2) or char < 0 or state.word and unit == 1:
            return None
        size, x, y = (np.fromiter(map(float, v), float, len(v)) for v in (sizes, xs, ys))
        if any(plain):
            raws = [bytes.fromhex(h.decode()) if h else t for h, t in zip(digits, plain, strict=True)]
            raw, sized = b"".join(raws), np.fromiter(map(len, raws), np.int64, len(raws))
        else:
            raw, sized = bytes.fromhex(b"".join(digits).decode()), np.fromiter(map(len, digits), np.int64, len(digits)) // 2
        if not raw or (sized % unit).any() or (known := font.bulk(codes := np.frombuffer(raw, ">u2" if unit == 2 else np.uint8))) is None:
            return None
        ctm = times(state.ctm, self.base)
        g, h, i, j, k, l = ctm  # noqa: E741
        if h or i or not g or not state.wide or np.abs(size * j).min() < 1e-6:
            return None
        chars, widths = known
        ends = np.cumsum(sized // unit)
        starts = ends - sized // unit
        first = np.zeros(len(codes) + 1, bool)
        first[starts] = True
        black = chars != 0
        white_before = np.concatenate(([True], ~black[:-1]))
        begins = np.flatnonzero(black & (white_before | first[:-1]))
        if not len(begins):
            return None
        stops = np.flatnonzero(black & np.concatenate((~black[1:] | first[1:-1], [True]))) + 1
        of = np.searchsorted(ends, begins, "right")
        run = np.concatenate(([0.0], np.cumsum(widths)))
        a, d = size * state.wide * g, size * j
        e, f = state.rise * i + (x * g + y * i + k), state.rise * j + (x * h + y * j + l)
        em, spread = np.abs(d)[of], (char / size)[of]
        u = run[begins] - run[starts[of]] + (begins - starts[of]) * spread
        width, own = run[stops] - run[begins], stops - begins
        left, right, past = (a[of] * v + e[of] for v in (u, u + width + (own - 1) * spread, u + width + own * spread))
        x0, x1 = np.minimum(left, right), np.maximum(left, right)
        low, high = (d * font.down + f)[of], (d * font.up + f)[of]
        y0, y1, level = np.minimum(low, high), np.maximum(low, high), f[of]
        ahead = 1.0 if g * state.wide > 0 else -1.0
        # a run that nothing parts from the one before it may go on with that one's word
        near = (left[1:] - past[:-1]) * ahead
        joins = (begins[1:] == stops[:-1]) & (near >= -BACK * em[1:]) & (near < GAP * em[1:]) & (np.abs(level[1:] - level[:-1]) < ASIDE * em[1:])
        text = chars.tobytes().decode("utf-32-le", "surrogatepass")
        words, last = self.words, self.open if black[0] else None
        if last is not None:
            dx, dy = left[0] - last.end[0], level[0] - last.end[1]
            forward, aside = dx * last.along[0] + dy * last.along[1], abs(dx * last.along[1] - dy * last.along[0])
            if -BACK * em[0] <= forward < GAP * em[0] and aside < ASIDE * em[0] and last.along[0] * ahead > 0.9:
                return None
        texts = [text[p:q] for p, q in zip(begins.tolist(), stops.tolist(), strict=True)]
        self.batch = Batch(texts, (x0, y0, x1, y1), em, (past, level), (ahead, 0.0), bool(black[-1]))
        if joins.any():
            made, self.batch = self.batch.shown(), None
            for w, join in zip(made, [False, *joins.tolist()], strict=True):
                if join:
                    o = words[-1]
                    o.text += w.text
                    o.x0, o.y0, o.x1, o.y1, o.end, o.size = min(o.x0, w.x0), min(o.y0, w.y0), max(o.x1, w.x1), max(o.y1, w.y1), w.end, max(o.size, w.size)
                else:
                    words.append(w)
            self.open = words[-1] if black[-1] else None
        state.font, state.size = font, float(size[-1])
        at, down = float(x[-1]), float(y[-1])
        step = (float(run[ends[-1]] - run[starts[-1]]) * state.size + int(ends[-1] - starts[-1]) * char) * state.wide
        return (1.0, 0.0, 0.0, 1.0, at, down), (1.0, 0.0, 0.0, 1.0, at + step, down)

    def font_named(self, fonts: dict, name: Name | None) -> Font:
        ref = fonts.get(name)
        key = ref.number if isinstance(ref, Ref) else id(ref)
        if key not in self.fonts:
            self.fonts[key] = Font(self.file, self.file.dict(ref))
        return self.fonts[key]

    def run(self, data: bytes, resources: dict, state: State, depth: int = 0) -> None:
        file, stack, held = self.file, [], []
        fonts, forms = file.dict(resources.get("Font")), file.dict(resources.get("XObject"))
        tm = line = UNIT
        p, tried = Parser(data, refs=False), 0  # text objects before `tried` are shown one by one
        copy = lambda s: State(**s.__dict__)

        def show(raw: bytes) -> None:
            nonlocal tm
            if state.font is None or not isinstance(raw, bytes):
                return
            if (behind := self.string(raw, state, tm)) is not None:
                tm = behind
                return
            for text, width, spaced in state.font.shown(raw):
                self.glyph(text, state, tm, width)
                step = (width * state.size + state.char + (state.word if spaced else 0.0)) * state.wide
                tm = (*tm[:4], step * tm[0] + tm[4], step * tm[1] + tm[5])

        def move(x: float, y: float) -> None:
            nonlocal tm, line
            a, b, c, d, e, f = line
            tm = line = (a, b, c, d, x * a + y * c + e, x * b + y * d + f)

        while True:
            if not held and (m := OPERATION.match(data, p.at)) and m[4] not in CONSTANTS:
                p.at, (name, numbers, digits, x) = m.end(), m.groups()
                if x not in OPERATORS:
                    continue
                if name is not None:
                    held.append(Name(name.decode("latin-1")))
                held += [float(v) if b"." in v else int(v) for v in numbers.split()]
                if digits is not None:
                    held.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
            elif (x := p.next()) is END:
                break
            elif not isinstance(x, Word):
                held.append(x)
                if len(held) > 10_000:
                    held = held[-10:]
                continue
            elif x not in OPERATORS:
                held = []
                continue
            n = [v for v in held if isinstance(v, (int, float)) and not isinstance(v, bool)]
            last = held[-1] if held else None
            if x in (b"Tj", b"'", b'"'):
                if x == b'"' and len(n) >= 2:
                    state.word, state.char = n[0], n[1]
                if x != b"Tj":
                    move(0.0, -state.lead)
                show(last)
            elif x == b"TJ" and isinstance(last, list):
                for part in last:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        step = -part / 1000 * state.size * state.wide
                        tm = (*tm[:4], step * tm[0] + tm[4], step * tm[1] + tm[5])
            elif x == b"BT":
                tm = line = UNIT
                if p.at >= tried and (m := ALL_ALONE.match(data, p.at)):
                    tried = m.end()
                    try:
                        shown = self.strings(ALONE.findall(data, p.at, tried), fonts, state)
                    except (TypeError, ValueError, OverflowError):  # a font that fails does so at the string that needs it
                        shown = None
                    if shown is not None:
                        line, tm = shown
                        p.at = tried
            elif x in (b"Td", b"TD") and len(n) >= 2:
                state.lead = -n[1] if x == b"TD" else state.lead
                move(n[0], n[1])
            elif x == b"T*":
                move(0.0, -state.lead)
            elif x == b"Tm" and len(n) >= 6:
                tm = line = tuple(map(float, n[-6:]))
            elif x == b"Tf" and held and n:
                name = next((v for v in held if isinstance(v, Name)), None)
                state.font, state.size = self.font_named(fonts, name), float(n[-1])
            elif x in (b"Tc", b"Tw", b"TL", b"Ts", b"Tz") and n:
                v = float(n[-1])
                if x == b"Tc":
                    state.char = v
                elif x == b"Tw":
                    state.word = v
                elif x == b"TL":
                    state.lead = v
                elif x == b"Ts":
                    state.rise = v
                else:
                    state.wide = v / 100
            elif x == b"q":
                stack.append(copy(state))
            elif x == b"Q" and stack:
                state = stack.pop()
            elif x == b"cm" and len(n) >= 6:
                state.ctm = times(tuple(map(float, n[-6:])), state.ctm)
            elif x == b"Do" and isinstance(last, Name):
                form = file.of(forms.get(last))
                if isinstance(form, Stream):
                    if form.head.get("Subtype") == "Image":
                        self.pictures = True
                    elif form.head.get("Subtype") == "Form" and depth < DEEPEST // 4 and id(form) not in self.running:
                        inner = copy(state)
                        inner.ctm = times(tuple(map(float, m)), state.ctm) if len(m := file.numbers(form.head.get("Matrix"))) == 6 else state.ctm
                        own = file.dict(form.head.get("Resources")) if "Resources" in form.head else resources
                        self.running.add(id(form))  # a form that shows itself shows nothing more
                        self.run(file.data_of(form), own, inner, depth + 1)
                        self.running.discard(id(form))
            elif x == b"ID":
                self.pictures = True
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, p.at)
                p.at = end.end() if end else len(data)
            held = []


def page_base(file: File, page: dict) -> Matrix:
    """From a page's own units to those of the shown page, y downwards."""
    box = file.numbers(page.get("CropBox")) or file.numbers(page.get("MediaBox"))
    x0, y0, x1, y1 = box if len(box) == 4 else (0, 0, 612, 792)
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    turn = file.of(page.get("Rotate", 0))
    turn = int(turn) % 360 if isinstance(turn, (int, float)) else 0
    if turn == 90:
        return (0.0, 1.0, 1.0, 0.0, -y0, -x0)
    if turn == 180:
        return (-1.0, 0.0, 0.0, 1.0, x1, -y0)
    if turn == 270:
        return (0.0, -1.0, -1.0, 0.0, y1, x1)
    return (1.0, 0.0, 0.0, -1.0, -x0, y1)


def pages_of(content: bytes) -> Iterator[Page]:
    """What each page shows. A page whose contents can't be read counts as one of pictures."""
    file = File(content)
    fonts: dict[int, Font] = {}
    for head in file.pages():
        page = Page(file, page_base(file, head), fonts=fonts)
        try:
            data = b"\n".join(file.data_of(s) for c in file.list(head.get("Contents")) if isinstance(s := file.of(c), Stream))
            page.run(data, file.dict(head.get("Resources")), State())
        except (PdfError, KeyError, TypeError, ValueError, IndexError, AttributeError, zlib.error, RecursionError):
            page.pictures = True
        page.drawn = [w for w in page.drawn if w.text]
        yield page


# Reading order ------------------------------------------------------------------------------------------------------

#: Heights of a line: a gap that parts segments of a row; rows that make columns, and words a segment has there.
STRIP, COLUMN_ROWS, COLUMN_WORDS = 1.2, 3, 2.0


def rows_of(words: list[Shown]) -> list[list[Shown]]:
    """Words whose middles lie within half a height of each other, from top to bottom, each row from left to right."""
    rows: list[tuple[float, float, list[Shown]]] = []
    for w in sorted(words, key=lambda w: (w.y0 + w.y1, w.x0)):
        middle = (w.y0 + w.y1) / 2
        if rows and abs(middle - rows[-1][0]) < 0.5 * min(w.height, rows[-1][1]):
            rows[-1][2].append(w)
        else:
            rows.append((middle, w.height or 1.0, [w]))
    return [sorted(r, key=lambda w: w.x0) for _, _, r in rows]


def segments_of(row: list[Shown]) -> list[list[Shown]]:
    out, right = [[row[0]]], row[0].x1
    for w in row[1:]:
        if w.x0 - right > STRIP * max(w.height, 1.0):
            out.append([])
        out[-1].append(w)
        right = max(right, w.x1)
    return out


def _free(segments: list[list[Shown]]) -> list[tuple[float, float]]:
    """The strips of a row that no segment covers, to both sides without end."""
    spans = [(s[0].x0, max(w.x1 for w in s)) for s in segments]
    return list(zip([float("-inf"), *(b for _, b in spans)], [*(a for a, _ in spans), float("inf")], strict=True))


def _common(a: list[tuple[float, float]], b: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    """A sweep over both lists of strips: what they share, if it is wide enough."""
    out, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        lo, hi = max(a[i][0], b[k][0]), min(a[i][1], b[k][1])
        if hi - lo > least:
            out.append((lo, hi))
        if a[i][1] < b[k][1]:
            i += 1
        else:
            k += 1
    return out


def one_column(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """lines_of() for rectangles of upright words whose rows lie clearly apart and have no gap that parts them, so that they are one
    block: their order and where in it rows begin; else None."""
    if not np.isfinite(x0 + x1 + y0 + y1).all():
        return None
    order = np.lexsort((x0, y0 + y1))
    x0, y0, x1, y1 = x0[order], y0[order], x1[order], y1[order]
    middle, height = (y0 + y1) / 2, y1 - y0
    new = middle[1:] != middle[:-1]
    begins = np.concatenate(([0], np.flatnonzero(new) + 1))
    # rows of one middle each, as far from the next as any two of their heights ask for
    most = np.maximum.reduceat(height, begins)
    if height.min() <= 0 or (np.diff(middle[begins]) < 0.5 * np.minimum(most[1:], most[:-1])).any():
        return None
    # the row's right edge so far is no less than that of the word before
    if (((x0[1:] - x1[:-1]) > STRIP * np.maximum(height[1:], 1.0)) & ~new).any():
        return None
    return order, begins


def lines_of(words: list[Shown]) -> list[list[list[Shown]]]:
    """Blocks of lines in reading order. Rows join a band while they share a strip free of words; a band of columns is read
    column by column, all else row by row."""
    turned = [w for w in words if abs(w.along[1]) > 0.5]
    words = [w for w in words if abs(w.along[1]) <= 0.5]
    bands: list[list[list[list[Shown]]]] = []
    strips: list[list[tuple[float, float]]] = []
    for row in rows_of(words):
        segments = segments_of(row)
        free = _free(segments)
        least = 0.6 * max(w.height for w in row)
        inner = free[1:-1]
        shared = _common(strips[-1], free, least) if strips and strips[-1] else []
        if shared and (len(segments) > 1 or bands[-1]):
            bands[-1].append(segments)
            strips[-1] = shared
        elif inner:
            bands.append([segments])
            strips.append(inner)
        elif strips and not strips[-1]:
            bands[-1].append(segments)
        else:
            bands.append([segments])
            strips.append([])
    out: list[list[list[Shown]]] = []
    for band, free in zip(bands, strips, strict=True):
        pieces = [s for row in band for s in row]
        if free and len(band) >= COLUMN_ROWS and sum(map(len, pieces)) >= COLUMN_WORDS * len(pieces):
            columns: list[list[list[Shown]]] = [[] for _ in range(len(free) + 1)]
            for row in band:
                own: list[list[Shown]] = [[] for _ in columns]
                for s in row:
                    own[sum(s[0].x0 >= lo + (hi - lo) / 2 for lo, hi in free)] += s
                for c, o in zip(columns, own, strict=True):
                    if o:
                        c.append(o)
            out += [c for c in columns if c]
        else:
            out.append([[w for s in row for w in s] for row in band])
    return out + ([[[w] for w in turned]] if turned else [])


def placed(content: bytes) -> tuple[tuple[list, ...], int, list[int]]:
    """words() as columns: their texts, pages, x, y, widths and heights."""
    out: tuple[list, ...] = ([], [], [], [], [], [])
    n, blind = 0, []
    for n, page in enumerate(pages_of(content), 1):  # noqa: B007
        if page.batch is not None and not page.drawn and (column := one_column(*page.batch.box)) is not None:
            order, texts = column[0], page.batch.texts
            x0, y0, x1, y1 = (v[order] for v in page.batch.box)
            found = [texts[i] for i in order.tolist()], x0.tolist(), y0.tolist(), (x1 - x0).tolist(), (y1 - y0).tolist()
        else:
            if page.pictures and not page.words:
                blind.append(n)
            own = [w for block in lines_of(page.words) for line in block for w in line]
            found = [w.text for w in own], [w.x0 for w in own], [w.y0 for w in own], [w.x1 - w.x0 for w in own], [w.y1 - w.y0 for w in own]
        texts, *boxes = found
        for column, more in zip(out, (texts, [n] * len(texts), *boxes), strict=True):
            column += more
    return out, n, blind


def words(content: bytes) -> tuple[list[dict], int, list[int]]:
    """(words in reading order with page, x, y, width, height; number of pages; pages that show pictures and no text)."""
    found, n, blind = placed(content)
    return [dict(zip(("word", "page", "x", "y", "width", "height"), w, strict=True)) for w in zip(*found, strict=True)], n, blind


def markdown(content: bytes) -> str:
    """The text layer: a line that reaches the edge of its block goes on in the next, a wider gap parts paragraphs, lines
    in clearly larger letters than most are headings."""
    pages = [lines_of(p.words) for p in pages_of(content)]
    sizes = sorted(w.size for p in pages for block in p for line in block for w in line)
    usual = sizes[len(sizes) // 2] if sizes else 0.0
    out: list[str] = []
    for page in pages:
        for block in page:
            right = max(w.x1 for line in block for w in line)
            text, last, head = "", None, False
            for line in block:
                own = " ".join(w.text for w in line)
                big = bool(own) and min(w.size for w in line) > 1.3 * usual and len(own) < 120
                if last is not None:
                    gap = min(w.y0 for w in line) - max(w.y1 for w in last)
                    follows = max(w.x1 for w in last) + 0.25 * last[-1].size + (line[0].x1 - line[0].x0) > right
                    text += "\n\n" if gap > 0.9 * max(w.height for w in line) or big != head else " " if follows and len(block) > 1 else "\n"
                text += "# " + own if big and not (text and text[-1] == " ") else own
                last, head = line, big
            out.append(text)
    return "\n\n".join(t for t in out if t)
