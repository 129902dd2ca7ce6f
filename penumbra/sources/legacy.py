"""Text of DOC, XLS and PPT files: compound files, Word's piece table, workbook records, slide records.

Texts of earlier saves that a presentation keeps are read too. Encrypted files are refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from .errors import IngestError, Unsupported
from .office import markdown_table

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Sector numbers from here are marks, not places.
MARKS = 0xFFFFFFFA


def streams(content: bytes, format: str) -> dict[str, bytes]:
    """The streams of a compound file by name; of equal names the first."""
    if not content.startswith(MAGIC):
        raise Unsupported(f"no extractor for {format} files that are no compound files")
    try:
        return _streams(content)
    except (struct.error, IndexError) as e:
        raise IngestError(f"the compound file is broken: {e}") from e


def _streams(content: bytes) -> dict[str, bytes]:
    shift, small = struct.unpack_from("<HH", content, 30)
    if not 7 <= shift <= 16 or not 4 <= small <= shift:
        raise IngestError("the compound file's sectors are broken")
    size, first_dir, _, cutoff, first_small, _, first_more, _ = 1 << shift, *struct.unpack_from("<IIIIIII", content, 48)
    sector = lambda n: content[(n + 1) << shift : (n + 2) << shift]
    listed = [n for n in struct.unpack_from("<109I", content, 76) if n < MARKS]
    seen: set[int] = set()
    while first_more < MARKS and first_more not in seen:
        seen.add(first_more)
        own = struct.unpack(f"<{size // 4}I", sector(first_more))
        listed += [n for n in own[:-1] if n < MARKS]
        first_more = own[-1]
    table = [x for n in listed for x in struct.unpack(f"<{size // 4}I", sector(n).ljust(size, b"\xff"))]

    def chain(n: int, next_: list[int]) -> Iterator[int]:
        seen = set()
        while n < MARKS and n < len(next_) and n not in seen:
            seen.add(n)
            yield n
            n = next_[n]

    whole = lambda n: b"".join(map(sector, chain(n, table)))
    raw, entries = whole(first_dir), []
    for i in range(0, len(raw) - 127, 128):
        length, kind = struct.unpack_from("<HB", raw, i + 64)
        start, n = struct.unpack_from("<IQ", raw, i + 116)
        entries.append((raw[i : i + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, start, n if shift > 9 else n & 0xFFFFFFFF))
    smalls = whole(first_small)
    small_table = list(struct.unpack(f"<{len(smalls) // 4}I", smalls[: len(smalls) // 4 * 4]))
    body = next((whole(start)[:n] for _, kind, start, n in entries if kind == 5), b"")
    out: dict[str, bytes] = {}
    for name, kind, start, n in entries:
        if kind == 2 and name not in out:
            data = whole(start) if n >= cutoff else b"".join(body[x << small : (x + 1) << small] for x in chain(start, small_table))
            out[name] = data[:n]
    return out


# Word ---------------------------------------------------------------------------------------------------------------

FIELD = re.compile("\x13[^\x13\x14\x15]*(\x14([^\x13\x14\x15]*))?\x15")


def from_doc(content: bytes) -> str:
    """Body, notes, headers and text boxes in the order of the file; cells end in tabs."""
    parts = streams(content, "doc")
    main = parts.get("WordDocument", b"")
    try:
        mark, flags = struct.unpack_from("<H", main)[0], struct.unpack_from("<H", main, 10)[0]
        if mark != 0xA5EC:
            raise IngestError("the DOC is of a kind that can't be read")
        if flags & 0x100:
            raise Unsupported("the DOC is encrypted")
        at, n = struct.unpack_from("<II", main, 0x1A2)
        return _shown("".join(_pieces(main, parts.get("1Table" if flags & 0x200 else "0Table", b"")[at : at + n])))
    except struct.error as e:
        raise IngestError(f"the DOC is broken: {e}") from e


def _pieces(main: bytes, table: bytes) -> Iterator[str]:
    at = 0
    while at < len(table) and table[at] == 1:
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at >= len(table) or table[at] != 2:
        raise IngestError("the DOC has no table of pieces")
    n = (struct.unpack_from("<I", table, at + 1)[0] - 4) // 12
    ends = struct.unpack_from(f"<{n + 1}I", table, at + 5)
    for i in range(n):
        place = struct.unpack_from("<I", table, at + 5 + 4 * (n + 1) + 8 * i + 2)[0]
        count = max(0, ends[i + 1] - ends[i])
        if place & 0x40000000:
            place = (place & 0x3FFFFFFF) // 2
            yield main[place : place + count].decode("cp1252", "replace")
        else:
            yield main[place : place + 2 * count].decode("utf-16-le", "replace")


def _shown(text: str) -> str:
    """What is seen of a text with marks: results of fields, not their codes; breaks as line ends."""
    while (plain := FIELD.sub(lambda m: m[2] or "", text)) != text:
        text = plain
    text = text.translate({0x0D: "\n", 0x07: "\t", 0x0B: "\n", 0x0C: "\n", 0x0E: "\n", 0x1E: "-", 0x1F: "", **dict.fromkeys((0, 1, 2, 3, 4, 5, 6, 8, 0x13, 0x14, 0x15), "")})
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# Workbooks ----------------------------------------------------------------------------------------------------------


class Strings:
    """Strings over a record and those that continue it; text that is cut begins anew with its width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.part, self.at = parts, 0, 0

    def _next(self) -> bool:
        while self.part < len(self.parts) and self.at >= len(self.parts[self.part]):
            self.part, self.at = self.part + 1, 0
        return self.part < len(self.parts)

    def take(self, n: int) -> bytes:
        out = b""
        while n and self._next():
            own = self.parts[self.part][self.at : self.at + n]
            self.at += len(own)
            out, n = out + own, n - len(own)
        return out

    def text(self, n: int, wide: bool) -> str:
        out = []
        while n and self.part < len(self.parts):
            left = len(self.parts[self.part]) - self.at
            if left <= 0:
                if not self._next():
                    break
                wide = bool(self.take(1)[0] & 1)
                continue
            count = min(n, left // 2 if wide else left)
            if not count:
                self.at += left
                continue
            raw = self.take(count * 2 if wide else count)
            out.append(raw.decode("utf-16-le" if wide else "latin-1", "replace"))
            n -= count
        return "".join(out)

    def string(self, count_bytes: int = 2) -> str:
        n = int.from_bytes(self.take(count_bytes), "little")
        flags = (self.take(1) or b"\0")[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        more = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        text = self.text(n, bool(flags & 1))
        self.take(4 * runs + more)
        return text


def number(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def packed_number(rk: int) -> str:
    value = float((rk & 0xFFFFFFFF) >> 2 if not rk & 0x80000000 else (rk >> 2) - (1 << 30)) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return number(value / 100 if rk & 1 else value)


def from_xls(content: bytes) -> str:
    """A table a sheet, then the texts of comments and boxes."""
    parts = streams(content, "excel")
    try:
        return _workbook(parts.get("Workbook") or parts.get("Book") or b"")
    except struct.error as e:
        raise IngestError(f"the XLS is broken: {e}") from e


def _workbook(data: bytes) -> str:
    records, at = [], 0
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        if kind == 0x3C and records:
            records[-1][1].append(data[at + 4 : at + 4 + n])
        else:
            records.append((kind, [data[at + 4 : at + 4 + n]]))
        at += 4 + n
    shared: list[str] = []
    sheets: list[dict[tuple[int, int], str]] = []
    beside: list[str] = []
    waiting: tuple[int, int] | None = None
    for kind, bodies in records:
        body = bodies[0]
        if kind == 0x2F:
            raise Unsupported("the XLS is encrypted")
        if kind == 0x809:
            sheets.append({})
        elif kind == 0xFC:
            own = Strings(bodies)
            _, n = struct.unpack("<II", own.take(8))
            shared = []
            for _ in range(n):
                if not own._next():
                    break
                shared.append(own.string())
        elif kind == 0x1B6 and len(bodies) > 1 and len(body) >= 12:
            n = struct.unpack_from("<H", body, 10)[0]
            own = Strings(bodies[1:])
            beside.append(own.text(n, bool(own.take(1)[0] & 1)))
        elif kind == 0x207 and waiting and sheets:
            sheets[-1][waiting], waiting = Strings(bodies).string(), None
        elif kind in (0xFD, 0x203, 0x27E, 0x204, 0xD6, 0x205, 0x06, 0xBD) and sheets and len(body) >= 6:
            row, col = struct.unpack_from("<HH", body)
            cells = sheets[-1]
            if kind == 0xFD:
                i = struct.unpack_from("<I", body, 6)[0]
                cells[row, col] = shared[i] if i < len(shared) else ""
            elif kind == 0x203:
                cells[row, col] = number(struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x27E:
                cells[row, col] = packed_number(struct.unpack_from("<I", body, 6)[0])
            elif kind in (0x204, 0xD6):
                own = Strings([body[6:], *bodies[1:]])
                cells[row, col] = own.string()
            elif kind == 0x205:
                cells[row, col] = ("TRUE" if body[6] else "FALSE") if not body[7] else ""
            elif kind == 0xBD:
                for i in range((len(body) - 6) // 6):
                    cells[row, col + i] = packed_number(struct.unpack_from("<I", body, 6 + 6 * i)[0])
            elif body[12:14] != b"\xff\xff":
                cells[row, col] = number(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waiting = (row, col)
            elif body[6] == 1:
                cells[row, col] = "TRUE" if body[8] else "FALSE"
    out = []
    for cells in sheets:
        rows: dict[int, list[str]] = {}
        for (row, col), text in sorted(cells.items()):
            own = rows.setdefault(row, [])
            own += [""] * (col - len(own)) + [text]
        out.append(markdown_table(list(rows.values())))
    return "\n\n".join(t for t in (*out, *beside) if t.strip())


# Presentations ------------------------------------------------------------------------------------------------------


def from_ppt(content: bytes) -> str:
    """The texts of slides, notes and masters, a block each."""
    data = streams(content, "ppt").get("PowerPoint Document", b"")
    out, todo = [], [(0, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            head, kind, n = struct.unpack_from("<HHI", data, at)
            stop = min(end, at + 8 + n)
            if kind == 0x2F14:
                raise Unsupported("the PPT is encrypted")
            if kind == 0x0FA0:
                out.append(data[at + 8 : stop].decode("utf-16-le", "replace"))
            elif kind == 0x0FA8:
                out.append(data[at + 8 : stop].decode("latin-1"))
            elif head & 15 == 15:
                todo += [(stop, end), (at + 8, stop)]
                break
            at = stop
    return "\n\n".join(t for t in (x.replace("\r", "\n").replace("\v", "\n").replace("\0", "").strip() for x in out) if t)
