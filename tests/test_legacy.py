"""DOC, XLS and PPT files that are written here, byte by byte."""

import struct

import pytest

from penumbra.sources import ingest, legacy
from penumbra.sources.errors import EngineError, Unsupported


def compound(parts: dict[str, bytes], cutoff: int = 4096) -> bytes:
    """A compound file of 512-byte sectors; parts under the cutoff lie in the small stream."""
    sectors: list[bytes] = []
    table: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return 0xFFFFFFFE
        first = len(sectors)
        for i in range(0, len(data), 512):
            sectors.append(data[i : i + 512].ljust(512, b"\0"))
            table.append(len(sectors))
        table[-1] = 0xFFFFFFFE
        return first

    small, small_table, entries = b"", [], []
    for name, data in parts.items():
        if len(data) < cutoff:
            start = len(small_table) if data else 0xFFFFFFFE
            for i in range(0, len(data), 64):
                small += data[i : i + 64].ljust(64, b"\0")
                small_table.append(len(small_table) + 1)
            if data:
                small_table[-1] = 0xFFFFFFFE
        else:
            start = put(data)
        entries.append((name, 2, start, len(data)))
    entries.insert(0, ("Root Entry", 5, put(small), len(small)))
    raw = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(n) + 2, k) + b"\0" * 49 + struct.pack("<IQ", s, size) for n, k, s, size in entries)
    dirs = put(raw.ljust(-(-len(raw) // 512) * 512, b"\0"))
    smalls = put(struct.pack(f"<{len(small_table)}I", *small_table).ljust(512, b"\xff") if small_table else b"")
    n = 1
    while len(table) + n > 128 * n:
        n += 1
    places = [len(sectors) + i for i in range(n)]
    table += [0xFFFFFFFD] * n
    fat = struct.pack(f"<{len(table)}I", *table).ljust(512 * n, b"\xff")
    head = legacy.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIII", 0, n, dirs, 0, cutoff, smalls, 1, 0xFFFFFFFE, 0)
    return head + struct.pack("<109I", *(places + [0xFFFFFFFF] * (109 - n))) + b"".join(sectors) + fat


def doc(*pieces: tuple[str, bool], flags: int = 0x200) -> bytes:
    """Pieces of text, each narrow or wide, in an order of their own in the file."""
    main, made = bytearray(2048), []
    for text, narrow in reversed(pieces):
        made.insert(0, (len(main), narrow, len(text)))
        main += text.encode("cp1252" if narrow else "utf-16-le") + b"\0" * (len(text) % 2)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 10, flags)
    ends = [0]
    for _, _, n in made:
        ends.append(ends[-1] + n)
    plc = struct.pack(f"<{len(ends)}I", *ends) + b"".join(b"\0\0" + struct.pack("<I", (at * 2 | 0x40000000) if narrow else at) + b"\0\0" for at, narrow, _ in made)
    clx = b"\x01\x03\0abc\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x1A2, 16, len(clx))
    return compound({"WordDocument": bytes(main), "1Table": b"\0" * 16 + clx})


def test_word_pieces_fields_and_cells():
    made = doc(("Name\x07john@x.com\x07\x07\r", True), ("日本 é\x0bnext\r", False), ("see \x13HYPERLINK \"x\"\x14link \x13 PAGE \x147\x15\x15 now\x1e\r", True), ("note " * 2000, True))
    assert ingest.EXTRACTORS["doc"](made) == "Name\tjohn@x.com\t\t\n日本 é\nnext\nsee link 7 now-\n" + ("note " * 2000).strip()


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def test_workbook_records():
    strings = [("4111111111111111", False), ("é日本", True), ("long " * 900, False), ("wide日" * 900, True)]
    whole, cuts = struct.pack("<II", 4, 4), []
    for text, wide in strings:
        whole += struct.pack("<HB", len(text), int(wide))
        for ch in text:
            if len(whole) + 2 > 2000:  # text goes on in another record, which says its width again
                cuts.append(whole)
                whole = bytes([int(wide)])
            whole += ch.encode("utf-16-le" if wide else "latin-1")
    cuts.append(whole)
    sst = record(0xFC, cuts[0]) + b"".join(record(0x3C, c) for c in cuts[1:])
    cell = lambda kind, row, col, body: record(kind, struct.pack("<HHH", row, col, 0) + body)
    book = record(0x809, b"\0" * 16) + sst + record(0x0A, b"") + record(0x809, b"\0" * 16)
    book += b"".join(cell(0xFD, 0, i, struct.pack("<I", i)) for i in range(4))
    book += cell(0x203, 1, 1, struct.pack("<d", 1.5)) + cell(0x27E, 1, 2, struct.pack("<I", 4200 << 2 | 3)) + cell(0x27E, 1, 3, struct.pack("<i", -5 << 2 | 2))
    book += record(0xBD, struct.pack("<HH", 2, 0) + struct.pack("<HIHI", 0, 7 << 2 | 2, 0, 8 << 2 | 2) + struct.pack("<H", 1))
    book += cell(0x06, 3, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x207, struct.pack("<HB", 6, 0) + b"a@b.io") + cell(0x205, 3, 1, b"\1\0")
    book += record(0x1B6, b"\0" * 10 + struct.pack("<H", 4) + b"\0" * 6) + record(0x3C, b"\0note") + record(0x3C, b"\0" * 16)
    for cutoff in (4096, 1):
        text = ingest.EXTRACTORS["excel"](compound({"Workbook": book}, cutoff))
        lines = text.split("\n")
        assert lines[0] == f"| 4111111111111111 | é日本 | {'long ' * 900} | {'wide日' * 900} |"
        assert lines[2:5] == ["|  | 1.5 | 42 | -5 |", "| 7 | 8 |  |  |", "| a@b.io | TRUE |  |  |"] and text.endswith("note")


def test_slide_texts():
    atom = lambda kind, data, head=0: struct.pack("<HHI", head, kind, len(data)) + data
    inner = atom(0x0FA0, "Título\rb@c.io".encode("utf-16-le")) + atom(0x03F0, atom(0x0FA8, b"caf\xe9\x0bmore"), 15)
    assert ingest.EXTRACTORS["ppt"](compound({"PowerPoint Document": atom(0x03E8, inner, 15) + atom(0x0FA8, b"last"), "Other": b"x" * 5000})) == "Título\nb@c.io\n\ncafé\nmore\n\nlast"


def test_what_is_refused_or_broken():
    with pytest.raises(Unsupported, match="encrypted"):
        legacy.from_doc(doc(("x", True), flags=0x300))
    with pytest.raises(Unsupported, match="encrypted"):
        legacy.from_xls(compound({"Workbook": record(0x2F, b"\0" * 6)}))
    good = doc(("text", True))
    for broken in (b"", legacy.MAGIC, good[:600], good.replace(b"\xec\xa5", b"\0\0"), legacy.MAGIC + b"\xff" * 600):
        with pytest.raises(EngineError):
            legacy.from_doc(broken)
    looped = bytearray(compound({"WordDocument": b"x" * 6000}))
    struct.pack_into("<I", looped, len(looped) - 512, 0)  # the first sector follows itself
    legacy.streams(bytes(looped), "doc")
