"""Identifiers made from integer keys by SQL text that means the same in any dialect used here."""

D = "CAST(c_custkey AS BIGINT)"


def pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS STRING), {n}, '0')"


#: (name, SQL of the text). Shares of rows are corrupted on purpose; some texts lead with a label or a word.
NIR_BASE = f"('1' || {pad(f'{D} % 100', 2)} || {pad(f'1 + {D} % 12', 2)} || '75' || {pad(f'({D} * 37) % 1000', 3)} || {pad(f'({D} * 91) % 1000', 3)})"
NIR_CORSICA = f"('2' || {pad(f'{D} % 100', 2)} || {pad(f'1 + {D} % 12', 2)} || '19' || {pad(f'({D} * 37) % 1000', 3)} || {pad(f'({D} * 91) % 1000', 3)})"


def nir_key(base: str) -> str:
    return pad(f"97 - CAST({base} AS BIGINT) % 97 + CASE WHEN {D} % 4 = 0 THEN 1 ELSE 0 END", 2)


SIREN9 = pad(f"({D} * 7919 + 104729) % 1000000000", 9)
NIC5 = pad(f"({D} * 131) % 100000", 5)
TEXT = {
    "nir": f"CASE WHEN {D} % 5 = 0 THEN 'id ' || substr({NIR_CORSICA}, 1, 5) || CASE WHEN {D} % 2 = 0 THEN '2A' ELSE '2A' END || substr({NIR_CORSICA}, 8, 6) || {nir_key(NIR_CORSICA)} ELSE 'sécu ' || substr({NIR_BASE}, 1, 1) || ' ' || substr({NIR_BASE}, 2, 2) || ' ' || substr({NIR_BASE}, 4, 10) || ' ' || {nir_key(NIR_BASE)} || ' fin' END",
    "ssn": f"'no. ' || {pad(f'({D} * 7) % 1000', 3)} || '-' || {pad(f'{D} % 100', 2)} || CASE WHEN {D} % 3 = 0 THEN ' ' ELSE '-' END || {pad(f'({D} * 13) % 10000', 4)} || ' é'",
    "iban": f"'to DE' || {pad(f'98 - CAST({pad(f"{D} * 104729", 18)} || {chr(39)}131400{chr(39)} AS DECIMAL(38,0)) % 97 + CASE WHEN {D} % 4 = 0 THEN 1 ELSE 0 END', 2)} || {pad(f'{D} * 104729', 18)} || CASE WHEN {D} % 7 = 0 THEN ' by' WHEN {D} % 7 = 1 THEN ' EUR' ELSE '.' END",
    "vat_fr": f"'tva FR' || {pad(f'(12 + 3 * (CAST({SIREN9} AS BIGINT) % 97)) % 97 + CASE WHEN {D} % 4 = 0 THEN 1 ELSE 0 END', 2)} || {SIREN9}",
    "vat_be": f"'é BE' || {pad(f'{D} * 6007', 8)} || {pad(f'97 - ({D} * 6007) % 97 + CASE WHEN {D} % 4 = 0 THEN 1 ELSE 0 END', 2)}",
    "vat_nl": f"'x NL' || {pad(f'{D} * 60013', 9)} || 'B' || {pad(f'{D} % 100', 2)}",
    "vat_lu": f"'x lu ' || {pad(f'{D} * 601', 6)} || {pad(f'({D} * 601) % 89 + CASE WHEN {D} % 4 = 0 THEN 1 ELSE 0 END', 2)}",
    "vat_form": f"'à ' || CASE {D} % 9 WHEN 0 THEN 'DE' WHEN 1 THEN 'ATU' WHEN 2 THEN 'IT' WHEN 3 THEN 'IE' WHEN 4 THEN 'ro ' WHEN 5 THEN 'somme de ' WHEN 6 THEN 'US' WHEN 7 THEN 'ES' ELSE 'PL' END || {pad(f'{D} * 7', 7)} || CASE {D} % 4 WHEN 0 THEN '12' WHEN 1 THEN '1' WHEN 2 THEN 'FA' ELSE '1234' END",
    "siret": f"CASE {D} % 3 WHEN 0 THEN 'SIRET ' || {SIREN9} || {NIC5} WHEN 1 THEN 'réf ' || substr({SIREN9}, 1, 3) || ' ' || substr({SIREN9}, 4, 3) || ' ' || substr({SIREN9}, 7, 3) || ' ' || {NIC5} ELSE 'siret ' || '356000000' || {NIC5} END",
    "siren": f"CASE {D} % 3 WHEN 0 THEN 'RCS' ELSE 'parcs' END || repeat('.', CAST(43 + {D} % 5 AS INT)) || ' ' || {SIREN9}",
}


def rows(name: str) -> str:
    """SQL for (doc_id, text) of one kind."""
    return f"SELECT {D} AS doc_id, {TEXT[name]} AS text FROM customer"


def behind(name: str, source: str, id_col: str, text_col: str) -> str:
    """SQL for the rows of a table with an identifier of one kind behind each text."""
    return f"SELECT {id_col}, {text_col} || ' ' || {TEXT[name].replace('c_custkey', id_col)} AS {text_col} FROM {source}"


#: Runs of more groups than any bank account number has, with one behind them: swallowed by the run, or apart from it.
LONG_RUN = "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'AA00 ' || repeat('AAAA ', CAST(190 + n_nationkey AS INT)) || CASE WHEN n_nationkey % 3 = 0 THEN 'é ' WHEN n_nationkey % 3 = 1 THEN 'to ' ELSE '' END || 'GB82 WEST 1234 5698 7654 32' AS text FROM nation"


def glyph_width(char: str) -> int:
    """Thousandths of an em of a character in text_pdf()."""
    return 300 if char == " " else 420 + ord(char) % 7 * 30


def text_pdf(text: str, modern: bool = False, size: int = 10) -> bytes:
    """A PDF whose text layer says `text`, wrapped into pages, in a font that numbers characters as they come and maps them
    to Unicode. `modern`: objects in streams, tables as streams with predictors; else plain, each word placed by itself."""
    import zlib

    most = 500_000 // size
    number = {c: i for i, c in enumerate(dict.fromkeys(" " + text), 1)}
    coded, wide = {ord(c): f"{i:04X}" for c, i in number.items()}, {c: glyph_width(c) for c in number}
    sizes = {word: sum([wide[c] for c in word]) + 300 for word in set(text.split())}
    shown = {word: word.translate(coded) for word in sizes}
    lines: list[list[str]] = []
    for paragraph in text.split("\n"):
        lines.append([])
        used = 0
        for word in paragraph.split():
            n = sizes[word]
            if used and used + n > most:
                lines.append([])
                used = 0
            lines[-1].append(word)
            used += n
    pages = []
    for at in range(0, max(1, len(lines)), 55):
        out = []
        for k, line in enumerate(lines[at : at + 55]):
            y, x = 780 - 13.5 * k, 50.0
            if modern and line:
                out.append(f"BT /F {size} Tf {x} {y} Td <{coded[32].join([shown[word] for word in line])}> Tj ET")
            for word in () if modern else line:
                out.append(f"BT /F {size} Tf {x:.2f} {y} Td <{shown[word]}> Tj ET")
                x += sizes[word] * size / 1000
        pages.append(zlib.compress("\n".join(out).encode()))
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "\n".join(f"1 beginbfchar <{i:04X}> <{c.encode('utf-16-be', 'surrogatepass').hex()}> endbfchar" for c, i in number.items())
    widths = "[1 [" + " ".join(str(glyph_width(c)) for c in number) + "]]"
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /BaseFont /S /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", 4: f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /S /DW 500 /W {widths} >>".encode()}
    stream = lambda data, head="": f"<< /Length {len(data)} {head}>>\nstream\n".encode() + data + b"\nendstream"
    streams = {5: stream(zlib.compress(cmap.encode()), "/Filter /FlateDecode ")}
    for i, data in enumerate(pages):
        objects[6 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {7 + 2 * i} 0 R >>".encode()
        streams[7 + 2 * i] = stream(data, "/Filter /FlateDecode ")
    kids = " ".join(f"{6 + 2 * i} 0 R" for i in range(len(pages)))
    objects[2] = f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [0 0 600 800] /Resources << /Font << /F 3 0 R >> >> >>".encode()
    out, last = b"%PDF-1.5\n", 6 + 2 * len(pages)
    table: dict[int, tuple[int, int, int]] = {0: (0, 0, 0)}
    if modern:
        heads, body = [], b""
        for k, (n, o) in enumerate(sorted(objects.items())):
            heads.append(f"{n} {len(body)}")
            body += o + b" "
            table[n] = (2, last, k)
        first = " ".join(heads).encode() + b" "
        streams[last] = stream(zlib.compress(first + body), f"/Type /ObjStm /N {len(heads)} /First {len(first)} /Filter /FlateDecode ")
        objects = {}
    for n, o in sorted((objects | streams).items()):
        table[n] = (1, len(out), 0)
        out += f"{n} 0 obj\n".encode() + o + b"\nendobj\n"
    if not modern:
        entries = b"".join(b"%010d 00000 n \n" % table[n][1] for n in range(1, last))
        return out + b"xref\n0 %d\n0000000000 65535 f \n" % last + entries + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (last, len(out))
    table[last + 1] = (1, len(out), 0)
    rows = [a.to_bytes(1, "big") + b.to_bytes(4, "big") + c.to_bytes(2, "big") for _, (a, b, c) in sorted(table.items())]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before, strict=True)) for r, before in zip(rows, [bytes(7), *rows], strict=False))
    head = f"/Type /XRef /Size {last + 2} /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> "
    return out + f"{last + 1} 0 obj\n".encode() + stream(zlib.compress(up), head) + f"\nendobj\nstartxref\n{len(out)}\n%%EOF\n".encode()
