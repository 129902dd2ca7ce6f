"""PDFs with a text layer: syntax, filters, fonts, places, reading order, round trips, what is refused."""

import base64
import random
import time
import zlib

import pyarrow as pa
import pytest
from pdfs import classic, one_page, stream

from penumbra.operators import engine
from penumbra.operators.engine import Readers, redact_files
from penumbra.plans import catalogue
from penumbra.plans.synthetic import text_pdf
from penumbra.sources import pdf


def texts(content):
    return [w["word"] for w in pdf.words(content)[0]]


def show(text, x=50, y=700, size=10):
    return b"BT /F %d Tf %d %d Td (%s) Tj ET\n" % (size, x, y, text)


def test_a_word_is_where_it_stands():
    (w,), n, blind = pdf.words(one_page(show(b"AAA", 100, 700, 20)))
    assert (n, blind, w["word"], w["page"]) == (1, [], "AAA", 1)
    assert (w["x"], w["y"], w["width"], w["height"]) == pytest.approx((100, 800 - 700 - 16, 3 * 0.667 * 20, 20))


@pytest.mark.parametrize("turn,box", [(90, (700 - 4, 100, 20, 40.02)), (180, (600 - 100 - 40.02, 700 - 4, 40.02, 20)), (270, (800 - 700 - 16, 600 - 100 - 40.02, 20, 40.02))])
def test_turned_pages(turn, box):
    (w,), _, _ = pdf.words(one_page(show(b"AAA", 100, 700, 20), page=b"/Rotate %d" % turn))
    assert (w["x"], w["y"], w["width"], w["height"]) == pytest.approx(box)


def test_crop_box_scale_and_matrices():
    content = b"q 2 0 0 2 10 20 cm BT /F 10 Tf 1 0 0 1 40 300 Tm (AAA) Tj ET Q"
    (w,), _, _ = pdf.words(one_page(content, page=b"/CropBox [10 20 510 720]"))
    assert (w["x"], w["y"], w["height"]) == pytest.approx((80, 700 - 600 - 16, 20))


@pytest.mark.parametrize("content,want", [
    (b"BT /F 10 Tf 50 700 Td [(Hel) -20 (lo) -400 (wor) 30 (ld)] TJ ET", ["Hello", "world"]),
    (b"BT /F 10 Tf 50 700 Td 12 TL (one) Tj T* (two) Tj (three) ' 1 2 (four) \" ET", ["one", "two", "three", "four"]),
    (b"BT /F 10 Tf 50 700 Td 12 Tc (ab c) Tj ET", ["ab", "c"]),
    (b"BT /F 10 Tf 50 700 Td (a\\(b\\)\\\\ \\101\\102 <c>) Tj ET", ["a(b)\\", "AB", "<c>"]),
    (b"BT /F 10 Tf 50 700 Td <48 69> Tj ET", ["Hi"]),
    (b"BT /F 10 Tf 50 700 Td (4111) Tj 60 0 Td (1111) Tj ET", ["4111", "1111"]),
    (b"BT /F 10 Tf 50 700 Td (caf\\351 \\200) Tj ET % (not this) Tj", ["café", "€"]),
    (b"BI /W 1 /H 1 /BPC 8 /CS /G ID \x00(x) Tj EI BT /F 10 Tf 50 700 Td (after) Tj ET", ["after"]),
])
def test_what_operators_show(content, want):
    assert texts(one_page(content)) == want


def test_fonts():
    differences = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /FirstChar 65 /Widths [500 500 500 500 500 500] /Encoding << /Differences [65 /eacute /fi 67 /uni20AC /a.alt /ccaron /alpha] >> >>"
    assert texts(one_page(show(b"ABCDEF"), differences)) == ["éfi€ačα"]
    cmap = stream(b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <41> <D83DDE00> endbfchar 2 beginbfrange <42> <43> <0078> <44> <45> [<0031> <00320033>] endbfrange")
    assert texts(one_page(show(b"ABCDE"), b"<< /Type /Font /Subtype /TrueType /BaseFont /X /ToUnicode 6 0 R >>", more=(cmap,))) == ["😀xy123"]
    wide = b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /UniJIS-UTF16-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType0 /DW 1000 >>] >>"
    assert texts(one_page(b"BT /F 10 Tf 50 700 Td <65E5672C> Tj ET", wide)) == ["日本"]
    blank = one_page(b"BT /F 10 Tf 50 700 Td <0001> Tj ET", b"<< /Type /Font /Subtype /Type0 /BaseFont /X /Encoding /Identity-H /DescendantFonts [<< /DW 500 >>] >>")
    assert texts(blank) == ["�"]


def predicted(data, columns=7):
    """PNG lines of every filter."""
    out, before = b"", bytes(columns)
    for i in range(0, len(data), columns):
        line, way = data[i : i + columns].ljust(columns, b" "), i // columns % 5
        made = bytearray()
        for k in range(columns):
            a, b, c = (line[k - 1] if k else 0), before[k], (before[k - 1] if k else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][way]
            made.append((line[k] - guess) & 255)
        out, before = out + bytes([way]) + bytes(made), line
    return out


def packed_lzw(data):
    """LZW codes of single bytes, with a clearing before the codes grow."""
    bits = ""
    for i, byte in enumerate(data):
        bits += (f"{256:09b}" if i % 200 == 0 else "") + f"{byte:09b}"
    bits += f"{257:09b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("name", ["flate", "predictor", "lzw", "85", "hex", "runs", "chain", "cut"])
def test_filters(name):
    plain = b"".join(show(b"word%d" % i, 50, 780 - 12 * i) for i in range(60))
    make = {
        "flate": (zlib.compress(plain), b"/Filter /FlateDecode"),
        "predictor": (zlib.compress(predicted(plain)), b"/Filter /FlateDecode /DecodeParms << /Predictor 15 /Columns 7 >>"),
        "lzw": (packed_lzw(plain), b"/Filter [/LZWDecode]"),
        "85": (base64.a85encode(plain) + b"~>", b"/Filter /ASCII85Decode"),
        "hex": (plain.hex().encode() + b">", b"/Filter /ASCIIHexDecode"),
        "runs": (b"".join(bytes([len(plain[i : i + 100]) - 1]) + plain[i : i + 100] for i in range(0, len(plain), 100)) + b"\x80", b"/Filter /RunLengthDecode"),
        "chain": (zlib.compress(plain).hex().encode(), b"/Filter [/ASCIIHexDecode /FlateDecode] /DecodeParms [null null]"),
        "cut": (zlib.compress(plain + b" ")[:-3], b"/Filter /FlateDecode"),
    }
    data, head = make[name]
    assert texts(one_page(data, head=head)) == [f"word{i}" for i in range(60)]


def test_forms_and_their_matrices():
    form = stream(b"BT /F 10 Tf 0 0 Td (inside) Tj ET /X Do", b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 200]")
    (w,), _, blind = pdf.words(one_page(b"/X Do", more=(form,)))
    assert w["word"] == "inside" and (w["x"], w["y"]) == pytest.approx((100, 592)) and not blind


def test_columns_are_read_one_after_the_other():
    left, right = [f"left line number {i}" for i in range(6)], [f"right line number {i}" for i in range(6)]
    content = show(b"A title over both of them", 150, 760, 16) + b"".join(show(t.encode(), x, 700 - 14 * i) for i in range(6) for x, t in ((50, left[i]), (320, right[i])))
    content += show(b"A closing line that goes over the whole width of the page and so parts nothing at all here", 50, 560)
    got = " ".join(texts(one_page(content)))
    assert got.index("title") < got.index("left line number 0") < got.index("left line number 5") < got.index("right line number 0") < got.index("right line number 5") < got.index("closing")


def test_rows_of_a_table_are_read_across():
    content = b"".join(show(t, x, 700 - 14 * i) for i in range(5) for x, t in ((50, b"Name%d" % i), (300, b"Value%d" % i)))
    assert texts(one_page(content)) == [t for i in range(5) for t in (f"Name{i}", f"Value{i}")]


@pytest.mark.parametrize("modern", [False, True])
def test_round_trip(modern):
    rng = random.Random(6)
    parts = ["word", "été", "日本語", "a@b.io", "😀", "4111", "(x)", "\\", "<y>", "FR76", "Ω", "x" * 120]
    text = "\n".join(" ".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(120))
    made = text_pdf(text, modern)
    words, n, blind = pdf.words(made)
    assert " ".join(w["word"] for w in words) == " ".join(text.split()) and n > 2 and not blind
    assert " ".join(pdf.markdown(made).split()) == " ".join(text.split())


def test_paragraphs_headings_and_wrapped_lines():
    content = show(b"Heading", 50, 760, 24) + b"".join(show(t, 50, y) for t, y in ((b"A long line that reaches to the right edge of its block and then goes", 700), (b"on here.", 688), (b"A new paragraph.", 650)))
    assert pdf.markdown(one_page(content)) == "# Heading\n\nA long line that reaches to the right edge of its block and then goes on here.\n\nA new paragraph."


def test_broken_tables_are_scanned():
    assert texts(one_page(show(b"found"), broken=True)) == ["found"]
    whole = one_page(show(b"found"))
    assert texts(whole[: whole.index(b"xref\n")]) == ["found"] and texts(b"\n\njunk" + whole) == ["found"]
    assert texts(text_pdf("in a stream of objects", True).replace(b"startxref", b"startxxxx")) == ["in", "a", "stream", "of", "objects"]


@pytest.mark.parametrize("content", [b"", b"no", b"%PDF-1.4", b"%PDF-1.4\ntrailer << /Root 1 0 R >>", classic([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>"], b"/Root 1 0 R /Encrypt 2 0 R"), b"%PDF-1.4 1 0 obj " + b"[" * 5000])
def test_what_is_refused(content):
    with pytest.raises(pdf.PdfError):
        list(pdf.pages_of(content))


def test_hostile_files_end():
    loop = classic([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [2 0 R 2 0 R 3 0 R] >>", b"<< /Type /Page /Contents 3 0 R /Parent 2 0 R /Resources 3 0 R >>"])
    assert pdf.words(loop)[:2] == ([], 1)
    for data in (b"(" * 100_000, b"[" * 100_000, b"<<" * 50_000, b"q " * 100_000 + b"1 " * 100_000, b"/X Do " * 3):
        pdf.words(one_page(data, more=(stream(b"/X Do /X Do", b"/Subtype /Form"),) if b"Do" not in data else (stream(b"/X Do", b"/Subtype /Form"),)))


def test_time_grows_with_the_text():
    def seconds(n):
        made = text_pdf("some words of a line " * n, False)
        t = time.process_time()
        pdf.words(made)
        return time.process_time() - t

    seconds(200)
    assert seconds(4000) < 3 * max(0.2, seconds(2000))


def picture_page(text=b""):
    return one_page(text + b"q 100 0 0 100 0 0 cm /X Do Q", more=(stream(b"\0\0\0", b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceRGB /BitsPerComponent 8"),))


def test_pdfs_among_files(spark):
    import numpy as np

    def ocr(picture):
        return [{"word": "scan", "x": 1, "y": 1, "width": 9, "height": 5}, {"word": "s@b.io", "x": 20, "y": 1, "width": 9, "height": 5}]

    def render(content, dpi):
        return [np.full((dpi, dpi, 3), 255, np.uint8)]

    rows = [("text", text_pdf("mail a@b.io now", True)), ("mixed", picture_page(show(b"b@b.io"))), ("scan", picture_page()), ("blank", one_page(b"")), ("none", b"%PDF-1.4"), ("null", None)]
    df = spark.createDataFrame([(n, bytearray(c) if c is not None else None, "x") for n, c in rows], "name string, content binary, error string").selectExpr("*", "CASE WHEN name <> 'null' THEN 'pdf' END AS kind", "CAST(NULL AS STRING) AS format")
    got = {r["name"]: r for r in redact_files(df, "markdown").collect()}
    assert set(got) == {n for n, _ in rows} and all(r["input_error"] == "x" for r in got.values())
    assert got["text"]["redacted_markdown"] == "mail ██████ now" and got["mixed"]["redacted_markdown"] == "██████"
    assert "text layer" in got["scan"]["error"] and got["scan"]["redacted_markdown"] is None and got["blank"]["error"] is None
    assert got["none"]["error"].startswith("PdfError") and "kind None" in got["null"]["error"]
    got = {r["name"]: r for r in redact_files(df, "native", readers=Readers(ocr=ocr, render=render)).collect()}
    assert [e["entity_type"] for e in got["scan"]["entities"]] == ["EMAIL_ADDRESS"] and bytes(got["scan"]["redacted_bytes"]).startswith(b"%PDF")
    box = got["text"]["entities"][0]["bbox"]
    where = next(w for w in pdf.words(rows[0][1])[0] if w["word"] == "a@b.io")
    assert (box["page"], box["x"], box["y"]) == (1, pytest.approx(where["x"]), pytest.approx(where["y"]))


SHOWN = [
    b"BT /F 10 Tf 50 700 Td (one two  three) Tj 4 Tc (spaced out) ' 0 Tc 9 Tw (with word spacing) Tj ET",
    b"BT /F 8 Tf 0.7 0.7 -0.7 0.7 100 100 Tm [(tur) -20 (ned) -600 (apart) 30 (on)] TJ 3 Ts 80 Tz (narrow high) Tj ET",
    b"2 0 0 2 5 5 cm BT /F 5 Tf 12 TL 20 200 Td (big) Tj T* (end ) Tj (next) Tj (joined) Tj -1 Tc (tight letters) Tj -3 0 0 3 90 90 Tm (mirrored) Tj ET",
]


@pytest.mark.parametrize("show", SHOWN)
def test_strings_run_by_run_are_strings_glyph_by_glyph(show, monkeypatch):
    file = one_page(show)
    runs, calls = pdf.words(file)[0], []
    monkeypatch.setattr(pdf.Page, "string", lambda *_: calls.append(1))
    single = pdf.words(file)[0]
    assert calls and [w["word"] for w in runs] == [w["word"] for w in single]
    assert all(abs(a[k] - b[k]) < 1e-9 for a, b in zip(runs, single, strict=True) for k in ("page", "x", "y", "width", "height"))


def test_plain_strings_are_not_placed_glyph_by_glyph(monkeypatch):
    glyphs = []
    monkeypatch.setattr(pdf.Page, "glyph", lambda *_: glyphs.append(1))
    text = "an address 1 rue de la Paix, née x@b.io " * 40
    for modern in (False, True):
        assert [w["word"] for w in pdf.words(text_pdf(text, modern))[0]] == text.split()
    assert not glyphs


ALONE = [
    b"".join(b"BT /F 10 Tf %d %d Td (word%d) Tj ET\n" % (50 + 60 * (i % 5), 700 - 14 * (i // 5), i) for i in range(40)),
    b"BT /F 10 Tf 50 700 Td (4111) Tj ET BT /F 10 Tf 72.5 700 Td (1111 and ) Tj ET BT /F 12 Tf 118 700 Td (more) Tj ET BT /F 10 Tf 50 650 Td () Tj ET BT /F 9. Tf .5 600 Td <48 69> Tj ET",
    b"3 Tc 2 Ts 80 Tz BT /F 10 Tf 50 700 Td (one) Tj ET BT /F 10 Tf +80 700 Td < 4869> Tj ET 0 Tc q 2 0 0 2 5 5 cm BT /F 5 Tf 20 300 Td (big) Tj ET BT /F 5 Tf 40 300 Td <414243> Tj ET Q BT /F 5 Tf 99 99 Td (end) Tj ET (more) Tj",
    b"-1 0 0 -1 600 800 cm BT /F 10 Tf 50 700 Td (turned over) Tj ET BT /F 10 Tf 50 650 Td (\351t\351 ) Tj ET BT /F 10 Tf 150 650 Td (  ) Tj ET BT /F 10 Tf 250 650 Td (\001) Tj ET BT /G 10 Tf 350 650 Td (other) Tj ET",
    b"9 Tw BT /F 10 Tf 50 700 Td (with spacing) Tj ET 0 Tw BT /F 0 Tf 50 600 Td (none) Tj ET BT /F 10 Tf 50 500 Td (open) Tj ET 0 1 -1 0 0 0 cm BT /F 10 Tf 50 -400 Td (upwards) Tj ET BT /F 10 Tf 90 -400 Td (so) Tj ET",
]


@pytest.mark.parametrize("show", ALONE)
def test_text_objects_at_once_are_text_objects_one_by_one(show, monkeypatch):
    file = one_page(show)
    found, text = pdf.words(file)[0], pdf.markdown(file)
    monkeypatch.setattr(pdf.Page, "strings", lambda *_: None)
    single = pdf.words(file)[0]
    assert single and [w["word"] for w in found] == [w["word"] for w in single] and text == pdf.markdown(file)
    assert all(abs(a[k] - b[k]) < 1e-9 for a, b in zip(found, single, strict=True) for k in ("page", "x", "y", "width", "height"))


def test_words_placed_by_themselves_are_read_at_once(monkeypatch):
    strings = []
    monkeypatch.setattr(pdf.Page, "string", lambda *_: strings.append(1))
    text = "an address 1 rue de la Paix, née x@b.io " * 400
    assert [w["word"] for w in pdf.words(text_pdf(text))[0]] == text.split()
    assert not strings


def test_files_of_few_splits_are_dealt_to_more_tasks_than_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 100 * cores, 1, cores + 1).selectExpr("id AS doc_id", "'a' AS text")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalogue.as_files(spark, str(tmp_path), "pdf", None)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {4 * cores}, true" in plan


def test_arrays_of_rows_as_columns():
    rows = [[(0, 1, 1, 1.0, 2.0, 3.0, 4.0), (2, 5, 1, 0.5, 0.5, 0.5, 0.5)], None, [], [(0, 3, 2, 9.0, 8.0, 7.0, 6.0)]]
    columns = [None if r is None else engine.Columns(*map(list, zip(*r, strict=True))) if r else engine.Columns(*([] for _ in range(7))) for r in rows]
    want = pa.array(rows, engine.WORDS)
    assert engine.array(columns, engine.WORDS) == want and engine.array([*columns[:3], rows[3]], engine.WORDS) == want and engine.array(rows, engine.WORDS) == want


@pytest.mark.parametrize("query", ["pdf_redacted", "office_redacted"])
def test_files_are_written_once(spark, query):
    plan = catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
