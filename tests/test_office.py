"""Office documents as people write them: what stands apart on the page stands apart in the text."""

import io
import random
import re
import zipfile

import pytest

from penumbra.operators import detect, mask
from penumbra.operators.engine import redact_files
from penumbra.plans import filetexts
from penumbra.sources import ingest, office

W = 'xmlns:w="u"'


def zipped(**parts):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for at, text in parts.items():
            z.writestr(at.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels") if "/" not in at else at, text)
    return made.getvalue()


def of(format, parts):
    return office.from_office(zipped(**parts), format)


def docx(body, **more):
    return of("docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **more})


def test_word_tabs_breaks_and_symbols():
    run = "<w:r><w:t>john@x.com</w:t><w:tab/><w:t>4111111111111111</w:t><w:br/><w:t>next</w:t><w:noBreakHyphen/><w:t>one</w:t><w:cr/><w:sym w:char='00E9'/></w:r>"
    assert docx(f"<w:p>{run}</w:p>") == "john@x.com\t4111111111111111\nnext-one\né"
    assert docx("<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>in</w:t></w:r></w:ins><w:r><w:instrText>PAGE</w:instrText></w:r><w:hyperlink><w:r><w:t>side</w:t></w:r></w:hyperlink></w:p>") == "inside"


def test_word_parts_beside_the_body():
    part = lambda t: f"<w:x {W}><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:x>"
    box = "<w:r><mc:AlternateContent xmlns:mc='m'><mc:Choice><w:txbxContent><w:p><w:r><w:t>box</w:t></w:r></w:p></w:txbxContent></mc:Choice><mc:Fallback><w:t>twice</w:t></mc:Fallback></mc:AlternateContent></w:r>"
    text = docx(f"<w:p><w:r><w:t>body</w:t></w:r>{box}</w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>held</w:t></w:r></w:p></w:sdtContent></w:sdt>", **{f"word/{n}.xml": part(n) for n in ("footnotes", "endnotes", "comments", "header1", "footer2")})
    assert sorted(text.split("\n\n")) == sorted(["body", "box", "held", "footnotes", "endnotes", "comments", "header1", "footer2"]) and text.startswith("body\n\nbox\n\nheld")
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    assert docx(f"<w:tbl><w:tr>{cell('a')}<w:sdt><w:sdtContent>{cell('b|c')}</w:sdtContent></w:sdt></w:tr></w:tbl>") == "| a | b\\|c |\n| --- | --- |\n"


def test_slides_in_order_with_notes():
    slide = lambda t: f'<p:sld xmlns:p="u" xmlns:a="v"><a:p><a:r><a:t>{t}</a:t></a:r><a:br/><a:r><a:t>more</a:t></a:r></a:p></p:sld>'
    rel = lambda *r: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="x/{k}" Target="{t}"/>' for i, k, t in r) + "</Relationships>"
    text = of("pptx", {
        "ppt/presentation.xml": '<p:p xmlns:p="u" xmlns:r="r"><p:sldId id="1" r:id="b"/><p:sldId id="2" r:id="a"/></p:p>', "ppt/_rels/presentation.xml.rels": rel(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide("one"), "ppt/slides/slide2.xml": slide("two"), "ppt/slides/slide10.xml": slide("ten"),
        "ppt/slides/_rels/slide2.xml.rels": rel(("n", "notesSlide", "../notesSlides/notesSlide1.xml")), "ppt/notesSlides/notesSlide1.xml": slide("note")})
    assert text == "two\nmore\n\nnote\nmore\n\none\nmore\n\nten\nmore"


def test_open_documents():
    body = lambda x: {"content.xml": f'<o:d xmlns:o="u" xmlns:table="b" xmlns:text="t">{x}</o:d>'}
    assert of("odt", body('<text:p>a<text:tab/>b<text:line-break/>c<text:s text:c="3"/>d<text:s/>e  \n f</text:p>')) == "a\tb\nc   d e f"
    assert of("odt", body("<text:p>before<text:note><text:note-citation>1</text:note-citation><text:note-body><text:p>the note</text:p></text:note-body></text:note> after</text:p>")) == "before after\n\nthe note"
    assert of("odt", body("<text:tracked-changes><text:p>gone</text:p></text:tracked-changes><text:list><text:list-item><text:p>item</text:p></text:list-item></text:list>")) == "item"
    styles = '<o:d xmlns:o="u" xmlns:style="s" xmlns:text="t"><style:header><text:p>top</text:p></style:header></o:d>'
    assert of("odt", body("<text:p>in</text:p>") | {"styles.xml": styles}) == "in\n\ntop"
    cell = lambda t, n="": f"<table:table-cell{n}><text:p>{t}</text:p></table:table-cell>"
    rows = f"<table:table><table:table-row>{cell('x', ' table:number-columns-repeated=\"2\"')}{cell('')}{cell('y')}<table:table-cell table:number-columns-repeated='16380'/></table:table-row><table:table-row table:number-rows-repeated='1048576'><table:table-cell/></table:table-row></table:table>"
    assert of("ods", body(rows)) == "| x | x |  | y |\n| --- | --- | --- | --- |\n"


def test_books():
    package = '<package><manifest><item id="1" href="t/z.xhtml"/><item id="2" href="t/a.xhtml"/></manifest><spine><itemref idref="1"/><itemref idref="2"/></spine></package>'
    first = "<html><head><title>T</title><style>p{}</style></head><body><h2>Top</h2><div>in a div</div><p>para<br/>two&nbsp;x &amp; y<p>open<ul><li>one<li>two</ul></body></html>"
    text = of("epub", {"o/p.opf": package, "o/t/a.xhtml": "<table><tr><td>a</td><td>b@c.io</td></tr></table><pre>x\n  y</pre>tail", "o/t/z.xhtml": first})
    assert text == "T\n\n## Top\n\nin a div\n\npara\ntwo\xa0x & y\n\nopen\n\n- one\n\n- two\n\na | b@c.io\n\nx\n  y\n\ntail"


def test_sheets():
    sheet = '<worksheet xmlns="u"><sheetData><row><c r="B1" t="s"><v>0</v></c><c t="inlineStr"><is><r><t>4111</t></r><r><t>111111111111</t></r></is></c><c t="b"><v>1</v></c><c t="str"><f>X()</f><v>f</v></c></row></sheetData></worksheet>'
    parts = {"xl/sharedStrings.xml": '<sst xmlns="u"><si><r><t>A</t></r><rPh sb="0"><t>phon</t></rPh><r><t>B</t></r></si></sst>', "xl/worksheets/sheet1.xml": sheet, "xl/comments1.xml": '<comments xmlns="u"><comment><text><r><t>said</t></r></text></comment></comments>'}
    assert of("excel", parts) == "|  | AB | 4111111111111111 | TRUE | f |\n| --- | --- | --- | --- | --- |\n\n\nsaid"


@pytest.mark.parametrize(("raw", "want"), [
    (rb"{\rtf1 john@x.com\cell 4111111111111111\cell\row next}", "john@x.com\t4111111111111111\t\nnext"),
    (rb"{\rtf1{\fonttbl{\f0\fnil Foo;}}{\*\generator W;}a{\field{\*\fldinst{HYPERLINK x}}{\fldrslt{link}}}\tab b\line c}", "alink\tb\nc"),
    (rb"{\rtf1\uc1 \u8364?\u-10179?\u-8704? caf\'e9 \{x\}\~y\emdash z}", "€😀 café {x}\xa0y—z"),
    (rb"{\rtf1\ansicpg932 \'93\'fa\'96\'7b}", "日本"),
    (b"{\\rtf1 a\\par\r\nb\\'\xff{\\header top}c{\\pict\\bin3 }}}{\\info{\\title t}}}", "a\nb\ntopc"),
    (rb"{\rtf1 one\par two", "one\ntwo"), (b"", ""),
])
def test_rich_text(raw, want):
    got = office.from_rtf(raw)
    assert got == want if b"\\'\xff" not in raw else "topc" in got


def test_csv_of_any_coding():
    want = "| a | é |\n| --- | --- |\n| x y | z |\n"
    text = 'a,é\r\n"x\ny",z\r\n'
    assert all(office.from_csv(raw) == want for raw in (text.encode(), text.encode("utf-8-sig"), text.encode("utf-16"), text.encode("utf-16-le"), text.encode("utf-16-be"), text.replace(",", ";").encode(), text.replace(",", "\t").encode()))


def test_identifiers_behind_tabs_and_cells_are_masked(spark):
    text = docx("<w:p><w:r><w:t>john@x.com</w:t><w:tab/><w:t>4111111111111111</w:t><w:br/><w:t>next</w:t></w:r></w:p>")
    rows = spark.createDataFrame([(1, text), (2, office.from_rtf(rb"{\rtf1 john@x.com\cell 4111111111111111\cell\row}"))], "id long, text string")
    got = {r["id"]: r for r in mask.redact(rows, "text").collect()}
    assert got[1]["redacted"] == "█" * 10 + "\t" + "█" * 16 + "\nnext" and len(got[2]["entities"]) == 2
    assert detect.detect(rows, ["id"], "text").count() == 4


@pytest.mark.parametrize("format", filetexts.FORMATS)
def test_files_of_every_format_say_what_was_written(format):
    text = filetexts.one_line(" a <b> & {c} \\d | \u00e9\u65e5\U0001f600 \x01\n\nend ")
    made = filetexts.office_file(format, text, 7)
    got = ingest.EXTRACTORS[format](made)
    assert all(a in got.split() or a in got.replace("|", " ").split() for a in ("a7@b.io", "b7@b.io", "c7@b.io")) and text.split()[0] in got and "\U0001f600" in got


def test_rows_of_no_kind_and_clashing_names_come_back(spark):
    rows = [(1, "text", b"mail a@b.io"), (2, None, b"x"), (3, "document", b"n\nb@c.io\n"), (4, "other", b"x"), (5, "image", None)]
    df = spark.createDataFrame([(i, k, bytearray(c) if c else None, "csv", "mine", 7) for i, k, c in rows], "id long, kind string, content binary, format string, error string, Output long")
    for output in ("markdown", "native"):
        got = {r["id"]: r for r in redact_files(df, output).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5] and all(r["input_error"] == "mine" and r["input_Output"] == 7 for r in got.values())
        assert got[1]["redacted_text"] == "mail ██████" and all(got[i]["error"] for i in (2, 4, 5))
    got = {r["id"]: r for r in ingest.extracted(df.drop("error"), on_error="column").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and "no extractor" in got[2]["error"] and got[3]["text"].startswith("| n |")


def test_no_job_runs_before_the_result_is_asked_for(spark):
    """Streams pass too: a table of files that arrive gives their results."""
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = spark.createDataFrame([(1, "text", bytearray(b"a@b.io"), None)], "id long, kind string, content binary, format string")
    redact_files(df, "markdown")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_white_space_is_what_a_pattern_over_every_space_gives():
    rng = random.Random(3)
    texts = ["".join(rng.choice("a\t\n\r\f\v \x00\x7f\xa0　￾\\{}é\U0001f600\x1c\x85b  ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        for others in ("\t\r\n", "\t\r\f", "\t\r\n\f"):
            assert office.spaced(text, others) == re.sub(f"[ {others}]+", " ", text)
        assert filetexts.one_line(text) == re.sub(filetexts.ODD.pattern.replace("\x1f", "\x20").replace("\\x1f", "\\x20") + "+", " ", text).strip(" ")


def test_texts_of_single_spaces_pass_without_a_pattern(monkeypatch):
    text = "an address in one line " * 2000
    files = {f: filetexts.office_file(f, text.strip(), 7) for f in ("odt", "epub")}
    calls = []
    plain = re.sub
    monkeypatch.setattr(office.re, "sub", lambda pattern, *a, **k: calls.append(pattern) or plain(pattern, *a, **k))
    for f, content in files.items():
        assert office.from_office(content, f).startswith(text.strip())
    assert not any(p.startswith("[ ") for p in calls)
