"""Filters, masking, external spans, layout, sources, images, SQL functions and streams."""

import http.server
import io
import json
import struct
import threading
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.functions import sqlfuncs
from penumbra.functions.spans import char_offset, snapped
from penumbra.operators import external, image, layout
from penumbra.operators.detect import counts, detect, in_order
from penumbra.operators.mask import audit_json, mask, mask_bytes, merged, output, redact
from penumbra.sources import ingest
from penumbra.streaming import stream

TEXT = "email: john@example.com, nir: 185017512345609"


def test_filters(spark):
    df = spark.createDataFrame([(1, TEXT)], "id int, text string")
    kinds = lambda **k: [r["entity_type"] for r in detect(df, ["id"], **k).orderBy("rec_order").collect()]
    assert kinds() == ["FR_NIR", "EMAIL_ADDRESS"]
    assert kinds(entities=["FR_NIR", "UNKNOWN"]) == ["FR_NIR"]
    assert kinds(entities=[]) == []
    assert kinds(score_threshold=0.95) == ["FR_NIR"]
    assert kinds(score_threshold=0.9) == ["FR_NIR", "EMAIL_ADDRESS"]
    assert "value" not in detect(df, ["id"]).columns
    assert {r["entity_type"]: r["n"] for r in counts(detect(df, ["id"])).collect()} == {"FR_NIR": 1, "EMAIL_ADDRESS": 1}
    assert "john" not in audit_json(detect(df, ["id"], include_text=True)).collect()[0]["value"]


@pytest.mark.parametrize(
    ("text", "spans", "want"),
    [("abcdefgh", [(0, 4), (2, 6)], "██████gh"), ("abcdefgh", [(0, 2), (2, 4)], "████efgh"), ("prefix SECRET suffix", [(7, 13)], "prefix ██████ suffix"), ("short text", [(102, 112)], "short text"), ("abc", [(2, 1), (1, 1)], "abc"), ("é😀x", [(1, 2)], "é█x"), ("abc", [(2, 99)], "ab█"), ("abcd", [], "abcd")],
)
def test_mask(spark, text, spans, want):
    df = spark.createDataFrame([(text, [{"cstart": a, "cend": b} for a, b in spans])], "text string, spans array<struct<cstart:int,cend:int>>")
    assert df.select(mask(F.col("text"), F.col("spans"))).first()[0] == want


def test_bytes_are_snapped_to_characters(spark):
    df = spark.createDataFrame([(n,) for n in range(-1, 12)], "n int").withColumn("t", F.lit("é█😀"))
    got = [(r[0], r[1]) for r in df.orderBy("n").select(snapped(F.col("t").cast("binary"), F.col("n")), char_offset(F.col("t"), F.col("n"))).collect()]
    assert got == [(0, 0), (0, 0), (0, 0), (2, 1), (2, 1), (2, 1), (5, 2), (5, 2), (5, 2), (5, 2), (9, 3), (9, 3), (9, 3)]
    one = spark.createDataFrame([("Numéro", [{"start": 0, "end": 4}])], "t string, s array<struct<start:int,end:int>>")
    assert one.select(mask_bytes(F.col("t"), F.col("s"))).first()[0] == "███éro"


def test_merged_spans(spark):
    df = spark.createDataFrame([(1, 0, 4), (1, 2, 6), (1, 6, 7), (1, 9, 9), (1, 10, 12), (2, 1, 2)], "id int, start int, end int")
    assert sorted(map(tuple, merged(df, ["id"]).select("id", "start", "end").collect())) == [(1, 0, 7), (1, 10, 12), (2, 1, 2)]


def test_external_spans_yield_and_are_converted(spark):
    docs = spark.createDataFrame([(1, "Numéro : Dupont, x@y.com")], "doc_id int, text string")
    found = detect(docs, ["doc_id"])
    fake = lambda texts, language: [[{"entity_type": "PERSON", "start": 9, "end": 15, "score": 0.8}, {"entity_type": "URL", "start": 19, "end": 24, "score": 0.9}, {"entity_type": "LOW", "start": 0, "end": 3, "score": 0.1}] for _ in texts]
    spans = external.in_bytes(external.analyzed(docs, fake), docs)
    rows = external.merge_external(found, spans, score_threshold=0.5).collect()
    assert sorted((r["entity_type"], r["start"], r["end"], r["source"]) for r in rows) == [("EMAIL_ADDRESS", 18, 25, "TierA"), ("PERSON", 10, 16, "TierB")]
    broken = lambda texts, language: (_ for _ in ()).throw(OSError("down"))
    with pytest.raises(Exception, match="down"):
        external.analyzed(docs, broken).collect()


WORDS = "id int, idx int, start int, end int, page int, x float, y float, width float, height float"


@pytest.mark.parametrize(
    ("words", "span", "want"),
    [
        ([(0, 5, 1, 20, 0, 10, 5)], (0, 5), (1, 20, 10)),
        ([(0, 1, 1, 0, 0, 10, 5), (2, 4, 1, 15, 0, 10, 5), (5, 7, 1, 30, 0, 10, 5)], (0, 7), (1, 0, 40)),
        ([(100, 105, 1, 0, 0, 10, 5)], (0, 5), None),
        ([(0, 3, 1, 0, 0, 10, 5), (3, 6, 2, 999, 0, 10, 5)], (0, 6), (1, 0, 10)),
        ([(0, 3, 2, 7, 0, 10, 5), (3, 6, 1, 999, 0, 10, 5)], (0, 6), (2, 7, 10)),
    ],
)
def test_union_boxes(spark, words, span, want):
    w = spark.createDataFrame([(1, i, a, b, p, float(x), float(y), float(wd), float(h)) for i, (a, b, p, x, y, wd, h) in enumerate(words)], WORDS)
    s = spark.createDataFrame([(1, "PERSON", *span)], "id int, entity_type string, start int, end int")
    out = layout.union_boxes(s, w, ["id"], ["entity_type"])
    box = out.first()["bbox"]
    assert (box and (box["page"], box["x"], box["width"])) == want
    assert layout.unplaceable(out, ["id"]).count() == (want is None)
    if want is None:
        with pytest.raises(Exception, match="PERSON"):
            layout.placed(out).collect()


def test_assembly_and_tiles(spark):
    words = spark.createDataFrame([(1, 0, ""), (1, 1, "née"), (1, 2, ""), (1, 3, "x")], "id int, i int, word string")
    texts, spans = layout.assemble(words, ["id"], ["i"])
    assert texts.first()["text"] == "née  x"
    assert [(r["start"], r["end"], r["cstart"]) for r in spans.orderBy("i").collect()] == [(0, 0, 0), (0, 4, 0), (5, 5, 4), (6, 7, 5)]
    tiles = spark.range(1).select(layout.tiles(F.lit(100), F.lit(60))).first()[0]
    assert (tiles[0]["width"], tiles[0]["height"], tiles[3]["x"], tiles[3]["y"]) == (57, 34, 43, 26)
    assert len(spark.range(1).select(layout.tiles(F.lit(100), F.lit(60), 1)).first()[0]) == 1


def test_box_merge(spark):
    box = lambda x, y: {"page": 1, "x": float(x), "y": float(y), "width": 10.0, "height": 10.0}
    kind = "array<struct<entity_type:string,bbox:struct<page:int,x:float,y:float,width:float,height:float>>>"
    e = lambda t, b: {"entity_type": t, "bbox": b}
    first = [e("A", box(100, 100))]
    for more, n in (([e("A", box(100, 4000))], 2), ([e("A", box(101, 101))], 1), ([e("B", box(100, 100))], 2), ([e("A", None)], 1), ([e("B", box(0, 0)), e("B", box(1, 1))], 2)):
        df = spark.createDataFrame([(first, more)], f"a {kind}, b {kind}")
        assert len(df.select(layout.merge_by_box(F.col("a"), F.col("b"))).first()[0]) == n


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,amount\nAlice,10\nBob,20\n")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9 x@y.com")
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>x@y.com</w:t></w:r></w:p></w:document>')
    (tmp_path / "c.docx").write_bytes(made.getvalue())
    (tmp_path / "d.bin").write_bytes(b"%PDF-1.4")
    files = ingest.read_files(spark, str(tmp_path))
    rows = {r["path"].rpartition("/")[2]: r for r in ingest.extracted(files, on_error="column").collect()}
    assert "Alice" in rows["a.csv"]["markdown"] and "Bob" in rows["a.csv"]["text"]
    assert rows["b.txt"]["text"] == "caf� x@y.com"
    assert rows["c.docx"]["text"] == "Hello x@y.com"
    assert rows["d.bin"]["kind"] == "pdf" and rows["d.bin"]["text"] is None and "Unsupported" in rows["d.bin"]["error"]
    with pytest.raises(Exception, match="no extractor"):
        ingest.extracted(files).collect()
    with pytest.raises(ingest.Unsupported):
        ingest.check_request("document", "native")
    assert ingest.from_rtf(rb"{\rtf1 a\par b\'e9}") == "a\nbé"


def test_images(spark):
    rng = np.random.default_rng(1)
    picture = rng.integers(0, 255, (10, 40, 3)).astype(np.uint8)
    assert (image.png_decode(image.png_encode(picture)) == picture).all()
    assert image.turned(picture, 90).shape[:2] == (40, 10)
    assert (image.turned(image.turned(picture, 90), 270) == picture).all()
    assert image.turned(picture, 45) is None and image.exif_orientation(b"garbage") is None
    slanted = image.slanted(np.zeros((50, 100, 3), np.uint8), 15)
    assert slanted.shape[0] > 50 and slanted.shape[1] > 100 and (slanted[0, 0] == 255).all()
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + b"\xff\xda"
    assert image.exif_orientation(jpeg) == 6
    assert image.upright(picture, 6).shape[:2] == (40, 10) and image.upright(picture, 1) is None
    white = np.full((64, 64, 3), 255, np.uint8)
    black = image.blacked(white, [{"page": 1, "x": 4.0, "y": 4.0, "width": 8.0, "height": 4.0}, {"page": 2, "x": 0.0, "y": 0.0, "width": 99.0, "height": 99.0}], 150)
    assert (black[8:16, 8:25] == 0).all() and (black[20:] == 255).all()
    df = spark.createDataFrame([(bytearray(image.png_encode(white)), [{"page": 1, "x": 4.0, "y": 4.0, "width": 8.0, "height": 4.0}])], "content binary, boxes array<struct<page:int,x:float,y:float,width:float,height:float>>")
    assert (image.png_decode(bytes(image.redact_images(df).first()["redacted"])) == black).all()
    assert image.image_pdf([white, picture]).startswith(b"%PDF")
    turned, found = image.first_found(picture, lambda im: [1] if im.shape[0] == 40 else [])
    assert found == [1] and turned.shape[0] == 40


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    assert spark.sql("SELECT pii_luhn('4111 1111 1111 1111'), pii_luhn('4111 1111 1111 1112'), pii_luhn(''), pii_ssn('536-90-4399'), pii_mod97('98')").first()[:] == (True, False, True, True, 1)
    assert [r[0] for r in spark.sql("SELECT e.value FROM VALUES ('a@b.io c@d.io') AS t(x), LATERAL pii_emails(t.x) e").collect()] == ["a@b.io", "c@d.io"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([(1, TEXT), (2, "nothing")], "id int, text string")
    df.write.parquet(src)
    out = stream.redacted_stream(stream.read(spark, src, df.schema))
    q = stream.write(out, str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "john" not in rows[1]["text"] and rows[2]["text"] == "nothing" and len(rows[1]["entities"]) == 2


def test_redact_plans_without_shuffle_or_python(spark):
    df = spark.createDataFrame([(1, TEXT)], "id int, text string")
    plan = redact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_spans_in_order(spark):
    df = spark.createDataFrame([(2, TEXT), (1, TEXT + " b@c.io")], "id int, text string")
    assert [(r["id"], r["entity_type"], r["start"]) for r in in_order(detect(df, ["id"]), ["id"]).collect()] == [(1, "FR_NIR", 30), (1, "EMAIL_ADDRESS", 7), (1, "EMAIL_ADDRESS", 46), (2, "FR_NIR", 30), (2, "EMAIL_ADDRESS", 7)]


def test_what_a_result_shows(spark):
    df = spark.createDataFrame([("t", None), (None, "m"), ("t", "m")], "text string, markdown string")
    assert [r[0] for r in df.select(output(df)).collect()] == ["t", "m", "t"] and [r[0] for r in df.select(output(df, "markdown")).collect()] == ["t", "m", "m"]
    with pytest.raises(ValueError):
        output(df, "html")


def test_boxes_within_a_row_are_those_of_tables(spark):
    words = [(0, 3, 2, 7.0, 1.0, 10.0, 5.0), (3, 6, 1, 99.0, 0.0, 10.0, 5.0), (8, 9, 2, 1.0, 9.0, 2.0, 2.0)]
    kind = "array<struct<entity_type:string,start:int,end:int,bbox:struct<page:int,x:float,y:float,width:float,height:float>>>"
    own = {"page": 5, "x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0}
    spans = [("A", 0, 9, None), ("B", 6, 8, None), ("C", 4, 5, None), ("D", 0, 9, own)]
    df = spark.createDataFrame([(spans, words)], f"s {kind}, w array<struct<start:int,end:int,page:int,x:float,y:float,width:float,height:float>>")
    got = {e["entity_type"]: e["bbox"] for e in df.select(layout.boxes_of(F.col("s"), F.col("w"))).first()[0]}
    table = layout.union_boxes(spark.createDataFrame([(1, *s) for s in spans], "id int, entity_type string, start int, end int, bbox struct<page:int,x:float,y:float,width:float,height:float>"), spark.createDataFrame([(1, i, *w) for i, w in enumerate(words)], WORDS), ["id"], ["entity_type"])
    assert got == {r["entity_type"]: r["bbox"] for r in table.collect()} and got["B"] is None and got["D"]["page"] == 5 and got["A"]["x"] == 1.0


def test_analyzer_over_http(monkeypatch):
    """One connection a call; what isn't an answer fails."""
    seen = []

    class Answer(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.client_address[1], asked["language"]))
            body = json.dumps([{"entity_type": "PERSON", "start": 0, "end": len(asked["text"]), "score": 0.8}]).encode()
            self.send_response(500 if asked["text"] == "bad" else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv(external.ENV, f"http://127.0.0.1:{server.server_port}/base/")
    analyze = external.http_analyzer()
    assert [e[0]["end"] for e in analyze(["é", "two"], "fr")] == [1, 3]
    assert {s[0] for s in seen} == {"/base/analyze"} and len({s[1] for s in seen}) == 1 and seen[0][2] == "fr"
    with pytest.raises(OSError):
        analyze(["bad"], "en")
    server.shutdown()
    with pytest.raises(OSError):
        external.http_analyzer("http://127.0.0.1:1", timeout=1)(["x"], "en")


def test_spans_in_one_pass_are_those_of_two_tables(spark):
    docs = spark.createDataFrame([(1, "Numéro : Dupont, x@y.com"), (2, None), (3, "none"), (4, "z@w.fr é")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "PERSON", 9, 15, 0.8), (1, "URL", 19, 24, 0.9), (1, "LOW", 0, 3, 0.1), (4, "X", 7, 99, 0.7), (4, "Y", -5, 0, 0.7), (3, "PERSON", 0, 4, 0.6)], "doc_id int, entity_type string, cstart int, cend int, score float")
    key = lambda r: (r["doc_id"], r["entity_type"], r["start"], r["end"], r["source"], round(r["score"], 3))
    one = external.with_external(docs, spans, score_threshold=0.5).select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    two = external.merge_external(detect(docs, ["doc_id"]), external.in_bytes(spans, docs), score_threshold=0.5)
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))
    assert external.with_external(docs, spans, entities=[]).select(F.sum(F.size("entities"))).first()[0] == 0


def test_sinks_keep_documents_as_they_are(spark, tmp_path):
    text = "one\r\ntwo\n\n three"
    df = spark.createDataFrame([(1, text, bytearray(b"x"), "a/b.c.png"), (2, None, None, "n")], "id int, redacted string, redacted_bytes binary, path string")
    ingest.write_redacted(df, str(tmp_path / "t"), id_cols=("id",))
    assert {r["id"]: r["text"] for r in spark.read.json(str(tmp_path / "t")).collect()} == {1: text, 2: None}
    ingest.write_bytes(df, str(tmp_path / "b"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).collect()] == [("a/b.c.redacted.out", bytearray(b"x"))]
    (tmp_path / "x.txt").write_text("a\nb")
    assert ingest.read_text(spark, str(tmp_path / "x.txt")).first()["text"] == "a\nb"


def test_counts_by_window(spark, tmp_path):
    df = spark.sql(f"SELECT 1 AS id, timestamp'2024-01-01 00:01:00' AS at, '{TEXT}' AS text UNION ALL SELECT 2, timestamp'2024-01-01 00:07:00', 'x@y.com'")
    df.write.parquet(str(tmp_path / "in"))
    found = stream.counts_by_window(stream.read(spark, str(tmp_path / "in"), df.schema), ["id"], "at")
    q = found.writeStream.format("memory").queryName("windows_").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["window"]["start"].minute, r["entity_type"], r["n"]) for r in spark.table("windows_").collect()) == [(0, "EMAIL_ADDRESS", 1), (0, "FR_NIR", 1), (5, "EMAIL_ADDRESS", 1)]


def test_one_bad_picture_fails_alone(spark):
    good = image.png_encode(np.full((9, 9, 3), 255, np.uint8))
    df = spark.createDataFrame([(1, bytearray(good), []), (2, bytearray(b"x"), [])], "id int, content binary, boxes array<struct<page:int,x:float,y:float,width:float,height:float>>")
    got = {r["id"]: r for r in image.redact_images(df).collect()}
    assert got[1]["error"] is None and got[2]["redacted"] is None and "RedactError" in got[2]["error"]


def test_structure_of_documents():
    """Headings by style and level, tables, and cells that a sheet leaves out."""

    def zipped(**parts):
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w") as z:
            for name, text in parts.items():
                z.writestr(name.replace("__", "/") + ".xml", text)
        return made.getvalue()

    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={style!r}/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    doc = zipped(word__document=f'<w:document xmlns:w="u"><w:body>{p("Top", "Heading1")}{p("text")}{p("", "Heading2")}<w:tbl><w:tr><w:tc>{p("a")}{p("b")}</w:tc><w:tc>{p("c|d")}</w:tc></w:tr><w:tr><w:tc>{p("e")}</w:tc></w:tr></w:tbl>{p("end")}</w:body></w:document>')
    assert ingest.from_office(doc, "docx") == "# Top\n\ntext\n\n## \n\n| a b | c\\|d |\n| --- | --- |\n| e |  |\n\n\nend"
    odt = zipped(content='<o:d xmlns:o="u" xmlns:text="t"><o:body><text:h text:outline-level="2">Sub</text:h><text:list><text:list-item><text:p>one</text:p></text:list-item></text:list></o:body></o:d>')
    assert ingest.from_office(odt, "odt") == "## Sub\n\none"
    sheet = zipped(xl__worksheets__sheet1='<worksheet xmlns="u"><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><v>3</v></c></row><row/></sheetData></worksheet>')
    assert ingest.from_office(sheet, "excel") == "| x |  | 3 |\n| --- | --- | --- |\n"
    assert ingest.markdown_table([]) == ""
    with pytest.raises(ingest.Unsupported):
        ingest.from_office(sheet, "doc")
