"""Files of any kind in one table: kinds, strategies, turning, tiles, places, drawing and errors."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from penumbra.operators import image, layout
from penumbra.operators.engine import Readers, joined, redact_files, redact_texts
from penumbra.operators.image import png_decode, png_encode
from penumbra.sources import ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NIR = "185017512345609"
SIZE = (120, 260)


def picture(mark=(255, 0, 0)):
    """White, with a mark in its upper left corner, by which the reader below knows which way is up."""
    p = np.full((*SIZE, 3), 255, np.uint8)
    p[:3, :3] = mark
    return p


def ocr(p):
    """Finds words only on an upright picture: a number if its mark is red, none of interest if it's green; small print
    only in tiles."""
    if tuple(p[0, 0][:3]) == (255, 0, 0):
        return [{"word": w, "x": 5 + 40 * i, "y": 10, "width": 38, "height": 8} for i, w in enumerate(["no", NIR, "end"])]
    if tuple(p[0, 0][:3]) == (0, 255, 0):
        return [{"word": "plain", "x": 5, "y": 10, "width": 38, "height": 8}]
    return []


def files(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").withColumn("kind", ingest.kind_of(F.col("path"), F.col("content"))).withColumn("format", ingest.format_of(F.col("path")))


def results(df, **options):
    return {r["path"]: r for r in redact_files(df, **options).collect()}


def black(content, box, dpi=150):
    s = dpi / 72
    x0, y0, x1, y1 = (int(v * s) for v in (box["x"], box["y"], box["x"] + box["width"], box["y"] + box["height"]))
    p = png_decode(content)
    return (p[y0:y1, x0:x1] == 0).all()


PDF = b"%PDF-1.4 two pages"
PAGES = lambda content: ([{"word": "page", "page": 1, "x": 1, "y": 1, "width": 9, "height": 5}, {"word": "a@b.io", "page": 2, "x": 20, "y": 30, "width": 40, "height": 10}], 2)
RENDER = lambda content, dpi: [np.full((dpi, dpi, 3), 200, np.uint8) for _ in range(2)]


def test_every_kind_in_one_table(spark):
    df = files(spark, [("a.txt", b"mail a@b.io caf\xe9"), ("b.csv", b"name,mail\nAl,al@b.io\n"), ("c.png", png_encode(picture())), ("d.pdf", PDF), ("e.doc", b"old"), ("f.png", b"no image")])
    readers = Readers(ocr=ocr, pages=PAGES, render=RENDER)
    got = results(df, output="native", readers=readers)
    assert got["a.txt"]["redacted_text"] == "mail ██████ caf�" and got["a.txt"]["redacted_bytes"] is None and got["a.txt"]["error"] is None
    assert "markdown only" in got["b.csv"]["error"] and got["b.csv"]["entities"] is None
    assert [e["entity_type"] for e in got["c.png"]["entities"]] == ["FR_NIR"] and black(got["c.png"]["redacted_bytes"], got["c.png"]["entities"][0]["bbox"])
    assert got["c.png"]["page_count"] == 1 and got["d.pdf"]["page_count"] == 2 and got["c.png"]["redacted_text"] is None
    assert got["d.pdf"]["redacted_bytes"].startswith(b"%PDF") and got["d.pdf"]["redacted_bytes"].count(b"/Type /Page ") == 2 and b"a@b.io" not in got["d.pdf"]["redacted_bytes"]
    assert got["d.pdf"]["entities"][0]["bbox"]["page"] == 2
    assert "RedactError" in got["f.png"]["error"] and all(r["output"] == "native" for r in got.values())
    got = results(df, output="markdown", readers=readers)
    assert "al@b.io" not in got["b.csv"]["redacted_markdown"] and "name" in got["b.csv"]["redacted_markdown"]
    assert got["c.png"]["redacted_markdown"] == f"no {'█' * 15} end" and got["d.pdf"]["redacted_markdown"] == "page ██████"
    assert "no extractor for doc" in got["e.doc"]["error"]
    with pytest.raises(Exception, match="markdown only"):
        redact_files(df, on_error="raise", readers=readers).collect()
    assert redact_files(df.filter("false"), readers=readers).count() == 0


def test_texts_need_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([("text", "mail a@b.io", None)], "kind string, text string, content binary")
    plan = redact_texts(df, "native", None, None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    row = redact_texts(df, "markdown", None, 0.8).first()
    assert row["redacted_markdown"] == row["redacted_text"] == "mail ██████" and row["entities"][0]["bbox"] is None


@pytest.mark.parametrize("degrees", [0, 90, 180, 270])
def test_pages_are_turned_until_something_is_found(spark, degrees):
    p = picture() if not degrees else image.turned(picture(), degrees)
    got = results(files(spark, [("a.png", png_encode(np.ascontiguousarray(p))), ("b.png", png_encode(picture((0, 255, 0))))]), readers=Readers(ocr=ocr))
    assert png_decode(got["a.png"]["redacted_bytes"]).shape[:2] == SIZE and len(got["a.png"]["entities"]) == 1
    assert got["b.png"]["entities"] == [] and (png_decode(got["b.png"]["redacted_bytes"]) == picture((0, 255, 0))).all()
    if degrees:
        off = results(files(spark, [("a.png", png_encode(np.ascontiguousarray(p)))]), readers=Readers(ocr=ocr), grid=0)
        assert off["a.png"]["entities"] == []


def test_small_print_is_found_in_tiles(spark):
    """The whole page shows one number; a tile shows the same and another, which comes with its place on the page."""

    def reader(p):
        if p.shape[:2] == SIZE:
            return [{"word": NIR, "x": 2.0, "y": 2.0, "width": 30.0, "height": 8.0}]
        if tuple(p[0, 0][:3]) == (255, 0, 0):
            return [{"word": NIR, "x": 2.2, "y": 2.1, "width": 30.0, "height": 8.0}]
        if tuple(p[-1, -1][:3]) == (0, 0, 255):
            return [{"word": "a@b.io", "x": 3.0, "y": 4.0, "width": 20.0, "height": 6.0}]
        raise ValueError("a tile that can't be read")

    p = picture()
    p[-1, -1] = (0, 0, 255)
    df = files(spark, [("a.png", png_encode(p))])
    got = results(df, readers=Readers(ocr=reader))["a.png"]
    assert [e["entity_type"] for e in got["entities"]] == ["FR_NIR", "EMAIL_ADDRESS"]
    x, y, *_ = image.cuts(SIZE[1], SIZE[0], 2, layout.TILE_OVERLAP)[3]
    box = got["entities"][1]["bbox"]
    assert box["x"] == pytest.approx(3.0 + x * 72 / 150) and box["y"] == pytest.approx(4.0 + y * 72 / 150) and black(got["redacted_bytes"], box)
    assert len(results(df, readers=Readers(ocr=reader), grid=1)["a.png"]["entities"]) == 1
    assert len(results(df, readers=Readers(ocr=reader), output="markdown")["a.png"]["entities"]) == 1


def test_external_spans_need_a_place_where_pixels_are_hidden(spark):
    df = files(spark, [("a.png", png_encode(picture())), ("b.txt", b"no one, a@b.io")])
    fake = lambda texts, language: [[{"entity_type": "PERSON", "start": 0, "end": 2, "score": 0.9}, {"entity_type": "URL", "start": 8, "end": 14, "score": 0.9}] for _ in texts]
    got = results(df, readers=Readers(ocr=ocr), analyzer=fake)
    assert [(e["entity_type"], e["source"]) for e in got["a.png"]["entities"]] == [("FR_NIR", "TierA"), ("PERSON", "TierB")]
    assert got["a.png"]["entities"][1]["bbox"]["x"] == 5.0
    assert got["b.txt"]["redacted_text"] == "██ one, ██████" and [e["entity_type"] for e in got["b.txt"]["entities"]] == ["EMAIL_ADDRESS", "PERSON"]
    beyond = lambda texts, language: [[{"entity_type": "PLACE", "start": 2, "end": 3, "score": 0.9}] for _ in texts]
    assert "no place on the page for entities of type PLACE" in results(df, readers=Readers(ocr=ocr), analyzer=beyond)["a.png"]["error"]


def test_strategies(spark):
    df = files(spark, [("a.pdf", PDF), ("b.png", png_encode(picture())), ("c.csv", b"x\n"), ("d.txt", b"t")])
    readers = Readers(ocr=ocr, pages=PAGES, render=RENDER, pdf_text=lambda c: "# layer c@d.io")
    got = results(df, output="markdown", readers=readers)
    assert got["a.pdf"]["redacted_markdown"] == "# layer ██████" and got["a.pdf"]["page_count"] is None
    assert "page" in results(df, output="markdown", readers=Readers(ocr=ocr, pages=PAGES, pdf_text=lambda c: "  "))["a.pdf"]["redacted_markdown"]
    assert "page" in results(df, output="markdown", readers=Readers(ocr=ocr, pages=PAGES, pdf_text=lambda c: 1 / 0))["a.pdf"]["redacted_markdown"]
    got = results(df, output="markdown", readers=readers, strategy="documents")
    assert got["a.pdf"]["redacted_markdown"] == "# layer ██████" and "reads no images" in got["b.png"]["error"] and got["c.csv"]["error"] is None
    assert "gives no places" in results(df, readers=readers, strategy="documents")["a.pdf"]["error"]
    got = results(df, output="markdown", readers=readers, strategy="layout")
    assert got["a.pdf"]["redacted_markdown"] == "page ██████" and "reads no documents" in got["c.csv"]["error"] and got["d.txt"]["redacted_text"] == "t"


def test_words_are_joined_like_a_table_of_them(spark):
    words = ["", "née", "", "x y", "😀"]
    text, spans = joined([{"word": w, "x": 0, "y": 0, "width": 1, "height": 1} for w in words])
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "id int, i int, word string")
    texts, table = layout.assemble(df, ["id"], ["i"])
    assert texts.first()["text"] == text and [(r["start"], r["end"]) for r in table.orderBy("i").collect()] == [s[:2] for s in spans]


def test_slants_and_tiles_by_hand():
    p = np.arange(20, dtype=np.uint8).reshape(4, 5, 1)
    turned = image.slanted(p, 0.0)
    assert (turned == p).all()
    big = np.random.default_rng(0).integers(0, 255, (30, 50, 3)).astype(np.uint8)
    for degrees in (10, -15, 20):
        got = image.slanted(big, degrees)
        a = np.radians(np.float32(degrees))
        h, w = got.shape[:2]
        for y, x in ((0, 0), (h // 2, w // 2), (h - 1, w // 3), (h // 4, w - 2)):
            rx, ry = np.float32(x) - w / 2, np.float32(y) - h / 2
            sx, sy = rx * np.cos(a) + ry * np.sin(a) + 25, -rx * np.sin(a) + ry * np.cos(a) + 15
            want = big[int(sy), int(sx)] if 0 <= sx < 50 and 0 <= sy < 30 else np.array([255] * 3)
            assert (got[y, x] == want).all()
    assert image.cuts(101, 61, 2, 0.15) == [(0, 0, 57, 34), (43, 0, 58, 34), (0, 26, 57, 35), (43, 26, 58, 35)]
    assert image.cuts(1, 1, 2, 0.15) == [] and image.cuts(7, 5, 0, 0.15) == [(0, 0, 7, 5)]


def test_png_filters():
    """Lines stored in every way a PNG may store them."""
    import struct
    import zlib

    rng = np.random.default_rng(2)
    p = rng.integers(0, 255, (12, 9, 3)).astype(np.uint8)
    lines, above = b"", np.zeros(27, int)
    for y, line in enumerate(p.reshape(12, 27).astype(int)):
        kind = y % 5
        left, corner = np.r_[[0] * 3, line[:-3]], np.r_[[0] * 3, above[:-3]]
        est = left + above - corner
        near = np.stack([abs(est - left), abs(est - above), abs(est - corner)])
        paeth = np.choose(near.argmin(0), [left, above, corner])
        lines += bytes([kind]) + bytes(((line - [0, left, above, (left + above) // 2, paeth][kind]) % 256).tolist())
        above = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    made = image.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 12, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (png_decode(made) == p).all()
