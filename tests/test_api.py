"""Plain functions and the command line."""

import io
import json
import sys

import numpy as np
import pytest

from pyspark import cloudpickle

from penumbra import __main__, api
from penumbra.operators import image
from penumbra.operators.engine import Readers
from penumbra.sources.ingest import EngineError, Unsupported

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = "mon NIR est 185017512345609, merci."


def test_text(spark):
    text, found = api.redact_text(spark, TEXT)
    assert text == "mon NIR est ███████████████, merci." and [e["entity_type"] for e in found] == ["FR_NIR"]
    fake = lambda texts, language: [[{"entity_type": "PERSON", "start": 0, "end": 3, "score": 0.9}, {"entity_type": "DATE", "start": 12, "end": 14, "score": 0.9}] for _ in texts]
    text, found = api.redact_text(spark, "é" + TEXT[1:], analyzer=fake)
    assert text.startswith("███ NIR") and [e["source"] for e in found] == ["TierA", "TierB"]
    assert api.redact_text(spark, "") == ("", [])


def test_image(spark):
    white = np.full((100, 400, 3), 255, np.uint8)
    words = [{"word": w, "x": 10 + 40 * i, "y": 10, "width": 30, "height": 10} for i, w in enumerate(["call", "212-555-0143", "now"])]
    out = image.png_decode(api.redact_image(spark, image.png_encode(white), words, dpi=72))
    assert (out[10:20, 50:80] == 0).all() and (out[10:20, 10:40] == 255).all() and (out[:, 90:] == 255).all()


READERS = Readers(
    ocr=lambda p: [{"word": w, "x": 10 + 40 * i, "y": 10, "width": 30, "height": 10} for i, w in enumerate(["call", "212-555-0143", "now"])],
    pages=lambda c: ([{"word": "a@b.io", "page": 2, "x": 1, "y": 1, "width": 9, "height": 5}], 2),
    render=lambda c, dpi: [np.full((dpi, dpi, 3), 200, np.uint8)] * 2,
)


def test_files_one_by_one(spark):
    white = image.png_encode(np.full((100, 400, 3), 255, np.uint8))
    made = api.redact_file(spark, white, "image", readers=READERS)
    assert made["page_count"] == 1 and made["entities"][0]["entity_type"] == "PHONE_NUMBER" and (image.png_decode(made["bytes"])[25:40, 110:160] == 0).all()
    assert api.redact_image_text(spark, white, READERS) == "call ████████████ now"
    assert api.redact_pdf_text(spark, b"%PDF", READERS) == "██████"
    low, high = (api.redact_pdf(spark, b"%PDF", READERS, dpi=d) for d in (72, 150))
    assert low.startswith(b"%PDF") and b"/Width 72 " in low and b"/Width 150 " in high and b"/MediaBox [0 0 72.00 72.00]" in high
    with pytest.raises(Unsupported, match="OCR"):
        api.redact_file(spark, white, "image")
    with pytest.raises(EngineError, match="RedactError"):
        api.redact_file(spark, b"x", "image", readers=READERS)


def test_document_and_command(spark, tmp_path, capsys, monkeypatch):
    text, found = api.redact_document(spark, b"name,mail\nAl,al@b.io\n", "csv")
    assert "al@b.io" not in text and "name" in text and len(found) == 1
    with pytest.raises(Unsupported):
        api.redact_document(spark, b"", "csv", "native")
    with pytest.raises(Unsupported):
        api.redact_document(spark, b"", "doc")
    (tmp_path / "a.txt").write_text(TEXT)
    assert __main__.main([str(tmp_path / "a.txt"), "--output", str(tmp_path / "o"), "--report", str(tmp_path / "r"), "--entities", "FR_NIR"]) == 0
    assert "185017512345609" not in (tmp_path / "o").read_text() + (tmp_path / "r").read_text() and len(json.loads((tmp_path / "r").read_text())) == 1
    # documents have no native output, which is the default
    (tmp_path / "b.csv").write_text("x,al@b.io\n")
    with pytest.raises(Unsupported):
        __main__.main([str(tmp_path / "b.csv")])
    assert __main__.main([str(tmp_path / "b.csv"), "--format", "markdown", "--report"]) == 0
    shown = capsys.readouterr()
    assert "| x | ███████ |" in shown.out and json.loads(shown.err[shown.err.index("[\n") :])[0]["entity_type"] == "EMAIL_ADDRESS"
    monkeypatch.setattr("sys.stdin", type("Stdin", (), {"buffer": io.BytesIO(TEXT.encode())}))
    assert __main__.main(["--as", "text"]) == 0 and "██" in capsys.readouterr().out
    (tmp_path / "c.png").write_bytes(image.png_encode(np.full((100, 400, 3), 255, np.uint8)))
    assert __main__.main([str(tmp_path / "c.png"), "--readers", "test_api:READERS", "--dpi", "72"]) == 0
    assert (image.png_decode((tmp_path / "c.redacted.out").read_bytes()) == 0).any()
    with pytest.raises(SystemExit):
        __main__.main(["--as", "image"])


def test_kinds_of_files():
    told = lambda name, content=b"x", kind=None: __main__.kind_and_format(name, content, kind)
    assert told("a.pdf") == told("b", b"%PDF-1") == ("pdf", None) and told("a.PNG") == ("text", None) and told("d.v2/x") == ("text", None)
    assert told("a.xlsx") == ("document", "excel") and told("a.png") == ("image", None) and told("a.txt", b"x", "xls") == ("document", "excel") and told("a.csv", b"", "text") == ("text", None)
