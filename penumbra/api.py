"""One document at a time: the same engine behind plain functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.checks import let
from .operators import external, image, layout
from .operators.detect import detect, entities_of
from .operators.engine import Readers, redact_files
from .operators.mask import mask_places
from .sources.ingest import EXTRACTORS, EngineError, Unsupported, check_request


def _spans(spark: SparkSession, df: DataFrame, entities, score_threshold, analyzer, language) -> DataFrame:
    found = detect(df, ["doc_id"], "text", entities, score_threshold)
    if analyzer is None:
        return found
    spans = external.in_bytes(external.analyzed(df, analyzer, language=language), df)
    return external.merge_external(found, spans, entities=entities, score_threshold=score_threshold)


def redact_texts(df: DataFrame, entities: list[str] | None = None, score_threshold: float | None = None, analyzer: external.Analyzer | None = None, language: str = "en") -> DataFrame:
    """(doc_id, text) to (doc_id, redacted, entities) with an external recognizer's spans, if one is given, merged in."""
    docs = df.select("doc_id", "text")
    if analyzer is None:
        found = docs.withColumn("entities", entities_of("text", entities, score_threshold))
    else:
        found = external.with_external(docs, external.analyzed(docs, analyzer, language=language), entities=entities, score_threshold=score_threshold)
    # bound, so that the scans are planned once
    made = let(F.col("entities"), lambda e: F.struct(mask_places(F.col("text"), e).alias("redacted"), F.transform(e, lambda x: F.struct(*(x[c].alias(c) for c in ("entity_type", "start", "end", "score", "source")))).alias("entities")))
    return found.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def redact_text(spark: SparkSession, text: str, entities: list[str] | None = None, score_threshold: float | None = None, analyzer: external.Analyzer | None = None, language: str = "en") -> tuple[str, list[dict]]:
    """(masked text, entities found)."""
    row = redact_texts(spark.createDataFrame([(0, text)], "doc_id long, text string"), entities, score_threshold, analyzer, language).first()
    return row["redacted"], [e.asDict() for e in row["entities"]]


def redact_image(spark: SparkSession, content: bytes, words: list[dict], entities: list[str] | None = None, score_threshold: float | None = None, analyzer: external.Analyzer | None = None, language: str = "en", dpi: int = layout.IMAGE_DPI, decode=image.png_decode, encode=image.png_encode) -> bytes:
    """The image with found entities black. `words` come from an OCR of the upright image: word, page, x, y, width,
    height in reading order. An entity without a place fails the call."""
    texts, spans = layout.assemble(spark.createDataFrame([(0, i, w["word"], w.get("page", 1), float(w["x"]), float(w["y"]), float(w["width"]), float(w["height"])) for i, w in enumerate(words)], "doc_id long, idx int, word string, page int, x float, y float, width float, height float"), ["doc_id"], ["idx"])
    found = _spans(spark, texts, entities, score_threshold, analyzer, language)
    boxed = layout.placed(layout.union_boxes(found, spans, ["doc_id"], ["entity_type"]))
    boxes = [r["bbox"].asDict() for r in boxed.select("bbox").collect()]
    picture: np.ndarray = decode(content)
    upright = image.upright(picture, image.exif_orientation(content))
    return encode(image.blacked(picture if upright is None else upright, boxes, dpi))


def redact_file(spark: SparkSession, content: bytes, kind: str, format: str | None = None, output: str = "native", readers: Readers | None = None, **options) -> dict:
    """The result of one file: text, markdown, bytes, page_count, entities. What can't be done raises Unsupported."""
    check_request(kind, output)
    df = spark.createDataFrame([(bytearray(content), kind, format)], "content binary, kind string, format string")
    row = redact_files(df, output, readers=readers, **options).first()
    if row["error"]:
        raise (Unsupported if row["error"].startswith("Unsupported") else EngineError)(row["error"])
    return {"text": row["redacted_text"], "markdown": row["redacted_markdown"], "bytes": None if row["redacted_bytes"] is None else bytes(row["redacted_bytes"]), "page_count": row["page_count"], "entities": [e.asDict(True) for e in row["entities"]]}


def redact_pdf(spark: SparkSession, content: bytes, readers: Readers, dpi: int = layout.IMAGE_DPI, **options) -> bytes:
    """A PDF of page images with found entities black; `readers` must read pages and render them."""
    return redact_file(spark, content, "pdf", readers=readers, dpi=dpi, **options)["bytes"]


def redact_pdf_text(spark: SparkSession, content: bytes, readers: Readers, **options) -> str:
    """A PDF's text, masked: its text layer's, or where it has none what the pages are read as."""
    return redact_file(spark, content, "pdf", output="markdown", readers=readers, **options)["markdown"]


def redact_image_text(spark: SparkSession, content: bytes, readers: Readers, **options) -> str:
    """What an OCR reads in an image, masked."""
    return redact_file(spark, content, "image", output="markdown", readers=readers, **options)["markdown"]


def redact_document(spark: SparkSession, content: bytes, format: str, output: str = "markdown", extractors: dict | None = None, **options) -> tuple[str, list[dict]]:
    """(masked Markdown, entities) of an office document."""
    check_request("document", output)
    use = EXTRACTORS | (extractors or {})
    if format not in use:
        raise Unsupported(f"no extractor for {format}")
    return redact_text(spark, use[format](content), **options)
