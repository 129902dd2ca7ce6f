"""python -m penumbra [FILE]: masks a text, document, image or PDF."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys

from pyspark.sql import SparkSession

from . import api
from .operators.engine import Readers
from .operators.external import http_analyzer
from .sources.ingest import FORMATS, IMAGES


def kind_and_format(name: str, content: bytes, told: str | None = None) -> tuple[str, str | None]:
    """By what --as tells, else a PDF by its first bytes, else by the name's ending (case matters), else text."""
    if told in ("text", "pdf", "image"):
        return told, None
    if told:
        return "document", FORMATS.get(told, told)
    end = os.path.basename(name).rpartition(".")[2] if "." in os.path.basename(name) else ""
    if content.startswith(b"%PDF") or end == "pdf":
        return "pdf", None
    if end in IMAGES:
        return "image", None
    return ("document", FORMATS[end]) if end in FORMATS else ("text", None)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="penumbra")
    p.add_argument("file", nargs="?", help="path; standard input without one")
    p.add_argument("--as", dest="kind", choices=["text", "pdf", "image", *dict.fromkeys([*FORMATS, *FORMATS.values()])], help="kind of input, if its name doesn't tell")
    p.add_argument("--format", default="native", choices=["native", "markdown"])
    p.add_argument("--output", help="file for the result; for images and PDFs FILE with the ending .redacted.out, if not given")
    p.add_argument("--report", nargs="?", const="-", help="file for the entities found, as JSON, without matched text; standard error without a name")
    p.add_argument("--entities", help="types to look for, joined by commas")
    p.add_argument("--score-threshold", type=float)
    p.add_argument("--dpi", type=int, default=150, help="resolution at which PDF pages are drawn")
    p.add_argument("--tier-b", action="store_true", help="also ask an external recognizer")
    p.add_argument("--language", default="en")
    p.add_argument("--readers", help="module:name of the Readers (OCR, PDF reader and renderer) to use")
    a = p.parse_args(argv)
    if a.file in (None, "-"):
        content = sys.stdin.buffer.read()
    else:
        with open(a.file, "rb") as source:
            content = source.read()
    kind, format_ = kind_and_format(a.file or "", content, a.kind)
    target = a.output
    if a.format == "native" and kind in ("image", "pdf") and target is None:
        if a.file in (None, "-"):
            p.error("--output is needed for an image or PDF from standard input")
        target = os.path.splitext(a.file)[0] + ".redacted.out"
    readers = Readers()
    if a.readers:
        module, _, name = a.readers.partition(":")
        readers = getattr(importlib.import_module(module), name)
    options = {"entities": a.entities.split(",") if a.entities is not None else None, "score_threshold": a.score_threshold, "analyzer": http_analyzer() if a.tier_b else None, "language": a.language, "dpi": a.dpi}
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    made = api.redact_file(spark, content, kind, format_, a.format, readers, **options)
    if made["bytes"] is not None:
        with open(target, "wb") as out:
            out.write(made["bytes"])
    else:
        order = ("markdown", "text") if a.format == "markdown" else ("text", "markdown")
        text = next(made[k] for k in order if made[k] is not None)
        if target:
            with open(target, "w", encoding="utf-8") as out:
                out.write(text)
        else:
            print(text)
    if a.report:
        report = json.dumps(made["entities"], indent=2)
        if a.report == "-":
            print(report, file=sys.stderr)
        else:
            with open(a.report, "w", encoding="utf-8") as out:
                out.write(report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
