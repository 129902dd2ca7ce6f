"""Spans from an external entity recognizer, merged with those found here; what was found here wins."""

from __future__ import annotations

import http.client
import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import let
from ..functions.spans import before, byte_offset, byte_places, first_where
from .detect import entities_of
from .recognizers import NONE

Analyzer = Callable[[list[str], str], list[list[dict]]]
#: Where an analyzer listens unless the setting names another place; seconds until a call counts as failed.
ENV, LOCAL_URL, TIMEOUT = "PRESIDIO_ANALYZER_URL", "http://localhost:5002", 5.0


def http_analyzer(url: str | None = None, timeout: float = TIMEOUT) -> Analyzer:
    """Posts each text to {url}/analyze over one connection a call; any failure fails the task, never passes text on."""
    base = urlsplit((url or os.environ.get(ENV) or LOCAL_URL).rstrip("/"))

    def analyze(texts: list[str], language: str) -> list[list[dict]]:
        kind = http.client.HTTPSConnection if base.scheme == "https" else http.client.HTTPConnection
        line, out = kind(base.netloc, timeout=timeout), []
        try:
            for text in texts:
                line.request("POST", f"{base.path}/analyze", json.dumps({"text": text, "language": language}).encode(), {"Content-Type": "application/json"})
                answer = line.getresponse()
                body = answer.read()
                if answer.status != 200:
                    raise OSError(f"the analyzer answered {answer.status}")
                out.append(json.loads(body))
        finally:
            line.close()
        return out

    return analyze


def analyzed(df: DataFrame, analyzer: Analyzer, id_col: str = "doc_id", text_col: str = "text", language: str = "en") -> DataFrame:
    """(id, entity_type, cstart, cend, score) as the analyzer gives them, in characters."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, e["entity_type"], e["start"], e["end"], e["score"]) for i, es in zip(f["id"], analyzer(f["text"].tolist(), language), strict=True) for e in es]
            yield pd.DataFrame(rows, columns=["id", "entity_type", "cstart", "cend", "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {kind}, entity_type string, cstart int, cend int, score float").withColumnRenamed("id", id_col)


def in_bytes(spans: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans given in characters with start and end in bytes, held within the text."""
    t = texts.select(id_col, F.col(text_col).alias("text_"))
    size = F.length("text_")
    held = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), size)
    joined = spans.join(t, id_col).withColumn("cstart", held("cstart")).withColumn("cend", held("cend"))
    return joined.withColumn("start", byte_offset(F.col("text_"), F.col("cstart"))).withColumn("end", byte_offset(F.col("text_"), F.col("cend"))).drop("text_")


def admitted(external: DataFrame, entities: list[str] | None = None, score_threshold: float | None = None) -> DataFrame:
    """External spans of the types asked for that score enough; the threshold is a float like the scores."""
    more = external
    if entities is not None:
        more = more.filter(F.col("entity_type").isin(*entities) if entities else F.lit(False))
    if score_threshold is not None:
        more = more.filter(F.col("score").cast("float") >= F.lit(score_threshold).cast("float"))
    return more


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(more: Column, found: Column) -> Column:
    """Of the spans `more` those that overlap none of `found`; both are arrays of structs with start and end.

    `found` is sorted by start once. A span overlaps one of those that begin before its end if the greatest of their ends is
    beyond its start, so a search for the first that doesn't and a running maximum tell.
    """
    ends = F.array_sort(F.transform(found, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))))

    def of(ordered: Column) -> Column:
        return before(
            F.transform(ordered, lambda y: y["end"]), F.lit(-1), lambda a, x: F.greatest(a, x),
            lambda upto: F.filter(more, lambda x: upto(first_where(ordered, lambda y: y["start"] >= x["end"])) <= x["start"]),
        )

    return F.when(F.size(found) == 0, more).otherwise(let(ends, of))


def merge_external(found: DataFrame, external: DataFrame, id_col: str = "doc_id", entities: list[str] | None = None, score_threshold: float | None = None) -> DataFrame:
    """`found` followed by the external spans that are admitted and overlap none of them.

    Both are grouped by id and meet once, so `found` is worked out once; columns that only one side has are null in the
    other's rows.
    """
    more = admitted(external, entities, score_threshold).withColumn("source", F.lit("TierB")).withColumn("rec_order", F.lit(100))
    both = found.limit(0).unionByName(more.limit(0), allowMissingColumns=True).schema
    names = [f for f in both if f.name != id_col]
    row = lambda df: F.struct(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names))
    a = found.groupBy(F.col(id_col).alias("a_id")).agg(F.collect_list(row(found)).alias("a"))
    b = more.groupBy(F.col(id_col).alias("b_id")).agg(F.collect_list(row(more)).alias("b"))
    none = F.array().cast(a.schema["a"].dataType)
    met = a.join(b, F.col("a_id").eqNullSafe(F.col("b_id")), "full").select(F.coalesce("a_id", "b_id").alias(id_col), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    free = apart(F.col("b"), F.col("a"))
    return met.select(id_col, F.explode(F.concat("a", free)).alias("e")).select(*(F.col(id_col) if c == id_col else F.col(f"e.{c}").alias(c) for c in both.names))


def with_external(docs: DataFrame, external: DataFrame, id_col: str = "doc_id", text_col: str = "text", entities: list[str] | None = None, score_threshold: float | None = None) -> DataFrame:
    """The documents with `entities`: what is found here, then the admitted external spans (in characters) that overlap
    none of it; with start and end in bytes and characters, score and source.

    Spans are grouped by document and meet the texts once; texts are scanned once, and no text is copied for a span.
    """
    span = F.struct(F.col("cstart").cast("int").alias("cstart"), F.col("cend").cast("int").alias("cend"), "entity_type", F.col("score").cast("float").alias("score"))
    own = admitted(external, entities, score_threshold).groupBy(F.col(id_col).alias("spans_id_")).agg(F.collect_list(span).alias("spans_"))
    met = docs.join(own, F.col(id_col) == F.col("spans_id_"), "left").drop("spans_id_")
    text, given = F.col(text_col), F.coalesce("spans_", F.array().cast(own.schema["spans_"].dataType))

    def placed(s: Column) -> Column:
        n = F.length(text)
        ends = let(n, lambda n: F.transform(F.concat(F.transform(s, lambda x: x["cstart"]), F.transform(s, lambda x: x["cend"])), lambda c: F.least(F.greatest(c, F.lit(0)), n)))

        def entity(x: Column, i: Column, chars: Column, places: Column) -> Column:
            j = i + F.size(s)
            return F.struct(
                x["entity_type"].alias("entity_type"), F.lit(100).alias("rec_order"), F.get(places, i).alias("start"), F.get(places, j).alias("end"), F.get(chars, i).alias("cstart"), F.get(chars, j).alias("cend"), x["score"].alias("score"),
                F.lit("TierB").alias("source"), F.lit(None).cast("string").alias("value"),
            )

        return let(ends, lambda chars: let(byte_places(text, chars), lambda places: F.transform(s, lambda x, i: entity(x, i, chars, places))))

    # bound, not columns of their own, which a plan would write out wherever they are used
    merged = let(entities_of(text_col, entities, score_threshold), lambda found: let(let(given, placed), lambda more: F.concat(found, apart(more, found).cast(NONE))))
    return met.withColumn("entities", merged).drop("spans_")
