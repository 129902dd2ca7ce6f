"""Detection: entity spans of a text column."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recognizers import NONE, Recognizer, chosen


@lru_cache(maxsize=64)
def _of_column(name: str, entities: tuple[str, ...] | None, score_threshold: float | None, context: int) -> Column:
    """Building the expression takes longer than planning it, so it is kept for a column's name and a session."""
    return entities_of(F.col(name), entities, score_threshold)


def entities_of(text: Column | str, entities: list[str] | None = None, score_threshold: float | None = None, more: tuple[Recognizer, ...] = ()) -> Column:
    """Array of all entities of a text, by recognizer and then by place. A projection: it streams as it is."""
    if isinstance(text, str):
        if more:
            return entities_of(F.col(text), entities, score_threshold, more)
        return _of_column(text, None if entities is None else tuple(entities), score_threshold, id(SparkContext._active_spark_context))
    each = [r.entities(text, score_threshold) for r in chosen(entities, more)]
    return F.concat(*each) if each else F.array().cast(NONE)


def detect(df: DataFrame, id_cols: list[str], text_col: str = "text", entities: list[str] | None = None, score_threshold: float | None = None, include_text: bool = False, more: tuple[Recognizer, ...] = ()) -> DataFrame:
    """A row for each entity: ids, entity_type, rec_order, start, end (bytes), cstart, cend (characters), score, source.

    The matched text is left out unless include_text asks for it.
    """
    found = df.select(*id_cols, F.explode(entities_of(text_col, entities, score_threshold, more)).alias("e"))
    out = ["entity_type", "rec_order", "start", "end", "cstart", "cend", "score", "source"] + ["value"] * include_text
    return found.select(*id_cols, *(F.col(f"e.{c}").alias(c) for c in out))


def in_order(spans: DataFrame, id_cols: list[str]) -> DataFrame:
    return spans.orderBy(*id_cols, "rec_order", "start")


def counts(spans: DataFrame, *by: str) -> DataFrame:
    """Number of entities by type (and further columns): an audit without matched text."""
    return spans.groupBy(*by, "entity_type").agg(F.count("*").alias("n"))
