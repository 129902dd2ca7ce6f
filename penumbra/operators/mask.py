"""Masking: one block for each character of the union of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.checks import let
from ..functions.spans import before, byte_places, snapped
from .detect import entities_of


def mask_places(text: Column, spans: Column) -> Column:
    """The text with the characters of spans blocked; same number of characters.

    Spans are structs with start and end in bytes, at characters' starts. Overlapping and touching spans run together,
    empty and inverted ones and parts beyond the text do nothing. Pieces are cut from the text's bytes and joined once.
    """
    held = F.transform(spans, lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("a"), F.least(s["end"], F.octet_length(text)).alias("b")))

    def of(raw: Column, ordered: Column) -> Column:
        piece = lambda a, b: F.substring(raw, a + 1, F.greatest(b - a, F.lit(0))).cast("string")

        def pieces(upto) -> Column:
            def one(s: Column, i: Column) -> Column:
                def from_(reach: Column) -> Column:
                    begin = F.greatest(s["a"], reach)
                    return F.concat(piece(reach, begin), F.repeat(F.lit(P.BLOCK), F.length(piece(begin, s["b"]))))

                return let(upto(i), from_)

            return F.concat(F.array_join(F.transform(ordered, one), ""), piece(upto(F.size(ordered)), F.octet_length(raw)))

        return before(F.transform(ordered, lambda s: s["b"]), F.lit(0), lambda a, x: F.greatest(a, x), pieces)

    # bytes and order are worked out once, not for each piece
    stitched = let(F.array_sort(F.filter(held, lambda s: s["a"] < s["b"])), lambda ordered: let(text.cast("binary"), lambda raw: of(raw, ordered)))
    return F.when(F.size(spans) == 0, text).otherwise(stitched)


def mask(text: Column, spans: Column) -> Column:
    """mask_places() for spans in characters (cstart, cend)."""
    real = F.filter(spans, lambda s: s["cstart"] < s["cend"])

    def of(s: Column) -> Column:
        ends = let(byte_places(text, F.concat(F.transform(s, lambda x: x["cstart"]), F.transform(s, lambda x: x["cend"]))), lambda p: F.transform(s, lambda x, i: F.struct(F.get(p, i).alias("start"), F.get(p, i + F.size(s)).alias("end"))))
        return mask_places(text, ends)

    return let(real, of)


def mask_bytes(text: Column, spans: Column) -> Column:
    """mask_places() for spans in any bytes (start, end), held within the text and moved back to characters' starts."""
    real = F.filter(spans, lambda s: s["start"] < s["end"])
    ends = lambda raw: F.transform(real, lambda s: F.struct(snapped(raw, s["start"]).alias("start"), snapped(raw, s["end"]).alias("end")))
    return mask_places(text, let(text.cast("binary"), ends))


def merged(spans: DataFrame, id_cols: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union of spans as disjoint ones: sorted, those that overlap or touch run together."""
    w = Window.partitionBy(*id_cols).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = spans.filter(F.col(start) < F.col(end)).withColumn("new_", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    numbered = grouped.withColumn("group_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*id_cols, "group_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("group_")


def redact(df: DataFrame, text_col: str = "text", entities: list[str] | None = None, score_threshold: float | None = None, include_text: bool = False) -> DataFrame:
    """The rows with `redacted` and `entities` (the audit trail, without matched text unless asked for)."""
    found = df.withColumn("entities", entities_of(text_col, entities, score_threshold))
    out = found.withColumn("redacted", mask_places(F.col(text_col), F.col("entities")))
    return out if include_text else out.withColumn("entities", F.transform("entities", lambda e: e.dropFields("value")))


def output(df: DataFrame, format: str = "native") -> Column:
    """What a result row shows: markdown if asked for and there, else text, and the other way round."""
    if format not in ("native", "markdown"):
        raise ValueError("format is native or markdown")
    order = ("markdown", "text") if format == "markdown" else ("text", "markdown")
    return F.coalesce(*(df[c] for c in order if c in df.columns))


def audit_json(spans: DataFrame, *keep: str) -> DataFrame:
    """A JSON object for each entity: type, span, score, box if placed and source; never matched text. Columns in `keep`
    stay beside it."""
    fields = [F.col("entity_type"), F.struct("start", "end").alias("span"), F.col("score")] + [F.col("bbox")] * ("bbox" in spans.columns) + [F.col("source")]
    return spans.select(*keep, F.to_json(F.struct(*fields)).alias("value"))
