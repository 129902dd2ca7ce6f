"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's shingles (five words; a text of fewer words is one
shingle, one without words has none). The sketch of a union is the k smallest of two sketches' hashes, so parts can be
sketched apart and merged. From two sketches follow the resemblance and containment of the shingle sets and from one
the number of distinct shingles; all are exact while no set exceeds k.

Cases: a null text counts as empty; two empty sketches resemble each other fully, an empty one is contained in any;
equal texts have equal sketches whatever their ids; repeated rows are rows like any others; null ids count as the
smallest; a very long text is read whole, by itself; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, by_size, mix64, parts, words

K = 256
SHINGLE = 5
#: Distinct words whose hashes a task keeps at once.
CACHE_WORDS = 300_000
#: Rows of a range of ids, about; a range is sorted and read as a stream by one task.
RANGE_ROWS = 100_000
#: Rows that the driver samples (an id, a hash and a length each): for each range, and in all at least.
SAMPLE_A_RANGE, LEAST_SAMPLE = 16, 50_000
#: A row that repeats is split over so many ranges that each gets this many of its copies in the sample: that the last
#: one gets none of all copies has a chance below 1e-17.
COPIES = 40
#: What a row costs beside its bytes, when ranges are made even.
ROW_BYTES = 200


class Sketcher:
    """Sketches texts, keeping the hashes of words seen before."""

    def __init__(self, k: int = K, shingle: int = SHINGLE):
        self.k, self.shingle, self.known = k, shingle, {}
        self.odd = [U64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j in range(shingle)]

    def hashes(self, text: str | None) -> np.ndarray:
        """A hash for each shingle, repeats included."""
        found = words(text)
        if not found:
            return np.empty(0, U64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            each = np.array([known[w] for w in found], U64)
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            each = np.array([known[w] for w in found], U64)
        width = min(self.shingle, len(each))
        n = len(each) - width + 1
        total = np.full(n, width, U64)
        for j in range(width):
            total += mix64(each[j : j + n] + self.odd[j])* self.odd[j]
        return mix64(total)

    def sketch(self, text: str | None) -> np.ndarray:
        return np.unique(self.hashes(text))[: self.k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated shared part of the union of two shingle sets; exact while the union has at most k."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated part of a's shingles that b has too."""
    if not len(a):
        return 1.0
    union = np.union1d(a, b)[:k]
    shared = resemblance(a, b, k) * distinct_count(union, k) if len(b) else 0.0
    return min(1.0, shared / distinct_count(a, k))


def pack(a: np.ndarray) -> bytes:
    return a.astype(">u8").tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, ">u8").astype(U64)


def printed(a: np.ndarray) -> str:
    return base64.b64encode(pack(a)).decode()


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(id, sketch binary, n_shingles double) for each row; no shuffle."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(k, shingle)
        for b in chain.from_iterable(by_size(x, "text") for x in batches):
            made = [make.sketch(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([pack(m) for m in made], pa.binary()), pa.array([distinct_count(m, k) for m in made], pa.float64())], ["id", "sketch", "n_shingles"])

    kind = src.schema["id"].dataType
    return src.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("sketch", T.BinaryType()), T.StructField("n_shingles", T.DoubleType())])).withColumnRenamed("id", id_col)


def merge(df: DataFrame, key: str, sketch_col: str = "sketch", k: int = K, fan: int = 64) -> DataFrame:
    """(key, sketch) with one merged sketch a key.

    Rows are first merged within tasks, then within `fan` salted parts of each key, then across parts, so that a key
    with many rows never meets in one task.
    """
    src = df.select(F.col(key).alias("key"), F.col(sketch_col).alias("sketch"))
    out = T.StructType([T.StructField("key", src.schema["key"].dataType), T.StructField("sketch", T.BinaryType())])

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(key, pack(np.unique(np.concatenate([unpack(x) for x in g if x is not None] or [np.empty(0, U64)]))[:k])) for key, g in f.groupby("key", dropna=False)["sketch"]], columns=["key", "sketch"]).astype({"key": f["key"].dtype})

    def group(f: pd.DataFrame) -> pd.DataFrame:
        return next(within(iter([f[["key", "sketch"]]])))

    first = src.mapInPandas(within, out).withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(fan)))
    return first.groupBy("key", "salt").applyInPandas(group, out).groupBy("key").applyInPandas(group, out).withColumnRenamed("key", key)


class Ranges:
    """Ranges of rows in the order of (id, hash of text), even in bytes by a sample of (id, hash, bytes).

    `cuts` are the first rows of all ranges but the first; rows equal to a cut that stands several times may be in any of
    the ranges that it parts, since they are one row repeated. `head` is the first row of all.
    """

    def __init__(self, at: np.ndarray, h: np.ndarray, size: np.ndarray, ranges: int, head: tuple[int, int]):
        order = np.lexsort((h, at))
        at, h, cost = at[order], h[order], np.cumsum(size[order] + ROW_BYTES)
        ends = np.searchsorted(cost, cost[-1] * np.arange(1, ranges) / ranges) if len(cost) else []
        self.cuts, self.head = [], head
        for row, m in Counter((int(at[i]), int(h[i])) for i in ends).items():
            if row > head:
                copies = int(((at == row[0]) & (h == row[1])).sum()) if m > 1 else 0
                self.cuts += [row] * max(1, min(m, copies // COPIES))
        self.n = len(self.cuts) + 1

    def span(self, row: tuple[int, int]) -> tuple[int, int]:
        """First and last range that a row may be in."""
        low, high = bisect_left(self.cuts, row), bisect_right(self.cuts, row)
        return (high, high) if high - low < 2 else (low + 1, high)

    def repeated(self) -> list[tuple[int, int]]:
        """Rows that begin a range and may be very many: the first of all, and those that stand several times."""
        return sorted({self.head, *(a for a, b in zip(self.cuts, self.cuts[1:], strict=False) if a == b)})

    def before(self, row: tuple[int, int]) -> list[int]:
        """The ranges that a row follows: it is the next one of their last row."""
        low, high = bisect_left(self.cuts, row), bisect_right(self.cuts, row)
        return [low] * (high > low) + [self.n - 1] * (row == self.head)


def edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sketch every text and its edited text, whose last quarter comes from the next document's start.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles. Rows
    are in order of id, null ids first, and equal ids in order of a hash of the text, then text. They are dealt to ranges
    of that order, each text is moved once, and a sorted stream meets each row's successor. A range also gets the first
    row of the next one, the last range the first row of all. Ranges are even in bytes; a row that repeats over more
    than a range is split, as its copies follow each other. The driver holds a sample of bounded size a range.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63))))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    rows, least = src.agg(F.count("*"), F.min("at")).first()
    src = src.withColumn("h", F.xxhash64("text"))
    # null ids come first, beside the smallest number
    first = F.col("doc_id").isNull() | (F.col("doc_id") == least) if least == -(2**63) else F.col("doc_id") == least
    head = src.filter(first).agg(F.min("h")).first()[0] if rows else 0
    n = max(parts(spark), -(-rows // range_rows))
    share = max(SAMPLE_A_RANGE * n, LEAST_SAMPLE) / max(1, rows)
    some = (src if share >= 1 else src.sample(share, 11)).select("at", "h", F.octet_length("text").alias("size")).toArrow()
    ranges = Ranges(*(some.column(c).to_numpy() for c in ("at", "h", "size")), n, (least or 0, head))
    many = set(ranges.repeated())

    @F.pandas_udf("array<int>")
    def places(at: pd.Series, h: pd.Series, spin: pd.Series) -> pd.Series:
        out = []
        for a, b, r in zip(at.tolist(), h.tolist(), spin.tolist(), strict=True):
            low, high = ranges.span((a, b))
            out.append([low + int(r * (high - low + 1)), *([] if (a, b) in many else ranges.before((a, b)))])
        return pd.Series(out)

    order = ["doc_id", "at", "h", "text", "ahead", "b"]
    dealt = src.select("doc_id", "at", "h", "text", F.posexplode(places("at", "h", F.rand(5))).alias("ahead", "b")).select(order)
    # of rows that may be very many one copy goes to the range before them
    to = spark.createDataFrame([(a, b, r) for a, b in sorted(many) for r in ranges.before((a, b))], "at long, h long, b int")
    near = src if len(many) > 1 else src.filter(first)
    copies = near.join(F.broadcast(to), ["at", "h"]).withColumn("ahead", F.lit(1)).select(order).dropDuplicates(["at", "h", "text", "b"])
    dealt = dealt.unionByName(copies).repartitionById(ranges.n, "b").sortWithinPartitions("b", "ahead", "at", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, before, out = Sketcher(k, shingle), None, []

        def add(after: str, sketch: np.ndarray) -> None:
            _, doc, text, own = before
            quarter = len(text) // 4
            new = text[: len(text) - quarter] + after[:quarter]
            edited = make.sketch(new)
            out.append((doc, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), printed(own), printed(edited), resemblance(own, edited, k), resemblance(own, sketch, k), distinct_count(own, k)))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in chain.from_iterable(by_size(x, "text") for x in batches):
            for b, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("b", "ahead", "doc_id", "text")), strict=True):
                own = None
                if before and before[0] == b:
                    own = before[3] if text == before[2] else make.sketch(text)
                    add(text, own)
                elif before:  # a range within one repeated row, whose next is the row again
                    add(before[2], before[3])
                before = None if ahead else (b, doc, text, make.sketch(text) if own is None else own)
                if len(out) >= 2000:
                    yield made()
                    out.clear()
        if before:
            add(before[2], before[3])
        if out:
            yield made()

    return dealt.select("b", "ahead", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double")
