"""What the operators share: reading tables, cutting lineage, words, hashes of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, delete, release, shared_folder, table

__all__ = ["U64", "by_size", "cut", "delete", "doc_crc", "forget", "kept", "met", "mix64", "parts", "release", "sampled", "shared_folder", "table", "words"]
U64 = np.uint64


#: Rows and bytes of text that a worker holds at once; one longer text is held by itself.
SLICE_ROWS, SLICE_BYTES = 1000, 4_000_000
#: A key with more than this part of all rows is hot; there are fewer than 1 / HOT_PART of them.
HOT_PART = 0.001


_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]):
    """What a worker process keeps from task to task: one thing at a time, so that stages that follow each other have the
    memory in turn."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Let go of what a worker process keeps for an operator whose stage is over."""
    _KEPT.clear()


def by_size(batch: pa.RecordBatch, column: str | int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts stay under `size` bytes together."""
    lo = held = 0
    for hi, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if hi > lo and (held + n > size or hi - lo >= rows):
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def met(rows: DataFrame, few: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with `few` (each key once; `size` rows of `rows` have it), where keys may be hot.

    Hot keys, fewer than 1 / HOT_PART by their definition, are broadcast; the others meet in a shuffle. Both should be
    cut, as each is read twice.
    """
    total = few.agg(F.sum(size)).first()[0] or 0
    hot = few.filter(F.col(size) > total * HOT_PART)
    own, rest = rows.join(F.broadcast(hot), key), rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return own.unionByName(rest.join(few, key))


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def doc_crc(doc_id: Column) -> Column:
    """CRC-32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def sampled(docs: DataFrame, labels: DataFrame, column: str, usable, most: int, most_bytes: int, of_several=F.max) -> DataFrame:
    """(doc_id, text, label): the labelled documents to fit on, each id once, by the hash of their ids.

    At most `most` ids that `usable` (a Column of doc_id) admits, whose texts have at most `most_bytes` bytes together;
    a text that would go over is left out. Of an id's labels the one that `of_several` picks counts and of its texts the
    greatest; null labels and ids are not used. The driver learns ids and lengths, `most` at most, before any text.
    """
    kept = labels.select(F.col("doc_id").cast("long"), F.col(column).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable(F.col("doc_id"))).groupBy("doc_id").agg(of_several("label").cast("int").alias("label"))
    few = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id")
    found = cut(own.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")))
    chosen, held = [], 0
    for i, n in found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held + n <= most_bytes:
            chosen.append(i)
            held += n
    left = found.sparkSession.createDataFrame([(i,) for i in chosen], "chosen long")
    return found.join(F.broadcast(left), found["doc_id"] == left["chosen"], "left_semi")


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit with a chance near one half."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters outside space and U+0009 to U+000D."""
    return text.encode("utf-8", "replace").split() if text else []
