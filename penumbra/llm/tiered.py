"""Ranked lexical search over a tiered index.

Documents are read once into blocks of postings. With the corpus's counts known, each term's postings in a block are
ordered by impact and dealt to tiers, the highest first; each tier carries its residual bound, the greatest impact that
the lower tiers hold. Tiers are columns of one table, so a round reads only the tiers it needs.

Items are searched in lanes. In a round every task adds up what the tiers read so far give each document of a block: a
lower bound, and with the residual bounds of the terms that a document was not met in, an upper bound. Lower bounds give
each item the score that its last place takes at least. Where no document of a block comes up to it, that is the proof
that the block has nothing more for the item; without the proof the item falls through to the next tier of that block,
the last of which makes all scores exact. No postings are shuffled: a task emits its best `k` bounds an item.

Cases: a null or empty text holds no term, is not counted and never found; an item without terms, or whose terms no document
holds, has no rows; every row of items and documents counts by itself, so equal rows rank beside each other; equal scores
are in order of doc_id, null last; a term that repeats in an item counts as often; a very long text is a block of its
own; further columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_size, cut, delete, shared_folder

#: Of a term's postings in a block, tier k holds those up to this rank or share of them, whichever is more; then the rest.
TIERS = ((8, 1 / 32), (64, 1 / 4))
LAST = len(TIERS)
#: Bytes of items that are searched together, and distinct terms of all items up to which only theirs are indexed.
LANE_BYTES, VOCABULARY = 8_000_000, 500_000
#: Blocks with open items that are broadcast; more meet in a shuffle.
OPEN_BLOCKS = 100_000
#: Bytes that are no part of a term become spaces, A to Z lower case; all of a non-ASCII character is part of one.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


# Index --------------------------------------------------------------------------------------------------------------

POSTINGS = "block long, docs array<long>, lengths array<long>, terms array<binary>, counts array<int>, places array<int>, tfs array<long>"


def postings(docs: DataFrame, vocabulary: set[bytes] | None = None) -> DataFrame:
    """POSTINGS of whole texts, a row for each block of documents: `counts` postings a term, in the order of terms;
    `places` are rows of the block. A vocabulary leaves out all other terms' postings (not their part of lengths)."""
    wanted = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for part in by_size(b, "text"):
                found = [terms(t) for t in _binary(part.column("text"))]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                own = set(chain.from_iterable(found))
                known = sorted(own if wanted is None else own & wanted.value)
                at = {t: i for i, t in enumerate(known)}
                ids = np.fromiter(map(at.get, chain.from_iterable(found), repeat(-1)), np.int64, int(lengths.sum()))
                rows = np.repeat(np.arange(len(found)), lengths)
                keys, tfs = np.unique((ids * len(found) + rows)[ids >= 0], return_counts=True)
                counts = np.bincount(keys // len(found), minlength=len(known)) if len(found) else keys
                row = [block, part.column("doc_id").to_numpy(zero_copy_only=False) if not part.column("doc_id").null_count else part.column("doc_id").to_pylist(), lengths, known, counts.astype(np.int32), (keys % max(1, len(found))).astype(np.int32), tfs]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, KINDS, strict=True)], NAMES)
                block += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, POSTINGS)


KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
NAMES = [f.split()[0] for f in POSTINGS.split(", ")]
TIER = [(f"counts{k}", f"places{k}", f"impacts{k}", f"below{k}") for k in range(LAST + 1)]
INDEX = "block long, docs array<long>, terms array<binary>" + "".join(f", {c} array<int>, {p} array<int>, {i} array<long>, {r} array<long>" for c, p, i, r in TIER)


def impacts(tfs: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """1,000,000,000 tf div (1000 tf + 12 m) for postings in documents of these lengths, m = 75 + 25 length n div total."""
    if len(lengths) and 25 * int(lengths.max()) * n >= 1 << 62:
        norm = 75 + np.array([25 * int(x) * n // total for x in lengths], np.int64)
    else:
        norm = 75 + 25 * lengths * n // max(1, total)
    return 1_000_000_000 * tfs // (1000 * tfs + 12 * norm)


def tiered(raw: DataFrame, n: int, total: int) -> DataFrame:
    """INDEX of postings: each block's terms with their postings by tier, highest impact first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, words = b.column("docs").slice(i, 1), b.column("terms").slice(i, 1)
                lengths, counts, places, tfs = (_numbers(b.column(c), i) for c in ("lengths", "counts", "places", "tfs"))
                impact = impacts(tfs, lengths[places], n, total)
                term = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((places, -impact, term))
                places, impact = places[order].astype(np.int32), impact[order]
                starts = np.cumsum(counts) - counts
                rank = np.arange(len(term)) - np.repeat(starts, counts)
                tier, out = np.full(len(term), LAST), []
                for k, (few, share) in reversed(list(enumerate(TIERS))):
                    tier[rank < np.repeat(np.maximum(few, np.ceil(counts * share)), counts)] = k
                upto = np.zeros(len(counts), np.int64)
                for k in range(LAST + 1):
                    own = tier == k
                    held = np.bincount(term[own], minlength=len(counts))
                    upto += held
                    below = np.zeros(len(counts), np.int64)
                    more = upto < counts
                    below[more] = impact[(starts + upto)[more]]
                    out += [pa.array([x], pa.list_(t)) for x, t in ((held.astype(np.int32), pa.int32()), (places[own], pa.int32()), (impact[own], pa.int64()), (below, pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), docs, words, *out], [f.split()[0] for f in INDEX.split(", ")])

    return raw.mapInArrow(run, INDEX)


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


# Search -------------------------------------------------------------------------------------------------------------


class Lane:
    """Items that are searched together: item_id, and for each the numbers and weights of its terms."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n: int):
        """items: (item_id, terms with repeats)."""
        self.ids = [i for i, _ in items]
        self.terms = sorted({t for _, own in items for t in own if t in df})
        number = {t: i for i, t in enumerate(self.terms)}
        weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in self.terms]
        self.items: list[list[tuple[int, int]]] = []
        for _, own in items:
            times: dict[int, int] = {}
            for t in own:
                if t in number and weight[number[t]] > 0:
                    times[number[t]] = times.get(number[t], 0) + 1
            self.items.append([(t, c * weight[t]) for t, c in times.items()])


class Block:
    """A block's tiers 0 to `upto`, met with a lane's terms."""

    def __init__(self, b: pa.RecordBatch, row: int, upto: int, lane: Lane):
        self.size = len(b.column("docs")[row].values)
        words = b.column("terms")[row].values.to_pylist()
        at = dict(zip(words, range(len(words)), strict=True))
        self.at = [at.get(t, -1) for t in lane.terms]
        self.tiers = []
        for k in range(upto + 1):
            held, places, impact, below = (_numbers(b.column(c), row) for c in TIER[k])
            self.tiers.append((np.r_[0, np.cumsum(held)].tolist(), places, impact))
            self.below = below.tolist()

    def lower(self, item: list[tuple[int, int]]) -> np.ndarray:
        """What the tiers give each document at least."""
        out = np.zeros(self.size, np.int64)
        for t, w in item:
            if (i := self.at[t]) >= 0:
                for ends, places, impact in self.tiers:
                    a, z = ends[i], ends[i + 1]
                    if z > a:
                        out[places[a:z]] += w * impact[a:z]
        return out

    def reaches(self, item: list[tuple[int, int]], least: int) -> bool:
        """Whether any document's upper bound is `least` or more; a term that it was not met in counts its residual bound."""
        rest = sum(w * self.below[self.at[t]] for t, w in item if self.at[t] >= 0)
        if rest >= least:
            return True
        out = np.zeros(self.size, np.int64)
        for t, w in item:
            if (i := self.at[t]) >= 0:
                below = self.below[i]
                for ends, places, impact in self.tiers:
                    a, z = ends[i], ends[i + 1]
                    if z > a:
                        out[places[a:z]] += w * (impact[a:z] - below)
        return self.size > 0 and rest + int(out.max()) >= least


def _best(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, len(values) - k)[len(values) - k :] if len(values) > k else values


class Search:
    """The rounds of one lane."""

    def __init__(self, index: DataFrame, lane: Lane, k: int):
        self.index, self.k, self.least = index, k, [1] * len(lane.items)
        self.lane = index.sparkSession.sparkContext.broadcast(lane)

    def rows(self, upto: int, open_: DataFrame | None) -> DataFrame:
        """Blocks with the columns of tiers up to `upto`, and the items that are open in them (null: all)."""
        tiers = self.index.select("block", "docs", "terms", *chain.from_iterable(TIER[: upto + 1]))
        if open_ is None:
            return tiers.withColumn("open", F.lit(None).cast("array<int>"))
        few = open_.count() <= OPEN_BLOCKS
        return tiers.join(F.broadcast(open_) if few else open_, "block")

    def raise_least(self, upto: int, open_: DataFrame | None) -> None:
        """What an item's last place takes at least, from lower bounds: the k best of each task."""
        shared, k = self.lane, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, np.ndarray] = {}
            for b in batches:
                for row in range(b.num_rows):
                    block, own = Block(b, row, upto, shared.value), b.column("open")[row].as_py()
                    for i in range(len(shared.value.items)) if own is None else own:
                        low = block.lower(shared.value.items[i])
                        best[i] = _best(np.r_[best[i], low[low > 0]] if i in best else low[low > 0], k)
            item = np.repeat(np.array(list(best), np.int32), [len(v) for v in best.values()]) if best else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(np.concatenate(list(best.values())) if best else np.empty(0, np.int64), pa.int64())], ["item", "low"])

        met = self.rows(upto, open_).mapInArrow(run, "item int, low long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("low").desc()))
        last = met.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("item").agg(F.count("*").alias("n"), F.min("low").alias("low"))
        for item, n, low in last.collect():
            if n == k:
                self.least[item] = max(self.least[item], low)

    def still_open(self, upto: int, open_: DataFrame | None) -> DataFrame:
        """(block, open): items that the tiers up to `upto` give no proof for."""
        shared, least = self.lane, self.index.sparkSession.sparkContext.broadcast(self.least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for row in range(b.num_rows):
                    block, own = Block(b, row, upto, shared.value), b.column("open")[row].as_py()
                    left = [i for i in (range(len(shared.value.items)) if own is None else own) if block.reaches(shared.value.items[i], least.value[i])]
                    if left:
                        out.append({"block": b.column("block")[row].as_py(), "open": left})
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("open", pa.list_(pa.int32()))]))

        return cut(self.rows(upto, open_).mapInArrow(run, "block long, open array<int>"))

    def scores(self, open_: DataFrame | None) -> DataFrame:
        """(item, item_id, doc_id, score): of each block the documents that may be among the k best, by all tiers."""
        shared, k, least = self.lane, self.k, self.index.sparkSession.sparkContext.broadcast(self.least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for row in range(b.num_rows):
                    block, own = Block(b, row, LAST, shared.value), b.column("open")[row].as_py()
                    docs = b.column("docs")[row].as_py()
                    for i in range(len(shared.value.items)) if own is None else own:
                        score = block.lower(shared.value.items[i])
                        there = np.flatnonzero(score >= least.value[i])
                        best = sorted(((-int(score[d]), docs[d] is None, docs[d] or 0) for d in there))[:k]
                        out += [(i, shared.value.ids[i], None if none else doc, -s) for s, none, doc in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])

        return self.rows(LAST, open_).mapInArrow(run, "item int, item_id long, doc_id long, score long")

    def found(self) -> DataFrame:
        open_ = None
        for upto in range(LAST):
            self.raise_least(upto, open_)
            open_ = self.still_open(upto, open_)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        return self.scores(open_).withColumn("rank", rank).filter(F.col("rank") <= self.k).select("item_id", "rank", "doc_id", "score")


def item_terms(items: DataFrame) -> DataFrame:
    """(uid, item_id, terms array<binary>): each row of items, its terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("item_id"), pa.array([terms(t) for t in _binary(b.column("text"))], pa.list_(pa.binary()))], ["uid", "item_id", "terms"])

    return items.select(F.monotonically_increasing_id().alias("uid"), F.col("item_id").cast("long"), "text").mapInArrow(run, "uid long, item_id long, terms array<binary>")


def build(docs: DataFrame, folder: str, vocabulary: set[bytes] | None = None) -> tuple[DataFrame, DataFrame, int, int]:
    """(index, (term, df), N, L) of documents, written to `folder`."""
    spark = docs.sparkSession
    postings(docs, vocabulary).write.parquet(f"{folder}/postings")
    raw = spark.read.parquet(f"{folder}/postings")
    n, total = raw.select(F.size(F.filter("lengths", lambda x: x > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("t")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    df = raw.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df")).withColumnRenamed("terms", "term")
    tiered(raw, n, total).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index"), df, n, total


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    asked = cut(item_terms(items))
    own = asked.select(F.explode("terms").alias("term")).distinct()
    few = own.count() <= VOCABULARY
    folder = f"{shared_folder(spark)}/tiered-{uuid.uuid4().hex}"
    index, df, n, total = build(docs, folder, {bytes(r[0]) for r in own.collect()} if few else None)
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)))).first()[0] or 0
    lanes = 1 + size // LANE_BYTES
    dealt = asked.withColumn("lane", F.pmod(F.xxhash64("uid"), F.lit(lanes)))
    counted = cut(df.join(own, "term", "left_semi")) if lanes > 1 else df
    parts_: list[DataFrame] = []
    for i in range(lanes):
        block = dealt.filter(F.col("lane") == i)
        rows = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in block.orderBy("uid").collect()]
        in_lane = counted.join(F.broadcast(block.select(F.explode("terms").alias("term")).distinct()), "term", "left_semi")
        lane = Lane(rows, {bytes(t): c for t, c in in_lane.collect()}, n)
        parts_.append(cut(Search(index, lane, k).found()))
    delete(spark, folder)
    out = parts_[0]
    for p in parts_[1:]:
        out = out.unionByName(p)
    return out


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
i AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0),
q AS (SELECT r, item_id, term, count(*) AS times FROM (SELECT r, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
m AS (SELECT r, 75 + (25 * len(t) * n) // l AS m FROM d, c WHERE len(t) > 0),
s AS (SELECT q.r AS item, p.r AS doc, any_value(q.item_id) AS item_id, any_value(p.doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON m.r = p.r GROUP BY q.r, p.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
