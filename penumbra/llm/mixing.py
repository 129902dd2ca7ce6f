"""Mixing sources to target weights by the cube method.

Each source gets a target number of words; a document's expected copies are target / size of its source, up to a
limit. Whole copies are certain, the fraction is an inclusion probability. The flight phase moves the probabilities
of three documents at a time along the null space of two balance constraints (their number and their words), until
one of them is 0 or 1 and the next document takes its place; at most two documents of a chunk stay fractional, beside twelve of
spread sizes that are kept for landing. The fractional rest of a source's chunks flies again in the same way, in
chunks as long as one task would get too many, and its last fourteen documents land on the whole numbers that bring the
source's words nearest to its target.

A source of any size is flown in chunks of a bounded number of documents, dealt by a hash. Rows that are equal are
counted first and travel as counts until they are in their chunk, a bounded number together, so no value is hot. Every
chunk draws its own directions from a seed. The driver learns one number a round of the water-filling that sets
targets, and one a partition of sources.

Cases: a null text has size 0; null sources are one source, last in order; sources without words have target 0; an
empty table gives an empty one; rows that repeat are documents of their own; a very long text is counted whole; further
columns are ignored by `mixed` and kept by `drawn`, whatever their names; reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Documents that fly together at most, about.
CHUNK_ROWS = 2000
MOST_COPIES = 3
#: Sources up to which their one row each is broadcast.
SMALL_SOURCES = 10_000
#: Documents of a source, beside the two that flight leaves, whose outcomes are compared in landing.
LANDING = 12
#: Equal rows that are dealt together at most.
TOGETHER = 100
SEED = 17
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs outside space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def row_key(docs: DataFrame, columns: list[str]) -> Column:
    """A number that rows equal in these columns share; nulls are unlike any value."""
    own = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*own, F.concat(*(F.when(c.isNull(), "0").otherwise("1") for c in own)))


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """The rows with nth: their place in order of a column, nulls last; sorted in parts, of which the driver counts rows."""
    now = cut(rows.orderBy(F.col(column).asc_nulls_last()))
    count = dict(map(tuple, now.groupBy(F.spark_partition_id()).count().collect()))
    before, at = [], 0
    for p in range(max(count, default=-1) + 1):
        before.append(at)
        at += count.get(p, 0)
    first = F.element_at(F.array(*map(F.lit, before or [0])).cast("array<long>"), F.spark_partition_id() + 1)
    return now.withColumn("nth", first + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """From (source, size, rows) to (source, n, source_size, target): weights repeat over sources in code point order, nulls last; what a source
    cannot take (over `most` times its size) is shared by weight among the others until none is above."""
    each = sizes.groupBy("source").agg(F.sum("rows").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    stats = cut(numbered(each, "source").withColumn("weight", weight).drop("nth"))
    total, most_of, by_weight = stats.agg(F.sum("source_size"), F.sum(F.col("source_size") * 0.0), F.sum(F.when(F.col("source_size") > 0, F.col("weight")))).first()
    rate = 0.0
    while total and by_weight:
        rate = (total - most_of) / by_weight
        full = F.col("weight") * rate > F.col("source_size") * float(most)
        capped, rest = stats.agg(F.sum(F.when(full, F.col("source_size") * float(most))), F.sum(F.when(~full, F.col("weight")))).first()
        if (capped or 0.0) == most_of:
            break
        most_of, by_weight = capped or 0.0, rest
    return stats.select("source", "n", "source_size", F.least(F.col("weight") * rate, F.col("source_size") * float(most)).cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Probabilities moved until at most two are fractional, keeping their sum and their sum of sizes."""
    p = p.astype(float).copy()
    live: list[int] = []
    queue = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    value, weight = p.tolist(), size.astype(float).tolist()
    while True:
        while len(live) < 3 and (i := next(queue, None)) is not None:
            live.append(i)
        if len(live) < 3:
            break
        a, b, c = live
        # null space of the two rows (1, 1, 1) and (size a, size b, size c)
        u = [weight[b] - weight[c], weight[c] - weight[a], weight[a] - weight[b]]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = down = float("inf")
        for i, x in zip(live, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - value[i]) / x), min(down, value[i] / x)
            elif x < 0:
                up, down = min(up, value[i] / -x), min(down, (1 - value[i]) / -x)
        # up with chance down / (up + down) keeps every expectation; the order of documents is already hashed
        step = up if (_spin(a, b, c, seed) * (up + down)) < down else -down
        for i, x in zip(live, u, strict=True):
            value[i] = min(1.0, max(0.0, value[i] + step * x))
        live = [i for i in live if EPS < value[i] < 1 - EPS]
    out = np.array(value)
    return np.where(out <= EPS, 0.0, np.where(out >= 1 - EPS, 1.0, out))


def _spin(a: int, b: int, c: int, seed: int) -> float:
    """A number from 0 to 1 that is the same in every run of a seed."""
    x = (seed * 0xFF51AFD7ED558CCD + a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    x = (x * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 32)) >> 11) / (1 << 53)


def held(p: np.ndarray, size: np.ndarray, n: int = LANDING) -> np.ndarray:
    """Marks of the fractional documents kept for landing: n of them, evenly spaced in order of size."""
    mark = np.zeros(len(p), bool)
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    order = open_[np.argsort(size[open_], kind="stable")]
    mark[order[np.unique(np.linspace(0, len(order) - 1, n).astype(int))] if len(order) > n else order] = True
    return mark


def fly_all_but(p: np.ndarray, size: np.ndarray, mark: np.ndarray, seed: int = SEED) -> np.ndarray:
    out = p.astype(float).copy()
    out[~mark] = flight(p[~mark], size[~mark], seed)
    return out


def land(p: np.ndarray, size: np.ndarray, owed: float, seed: int = SEED) -> np.ndarray:
    """Whole numbers for all, so that the words taken come nearest to `owed`, and then their number to its expectation.

    All but a few documents fly; of those kept and the two that flight leaves all outcomes are compared.
    """
    many = p.sum()
    p = fly_all_but(p, size, held(p, size), seed)
    rest = np.flatnonzero((p > 0) & (p < 1))
    owed -= float((p * size)[p == 1].sum())
    many -= float((p == 1).sum())
    bits = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    words, count = bits @ size[rest].astype(float), bits.sum(1)
    p[rest] = bits[np.lexsort((np.abs(count - many), np.abs(words - owed)))[0]]
    return p


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_COPIES, chunk_rows: int = CHUNK_ROWS, seed: int = SEED, columns: tuple[str, ...] = ("doc_id", "source", "text")) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, row) for each document; row is its row_key by `columns`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), row_key(docs, list(columns)).alias("row"))
    sizes = cut(own.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("rows")))
    share = cut(targets(sizes, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EPS).cast("int")
    p = F.greatest(F.lit(0.0), rate - whole)
    fields = ["doc_id", "source", "size", "row", "nth", "source_size", "target", "whole", "p", "owed"]
    # equal rows are dealt a bounded number together: nth is the first one's number, rows how many there are
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(TOGETHER).cast("long")))
    flying = sizes.join(F.broadcast(share) if share.count() <= SMALL_SOURCES else share, sizes["source"].eqNullSafe(share["source"])).select("doc_id", sizes["source"], "size", "row", "rows", first.alias("nth"), "source_size", "target", whole.alias("whole"), p.alias("p"), (p * F.col("size")).alias("owed"), "n")
    flying = flying.withColumn("rows", F.least(F.col("rows") - F.col("nth"), F.lit(TOGETHER)))
    kinds = "doc_id long, source string, size long, row long, nth long, source_size long, target double, whole int, p double, owed double"
    order = ["row", "doc_id", "nth"]

    def of(level: int, *key) -> int:
        return zlib.crc32(repr((seed, level, *key)).encode())

    def fly(level: int):
        def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            if level == 0:  # a row for each of equal documents
                many = f["rows"].to_numpy()
                at = np.repeat(np.arange(len(f)), many)
                f = f.iloc[at].assign(nth=f["nth"].to_numpy()[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
            f = f.sort_values(order, kind="stable", ignore_index=True)
            start, size = f["p"].to_numpy(), f["size"].to_numpy()
            p = fly_all_but(start, size, held(start, size), of(level, *key))
            # those still fractional owe what the chunk owed less what is decided
            left = (p > 0) & (p < 1)
            owed = float(f["owed"].sum() - (p * size)[~left].sum())
            return f.assign(p=p, owed=np.where(left, owed / max(1, left.sum()), 0.0))[fields]

        return run

    def settle(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable", ignore_index=True)
        return f.assign(p=land(f["p"].to_numpy(), f["size"].to_numpy(), float(f["owed"].sum()), of(-1, *key)))[fields]

    fractional = F.col("p").between(EPS, 1 - EPS)
    done, level = [], 0
    while True:
        chunk = F.pmod(F.xxhash64("row", "nth", F.lit(level), F.lit(seed)), F.ceil(F.col("n") / chunk_rows))
        flown = cut(flying.withColumn("chunk", chunk).select(*fields, *["rows"] * (level == 0), "chunk").groupBy("source", "chunk").applyInPandas(fly(level), kinds))
        done.append(flown.filter(~fractional))
        rest = flown.filter(fractional)
        each = rest.groupBy("source").agg(F.count("*").alias("n"))
        if (each.agg(F.max("n")).first()[0] or 0) <= 4 * chunk_rows:
            break
        each, level = cut(each), level + 1
        flying = rest.join(F.broadcast(each) if each.count() <= SMALL_SOURCES else each, rest["source"].eqNullSafe(each["source"])).select(*(rest[c] for c in fields), "n")
    done.append(rest.groupBy("source").applyInPandas(settle, kinds))
    all_done = done[0]
    for more in done[1:]:
        all_done = all_done.unionByName(more)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("int")
    return all_done.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "source", "row")


def drawn(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """The documents as often as the mix takes them: all their columns, rows repeated up to `most` times.

    Texts are shuffled once. Rows that are equal in all columns are any of them: they are counted, and their copies are
    made from one, a bounded number at a time.
    """
    name = "row_"
    while name in docs.columns:
        name += "_"
    copies, rows = f"{name}copies", f"{name}rows"
    taken = cut(mixed(docs, weights, most, columns=tuple(docs.columns)).groupBy(F.col("row").alias(name)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0))
    keyed = docs.withColumn(name, row_key(docs, docs.columns))
    one, many = taken.filter(F.col(rows) == 1), taken.filter(F.col(rows) > 1)
    out = keyed.join(one, name).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    if not many.isEmpty():
        alike = keyed.join(many, name).distinct()
        blocks = alike.withColumn(rows, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(TOGETHER).cast("long"))))
        spread = blocks.repartition(F.col(name), F.col(rows))
        out = out.unionByName(spread.withColumn(copies, F.explode(F.sequence(F.col(rows), F.least(F.col(copies), F.col(rows) + TOGETHER) - 1))))
    return out.drop(name, copies, rows)
