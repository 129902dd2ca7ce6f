"""Nearest neighbours by inner product with a vantage-point tree for each shard.

Largest inner product becomes least distance once every vector gets one more coordinate that brings all to the same
norm (queries get 0 there), and distances obey the triangle inequality. A bounded sample of candidates is spread
over their cells: a row belongs to the nearest of a few centres, and a cell to as many shards, dealt by a hash, as its
bytes need. A shard has one tree: its rows are halved at the median distance to a vantage point until leaves are small.

The sample also bounds every query from the start: its k-th best in the sample is no better than its k-th best of all.
A query is sent to the shards whose ball, around the centre and as wide as its farthest row, reaches within that bound;
the others are never met. In a shard, blocks of queries descend together, the nearer half first; the farther half is
skipped by queries whose distance to the boundary exceeds `factor` times their distance to their k-th best so far.
Factor 1 skips nothing that could matter and so is exact; smaller ones skip more, of shards and of halves.

Candidates move once, in packed chunks, to the one task that builds their tree, and queries move to the shards that may
hold their neighbours, in a sorted stream that a task reads chunk by chunk; so a shard's tree is built once, not once for
each group of queries, and a task holds one shard whatever the number of queries. Only where shards are fewer than
shuffle partitions are they repeated in lanes, each of which takes a part of the queries.

Equal vectors of a shard are one point with its smallest ids, each once, of which no result needs more than k + 1; tasks
thin them out before they move. Where ids have several vectors, a query looks for more points until it holds k ids
besides its own, and what shards and a query's own vectors find is merged by id. Candidates within rounding of the k-th
are scored anew, coordinate by coordinate, so equal vectors score equally in every shard.

Cases: vectors that are null, zero, or hold null or non-finite parts neither ask nor answer; only vectors of the same
number of parts compare; ids without a valid vector and queries without candidates give no rows; null ids take no
part; rows that repeat an id count once, with their best score; ties go to the smaller id; further columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, cut, mix64, parts

FACTOR = 1.0
LEAF = 512
#: Bytes of a shard's vectors, about, and rows of one at least where more shards would only serve parallel work.
SHARD_BYTES, LEAST_ROWS = 64_000_000, 4096
#: Sampled candidates of each number of parts, from which queries' bounds come, and centres among them, at most.
SAMPLE, CENTRES = 4096, 256
#: Queries of a lane: at least so many, where lanes only serve parallel work, and about as many at most.
LEAST_LANE, LANE_ROWS = 4096, 1_000_000
BLOCK = 512


def valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(parts, ids, vectors) for each number of parts in a batch of (id, vec)."""
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    vec = batch.column("vec")
    flat, ends = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.r_[0, np.cumsum(np.diff(vec.offsets.to_numpy()))]
    dim = np.diff(ends)
    for d in np.unique(dim):
        own = np.flatnonzero(dim == d)
        yield int(d), ids[own], flat[(ends[own][:, None] + np.arange(d)).ravel()].reshape(len(own), d)


class Cells:
    """Centres among sampled candidates of one number of parts, and what the sample tells of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, k: int, centres: int):
        self.ids, self.x, self.most, self.k = ids, x, most, k
        self.full = np.c_[x, np.sqrt(np.maximum(0, most - np.einsum("ij,ij->i", x, x)))]
        # the first of the sample, then always the one farthest from those there are
        self.at, gap = [0], np.linalg.norm(self.full - self.full[0], axis=1)
        while len(self.at) < min(centres, len(x)) and gap.max() > 0:
            self.at.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(self.full - self.full[self.at[-1]], axis=1))
        self.centres = self.full[self.at]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each candidate and its distance from the centre."""
        # the last coordinate of a row above the sampled norm is 0; `most` is of all rows, so there is none
        full = np.c_[x, np.sqrt(np.maximum(0, self.most - np.einsum("ij,ij->i", x, x)))]
        square = np.einsum("ij,ij->i", full, full)[:, None] + np.einsum("ij,ij->i", self.centres, self.centres) - 2 * full @ self.centres.T
        cell = square.argmin(1)
        return cell, np.linalg.norm(full - self.centres[cell], axis=1)

    def bounds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th best score of each query among the sampled ids but its own; none (minus infinity) if there are fewer."""
        if len(self.ids) <= self.k:
            return np.full(len(q), -np.inf)
        s = q @ self.x.T
        s[ids[:, None] == self.ids] = -np.inf
        return -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]

    def meets(self, q: np.ndarray, bound: np.ndarray, reach: np.ndarray, factor: float) -> np.ndarray:
        """Whether a query may have neighbours in each cell, whose farthest row is `reach` from its centre."""
        square = np.einsum("ij,ij->i", q, q) + self.most
        slack = 1e-9 * (square + 1)
        far = np.sqrt(np.maximum(0, square[:, None] - 2 * (q @ self.x[self.at].T)))
        near = np.sqrt(np.maximum(0, square - 2 * np.where(np.isfinite(bound), bound, 0) + slack))
        return ~np.isfinite(bound)[:, None] | (far - reach <= factor * near[:, None] + slack[:, None])


class Tree:
    """A vantage-point tree over distinct vectors (rows of x)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        norms = np.einsum("ij,ij->i", x, x)
        self.x = x
        self.most = float(norms.max())
        self.full = np.c_[x, np.sqrt(np.maximum(0, self.most - norms))]
        self.root = self._grow(np.arange(len(x)), leaf)

    def _grow(self, own: np.ndarray, leaf: int):
        if len(own) <= leaf:
            return own
        # of a few spread candidates the one whose distances vary most
        tried = own[np.linspace(0, len(own) - 1, 5).astype(int)]
        spread = [np.linalg.norm(self.full[own[:: max(1, len(own) // 256)]] - self.full[c], axis=1).std() for c in tried]
        point = tried[int(np.argmax(spread))]
        far = np.linalg.norm(self.full[own] - self.full[point], axis=1)
        edge = float(np.median(far))
        inside = far <= edge
        if inside.all():
            return own
        return point, edge, self._grow(own[inside], leaf), self._grow(own[~inside], leaf)

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that hold each query's k best rows, and few others; none below `least`, if given."""
        n = len(q)
        square = np.einsum("ij,ij->i", q, q) + self.most
        slack = 1e-9 * (np.sqrt(square) * np.sqrt(self.most) + 1)
        best = np.full((n, k), -np.inf)
        if least is not None:
            best[:] = least[:, None]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def radius(who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, square[who] - 2 * (best[who].min(1) - slack[who])))

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if not isinstance(node, tuple):
                s = q[who] @ self.x[node].T
                both = np.concatenate([best[who], s], 1)
                best[who] = both if both.shape[1] == k else -np.partition(-both, k - 1, axis=1)[:, :k]
                i, j = np.nonzero(s >= (best[who].min(1) - slack[who])[:, None])
                found.append((who[i], node[j], s[i, j]))
                return
            point, edge, inner, outer = node
            d = np.sqrt(np.maximum(0, square[who] - 2 * (q[who] @ self.x[point])))
            near = d <= edge
            visit(inner, who[near])
            visit(outer, who[~near])
            visit(outer, who[near & (edge - d <= factor * radius(who) + 1e-9 * (1 + edge))])
            visit(inner, who[~near & (d - edge <= factor * radius(who) + 1e-9 * (1 + edge))])

        visit(self.root, np.arange(n))
        if not found:
            return np.empty(0, int), np.empty(0, int)
        who, row, s = (np.concatenate(c) for c in zip(*found, strict=True))
        last = s >= best[who].min(1) - slack[who]
        return who[last], row[last]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, coordinate by coordinate in order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


EMPTY = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})


class Shard:
    """The points of a shard with their ids, and its tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        _, first, group = np.unique(x + 0.0, axis=0, return_index=True, return_inverse=True)
        self.k, self.point = k, x[first]
        self.tree = Tree(self.point)
        by = np.lexsort((ids, group.ravel()))
        ids, group = ids[by], group.ravel()[by]
        new = np.r_[True, (np.diff(group) != 0) | (np.diff(ids) != 0)]
        self.ids, group = ids[new], group[new]
        self.start = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        self.several = len(np.unique(self.ids)) < len(self.ids)  # some id has more than one point

    def top(self, q_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, factor: float) -> pd.DataFrame:
        """query_id, vec_id, score: at least each query's k best of the shard from its bound on, without its own id."""
        k, start, point = self.k, self.start, self.point
        out, todo = [], [(np.arange(lo, min(lo + BLOCK, len(q))), k + 1) for lo in range(0, len(q), BLOCK)]
        # a little below, as sums come out differently in another order
        floor = np.where(np.isfinite(bound), bound - 1e-9 * (np.abs(bound) + np.sqrt(np.einsum("ij,ij->i", q, q) * self.tree.most) + 1), -np.inf)
        while todo:
            own, most = todo.pop()
            who, row = self.tree.search(q[own], most, factor, floor[own])
            score = inner(q[own][who], point[row])
            count = np.minimum(np.diff(start)[row], k + 1)
            rep = np.repeat(np.arange(len(row)), count)
            got = self.ids[start[row][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)]
            f = pd.DataFrame({"asked": who[rep], "query_id": q_ids[own][who][rep], "vec_id": got, "score": score[rep]})
            f = f[f["query_id"] != f["vec_id"]].sort_values(["asked", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            f = f.drop_duplicates(["asked", "vec_id"])
            if self.several and most < len(point):
                # fewer ids than asked for, though there were points enough
                short = (np.bincount(f["asked"], minlength=len(own)) < k) & (np.bincount(who, minlength=len(own)) >= most)
                f = f[~short[f["asked"]]]
                again, at_once = own[short], max(1, BLOCK * (k + 1) // (4 * most))
                todo += [(again[lo : lo + at_once], 4 * most) for lo in range(0, len(again), at_once)]
            out.append(f[f.groupby("asked").cumcount() < k].drop(columns="asked"))
        return pd.concat(out, ignore_index=True) if out else EMPTY


def thinned(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of rows of which equal vectors keep their `most` smallest ids."""
    _, group = np.unique(x + 0.0, axis=0, return_inverse=True)
    by = np.lexsort((ids, group.ravel()))
    g, i = group.ravel()[by], ids[by]
    by = by[np.r_[True, (np.diff(g) != 0) | (np.diff(i) != 0)]] if len(by) else by
    g = group.ravel()[by]
    start = np.r_[0, np.flatnonzero(np.diff(g)) + 1] if len(g) else np.empty(0, int)
    return by[np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) < most]


PACKED = "part int, kind int, ids binary, vecs binary, bounds binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "kind", "ids", "vecs", "bounds"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, factor: float = FACTOR, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product with each query, its own id left out.

    The driver holds `sample` vectors of each number of parts and two numbers a cell.
    """
    spark = candidates.sparkSession
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & valid(F.col("vec")))
    some, asked = usable(candidates), usable(queries)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    kinds = {r["dim"]: (r["n"], r["most"]) for r in some.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()}
    m = asked.count()
    at_least = parts(spark)
    # vectors travel as they are stored; sums are of doubles
    width = np.float32 if isinstance(some.schema["vec"].dataType.elementType, T.FloatType) and asked.schema["vec"].dataType == some.schema["vec"].dataType else np.float64
    raw = lambda x: x.astype(width).tobytes()
    vectors = lambda b, d: np.frombuffer(b, width).astype(np.float64).reshape(-1, d)
    size = np.dtype(width).itemsize
    cells: dict[int, Cells] = {}
    for d, (n, most) in kinds.items():
        shards = max(1, -(-n * 8 * d // shard_bytes), min(at_least, n // LEAST_ROWS))
        of_dim = some.filter(F.size("vec") == d)
        share = min(1.0, sample / n)
        got = (of_dim if share == 1.0 else of_dim.sample(share, 3)).select("id", "vec").limit(2 * sample).toArrow().combine_chunks()
        ids = got.column("id").to_numpy()
        x = np.array(got.column("vec").to_pylist(), np.float64).reshape(len(ids), d)
        one = np.unique(ids, return_index=True)[1]  # an id counts once
        if len(one):
            cells[d] = Cells(ids[one], x[one], most * (1 + 1e-12), k, int(min(CENTRES, shards)))
    if not cells or not m:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = dict(zip(cells, np.cumsum([0, *(len(c.at) for c in cells.values())])[:-1].tolist(), strict=True))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, ids, x in rows_of(b):
                if d not in cells:
                    continue
                left = thinned(ids, x, k + 1)
                ids, x = ids[left], x[left]
                cell, far = cells[d].of(x)
                for c in np.unique(cell):
                    own = cell == c
                    out.append((first[d] + int(c), int(own.sum()), float(far[own].max()), ids[own].tobytes(), raw(x[own]), d))
            if out:
                types = (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["cell", "n", "far", "ids", "vecs", "dim"])

    dealt = cut(some.mapInArrow(deal, "cell int, n long, far double, ids binary, vecs binary, dim int"))
    seen = {r["cell"]: (r["n"], r["far"], r["dim"]) for r in dealt.groupBy("cell", "dim").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}
    # a cell's shards follow each other, then its lanes
    n_shards = {c: max(1, -(-n * 8 * d // shard_bytes)) for c, (n, _, d) in seen.items()}
    lanes = max(1, min(-(-at_least // sum(n_shards.values())), m // LEAST_LANE), -(-m // LANE_ROWS))
    base, total = {}, 0
    for c in sorted(seen):
        base[c] = total
        total += n_shards[c] * lanes
    reach = {d: np.array([seen.get(first[d] + i, (0, -np.inf, d))[1] for i in range(len(c.at))]) for d, c in cells.items()}

    def to_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, ids, vecs, d in zip(*(b.column(c).to_pylist() for c in ("cell", "ids", "vecs", "dim")), strict=True):
                ids, x = np.frombuffer(ids, np.int64), vectors(vecs, d)
                # equal vectors go to the same shard of their cell
                shard = (mix64((x + 0.0).view(U64) * mix64(np.arange(1, d + 1, dtype=U64))).sum(1, dtype=U64) % U64(n_shards[cell])).astype(int)
                for s in np.unique(shard):
                    own = shard == s
                    at = base[cell] + int(s) * lanes
                    yield _packed([(at + lane, 0, ids[own].tobytes(), raw(x[own]), b"") for lane in range(lanes)])

    def to_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, ids, q in rows_of(b):
                if d not in cells:
                    continue
                for lo in range(0, len(ids), BLOCK):
                    i, v = ids[lo : lo + BLOCK], q[lo : lo + BLOCK]
                    bound = cells[d].bounds(i, v)
                    meets = cells[d].meets(v, bound, reach[d], factor)
                    lane = (mix64(i.view(U64)) % U64(lanes)).astype(int)
                    out = []
                    for c in np.flatnonzero(meets.any(0)):
                        if (cell := first[d] + int(c)) not in base:
                            continue
                        for one in np.unique(lane[meets[:, c]]):
                            own = meets[:, c] & (lane == one)
                            out += [(base[cell] + s * lanes + int(one), 1, i[own].tobytes(), raw(v[own]), bound[own].tobytes()) for s in range(n_shards[cell])]
                    if out:
                        yield _packed(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, shard = None, [], None
        for b in batches:
            for row in range(b.num_rows):
                part, kind, ids, vecs, bounds = (b.column(c)[row].as_py() for c in ("part", "kind", "ids", "vecs", "bounds"))
                if part != at:
                    at, held, shard = part, [], None
                ids = np.frombuffer(ids, np.int64)
                x = vectors(vecs, len(vecs) // size // len(ids))
                if kind == 0:
                    held.append((ids, x))
                    continue
                if held:
                    shard, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), k), []
                if shard:
                    found = shard.top(ids, x, np.frombuffer(bounds, np.float64), factor)
                    yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    both = dealt.select("cell", "ids", "vecs", "dim").mapInArrow(to_shards, PACKED).unionByName(asked.mapInArrow(to_queries, PACKED))
    streams = both.repartitionById(total, "part").sortWithinPartitions("part", "kind")
    tops = streams.mapInArrow(meet, "query_id long, vec_id long, score double")
    tops = tops.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return tops.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
