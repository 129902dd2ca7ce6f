"""SimHash near-duplicates by meeting in the middle.

Two fingerprints within 3 bits share a middle: a value within 2 bits of one and 1 bit of the other. Every distinct
fingerprint emits the variants within half the radius, the variants are shuffled, and those that meet are verified.
Half of 3 is not whole, so parity decides: fingerprints with an even number of set bits emit themselves and their
64 one-bit variants, odd ones also two-bit variants (a pair at distance 3 has one of each; pairs at 1 or 2 meet in
one-bit variants). Of the two-bit variants only those are needed whose two bits lie in the same half: two of any three
differing bits do. So odd fingerprints do not emit the whole ball of radius 2, and every pair meets all the same.

A group that shares a variant is linked as a star. Its hub is a member within one bit of the variant; all others are
within two bits of it, so within three of the hub, and connectivity loses nothing. Two-bit members that meet without
such a hub may be four bits apart; those within reach meet elsewhere. So no pairs within groups are emitted. Links are
reduced to a forest inside each task before they are written.

Variants travel packed: for each fingerprint and shuffle bucket one list of flip codes, which the receiver expands.

Near copies at a five-word similarity of 0.8 differ in 4 to 19 of 64 bits, beyond any ball that can be emitted. For them
there is a wide fingerprint (`wide_links`): 512 bits over the distinct shingles, in 16 blocks of 32. Each block emits
itself and its 32 one-bit variants, so two texts meet where any block differs in at most two bits: always so up to 47 bits in
all and mostly beyond (a pair at similarity 0.8 has about 60). Only a variant and 32 bytes a text are shuffled: its name,
64 further bits, in which near texts differ in few, and a bit of each of 128 smallest shingle hashes (`minima`), to tell nearer texts. Of those that meet in a variant, all are linked that a chain of such pairs joins: by a star where its hub is near all, else by comparing the
smallest part with the rest until no part is left, without emitting pairs. Three members of a variant are hubs, by an
order that differs from block to block, so near copies are linked in several ways. Texts of equal block value share all its 33 variants:
links from their hubs are written where they share it unchanged, and used but not written where the same bit of both is flipped. What a task finds goes on as a forest of its nearest links
(by minima): of all links up to any distance, it joins what they join, so links that the sketches refuse don't stand in for nearer ones, and a group of near copies
has fewer links a task than members. A link then stands if bottom-256 sketches of the five-word shingles (op7's) put the similarity at 0.8, less their error, or more. Documents that merely share a long passage are no near copies.

A node has at most 43,744 links of three bits, the size of its ball, so links have no hot key. Components and fingerprints that many
share are few by the bound in `common.met` and meet their members by broadcast.

Cases: null or empty texts have fingerprint zero and link like others; equal texts share one fingerprint, which is
searched once; a very long text is read whole, by itself; null ids take part and never become a component's id unless
no member has one; rows that repeat an id are rows each; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bottomk
from .common import U64, by_size, cut, forget, met, mix64, parts, release
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Variants that one group of the search holds, about: 16 bytes each.
GROUP_VARIANTS = 3_000_000
#: Fingerprints whose variants are made at once: about 8,000 bytes each while made.
BLOCK = 2048

_BIT = np.left_shift(U64(1), np.arange(64, dtype=U64))
_PAIRS = np.array([[i, j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)])
#: Code 0 is the fingerprint itself, 1 to 64 its one-bit variants, then two bits of one half.
FLIPS = np.concatenate([np.zeros(1, U64), _BIT, _BIT[_PAIRS[:, 0]] | _BIT[_PAIRS[:, 1]]])
EVEN = 65
#: A wide fingerprint: blocks of 32 bits, 64 bits to compare, and how many of these near copies may differ in: 8 to 10 is
#: usual at similarity 0.8, 32 for texts that have nothing in common.
BLOCKS, WIDE_RADIUS = 16, 20
#: Bits that tell which of several near texts is nearer, a power of two.
MINIMA = 128
#: Hubs of a variant: each links to all of its members that are near.
HUBS = 3
#: The least similarity, and what a sketch's estimate may be under it: its standard error there is 0.025.
SIMILAR, SLACK = 0.8, 0.03
_FLIP = np.concatenate([np.zeros(1, np.uint32), np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))])
_WORD = np.arange(1, BLOCKS // 2 + 2, dtype=U64) * U64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each run of three words, repeats included; of the whole sequence if shorter; none without words."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.empty(0, U64)
    if len(found) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], U64)
    line = b" ".join(found)
    at, starts = 0, []
    for w in found:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    digest, ends = xxhash.xxh64_intdigest, starts[SHINGLE:]
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=False)], U64)


def lowered(text: str | None) -> str:
    """The text with A to Z in lower case."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).decode()


def fingerprint(text: str | None) -> int:
    h = shingle_hashes(text)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BIT[counts * 2 > len(h)].sum(dtype=U64))


def wide_fingerprint(text: str | None) -> bytes:
    """72 bytes: a bit is one if set in over half of the text's distinct shingles' hashes, which are mixed anew for each
    8 bytes; zeros without words. The last 8 bytes belong to no block."""
    h = np.unique(shingle_hashes(text))
    counts = np.zeros(64 * len(_WORD), np.int64)
    for i in range(0, len(h), 255):  # a byte holds a count of 255
        mixed = mix64(h[i : i + 255, None] + _WORD)
        counts += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(h), bitorder="little").tobytes()


def minima(sketch: np.ndarray) -> bytes:
    """16 bytes: of the least hash of a sketch in each of 128 bins one bit; zero where a bin has none. Sketches of similarity s
    differ in about (1 - s) / 2 of the bits whose bins are filled."""
    bits = np.zeros(MINIMA, np.uint8)
    bins, first = np.unique(sketch & np.uint32(MINIMA - 1), return_index=True)
    bits[bins] = sketch[first] >> np.uint32(8) & np.uint32(1)
    return np.packbits(bits, bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, wide, fp, sketch): 72 bytes and 16 of minima, their XXH64 as a signed long that stands for them, and the upper
    halves of the smallest hashes of five-word shingles; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sketcher = bottomk.Sketcher()
        for batch in batches:
            for b in by_size(batch, "text"):
                texts = b.column("text").to_pylist()
                sketches = [(sketcher.sketch(lowered(t)) >> U64(32)).astype("<u4") for t in texts]
                made = [wide_fingerprint(t) + minima(s) for t, s in zip(texts, sketches, strict=True)]
                sketched = [s.tobytes() for s in sketches]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary()), pa.array(_names(made)), pa.array(sketched, pa.binary())], ["doc_id", "wide", "fp", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, wide binary, fp long, sketch binary")


def _names(wide: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, SEED) for w in wide], U64).view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed long; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for b in by_size(batch, "text"):
                made = np.array([fingerprint(t.as_py()) for t in b.column("text")], U64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _codes(fp: np.ndarray) -> np.ndarray:
    """How many codes each fingerprint emits."""
    even = np.bitwise_count(fp) % 2 == 0
    return np.where(even, EVEN, len(FLIPS))


def _forest(pairs: np.ndarray) -> list[int]:
    """Rows of `pairs` that join what all of them join, without a circle."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at, root, forest = at.reshape(-1, 2), list(range(len(nodes))), []
    for i, (x, y) in enumerate(at.tolist()):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append(i)
    return forest


def _apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(-1, dtype=np.int32)


def _once(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.unique(np.sort(np.stack([one, other], 1), axis=1), axis=0)


def _starred(prints: np.ndarray, who: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of HUBS members of every group (`start`: where one begins): the hub's number, its place, those of the members behind it,
    and which of these are within the radius."""
    if not len(who):
        return
    first = np.flatnonzero(start)[np.cumsum(start) - 1]
    place = np.arange(len(who))
    for h in range(HUBS):
        at = place[place > first + h]
        hub, close = first[at] + h, np.zeros(len(at), bool)
        for i in range(0, len(at), 100_000):
            close[i : i + 100_000] = _apart(prints[who[hub[i : i + 100_000]]], prints[who[at[i : i + 100_000]]]) <= radius
        yield h, hub, at, close


def _chained(prints: np.ndarray, members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of members within the radius that join all that chains of such pairs join.

    First each member not yet near another is held against all. Then the smallest part is held against the rest: it joins
    a part or is done. So nothing is held for all pairs, and a group of near copies takes one look at each.
    """
    own, n = prints[members], len(members)
    part, pairs = np.full(n, -1), []
    for i in range(n):
        if part[i] < 0:
            near = np.flatnonzero(_apart(own[i], own) <= radius)
            new = near[part[near] < 0]
            joined, first = np.unique(part[near], return_index=True)
            pairs += [(i, int(j)) for j in np.r_[new, near[first[joined >= 0]]] if j != i]
            part[np.isin(part, joined[joined >= 0])] = i
            part[new] = i
    open_ = np.ones(n, bool)
    while True:
        names, sizes = np.unique(part[open_], return_counts=True)
        if len(names) < 2:
            return [(int(members[i]), int(members[j])) for i, j in pairs]
        least = names[sizes.argmin()]
        rest = np.flatnonzero(open_ & (part != least))
        for i in np.flatnonzero(open_ & (part == least)):
            near = rest[_apart(own[i], own[rest]) <= radius]
            if len(near):
                pairs.append((int(i), int(near[0])))
                part[part == least] = part[near[0]]
                break
        else:
            open_[part == least] = False


def wide_links(distinct: DataFrame, radius: int = WIDE_RADIUS, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """Pairs (a, b) of `fp` whose graph connects all wide fingerprints that meet in a block and differ in at most `radius`
    of the 64 bits to compare; input: (fp, wide), each once."""
    spark = distinct.sparkSession
    flips = len(_FLIP)
    buckets = max(parts(spark), -(-distinct.count() * BLOCKS * flips // group_variants))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.arange(BLOCKS * flips)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                wide = np.frombuffer(b"".join(b.column("wide").slice(lo, BLOCK).to_pylist()), "<u4").reshape(-1, BLOCKS + 2 + MINIMA // 32)
                own = np.stack([b.column("fp").slice(lo, BLOCK).to_numpy().view(U64), *np.ascontiguousarray(wide[:, BLOCKS:]).view("<u8").T], 1)
                variants = (wide[:, code // flips] ^ _FLIP[code % flips]).ravel()
                blocks = np.tile((code // flips).astype(np.uint8), len(wide))
                where = (mix64(_keys(variants, blocks)) % U64(buckets)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                where, who, variants, codes = where[order], order // len(code), variants[order].astype("<u4"), (order % len(code)).astype("<u2")
                first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
                rows = []
                for f, e in zip(first, np.r_[first[1:], len(where)], strict=True):
                    there, per = np.unique(who[f:e], return_counts=True)
                    rows.append((int(where[f]), own[there].tobytes(), per.astype("<u2").tobytes(), variants[f:e].tobytes(), codes[f:e].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(zip(*rows, strict=True))], ["bucket", "own", "per", "variants", "codes"])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        forget()
        own = np.frombuffer(b"".join(f["own"]), "<u8").reshape(-1, 2 + MINIMA // 64)
        names, prints = own[:, 0], own[:, 1:2]
        who = np.repeat(np.arange(len(own)), np.frombuffer(b"".join(f["per"]), "<u2"))
        block, flip = np.divmod(np.frombuffer(b"".join(f["codes"]), "<u2"), flips)
        key = _keys(np.frombuffer(b"".join(f["variants"]), "<u4"), block)
        order = np.lexsort((mix64(mix64(names)[who] ^ (key >> U64(32))), key))
        key, who, flip = key[order], who[order], flip[order]
        same = key[1:] == key[:-1]
        again = np.r_[same, False] | np.r_[False, same]
        key, who, flip = key[again], who[again], flip[again]
        if not len(who):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        start = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(start) - 1
        pairs, elsewhere, near = [], [], np.ones(len(who), bool)
        for h, hub, at, close in _starred(prints, who, start, radius):
            if h == 0:
                near[at] = close
            hub, at = hub[close], at[close]
            met_before = (flip[hub] == flip[at]) & (flip[at] > 0)
            for to, those in ((elsewhere, met_before), (pairs, ~met_before)):
                to.append(_once(who[hub[those]], who[at[those]]))
        own_value = np.flatnonzero(flip == 0)
        for _, hub, at, close in _starred(prints, who[own_value], np.diff(group[own_value], prepend=-1) != 0, radius):
            pairs.append(_once(who[own_value[hub[close]]], who[own_value[at[close]]]))
        bounds, seen = np.r_[np.flatnonzero(start), len(who)], set()
        for g in np.unique(group[~near]):
            members = who[bounds[g] : bounds[g + 1]]
            if len(members) > 2 and (known := members.tobytes()) not in seen:
                seen.add(known)
                pairs.append(np.array(_chained(prints, members, radius), np.int64).reshape(-1, 2))
        here, there = np.concatenate(pairs), np.concatenate(elsewhere)
        kept, first = np.unique(np.sort(np.concatenate([here, there]), axis=1), axis=0, return_index=True)
        ends = np.sort(names[kept], axis=1)
        # one order of links in all tasks, so that what is left to another task is joined there by links as near
        order = np.lexsort((ends[:, 1], ends[:, 0], _apart(own[kept[:, 0], 2:], own[kept[:, 1], 2:])))
        order = order[_forest(kept[order])]
        named = ends[order[first[order] < len(here)]].view(np.int64)
        return pd.DataFrame({"a": named[:, 0], "b": named[:, 1]})

    packed = distinct.repartition(parts(spark), "fp").mapInArrow(emit, "bucket int, own binary, per binary, variants binary, codes binary")
    return packed.groupBy("bucket").applyInPandas(meet, "a long, b long")


def _keys(variants: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Block number and variant in one."""
    return variants.astype(U64) | blocks.astype(U64) << U64(32)


def links(distinct: DataFrame, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """Pairs (a, b) of fingerprints within 3 bits whose graph connects all that are; input: fp, each once."""
    spark = distinct.sparkSession
    n = distinct.count()
    buckets = max(parts(spark), -(-n * (EVEN + len(FLIPS)) // 2 // group_variants))
    low = np.uint64(buckets)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().view(U64)
            for i in range(0, len(fps), BLOCK):
                fp = fps[i : i + BLOCK]
                count = _codes(fp)
                who = np.repeat(np.arange(len(fp)), count)
                code = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                where = (mix64(fp[who] ^ FLIPS[code]) % low).astype(np.int32)
                order = np.argsort(where, kind="stable")
                where, who, code = where[order], who[order], code[order].astype("<u2")
                first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
                last = np.r_[first[1:], len(where)]
                rows = []
                for f, e in zip(first, last, strict=True):
                    per = np.bincount(who[f:e], minlength=len(fp))
                    there = np.flatnonzero(per)
                    rows.append((int(where[f]), fp[there].tobytes(), per[there].astype("<u2").tobytes(), code[f:e].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "fps", "per", "codes"])

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        forget()
        fp = np.concatenate([np.repeat(np.frombuffer(a, U64), np.frombuffer(b, "<u2")) for a, b in zip(f["fps"], f["per"], strict=True)])
        code = np.concatenate([np.frombuffer(c, "<u2") for c in f["codes"]])
        variant = fp ^ FLIPS[code]
        order = np.argsort(variant)
        variant = variant[order]
        same = variant[1:] == variant[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        variant, order = variant[keep], order[keep]
        fp, far = fp[order], code[order] >= EVEN
        if not len(fp):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        by = np.lexsort((fp, far, variant))
        variant, fp, far = variant[by], fp[by], far[by]
        start = np.r_[True, variant[1:] != variant[:-1]]
        hub = np.flatnonzero(start)[np.cumsum(start) - 1]
        take = ~start & ~far[hub]
        a, b = fp[hub[take]], fp[take]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= RADIUS]
        forest = _forest(pairs)
        kept = pairs[forest]
        return pd.DataFrame({"a": kept[:, 0].view(np.int64) if len(kept) == 0 else kept[:, 0].astype(U64).view(np.int64), "b": kept[:, 1].astype(U64).view(np.int64)})

    packed = distinct.repartition(parts(spark), "fp").mapInArrow(emit, "bucket int, fps binary, per binary, codes binary")
    return packed.groupBy("bucket").applyInPandas(meet, "a long, b long")


def near_duplicates(docs: DataFrame, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """(doc_id, fp, component_id) for each document: the smallest doc_id reachable over links of at most 3 bits."""
    prints = cut(fingerprints(docs))
    reps = cut(_each(prints))
    return _grouped(prints, reps, links(reps.select("fp"), group_variants))


def near_copies(docs: DataFrame, radius: int = WIDE_RADIUS, group_variants: int = GROUP_VARIANTS) -> DataFrame:
    """(doc_id, fp, component_id) for each document: the smallest doc_id reachable over near copies, whose wide
    fingerprints meet in a block, differ in at most `radius` of 64 further bits and have alike sketches.

    Texts of equal shingle sets have equal fingerprints. Cases are those of the fingerprints of 64 bits.
    """
    prints = cut(wide_fingerprints(docs))
    reps = cut(_each(prints, F.max("wide").alias("wide")))
    linked = cut(wide_links(reps.select("fp", "wide"), radius, group_variants).distinct())
    return _grouped(prints.select("doc_id", "fp"), reps, _alike(linked, prints))


def _alike(linked: DataFrame, prints: DataFrame) -> DataFrame:
    """The links (a, b) whose texts' sketches are alike; only sketches of linked fingerprints move."""
    ends = linked.select(F.col("a").alias("fp")).unionAll(linked.select(F.col("b").alias("fp"))).distinct()
    sketches = cut(prints.join(ends, "fp", "left_semi").groupBy("fp").agg(F.max("sketch").alias("sketch")))
    one, other = (sketches.select(F.col("fp").alias(c), F.col("sketch").alias(f"of_{c}")) for c in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            near = [bottomk.resemblance(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= SIMILAR - SLACK for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    alike = cut(linked.join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"))
    release(sketches)
    return alike


def _each(prints: DataFrame, *more: Column) -> DataFrame:
    """Each fingerprint once, with its smallest doc_id and its number of rows."""
    return prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), *more)


def _grouped(prints: DataFrame, reps: DataFrame, linked: DataFrame) -> DataFrame:
    reached = components(linked)
    joined = cut(reps.join(reached, reps["fp"] == reached["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    smallest = cut(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    classes = cut(met(joined, smallest, "root", "n").select("fp", "rows", "component_id"))
    for done in (reps, joined, smallest):
        release(done)
    return met(prints, classes, "fp", "rows").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """All columns of the documents that stay: of each group of near copies the one with the smallest doc_id.

    Rows that share an id stay or go together; rows without an id stay, since no id names their group's one.
    """
    found = near_copies(docs, radius).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
