"""Packing by cutting-stock columns: patterns of lengths from a linear program, given to documents by rank.

Tokenized documents (ids and an end id) are cut only where they exceed a sequence; what is left of each is a piece of 1
to capacity - 1 tokens. Only the histogram of those lengths, fewer than `capacity` counts however large the corpus,
comes to the driver. There a linear program covers it with patterns of lengths that fit a sequence: it starts from
patterns that fill exactly (each uses up one length, so they are a basis), and columns priced by an unbounded knapsack
over the duals enter until the rounds' limit or until sequences are within TOLERANCE of the tokens' own need. Pattern
counts are rounded down; what that leaves over, a few pieces a pattern, is covered by further whole patterns.

Assignment is arithmetic: the q-th piece of a length has its place in the q-th slot of that length, so a piece needs its
rank among equal lengths only, which is its rank in its task and the count of earlier tasks. Where patterns leave gaps,
the worst of them are given up; their pieces, as one stream in order of length and rank, are cut to fill the gaps of the
others and then into whole sequences, the last into powers of two. So no sequence is padded.

Cases: a null or empty text is one piece of one end id; equal rows are pieces each; a very long text is tokenized by
itself and cut; null ids stay null; further columns are ignored; an empty table packs into none.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, kept, shared_folder

CAPACITY, END = 2048, 1
#: Rounds of column generation, and how near to the tokens' own need its sequences are enough.
ROUNDS, TOLERANCE = 150, 0.001
#: Rows to cut whose tokens are fetched by broadcast; more meet in a shuffle.
FEW_CUTS = 200_000
#: Distinct chunks and words whose ids a worker keeps.
CACHE_CHUNKS, CACHE_WORDS = 800_000, 1_000_000

# Tokens -------------------------------------------------------------------------------------------------------------

#: Lines of printable ASCII and Latin-1 letters; the vocabulary's split within them (a fixed pattern of it).
PLAIN = re.compile("^[!-~À-ÖØ-öø-ÿ]+$", re.M).findall
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\nA-Za-z0-9À-ÖØ-öø-ÿ ]+|\n").findall
#: White space of other kinds, which chunks are not parted at.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
#: Texts on which the way by chunks must give the library's ids before it is used.
PROBES = ("", "One two, three's don't they'll 1234.5 (x) -- 'quoted' it's\nNext line: été Über £5 ½\nI'm", "a\nb c\nd", "日本語 текст \U0001f600 x", "x  y \n z\n\nw ", "<|endoftext|> a<|endoftext|>b", "WE'LL 'S s' ªº² á")


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Tokens:
    """Ids of whole texts as little-endian bytes. No token of a byte-level vocabulary spans from a character to white
    space, so a text of single spaces and line ends is its chunks, each with the white space before it, encoded once.
    A text with a chunk that isn't of this kind (empty, of other white space, of a special token's look) is marked by it and
    goes to the library whole, as do all texts where a vocabulary fails PROBES."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder, self.known, self.words = Tokenizer.from_file(path), {}, {}
        line = self.encoder.encode("\n", add_special_tokens=False).ids
        self.line, self.by_chunks = line[0] if len(line) == 1 else -1, len(line) == 1
        if self.by_chunks:
            whole = [as_bytes([*e.ids, END]) for e in self.encoder.encode_batch(list(PROBES), add_special_tokens=False)]
            self.by_chunks = list(self.ids(list(PROBES))) == whole

    def _encode(self, new: list[str]) -> list[bytes]:
        """The ids of words without line ends: as one text, a word a line."""
        out: list[bytes] = []
        fast = getattr(self.encoder, "encode_batch_fast", self.encoder.encode_batch)
        for lo in range(0, len(new), 4000):
            ids = np.array(fast(["\n".join(new[lo : lo + 4000])], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.line)).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]
        return out

    def _learn(self, new: list[str]) -> None:
        """New chunks: a word after a space, or one after a line end, which it then begins with."""
        known, words, end = self.known, self.words, as_bytes([self.line])
        mark = b"\xff" * 4
        for first, prefix, before in ((False, " ", b""), (True, "", end)):
            own = [c[1:] for c in new if c[:1] == "\n"] if first else [c for c in new if c[:1] != "\n"]
            whole = "\n".join(own)
            plain = PLAIN(whole)
            if "<|" in whole:
                plain = [c for c in plain if "<|" not in c]
            name = "\n" if first else ""
            other = list(set(own).difference(plain)) if len(plain) < len(own) else []
            odd = {c for c in other if not c or "<|" in c or OTHER_SPACE(c)}
            known.update((name + c, None) for c in odd)
            other = [c for c in other if c not in odd]
            if plain:
                parts = SPLIT(prefix + ("\n" + prefix).join(plain))
                words["\n"] = mark
                if fresh := list(set(parts).difference(words)):
                    words.update(zip(fresh, self._encode(fresh), strict=True))
                made = b"".join(map(words.__getitem__, parts)).split(mark)
                known.update(zip([name + c for c in plain], [before + x for x in made], strict=True) if first else zip(plain, made, strict=True))
            if other:
                known.update((name + c, before + as_bytes(e.ids)) for c, e in zip(other, self.encoder.encode_batch([prefix + c for c in other], add_special_tokens=False), strict=True))

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        end = as_bytes([END])
        split = [("\n" + t).replace("\n", " \n")[1:].split(" ") if t and self.by_chunks else None for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.known
        if new := set(chain.from_iterable(filter(None, split))).difference(known):
            self._learn(list(new))
        for text, chunks in zip(texts, split, strict=True):
            try:
                yield b"".join(map(known.__getitem__, chunks))[4:] + end
            except TypeError:  # no chunks, or one that isn't of the kind
                yield as_bytes([*self.encoder.encode(text or "", add_special_tokens=False).ids, END])


# The program --------------------------------------------------------------------------------------------------------

Pattern = dict[int, int]  # length to how many


def exact(counts: dict[int, int], longest: int, capacity: int, there: int, mirror: int) -> Pattern:
    """A pattern with `longest` that fills a sequence as far as lengths that are there allow, of few long pieces.

    `there` has bit n for each length n that is there, `mirror` bit capacity - n.
    """
    out, gap = {longest: 1}, capacity - longest
    room = lambda n: counts[n] - out.get(n, 0) > 0
    while gap > 0:
        if gap < capacity and there >> gap & 1 and room(gap):
            out[gap] = out.get(gap, 0) + 1
            return out
        both = there & (mirror >> (capacity - gap)) & ((1 << gap) - 1)
        while both:
            a = both.bit_length() - 1
            if a and room(a) and room(gap - a) and (2 * a != gap or counts[a] - out.get(a, 0) > 1):
                for n in (a, gap - a):
                    out[n] = out.get(n, 0) + 1
                return out
            both ^= 1 << a
        fit = there & ((2 << gap) - 1)
        while fit and not ((n := fit.bit_length() - 1) and room(n)):
            fit ^= 1 << (fit.bit_length() - 1)
        if not fit:
            return out
        n = fit.bit_length() - 1
        out[n] = out.get(n, 0) + 1
        gap -= n
    return out


def used_up(counts: dict[int, int], capacity: int, whole: bool) -> list[tuple[Pattern, float]]:
    """Patterns, longest pieces first, each as often as its scarcest length allows, until all are covered.

    Not `whole`: by fractions, so that each pattern uses up a length and the patterns are a basis.
    """
    left: dict[int, float] = {n: c for n, c in counts.items() if c > 0}
    there = sum(1 << n for n in left)
    mirror = sum(1 << (capacity - n) for n in left)
    out = []
    while left:
        # a fraction of a piece that is left counts as one to find a pattern
        own = exact({n: int(c) if whole else max(1, int(c)) for n, c in left.items()}, there.bit_length() - 1, capacity, there, mirror)
        times = min(left[n] // k if whole else left[n] / k for n, k in own.items())
        for n, k in own.items():
            left[n] -= times * k
            if left[n] <= 1e-9:
                del left[n]
                there ^= 1 << n
                mirror ^= 1 << (capacity - n)
        out.append((own, times))
    return out


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The worthiest pattern (indices of ascending lengths to how many), lengths as often as they fit."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w, k in enumerate(np.searchsorted(lengths, np.arange(capacity + 1), side="right")):
        if k:
            worth = best[w - lengths[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[w - 1]:
                best[w], last[w] = worth[i], i
            else:
                best[w] = best[w - 1]
    own: dict[int, int] = {}
    w = capacity
    while w > 0:
        if (i := int(last[w])) < 0:
            w -= 1
        else:
            own[i] = own.get(i, 0) + 1
            w -= int(lengths[i])
    return float(best[capacity]), own


def program(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Pattern, float]]:
    """Patterns and how often each is used, by column generation from the basis of `used_up`: the fewest sequences."""
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0))
    if not len(lengths):
        return []
    at = {int(n): i for i, n in enumerate(lengths)}
    basis, size = used_up(counts, capacity, whole=False), len(lengths)
    # a pattern that used up several lengths stands for one; the others have columns of their own, used 0 times
    left, rows = set(at), {}
    held = {n: float(counts[n]) for n in at}
    for own, times in basis:
        for n, k in own.items():
            held[n] -= times * k
        gone = [n for n in own if n in left and held[n] <= 1e-9]
        rows[gone[0]] = (own, times)
        rows.update((n, ({n: 1}, 0.0)) for n in gone[1:])
        left -= set(gone)
    columns = [rows[int(n)][0] for n in lengths]
    x = np.array([rows[int(n)][1] for n in lengths])
    matrix = np.zeros((size, size))
    for j, own in enumerate(columns):
        for n, k in own.items():
            matrix[at[n], j] = k
    inverse = np.linalg.inv(matrix)
    need = sum(n * c for n, c in counts.items()) / capacity
    for _ in range(rounds):
        if x.sum() <= need * (1 + TOLERANCE):
            break
        duals = inverse.sum(axis=0)
        worth, own = knapsack(lengths, duals, capacity)
        if worth <= 1 + 1e-9:
            break
        idx, k = np.fromiter(own, np.int64), np.fromiter(own.values(), float)
        change = inverse[:, idx] @ k
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * change, 0)
        x[out] = ratio[out]
        row = inverse[out] / change[out]
        change[out] = 0
        inverse -= np.outer(change, row)
        inverse[out] = row
        columns[out] = {int(lengths[i]): n for i, n in own.items()}
    return list(zip(columns, x.tolist(), strict=True))


class Plan:
    """Whole patterns with counts, the stream of pieces to cut, and where each slot is."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS):
        self.capacity = capacity
        chosen = [[own, int(times + 1e-6)] for own, times in program(counts, capacity, rounds)]
        left = dict(counts)
        for pattern in chosen:
            own = pattern[0]
            pattern[1] = min([pattern[1], *(left[n] // k for n, k in own.items())])
            for n, k in own.items():
                left[n] -= k * pattern[1]
        chosen += [[own, int(times)] for own, times in used_up(left, capacity, whole=True)]
        chosen = [p for p in chosen if p[1] > 0]
        # the widest gaps are given up until their pieces fill the others'
        gap = lambda own: capacity - sum(n * k for n, k in own.items())
        chosen.sort(key=lambda p: -gap(p[0]))
        gaps, stream, given = sum(gap(own) * times for own, times in chosen), 0, {}
        for pattern in chosen:
            own, g = pattern[0], gap(pattern[0])
            if gaps <= stream:
                break
            # a copy given up brings its tokens and takes its gap away: together one capacity
            n = min(pattern[1], -((stream - gaps) // capacity))
            pattern[1] -= n
            stream, gaps = stream + n * (capacity - g), gaps - n * g
            for length, k in own.items():
                given[length] = given.get(length, 0) + n * k
        self.patterns: list[tuple[Pattern, int]] = [(own, times) for own, times in chosen if times]
        self.total = stream
        # slots of each length, pattern after pattern: first rank, copies a sequence, first sequence, first offset
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        first, at = 0, 0
        #: (place in the stream, gap, copies, first sequence, offset) of patterns with gaps
        self.gaps: list[tuple[int, int, int, int, int]] = []
        for own, times in self.patterns:
            offset = 0
            for n, k in sorted(own.items(), reverse=True):
                slots.setdefault(n, []).append((ranks.get(n, 0), k, first, offset))
                ranks[n] = ranks.get(n, 0) + k * times
                offset += n * k
            if (g := capacity - offset) > 0:
                self.gaps.append((at, g, times, first, offset))
                at += g * times
            first += times
        self.filled, self.next = min(at, stream), first
        self.slots = {n: np.array(s, np.int64) for n, s in slots.items()}
        self.whole = ranks
        self.begin, at = {}, 0
        for n in sorted(given):
            self.begin[n] = at
            at += n * given[n]

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces of this length by rank; sequence -1 where the piece is of the stream, offset its
        place there."""
        ranks = np.asarray(ranks, np.int64)
        whole = self.whole.get(length, 0)
        seq, off = np.full(len(ranks), -1, np.int64), np.zeros(len(ranks), np.int64)
        own = ranks < whole
        if own.any():
            s = self.slots[length]
            i = np.searchsorted(s[:, 0], ranks[own], side="right") - 1
            nth = ranks[own] - s[i, 0]
            seq[own], off[own] = s[i, 2] + nth // s[i, 1], s[i, 3] + nth % s[i, 1] * length
        off[~own] = self.begin.get(length, 0) + (ranks[~own] - whole) * length
        return seq, off

    def cuts(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of what a piece of the stream is cut into."""
        out, done = [], 0
        while done < length:
            p = at + done
            if p < self.filled:
                own = max(g for g in self.gaps if g[0] <= p)
                nth, into = divmod(p - own[0], own[1])
                n, seq, off = own[1] - into, own[3] + nth, own[4] + into
            else:
                nth, into = divmod(p - self.filled, self.capacity)
                seq, size, begin = self.next + nth, self.capacity, 0
                rest = self.total - self.filled - nth * self.capacity
                if rest < self.capacity:  # the last: a sequence for each of its powers of two, the greatest first
                    seq = self.next + nth
                    for bit in range(rest.bit_length() - 1, -1, -1):
                        if rest >> bit & 1:
                            if into < begin + (1 << bit):
                                size = 1 << bit
                                break
                            begin += 1 << bit
                            seq += 1
                n, off = begin + size - into, into - begin
            n = min(n, length - done)
            out.append((done, n, seq, off))
            done += n
        return out


# Packing ------------------------------------------------------------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, rank long, ids binary"
NAMES = [f.split()[0] for f in PIECES.split(", ")]
KINDS = [pa.int64()] * 8 + [pa.binary()]
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Sequences that one document fills have numbers from here.
FULL = 1 << 62


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of every document; `rank` counts the task's pieces of that length, `ids` are kept where they may be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, part, nth = kept(("cutting", path), lambda: Tokens(path)), TaskContext.get().partitionId(), 0
        ranks = [0] * (capacity + 1)
        for b in batches:
            for own in by_size(b, "text"):
                rows = []
                for doc, ids in zip(own.column("doc_id").to_pylist(), make.ids(own.column("text").to_pylist()), strict=True):
                    total = len(ids) // 4
                    for at in range(0, total, capacity):
                        piece = ids[4 * at : 4 * (at + capacity)]
                        n = len(piece) // 4
                        rows.append((doc, at, n, zlib.crc32(piece), total, part, nth, ranks[n], piece if n < capacity else None))
                        ranks[n] += 1
                        nth += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """OUT for every piece; the pieces' tokens stay in the shared folder, which the result reads."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/cutting-{uuid.uuid4().hex}"
    pieces(docs, path, capacity).write.parquet(folder)
    made = spark.read.parquet(folder)
    short = made.filter(F.col("length") < capacity)
    held = short.groupBy("part", "length").agg(F.count("*").alias("n"))
    plan = Plan({r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, rounds)
    shared = spark.sparkContext.broadcast(plan)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = short.select(*(c for c in NAMES if c != "ids")).join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).select(*(c for c in NAMES if c != "ids"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(own):
                    seq[own], off[own] = shared.value.place(int(lengths[own[0]]), ranks[own])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [*OUT[:5], "part", "nth"]] + [pa.array(seq), pa.array(off)], [*OUT[:5], "part", "nth", "sequence_id", "offset"])

    placed = ranked.mapInArrow(assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, sequence_id long, offset long")
    whole = placed.filter("sequence_id >= 0").select(*OUT)
    full = made.filter(F.col("length") == capacity).select(*OUT[:5], (F.lit(FULL) + F.shiftleft("part", 33) + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not plan.total:
        return whole.unionByName(full)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, start, length, total, at, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "offset", "ids")), strict=True):
                for lo, n, seq, off in shared.value.cuts(at, length):
                    rows.append((doc, start + lo, n, zlib.crc32(ids[4 * lo : 4 * (lo + n)]), total, seq, off))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(OUT))], OUT)

    given = placed.filter("sequence_id < 0").select("part", "nth", "offset")
    few = sum(times for times in _given(plan)) <= FEW_CUTS
    fetched = made.select(*NAMES).join(F.broadcast(given) if few else given, ["part", "nth"])
    return whole.unionByName(full).unionByName(fetched.select("doc_id", "start", "length", "doc_tokens", "offset", "ids").mapInArrow(cut_up, ", ".join(f"{c} long" for c in OUT)))


def _given(plan: Plan) -> list[int]:
    """Pieces of each length in the stream."""
    ends = [*list(plan.begin.values())[1:], plan.total]
    return [(end - at) // n for (n, at), end in zip(plan.begin.items(), ends, strict=True)]
