"""Best-two-fit packing of tokenized documents into sequences.

Documents are tokenized, closed by an end id and cut only where they exceed a sequence. Pieces are dealt to groups by
a hash, so that no source, copy or id gathers in one, and each group is packed by itself: every sequence takes the
longest piece left, then greedily the longest that fits; while a gap remains, the sequence's smallest piece is
swapped for two unpacked pieces that together fill the widened gap more, also where it is the only one. Only lengths
decide; a group holds lengths and places, never texts. A group ends with one part-filled sequence at most beyond what its
lengths force.

Cases: a null or empty text is one piece of one end id; equal rows are packed each; a very long text is tokenized by
itself and cut into pieces; null ids stay null; further columns are ignored; an empty table packs into none; lengths below
1 or above the capacity are an error.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, kept

CAPACITY = 2048
END = 0
#: Documents a group gets, about; their pieces' lengths are what it holds.
GROUP_ROWS = 25_000
#: Distinct chunks of text, and words in them, whose ids a worker keeps at once: about 300 MB.
CACHE_CHUNKS, CACHE_WORDS = 400_000, 800_000
#: A character that is a word of its own and hardly occurs in texts.
MARK = "\x01"
#: Chunks whose lower case and words need no Unicode tables: printable ASCII and the letters of Latin-1.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
#: The vocabulary's words within plain lower-case chunks (a fixed pattern of the vocabulary), and the ends of lines.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+").findall
#: Stands for a line's end among ids, each of which has zeros in its upper bytes.
LINE = b"\xff" * 4


#: Texts on which the way by chunks and words must give the library's ids before it is used.
PROBES = (
    "The quick brown-fox didn't jump (over) 1,234.56 dogs; they've said: 'we'll see', it's I'm.",
    "ÉLAN naïve café Straße Ærø ÿ ß ×÷ µ\u00a0x\tTAB\r\nline  two   spaces\n\n\nend ",
    " leading and trailing  \u3000 ideographic 日本語のテキスト mixed한국어 and ﬁ ligature İstanbul ŞİŞ",
    "http://a.b/c?d=e&f=g#h user@example.com {json: [1, 2, null]} <|endoftext|> <b>x</b> a_b __init__ $100 50% C++",
    "emoji 😀👍 zero\u200bwidth combining e\u0301 Ωμέγα Привет мир 're ''ve 'S don'T THEY'RE",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa 0123456789012345678901234567890 ............... \x01 \x7f",
    "",
    " ",
    "\n",
)


class Tokenizing:
    """Ids of whole texts as little-endian bytes, from those of chunks between white space and of the words in them.

    No token of this kind of vocabulary spans white space or two of its words, so each distinct one is encoded once.
    Chunks of plain characters are split here; any other goes to the library whole. Whether a vocabulary is of this kind
    is tried on PROBES; texts of any other go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder, self.known, self.words = Tokenizer.from_file(path), {}, {}
        mark = self.encoder.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.by_words = True
        whole = [as_bytes([*e.ids, END]) for e in self.encoder.encode_batch(list(PROBES), add_special_tokens=False)]
        self.by_words = [i.tobytes() for i in self.ids(list(PROBES))] == whole

    def _encode(self, new: list[str]) -> list[bytes]:
        """The ids of each string; many are encoded as one text, with marks between them."""
        fast = getattr(self.encoder, "encode_batch_fast", self.encoder.encode_batch)
        if self.mark is None or any(MARK in w for w in new):
            return [as_bytes(e.ids) for e in fast(new, add_special_tokens=False)]
        out: list[bytes] = []
        for lo in range(0, len(new), 4000):
            ids = np.array(fast([f" {MARK} ".join(new[lo : lo + 4000])], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends, strict=False)]
        return out

    def _learn(self, new: list[str]) -> None:
        known, words = self.known, self.words
        plain = [c for c in new if PLAIN(c) and "<|" not in c]
        if plain:
            # all chunks as one text: a line a chunk, whose ends become a mark that no id's bytes hold
            parts = SPLIT("\n".join(plain).lower())
            words["\n"] = LINE
            if fresh := [w for w in set(parts) if w not in words]:
                words.update(zip(fresh, self._encode(fresh), strict=True))
            known.update(zip(plain, b"".join(map(words.__getitem__, parts)).split(LINE), strict=True))
        if len(plain) < len(new):
            other = [c for c in new if c not in known]
            known.update(zip(other, (as_bytes(e.ids) for e in self.encoder.encode_batch(other, add_special_tokens=False)), strict=True))

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        if not self.by_words:
            for e in self.encoder.encode_batch([t or "" for t in texts], add_special_tokens=False):
                yield np.array([*e.ids, END], "<u4")
            return
        # space, tab, line feed, carriage return: white space to such a vocabulary's patterns
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if new := [c for c in set(chain.from_iterable(split)) if c not in known]:
            self._learn(new)
        end = as_bytes([END])
        for chunks in split:
            yield np.frombuffer(b"".join(map(known.__getitem__, chunks)) + end, "<u4")


def warm(path: str) -> Tokenizing:
    """What a worker process has encoded so far, over all its tasks."""
    return kept(("packing", path), lambda: Tokenizing(path))


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, nth[, ids]) for each piece; nth counts within the task."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, nth = warm(path), 0
        for b in batches:
            for part in by_size(b, "text"):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), make.ids(part.column("text").to_pylist()), strict=True):
                    for i, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at : at + capacity]
                        rows.append((doc, i, at, len(own), zlib.crc32(own.tobytes()), nth) + ((own.astype(np.int64),) if with_ids else ()))
                        nth += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long" + ", ids array<long>" * with_ids)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. Lengths that are there are bits of one integer, so the longest that fits and the
    pairs of a given sum are each a few operations on it."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must be 1 to {capacity}")
    left = np.bincount(lengths, minlength=capacity + 1).tolist()
    there = sum(1 << n for n in range(capacity + 1) if left[n])
    mirror = sum(1 << (capacity - n) for n in range(capacity + 1) if left[n])

    def take(n: int) -> int:
        nonlocal there, mirror
        left[n] -= 1
        if not left[n]:
            there ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return n

    def give(n: int) -> None:
        nonlocal there, mirror
        if not left[n]:
            there |= 1 << n
            mirror |= 1 << (capacity - n)
        left[n] += 1

    def pair(most: int, above: int) -> tuple[int, int] | None:
        """Two lengths left with the largest sum up to `most` and over `above`."""
        for total in range(most, above, -1):
            both = there & (mirror >> (capacity - total)) & ((1 << total) - 1)
            if both:
                a = both.bit_length() - 1
                if 2 * a == total and left[a] < 2:
                    both ^= 1 << a
                    a = both.bit_length() - 1
                if a > 0:
                    return a, total - a
        return None

    bins: list[list[int]] = []
    while there:
        own = [take(there.bit_length() - 1)]
        gap = capacity - own[0]
        while gap and there:
            n = (there & ((2 << gap) - 1)).bit_length() - 1
            if n > 0:
                own.append(take(n))
                gap -= n
                continue
            least = min(range(len(own)), key=own.__getitem__)
            if (two := pair(gap + own[least], own[least])) is None:
                break
            out = own.pop(least)
            own += [take(two[0]), take(two[1])]
            give(out)
            gap += out - sum(two)
        bins.append(own)
    order = np.argsort(lengths, kind="stable")
    sizes = np.fromiter(chain.from_iterable(bins), np.int64, len(lengths))
    count = np.fromiter(map(len, bins), np.int64, len(bins))
    which = np.repeat(np.arange(len(bins)), count)
    ends = np.cumsum(sizes)
    offset = ends - sizes
    first = np.r_[0, np.cumsum(count)[:-1]] if len(bins) else np.empty(0, np.int64)
    offset = offset - np.repeat(offset[first], count) if len(bins) else offset
    slots = np.argsort(sizes, kind="stable")
    bin_of, offset_of = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bin_of[order], offset_of[order] = which[slots], offset[slots]
    return bin_of, offset_of


def packed(cut_up: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset in place of nth; any further columns of `pieces` stay."""
    kept = [c for c in cut_up.columns if c != "nth"]
    dealt = cut_up.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth"), F.lit(groups))).drop("nth")
    out = T.StructType([*(f for f in cut_up.schema if f.name != "nth"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def group(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        which, offset = best_two_fit(f["length"].to_numpy(), capacity)
        return f[kept].assign(sequence_id=(int(key[0]) << 32) + which, offset=offset)

    return dealt.groupBy("g").applyInPandas(group, out)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Tokenize and pack every document: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return packed(pieces(docs, path, capacity, with_ids), max(1, docs.count() // group_rows), capacity)
