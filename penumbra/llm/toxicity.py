"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows of words.

Each word enters as a word (label statistics and a hashed embedding) and as characters (label statistics and
embeddings of its beginnings and endings; characters between the first five and the last four are not read, and what
white space does not part is one word). A window of 32 words is read in both directions, pooled by attention and
scored; windows start every 16 words, so every word but a text's first and last few is read in two, and a text's last
window ends with its last word's window. A document's probability follows from its highest window, the number of
windows above zero and its length, by a logistic calibration. Everything is trained in numpy on the driver from a
bounded sample of labelled documents (`TRAIN_DOCS`, `TRAIN_BYTES`), of each of which at most `BAG` windows train the
network: those with the most evidence and one more; the calibration sees all windows. While training, a document's label
statistics come from other parts of the sample. Grams without evidence are dropped before anything is trained, so
training and scoring read the same features.

What a word adds to either direction's gates depends on the word alone and is kept, so a window costs only its
recurrent products. Scoring is one pass over each whole text, without a shuffle.

Cases: null and empty texts have no window and get the score of a text without evidence; texts without labelled
documents of both kinds get the prior of the labels seen (0 if none); equal texts score equally; null labels are not
used; of a document's several labels the largest counts, and of an id's several texts the greatest is fitted on; rows
that repeat are scored each; a very long text is read whole, by itself; further columns stay as they are; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, kept, sampled

#: Labelled documents fitted on, at most: those whose ids have the smallest hashes.
TRAIN_DOCS = 6000
#: Bytes of their texts together, at most.
TRAIN_BYTES = 48_000_000
WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, BUCKETS, ATTEND = 8, 4, 1024, 8
STEPS, BATCH, RATE = 260, 64, 0.008
#: Windows of a document that train the network, at most.
BAG = 6
SEED = 7
#: Weight decay of the embeddings and of the other weights.
DECAY_EMBED, DECAY = 0.5, 0.02
#: Evidence over which a word is known by itself.
KNOWN = 0.3
#: Numbers kept for a word: both directions' gate inputs and its statistics.
WIDTH = 6 * HIDDEN + 3
#: Documents a gram must be in to be evidence; parts of the sample, each read with the others' evidence.
LEAST, FOLDS = 3, 5
#: Distinct chunks of text whose gate inputs a worker keeps (about 100 MB); windows scored at once.
CACHE_CHUNKS, BLOCK = 250_000, 4096
THRESHOLD = 0.5
_LETTERS = re.compile(r"[\W_]+")


def bare(chunk: str) -> str:
    """The word without case and signs."""
    w = chunk.lower()
    return w if w.isalpha() else _LETTERS.sub("", w)


def affixes(begin: str, end: str) -> list[str]:
    """Beginnings (^) and endings ($) of a word, from its first five and last four characters."""
    return [*("^" + begin[:k] for k in (3, 4, 5) if len(begin) >= k), *("$" + end[-k:] for k in (3, 4) if len(end) >= k)]


def starts(n: int) -> range:
    """Where the windows of a text of n words begin; the last reaches its end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """How many documents of either label hold each gram: a word itself (=) or an affix.

    A word counts as known if its evidence is over KNOWN; all others differ only by their affixes.
    """

    def __init__(self, ids: dict[str, int], counts: np.ndarray, n: tuple[int, int]):
        self.ids, self.counts, self.n = ids, counts, n  # the last row of counts is for grams not seen
        self.buckets = np.array([*map(self.bucket, ids), 0], np.int32)

    def evidence(self, c: np.ndarray) -> np.ndarray:
        """Log odds of label 1 from counts (.., 2), drawn towards 0 where counts are low."""
        total = c.sum(-1)
        odds = np.log((c[..., 1] + 0.5) / (self.n[1] + 1)) - np.log((c[..., 0] + 0.5) / (self.n[0] + 1))
        return np.where(total >= LEAST, np.clip(odds * total / (total + 4), -4, 6), 0.0)

    def bucket(self, gram: str) -> int:
        return 1 + zlib.crc32(gram.encode()) % (BUCKETS - 1)

    def statistics(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(evidence of the word, most and mean of its affixes) of words given as grams (word first, -1 for none)."""
        e = self.evidence(counts)[grams] * (grams >= 0)
        there = grams[:, 1:] >= 0
        top = np.where(there.any(1), np.where(there, e[:, 1:], -9).max(1), 0.0)
        word = np.where(np.abs(e[:, 0]) > KNOWN, e[:, 0], 0.0)
        return np.stack([word, top, e[:, 1:].sum(1) / np.maximum(1, there.sum(1))], 1)

    def strong(self) -> np.ndarray:
        """Marks of the grams whose evidence is over KNOWN; only they are kept."""
        return np.abs(self.evidence(self.counts[:-1])) > KNOWN


class Network:
    """Weights and passes. Gates are in the order update, reset, new; `d` is 0 forward, 1 backward."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        size = 3 + 2 * EMBED
        small = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.w = {"word": r.normal(0, 0.1, (BUCKETS, EMBED)), "char": r.normal(0, 0.1, (BUCKETS, EMBED)), "A": small(2 * HIDDEN + 3, ATTEND), "v": small(ATTEND), "o": small(2 * HIDDEN + 3), "c": np.zeros(1)}
        for d in "01":
            self.w |= {"W" + d: small(size, 3 * HIDDEN), "U" + d: small(HIDDEN, 3 * HIDDEN), "b" + d: np.zeros(3 * HIDDEN)}

    def vectors(self, stats: np.ndarray, word: np.ndarray, char: np.ndarray) -> np.ndarray:
        there = (char > 0)[..., None]
        mean = (self.w["char"][char] * there).sum(1) / np.maximum(1, there.sum(1))
        return np.concatenate([stats, self.w["word"][word] * (word > 0)[:, None], mean], 1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to both directions' gates, then their statistics, which attention also sees."""
        return np.concatenate([*(x @ self.w["W" + d] + self.w["b" + d] for d in "01"), x[:, :3]], 1)

    def forward(self, g: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows from gate inputs (windows, words, gates) and marks of words that are there; and a trace."""
        n, steps, _ = g.shape
        hs = np.zeros((2, n, steps, HIDDEN), g.dtype)
        trace = {"g": g, "mask": mask, "hs": hs, "steps": ([], [])}
        for d in (0, 1):
            h, u = np.zeros((n, HIDDEN), g.dtype), self.w["U%d" % d].astype(g.dtype)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a, q = g[:, t, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN], h @ u
                zr = sigmoid(a[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(a[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
                trace["steps"][d].append((t, h, z, r, new, q[:, 2 * HIDDEN :]))
                m = mask[:, t : t + 1]
                h = np.where(m, new + z * (h - new), h)
                hs[d, :, t] = h
        both = np.concatenate([hs[0], hs[1], g[:, :, 6 * HIDDEN :]], 2)
        e = np.tanh(both @ self.w["A"].astype(g.dtype))
        s = np.where(mask, e @ self.w["v"].astype(g.dtype), -1e9)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        pooled = (p[:, :, None] * both).sum(1)
        trace |= {"both": both, "e": e, "p": p, "pooled": pooled}
        return pooled @ self.w["o"].astype(g.dtype) + g.dtype.type(self.w["c"][0]), trace

    def backward(self, dlogit: np.ndarray, trace: dict) -> tuple[dict, np.ndarray]:
        """Gradients of the weights above the gates' inputs, and of those inputs."""
        both, e, p, mask, g = (trace[k] for k in ("both", "e", "p", "mask", "g"))
        grad = {"o": trace["pooled"].T @ dlogit, "c": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * self.w["o"]
        dp = (dpool[:, None, :] * both).sum(2)
        ds = p * (dp - (p * dp).sum(1, keepdims=True))
        de = ds[:, :, None] * self.w["v"] * (1 - e * e)
        grad["v"] = np.einsum("nt,nta->a", ds, e)
        grad["A"] = np.einsum("nth,nta->ha", both, de)
        dboth = p[:, :, None] * dpool[:, None, :] + de @ self.w["A"].T
        dg = np.zeros_like(g)
        for d in (0, 1):
            u, du, dh = self.w["U%d" % d], np.zeros((HIDDEN, 3 * HIDDEN)), 0.0
            for t, h, z, r, new, q in reversed(trace["steps"][d]):
                dh = dh + dboth[:, t, d * HIDDEN : (d + 1) * HIDDEN]
                m = mask[:, t : t + 1]
                dnew = dh * (1 - z) * (1 - new * new) * m
                dz = dh * (h - new) * z * (1 - z) * m
                dr = dnew * q * r * (1 - r)
                dq = np.concatenate([dz, dr, dnew * r], 1)
                du += h.T @ dq
                dg[:, t, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN] = np.concatenate([dz, dr, dnew], 1)
                dh = np.where(m, dh * z, dh) + dq @ u.T
            grad["U%d" % d] = du
        return grad, dg


class Model:
    """What scores documents: statistics, network, calibration (or a constant where nothing could be learned)."""

    def __init__(self, words: Words | None, net: Network | None, calibration: np.ndarray | None, prior: float):
        self.words, self.net, self.calibration, self.prior = words, net, calibration, prior
        self.name = uuid.uuid4().hex

    def probability(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ self.calibration[:-1] + self.calibration[-1])


def summary(logits: np.ndarray) -> list[float]:
    """A document's features: highest window, mean of the three highest, windows above 0 and about -2, windows."""
    if not len(logits):
        return [-6.0, -6.0, 0.0, 0.0, 0.0]
    z = np.clip(logits.astype(float), -6, 12)
    top = np.partition(z, len(z) - 3)[-3:] if len(z) > 3 else z
    return [float(z.max()), float(top.mean()), float(np.log1p((z > 0).sum())), float(np.log1p(sigmoid(z + 2).sum())), float(np.log1p(len(z)))]


class Scorer:
    """Scores texts in one task, keeping the gate inputs of chunks."""

    def __init__(self, model: Model):
        self.model = model
        if model.words:
            self.evidence = model.words.evidence(model.words.counts)
            self.whole = {g[1:]: i for g, i in model.words.ids.items() if g[0] == "="}
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # row of a chunk
        self.rows = np.zeros((4096, WIDTH), np.float32)
        self.ends: tuple[dict[str, int], dict[str, int]] = ({}, {})  # of first and of last characters
        # largest evidence, sum, number and summed embeddings of the affixes of each
        self.parts = [np.zeros((0, 3 + EMBED)), np.zeros((0, 3 + EMBED))]

    def _parts(self, side: int, texts: list[str]) -> np.ndarray:
        """Rows of self.parts for the first (side 0) or last (side 1) characters of words."""
        ids, words = self.ends[side], self.model.words
        if new := [t for t in set(texts) if t not in ids]:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            grams, buckets = np.full((len(new), 3), len(words.ids)), np.zeros((len(new), 3), int)
            for i, t in enumerate(new):
                for k, g in enumerate(affixes(t, "") if side == 0 else affixes("", t)):
                    grams[i, k], buckets[i, k] = words.ids.get(g, -1), words.bucket(g)
            there, e = buckets > 0, self.evidence[grams]
            top = np.where(there.any(1), np.where(there, e, -9).max(1), -9)
            made = np.concatenate([np.stack([top, (e * there).sum(1), there.sum(1)], 1), (self.model.net.w["char"][buckets] * there[..., None]).sum(1)], 1)
            self.parts[side] = np.concatenate([self.parts[side], made])
        return self.parts[side][np.fromiter(map(ids.__getitem__, texts), np.int64, len(texts))]

    def _learn(self, new: list[str]) -> None:
        words, net = self.model.words, self.model.net
        own = [bare(c) for c in new]
        whole = self.whole
        at = np.array([whole.get(w, -1) for w in own])
        e = np.where(at >= 0, self.evidence[at], 0.0)
        e[np.abs(e) <= KNOWN] = 0
        begin, end = self._parts(0, [w[:5] for w in own]), self._parts(1, [w[-4:] for w in own])
        many = begin[:, 2] + end[:, 2]
        x = np.zeros((len(new), 3 + 2 * EMBED))
        x[:, 0] = e
        x[:, 1] = np.where(many > 0, np.maximum(begin[:, 0], end[:, 0]), 0)
        x[:, 2] = (begin[:, 1] + end[:, 1]) / np.maximum(1, many)
        known = e != 0
        x[known, 3 : 3 + EMBED] = net.w["word"][words.buckets[at[known]]]
        x[:, 3 + EMBED :] = (begin[:, 3:] + end[:, 3:]) / np.maximum(1, many)[:, None]
        first = len(self.known)
        if first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(new), len(self.rows) // 2), WIDTH), np.float32)])
        self.rows[first : first + len(new)] = net.gates(x)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))

    def all_logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's window logits; windows of several texts are read together."""
        chunks = [(t or "").split() for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self._clear()
        known = self.known
        if new := [c for c in set(chain.from_iterable(chunks)) if c not in known]:
            self._learn(new)
        ids, marks, counts, span = [], [], [], np.arange(WINDOW)
        for own in chunks:
            row = np.fromiter(map(known.__getitem__, own), np.int32, len(own))
            at = np.array(starts(len(own)), np.int64)[:, None] + span
            counts.append(len(at))
            if len(at):
                there = at < len(own)
                marks.append(there)
                ids.append(np.where(there, row[np.minimum(at, len(own) - 1)], 0))
        logits = self._score(np.concatenate(ids), np.concatenate(marks)) if ids else np.empty(0, np.float32)
        ends = np.cumsum(counts)
        return [logits[b - n : b] for n, b in zip(counts, ends, strict=True)]

    def _score(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The forward pass without a trace, in blocks; gates are scaled so that each needs one tanh."""
        w = {k: v.astype(np.float32) for k, v in self.model.net.w.items() if k not in ("word", "char")}
        two, three, made = 2 * HIDDEN, 3 * HIDDEN, []
        for lo in range(0, len(ids), BLOCK):
            i, m = ids[lo : lo + BLOCK], mask[lo : lo + BLOCK]
            n, whole = len(i), bool(m.all())
            hs = np.empty((WINDOW, n, two + 3), np.float32)
            for t in range(WINDOW):
                hs[t, :, two:] = self.rows[i[:, t], 2 * three :]
            for d in (0, 1):
                h, u = np.zeros((n, HIDDEN), np.float32), w["U%d" % d]
                for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                    a, q = self.rows[i[:, t], d * three : (d + 1) * three], h @ u
                    zr = a[:, :two] + q[:, :two]
                    zr *= np.float32(0.5)
                    np.tanh(zr, out=zr)
                    zr *= np.float32(0.5)
                    zr += np.float32(0.5)
                    new = q[:, two:]
                    new *= zr[:, HIDDEN:]
                    new += a[:, two:]
                    np.tanh(new, out=new)
                    z = zr[:, :HIDDEN]
                    z *= h - new
                    z += new
                    h = z.copy() if whole else np.where(m[:, t : t + 1], z, h)
                    hs[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
            s = np.tanh(hs.reshape(-1, two + 3) @ w["A"]) @ w["v"]
            s = np.where(m.T, s.reshape(WINDOW, n), np.float32(-1e9))
            s = np.exp(s - s.max(0))
            s /= s.sum(0)
            made.append((hs @ w["o"] * s).sum(0) + w["c"][0])
        return np.concatenate(made)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.calibration is None:
            return np.full(len(texts), self.model.prior)
        out, lo, size = np.empty(len(texts)), 0, 0
        for hi, t in enumerate(texts):
            size += len(t or "")
            if size > 2_000_000 or hi + 1 == len(texts):
                out[lo : hi + 1] = self.model.probability(np.array([summary(x) for x in self.all_logits(texts[lo : hi + 1])]))
                lo, size = hi + 1, 0
        return out


def warm(model: Model) -> Scorer:
    """The scorer of a model that earlier tasks of this worker process have used, with what it keeps."""
    return kept(("toxicity", model.name), lambda: Scorer(model))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton steps."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        ridge = np.full(len(w), l2)
        ridge[-1] = 1e-6
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-9), x1.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(rows: list[tuple[str | None, int]], seed: int = SEED) -> Model:
    """A model from (text, label) pairs; the same for the same rows."""
    y = np.array([int(label > 0) for _, label in rows], int)
    n = (int((y == 0).sum()), int((y == 1).sum()))
    if min(n) == 0:
        return Model(None, None, None, float(n[1] > 0))
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(c, len(vocabulary)) for c in (t or "").split()], np.int32) for t, _ in rows]
    ids: dict[str, int] = {}
    grams = np.full((len(vocabulary), 6), -1, np.int32)
    vocabulary = [bare(c) for c in vocabulary]
    for i, w in enumerate(vocabulary):
        if w:
            own = ("=" + w, *affixes(w[:5], w[-4:]))
            grams[i, : len(own)] = [ids.setdefault(g, len(ids)) for g in own]
    del vocabulary
    # evidence for a document comes from the documents of the other folds
    fold = np.arange(len(docs)) % FOLDS
    part = np.zeros((FOLDS, len(ids) + 1, 2), np.int32)
    for doc, f, label in zip(docs, fold, y, strict=True):
        part[f, np.setdiff1d(grams[np.unique(doc)], [-1]), label] += 1
    whole = Words(ids, part.sum(0), n)
    buckets = whole.buckets[grams]
    buckets[grams < 0] = 0
    # grams without evidence go before training; words that have them see them as not seen
    strong = whole.strong()
    to = np.where(strong, np.cumsum(strong) - 1, strong.sum())
    grams = np.where(grams < 0, -1, to[grams]).astype(np.int32)
    part = part[:, [*np.flatnonzero(strong), len(ids)]]
    words = Words({g: int(to[i]) for g, i in ids.items() if strong[i]}, part.sum(0), n)
    del whole, ids
    net, r = Network(seed), np.random.default_rng(seed)
    stats = [words.statistics(grams, words.counts - part[f]).astype(np.float32) for f in range(FOLDS)]
    bags = []
    for own, f in zip(docs, fold, strict=True):
        at = np.array(starts(len(own)), int)
        if len(at) > BAG:  # those with the most evidence, and one more of any kind
            strong = np.array([stats[f][own[a : a + WINDOW]][:, :2].max(1).clip(0).sum() for a in at])
            top = np.argsort(-strong, kind="stable")[: BAG - 1]
            at = at[np.unique(np.r_[top, r.integers(len(at))])]
        bags.append(at)
    by = [np.flatnonzero((y == k) & (np.array([len(b) for b in bags]) > 0)) for k in (0, 1)]
    if min(map(len, by)) == 0:
        return Model(None, None, None, n[1] / sum(n))
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    for step in range(1, STEPS + 1):
        chosen = np.concatenate([r.choice(b, BATCH // 2) for b in by])
        which, spots, bag = [], [], []
        for j, i in enumerate(chosen):
            for a in bags[i]:
                piece = docs[i][a : a + WINDOW]
                which.append((fold[i], piece))
                spots.append(len(piece))
                bag.append(j)
        uniq: dict[tuple[int, int], int] = {}
        ix = np.zeros((len(which), WINDOW), int)
        for k, (f, piece) in enumerate(which):
            ix[k, : len(piece)] = [uniq.setdefault((int(f), int(p)), len(uniq)) for p in piece]
        mask = np.arange(WINDOW) < np.array(spots)[:, None]
        pick = np.array(list(uniq))
        s, char = np.stack([stats[f][w] for f, w in uniq]), buckets[pick[:, 1], 1:]
        word = np.where(s[:, 0] != 0, buckets[pick[:, 1], 0], 0)
        x = net.vectors(s, word, char)
        logit, trace = net.forward(net.gates(x)[ix], mask)
        bag = np.array(bag)
        top = np.full(len(chosen), -np.inf)
        np.maximum.at(top, bag, logit)
        part = np.exp(logit - top[bag])
        total = np.bincount(bag, part, len(chosen))
        whole = top + np.log(total)
        err = (sigmoid(whole) - y[chosen]) / len(chosen)
        grad, dg = net.backward(err[bag] * part / total[bag], trace)
        dgates = np.zeros((len(uniq), WIDTH))
        np.add.at(dgates, ix[mask], dg[mask])
        dx = np.zeros_like(x)
        for d in (0, 1):
            own = dgates[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN]
            grad["W%d" % d], grad["b%d" % d] = x.T @ own, own.sum(0)
            dx += own @ net.w["W%d" % d].T
        grad["word"], grad["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
        np.add.at(grad["word"], word[word > 0], dx[word > 0, 3 : 3 + EMBED])
        there = char > 0
        np.add.at(grad["char"], char[there], np.repeat(dx[:, 3 + EMBED :] / np.maximum(1, there.sum(1))[:, None], there.sum(1), 0))
        rate = RATE * (1 - step / (STEPS + 1))
        for k, v in net.w.items():
            one, two = moment[k]
            one += 0.1 * (grad[k] - one)
            two += 0.01 * (grad[k] ** 2 - two)
            v -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-8) + rate * (DECAY_EMBED if k in ("word", "char") else DECAY) * v
    model = Model(words, net, np.zeros(6), n[1] / sum(n))
    feats, scorer = np.zeros((len(docs), 5)), Scorer(model)
    scorer.rows = np.zeros((len(grams), WIDTH), np.float32)
    for f in range(FOLDS):
        for lo in range(0, len(grams), BLOCK):
            s, b = stats[f][lo : lo + BLOCK], buckets[lo : lo + BLOCK]
            scorer.rows[lo : lo + BLOCK] = net.gates(net.vectors(s, np.where(s[:, 0] != 0, b[:, 0], 0), b[:, 1:]))
        for i in np.flatnonzero(fold == f):
            at = np.array(starts(len(docs[i])), int)[:, None] + np.arange(WINDOW)
            there = at < len(docs[i])
            feats[i] = summary(scorer._score(np.where(there, docs[i][np.minimum(at, len(docs[i]) - 1)], 0), there) if len(at) else np.empty(0))
    model.calibration = logistic(feats, y, 1.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> Model:
    """A model from at most `most` labelled documents that `usable` (a Column of doc_id) admits."""
    rows = sampled(docs, labels, "toxic", usable, most, most_bytes).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([(r["text"], r["label"]) for r in rows])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the probability that a whole text is toxic; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = warm(model)
        for b in batches:
            for part in by_size(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(make.scores(part.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def kept_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; texts are not shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = warm(model)
        for b in batches:
            for part in by_size(b, at):
                yield part.filter(pa.array(make.scores(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
