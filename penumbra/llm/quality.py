"""Quality: a sparse ensemble of rules over statistics of a text.

One pass over each whole text gives its statistics. On a bounded sample of labelled documents shallow trees are
boosted, every path from a root becomes a rule (a conjunction of thresholds), and a lasso logistic regression keeps few
of them. The kept rules are compiled into one Spark column expression over the statistics, which Catalyst plans like
any other; there is no shuffle.

Cases: null and empty texts have zero statistics and are scored by the same rules; equal texts score equally, and rows
that repeat are scored each; a very long text is read whole, by itself; where the labels seen are all alike, every
document gets that label's smoothed rate (0.5 without labels); null labels are not used; of a document's several labels
the smallest counts, and of an id's several texts the greatest is fitted on; further columns stay as they are, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, forget, sampled

#: Labelled documents fitted on, at most: those whose ids have the smallest hashes.
TRAIN_DOCS = 8000
#: Bytes of their texts together, at most; their statistics are what the driver gets.
TRAIN_BYTES = 256_000_000
TREES, DEPTH, BINS, LEAST, SHRINK, PART = 40, 3, 48, 8, 0.3, 0.7
PENALTIES = (0.03, 0.01, 0.004, 0.0015)
SEED = 11
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", b" \t\r\v\f", b"\n"), 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 10
STATS = ["n_chars", "n_words", "word_length", "longest_word", "upper", "digit", "stop", "shout", "pipe", "sign", "high", "shouting_words", "signed_words", "distinct_words", "top_word", "repeats", "distinct_pairs", "distinct_lines", "line_words", "capital_words", "ended_lines"]


def statistics(text: str | None) -> list[float]:
    """The numbers of STATS: shares of bytes, of words, of pairs of words and of lines; 0 where there is none."""
    raw = (text or "").encode("utf-8", "replace")
    own = raw.split()
    if not own:
        return [float(len(text or ""))] + [0.0] * (len(STATS) - 1)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11)
    n, size = len(own), len(raw)
    letters = max(1, int(kinds[1] + kinds[2] + kinds[10]))
    seen = Counter(own)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = max(1, n - 1)
    return [
        float(len(text)), float(n), sum(map(len, own)) / n, float(max(map(len, own))), kinds[1] / letters, kinds[3] / size, kinds[4] / size, kinds[5] / size, kinds[6] / size,
        kinds[7] / size, kinds[10] / size, (kinds[5] / n), (kinds[7] / n), len(seen) / n, max(seen.values()) / n, sum(map(eq, own, own[1:])) / pairs,
        len(set(zip(own, own[1:]))) / pairs, len(set(lines)) / len(lines), n / len(lines), sum(map(bytes.istitle, seen)) / len(seen), sum(x.rstrip().endswith((b".", b"?", b"!")) for x in lines) / len(lines),
    ]


def own_name(docs: DataFrame) -> str:
    """A column name that docs do not have."""
    name = "statistics"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def measured(docs: DataFrame, name: str) -> DataFrame:
    """The rows with the statistics of their texts as a struct column `name`; each text moves once, without a shuffle."""
    at = docs.columns.index("text")
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for b in by_size(batch, at):
                made = np.array([statistics(t.as_py()) for t in b.column(at)], float).reshape(-1, len(STATS))
                stats = pa.StructArray.from_arrays([pa.array(made[:, i]) for i in range(len(STATS))], STATS)
                yield pa.RecordBatch.from_arrays([*b.columns, stats], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, kind)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether it is over, threshold)


def grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, features: np.ndarray) -> tuple[list[tuple[Rule, float]], list[Rule]]:
    """(leaves with their steps, all paths) of one tree on the histogram of gradients."""
    leaves, paths = [], []

    def split(rows: np.ndarray, path: Rule) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAST:
            for f in features:
                n = len(cuts[f]) + 1
                count = np.cumsum(np.bincount(codes[rows, f], minlength=n))[:-1]
                gl = np.cumsum(np.bincount(codes[rows, f], grad[rows], n))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, f], hess[rows], n))[:-1]
                fit = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                fit[(count < LEAST) | (len(rows) - count < LEAST)] = -1
                if len(fit) and fit.max() > best[0]:
                    best = (fit.max(), (f, int(fit.argmax())))
        if best[1] is None:
            leaves.append((path, -g / (h + 1)))
            return
        f, k = best[1]
        over = codes[rows, f] > k
        for side in (False, True):
            to = (*path, (int(f), side, float(cuts[f][k])))
            paths.append(to)
            split(rows[over == side], to)

    split(rows, ())
    return leaves, paths


def tidy(rule: Rule) -> Rule:
    """Without thresholds that others imply."""
    tight: dict[tuple[int, bool], float] = {}
    for f, over, t in rule:
        k = (f, over)
        tight[k] = t if k not in tight else (max if over else min)(tight[k], t)
    return tuple(sorted((f, over, t) for (f, over), t in tight.items()))


def applies(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, over, t in rule:
        out &= (x[:, f] > t) == over
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and constant of an L1-penalized logistic regression, by accelerated proximal steps."""
    mean, sd = r.mean(0), np.maximum(r.std(0), 1e-3)
    s = (r - mean) / sd
    step = 4.0 / max(1e-9, np.linalg.norm(s, 2) ** 2 / len(y) + 1)
    w = v = np.zeros(s.shape[1])
    b = c = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(rounds):
        err = 0.5 * np.tanh(0.5 * (s @ v + c)) + 0.5 - y
        to = v - step * (s.T @ err / len(y))
        w2, b2 = np.sign(to) * np.maximum(0, np.abs(to) - step * penalty), c - step * err.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w / sd, b - float((w * mean / sd).sum())


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with weights, constant); the same for the same rows."""
    x, y = np.asarray(x, float).reshape(-1, len(STATS)), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(rate / (1 - rate)))
    r = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        cuts.append(q[q < x[:, f].max()])
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    logit, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    usable = np.array([f for f in range(x.shape[1]) if len(cuts[f])])
    for _ in range(TREES):
        p = 0.5 * np.tanh(0.5 * logit) + 0.5
        rows = np.sort(r.permutation(len(y))[: max(2 * LEAST, int(PART * len(y)))])
        some = np.sort(r.choice(usable, max(1, int(PART * len(usable))), replace=False)) if len(usable) else usable
        leaves, paths = grow(x, codes, cuts, p - y, p * (1 - p), rows, some)
        for rule, value in leaves:
            logit[applies(rule, x)] += SHRINK * value
        found |= dict.fromkeys(map(tidy, paths))
    seen: dict[bytes, Rule] = {}
    for rule in sorted(found, key=lambda k: (len(k), k)):
        mark = applies(rule, x)
        if 0 < mark.sum() < len(y):
            seen.setdefault(min(np.packbits(mark).tobytes(), np.packbits(~mark).tobytes()), rule)
    rules = list(seen.values())
    if not rules:
        return [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    marks = np.stack([applies(k, x) for k in rules], 1).astype(float)
    part = r.permutation(len(y)) % 4 == 0
    loss = {}
    if 0 < y[~part].mean() < 1 and part.any():
        for penalty in PENALTIES:
            w, b = lasso(marks[~part], y[~part], penalty, 250)
            z = marks[part] @ w + b
            loss[penalty] = float(np.mean(np.logaddexp(0, z) - y[part] * z))
    w, b = lasso(marks, y, min(loss, key=loss.get) if loss else PENALTIES[1])
    return [(k, float(v)) for k, v in zip(rules, w, strict=True) if abs(v) > 1e-4], b


def compiled(model: tuple[list[tuple[Rule, float]], float], stats: Column) -> Column:
    """The model as a column expression over the struct of statistics."""
    rules, constant = model
    total = F.lit(constant)
    for rule, weight in rules:
        test = F.lit(True)
        for f, over, t in rule:
            test = test & (stats[STATS[f]] > t if over else stats[STATS[f]] <= t)
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, usable, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES):
    """A model from at most `most` labelled documents that `usable` (a Column of doc_id) admits."""
    rows = measured(sampled(docs, labels, "quality", usable, most, most_bytes, F.min), "statistics").select("doc_id", "label", "statistics.*").collect()
    made = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 2 + len(STATS))
    return train(made[:, 2:], (made[:, 1] > 0).astype(float))


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score): the probability of label 1."""
    return measured(docs.select("doc_id", "text"), "statistics").select("doc_id", compiled(model, F.col("statistics")).alias("score"))


def kept_good(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns; texts are not shuffled."""
    name = own_name(docs)
    return measured(docs, name).filter(compiled(model, F.col(name)) >= threshold).drop(name)
