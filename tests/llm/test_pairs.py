"""Fingerprints, SimHash groups, neighbours and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from penumbra.llm import bottomk, queries, simhash, vantage
from penumbra.llm.components import components

SMALL = "/root/testdata/sf0.001"

EDGE = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "Élan b c"), (10, "x " * 30000), (11, "a b c d e f g h"), (None, "a b c")]


def slow_fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))] if own else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_groups(prints):
    """Smallest id reachable over pairs of at most 3 bits."""
    ids, root = list(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op8_simhash_balls(spark, SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == slow_groups(prints)


def test_simhash_edges(docs_of):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(EDGE)).collect()}
    assert all(got[i]["fp"] == 0 and got[i]["component_id"] == 1 for i in (1, 2, 3))
    assert got[5]["fp"] == got[6]["fp"] and got[6]["component_id"] == 5
    assert got[8]["component_id"] == got[11]["component_id"] == 7
    assert simhash.near_duplicates(docs_of([])).count() == 0
    kept = simhash.deduplicated(docs_of(EDGE))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 7, 9, 10] and kept.columns == docs_of([]).columns


def test_every_pair_within_three_bits_is_linked(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            v = base
            for b in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << b
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), group_variants=50_000)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    want = slow_groups({v: v & (1 << 64) - 1 for v in signed})
    classes = {}
    for v in signed:
        classes.setdefault(want[v], set()).add(found.get(v, v))
    assert all(len(c) == 1 for c in classes.values())
    assert len({next(iter(c)) for c in classes.values()}) == len(classes)
    for r in edges.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 3


def near_copies_of(rng, families, copies):
    """Texts in families of edited copies, and pairs that share a passage of half their words only."""
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(base))
        for _ in range(copies):
            edited = list(base)
            for _ in range(max(1, len(base) // 60)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited).upper() if rng.random() < 0.2 else " ".join(edited))
    passage = [word() for _ in range(120)]
    texts += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(40)]) for _ in range(60)]
    return texts


def test_near_copies_against_brute_force(docs_of):
    texts = near_copies_of(random.Random(9), 60, 4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(list(enumerate(texts)))).collect()}
    sets = [slow_shingles(t.lower()) for t in texts]
    alike = [(i, j, len(a & b) / len(a | b)) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) / len(a | b) >= 0.5]
    near = [(i, j) for i, j, s in alike if s >= 0.8]
    assert len(near) > 250 and sum(got[i] == got[j] for i, j in near) >= 0.97 * len(near)
    reach = {i: i for i in range(len(texts))}
    for i, j, s in sorted(alike):
        if s >= 0.7:
            low, high = sorted((reach[i], reach[j]))
            reach = {k: low if r == high else r for k, r in reach.items()}
    assert all(reach[i] == reach[c] for i, c in got.items())
    assert all(got[i] == i for i in range(300, 360))


def test_near_copies_of_a_chain_and_a_hot_group():
    rng = np.random.default_rng(4)
    hub = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    prints = np.repeat(hub[None], 400, 0)
    for i in range(1, 400):
        bits = rng.integers(0, 256, 6)
        prints[i] = prints[i - 1] if i % 100 else rng.integers(0, 1 << 63, 4).astype(np.uint64)
        for b in bits:
            prints[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    for radius in (0, 4, 6, 20):
        apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)

        def parts_of(pairs):
            root = list(range(400))
            for x, y in pairs:
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
            return root

        want = parts_of(zip(*np.nonzero(apart <= radius), strict=True))
        assert parts_of(simhash._chained(prints, np.arange(400), radius)) == want


def test_near_copies_edges(docs_of):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs_of(EDGE)).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == [1, 1, 1, 4, 5, 5, 7, 7, 9, 10, 7] and got[None] is None
    assert simhash.near_copies(docs_of([])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[501] == found[500] == 500
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_shingles(text):
    """The set of runs of five words, by a plain loop over the text's words."""
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def check_edits(rows, got):
    """Fingerprint rows against shingle sets; `rows` are (doc_id, text) in order, the next of a row being the one after."""
    want = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        near = []
        for other in (edited, after):
            a, b = slow_shingles(t), slow_shingles(other)
            near.append((len(a & b) / len(a | b) if a | b else 1.0, len(a | b) <= bottomk.K))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), near))
    have = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["near_next"], r["near_edited"]) for r in got)
    assert [h[:3] for h in have] == sorted(w[:3] for w in want)
    for h, w in zip(have, sorted(want, key=lambda w: (*w[:3], w[3][1][0])), strict=True):
        for mine, (true, exact) in ((h[4], w[3][0]), (h[3], w[3][1])):
            assert abs(mine - true) < (1e-12 if exact else 0.15)


def test_fingerprints_query(spark):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    check_edits(rows, queries.op7_bottom_k_fingerprints(spark, SMALL).collect())


def ordered(rows):
    """Null ids first, equal ids in order of the hash that Spark gives their texts."""
    sign = lambda h: h - (1 << 64) if h >> 63 else h
    return sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-(2**63) if r[0] is None else r[0], sign(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1]))


def test_fingerprints_of_ids_that_repeat(spark, docs_of):
    """A third of all rows without an id, a third with one id and equal texts: split over ranges, no row lost."""
    rng = random.Random(2)
    own = lambda: " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 30)))
    rows = [(None, own()) for _ in range(400)] + [(7, "same text of many rows and some more of it")] * 400 + [(i, own()) for i in range(400)] + [(None, None)] * 150
    rng.shuffle(rows)
    check_edits(ordered(rows), bottomk.edits(docs_of(rows), range_rows=60).collect())
    for few in ([(3, "x y")] * 3 + [(4, "z")], [(None, None)] * 5, [(2, "only")]):
        check_edits(ordered(few), bottomk.edits(docs_of(few), range_rows=1).collect())


def test_ranges_are_even():
    rng = np.random.default_rng(3)
    at, h = np.r_[rng.integers(0, 10**6, 20_000), np.full(10_000, 17)], rng.integers(-(2**62), 2**62, 30_000)
    h[25_000:] = 5
    size = np.where(at < 1000, 50_000, 100)
    ranges = bottomk.Ranges(at, h, size, 40, (-1, 0))
    low = [ranges.span(r) for r in zip(at.tolist(), h.tolist(), strict=True)]
    load = np.zeros(ranges.n)
    for (a, b), n in zip(low, size.tolist(), strict=True):
        load[a : b + 1] += (n + bottomk.ROW_BYTES) / (b - a + 1)
    assert ranges.n > 30 and load.max() < 2 * load.mean() and (17, 5) in ranges.repeated()


def test_fingerprint_edges_and_sketches(spark, docs_of):
    got = bottomk.edits(docs_of(EDGE), range_rows=3)
    check_edits(ordered(EDGE), got.collect())
    by = {r["doc_id"]: r for r in got.collect()}
    assert len(by) == len(EDGE) and by[7]["fingerprint"] == by[8]["fingerprint"] == by[11]["fingerprint"]
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == "" and by[1]["near_next"] == 1.0 and by[2]["near_next"] == 1.0 and by[3]["near_next"] == 0.0
    assert bottomk.edits(docs_of([])).count() == 0 and bottomk.edits(docs_of([(5, "a b c d")])).first()["near_next"] == 1.0
    a, b = " ".join(map(str, range(3000))), " ".join(map(str, range(1500, 4500)))
    made = {r["doc_id"]: r for r in bottomk.sketches(docs_of([(1, a), (2, b)])).collect()}
    x, y = (bottomk.unpack(made[i]["sketch"]) for i in (1, 2))
    assert abs(made[1]["n_shingles"] / 2996 - 1) < 0.2 and abs(bottomk.resemblance(x, y) - 1 / 3) < 0.12 and abs(bottomk.containment(x, y) - 0.5) < 0.15
    parts = bottomk.sketches(docs_of([(1, " ".join(a.split()[:1600])), (1, " ".join(a.split()[1596:]))]))
    assert bytes(bottomk.merge(parts, "doc_id").first()["sketch"]) == bytes(made[1]["sketch"])


def brute(rows, ids, k):
    out = []
    for q, v in rows:
        if q in ids:
            scored = sorted(((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("factor", [1.0, 0.5])
def test_neighbours(spark, factor):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900 + i, rows[i % 3][1]) for i in range(200)]
    bad = [(2000, None), (2001, [0.0] * 8), (2020, [float("nan")] * 8), (2040, [1.0, None] + [0.0] * 6), (2060, [float("inf")] + [0.0] * 7), (2080, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    found = vantage.nearest(df.filter("vec_id % 20 = 0"), df, k=20, factor=factor, shard_bytes=300 * 64)
    got = sorted(tuple(r) for r in found.collect())
    want = sorted(brute(rows, {i for i, _ in rows if i % 20 == 0}, 20))
    if factor == 1.0:
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))
    else:
        assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    assert vantage.nearest(df.filter("false"), df).count() == 0 and vantage.nearest(df, df.filter("vec_id = 2001")).count() == 0


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(4)
    one, two = ([float(np.float32(v)) for v in rng.normal(size=4)] for _ in range(2))
    rows = [(20, one)] * 25 + [(21, one)] + [(5, two)] * 25 + [(6, two)] + [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(30, 70)]
    rows += [(7, [float(np.float32(v * (9 + j))) for v in one]) for j in range(60)]  # an id with many near vectors
    rows += [(40, [float(np.float32(v * (5 + j))) for v in two]) for j in range(60)]  # and one that asks
    want = {}
    for a, v in rows:
        if a % 20 == 0:
            for b, w in rows:
                if a != b:
                    s = sum(x * y for x, y in zip(v, w, strict=True))
                    want[a, b] = max(s, want.get((a, b), s))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.filter("vec_id % 20 = 0")
    for shard_bytes in (32_000, 1600):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vantage.nearest(asked, df, k=20, shard_bytes=shard_bytes).collect()}
        assert len(got) == 20 * len({a for a, _ in want})
        for a in {a for a, _ in want}:
            best = sorted((-s, b) for (c, b), s in want.items() if c == a)[:20]
            assert [got[a, n + 1][0] for n in range(20)] == [b for _, b in best]
            assert np.allclose([got[a, n + 1][1] for n in range(20)], [-s for s, _ in best], rtol=1e-12)


def test_shards_out_of_reach_are_not_met(spark, monkeypatch):
    """Clustered rows: exact results, from a few shards of many; extra columns with clashing names are ignored."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(12, 6)) * 10
    x = np.concatenate([c + rng.normal(size=(150, 6)) * 0.05 for c in centre]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 400, 0)])
    rows = [(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, id string, vec double")
    monkeypatch.setattr(vantage, "LEAST_ROWS", 50)
    got = sorted(tuple(r) for r in vantage.nearest(df.filter("vec_id % 20 = 0"), df, k=20, shard_bytes=100 * 24).collect())
    scores = x.astype(float) @ x.astype(float).T
    for q in range(0, len(x), 20):
        best = sorted((-scores[q, i], i) for i in range(len(x)) if i != q)[:20]
        mine = [r for r in got if r[0] == q]
        assert np.allclose([r[3] for r in mine], [-s for s, _ in best]) and [r[1] for r in mine] == list(range(1, 21))
    most = float((x.astype(float) ** 2).sum(1).max())
    cells = vantage.Cells(np.arange(len(x)), x.astype(float), most, 20, 12)
    cell, far = cells.of(x.astype(float))
    reach = np.array([far[cell == c].max(initial=-np.inf) for c in range(len(cells.at))])
    q = x[::20].astype(float)
    meets = cells.meets(q, cells.bounds(np.arange(0, len(x), 20), q), reach, 1.0)
    assert meets.mean() < 0.5


def test_pruning_skips_parts_of_clustered_data():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.01, (600, 4)) for c in range(8)])
    tree = vantage.Tree(x, leaf=64)
    q = x[::97]
    who, row = tree.search(q, 5)
    best = np.sort(q @ x.T, axis=1)[:, -5:]
    for i in range(len(q)):
        assert np.allclose(np.sort(q[i] @ x[row[who == i]].T)[-5:], best[i])


def test_links_of_a_hot_group_are_a_forest_a_task(docs_of, spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = [" ".join(base[: (at := rng.randrange(300))] + [f"x{i}"] + base[at:]) for i in range(400)]
    prints = simhash.wide_fingerprints(docs_of(list(enumerate(texts)))).select("fp", "wide").distinct().cache()
    linked = simhash.wide_links(prints, group_variants=100_000)
    n, tasks = prints.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() * 528 // 100_000))
    assert linked.count() <= tasks * (n - 1)
    assert components(linked).select("root").distinct().count() == 1 and components(linked).count() == n


def test_copies_of_equal_blocks_are_not_linked_again_in_each_variant(docs_of, spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = [" ".join(base[: (at := rng.randrange(300))] + [f"x{i}"] + base[at:]) for i in range(300)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(200)) for _ in range(30)]
    prints = simhash.wide_fingerprints(docs_of(list(enumerate(texts)))).select("fp", "wide").distinct().cache()
    found = prints.collect()
    wide = np.frombuffer(b"".join(r["wide"] for r in found), "<u4").reshape(-1, simhash.BLOCKS + 2 + simhash.MINIMA // 32)
    apart = np.bitwise_count(wide[:, None] ^ wide[None]).astype(int)
    root = np.arange(len(found))
    for i, j in np.argwhere((apart[:, :, : simhash.BLOCKS].min(2) <= 2) & (apart[:, :, simhash.BLOCKS : simhash.BLOCKS + 2].sum(2) <= simhash.WIDE_RADIUS)):
        root[root == root[i]] = root[j]
    for buckets in (4, 40, 400):
        linked = simhash.wide_links(prints, group_variants=-(-len(found) * 528 // buckets)).cache()
        # before: each text with nearly each other one in every bucket that two of them share, up to 528 a text
        assert linked.count() <= 40 * len(found)
        reached = {r["node"]: r["root"] for r in components(linked).collect()}
        assert len(set(reached.values())) + len(found) - len(reached) == len(set(root.tolist()))
