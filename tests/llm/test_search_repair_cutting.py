"""Ranked search, turn repair and cutting-stock packing against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from penumbra.llm import cutting, queries, repair, tiered

SMALL = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# Search


def slow_search(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in docs]
    n, total = sum(c > 0 for _, _, c in own), sum(c for _, _, c in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, tf, size in own:
            score = 0
            for t in terms(text):
                if tf[t]:
                    m = 75 + 25 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ODD_DOCS = [(1, None), (2, ""), (3, " .,- "), (4, "Été ÉTÉ été a-b_c 1"), (5, "one two three"), (6, "one two three"), (6, "ONE two"), (None, "one"), (7, "common " * 30000 + "rare"), (8, "日本語、テキスト one"), (9, "rare rare one")]
ODD_ITEMS = [(1, "one TWO one"), (1, "rare"), (2, None), (3, "..."), (4, "absent"), (None, "common rare"), (5, "été ÉTÉ"), (6, "日本語、テキスト")]


def test_search_edges(spark, docs_of):
    items = spark.createDataFrame([(i, t, "x") for i, t in ODD_ITEMS], "item_id long, text string, terms string")
    assert rows_of(tiered.search(docs_of(ODD_DOCS), items)) == slow_search(ODD_DOCS, ODD_ITEMS)
    assert rows_of(tiered.search(docs_of(ODD_DOCS), items, k=1)) == slow_search(ODD_DOCS, ODD_ITEMS, 1)
    assert tiered.search(docs_of([]), items).count() == 0
    assert tiered.search(docs_of(ODD_DOCS), items.limit(0)).count() == 0
    assert tiered.search(docs_of([(1, None)]), items).count() == 0


def test_search_over_many_blocks_lanes_and_tiers(spark, docs_of, monkeypatch):
    """Blocks of few rows, several lanes, a whole vocabulary: the same rows, and most blocks are proven early."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(300)], k=rng.randint(1, 200)))) for i in range(900)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(99, docs[5][1])]
    monkeypatch.setattr(tiered, "TIERS", ((1, 1 / 32), (4, 1 / 4)))
    want, table = slow_search(docs, items, 5), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(tiered.search(docs_of(docs).repartition(24), table, 5)) == want
    monkeypatch.setattr(tiered, "LANE_BYTES", 200)
    monkeypatch.setattr(tiered, "VOCABULARY", 10)
    monkeypatch.setattr(tiered, "OPEN_BLOCKS", 0)
    assert rows_of(tiered.search(docs_of(docs).repartition(24), table, 5)) == want


def test_bounds_hold_and_prove(spark, docs_of, tmp_path):
    """In each tier a document's exact score lies within its bounds, and lower tiers hold no more than is said."""
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefgh", [8, 7, 6, 5, 4, 3, 2, 1], k=rng.randint(1, 400)))) for i in range(600)]
    index, df, n, _ = tiered.build(docs_of(docs), str(tmp_path / "i"))
    lane = tiered.Lane([(1, [b"a", b"g", b"h", b"h"])], {bytes(t): c for t, c in df.collect()}, n)
    seen = 0
    for batch in index.toArrow().to_batches():
        for row in range(batch.num_rows):
            score = tiered.Block(batch, row, tiered.LAST, lane).lower(lane.items[0])
            for upto in range(tiered.LAST + 1):
                block = tiered.Block(batch, row, upto, lane)
                assert (block.lower(lane.items[0]) <= score).all()
                assert block.reaches(lane.items[0], int(score.max()))
                seen += not block.reaches(lane.items[0], int(score.max() * 1.2) + 1)
    assert seen


# Repair


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        role, text, kind = sp(role), sp(text), zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def slow_repair(turns, room=3):
    """All edits of a few turns: (cost, audit, repaired)."""
    seen, facts = set(), []
    for role, text in turns:
        ink = text.strip(" \t\n\x0b\x0c\r")
        gone = not ink or (role, text) in seen
        facts.append((role, text, gone, int(bool(ink) and ink[-1] not in ".!?")))
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?").fullmatch
    best = None
    for gaps in itertools.product(range(room), repeat=len(facts) + 1):
        options = []
        for i in range(len(facts) + 1):
            options += [[(2, "I", "user", ""), (2, "I", "assistant", "")]] * gaps[i]
            if i < len(facts):
                role, text, gone, cut = facts[i]
                options.append([(3, "D", None, None)] + ([] if gone else [(cut, "K", role, text), (2 + cut, "R", "user", text), (2 + cut, "R", "assistant", text)]))
        for way in itertools.product(*options):
            kept = [(r, t) for _, _, r, t in way if r is not None]
            if legal("".join(r[:1] or "?" for r, _ in kept)):
                this = (sum(w[0] for w in way), "".join(w[1] for w in way), "\n".join(f"{r}:{t}" for r, t in kept))
                best = min(best or this, this)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_edits_against_all_edits(seed):
    rng = random.Random(seed)
    for _ in range(12):
        turns = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Hi.", "Hm", "", "Ok!"])) for _ in range(rng.randint(0, 3))]
        own, seen = repair.Segment(), set()
        for i, (role, text) in enumerate(turns):
            own.add(i, role[:1], 1, (role, text) not in seen, not text.strip(), text[-1:] not in ".!?")
            seen.add((role, text))
        made = own.report()
        cost, audit, whole = slow_repair(turns)
        assert (made["cost"], made["audit"]) == (cost, audit), turns
        assert "\n".join(f"{r}:{t}" for r, t in repair.edited(audit, iter(turns))) == whole


def test_products_may_be_grouped_in_any_way():
    rng = random.Random(8)
    for _ in range(300):
        turns = [repair.turn_matrix(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.4) for _ in range(rng.randint(1, 12))]
        left = turns[0]
        for m in turns[1:]:
            left = repair.product(left, m)
        assert left == repair.product_of(turns)
        assert repair.power(turns[0], 5) == repair.product_of([turns[0]] * 5)


def test_repair_edges(spark):
    rows = [(1, None, None, None), (1, None, "user", "x."), (2, 5, "system", "Be."), (2, 9, "user", "Q?"), (2, 9, "user", "Q?"), (2, 11, "assistant", "A\t\r"), (None, 1, "user", "u."), (None, 2, "assistant", "v"), (3, 0, "user", "é" * 70000 + "."), (3, 1, "tool", "z.")]
    rows += [(4, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(400)] + [(5, t, "user", "same.") for t in range(300)]
    rows += [(6, 1, "user", "rep.")] * 500
    lost = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "gone."))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, n int")
    got = {r["conv_id"]: r.asDict() for r in repair.repaired(repair.damaged(table)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None, lost}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[lost] == {"conv_id": lost, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    for conv in got:
        own = sorted((r[1:] for r in slow_damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        seen, counts = set(), collections.Counter()
        segment = repair.Segment()
        for t, role, text in own:
            blank, again, ink = not text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen, text.rstrip(" \t\n\x0b\x0c\r")
            cut = ink[-1:] not in (".", "!", "?")
            counts["blank" if blank else "duplicate" if again else "truncated" if cut else "fine"] += 1
            segment.add(t, role[:1], 1, not again, blank, cut)
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        assert got[conv]["gaps"] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [got[conv][c] for c in ("blank", "duplicate", "truncated")] == [counts[c] for c in ("blank", "duplicate", "truncated")], conv
        assert got[conv]["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit = repair.cheapest(repair.product_of(segment.matrices))
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, audit)
        whole = "\n".join(f"{r}:{t}" for r, t in repair.edited(audit, ((r, t) for _, r, t in own)))
        assert got[conv]["repaired_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert repair.repaired(repair.damaged(table.limit(0))).count() == 0


def test_one_conversation_over_many_ranges(spark):
    """A conversation of most rows is cut at many ranges and multiplied together level by level."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "", f"{t}?"])) for t in range(5000)] + [(i, 0, "user", "q?") for i in range(8, 40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = {r["conv_id"]: r for r in repair.repaired(repair.intact(table)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "70")
    try:
        many = {r["conv_id"]: r for r in repair.repaired(repair.intact(table)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == many and re.fullmatch("[KRDI]+", one[7]["audit"]) and len(one[7]["audit"].replace("I", "")) == 5000


# Cutting


def ids_of(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    return [[*e.ids, cutting.END] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_are_the_librarys():
    rng = random.Random(1)
    parts = ["a", "B", "Ü", "é", "'s", "'ll", "'", "1", "23", ".", ",", " ", "  ", "\n", "\n\n", "\t", "\xa0", "ª", "日", "I'm", "<|endoftext|>", "<|", "😀", "-", "\r"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + ["".join(rng.choices(parts[:11] + [" a"] * 8, k=60)) for _ in range(1500)]
    make = cutting.Tokens(VOCABULARY)
    assert make.by_chunks
    assert [np.frombuffer(i, "<u4").tolist() for i in make.ids(texts)] == ids_of(texts)


def checked(rows, texts, capacity):
    """Each id in exactly one piece, gapless sequences, right sums; (padding, sequences)."""
    want, sequences, taken = collections.Counter(map(tuple, ids_of(texts))), collections.defaultdict(list), collections.defaultdict(list)
    by_doc = {i: ids for i, ids in enumerate(ids_of(texts))}
    for r in rows:
        own = by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(by_doc[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        taken[r["doc_id"]].append((r["start"], r["length"]))
    for spans, total in [(s, None) for s in sequences.values()] + [(taken[i], len(ids)) for i, ids in by_doc.items()]:
        end = 0
        for at, n in sorted(spans):
            assert at == end and n > 0
            end += n
        assert end <= capacity if total is None else end == total
    sums = [sum(n for _, n in s) for s in sequences.values()]
    assert want
    return sum(capacity - n for n in sums if n & (n - 1)), len(sums)


def test_packing_query_is_whole_and_unpadded(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(texts) == list(range(len(texts)))
    rows = queries.op13_cutting_stock(spark, SMALL).collect()
    padding, n = checked(rows, [texts[i] for i in range(len(texts))], 2048)
    total = sum(r["length"] for r in rows)
    assert padding == 0 and n <= total / 2048 + 12


def test_packing_edges(docs_of):
    texts = [None, "", "a", "a", "word " * 9000, "x" * 30, "b c d"] + ["one two three four"] * 40
    for capacity in (8, 2048):
        rows = cutting.pack(docs_of(list(enumerate(texts))), VOCABULARY, capacity).collect()
        assert checked(rows, texts, capacity)[0] == 0
    assert cutting.pack(docs_of([]), VOCABULARY).count() == 0
    (only,) = cutting.pack(docs_of([(None, None)]), VOCABULARY).collect()
    assert only["doc_id"] is None and (only["start"], only["length"], only["offset"], only["doc_tokens"]) == (0, 1, 0, 1)


@pytest.mark.parametrize("counts", [{1500: 100}, {1: 1}, {5: 3000}, {2047: 10, 1: 3}, {1000: 7, 900: 5, 30: 2}, dict(collections.Counter(random.Random(5).randint(1, 2047) for _ in range(4000)))])
def test_plan_places_each_piece_once(counts):
    plan, fill = cutting.Plan(counts), collections.defaultdict(list)
    for n, c in counts.items():
        for seq, off in zip(*(a.tolist() for a in plan.place(n, np.arange(c))), strict=True):
            for _, length, s, o in [(0, n, seq, off)] if seq >= 0 else plan.cuts(off, n):
                fill[s].append((o, length))
    for spans in fill.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 2048 and (end == 2048 or end & (end - 1) == 0)
    assert len(fill) <= sum(n * c for n, c in counts.items()) / 2048 + 12


def test_columns_lower_the_program():
    """Pricing finds the pairs that the start misses: lengths of which only unlike ones fit together."""
    counts = {1100: 300, 700: 300, 650: 300, 300: 300, 250: 300}
    start = sum(x for _, x in cutting.program(counts, rounds=0))
    best = sum(x for _, x in cutting.program(counts))
    need = sum(n * c for n, c in counts.items()) / 2048
    assert need <= best <= start
    covered = collections.Counter()
    for own, times in cutting.program(counts):
        assert sum(n * k for n, k in own.items()) <= 2048
        for n, k in own.items():
            covered[n] += k * times
    assert all(covered[n] == pytest.approx(c) for n, c in counts.items())


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_against_all_patterns(seed):
    rng = random.Random(seed)
    lengths = np.array(sorted(rng.sample(range(3, 20), 4)))
    values = np.array([rng.random() for _ in lengths])
    worth, own = cutting.knapsack(lengths, values, 30)
    best = max(sum(v * k for v, k in zip(values, ks, strict=True)) for ks in itertools.product(range(11), repeat=4) if sum(n * k for n, k in zip(lengths, ks, strict=True)) <= 30)
    assert worth == pytest.approx(best) and sum(values[i] * k for i, k in own.items()) == pytest.approx(best)
