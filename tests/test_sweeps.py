"""Searches over sorted spans and words against comparing all with all."""

import random

from penumbra.operators import external, layout

SPANS = "array<struct<start:int,end:int>>"


def test_spans_apart_from_others(spark):
    rng = random.Random(4)
    some = lambda n: [(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 60) for _ in range(n))]
    rows = [(i, some(rng.randint(0, 8)), some(rng.randint(0, 8))) for i in range(300)]
    df = spark.createDataFrame(rows, f"id int, more {SPANS}, found {SPANS}")
    got = {r["id"]: [tuple(x) for x in r["apart"]] for r in df.select("id", external.apart(df["more"], df["found"]).alias("apart")).collect()}
    assert got == {i: [x for x in more if not any(x[0] < y[1] and y[0] < x[1] for y in found)] for i, more, found in rows}


def test_boxes_of_spans_over_words(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        words, at = [], 0
        for _ in range(rng.randint(0, 12)):
            n = rng.choice([0, 1, 3, 6])
            words.append((at, at + n, rng.choice([1, 1, 2]), float(rng.randint(0, 90)), float(rng.randint(0, 90)), float(rng.randint(1, 9)), float(rng.randint(1, 9))))
            at += n + 1
        rows.append((i, words, [(a, a + rng.randint(0, 12), None) for a in (rng.randint(0, 50) for _ in range(rng.randint(0, 6)))]))
    df = spark.createDataFrame(rows, f"id int, words array<struct<start:int,end:int,page:int,x:float,y:float,width:float,height:float>>, spans array<struct<start:int,end:int,bbox:{layout.BOX}>>")

    def box(span, words):
        hit = [w for w in words if span[0] < w[1] and w[0] < span[1]]
        own = [w for w in hit if w[2] == hit[0][2]]
        if not own:
            return None
        x, y = min(w[3] for w in own), min(w[4] for w in own)
        return own[0][2], x, y, max(w[3] + w[5] for w in own) - x, max(w[4] + w[6] for w in own) - y

    got = {r["id"]: [e["bbox"] and tuple(e["bbox"]) for e in r["made"]] for r in df.select("id", layout.boxes_of(df["spans"], df["words"]).alias("made")).collect()}
    assert got == {i: [box(s, words) for s in spans] for i, words, spans in rows}
