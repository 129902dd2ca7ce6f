"""Repair of conversations' turn structure by min-plus matrices.

A conversation is legal if its roles' initials are nothing, or an optional system turn and then user and assistant in
turn, the assistant last. Edits keep a turn, give it the role that is due, delete it, or insert an empty one; the
cheapest edits count, and of equally cheap ones the least string of initials (the audit).

Each turn is a 4 x 4 matrix over states (start, after system, user, assistant) of (cost, audit), with the closure of
insertions before it; the product adds costs, joins audits and keeps the least. Neither of two audits of equal cost of
the same turns begins the other (what it had more would be insertions, which cost), so the least of the parts is the
least of the whole, and products may be taken in any grouping. Turns without their texts are dealt to ranges of
(conversation, turn): conversations within a range are done there; of those that cross ranges each range keeps one
matrix, and eight neighbours at a time are multiplied until one is left. Texts move once, to be hashed in order beside
their audit; SHA-256 has no parallel form, so one conversation is hashed by one task, as a stream.

Cases: null roles and texts are one space; turns are in order of number (nulls first), equal numbers by role, the first
PREFIX characters of the text, then a digest of both; a conversation without rows after damage has zeros and an empty
audit; rows of null conv_id are one conversation; roles without a legal initial can't be kept; equal rows that repeat
are raised to a power, not multiplied one by one; further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = (1 << 60, "")
LEGAL_PAIRS = ("su", "ua", "au")
#: Characters of a text that order turns of equal number and role.
PREFIX = 64
#: Neighbouring ranges whose matrices are multiplied at a time.
FAN = 8
Matrix = list[list[tuple[int, str]]]


def matrix(edits: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return [[edits.get((i, j), NEVER) for j in range(4)] for i in range(4)]


IDENTITY = matrix({(i, i): (0, "") for i in range(4)})
#: What a state comes to by insertions alone: a user after anything but a user, an assistant after a user.
INSERTIONS = matrix({(i, i): (0, "") for i in range(4)} | {(i, USER): (INSERT, "I") for i in (START, SYSTEM, ASSISTANT)} | {(USER, ASSISTANT): (INSERT, "I")} | {(i, ASSISTANT): (2 * INSERT, "II") for i in (START, SYSTEM)})


def product(a: Matrix, b: Matrix) -> Matrix:
    """The least (cost, audit) over the state between."""
    out = []
    for row in a:
        own = []
        for j in range(4):
            costs = [row[k][0] + b[k][j][0] for k in range(4)]
            least = min(costs)
            own.append(NEVER if least >= NEVER[0] else (least, min(row[k][1] + b[k][j][1] for k in range(4) if costs[k] == least)))
        out.append(own)
    return out


def product_of(matrices: list[Matrix]) -> Matrix:
    """The product of neighbours, then of neighbouring products, so that audits are copied a few times each."""
    while len(matrices) > 1:
        paired = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)]
        matrices = paired + matrices[len(matrices) - len(matrices) % 2 :]
    return matrices[0] if matrices else IDENTITY


def power(m: Matrix, n: int) -> Matrix:
    out = IDENTITY
    while n:
        out, m, n = product(out, m) if n & 1 else out, product(m, m) if n > 1 else m, n >> 1
    return out


def due(state: int) -> int:
    """The state after a turn of the role that is due."""
    return ASSISTANT if state == USER else USER


@cache
def turn_matrix(initial: str, deleted: bool, truncated: bool) -> Matrix:
    """One turn, with insertions before it. A turn that must go is only deleted."""
    edits = {(i, i): (DELETE, "D") for i in range(4)}
    if not deleted:
        extra = TRUNCATED * truncated
        kept = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
        options = [((i, due(i)), (REROLE + extra, "R")) for i in range(4)] + [(move, (extra, "K")) for move in kept.get(initial, [])]
        for move, edit in options:
            edits[move] = min(edits.get(move, NEVER), edit)
    return product(INSERTIONS, matrix(edits))


def cheapest(m: Matrix) -> tuple[int, str]:
    """The least way from the start to a legal end, with insertions after the last turn."""
    whole = product(m, INSERTIONS)
    return min(whole[START][START], whole[START][ASSISTANT])


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    state, names = START, {USER: "user", ASSISTANT: "assistant"}
    for edit in audit:
        if edit == "I":
            state = due(state)
            yield names[state], ""
            continue
        role, text = next(turns)
        if edit == "R":
            state = due(state)
            yield names[state], text
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield role, text


# Damage -------------------------------------------------------------------------------------------------------------

KINDS = 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): rows after the damage that CRC-32 of `conv_id:turn` picks; lost rows stay as
    marks, so that no conversation is forgotten."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(KINDS)).alias("kind"))
    kind, text = F.col("kind"), F.col("text")
    worn = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(kind == 0))
    return own.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), worn.alias("text"), F.explode(copies).alias("lost"))


def intact(conversations: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role"), spaced("text"), F.lit(False).alias("lost"))


def placed(rows: DataFrame) -> DataFrame:
    """With what orders turns of equal number: the text's beginning and a digest of role and text."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return rows.withColumn("prefix", F.substring("text", 1, PREFIX)).withColumn("digest", digest)


PLACE = ["turn", "role", "prefix", "digest"]


def facts(rows: DataFrame) -> DataFrame:
    """(conv_id, PLACE, n, first, blank, truncated) of equal rows, without texts: n rows, first if none equal is at an
    earlier turn. Equal rows are counted before they are shuffled, and first turns come as marks, so no key is hot."""
    inked = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", " " * 5))
    flags = placed(rows).select("conv_id", *PLACE, (~F.col("lost")).cast("long").alias("n"), (inked == "").alias("blank"), (~F.right(inked, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    alike = flags.groupBy("conv_id", *PLACE, "blank", "truncated").agg(F.sum("n").alias("n"))
    firsts = alike.filter("n > 0").groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("t"), F.min("role").alias("role"), F.min("prefix").alias("prefix"))
    marks = firsts.select("conv_id", F.col("t.turn").alias("turn"), "role", "prefix", "digest", F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("truncated"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("first"))
    both = alike.withColumn("first", F.lit(0)).unionByName(marks)
    return both.groupBy("conv_id", *PLACE).agg(F.sum("n").alias("n"), (F.max("first") == 1).alias("first"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))


# Segments -----------------------------------------------------------------------------------------------------------

COUNTS = ["blank", "duplicate", "truncated", "illegal"]


class Segment:
    """What neighbouring turns of one conversation come to: counts, ends and their matrix."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.ends: tuple[str, str] | None = None  # the first and last initial
        self.turns: tuple[int, int, int] | None = None  # smallest, largest, distinct
        self.matrices: list[Matrix] = []

    def add(self, turn: int | None, initial: str, n: int, first: bool, blank: bool, truncated: bool) -> None:
        """n equal rows that follow the last."""
        if not n:
            return
        cut_short = first and not blank and truncated
        self.counts["blank"] += n if blank else 0
        self.counts["duplicate"] += 0 if blank else n - first
        self.counts["truncated"] += cut_short
        self.meet(initial)
        self.counts["illegal"] += (n - 1) * (initial + initial not in LEGAL_PAIRS)
        self.ends = (self.ends[0] if self.ends else initial, initial)
        if turn is not None:
            self.span(turn, turn, 1)
        kept = int(first and not blank)
        if kept:
            self.matrices.append(turn_matrix(initial, False, cut_short))
        if n > kept:
            self.matrices.append(power(turn_matrix(initial, True, False), n - kept) if n - kept > 1 else turn_matrix(initial, True, False))

    def meet(self, initial: str) -> None:
        if self.ends:
            self.counts["illegal"] += self.ends[1] + initial not in LEGAL_PAIRS

    def span(self, low: int, high: int, distinct: int) -> None:
        if self.turns is None:
            self.turns = (low, high, distinct)
        else:
            self.turns = (self.turns[0], high, self.turns[2] + distinct - (low == self.turns[1]))

    def follow(self, other: "Segment") -> None:
        """The turns of `other` come after these."""
        for c in COUNTS:
            self.counts[c] += other.counts[c]
        if other.ends:
            self.meet(other.ends[0])
            self.ends = (self.ends[0] if self.ends else other.ends[0], other.ends[1])
        if other.turns:
            self.span(*other.turns)
        self.matrices += other.matrices

    def row(self) -> dict:
        m = product_of(self.matrices)
        return {**self.counts, "ends": list(self.ends or ()), "turns": list(self.turns or ()), "costs": [x[0] for r in m for x in r], "audits": [x[1] for r in m for x in r]}

    @staticmethod
    def of(row: dict) -> "Segment":
        out = Segment()
        out.counts = {c: int(row[c]) for c in COUNTS}
        out.ends = tuple(row["ends"]) if len(row["ends"]) else None
        out.turns = tuple(int(x) for x in row["turns"]) if len(row["turns"]) else None
        flat = list(zip((int(c) for c in row["costs"]), row["audits"], strict=True))
        out.matrices = [[flat[i : i + 4] for i in range(0, 16, 4)]]
        return out

    def report(self) -> dict:
        cost, audit = cheapest(product_of(self.matrices))
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": audit}


SEGMENT = "blank long, duplicate long, truncated long, illegal long, ends array<string>, turns array<long>, costs array<long>, audits array<string>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NONE = {k: None for k in ("ends", "turns", "costs", "audits", "gaps", "cost", "audit")}


def segments(ordered: DataFrame, kind: str) -> DataFrame:
    """Of each range of ordered facts: reports of conversations that lie within it, segments of its first and last."""
    schema = f"conv_id {kind}, part long, open boolean, {SEGMENT}, gaps long, cost long, audit string"
    names = ["conv_id", "part", "open", *COUNTS, *NONE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, key, began = TaskContext.get().partitionId(), None, None, 0
        out: list[dict] = []

        def rows(made: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(made, schema=arrow)

        arrow = None
        for b in batches:
            if arrow is None:
                arrow = pa.schema([("conv_id", b.schema.field("conv_id").type), ("part", pa.int64()), ("open", pa.bool_()), *((c, pa.int64()) for c in COUNTS), ("ends", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("gaps", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
            for conv, *fact in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "first", "blank", "truncated")), strict=True):
                if own is None or conv != key:
                    if own is not None:
                        # the first of a range may have begun before it
                        out.append({"conv_id": key, "part": part, "open": began == 1, **NONE, **(own.row() if began == 1 else own.report())})
                    own, key, began = Segment(), conv, began + 1
                own.add(*fact)
            yield rows(out)
            out = []
        if own is not None:
            yield rows([{"conv_id": key, "part": part, "open": True, **NONE, **own.row()}])

    assert [f.split()[0] for f in schema.split(", ")] == names
    return ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "first", F.coalesce("blank", F.lit(True)).alias("blank"), F.coalesce("truncated", F.lit(False)).alias("truncated")).mapInArrow(run, schema)


def _of_group(finish: bool, kind: str) -> tuple[Callable, str]:
    """For applyInPandas: the segments of a group as one, or as its report."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        own = Segment()
        for r in f.sort_values("part").to_dict("records"):
            own.follow(Segment.of(r))
        made = {"conv_id": f["conv_id"].iloc[0], **({} if finish else {"part": int(f["part"].min())}), **(own.report() if finish else own.row())}
        return pd.DataFrame({k: pd.Series([v], dtype=f["conv_id"].dtype if k == "conv_id" else None) for k, v in made.items()})

    return run, f"conv_id {kind}, {REPORT}" if finish else f"conv_id {kind}, part long, {SEGMENT}"


def reports(rows: DataFrame) -> DataFrame:
    """(conv_id, REPORT) for each conversation of (conv_id, turn, role, text, lost)."""
    kind, n = rows.schema["conv_id"].dataType.simpleString(), parts(rows.sparkSession)
    ordered = facts(rows).repartitionByRange(n, "conv_id", *PLACE).sortWithinPartitions("conv_id", *PLACE)
    made = segments(ordered, kind)
    whole = made.filter(~F.col("open")).select("conv_id", *(f.split()[0] for f in REPORT.split(", ")))
    rest, block = made.filter("open").select("conv_id", "part", *(f.split()[0] for f in SEGMENT.split(", "))), FAN
    while block < n:
        run, schema = _of_group(False, kind)
        rest, block = rest.groupBy("conv_id", F.floor(F.col("part") / block)).applyInPandas(run, schema), block * FAN
    run, schema = _of_group(True, kind)
    return whole.unionByName(rest.groupBy("conv_id").applyInPandas(run, schema))


# Repaired texts -----------------------------------------------------------------------------------------------------


def _turns(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in columns), strict=True)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, REPORT, repaired_sha256): each conversation's texts pass beside its audit, in order, as a stream."""
    names = [f.split()[0] for f in REPORT.split(", ")]
    kind = rows.schema["conv_id"].dataType.simpleString()
    heads = reports(rows).select("conv_id", F.lit(0).alias("body"), F.struct(*names).alias("head"))
    bodies = placed(rows.filter(~F.col("lost"))).select("conv_id", F.lit(1).alias("body"), *PLACE, "text")
    both = heads.unionByName(bodies, allowMissingColumns=True).repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "body", *PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _turns(batches, ["conv_id", "head", "role", "text"])
        for conv, head, _, _ in stream:
            digest, begun = hashlib.sha256(), False
            for role, text in edited(head["audit"], ((r, t) for _, _, r, t in stream)):
                digest.update((("\n" if begun else "") + role + ":" + text).encode())
                begun = True
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **head, "repaired_sha256": digest.hexdigest()}])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in batches of a thousand or of a million audit characters."""
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += len(b.column("audit")[0].as_py())
            if len(held) >= 1000 or size > 1_000_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return both.select("conv_id", "head", "role", "text").mapInArrow(gathered, f"conv_id {kind}, {REPORT}, repaired_sha256 string")


ORACLE = """
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))),
        lambda c, b: list_reduce(range(8), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), md5(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i FROM d),
e AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ \\t-\\r]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ \\t-\\r]*$') AS short,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
f AS (SELECT *, blank OR again AS gone, CASE WHEN short THEN 1 ELSE 0 END AS extra FROM e),
s AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS x0, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS x1,
         {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS x2, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS x3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {'c': y0.c + 3, 'a': y0.a || 'D', 't': y0.t},
         list_min([{'c': y1.c + 3, 'a': y1.a || 'D', 't': y1.t}] || CASE WHEN NOT gone AND initial = 's' THEN [{'c': y0.c + extra, 'a': y0.a || 'K', 't': y0.t || own}] ELSE [] END),
         list_min([{'c': y2.c + 3, 'a': y2.a || 'D', 't': y2.t}]
           || CASE WHEN NOT gone THEN [{'c': y0.c + 2 + extra, 'a': y0.a || 'R', 't': y0.t || usr}, {'c': y1.c + 2 + extra, 'a': y1.a || 'R', 't': y1.t || usr}, {'c': y3.c + 2 + extra, 'a': y3.a || 'R', 't': y3.t || usr}] ELSE [] END
           || CASE WHEN NOT gone AND initial = 'u' THEN [{'c': y0.c + extra, 'a': y0.a || 'K', 't': y0.t || own}, {'c': y1.c + extra, 'a': y1.a || 'K', 't': y1.t || own}, {'c': y3.c + extra, 'a': y3.a || 'K', 't': y3.t || own}] ELSE [] END),
         list_min([{'c': y3.c + 3, 'a': y3.a || 'D', 't': y3.t}]
           || CASE WHEN NOT gone THEN [{'c': y2.c + 2 + extra, 'a': y2.a || 'R', 't': y2.t || ast}] ELSE [] END
           || CASE WHEN NOT gone AND initial = 'a' THEN [{'c': y2.c + extra, 'a': y2.a || 'K', 't': y2.t || own}] ELSE [] END)
  FROM (
    SELECT s.conv_id, f.i, f.gone, f.initial, f.extra, chr(10) || f.role || ':' || f.text AS own, chr(10) || 'user:' || f.text AS usr, chr(10) || 'assistant:' || f.text AS ast, x0 AS y0, x1 AS y1,
      list_min([x2, {'c': x0.c + 2, 'a': x0.a || 'I', 't': x0.t || chr(10) || 'user:'}, {'c': x1.c + 2, 'a': x1.a || 'I', 't': x1.t || chr(10) || 'user:'}, {'c': x3.c + 2, 'a': x3.a || 'I', 't': x3.t || chr(10) || 'user:'}]) AS y2,
      list_min([x3, {'c': x2.c + 2, 'a': x2.a || 'I', 't': x2.t || chr(10) || 'assistant:'}, {'c': x0.c + 4, 'a': x0.a || 'II', 't': x0.t || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': x1.c + 4, 'a': x1.a || 'II', 't': x1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS y3
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1)),
l AS (
  SELECT conv_id, list_min([x0, x3, {'c': x2.c + 2, 'a': x2.a || 'I', 't': x2.t || chr(10) || 'assistant:'}, {'c': x1.c + 4, 'a': x1.a || 'II', 't': x1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS z
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM s) WHERE back = 1),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE short AND NOT again AND NOT blank) AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       z.c AS cost, z.a AS audit, sha256(substr(z.t, 2)) AS repaired_sha256
FROM l LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM l.conv_id
"""
