"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (equal role and text) is rendered once as prompt; what follows in either
conversation is its completion, with a loss mask: only what an assistant writes (and its end mark) is learned from,
role headers and other roles' turns in a completion are not. All of it is built-in array functions over one row a pair.

Cases: a null text or role is an empty one; turns are in order of turn number (nulls first), then role, then text;
equal turns that repeat are turns each; equal conversations have empty completions and masks; one conversation that continues the other leaves the shorter an
empty completion; a pair lacking a side has an empty conversation there; ids may be any 64-bit number; further columns
are ignored, whatever their names; turns of any length are rendered whole, so a pair must fit a row (2 GB), as its
result does; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"


def header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def masked_spans(turns: Column) -> Column:
    """`start-end` code points of the rendered text to learn from, joined by commas."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def add(seen: Column, t: Column) -> Column:
        begin = seen["at"] + F.length(header(t))
        end = begin + F.length(body(t))
        span = F.concat(F.when(seen["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.cast("long").alias("at"), F.concat(seen["spans"], F.when(t["role"] == LEARNED, span).otherwise("")).alias("spans"))

    return F.aggregate(turns, start, add, lambda seen: seen["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Length of the longest common prefix of two arrays of (role, text)."""
    differs = F.array_position(F.zip_with(chosen, rejected, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs == 0, F.size(chosen)).otherwise(differs - 1).cast("int")


def formatted(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected: arrays of (role, text)) to pair_id, n_common, prompt, chosen, rejected,
    chosen_mask, rejected_mask."""
    n = common_turns(F.col("chosen"), F.col("rejected"))
    rest = lambda side: F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    own = pairs.select("pair_id", "chosen", "rejected", n.alias("n_common"))
    return own.select(
        "pair_id",
        "n_common",
        rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        rendered(rest(F.col("chosen"))).alias("chosen"),
        rendered(rest(F.col("rejected"))).alias("rejected"),
        masked_spans(rest(F.col("chosen"))).alias("chosen_mask"),
        masked_spans(rest(F.col("rejected"))).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs for tables without rejected ones: the rejected conversation ends with its neighbour's last turn.

    Neighbours are ids 2n and 2n + 1, whose turns meet in one shuffle. Without a neighbour the last turn is missing.
    Rows without conv_id belong to no conversation and are left out.
    """
    conv = F.col("conv_id").cast("long")
    turn = F.struct(conv.alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = conversations.filter("conv_id is not null").groupBy(F.shiftright(conv, 1).alias("two")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    of = lambda bit: F.transform(F.filter("turns", lambda t: t["conv_id"].bitwiseAND(F.lit(1)) == bit), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = both.select(F.shiftleft("two", 1).alias("even"), of(0).alias("a"), of(1).alias("b"))
    side = lambda i, own, other: F.struct((F.col("even") + i).alias("pair_id"), F.col(own).alias("own"), F.col(other).alias("other"))
    each = sides.select(F.explode(F.array(side(0, "a", "b"), side(1, "b", "a"))).alias("p")).select("p.*").filter(F.size("own") > 0)
    rejected = F.concat(F.slice("own", F.lit(1), F.size("own") - 1), F.slice("other", F.greatest(F.size("other"), F.lit(1)), F.lit(1)))
    return each.select("pair_id", F.col("own").alias("chosen"), rejected.alias("rejected"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, role, text FROM t WHERE i = n),
ids AS (SELECT conv_id, max(n) AS n FROM t GROUP BY conv_id),
m AS (
  SELECT ids.conv_id AS pair_id, ids.n,
         l.conv_id IS NOT NULL AND o.role = l.role AND o.text = l.text AS same, l.role AS r_role, l.text AS r_text, o.role AS c_role, o.text AS c_text
  FROM ids JOIN last o ON o.conv_id = ids.conv_id LEFT JOIN last l ON l.conv_id = xor(ids.conv_id, 1)),
p AS (
  SELECT m.pair_id, string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.i) AS prompt
  FROM m JOIN t ON t.conv_id = m.pair_id AND (t.i < m.n OR m.same) GROUP BY m.pair_id)
SELECT m.pair_id, CAST(m.n - CASE WHEN m.same THEN 0 ELSE 1 END AS INTEGER) AS n_common, coalesce(p.prompt, '') AS prompt,
  CASE WHEN m.same THEN '' ELSE '<|im_start|>' || c_role || chr(10) || c_text || '<|im_end|>' || chr(10) END AS chosen,
  CASE WHEN m.same OR r_role IS NULL THEN '' ELSE '<|im_start|>' || r_role || chr(10) || r_text || '<|im_end|>' || chr(10) END AS rejected,
  CASE WHEN m.same OR c_role <> 'assistant' THEN '' ELSE CAST(13 + length(c_role) AS VARCHAR) || '-' || CAST(24 + length(c_role) + length(c_text) AS VARCHAR) END AS chosen_mask,
  CASE WHEN m.same OR r_role IS NULL OR r_role <> 'assistant' THEN '' ELSE CAST(13 + length(r_role) AS VARCHAR) || '-' || CAST(24 + length(r_role) + length(r_text) AS VARCHAR) END AS rejected_mask
FROM m LEFT JOIN p ON p.pair_id = m.pair_id
"""
