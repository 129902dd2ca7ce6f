"""Places of all matches of a pattern, without a UDF.

Matches are wrapped in a mark and the text is split at marks, so odd parts are matches and the lengths of the parts
before one are its place. U+0001 is the mark; where a text has it, U+0002 stands in for it while scanning, which no
pattern tells apart and which is as long.

Sums over all parts before one are kept for blocks of as many parts as there are blocks, so that n matches cost about
n times the root of n short steps, and copies of bytes, not of strings that grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import let
from .patterns import PATTERN, SCAN

MARK, STAND_IN = "\u0001", "\u0002"
SPAN = "struct<cstart:int,cend:int,start:int,end:int,value:string>"
#: Two counts in one number: characters times this, and bytes.
BOTH = 1 << 32
#: Characters of a block in which places are turned into bytes.
PLACES = 2048


def parts_of(text: Column, pattern: str, lead: str = "") -> Column:
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    marked = F.regexp_replace(safe, f"(?U)({lead})({pattern})", f"$1{MARK}$2{MARK}") if lead else F.regexp_replace(safe, f"(?U)({pattern})", f"{MARK}$1{MARK}")
    return F.split(marked, MARK, -1)


def before(items: Column, zero: Column, add: Callable[[Column, Column], Column], use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(upto), where upto(i) is the fold of the items before index i; `add` must also join two folds' results."""

    def blocked(width: Column) -> Column:
        # a slice copies the array it is taken from, so blocks are cut once and only they are sliced again
        blocks = F.transform(F.sequence(F.lit(0), F.size(items), width), lambda a: F.slice(items, a + 1, width))

        def heads(own: Column, ends: Column) -> Column:
            def upto(i: Column) -> Column:
                block = F.floor(i / width).cast("int")
                return F.aggregate(F.slice(F.get(own, block), F.lit(1), i - block * width), F.get(ends, block), add)

            return use(upto)

        sums = lambda own: F.aggregate(F.transform(own, lambda x: F.aggregate(x, zero, add)), F.array(zero), lambda seen, x: F.concat(seen, F.array(add(F.element_at(seen, -1), x))))
        return let(blocks, lambda own: let(sums(own), lambda ends: heads(own, ends)))

    return let((F.floor(F.sqrt(F.size(items))) + 1).cast("int"), blocked)


def first_where(items: Column, late: Callable[[Column], Column]) -> Column:
    """The first index at which `late` holds, where it holds for all after it; the number of items if for none."""
    middle = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(late(F.get(items, middle(s))), F.struct(s["lo"].alias("lo"), middle(s).alias("hi"))).otherwise(F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + 1.0)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi")), step, lambda s: s["lo"])


def find_all(text: Column, pattern: str, valid=None, lead: str = "") -> Column:
    """Array of SPAN for the leftmost matches that do not overlap, of those whose value is `valid`.

    What `lead` matches is read over before a match. Places are worked out only where a match is valid.
    """

    def of(parts: Column) -> Column:
        odd = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        kept = odd if valid is None else F.filter(odd, lambda i: valid(F.get(parts, i)))
        sized = F.transform(parts, lambda p: F.length(p) * F.lit(BOTH) + F.octet_length(p))

        def span(i: Column, at: Column) -> Column:
            value = F.get(parts, i)
            c, b = (at / BOTH).cast("int"), (at % BOTH).cast("int")
            return F.struct(c.alias("cstart"), (c + F.length(value)).alias("cend"), b.alias("start"), (b + F.octet_length(value)).alias("end"), value.alias("value"))

        def spans(mine: Column) -> Column:
            places = let(sized, lambda s: before(s, F.lit(0).cast("long"), lambda a, x: a + x, lambda upto: F.transform(mine, lambda i: let(upto(i), lambda at: span(i, at)))))
            return F.when(F.size(mine) > 0, places).otherwise(F.array().cast(f"array<{SPAN}>"))

        return let(kept, spans)

    return let(parts_of(text, pattern, lead), of)


def form_of(entity_type: str, pattern: str) -> tuple[str, str]:
    return SCAN[entity_type] if entity_type in SCAN and PATTERN[entity_type] == pattern else ("", pattern)


def scan(text: Column, entity_type: str, pattern: str, valid=None) -> Column:
    """find_all for a type's pattern, by the form in SCAN that long texts allow; other patterns are taken as they are."""
    lead, own = form_of(entity_type, pattern)
    return find_all(text, own, valid, lead)


def scanned_values(text: Column, entity_type: str, pattern: str) -> Column:
    """The values of scan(), valid or not, for which no places are worked out."""
    lead, own = form_of(entity_type, pattern)
    return F.filter(parts_of(text, own, lead), lambda _, i: i % 2 == 1)


def byte_places(text: Column, places: Column) -> Column:
    """Bytes before places given in characters, held within the text; one for each, in their order."""

    def of(blocks: Column, held: Column) -> Column:
        def at(c: Column, upto) -> Column:
            block = F.floor(c / PLACES).cast("int")
            return (upto(block) + F.octet_length(F.substr(F.coalesce(F.get(blocks, block), F.lit("")), F.lit(1), c - block * PLACES))).cast("int")

        sized = F.transform(blocks, F.octet_length)
        return let(sized, lambda s: before(s, F.lit(0), lambda a, x: a + x, lambda upto: F.transform(held, lambda c: at(c, upto))))

    def sized(n: Column) -> Column:
        held = F.transform(places, lambda c: F.least(F.greatest(c, F.lit(0)), n))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PLACES)), lambda i: F.substr(text, i, F.lit(PLACES)))
        return F.when(n == F.octet_length(text), held).otherwise(let(blocks, lambda b: let(held, lambda h: of(b, h))))

    return F.when(F.size(places) == 0, F.array().cast("array<int>")).otherwise(let(F.length(text), sized))


def byte_offset(text: Column, chars: Column) -> Column:
    """Bytes before a place given in characters; beyond the text's end, its length."""
    return F.octet_length(F.substr(text, F.lit(1), F.greatest(chars, F.lit(0))))


def snapped(raw: Column, place: Column) -> Column:
    """A place in a text's bytes (binary), held within them and moved back to the start of a character."""
    held = F.least(F.greatest(place, F.lit(0)), F.octet_length(raw))
    inside = lambda n: (n > 0) & (n < F.octet_length(raw)) & F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^[89AB]")
    return let(held, lambda n: F.when(~inside(n), n).when(~inside(n - 1), n - 1).when(~inside(n - 2), n - 2).otherwise(n - 3))


def char_offset(text: Column, place: Column) -> Column:
    """Characters before a byte place, which is first snapped."""
    return F.length(F.substring(text.cast("binary"), F.lit(1), snapped(text.cast("binary"), place)).cast("string"))
