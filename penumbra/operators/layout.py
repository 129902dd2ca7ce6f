"""Layout: texts assembled from word boxes, boxes of spans, boxes of the same thing found twice, tiles and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import let
from ..functions.spans import first_where

BOX = "struct<page:int,x:float,y:float,width:float,height:float>"
#: Text units of an inch, and the resolution at which images are read.
UNITS, IMAGE_DPI = 72, 150
TILE_GRID, TILE_OVERLAP = 2, 0.15


def assemble(words: DataFrame, id_cols: list[str], order: list[str], word_col: str = "word") -> tuple[DataFrame, DataFrame]:
    """(texts, words with start and end): words joined by one space in order; spans in bytes and characters.

    No space precedes the first word that is not empty, so empty words at the start add nothing.
    """
    w = Window.partitionBy(*id_cols).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    filled = F.sum(F.length(word_col)).over(before) > 0
    gap = F.when(F.coalesce(filled, F.lit(False)), 1).otherwise(0)
    sized = words.withColumn("gap_", gap)
    bytes_, chars = F.octet_length(word_col), F.length(word_col)
    start = lambda size: (F.coalesce(F.sum(size + F.col("gap_")).over(before), F.lit(0)) + F.col("gap_")).cast("int")
    spans = sized.withColumn("start", start(bytes_)).withColumn("end", F.col("start") + bytes_).withColumn("cstart", start(chars)).withColumn("cend", F.col("cstart") + chars)
    piece = F.concat(F.repeat(F.lit(" "), F.col("gap_")), F.col(word_col))
    keys = F.struct(*(F.col(c) for c in order), piece.alias("piece"))
    texts = spans.groupBy(*id_cols).agg(F.array_join(F.transform(F.array_sort(F.collect_list(keys)), lambda k: k["piece"]), "").alias("text"))
    return texts, spans.drop("gap_")


def union_boxes(spans: DataFrame, words: DataFrame, id_cols: list[str], span_key: list[str]) -> DataFrame:
    """The spans with bbox: the box around all words they overlap on the page of the first of them; null if none.

    `words` has idx, start, end, page, x, y, width, height. A bbox that is already there is kept.
    """
    w = words.select(*(F.col(c).alias(f"w_{c}") for c in id_cols), F.col("idx"), F.col("start").alias("ws"), F.col("end").alias("we"), "page", *(F.col(c).cast("float").alias(c) for c in ("x", "y", "width", "height")))
    s = spans.select(*id_cols, *(c for c in span_key if c not in id_cols), "start", "end").distinct()
    on = [s[c].eqNullSafe(w[f"w_{c}"]) for c in id_cols] + [s["start"] < w["we"], w["ws"] < s["end"]]
    keys = list(dict.fromkeys([*id_cols, *span_key, "start", "end"]))
    hit = s.join(w, on)
    by_page = hit.groupBy(*keys, "page").agg(F.min("idx").alias("first"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"))
    box = F.struct(F.col("page").cast("int").alias("page"), F.col("x"), F.col("y"), (F.col("r") - F.col("x")).cast("float").alias("width"), (F.col("b") - F.col("y")).cast("float").alias("height"))
    boxes = by_page.groupBy(*keys).agg(F.min_by(box, "first").alias("box_"))
    joined = spans.join(boxes, keys, "left")
    own = F.coalesce("bbox", "box_") if "bbox" in spans.columns else F.col("box_")
    return joined.withColumn("bbox", own.cast(BOX)).drop("box_")


def boxes_of(spans: Column, words: Column) -> Column:
    """An array of spans with bbox: union_boxes() within a row, from its words (structs with start, end, page, x, y,
    width, height in reading order). A bbox that is already there is kept.

    Words' places ascend, so a span's words are a run, whose ends are searched for; only the run is looked at.
    """

    def box(hit: Column) -> Column:
        own = F.filter(hit, lambda w: w["page"] == F.get(hit, F.lit(0))["page"])
        low = lambda c: F.array_min(F.transform(own, lambda w: w[c]))
        high = lambda c, size: F.array_max(F.transform(own, lambda w: (w[c] + w[size]).cast("float")))
        made = F.struct(F.get(hit, F.lit(0))["page"].cast("int").alias("page"), low("x").alias("x"), low("y").alias("y"), (high("x", "width") - low("x")).cast("float").alias("width"), (high("y", "height") - low("y")).cast("float").alias("height"))
        return F.when(hit.isNotNull(), made).cast(BOX)

    def placed(s: Column) -> Column:
        ends = F.struct(first_where(words, lambda w: w["end"] > s["start"]).alias("a"), first_where(words, lambda w: w["start"] >= s["end"]).alias("z"))
        hit = let(ends, lambda x: F.when(x["a"] < x["z"], F.transform(F.sequence(x["a"], x["z"] - 1), lambda i: F.get(words, i))))
        return s.withField("bbox", F.coalesce(s["bbox"], let(hit, box)))

    return F.transform(spans, placed)


def unplaceable(spans: DataFrame, id_cols: list[str]) -> DataFrame:
    """(ids, types): the distinct sorted types of entities without a box."""
    return spans.filter(F.col("bbox").isNull()).groupBy(*id_cols).agg(F.array_sort(F.collect_set("entity_type")).alias("types"))


def placed(spans: DataFrame) -> DataFrame:
    """The spans; running it fails, naming the type, where one has no box, since pixels could not be hidden."""
    told = F.concat(F.lit("no place on the page for an entity of type "), F.col("entity_type"))
    return spans.withColumn("bbox", F.when(F.col("bbox").isNull(), F.raise_error(told).cast(BOX)).otherwise(F.col("bbox")))


def centre_inside(new: Column, old: Column) -> Column:
    cx, cy = new["x"] + new["width"] / 2, new["y"] + new["height"] / 2
    return (new["page"] == old["page"]) & cx.between(old["x"], old["x"] + old["width"]) & cy.between(old["y"], old["y"] + old["height"])


def merge_by_box(found: Column, tiled: Column) -> Column:
    """`found` and those of `tiled` whose box's centre lies in no box of the same type so far; boxless ones are left out.

    Both are arrays of structs with entity_type and bbox; one counts against what was added before it.
    """

    def add(acc: Column, e: Column) -> Column:
        seen = F.exists(acc, lambda o: (o["entity_type"] == e["entity_type"]) & F.coalesce(centre_inside(e["bbox"], o["bbox"]), F.lit(False)))
        return F.when(e["bbox"].isNull() | seen, acc).otherwise(F.concat(acc, F.array(e)))

    return F.aggregate(tiled, found, add)


def tiles(width: Column, height: Column, grid: int = TILE_GRID, overlap: float = TILE_OVERLAP) -> Column:
    """Array of (row, col, x, y, width, height): a grid of tiles that reach over their neighbours; grid 1 is the whole.

    Sides and overlaps are whole pixels, cut toward zero, so the last pixels of a size that the grid doesn't divide are
    in no tile but by overlap.
    """
    grid = max(1, grid)

    def tile(i: Column) -> Column:
        row, col = F.floor(i / grid), i % grid

        def side(n: Column, size: Column) -> tuple[Column, Column]:
            step = F.floor(size / grid).cast("int")
            extra = (step.cast("float") * F.lit(overlap).cast("float")).cast("int")
            low = F.greatest(n * step - extra, F.lit(0)).cast("int")
            return low, (F.least((n + 1) * step + extra, size) - low).cast("int")

        x, w = side(col, width)
        y, h = side(row, height)
        return F.struct(row.cast("int").alias("row"), col.cast("int").alias("col"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), tile), lambda t: (t["width"] > 0) & (t["height"] > 0))


def shifted(box: Column, left: Column, top: Column, dpi: int = IMAGE_DPI) -> Column:
    """A box read in a tile at (left, top) pixels, in units of the whole image."""
    per = UNITS / dpi
    return F.struct(box["page"].alias("page"), (box["x"] + left * per).cast("float").alias("x"), (box["y"] + top * per).cast("float").alias("y"), box["width"].alias("width"), box["height"].alias("height"))


def pixels(box: Column, width: Column, height: Column, dpi: Column | int) -> Column:
    """The pixel rectangle (x0, y0, x1, y1) of a box on an image: scaled, cut toward zero, held to the image."""
    scale = (F.lit(dpi) if isinstance(dpi, int) else dpi).cast("float") / F.lit(float(UNITS)).cast("float")
    low = lambda v: F.greatest((v * scale).cast("float"), F.lit(0).cast("float")).cast("int")
    high = lambda v, most: F.least(F.greatest((v * scale).cast("float"), F.lit(0).cast("float")).cast("int"), most.cast("int"))
    return F.struct(low(box["x"]).alias("x0"), low(box["y"]).alias("y0"), high(box["x"] + box["width"], width).alias("x1"), high(box["y"] + box["height"], height).alias("y1"))
