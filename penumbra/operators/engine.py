"""Files of any kind in one table: read, find, redact, each row by its kind.

Texts and office documents come out as masked text, images as images with black boxes, PDFs as PDFs of page images
(or all of them as masked Markdown). PDFs with a text layer are read here. What has no library here is put in by the
caller: an OCR, a PDF renderer, codecs for formats other than PNG and JPEG.

Finding is the same column expression for all kinds; only what must be done to pixels and files runs in Python, and
only for rows that need it. All of it is one plan of row-wise steps, in which an OCR reads each image and turn once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import let
from ..sources import pdf
from ..sources.errors import IngestError, Unsupported
from ..sources.ingest import EXTRACTORS, decoded
from ..sources.tables import by_size
from . import external, image, layout
from .detect import entities_of
from .mask import mask_bytes, mask_places

WORD = "struct<start:int,end:int,page:int,x:float,y:float,width:float,height:float>"
ENTITY = "struct<entity_type:string,start:int,end:int,score:float,source:string,bbox:" + layout.BOX + ">"
STRATEGIES = ("default", "documents", "layout")


@dataclass(frozen=True)
class Readers:
    """What turns files into texts, words with places and pixels.

    ocr(image) and pages(pdf) give words in reading order: dicts of word, page, x, y, width, height in 72 units an inch;
    `pages` gives (words, number of pages). pdf_text(pdf) gives the Markdown of a PDF's text layer, render(pdf, dpi) its
    pages' pixels. extractors by format add to those for office documents. PNG, JPEG, GIF and BMP are decoded here (the last two come out as PNG); pages of
    redacted PDFs are lossless, or JPEGs of page_quality.
    """

    ocr: Callable[[np.ndarray], list[dict]] | None = None
    pages: Callable[[bytes], tuple[list[dict], int]] | None = None
    pdf_text: Callable[[bytes], str] = pdf.markdown
    render: Callable[[bytes, int], list[np.ndarray]] | None = None
    decode: Callable[[bytes], np.ndarray] = image.decode
    encode: Callable[[np.ndarray, bytes], bytes] | None = None
    page_quality: int | None = None
    extractors: dict[str, Callable[[bytes], str]] = field(default_factory=dict)


def joined(words: list[dict]) -> tuple[str, list[tuple]]:
    """Words joined by one space (none before the first that isn't empty), and each word's place in bytes and box."""
    text, at, spans = [], 0, []
    for w in words:
        raw = w["word"].encode("utf-8", "replace")
        if at:
            text.append(" ")
            at += 1
        spans.append((at, at + len(raw), int(w.get("page", 1)), *(float(w[k]) for k in ("x", "y", "width", "height"))))
        text.append(w["word"])
        at += len(raw)
    return "".join(text), spans


class Columns:
    """A row's list of structs as a list a field."""

    __slots__ = ("of",)

    def __init__(self, *of: list):
        self.of = of

    def __len__(self) -> int:
        return len(self.of[0])

    def __iter__(self) -> Iterator[tuple]:
        return zip(*self.of, strict=True)


def array(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of rows' values, of which lists of structs may be Columns."""
    if not any(isinstance(v, Columns) for v in values):
        return pa.array(values, kind)
    if not all(v is None or isinstance(v, Columns) for v in values):
        return pa.array([list(v) if isinstance(v, Columns) else v for v in values], kind)
    there = [v for v in values if v is not None]
    ends = list(accumulate((0 if v is None else len(v) for v in values), initial=0))
    offsets = pa.array([*(None if v is None else at for v, at in zip(values, ends, strict=False)), ends[-1]], pa.int32())
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(v.of[i] for v in there)), f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(offsets, inner, type=kind)


def joined_columns(texts: list[str], *places: list) -> tuple[str, Columns]:
    """joined() for words that are not empty, as columns of their texts, pages, x, y, widths and heights."""
    text = " ".join(texts)
    sizes = list(map(len, texts)) if text.isascii() else [len(t.encode("utf-8", "replace")) for t in texts]
    ends = [e + i for i, e in enumerate(accumulate(sizes))]
    return text, Columns([e - n for e, n in zip(ends, sizes, strict=True)], ends, *places)


def own_pages(content: bytes, readers: Readers) -> tuple[str, Columns | list[tuple], int]:
    """A PDF's text, joined() words and number of pages by its text layer; pages that only show pictures are read by the OCR, which
    takes a renderer too. Without them such a page is refused, not passed on unread."""
    words, n, blind = pdf.placed(content)
    if not blind:
        return (*joined_columns(*words), n)
    if readers.ocr is None or readers.render is None:
        raise Unsupported(f"pages without a text layer ({', '.join(map(str, blind))}) need an OCR and a renderer")
    pictures = readers.render(content, layout.IMAGE_DPI)
    read_ = [{**w, "page": i} for i in blind for w in readers.ocr(pictures[i - 1])]
    named = [dict(zip(("word", "page", "x", "y", "width", "height"), w, strict=True)) for w in zip(*words, strict=True)]
    return (*joined(sorted(named + read_, key=lambda w: w["page"])), n)


def ingest_one(kind: str, format: str | None, content: bytes, readers: Readers, strategy: str, boxes: bool) -> tuple[str | None, str | None, Columns | list[tuple], int | None]:
    """(text, markdown, words, pages) of a file that is no plain text."""
    if kind == "image":
        if strategy == "documents":
            raise Unsupported("the documents strategy reads no images")
        if readers.ocr is None:
            raise Unsupported("images need an OCR")
        text, words = joined(readers.ocr(seen(content, readers, None)))
        return text, None, words, 1
    if kind == "pdf":
        if strategy == "documents" and boxes:
            raise Unsupported("the documents strategy gives no places in a PDF")
        if strategy != "layout" and not boxes:
            try:
                markdown = readers.pdf_text(content)
            except Exception:
                if strategy == "documents":
                    raise
                markdown = ""
            if markdown.strip() or strategy == "documents":
                return markdown, markdown, [], None
        if readers.pages is None:
            text, words, n = own_pages(content, readers)
        else:
            words, n = readers.pages(content)
            text, words = joined(words)
        return text, None, words, n
    if strategy == "layout":
        raise Unsupported("the layout strategy reads no documents")
    use = EXTRACTORS | readers.extractors
    if format not in use:
        raise Unsupported(f"no extractor for {format}")
    markdown = use[format](content)
    return markdown, markdown, [], None


#: What reading a file adds, with their Arrow types.
WORDS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("page", pa.int32()), *((c, pa.float32()) for c in ("x", "y", "width", "height"))]))
STATE = {"text": ("string", pa.string()), "markdown": ("string", pa.string()), "words": (f"array<{WORD}>", WORDS), "pages": ("int", pa.int32()), "error": ("string", pa.string())}


class Names:
    """Columns of the engine's own beside those of the files, whatever theirs are called."""

    def __init__(self, taken: list[str]):
        self.taken = {c.lower() for c in taken}

    def __getattr__(self, name: str) -> str:
        own = f"{name}__"
        while own.lower() in self.taken:
            own += "_"
        return own


def added(df: DataFrame, columns: dict[str, tuple[str, pa.DataType]], work: Callable[[tuple], tuple], inputs: list[str], size_of: str) -> DataFrame:
    """The rows with what work(inputs of a row) gives, a value a column; what is there passes through as it is. Rows go in
    runs of bounded bytes, and no result waits for another's."""
    schema = T.StructType([*df.schema, *(T.StructField(c, T._parse_datatype_string(t)) for c, (t, _) in columns.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, size_of):
                made = [work(row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                more = [array([m[i] for m in made], t) for i, (_, t) in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *columns])

    return df.mapInArrow(run, schema)


def told(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def seen(content: bytes, readers: Readers, degrees: float | None) -> np.ndarray:
    """An image's pixels, upright and turned; worked out from the file wherever they are needed, never kept."""
    picture = readers.decode(content)
    if (turn := image.exif_orientation(content)) and (turned := image.upright(picture, turn)) is not None:
        picture = turned
    if degrees is not None:
        picture = image.turned(picture, degrees) if degrees in (90, 180, 270) else image.slanted(picture[:, :, :3], degrees)
    return np.ascontiguousarray(picture)


def read(files: DataFrame, names: Names, readers: Readers, strategy: str = "default", boxes: bool = False) -> DataFrame:
    """The files with STATE. A file that can't be read, or has no kind, has an error and nothing else."""

    def work(row: tuple) -> tuple:
        kind, format, content = row
        try:
            if kind not in ("image", "pdf", "document"):
                raise Unsupported(f"files of kind {kind} can't be read")
            if content is None:
                raise IngestError("no content")
            return (*ingest_one(kind, format, content, readers, strategy, boxes), None)
        except Exception as e:
            return (None, None, None, None, told(e))

    return added(files, {getattr(names, c): t for c, t in STATE.items()}, work, ["kind", "format", "content"], "content")


@lru_cache(maxsize=64)
def _found(text: str, words: str, entities: tuple[str, ...] | None, score_threshold: float | None, context: int) -> Column:
    """Building the expression takes longer than planning it, so it is kept for columns' names and a session."""
    none, w = F.lit(None).cast(layout.BOX), F.col(words)
    struct = lambda e: F.struct(e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"), e["source"].alias("source"), none.alias("bbox"))
    all_ = F.transform(entities_of(text, None if entities is None else list(entities), score_threshold), struct)
    boxed = let(all_, lambda e: F.when(F.size(w) > 0, layout.boxes_of(e, w)).otherwise(e))
    return F.coalesce(boxed, F.array()).cast(f"array<{ENTITY}>")


def found_in(text: str, words: str, entities: list[str] | None, score_threshold: float | None) -> Column:
    """Entities of a text column with bytes, scores and the box around their words, if there are any."""
    return _found(text, words, None if entities is None else tuple(entities), score_threshold, id(SparkContext._active_spark_context))


#: Between texts of an image's turns: no pattern spans it, and no label's reach.
APART = "\n" * 64
TURN = f"struct<text:string,at:int,stop:int,words:array<{WORD}>>"
TURNS = pa.list_(pa.struct([("text", pa.string()), ("at", pa.int32()), ("stop", pa.int32()), ("words", WORDS)]))


def turned_until_found(df: DataFrame, names: Names, readers: Readers, entities, score_threshold) -> DataFrame:
    """Images without findings are turned and read again in the order of the ladder; the first turn that finds counts.

    Two steps of the plan, right angles and then slants: rows pass, and only an image that is still without findings is
    decoded and read, at each angle of the step. So nothing is kept, and an image's turn is a number until it is drawn.
    """
    text, words, found, angle, error = (F.col(getattr(names, c)) for c in ("text", "words", "found", "angle", "error"))
    df = df.withColumn(names.angle, F.lit(None).cast("double"))
    for ladder in ([d for d in image.LADDER if d in (90, 180, 270)], [d for d in image.LADDER if d not in (90, 180, 270)]):

        def again(row: tuple, ladder: list[float] = ladder) -> tuple:
            content, is_open = row
            own, text, words, at = [], [], [], 0
            for degrees in ladder if is_open else ():
                try:
                    one, spans = joined(readers.ocr(seen(content, readers, degrees)))
                except Exception:  # an angle that can't be read finds nothing
                    one, spans = "", []
                end = at + len(one.encode("utf-8", "replace"))
                own.append((one, at, end, spans))
                words += [(at + a, at + z, *rest) for a, z, *rest in spans]
                text.append(one + APART)
                at = end + len(APART)
            return "".join(text), words, own

        open_ = error.isNull() & (F.size(found) == 0)
        kinds = {names.text2: STATE["text"], names.words2: STATE["words"], names.turns: (f"array<{TURN}>", TURNS)}
        tried = added(df.withColumn(names.open, open_), kinds, again, ["content", names.open], "content")
        tried = tried.withColumn(names.found2, found_in(names.text2, names.words2, entities, score_threshold))
        # the first turn whose part of the text an entity lies in
        holds = F.transform(names.turns, lambda t: F.exists(names.found2, lambda e: (e["start"] >= t["at"]) & (e["start"] < t["stop"])))
        tried = tried.withColumn(names.first, F.coalesce(F.array_position(holds, True).cast("int"), F.lit(0)) - 1)
        hit, turn = F.col(names.first) >= 0, F.get(names.turns, F.col(names.first))
        own = F.filter(names.found2, lambda e: (e["start"] >= turn["at"]) & (e["start"] < turn["stop"]))
        moved = F.transform(own, lambda e: e.withField("start", e["start"] - turn["at"]).withField("end", e["end"] - turn["at"]))
        new = {names.text: (turn["text"], text), names.words: (turn["words"], words), names.found: (moved, found), names.angle: (F.get(F.array(*(F.lit(float(d)) for d in ladder)), F.col(names.first)), angle)}
        df = tried.select(*(c for c in df.columns if c not in new), *(F.when(hit, then).otherwise(was).alias(c) for c, (then, was) in new.items()))
    return df


def tiled(df: DataFrame, names: Names, readers: Readers, entities, score_threshold, grid: int, overlap: float) -> DataFrame:
    """Images are read a second time in overlapping tiles; what only tiles show is added, by place."""
    per = layout.UNITS / layout.IMAGE_DPI

    def tiles_of(row: tuple) -> tuple:
        content, degrees, error = row
        text, words, at = [], [], 0
        if error is not None:
            return "", []
        try:
            picture = seen(content, readers, degrees)
        except Exception:
            return "", []
        for x, y, w, h in image.cuts(picture.shape[1], picture.shape[0], grid, overlap):
            try:
                own, spans = joined(readers.ocr(np.ascontiguousarray(picture[y : y + h, x : x + w])))
            except Exception:  # one tile that can't be read leaves the others
                continue
            words += [(at + a, at + b, p, bx + x * per, by + y * per, bw, bh) for a, b, p, bx, by, bw, bh in spans]
            text.append(own + "\n")
            at += len(text[-1].encode("utf-8", "replace"))
        return "".join(text), words

    made = added(df, {names.text2: STATE["text"], names.words2: STATE["words"]}, tiles_of, ["content", names.angle, names.error], "content")
    made = made.withColumn(names.found2, found_in(names.text2, names.words2, entities, score_threshold))
    return made.withColumn(names.found, layout.merge_by_box(F.col(names.found), F.col(names.found2))).drop(names.text2, names.words2, names.found2)


GIVEN = pa.list_(pa.struct([("entity_type", pa.string()), ("cstart", pa.int32()), ("cend", pa.int32()), ("score", pa.float32())]))


def with_analyzer(df: DataFrame, names: Names, analyzer: external.Analyzer, language: str, entities, score_threshold) -> DataFrame:
    """What an external recognizer finds beside it, where nothing was found here."""

    def ask(row: tuple) -> tuple:
        if row[0] is None:
            return ([],)
        return ([(e["entity_type"], e["start"], e["end"], e["score"]) for e in analyzer([row[0]], language)[0]],)

    asked = added(df, {names.given: ("array<struct<entity_type:string,cstart:int,cend:int,score:float>>", GIVEN)}, ask, [names.text], names.text)
    given = F.col(names.given)
    if entities is not None:
        given = F.filter(given, lambda e: e["entity_type"].isin(*entities) if entities else F.lit(False))
    if score_threshold is not None:
        given = F.filter(given, lambda e: e["score"] >= F.lit(score_threshold).cast("float"))
    none, text, words, found = F.lit(None).cast(layout.BOX), F.col(names.text), F.col(names.words), F.col(names.found)

    def placed(s: Column) -> Column:
        ends = external.byte_places(text, F.concat(F.transform(s, lambda x: x["cstart"]), F.transform(s, lambda x: x["cend"])))
        made = lambda places: F.transform(s, lambda x, i: F.struct(x["entity_type"].alias("entity_type"), F.get(places, i).alias("start"), F.get(places, i + F.size(s)).alias("end"), x["score"].alias("score"), F.lit("TierB").alias("source"), none.alias("bbox")))
        return let(ends, made)

    free = let(let(given, placed), lambda more: external.apart(more, found))
    boxed = let(free, lambda e: F.when(F.size(words) > 0, layout.boxes_of(e, words)).otherwise(e))
    return asked.withColumn(names.found, F.concat(found, F.coalesce(boxed.cast(f"array<{ENTITY}>"), F.array().cast(f"array<{ENTITY}>")))).drop(names.given)


RESULTS = ["redacted_text", "redacted_markdown", "redacted_bytes", "page_count", "entities", "error", "output"]


def redact_texts(files: DataFrame, output: str, entities: list[str] | None, score_threshold: float | None) -> DataFrame:
    """Plain texts with their RESULTS: one projection, without Python, a shuffle or a kept step."""
    names = Names(files.columns)
    text = F.coalesce(F.col("text"), decoded(F.col("content"))) if "text" in files.columns else decoded(F.col("content"))
    none = lambda kind: F.lit(None).cast(kind)
    entity = lambda e: F.struct(e["entity_type"].alias("entity_type"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"), e["source"].alias("source"), none(layout.BOX).alias("bbox"))
    own = files.withColumn(names.text, text)
    made = let(entities_of(names.text, entities, score_threshold), lambda e: F.struct(mask_places(F.col(names.text), e).alias("text"), F.transform(e, entity).cast(f"array<{ENTITY}>").alias("entities")))
    done, made = own.withColumn(names.made, made), F.col(names.made)
    markdown = made["text"] if output == "markdown" else none("string")
    return done.select(
        *files.columns, made["text"].alias("redacted_text"), markdown.alias("redacted_markdown"), none("binary").alias("redacted_bytes"), none("int").alias("page_count"), made["entities"].alias("entities"),
        none("string").alias("error"), F.lit(output).alias("output"),
    )


def redact_files(
    files: DataFrame, output: str = "native", entities: list[str] | None = None, score_threshold: float | None = None, readers: Readers | None = None, strategy: str = "default",
    analyzer: external.Analyzer | None = None, language: str = "en", dpi: int = 150, grid: int = layout.TILE_GRID, overlap: float = layout.TILE_OVERLAP, on_error: str = "column",
) -> DataFrame:
    """Files (content, kind, format and any other columns; texts may have `text` instead of content) with their results.

    Adds output, redacted_text, redacted_markdown, redacted_bytes, page_count, entities (type, bytes, score, source and
    box; never matched text) and error. Native output of an image or PDF is bytes, of a text its text; documents have
    none and get an error, as do files that could not be read, have no kind or have an entity without a place. on_error
    "raise" fails the job instead. `grid` 1 or 0 turns off the second reading in tiles, 0 also the turning of images without
    findings. Files' own columns named like a result come back as input_ and their name.

    A plan of projections and row-wise steps: no job runs when it is built, no row is kept, joined or shuffled, each file is read
    once, and a table that is a stream gives a stream.
    """
    if output not in ("native", "markdown"):
        raise ValueError("output is native or markdown")
    if strategy not in STRATEGIES or on_error not in ("column", "raise"):
        raise ValueError(f"strategy is one of {STRATEGIES}, on_error column or raise")
    readers = readers or Readers()
    results = {c.lower() for c in RESULTS}
    for c in files.columns:
        if c.lower() in results:
            own = f"input_{c}"
            while own.lower() in {x.lower() for x in files.columns}:
                own += "_"
            files = files.withColumnRenamed(c, own)
    names, kind = Names(files.columns), F.col("kind")
    texts, pictures = files.filter(kind.eqNullSafe("text")), files.filter(kind.eqNullSafe("image"))
    others = files.filter(~kind.eqNullSafe("text") & ~kind.eqNullSafe("image"))
    pixels = output == "native"
    finish = lambda df, drawn: _finished(df, names, output, entities, score_threshold, readers, analyzer, language, dpi, on_error, drawn)
    if analyzer is None:  # texts need no Python
        done = redact_texts(texts, output, entities, score_threshold)
    else:
        text = F.coalesce(F.col("text"), decoded(F.col("content"))) if "text" in files.columns else decoded(F.col("content"))
        none = lambda c: F.lit(None).cast(STATE[c][0])
        plain = texts.select("*", text.alias(names.text), none("markdown").alias(names.markdown), F.array().cast(STATE["words"][0]).alias(names.words), none("pages").alias(names.pages), none("error").alias(names.error))
        done = finish(plain.withColumn(names.found, found_in(names.text, names.words, entities, score_threshold)), False)
    look = lambda df: df.withColumn(names.found, found_in(names.text, names.words, entities, score_threshold))
    shown = look(read(pictures, names, readers, strategy, pixels))
    if grid > 0 and readers.ocr:
        shown = turned_until_found(shown, names, readers, entities, score_threshold)
        if pixels and grid > 1:
            shown = tiled(shown, names, readers, entities, score_threshold, grid, overlap)
    if pixels:  # what is refused is told without being read
        done = done.unionByName(_refused(others.filter(kind.eqNullSafe("document")), "Unsupported: documents can be redacted to markdown only", output, on_error))
        others = others.filter(~kind.eqNullSafe("document"))
    rest = look(read(others, names, readers, strategy, pixels))
    return done.unionByName(finish(rest, pixels)).unionByName(finish(shown, pixels))


def _refused(files: DataFrame, reason: str, output: str, on_error: str) -> DataFrame:
    kinds = dict(zip(RESULTS, ("string", "string", "binary", "int", f"array<{ENTITY}>"), strict=False))
    error = F.lit(reason) if on_error == "column" else F.when(F.col("kind").isNotNull(), F.raise_error(F.lit(reason)).cast("string"))
    return files.select(*files.columns, *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), error.alias("error"), F.lit(output).alias("output"))


def _finished(df: DataFrame, names: Names, output: str, entities, score_threshold, readers: Readers, analyzer, language: str, dpi: int, on_error: str, drawn: bool) -> DataFrame:
    """RESULTS from what was read and found, in place of the engine's own columns. `drawn`: boxes are drawn, not texts masked."""
    own = [c for c in df.columns if c in {getattr(names, n) for n in (*STATE, "found", "angle", "open", "text2", "words2", "turns", "found2", "first")}]
    kept = [c for c in df.columns if c not in own]
    if analyzer:
        df = with_analyzer(df, names, analyzer, language, entities, score_threshold)
    found, failed = F.col(names.found), F.col(names.error)
    if drawn:
        homeless = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda e: e["bbox"].isNull()), lambda e: e["entity_type"]))), ", ")
        failed = F.coalesce(failed, F.when(homeless != "", F.concat(F.lit("Unsupported: no place on the page for entities of type "), homeless)))
        turn = F.col(names.angle) if names.angle in df.columns else F.lit(None).cast("double")

        def draw(row: tuple) -> tuple:
            kind, content, degrees, boxes, failed = row
            if failed is not None:
                return (None, None)
            return image.drawn(content, boxes, dpi if kind == "pdf" else layout.IMAGE_DPI, readers.encode, lambda b: seen(b, readers, degrees), readers.render, turned=True, quality=readers.page_quality)

        boxes = F.transform(found, lambda e: e["bbox"])
        df = df.select("*", turn.alias(names.turned), boxes.alias(names.boxes), failed.alias(names.failed))
        df = added(df, {names.bytes: ("binary", pa.binary()), names.drawing: ("string", pa.string())}, draw, ["kind", "content", names.turned, names.boxes, names.failed], "content")
        error, made = F.coalesce(names.failed, names.drawing), F.col(names.bytes)
        text = markdown = F.lit(None).cast("string")
    else:  # a file's Markdown, where it has one, is its text
        error, made = failed, F.lit(None).cast("binary")
        df = df.withColumn(names.masked, mask_bytes(F.col(names.text), found))
        text = F.col(names.masked)
        markdown = text if output == "markdown" else F.when(F.col(names.markdown).isNotNull(), text)
    if on_error == "raise":
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    good = F.col("error").isNull()
    done = df.withColumn("error", error)
    return done.select(
        *kept, F.when(good, text).alias("redacted_text"), F.when(good, markdown).alias("redacted_markdown"), F.when(good, made).alias("redacted_bytes"), F.col(names.pages).alias("page_count"),
        F.when(good, found).alias("entities"), "error", F.lit(output).alias("output"),
    )
