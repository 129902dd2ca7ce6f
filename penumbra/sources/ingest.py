"""Inputs: kinds of files, decoding, and extractors that turn documents into text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import legacy, pdf
from .errors import EngineError, IngestError, RedactError, Unsupported
from .office import ZIPPED, from_csv, from_office, from_rtf, markdown_table
from .tables import by_size

__all__ = ["EXTRACTORS", "EngineError", "FORMATS", "IMAGES", "IngestError", "RedactError", "Unsupported", "check_request", "decoded", "extension", "extracted", "format_of", "from_csv", "from_office", "from_pdf", "from_rtf", "kind_of", "markdown_table", "read_files", "read_text", "write_bytes", "write_redacted"]

#: File name endings of document formats and images (case matters).
FORMATS = {"doc": "doc", "docx": "docx", "odt": "odt", "ppt": "ppt", "pptx": "pptx", "rtf": "rtf", "epub": "epub", "xls": "excel", "xlsx": "excel", "ods": "ods", "odp": "odp", "csv": "csv"}
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("path", F.input_file_name())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, kind, format) of any files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.withColumn("kind", kind_of(F.col("path"), F.col("content"))).withColumn("format", format_of(F.col("path")))


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def format_of(path: Column) -> Column:
    """Document format by file name, null for others."""
    table = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return table[extension(path)]


def kind_of(path: Column, content: Column) -> Column:
    """pdf by its first bytes or name, then image and document by name, else text."""
    end = extension(path)
    return F.when(F.startswith(content, F.lit(b"%PDF")) | (end == "pdf"), "pdf").when(end.isin(*IMAGES), "image").when(end.isin(*FORMATS), "document").otherwise("text")


def from_pdf(content: bytes) -> str:
    """The text layer as Markdown; a PDF that shows pictures only, or is broken, has none that can be read."""
    try:
        text = pdf.markdown(content)
        readable = text.strip() or not pdf.words(content)[2]
    except Exception as e:
        raise Unsupported(f"the PDF has no text layer that can be read: {e}") from e
    if not readable:
        raise Unsupported("the PDF has no text layer")
    return text


#: Extractors by format; others (from_pdf, an OCR) can be put in.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"csv": from_csv, "rtf": from_rtf} | {f: (lambda b, f=f: from_office(b, f)) for f in ZIPPED}
EXTRACTORS |= {"doc": legacy.from_doc, "ppt": legacy.from_ppt, "excel": lambda b: legacy.from_xls(b) if b.startswith(legacy.MAGIC) else from_office(b, "excel")}


def extracted(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, on_error: str = "raise") -> DataFrame:
    """The rows of read_files with text, markdown and error.

    Text files are decoded in the JVM; documents pass an extractor by format, PDFs and images one named pdf or image.
    on_error: "raise" fails the job; "column" leaves text null and gives the reason, never the raw content.
    """
    if on_error not in ("raise", "column"):
        raise ValueError("on_error is raise or column")
    use = EXTRACTORS | (extractors or {})
    is_text = F.col("kind").eqNullSafe("text")
    plain = files.filter(is_text).withColumn("text", decoded(F.col("content"))).withColumn("markdown", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    schema = T.StructType([*files.schema, *(T.StructField(c, T.StringType()) for c in ("text", "markdown", "error"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, "content"):
                texts, errors = [], []
                for kind, form, content in zip(*(part.column(c).to_pylist() for c in ("kind", "format", "content")), strict=True):
                    try:
                        key = form if kind == "document" else kind
                        if key not in use:
                            raise Unsupported(f"no extractor for {key}")
                        if content is None:
                            raise IngestError("no content")
                        texts.append(use[key](content))
                        errors.append(None)
                    except Exception as e:
                        if on_error == "raise":
                            raise
                        texts.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                more = [pa.array(x, pa.string()) for x in (texts, texts, errors)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "text", "markdown", "error"])

    return plain.unionByName(files.filter(~is_text).mapInArrow(run, schema))


def check_request(kind: str, output: str) -> None:
    """Refuses what cannot be done before any work: documents have no native output."""
    if output not in ("native", "markdown"):
        raise ValueError("output is native or markdown")
    if kind == "document" and output == "native":
        raise Unsupported("documents can be redacted to markdown only")


def write_redacted(df: DataFrame, path: str, text_col: str = "redacted", id_cols: tuple[str, ...] = ()) -> None:
    """A JSON object a line for each document: its ids and its text, with its line ends as they are."""
    df.select(F.to_json(F.struct(*id_cols, F.col(text_col).alias("text"))).alias("value")).write.mode("overwrite").text(path)


def write_bytes(df: DataFrame, path: str, name_col: str = "path", bytes_col: str = "redacted_bytes") -> None:
    """Parquet rows of (name, content) for each result that has bytes; named like the command's files."""
    name = F.concat(F.regexp_replace(F.col(name_col), r"\.[^./\\]+$", ""), F.lit(".redacted.out"))
    df.filter(F.col(bytes_col).isNotNull()).select(name.alias("name"), F.col(bytes_col).alias("content")).write.mode("overwrite").parquet(path)
