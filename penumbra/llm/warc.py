"""WARC archives of captured pages and their merged capture index.

Writing: pairs of payload digest and page id are counted (partially before the shuffle) and the smallest id of a payload
stands for it; the others of at least 100 bytes become revisit records without a payload. Every record is a gzip member
of its own, so an index entry's position is where a reader can start. Archives go through Spark's own writer: any store
that Spark can write works and a lost task's archives are written anew. An archive ends at a bound of bytes or records.

Reading: members are inflated one by one and records parsed by their length fields only, never by searching for marks
that a payload may hold; a worker holds one archive as stored and one record.

Index: the entries of an archive, sorted by (URL key, capture time, page id), are a run. Splitters from a sample that is
a small fixed part of the entries cut each run into slices; a slice is one packed row. All slices of a key range meet
in one task, which merges them with a loser tree; range and place within it are the global order. A URL that holds many
captures is split by time and page id.

Cases: a null html is an empty payload; a null url is an empty one; a very long html is a record, and an archive, of its
own; rows that repeat a page id are records each, of which equal payloads still refer to the smallest id (record names
hold the digest, and a random part where page and payload repeat); a payload whose pages all lack an id is always a
response; further columns are ignored; an empty table gives an empty index. Tables without a capture time get one that
counts seconds by page id.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, parts, shared_folder

LEAST_BYTES = 100
#: Records of one archive, and bytes of them before compression, at most; a longer record is an archive by itself.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1000, 32_000_000
#: Entries of a key range, about; each range is one merge task, which holds them.
RANGE_ROWS = 100_000
#: Keys that the driver samples for each key range.
SAMPLE_A_RANGE = 16
#: Entries of one packed slice of a run, at most.
SLICE = 20_000
#: Compressed bytes read ahead at once.
AHEAD = 1 << 16
END = "\r\n"

ENTRY = ["urlkey", "captured", "page_id", "url", "archive", "position", "record_bytes", "record_type", "payload_bytes", "payload_digest", "refers_to"]
ENTRY_SCHEMA = "urlkey string, captured string, page_id long, url string, archive string, position long, record_bytes long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """A key that sorts a host's pages together: reversed host labels, then path and query, in lower case."""
    try:
        seen = urlsplit((url or "").strip())
        host, port = (seen.hostname or ""), seen.port
    except ValueError:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    usual = {"http": 80, "https": 443}.get(seen.scheme)
    return (",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, usual) else "") + ")" + (seen.path or "/") + (f"?{seen.query}" if seen.query else "")).lower()


def records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to, repeats): null refers_to for responses."""
    src = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload")).withColumns({"payload_digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload").cast("long")})
    pairs = src.groupBy("payload_digest", "page_id").agg(F.max("payload_bytes").alias("bytes_"), F.count("*").alias("rows_"))
    chosen = pairs.filter(F.col("bytes_") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("payload_digest", "first")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    notes = cut(pairs.join(chosen, "payload_digest", "left").select(F.col("page_id").alias("page_"), F.col("payload_digest").alias("digest_"), first.alias("first"), (F.col("rows_") > 1).alias("again")).filter("first is not null or again"))
    on = src["page_id"].eqNullSafe(notes["page_"]) & (src["payload_digest"] == notes["digest_"])
    return src.join(notes, on, "left").select("page_id", "url", F.when(F.col("first").isNull(), F.col("payload")).otherwise("").alias("payload"), "payload_bytes", "payload_digest", F.col("first").alias("refers_to"), F.coalesce("again", F.lit(False)).alias("repeats"))


def members(records: list[bytes]) -> bytes:
    """Records as gzip members, one after the other."""
    out = []
    for r in records:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [squeeze.compress(r), squeeze.flush()]
    return b"".join(out)


#: A member of nothing. A member ends with its length's highest byte, which is zero below 16 MiB; this one's always is.
NOTHING = members([b""])


def write_archives(pages: DataFrame, folder: str) -> None:
    """A record for each row into .warc parts below `folder`."""
    r = records(pages)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    revisit = F.col("refers_to").isNotNull()
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(4_000_000_000)) + 946_684_800
    date = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    one_line = F.regexp_replace("url", "[\\r\\n]", "")
    name = lambda p, *more: F.concat(F.lit("<urn:page:"), p, F.lit(":"), F.substring("payload_digest", 1, 16), *more, F.lit(">"))
    again = F.when(F.col("repeats"), F.concat(F.lit(":"), F.uuid())).otherwise("")
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(page, again)),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), one_line),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to").cast("string")), F.lit(END + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length("payload")),
    ]
    # concat_ws leaves nulls out
    text = F.concat(F.concat_ws(END, *fields), F.lit(END * 2), F.col("payload"), F.lit(END * 2))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([members(held) + NOTHING], pa.binary())], ["value"])
        for b in batches:
            for r in b.column("value"):
                r = r.as_py()
                if held and (len(held) >= ARCHIVE_RECORDS or size + len(r) > ARCHIVE_BYTES):
                    yield done()
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield done()

    # a row is an archive; its last byte, a zero, is the separator that the writer adds
    rows = r.select(text.cast("binary").alias("value")).mapInArrow(archive, "value binary")
    whole = F.col("value").substr(F.lit(1), F.length("value") - 1).cast("string")
    rows.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\0").option("compression", "none").text(folder)


def parsed(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(position, stored bytes, header fields, block) of each record of an archive."""
    at, whole = 0, memoryview(content)
    while at < len(whole):
        inflate, begin, data = zlib.decompressobj(31), at, []
        while not inflate.eof:
            if at >= len(whole):
                raise ValueError(f"the record at {begin} has no end")
            data.append(inflate.decompress(whole[at : at + AHEAD]))
            at += len(whole[at : at + AHEAD])
        at -= len(inflate.unused_data)
        if not (record := b"".join(data)):
            continue
        head = record.index(b"\r\n\r\n")
        version, *lines = record[:head].decode("utf-8", "replace").split(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {begin}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        end = head + 4 + int(fields["Content-Length"])
        if record[end:] != b"\r\n\r\n":
            raise ValueError(f"the record at {begin} has no end")
        yield begin, at - begin, fields, record[head + 4 : end]


def read_archives(spark: SparkSession, folder: str, with_block: bool = False) -> DataFrame:
    """The entries of all archives, an archive's sorted as one run; digests of responses are taken from their blocks."""


    def page(name: str) -> int | None:
        own = name.split(":")[2]
        return None if own == "none" else int(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows = []
                for at, stored, f, block in parsed(content.as_py()):
                    back = f.get("WARC-Refers-To")
                    digest = hashlib.sha256(block).hexdigest()
                    if not back and f"sha256:{digest}" != f["WARC-Payload-Digest"]:
                        raise ValueError(f"the block at {at} of {path} isn't what was written")
                    url = f["WARC-Target-URI"]
                    rows.append((url_key(url), re.sub(r"\D", "", f["WARC-Date"]), page(f["WARC-Record-ID"]), url, path.rsplit("/", 1)[-1], at, stored, f["WARC-Type"], int(f["X-Payload-Length"]) if back else len(block), f["WARC-Payload-Digest"][7:] if back else digest, page(back) if back else None) + ((block.decode("utf-8", "replace"),) if with_block else ()))
                rows.sort(key=_order)
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = ENTRY + ["block"] * with_block
    texts = {"urlkey", "captured", "url", "archive", "record_type", "payload_digest", "block"}
    schema = pa.schema([(n, pa.string() if n in texts else pa.int64()) for n in names])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).select("path", "content")
    return files.mapInArrow(run, ENTRY_SCHEMA + ", block string" * with_block)


def _order(entry: tuple) -> tuple:
    """URL key by code point, capture time, page id (none first), then place."""
    return entry[0].encode("utf-8", "replace"), entry[1], -(2**63) if entry[2] is None else entry[2], entry[4], entry[5]


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple]:
    """One sorted sequence from sorted ones: a winner is replaced along its path to the root, a comparison a level."""
    k = len(runs)
    heads, tops = [iter(r) for r in runs], []
    for h in heads:
        e = next(h, None)
        tops.append(None if e is None else (_order(e), e))
    beats = lambda i, j: tops[j] is None or (tops[i] is not None and tops[i][0] <= tops[j][0])
    lost, won = [0] * k, list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        i, j = won[2 * node] if 2 * node < k else 2 * node - k, won[2 * node + 1] if 2 * node + 1 < k else 2 * node + 1 - k
        won[node], lost[node] = (i, j) if beats(i, j) else (j, i)
    best = won[1] if k > 1 else 0
    while k and tops[best] is not None:
        yield tops[best][1]
        e = next(heads[best], None)
        tops[best] = None if e is None else (_order(e), e)
        node = (best + k) // 2
        while node:
            if not beats(best, lost[node]):
                best, lost[node] = lost[node], best
            node //= 2


def merged_index(entries: DataFrame, rows: int) -> DataFrame:
    """Entries in global order: partitions by key range, each merged from its runs; range_ and nth_ tell the place.

    `entries` must come from read_archives without blocks: all rows of an archive together and sorted.
    """
    spark = entries.sparkSession
    ranges = max(parts(spark), rows // RANGE_ROWS)
    share = min(1.0, SAMPLE_A_RANGE * ranges / max(1, rows))
    keys = ["urlkey", "captured", "page_id", "archive", "position"]
    sample = entries.select(*keys).filter(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    got = sorted(_order((r[0], r[1], r[2], None, r[3], r[4])) for r in sample.collect())
    splits = [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_right

        for batch, f in enumerate(batches):  # a batch may end within a run; each part is a sorted run too
            f = f.astype({"page_id": "Int64", "refers_to": "Int64"})
            for archive, run in f.groupby("archive", sort=False):
                rows_ = [tuple(None if v is pd.NA else v for v in r) for r in run[ENTRY].astype(object).itertuples(index=False)]
                place = [bisect_right(splits, _order(r)) for r in rows_]
                out, at = [], 0
                while at < len(rows_):
                    end = min(bisect_right(place, place[at]), at + SLICE)
                    out.append((place[at], f"{archive} {batch}", at, pickle.dumps(rows_[at:end])))
                    at = end
                yield pd.DataFrame(out, columns=["range_", "run", "first", "slice"])

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["run", "first"])
        runs = [[e for s in g for e in pickle.loads(s)] for _, g in f.groupby("run", sort=True)["slice"]]  # noqa: S301
        out = pd.DataFrame(list(loser_tree(runs)), columns=ENTRY).astype({"page_id": "Int64", "refers_to": "Int64"})
        return out.assign(range_=key[0], nth_=np.arange(len(out)))

    packed = entries.mapInPandas(slices, "range_ int, run string, first long, slice binary")
    return packed.groupBy("range_").applyInPandas(merge, ENTRY_SCHEMA + ", range_ int, nth_ long")


def captures(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, read the archives back and merge their index.

    Archives stay in `folder`; without one they are written to the shared folder and go once they have been read.
    """
    spark = pages.sparkSession
    at = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, at)
    entries = cut(read_archives(spark, at))
    if folder is None:
        delete(spark, at)
    return merged_index(entries, entries.count())
