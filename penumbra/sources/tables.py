"""Tables of a folder, dealt so that all cores have work, and rows kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scans of more splits than this many for each core are never dealt anew.
FEW_SPLITS = 4
#: Rows and bytes of a column that a worker holds at once; one longer value is held by itself.
SLICE_ROWS, SLICE_BYTES = 1000, 4_000_000


def by_size(batch: pa.RecordBatch, column: str | int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values stay under `size` bytes together."""
    lo = held = 0
    for hi, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if hi > lo and (held + n > size or hi - lo >= rows):
            yield batch.slice(lo, hi - lo)
            lo, held = hi, 0
        held += n
    if lo < batch.num_rows:
        yield batch.slice(lo)


def table(spark: SparkSession, folder: str, name: str, costly: bool = False) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"), costly)


def spread(scan: DataFrame, costly: bool = False) -> DataFrame:
    """The rows of a plain scan; dealt anew where its few splits would leave cores idle.

    A file of one row group is one task however many splits it has. Only scans with few splits are looked at, by
    counting rows a split, which reads file footers alone; scans of large tables stay as they are, without a shuffle.
    `costly`: a row takes far longer than moving it, so few splits are always dealt, since 8 on 6 cores take two turns.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > FEW_SPLITS * cores:
        return scan
    rows = [n for _, n in scan.groupBy(F.spark_partition_id()).count().collect()]
    if sum(rows) <= cores or not costly and 2 * len(rows) >= cores:
        return scan
    return scan.repartition((FEW_SPLITS if costly else 2) * cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Only where the setting is absent and Spark runs in one process (tests) does a local folder stand in for it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="penumbra-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder; survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete what `cut` wrote for these rows, once nothing reads them any more."""
    kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        delete(df.sparkSession, kept.get())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
