"""What the operators share: table reading, shared-folder tables, Arrow map stages."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r; bytes.split() splits at just these.
WORD = r"[^\x20\x09-\x0D]+"

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Tables of this driver that are there still: path, and the name in the catalogue of those that have one.
_written: dict[str, tuple[SparkSession, str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that the context was given.

    Without either a local master gets checkpoints beside its warehouse; a cluster must name a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _drop(path: str) -> None:
    spark, name = _written.pop(path)
    if name is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path in _written:
            _drop(path)


def tables_there() -> set[str]:
    """Paths of the written tables that haven't been released."""
    return set(_written)


def release_unread(paths: set[str], docs: DataFrame) -> None:
    """Deletes those of the written tables at paths that docs doesn't read."""
    here = paths & _written.keys()
    read = docs.inputFiles() if here else ()
    for path in here:
        if not any(path in f for f in read):
            _drop(path)


def _clean() -> None:
    for path in list(_written):
        try:
            _drop(path)
        except Exception:  # noqa: S112  the session may be gone at exit; the other tables may have another
            continue


atexit.register(_clean)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is; no other plan reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    The table goes when it is released, or else when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path], out.written_path = (spark, None), path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The same, bucketed by key, so that what groups by it later reads the table without a shuffle."""
    spark = df.sparkSession
    made = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{made}"
    with tidy(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(made)
    out = spark.table(made)
    _written[path], out.written_path = (spark, made), path
    return out


def running(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with {name}_before and {name}_all: value summed over the rows of the same group that come before, and over all of its rows.

    Ranges of (by, order) hold about as many rows each, however common a group or a row is; what meets in one window is a
    range's rows of one group, or a group's sums by range. by must hold no nulls. Rows equal in by and order follow each other
    in any order."""
    keys = [*(F.col(c).asc() for c in by), *order, F.col("__tie").asc()]
    ranges = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    there = written(ranges.withColumn("__value", value).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), f"{name}-ranges")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = there.withColumn("__local", F.sum("__value").over(upto(Window.partitionBy(*by, "__part").orderBy("__at"))) - F.col("__value"))
    sums = there.groupBy(*by, "__part").agg(F.sum("__value").alias("__sum"))
    first = F.sum("__sum").over(upto(Window.partitionBy(*by).orderBy("__part"))) - F.col("__sum")
    sums = sums.select(*by, "__part", first.alias("__first"), F.sum("__sum").over(Window.partitionBy(*by)).alias(f"{name}_all"))
    out = local.join(sums, [*by, "__part"])
    return out.withColumn(f"{name}_before", F.col("__local") + F.col("__first")).select(*df.columns, f"{name}_before", f"{name}_all")


def trim() -> None:
    """Gives memory that Python has freed back to the system, where the C library can; workers live on between tasks."""
    gc.collect()
    if _trim is not None:
        _trim(0)


#: Rows, and bytes of a text column, that a worker turns into Python objects at a time; a longer text goes alone.
ROWS, BYTES = 1000, 8_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most ROWS rows and about BYTES bytes."""
    if batch.num_rows <= ROWS and batch.nbytes <= BYTES:
        if batch.num_rows:
            yield batch
        return
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_list(column.type):
            offsets = np.frombuffer(column.buffers()[1], np.int32, batch.num_rows + 1, column.offset * 4).astype(np.int64)
            width = 1 if not pa.types.is_list(column.type) else max(1, column.values.nbytes // max(1, len(column.values)))
            size += np.diff(offsets) * width
    total = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = min(start + ROWS, max(start + 1, int(np.searchsorted(total, before + BYTES, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """function on each Arrow batch of df, in slices that bound a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield function(part)
        trim()

    return df.mapInArrow(run, schema)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """df in no fewer partitions than the session's parallelism, so that one file doesn't make one task."""
    parallel = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parallel else df.repartition(parallel)


def unused(df: DataFrame, name: str) -> str:
    """name, or what of it with underscores no column of df is called."""
    while name in df.columns:
        name += "_"
    return name


def held_out(modulus: int, remainder: int, column: str = "doc_id"):
    """crc32 of the id's text against a remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
