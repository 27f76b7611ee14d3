"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of this driver that are there still.
_kept: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a local master without either gets one beside its warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _kept[path] = spark
    return path


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table in the shared folder, until the driver's Python ends."""
    path = scratch(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows in no fewer partitions than the session works on at a time, so that one small file doesn't make one task."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= parallel else rows.repartition(parallel)


def _clean() -> None:
    for path, spark in _kept.items():
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: S112  the session may be gone at exit
            continue


atexit.register(_clean)
