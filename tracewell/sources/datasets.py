"""Datasets with declared roles: JSON lines, Parquet or rows in memory; checks, and the example index."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracewell.functions import canonical as C
from tracewell.operators.rows import require

MOST_BYTES = 1 << 31
INDEX_COLUMNS = ["example_id", "prompt", "completion", "labels_json", "metadata_json", "sample_weight", "reserved_noop", "source", "source_row"]


@dataclass(frozen=True)
class Roles:
    """Which fields play which role. labels None: a field named labels if there is one; () gives an empty object."""

    prompt: str = "prompt"
    completion: str = "completion"
    labels: tuple[str, ...] | None = None
    metadata: tuple[str, ...] | None = None
    weight: str | None = "sample_weight"


def _object(rows: DataFrame, names: Iterable[str], nulls: bool) -> Column:
    """A canonical JSON object of the fields."""
    names = [n for n in names if nulls or n in rows.columns]
    if not names:
        return F.lit("{}")
    fields = [(F.col(n) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in names]
    return C.canonical_column(F.struct(*fields), StructType([rows.schema[n] if n in rows.columns else StructField(n, StringType()) for n in names]))


def project_roles(rows: DataFrame, roles: Roles, row: str) -> DataFrame:
    """row, prompt, completion, labels_json, metadata_json, sample_weight; undeclared fields are left out."""
    labels = (_json_field(rows, "labels") if "labels" in rows.columns else F.lit("null")) if roles.labels is None else _object(rows, roles.labels, True)
    metadata = (F.coalesce(_json_field(rows, "metadata"), F.lit("{}")) if "metadata" in rows.columns else F.lit("{}")) if roles.metadata is None else _object(rows, roles.metadata, False)
    weight = F.coalesce(F.col(roles.weight).cast("double"), F.lit(1.0)) if roles.weight and roles.weight in rows.columns else F.lit(1.0)
    return rows.select(F.col(row), F.col(roles.prompt).alias("prompt"), F.col(roles.completion).alias("completion"), F.coalesce(labels, F.lit("null")).alias("labels_json"), metadata.alias("metadata_json"), weight.alias("sample_weight"))


def _json_field(rows: DataFrame, name: str) -> Column:
    """A field as canonical JSON; null where it is."""
    return F.when(F.col(name).isNotNull(), C.canonical_column(F.col(name), rows.schema[name].dataType))


def reason() -> Column:
    """Why a row of prompt, completion, sample_weight can't be an example; null where it can."""
    weight = F.col("sample_weight")
    return (
        F.when(F.col("prompt").isNull(), "prompt is missing").when(F.coalesce(F.col("completion"), F.lit("")) == "", "completion is empty")
        .when(weight.isNull() | F.isnan(weight) | ~weight.between(0, 1000), "weight outside")
    )


def rejections(rows: DataFrame, row: str) -> DataFrame:
    return rows.select(row, reason().alias("reason")).where("reason IS NOT NULL")


def size_guard(spark: SparkSession, path: str, most: int = MOST_BYTES) -> None:
    """Refuses files beyond most bytes, whatever file system they are in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    if size > most:
        raise ValueError(f"{path} has {size} bytes; at most {most} are read")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (from 1) and file_row (from 0, over all files in the order of their names) of every line.

    Lines are numbered where they are read; only a row for each split meets in one place."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    splits = read.groupBy("file", "__split").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.orderBy("file", "__split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = splits.select("file", "__split", "__first", before(Window.partitionBy("file")).alias("__lines"), before(Window.partitionBy()).alias("__rows"))
    inside = F.col("__id") - F.col("__first")
    return read.join(F.broadcast(told), ["file", "__split"]).select("value", "file", (F.col("__lines") + inside + 1).alias("line"), (F.col("__rows") + inside).alias("file_row"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects, one a line, blank lines skipped; any other line fails the read and is named. file_row is the line's number over all files, from 0."""
    size_guard(spark, path)
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    is_object = F.trim("value").startswith("{") & F.col("r").isNotNull() & F.is_valid_utf8("value") & (F.try_parse_json("value").isNotNull())
    named = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(" of "), F.element_at(F.split("file", "/"), -1), F.lit(" is not a JSON object"))
    checked = parsed.withColumn("r", F.when(is_object, F.col("r")).otherwise(F.raise_error(named).cast(parsed.schema["r"].dataType)))
    return checked.select("r.*", "file_row")


def read_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines (.jsonl, .json; a schema is asked for) or Parquet (.parquet, .pq), by the name's end."""
    if path.endswith((".jsonl", ".json")):
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return read_json_lines(spark, path, schema)
    if path.endswith((".parquet", ".pq")):
        size_guard(spark, path)
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def from_records(spark: SparkSession, records: list[dict], schema: str) -> DataFrame:
    """Rows in memory, numbered as given."""
    names = [f.split()[0] for f in schema.split(",")]
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(records)], f"source_row long, {schema}")


def example_index(rows: DataFrame, source: str, reserved: Column | None = None) -> DataFrame:
    """The nine columns of the index from projected roles with source_row; an invalid row fails the read."""
    why = reason()
    checked = rows.withColumn("completion", F.when(why.isNull(), F.col("completion")).otherwise(F.raise_error(F.coalesce(why, F.lit(""))).cast("string")))
    prompt, completion = C.nfc(F.col("prompt")), C.nfc(F.col("completion"))
    made = C.example_id(prompt, completion, F.col("sample_weight"), F.col("labels_json"), F.col("metadata_json"))
    return checked.withColumn("example_id", made).withColumn("source", F.lit(source)).withColumn("reserved_noop", F.lit(False) if reserved is None else reserved).select(*INDEX_COLUMNS)


def write_index(index: DataFrame, path: str) -> None:
    index.write.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index, each row's identity computed again; a row that differs fails the read."""
    index = spark.read.parquet(path)
    made = C.example_id(C.nfc(F.col("prompt")), C.nfc(F.col("completion")), F.col("sample_weight"), F.col("labels_json"), F.col("metadata_json"))
    return require(index, F.col("example_id") == made, "an example's identity differs from its content", "example_id")
