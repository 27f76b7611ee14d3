"""Row numbers, duplicate groups, grouping policies and set comparisons."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def numbered(rows: DataFrame, bucket: Column, order: list[Column], out: str = "source_row") -> DataFrame:
    """rows with a contiguous number from 0, by bucket and then order.

    Only a count for each bucket meets in one place; buckets must rise with the order."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("__bucket", before.alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return rows.withColumn("__at", inside).join(base, "__bucket").withColumn(out, F.col("__base") + F.col("__at")).drop("__bucket", "__base", "__at")


def duplicate_groups(rows: DataFrame, key: str, row: str, least: int = 1) -> DataFrame:
    """key, row, n of the rows whose key occurs at least so often, n times. A group is its rows: none is gathered anywhere."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.select(key, row).join(counts, key)


POLICIES = ("occurrence", "example", "source", "time_window")


def group_key(policy: str, window: int = 1) -> Column:
    """The key of a grouping policy over occurrence_id, example_id, source, step and metadata (a JSON object)."""
    if policy == "occurrence":
        return F.col("occurrence_id").cast("string")
    if policy == "example":
        return F.col("example_id").cast("string")
    if policy == "source":
        return F.col("source").cast("string")
    if policy == "time_window":
        if window < 1:
            raise ValueError("a time window has at least one step")
        return F.floor(F.col("step") / window).cast("string")
    if policy.startswith("metadata:"):
        return F.coalesce(F.get_json_object("metadata", "$." + policy.removeprefix("metadata:")), F.lit("null"))
    raise ValueError(f"policy {policy}")


def grouped(occurrences: DataFrame, policy: str, window: int = 1) -> DataFrame:
    """group_id (policy:key), occurrence_id, n: each distinct occurrence of a group, and how many the group has."""
    members = occurrences.select(F.concat(F.lit(f"{policy}:"), group_key(policy, window)).alias("group_id"), "occurrence_id").distinct()
    return members.join(members.groupBy("group_id").agg(F.count("*").alias("n")), "group_id")


def ordered_digest(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, digest, n: SHA-256 of each group's values in order, each ended by a newline; n of them. Null values are left out.

    A digest takes its input in order, so a group goes through one task; sorted, as a stream of batches, and never as a whole."""
    kinds = dict(rows.dtypes)
    listed = rows.where(F.col(value).isNotNull()).select(*by, *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), F.col(value).cast("string").alias("__v"))
    placed = listed.repartition(*by).sortWithinPartitions(*by, *(f"__o{i}" for i in range(len(order))), "__v")

    schema = pa.schema([*(pa.field(c, to_arrow_type(listed.schema[c].dataType)) for c in by), ("digest", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, done = None, hashlib.sha256(), 0, []
        for batch in batches:
            for *own, v in zip(*(batch.column(c).to_pylist() for c in (*by, "__v")), strict=True):
                if own != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest(), n))
                    now, digest, n = own, hashlib.sha256(), 0
                digest.update(v.encode() + b"\n")
                n += 1
        if now is not None:
            done.append((*now, digest.hexdigest(), n))
        yield pa.RecordBatch.from_pylist([dict(zip((*by, "digest", "n"), r, strict=True)) for r in done], schema)

    return placed.select(*by, "__v").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "digest string", "n long"]))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, n: rows that one relation has more often than the other; none where they are equal."""
    return left.exceptAll(right).select(F.lit("left").alias("side")).unionByName(right.exceptAll(left).select(F.lit("right").alias("side"))).groupBy("side").agg(F.count("*").alias("n"))


def order_breaks(rows: DataFrame, by: list[str], position: str, *order: str) -> DataFrame:
    """Rows whose order columns aren't above those of the row before them."""
    window = Window.partitionBy(*by).orderBy(position)
    now = F.struct(*order)
    return rows.withColumn("__before", F.lag(now).over(window)).where(F.col("__before") >= now).drop("__before")


def require(rows: DataFrame, condition: Column, message: str, column: str) -> DataFrame:
    """rows; reading column fails where condition doesn't hold."""
    return rows.withColumn(column, F.when(condition, F.col(column)).otherwise(F.raise_error(F.lit(message)).cast(rows.schema[column].dataType)))


def all_subsets(spark, names: list[str]) -> DataFrame:
    """subset (sorted array), size: every subset of 1 to 12 names, by the bits of a number."""
    names = sorted(set(names))
    if not 1 <= len(names) <= 12:
        raise ValueError("between 1 and 12 groups")
    bits = F.array(*(F.when(F.col("id").bitwiseAND(1 << i) != 0, F.lit(n)) for i, n in enumerate(names)))
    return spark.range(1 << len(names)).select(F.array_compact(bits).alias("subset")).withColumn("size", F.size("subset"))
