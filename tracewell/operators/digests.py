"""Digests of ordered relations as trees, so that no order goes through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.sweep import sweep

#: Members of a node at most.
FANOUT = 4096


def row_hash(*columns: str) -> Column:
    """SHA-256 of the columns as a JSON object, nulls too."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def tree_digest(rows: DataFrame, by: list[str], position: str, value: str, fanout: int = FANOUT, most: int | None = None) -> DataFrame:
    """by, digest, n: the root over each group's values, hex digests at positions 0 to n - 1.

    A node is the SHA-256 of up to fanout digests below it, in order and one after another; a lone one is the root itself.
    Levels are made one above the other, a node's members in one place and never a group's. Nulls in by are a group. most: what no
    group has more of; else rows are counted."""
    level = rows.select(*by, F.col(position).cast("long").alias("__at"), F.col(value).alias("__h"), F.lit(1).cast("long").alias("__n"))
    count = (rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) if most is None else most
    while True:
        node = F.transform(F.sort_array(F.collect_list(F.struct("__at", "__h"))), lambda x: x["__h"])
        level = level.groupBy(*by, F.floor(F.col("__at") / fanout).alias("__up")).agg(node.alias("__m"), F.sum("__n").alias("__n"))
        level = level.select(*by, F.col("__up").alias("__at"), F.when(F.size("__m") == 1, F.get("__m", F.lit(0))).otherwise(F.sha2(F.array_join("__m", ""), 256)).alias("__h"), "__n")
        count = -(-count // fanout)
        if count <= 1:
            return level.select(*by, F.col("__h").alias("digest"), F.col("__n").alias("n"))


def ordered_tree_digest(rows: DataFrame, by: list[str], order: list[str], value: str, fanout: int = FANOUT) -> DataFrame:
    """The same of values that aren't numbered yet, in the order of the columns, then of the values."""
    placed = sweep(rows.select(*by, *order, value), by, [*order, value], {"__n": ("sum", F.lit(1).cast("long"))})
    return tree_digest(placed.withColumn("__n", F.col("__n") - 1), by, "__n", value, fanout)
