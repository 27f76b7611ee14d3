"""Checkpoints in logical time: windows, states, transitions and as-of lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType

from tracewell.operators import sweep

PRESENT, ABSENT, UNCERTAIN = "PRESENT", "ABSENT", "UNCERTAIN"
#: Rows of a side that goes to every task, as checkpoints and windows of one run may; more are swept.
FEW = 100_000


def few(rows: DataFrame, most: int = FEW) -> bool:
    """Whether rows are few enough for a broadcast."""
    return rows.limit(most + 1).count() <= most


def presence_state(low: Column, high: Column, threshold: float, direction: str = "greater") -> Column:
    """PRESENT or ABSENT where the whole interval is on one side of the threshold, else UNCERTAIN."""
    if direction == "greater":
        return F.when(low >= threshold, PRESENT).when(high < threshold, ABSENT).otherwise(UNCERTAIN)
    if direction == "less":
        return F.when(high <= threshold, PRESENT).when(low > threshold, ABSENT).otherwise(UNCERTAIN)
    raise ValueError(f"direction {direction}")


def adjacent(points: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """points with next_step and next_state of the following point; the last point of a group is left out."""
    order = Window.partitionBy(*by).orderBy(step)
    return points.withColumn("next_step", F.lead(step).over(order)).withColumn("next_state", F.lead("state").over(order)).where(F.col("next_step").isNotNull())


def transitions(points: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    """start, stop, from_state, to_state, kind of adjacent points whose states differ, or of which one is uncertain."""
    kind = F.when((F.col("state") == UNCERTAIN) | (F.col("next_state") == UNCERTAIN), "UNSTABLE").when(F.col("next_state") == PRESENT, "ABSENT_TO_PRESENT").otherwise("PRESENT_TO_ABSENT")
    pairs = adjacent(points, by, step).withColumn("kind", kind).where((F.col("kind") == "UNSTABLE") | (F.col("state") != F.col("next_state")))
    return pairs.select(*by, F.col(step).alias("start"), F.col("next_step").alias("stop"), F.col("state").alias("from_state"), F.col("next_state").alias("to_state"), "kind")


def duplicate_steps(points: DataFrame, by: list[str], step: str = "step") -> DataFrame:
    return points.groupBy(*by, step).agg(F.count("*").alias("n")).where("n > 1")


def monotone(points: DataFrame, by: list[str], rising: bool = True, step: str = "step") -> DataFrame:
    """by, monotone: whether no state is uncertain and presence never goes back."""
    level = F.when(F.col("state") == PRESENT, 1).when(F.col("state") == ABSENT, 0)
    before = F.lag(level).over(Window.partitionBy(*by).orderBy(step))
    good = level.isNotNull() & F.coalesce((level >= before) if rising else (level <= before), F.lit(True))
    return points.withColumn("__good", good).groupBy(*by).agg(F.bool_and("__good").alias("monotone"))


def few_of(rows: DataFrame, most: int = FEW) -> pa.Table | None:
    """rows where they are few enough to go to every task, else None."""
    told = rows.limit(most + 1).toArrow()
    return told if told.num_rows <= most else None


def beside(rows: DataFrame, step: str, marks: pa.Table, at: str, last: dict[str, str], after: dict[str, str] | None = None) -> DataFrame:
    """rows with columns of the last mark whose at isn't beyond their step, and of the mark after that (out: column of marks). Null where there is none.

    Marks are few; they go to each task once, where a batch of rows is placed among them by halving."""
    after = after or {}
    marks = marks.take(pc.sort_indices(marks, [(at, "ascending")])).combine_chunks()
    times = marks[at].to_numpy()
    kinds = from_arrow_schema(marks.schema)
    schema = StructType([*rows.schema.fields, *(StructField(out, kinds[c].dataType) for out, c in (*last.items(), *after.items()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(step)
            place = np.full(batch.num_rows, -1)
            place[np.asarray(own.is_valid())] = np.searchsorted(times, own.drop_null().to_numpy(zero_copy_only=False), "right")
            one = pa.array(place - 1, mask=place < 1)
            two = pa.array(place, mask=(place < 0) | (place == len(times)))
            told = [*(marks[c].take(one).combine_chunks() for c in last.values()), *(marks[c].take(two).combine_chunks() for c in after.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], schema.names)

    return rows.mapInArrow(run, schema)


def window_members(occurrences: DataFrame, windows: DataFrame, step: str = "step", most: int = FEW) -> DataFrame:
    """occurrences joined with the windows [start, stop) that they fall in.

    Few windows that don't overlap, as those of one timeline, go to every task, and an occurrence's is found by halving;
    more windows, or such that overlap, meet occurrences by an interval join."""
    told = few_of(windows.where("start IS NOT NULL"), most)
    if told is not None:
        ordered = told.take(pc.sort_indices(told, [("start", "ascending"), ("stop", "ascending")]))
        starts, stops = (ordered[c].to_pylist() for c in ("start", "stop"))
    if told is None or any(a is not None and b < a for a, b in zip(stops, starts[1:], strict=False)):
        return sweep.interval_join(occurrences, windows, step, closed=False)
    names = {f"__w_{c}": c for c in windows.columns}
    own = beside(occurrences, step, ordered, "start", names).where(F.col(step) < F.col("__w_stop"))
    return own.select(*occurrences.columns, *(F.col(w).alias(c) for w, c in names.items()))


def window_summary(occurrences: DataFrame, windows: DataFrame) -> DataFrame:
    """start, stop, n, sources (sorted, distinct)."""
    return window_members(occurrences, windows).groupBy("start", "stop").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


def as_of(rows: DataFrame, checkpoints: DataFrame, step: str = "step", most: int = FEW) -> DataFrame:
    """rows with checkpoint_step and checkpoint_hash of the latest checkpoint at or before their step (the greater hash on ties); nulls where there is none.

    Few checkpoints go to every task and are found by halving; more are swept together with the rows."""
    told = few_of(checkpoints.where("step IS NOT NULL").groupBy("step").agg(F.max("hash").alias("hash")), most)
    if told is None:
        named = checkpoints.select(F.col("step").alias(step), F.col("step").alias("checkpoint_step"), F.col("hash").alias("checkpoint_hash"))
        return sweep.as_of(rows, named, step, ["checkpoint_step", "checkpoint_hash"])
    return beside(rows, step, told, "step", {"checkpoint_step": "step", "checkpoint_hash": "hash"})


def chosen_checkpoints(checkpoints: DataFrame, steps: list[int] | str) -> DataFrame:
    """All checkpoints, or those of a list of steps; an unknown step is refused."""
    if steps == "all":
        return checkpoints
    known = {r["step"] for r in checkpoints.where(F.col("step").isin(list(steps))).select("step").distinct().collect()}
    if set(steps) - known:
        raise ValueError(f"no checkpoint at steps {sorted(set(steps) - known)}")
    return checkpoints.where(F.col("step").isin(list(steps)))


def learning_rate(step: Column, base: float, total: int, warmup: int, schedule: str = "constant") -> Column:
    """max(step, 1) / warmup at first; then constant, linear 1 - p or cosine (1 + cos pi p) / 2 of base."""
    p = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    shape = {"constant": F.lit(1.0), "linear": 1 - p, "cosine": (1 + F.cos(F.lit(3.141592653589793) * p)) / 2}[schedule]
    return F.lit(base) * (F.when(step < warmup, F.greatest(step, F.lit(1)) / F.lit(float(max(1, warmup)))).otherwise(shape))
