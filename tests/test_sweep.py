"""Joins by order against plain loops, and their plans."""

import datetime as dt
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import ranking as K
from tracewell.operators import sweep
from tracewell.operators import timeline as T


@pytest.fixture(scope="module")
def sides(spark):
    """Rows and marks with ties, nulls in the group and in the time, and a group that has half of all."""
    r = np.random.default_rng(4)
    group = lambda: None if r.random() < 0.1 else "hot" if r.random() < 0.5 else f"g{r.integers(4)}"
    rows = [(i, group(), None if i % 50 == 7 else int(r.integers(60))) for i in range(400)]
    marks = [(group(), None if i % 40 == 3 else int(r.integers(60)), int(r.integers(5))) for i in range(150)]
    return rows, marks, spark.createDataFrame(rows, "id int, g string, t int"), spark.createDataFrame(marks, "g string, t int, m int")


@pytest.mark.parametrize("by", [["g"], []], ids=str)
def test_as_of(sides, by):
    rows, marks, left, right = sides
    got = {r["id"]: r["m"] for r in sweep.as_of(left, right, "t", ["m"], by).collect()}
    assert len(got) == len(rows)
    for i, g, t in rows:
        fit = [(s, m) for h, s, m in marks if t is not None and s is not None and s <= t and (not by or h == g)]
        assert got[i] == (max(fit)[1] if fit else None)


@pytest.mark.parametrize("by", [["g"], []], ids=str)
def test_distances(sides, by):
    rows, marks, left, right = sides
    spans = right.select("g", F.col("t").cast("long").alias("start"), (F.col("t") + F.col("m")).cast("long").alias("stop"))
    got = {r["id"]: r["distance"] for r in sweep.distances(left.withColumn("t", F.col("t").cast("long")), spans, "t", by).collect()}
    for i, g, t in rows:
        fit = [max(0, s - t, t - s - m) for h, s, m in marks if t is not None and s is not None and (not by or h == g)]
        assert got[i] == (min(fit) if fit else None)


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("by", [["g"], []], ids=str)
def test_intervals(spark, sides, by, closed):
    rows, marks, left, right = sides
    spans = right.withColumn("n_", F.monotonically_increasing_id()).select("g", F.col("t").alias("start"), (F.col("t") + F.col("m") * 3 - 2).alias("stop"), F.lit(1).alias("id"), "m")
    inside = lambda t, s, m: t is not None and s is not None and s <= t and (t <= s + 3 * m - 2 if closed else t < s + 3 * m - 2)
    own = spans.drop("g") if not by else spans
    pairs = sorted((r["id"], r["start"], r["m"]) for r in sweep.interval_join(left, own, "t", by, closed).collect())
    assert pairs == sorted((i, s, m) for i, g, t in rows for h, s, m in marks if inside(t, s, m) and (not by or g == h))
    totals = sorted((r["g"] or "", -1 if r["start"] is None else r["start"], r["m"], r["n"], r["ids"]) for r in sweep.interval_totals(left, spans, "t", by, closed, {"ids": F.col("id").cast("long")}).collect())
    want = []
    for h, s, m in marks:
        fit = [i for i, g, t in rows if inside(t, s, m) and (not by or g == h)]
        want.append((h or "", -1 if s is None else s, m, len(fit), sum(fit)))
    assert totals == sorted(want)


def test_empty_sides(sides):
    rows, _, left, right = sides
    none = right.where("false")
    assert sweep.as_of(left, none, "t", ["m"], ["g"]).where("m IS NULL").count() == len(rows)
    assert sweep.as_of(left.where("false"), right, "t", ["m"], ["g"]).count() == 0
    spans = right.select("g", F.col("t").alias("start"), F.col("t").alias("stop"))
    assert sweep.interval_join(left, spans.where("false"), "t", ["g"]).count() == 0 and sweep.interval_join(left.where("false"), spans, "t", ["g"]).count() == 0
    assert sweep.interval_totals(left.where("false"), spans, "t", ["g"]).agg(F.sum("n")).first()[0] == 0


def test_no_nested_loop_and_no_product(sides):
    _, _, left, right = sides
    spans = right.select("g", F.col("t").alias("start"), (F.col("t") + 9).alias("stop"))
    for made in (sweep.as_of(left, right, "t", ["m"]), sweep.interval_join(left, spans, "t"), sweep.interval_totals(left, spans, "t")):
        plan = made._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_beyond_the_broadcast(spark):
    """As-of, nearest and interval joins give the same whether the small side travels or is swept."""
    windows = spark.createDataFrame([(3, 5, "a"), (7, 9, "b"), (20, 21, "c"), (30, 41, "d")], "start long, stop long, kind string")
    events = spark.range(60).select(F.col("id").alias("step"), (F.col("id") % 7).alias("x"))
    as_rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
    assert as_rows(T.window_members(events, windows)) == as_rows(T.window_members(events, windows, most=2))
    assert as_rows(K.temporal(events, windows)) == as_rows(K.temporal(events, windows, most=2))
    marks = spark.createDataFrame([(5, "x"), (5, "y"), (17, "a"), (40, "b")], "step long, hash string")
    assert as_rows(T.as_of(events, marks)) == as_rows(T.as_of(events, marks, most=2))


def test_what_follows_takes_time_as_rows_do(spark):
    """Many rows of one range: a fold of what follows each doesn't look at all of it again."""
    rows = spark.range(0, 300_000, 1, 1).select(F.col("id").alias("t"))
    spans = rows.where("t % 1000 = 999").select(F.col("t").alias("start"), (F.col("t") + 10).alias("stop"))
    began = time.monotonic()
    found = sweep.distances(rows, spans, "t").agg(F.sum("distance"), F.max("distance"), F.count("distance")).first()
    assert time.monotonic() - began < 60
    a_gap = sum(min(i - 10, 1000 - i) for i in range(11, 1000))  # from the end of a span to the next
    assert tuple(found) == (sum(range(1, 1000)) + 299 * a_gap, 999, 300_000)


def test_nearest_errors_equals_sql(spark, tmp_path):
    """Events before the first error, without a time, of one time, and without any error."""
    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 0, "view"), (2, 10, "error"), (3, 310, "view"), (4, None, "view"), (5, 320, "error"), (6, None, "error"), (7, 320, "view"), (8, 320, "error"), (9, 390, "view"), (10, 10, "view")]
    made = spark.createDataFrame([(i, at(s), k) for i, s, k in rows], "event_id long, ts timestamp_ntz, event_type string").coalesce(1)
    for name, events in (("some", made), ("none", made.where("event_type <> 'error'"))):
        events.write.parquet(f"{tmp_path}/{name}/events.parquet")
        view = f"(SELECT * FROM '{tmp_path}/{name}/events.parquet/*.parquet')"
        want = duckdb.connect().sql(plans.ORACLES["nearest_errors"].replace("FROM events", f"FROM {view}")).fetchall()
        assert sorted(map(tuple, plans.QUERIES["nearest_errors"](spark, f"{tmp_path}/{name}").collect())) == sorted(want)


def test_few_marks_do_not_travel_with_rows(spark):
    """Many checkpoints and windows, none of them in every row, in time that follows the rows; nulls and times before the first find none."""
    rows = spark.range(0, 400_000, 1, 4).select(F.when(F.col("id") != 77, F.col("id") - 5).alias("step"))
    marks = spark.range(20_000).select((F.col("id") * 20).alias("step"), F.col("id").cast("string").alias("hash"))
    spans = marks.select(F.col("step").alias("start"), (F.col("step") + 5).alias("stop"))
    began = time.monotonic()
    found = T.as_of(rows, marks)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert found.where("checkpoint_step IS NULL").count() == 6 and found.where("checkpoint_step <> step - step % 20 OR checkpoint_hash <> step DIV 20").count() == 0
    assert T.window_members(rows, spans).where("start = step - step % 20 AND step < stop").count() == T.window_members(rows, spans).count() == sum(i % 20 < 5 for i in range(399_995) if i != 72)
    distances = K.temporal(rows, spans).where("step >= 0 AND distance <> least(greatest(0, step % 20 - 5), 20 - step % 20) AND step < 399980")
    assert distances.count() == 0 and time.monotonic() - began < 60


def test_totals_sweep_times_alone(spark, monkeypatch):
    """Many points and intervals of few times: what is swept are the times, and sums keep their types."""
    points = spark.range(50_000).select((F.col("id") % 30).cast("int").alias("t"), (F.col("id") / 4).cast("decimal(12,2)").alias("v"))
    spans = spark.range(20_000).select("id", (F.col("id") % 40 - 5).cast("int").alias("start"), (F.col("id") % 40 - 5 + F.col("id") % 9).cast("int").alias("stop"))
    swept = []
    monkeypatch.setattr(sweep, "sweep", lambda rows, *a, own=sweep.sweep: swept.append(rows.count()) or own(rows, *a))
    made = sweep.interval_totals(points, spans, "t", sums={"v": F.col("v")})
    own = points.groupBy("t").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    want = spans.join(own, (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("stop")), "left").groupBy(*spans.columns).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    assert made.count() == 20_000 and made.exceptAll(want.select(*spans.columns, "n", F.col("v").cast(dict(made.dtypes)["v"]))).isEmpty()
    assert dict(made.dtypes)["v"] == dict(points.agg(F.sum("v").alias("v")).dtypes)["v"] and swept == [30 + len({i - 5 for i in range(40)}) + len({i % 40 - 5 + i % 9 for i in range(20_000)})]
