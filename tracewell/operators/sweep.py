"""Joins on an order: as-of, nearest and interval joins of sides of any size.

Both sides are put in one order, cut into ranges of about as many rows each, and swept: a range's own rows tell what came
before each of them in it, and a row a range tells what to carry over from the ranges before. Nothing is broadcast or
gathered, and no side is met pair by pair but where pairs are the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.sources.shared import kept

#: Points that one cell of an interval join holds.
CELL = 64
#: How a row of a range folds, how a range's rows do, and how the carried value meets the row's own.
_FOLDS = {
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("__at"))), lambda own, carried: F.coalesce(own, carried)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("__at"))), lambda own, carried: F.coalesce(own, carried)),
    "max": (F.max, F.max, lambda own, carried: F.greatest(own, carried)),
    "sum": (F.sum, F.sum, lambda own, carried: F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))),
}
#: The fold of rows met backwards that gives what a fold gives forwards.
_BACK = {"first": "last", "last": "first"}


def sweep(rows: DataFrame, by: list[str], order: list[str], before: dict[str, tuple[str, Column]], after: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """rows with what each of before (name: fold, column) gives over the rows of its group up to it, and each of after from it on.

    Folds are last and first (of values that aren't null), max and sum. Nulls in by are a group; nulls in order come first.
    Rows that are equal in by and order follow each other in any order."""
    after = after or {}
    keys = [F.col(c).asc() for c in (*by, *order)] + [F.col("__tie").asc()]
    ranges = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    there = kept(ranges.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "sweep")
    inside, across = Window.partitionBy(*by, "__part"), Window.partitionBy(*by)
    upto, since = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("__at"), F.desc("__at")))
    earlier, later = (across.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("__part"), F.desc("__part")))
    # what follows is folded backwards: Spark folds a frame without an end anew for each row, which grows with the square of a range
    back = lambda f: (_FOLDS[_BACK.get(f, f)][0], *_FOLDS[f][1:])
    asked = [(n, *_FOLDS[f], c, upto, earlier) for n, (f, c) in before.items()] + [(n, *back(f), c, since, later) for n, (f, c) in after.items()]
    parts = there.groupBy(*by, "__part").agg(*(whole(c).alias(f"__p_{n}") for n, _, whole, _, c, _, _ in asked))
    groups = [*by, "__part"]
    carried = parts.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(groups)), *(fold(F.col(f"__p_{n}")).over(outer).alias(f"__c_{n}") for n, fold, _, _, _, _, outer in asked))
    own = there.select("*", *(fold(c).over(inner).alias(n) for n, fold, _, _, c, inner, _ in asked))
    met = own.join(carried, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(groups)]), "left")
    for n, _, _, meet, *_ in asked:
        met = met.withColumn(n, meet(F.col(n), F.col(f"__c_{n}")))
    return met.select(*rows.columns, *(a[0] for a in asked))


def _both(rows: DataFrame, marks: DataFrame, by: list[str], at: str, mark: Column) -> DataFrame:
    """by, __t, __side, __mark, __row: marks come before rows of the same time."""
    listed = rows.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"))
    told = marks.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("__t"), F.lit(0).alias("__side"), mark.alias("__mark"))
    return told.unionByName(listed, allowMissingColumns=True)


def as_of(rows: DataFrame, marks: DataFrame, at: str, take: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with the columns take of the last mark of their group at or before their time; of marks of one time the greatest. Null where there is none, or no time."""
    by = by or []
    both = _both(rows, marks, by, at, F.struct(*take))
    found = sweep(both, by, ["__t", "__side", "__mark"], {"__last": ("last", F.col("__mark"))}).where("__side = 1")
    mine = F.when(F.col("__t").isNotNull(), F.col("__last"))
    return found.select("__row.*", *(mine[c].alias(c) for c in take))


def distances(rows: DataFrame, spans: DataFrame, at: str, by: list[str] | None = None) -> DataFrame:
    """rows with distance: how far their time (a whole number) is from the nearest closed span (start, stop) of their group, 0 within one; null without spans.

    The spans that began by then reach as far as their latest stop; the nearest of the others is the next to begin."""
    by = by or []
    both = _both(rows, spans.withColumn(at, F.col("start")), by, at, F.struct("start", "stop"))
    found = sweep(both, by, ["__t", "__side"], {"__reach": ("max", F.col("__mark.stop"))}, {"__next": ("first", F.col("__mark.start"))}).where("__side = 1")
    near = F.least(F.when(F.col("__reach").isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("__t") - F.col("__reach"))), F.col("__next") - F.col("__t"))
    return found.select("__row.*", F.when(F.col("__t").isNotNull(), near).alias("distance"))


def _ranked(points: DataFrame, intervals: DataFrame, at: str, by: list[str], closed: bool) -> tuple[DataFrame, DataFrame]:
    """Points (__row) with __n before them and themselves; intervals (__row) with __n_low and __n_high, those before start and by stop."""
    numbered = intervals.where("start <= stop").select(*by, F.monotonically_increasing_id().alias("__id"), F.struct(*intervals.columns).alias("__i"))
    end = lambda name, side: F.struct(F.col(f"__i.{name}").alias("__t"), F.lit(side).alias("__side"), F.lit(name == "start").alias("__low"))
    ends = numbered.withColumn("__end", F.explode(F.array(end("start", 0), end("stop", 2 if closed else 0)))).select(*by, "__id", "__end.*", F.when(F.col("__end.__low"), F.col("__i")).alias("__interval"))
    own = points.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*points.columns).alias("__row"), F.lit(1).cast("long").alias("__one"))
    both = own.unionByName(ends, allowMissingColumns=True)
    done = kept(sweep(both, [], [*by, "__t", "__side"], {"__n": ("sum", F.col("__one"))}), "intervals")  # one order for all groups: what lies between an interval's ends is of its own
    told = done.where("__side <> 1").groupBy("__id").agg(F.first("__interval", ignorenulls=True).alias("__row"), *(F.max(F.when(F.col("__low") == low, F.col("__n"))).alias(f"__n_{'low' if low else 'high'}") for low in (True, False)))
    return done.where("__side = 1"), told


def interval_totals(points: DataFrame, intervals: DataFrame, at: str, by: list[str] | None = None, closed: bool = True, sums: dict[str, Column] | None = None) -> DataFrame:
    """intervals (start, stop, ...) with n, and each of sums, of the points of their group within; those that end before they start have none.

    Sums are differences of running sums, exact for whole numbers and decimals; no pair is made, however much intervals overlap.
    Only times are swept, each once: points of one time are summed before, and intervals look the sums of their ends up."""
    by, sums = by or [], sums or {}
    asked = {"n": F.lit(1).cast("long"), **sums}
    kinds = dict(points.select(*(F.sum(c).alias(n) for n, c in asked.items())).dtypes)
    own = points.where(F.col(at).isNotNull()).groupBy(*by, F.col(at).alias("__t")).agg(*(F.sum(c).alias(f"__s_{n}") for n, c in asked.items())).withColumn("__side", F.lit(1))
    good = intervals.where("start <= stop")
    last = 2 if closed else 0
    times = good.select(*by, F.explode(F.array(*(F.struct(F.col(c).alias("t"), F.lit(side).alias("side")) for c, side in (("start", 0), ("stop", last))))).alias("__end"))
    ends = times.select(*by, F.col("__end.t").alias("__t"), F.col("__end.side").alias("__side")).distinct()
    both = own.unionByName(ends, allowMissingColumns=True)
    done = sweep(both, [], [*by, "__t", "__side"], {f"__t_{n}": ("sum", F.col(f"__s_{n}")) for n in asked})  # one order for all groups: what lies between an interval's ends is of its own
    told = kept(done.where("__side <> 1").select(*by, "__t", "__side", *(f"__t_{n}" for n in asked)), "intervals")
    for end, side in (("start", 0), ("stop", last)):
        here = told.where(F.col("__side") == side).select(*(F.col(c).alias(f"__{end}_by{i}") for i, c in enumerate(by)), F.col("__t").alias(f"__{end}"), *(F.col(f"__t_{n}").alias(f"__{end}_{n}") for n in asked))
        same = [F.col(c).eqNullSafe(F.col(f"__{end}_by{i}")) for i, c in enumerate(by)]
        good = good.join(here, reduce(lambda a, b: a & b, same, F.col(end) == F.col(f"__{end}")))
    found = good.select(*intervals.columns, *((F.col(f"__stop_{n}") - F.col(f"__start_{n}")).cast(kinds[n]).alias(n) for n in asked))
    none = intervals.where("NOT coalesce(start <= stop, false)").select(*intervals.columns, *(F.lit(0).cast(kinds[n]).alias(n) for n in asked))
    return found.unionByName(none)


def interval_join(points: DataFrame, intervals: DataFrame, at: str, by: list[str] | None = None, closed: bool = True) -> DataFrame:
    """A row for each point within each interval [start, stop] (closed) or [start, stop) of its group: the columns of points, then those of intervals that points lack.

    Points are numbered in order, an interval knows the numbers that it spans, and both meet by cells of CELL numbers: an equi
    join that looks at the pairs of the result and at most two cells more for each interval."""
    by = by or []
    own, ends = _ranked(points, intervals, at, by, closed)
    inside = own.select("__row", (F.col("__n") - 1).alias("__i")).withColumn("__cell", F.floor(F.col("__i") / CELL))
    spans = ends.where("__n_low < __n_high").select(F.col("__row").alias("__span"), "__n_low", "__n_high")
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__n_low") / CELL), F.floor((F.col("__n_high") - 1) / CELL))))
    met = inside.join(cells, "__cell").where("__i >= __n_low AND __i < __n_high")
    return met.select("__row.*", *(F.col(f"__span.{c}").alias(c) for c in intervals.columns if c not in points.columns))
