"""Probe aggregates, intervals, corrections, drift gates and verdicts."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from tracewell.functions.safe_regex import full_match
from tracewell.operators.sweep import sweep
from tracewell.sources.shared import kept, spread

AGGREGATES = ("mean", "min", "max", "median")
#: Rows of a group whose values one task may hold; quantiles of larger groups are selected by counts.
HELD = 10_000
#: Bits of a key that a pass tells; a key has 64.
DIGIT = 16


@F.arrow_udf(LongType())
def _key(values: pa.Array) -> pa.Array:
    """Doubles as whole numbers in the same order; both zeros are one, and what isn't a number comes last."""
    bits = (np.asarray(values.fill_null(0.0), np.float64) + 0.0).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=np.asarray(values.is_null()))


@F.arrow_udf(DoubleType())
def _value(keys: pa.Array) -> pa.Array:
    bits = np.asarray(keys.fill_null(0), np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64), mask=np.asarray(keys.is_null()))


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], held: int = HELD) -> DataFrame:
    """by and a column for each of at (name: p): linear between order statistics at p(n - 1). Exact; nulls don't count, a group of nulls alone has none.

    Groups of at most held values take Spark's own percentile. Of larger ones the order statistics are selected by counting: a pass
    counts the values by the next DIGIT bits of their keys, among those that begin as the sought ones do, and so tells those bits; four
    passes tell a key. What meets in one place is at most 2 ** DIGIT counts, and a pass reads only rows that the last one left."""
    groups = [f"__g{i}" for i in range(len(by))]
    listed = rows.where(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.col(value).cast("double").alias("__v"))
    sizes = listed.groupBy(*groups).agg(F.count("*").alias("__n"))
    named = lambda df: df.select(*(F.col(g).alias(c) for c, g in zip(by, groups, strict=True)), *at)
    large = kept(sizes.where(F.col("__n") > held), "large-groups")
    if large.isEmpty():
        return named(listed.groupBy(*groups).agg(*(F.percentile("__v", F.lit(p)).alias(n) for n, p in at.items())))
    small = _met(listed, sizes.where(F.col("__n") <= held), groups).groupBy(*groups).agg(*(F.percentile("__v", F.lit(p)).alias(n) for n, p in at.items()))
    place = F.explode(F.array(*(F.struct(F.lit(n).alias("__q"), (F.lit(p) * (F.col("__n") - 1)).alias("__p")) for n, p in at.items())))
    wanted = large.withColumn("__w", place).select(*groups, "__n", "__w.*").withColumn("__low", F.floor("__p")).withColumn("__share", F.col("__p") - F.col("__low"))
    ranks = wanted.select(*groups, F.explode(F.array("__low", F.least(F.col("__low") + 1, F.col("__n") - 1))).alias("__r")).distinct()
    sought = kept(ranks.select(*groups, "__r", F.lit(0).cast("long").alias("__begin"), F.col("__r").alias("__left")), "sought")
    left = _met(listed, large.select(*groups), groups).withColumn("__k", _key("__v")).select(*groups, "__k")
    for told in range(0, 64, DIGIT):
        if told:
            left = kept(_met(left.withColumn("__begin", F.shiftright("__k", 64 - told)), sought.select(*groups, "__begin").distinct(), [*groups, "__begin"]), "left")
        digit = F.shiftright("__k", 64 - told - DIGIT)
        counts = left.withColumn("__digit", digit).groupBy(*groups, *(["__begin"] if told else []), "__digit").agg(F.count("*").alias("__c"))
        if not told:
            counts = counts.withColumn("__begin", F.lit(0).cast("long"))
        upto = F.sum("__c").over(Window.partitionBy(*groups, "__begin").orderBy("__digit"))
        counts = counts.withColumn("__upto", upto)
        met = _met(sought, counts, [*groups, "__begin"]).where((F.col("__left") < F.col("__upto")) & (F.col("__left") >= F.col("__upto") - F.col("__c")))
        sought = kept(met.select(*groups, "__r", F.col("__digit").alias("__begin"), (F.col("__left") - F.col("__upto") + F.col("__c")).alias("__left")), "sought")
    found = sought.select(*groups, "__r", _value("__begin").alias("__x"))
    low = _met(wanted.withColumn("__r", F.col("__low")), found, [*groups, "__r"]).withColumnRenamed("__x", "__a").drop("__r")
    both = _met(low.withColumn("__r", F.least(F.col("__low") + 1, F.col("__n") - 1)), found, [*groups, "__r"])
    between = F.when(F.col("__share") == 0, F.col("__a")).otherwise((1 - F.col("__share")) * F.col("__a") + F.col("__share") * F.col("__x"))
    selected = both.groupBy(*groups).agg(*(F.max(F.when(F.col("__q") == n, between)).alias(n) for n in at))
    return named(small.unionByName(selected) if by else selected)


def _met(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """left joined with right on columns of these names, nulls being equal; right's other columns are added."""
    if not names:
        return left.crossJoin(F.broadcast(right))  # no group: one row
    other = right.withColumnsRenamed({n: f"__o{i}" for i, n in enumerate(names)})
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__o{i}")) for i, n in enumerate(names)])
    return left.join(other, same).drop(*(f"__o{i}" for i in range(len(names))))


def probe_aggregate(scores: DataFrame, by: list[str], how: str, value: str = "score", held: int = HELD) -> DataFrame:
    """by, value: the mean, least, greatest or middle score of each group."""
    if how == "median":
        return quantiles(scores, by, value, {"value": 0.5}, held)
    return scores.groupBy(*by).agg({"mean": F.avg, "min": F.min, "max": F.max}[how](value).alias("value"))


def linear_quantile(ordered: list[float], p: float) -> float:
    """Linear between the members of a sorted list at p(n - 1)."""
    place = p * (len(ordered) - 1)
    low = int(place)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (place - low)


#: Draws that one digest tells, sixteen bits each, and 65536 times the chance that a row is drawn at most 0, 1, ... times (Poisson of mean 1); fixed values.
DRAWS = 16
DRAWN = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def hashed_bootstrap(differences: DataFrame, by: list[str], key: Column, value: str, draws: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """by, low, high: percentile interval of the mean over resamples in which each row occurs as often as its key's hash says, once on average
    (the Poisson bootstrap), so that any engine draws the same.

    A row's part in all draws is told where it stands: a task gives one vector of sums a group, and vectors are added."""
    names = [f"__g{i}" for i in range(len(by))]
    kinds = dict(differences.dtypes)
    digests = [F.unhex(F.sha2(F.concat(F.lit(f"{seed}:{d}:"), key), 256)) for d in range(-(-draws // DRAWS))]
    told = spread(differences).select(*(F.col(c).alias(g) for c, g in zip(by, names, strict=True)), F.col(value).cast("double").alias("__v"), F.concat(*digests).alias("__d")).where("__v IS NOT NULL")
    times = np.searchsorted(np.array(DRAWN), np.arange(1 << 16), side="right").astype(np.float64)
    schema = ", ".join([*(f"{g} {kinds[c]}" for c, g in zip(by, names, strict=True)), "__draw int, __s double, __w double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = pa.StructArray.from_arrays([batch.column(g) for g in names], names) if names else None
            codes, kinds_here = (np.zeros(batch.num_rows, np.int64), 1) if groups is None else _codes(groups)
            data = np.frombuffer(b"".join(batch.column("__d").to_pylist()), ">u2").reshape(batch.num_rows, -1)[:, :draws]
            weights, v = times[data], np.asarray(batch.column("__v"))
            for g in range(kinds_here):
                at = np.flatnonzero(codes == g)
                own = weights[at]
                first = pa.array(np.full(draws, at[0]))
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(first) for n in names), pa.array(np.arange(draws, dtype=np.int32)), pa.array(v[at] @ own), pa.array(own.sum(0))], [*names, "__draw", "__s", "__w"])

    sums = told.mapInArrow(run, schema).groupBy(*names, "__draw").agg((F.sum("__s") / F.sum("__w")).alias("__m"))
    return _interval(sums, by, names, confidence)


def _codes(groups: pa.StructArray) -> tuple[np.ndarray, int]:
    """A number for each row's group, and how many there are."""
    seen: dict = {}
    codes = np.array([seen.setdefault(tuple(g.values()), len(seen)) for g in groups.to_pylist()], np.int64)
    return codes, len(seen)


def _interval(means: DataFrame, by: list[str], names: list[str], confidence: float) -> DataFrame:
    """by, low, high of a group's draws, of which there are few."""
    tail = (1 - confidence) / 2
    out = means.groupBy(*names).agg(F.percentile("__m", F.lit(tail)).alias("low"), F.percentile("__m", F.lit(1 - tail)).alias("high"))
    return out.select(*(F.col(g).alias(c) for c, g in zip(by, names, strict=True)), "low", "high")


def dealt_bootstrap(differences: DataFrame, by: list[str], value: str, draws: int, seed: int, confidence: float = 0.95, block: int = 1 << 16) -> DataFrame:
    """by, low, high: percentile interval of the mean over resamples of exactly a group's size, with replacement.

    Rows are numbered within their group and cut into blocks. A draw's rows are dealt to the blocks by conditional binomials, each
    block's share of what is left, from random numbers that every block can make for itself; a block then picks its share among
    its rows and gives one vector of sums, and vectors are added. What a block must walk are the blocks before it, not their rows."""
    names = [f"__g{i}" for i in range(len(by))]
    kinds = dict(differences.dtypes)
    listed = differences.where(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, names, strict=True)), F.col(value).cast("double").alias("__v"))
    one = F.lit(1).cast("long")
    placed = sweep(listed, names, ["__v"], {"__i": ("sum", one)})
    sizes = listed.groupBy(*names).agg(F.count("*").alias("__n"))
    dealt = _met(placed, sizes, names).withColumn("__block", F.floor((F.col("__i") - 1) / block))
    schema = ", ".join([*(f"{g} {kinds[c]}" for c, g in zip(by, names, strict=True)), "__draw int, __s double"])

    def pick(table: pa.Table) -> pa.Table:
        row = table.slice(0, 1).to_pylist()[0]
        n, mine = row["__n"], row["__block"]
        group = int.from_bytes(hashlib.sha256(repr([row[g] for g in names]).encode()).digest()[:8])
        left, own = np.full(draws, n), np.zeros(draws, np.int64)
        for b in range(mine + 1):
            size, rest = min(block, n - b * block), n - b * block
            own = left if size == rest else np.random.default_rng([seed, group, b]).binomial(left, size / rest)
            left = left - own
        values = np.sort(np.asarray(table["__v"]))
        source = np.random.default_rng([seed, group, mine, 1])
        sums = np.array([values[source.integers(0, len(values), int(k))].sum() for k in own])
        return pa.table({**{g: table[g].combine_chunks().take(pa.array(np.zeros(draws, np.int64))) for g in names}, "__draw": pa.array(np.arange(draws, dtype=np.int32)), "__s": pa.array(sums)})

    sums = _met(dealt.groupBy(*names, "__block").applyInArrow(pick, schema).groupBy(*names, "__draw").agg(F.sum("__s").alias("__s")), sizes, names)
    return _interval(sums.withColumn("__m", F.col("__s") / F.col("__n")), by, names, confidence)


def paired_bootstrap(pairs: DataFrame, by: list[str], draws: int, seed: int, confidence: float = 0.95) -> DataFrame:
    """by, low, high: percentile interval of the mean difference after - before, by the Mersenne Twister, one group a task.

    Columns position, before, after; a group is a behavior's probes, of which a contract has 100,000 at most."""
    if not 1 <= draws <= 10_000_000:
        raise ValueError("between 1 and 10,000,000 draws")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def interval(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        values = (group["after"] - group["before"]).tolist()
        n, source = len(values), random.Random(seed)
        means = sorted(sum(values[source.randrange(n)] for _ in range(n)) / n for _ in range(draws))
        tail = (1 - confidence) / 2
        return pd.DataFrame([[*(group[c].iloc[0] for c in by), linear_quantile(means, tail), linear_quantile(means, 1 - tail)]], columns=[*by, "low", "high"])

    return pairs.groupBy(*by).applyInPandas(interval, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "low double, high double"]))


def holm(tests: DataFrame, by: list[str], p: str = "p", order: str = "test_id", held: int = 1_000_000) -> DataFrame:
    """tests with adjusted: running maximum of (m - rank) p over falling significance, at most 1.

    Where a family has more than held tests, ranks and running maxima are swept by range; no family then meets in one task."""
    sizes = tests.groupBy(*by).agg(F.count("*").alias("__m"))
    if (sizes.agg(F.max("__m")).first()[0] or 0) > held:
        ranked = sweep(tests, by, [p, order], {"__r": ("sum", F.lit(1).cast("long"))})
        met = _met(ranked, sizes, by).withColumn("__a", (F.col("__m") - F.col("__r") + 1) * F.col(p))
        return sweep(met, by, ["__r"], {"__most": ("max", F.col("__a"))}).withColumn("adjusted", F.least(F.lit(1.0), F.col("__most"))).select(*tests.columns, "adjusted")
    ranked = Window.partitionBy(*by).orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    step = tests.withColumn("__a", (m - F.row_number().over(ranked) + 1) * F.col(p))
    return step.withColumn("adjusted", F.least(F.lit(1.0), F.max("__a").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))).drop("__a")


def control_drift(pairs: DataFrame, mean_limit: float, max_limit: float) -> DataFrame:
    """control_id, mean_drift, max_drift, passes of paired scores before and after."""
    apart = F.abs(F.col("before") - F.col("after"))
    per = pairs.groupBy("control_id").agg(F.avg(apart).alias("mean_drift"), F.max(apart).alias("max_drift"))
    return per.withColumn("passes", (F.col("mean_drift") <= mean_limit) & (F.col("max_drift") <= max_limit))


def paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Scores before and after by key; a key that one side lacks fails the read."""
    both = before.withColumnRenamed("score", "before").join(after.withColumnRenamed("score", "after"), keys, "full_outer")
    whole = F.col("before").isNotNull() & F.col("after").isNotNull()
    return both.withColumn("before", F.when(whole, F.col("before")).otherwise(F.raise_error(F.lit("scores don't pair up")).cast("double")))


def effect(original: Column, counterfactual: Column, direction: str, operation: str) -> Column:
    """How far a removal lowers (an addition raises) the behavior, whichever way it is measured."""
    lowered = original - counterfactual if direction == "greater" else counterfactual - original
    return lowered if operation == "removal" else -lowered


def relative_effect(value: Column, original: Column) -> Column:
    return value / F.greatest(F.abs(original), F.lit(1e-12))


def accepted(before: Column, after: Column, value: Column, required: float, operation: str) -> Column:
    """A removal takes the behavior from PRESENT to ABSENT, an addition the other way, by the required effect."""
    first, last = ("PRESENT", "ABSENT") if operation == "removal" else ("ABSENT", "PRESENT")
    return (before == first) & (after == last) & (value >= required)


def replay_status(target_failed: Column, controls_passed: Column, is_accepted: Column) -> Column:
    return F.when(target_failed, "TARGET_FAILED").when(~controls_passed, "CONTROLS_FAILED").when(~is_accepted, "INCONCLUSIVE").otherwise("TARGET_PASSED")


def causal_claim(status: Column, holdout_passed: Column, audit_grade: Column) -> Column:
    """Strong only for a passed replay with a passed holdout on an audited run."""
    return F.when((status == "TARGET_PASSED") & holdout_passed & audit_grade.isin("BITWISE", "NUMERIC"), "STRONG").when(status == "TARGET_PASSED", "PROVISIONAL").otherwise("NONE")


def audit_grade(comparisons: DataFrame, by: list[str], tolerance: float = 1e-5) -> DataFrame:
    """by, grade: BITWISE where all parts are equal, NUMERIC where differences are within tolerance, else FAILED."""
    near = F.coalesce(F.col("max_abs") <= tolerance, F.lit(False))
    return comparisons.groupBy(*by).agg(F.when(F.bool_and("equal"), "BITWISE").when(F.bool_and(F.col("equal") | near), "NUMERIC").otherwise("FAILED").alias("grade"))


def tensor_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """name, equal, max_abs, max_rel of tensors (name, values) by full outer join; a missing or differently sized one has nulls."""
    r = right.withColumnRenamed("values", "other")
    both = left.join(r, "name", "full_outer")
    same = F.size("values") == F.size("other")
    apart = F.zip_with("values", "other", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    ratio = F.zip_with("values", "other", lambda a, b: F.abs(a.cast("double") - b.cast("double")) / F.greatest(F.abs(b.cast("double")), F.lit(2.2250738585072014e-308)))
    return both.select("name", F.coalesce(F.col("values") == F.col("other"), F.lit(False)).alias("equal"), F.when(same, F.array_max(apart)).alias("max_abs"), F.when(same, F.array_max(ratio)).alias("max_rel"))


def scorer(kind: str, **log_probs: Column | str) -> Column:
    """A probe's score from its log-probabilities or output by scorer type; a pattern is one of the safe subset, as text."""
    value = log_probs.get("value")
    if kind in ("token_log_probability", "sequence_log_probability"):
        return value
    if kind in ("sequence_nll", "scalar_loss"):
        return -value
    if kind == "sequence_logprob_margin":
        return log_probs["preferred"] - log_probs["alternative"]
    if kind == "multiple_choice_margin":
        return log_probs["correct"] - F.array_max(log_probs["others"])
    if kind == "greedy_exact_match_rate":
        return (log_probs["output"] == log_probs["expected"]).cast("double")
    if kind == "greedy_regex_match_rate":
        return full_match(log_probs["output"], log_probs["pattern"]).cast("double")
    raise ValueError(f"scorer {kind}")
