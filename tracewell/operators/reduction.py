"""Relations over evaluated subsets of candidate groups: signals, residuals, landscapes, beams and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interaction_signals(observations: DataFrame) -> DataFrame:
    """left, right, union, kind of disjoint evaluated subsets whose union was evaluated and contradicts both.

    observations: subset (sorted array), accepted; each union row meets only its own splits: pairs are found by an equi join on the
    complement within the union, not by comparing all pairs."""
    o = observations.select("subset", "accepted")
    left = o.select(F.col("subset").alias("left"), F.col("accepted").alias("la"), F.explode("subset").alias("member"))
    whole = o.select(F.col("subset").alias("union"), F.col("accepted").alias("ua"), F.explode("subset").alias("member"))
    inside = left.join(whole, "member").groupBy("left", "la", "union", "ua").agg(F.count("*").alias("shared")).where((F.col("shared") == F.size("left")) & (F.size("left") < F.size("union")))
    split = inside.withColumn("right", F.array_sort(F.array_except("union", "left")))
    both = split.join(o.select(F.col("subset").alias("right"), F.col("accepted").alias("ra")), "right")
    before = (F.size("left") < F.size("right")) | ((F.size("left") == F.size("right")) & (F.array_join("left", "\0") < F.array_join("right", "\0")))
    kind = F.when(F.col("la") & F.col("ra") & ~F.col("ua"), "ANTAGONISTIC").when(~F.col("la") & ~F.col("ra") & F.col("ua"), "SYNERGISTIC")
    return both.where(before).withColumn("kind", kind).where(F.col("kind").isNotNull()).select("left", "right", "union", "kind")


def pair_residuals(observations: DataFrame) -> DataFrame:
    """left, right, residual, kind: a pair's effect less its members' own."""
    one = observations.where(F.size("subset") == 1).select(F.col("subset")[0].alias("name"), F.col("effect").alias("own"))
    two = observations.where(F.size("subset") == 2).select(F.col("subset")[0].alias("left"), F.col("subset")[1].alias("right"), "effect")
    both = two.join(one.select(F.col("name").alias("left"), F.col("own").alias("le")), "left").join(one.select(F.col("name").alias("right"), F.col("own").alias("re")), "right")
    residual = F.col("effect") - F.col("le") - F.col("re")
    return both.select("left", "right", residual.alias("residual"), F.when(residual > 0, "synergistic").when(residual < 0, "antagonistic").otherwise("additive").alias("kind"))


def landscape_minimum(observations: DataFrame) -> DataFrame:
    """All accepted subsets of the least accepted size."""
    good = observations.where("accepted").withColumn("size", F.size("subset"))
    return good.join(F.broadcast(good.agg(F.min("size").alias("size"))), "size").select("subset", "size")


def subset_key(subset: Column) -> Column:
    return F.array_join(F.array_sort(subset), "\0")


def smallest_accepted(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The accepted subset of least size, then least in order."""
    return observations.where("accepted").groupBy(*(by or [])).agg(F.min_by("subset", F.struct(F.size("subset"), subset_key(F.col("subset")))).alias("subset"))


def beam_layer(observations: DataFrame, width: int) -> DataFrame:
    """Of each size, the width best subsets by falling objective, then sorted members."""
    order = Window.partitionBy("size").orderBy(F.col("effect").desc(), subset_key(F.col("subset")))
    return observations.withColumn("size", F.size("subset")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)


def cost_summary(replays: DataFrame) -> DataFrame:
    """replays, cache_hits, steps, seconds, prefix_reuse of replay rows."""
    return replays.agg(F.count("*").alias("replays"), F.count_if("cache_hit").alias("cache_hits"), F.sum("steps").alias("steps"), F.sum("seconds").alias("seconds"), F.sum("prefix_steps").alias("prefix_reuse"))


def negative_results(cases: DataFrame) -> DataFrame:
    """kind, n: failed cases, recall below one, failed single removals and failed controls, none of them hidden."""
    rows = [
        cases.where(~F.col("accepted")).select(F.lit("failed_case").alias("kind")), cases.where("recall < 1").select(F.lit("recall_below_one").alias("kind")),
        cases.where((F.size("subset") == 1) & ~F.col("accepted")).select(F.lit("failed_singleton").alias("kind")), cases.where(~F.col("controls_passed")).select(F.lit("control_failure").alias("kind")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


def stale_entries(cache: DataFrame, most: int) -> DataFrame:
    """Entries (key, written) to prune: all but the most recently written, of those written together the first by key.

    The last entry that stays is found among the first most, which are taken part by part; the others are held against it."""
    if most < 1:
        return cache
    stay = cache.select("written", "key").orderBy(F.col("written").desc(), "key").limit(most)
    last = stay.agg(F.count("*").alias("__n"), F.min("written").alias("__w"))
    tied = stay.join(F.broadcast(last), F.col("written") == F.col("__w")).groupBy("__n", "__w").agg(F.max("key").alias("__k"))
    later = (F.col("written") < F.col("__w")) | (F.col("written") == F.col("__w")) & (F.col("key") > F.col("__k"))
    return cache.crossJoin(F.broadcast(tied)).where((F.col("__n") == most) & later).drop("__w", "__k", "__n")  # one row
