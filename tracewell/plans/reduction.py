"""Queries on evaluated subsets, costs, caches and evidence relations."""

from pyspark.sql import functions as F

from tracewell.functions import canonical as C
from tracewell.operators import reduction as D
from tracewell.operators import rows as R
from tracewell.plans import fixtures as X
from tracewell.plans import query

_S = f"WITH {X.SUBSETS} "
_T = lambda c: f"array_to_string({c}, '|')"


def _text(name):
    return F.array_join(name, "|")


@query(f"WITH k AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS k FROM events) SELECT {_T('list_filter(k, lambda x: (m >> (list_position(k, x) - 1)) & 1 = 1)')} AS subset, CAST(bit_count(m) AS BIGINT) AS size FROM k, range(0, CAST(pow(2, (SELECT len(k) FROM k)) AS BIGINT)) t(m)")
def all_subsets(spark, sf_dir):
    return R.all_subsets(spark, X.kinds(spark, sf_dir)).select(_text("subset").alias("subset"), F.col("size").cast("long").alias("size"))


_PAIRS = """, p AS (SELECT a.subset AS l, b.subset AS r, a.accepted AS la, b.accepted AS ra, list_sort(a.subset || b.subset) AS u FROM subsets a, subsets b WHERE NOT list_has_any(a.subset, b.subset) AND (len(a.subset) < len(b.subset) OR (len(a.subset) = len(b.subset) AND array_to_string(a.subset, '|') < array_to_string(b.subset, '|')))),
s AS (SELECT l, r, u, CASE WHEN la AND ra AND NOT accepted THEN 'ANTAGONISTIC' WHEN NOT la AND NOT ra AND accepted THEN 'SYNERGISTIC' END AS kind FROM p JOIN subsets ON subset = u) """


@query(_S + _PAIRS + f"SELECT {_T('l')} AS left_set, {_T('r')} AS right_set, {_T('u')} AS union_set, kind FROM s WHERE kind IS NOT NULL")
def interaction_signals(spark, sf_dir):
    return D.interaction_signals(X.subsets(spark, sf_dir)).select(_text("left").alias("left_set"), _text("right").alias("right_set"), _text("union").alias("union_set"), "kind")


@query(_S + "SELECT p.subset[1] AS l, p.subset[2] AS r, round(p.effect - a.effect - b.effect, 6) + 0.0 AS residual, CASE WHEN round(p.effect - a.effect - b.effect, 6) > 0 THEN 'synergistic' WHEN round(p.effect - a.effect - b.effect, 6) < 0 THEN 'antagonistic' ELSE 'additive' END AS kind FROM subsets p JOIN subsets a ON a.subset = p.subset[1:1] JOIN subsets b ON b.subset = p.subset[2:2] WHERE len(p.subset) = 2")
def pair_residuals(spark, sf_dir):
    rows = D.pair_residuals(X.subsets(spark, sf_dir)).withColumn("residual", F.round("residual", 6) + 0.0)
    kind = F.when(F.col("residual") > 0, "synergistic").when(F.col("residual") < 0, "antagonistic").otherwise("additive")
    return rows.select(F.col("left").alias("l"), F.col("right").alias("r"), "residual", kind.alias("kind"))


@query(_S + f"SELECT {_T('subset')} AS subset, len(subset) AS size FROM subsets WHERE accepted AND len(subset) = (SELECT min(len(subset)) FROM subsets WHERE accepted)")
def landscape_minimum(spark, sf_dir):
    return D.landscape_minimum(X.subsets(spark, sf_dir)).select(_text("subset").alias("subset"), F.col("size").cast("long").alias("size"))


@query(_S + f"SELECT {_T('subset')} AS subset FROM subsets WHERE accepted ORDER BY len(subset), {_T('subset')} LIMIT 1")
def smallest_accepted(spark, sf_dir):
    return D.smallest_accepted(X.subsets(spark, sf_dir)).select(_text("subset").alias("subset"))


@query(_S + f"SELECT {_T('subset')} AS subset, len(subset) AS size, row_number() OVER (PARTITION BY len(subset) ORDER BY effect DESC, {_T('subset')}) AS place FROM subsets QUALIFY place <= 3")
def beam_layers(spark, sf_dir):
    return D.beam_layer(X.subsets(spark, sf_dir), 3).select(_text("subset").alias("subset"), F.col("size").cast("long").alias("size"), F.col("place").cast("long").alias("place"))


@query(_S + "SELECT count(*) AS replays, count(*) FILTER (len(subset) = 1) AS cache_hits, CAST(sum(len(subset) * 4) AS BIGINT) AS steps, sum(seconds) AS seconds, CAST(sum(len(subset)) AS BIGINT) AS prefix_reuse FROM subsets")
def replay_costs(spark, sf_dir):
    n = F.size("subset")
    return D.cost_summary(X.subsets(spark, sf_dir).select("seconds", (n == 1).alias("cache_hit"), (n * 4).cast("long").alias("steps"), n.cast("long").alias("prefix_steps")))


@query(_S + "SELECT kind, count(*) AS n FROM (SELECT 'failed_case' AS kind FROM subsets WHERE NOT accepted UNION ALL SELECT 'recall_below_one' FROM subsets WHERE recall < 1 UNION ALL SELECT 'failed_singleton' FROM subsets WHERE len(subset) = 1 AND NOT accepted UNION ALL SELECT 'control_failure' FROM subsets WHERE NOT controls_passed) GROUP BY 1")
def negative_results(spark, sf_dir):
    return D.negative_results(X.subsets(spark, sf_dir))


@query("""SELECT c_custkey, sha256('{"adapter_hash":"' || c_mktsegment || '","behavior_contract_hash":"b","environment_compatibility_class":"cpu","patch_hash":"' || c_custkey || '","remaining_history_hash":"h","source_checkpoint_hash":"ck","training_configuration_hash":"t"}') AS digest FROM customer""")
def cache_keys(spark, sf_dir):
    digest = C.cache_key(
        source_checkpoint_hash=F.lit("ck"), remaining_history_hash=F.lit("h"), patch_hash=F.col("c_custkey").cast("string"), adapter_hash=F.col("c_mktsegment"), training_configuration_hash=F.lit("t"),
        behavior_contract_hash=F.lit("b"), environment_compatibility_class=F.lit("cpu"),
    )
    return X.table(spark, sf_dir, "customer").select("c_custkey", digest.alias("digest"))


@query("SELECT o_orderkey AS key, o_orderdate AS written FROM orders ORDER BY o_orderdate DESC, o_orderkey OFFSET 256")
def cache_pruning(spark, sf_dir):
    return D.stale_entries(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("written")), 256)


@query("SELECT count(*) AS occurrences, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum(strlen(text)) * 1000000.0 / count(*), 4) AS bytes_per_million, round(count(*) / 12.5, 6) AS per_second FROM documents")
def storage_projection(spark, sf_dir):
    size = F.sum(F.octet_length("text").cast("long"))
    return X.table(spark, sf_dir, "documents").agg(F.count("*").alias("occurrences"), size.alias("bytes"), F.round(size * 1000000.0 / F.count("*"), 4).alias("bytes_per_million"), F.round(F.count("*") / 12.5, 6).alias("per_second"))


@query(_S + f", k AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS k FROM events) SELECT {_T('subset')} AS subset, {_T('list_filter(k, lambda x: NOT list_contains(subset, x))')} AS complement FROM subsets, k")
def complements(spark, sf_dir):
    every = F.array(*(F.lit(n) for n in X.kinds(spark, sf_dir)))
    return X.subsets(spark, sf_dir).select(_text("subset").alias("subset"), F.array_join(F.array_except(every, "subset"), "|").alias("complement"))
