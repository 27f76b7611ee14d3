"""Queries on packing, tokens, weights and ledger checks."""

from pyspark.sql import functions as F

from tracewell.functions import tokens as W
from tracewell.operators import ledger as L
from tracewell.plans import fixtures as X
from tracewell.plans import query

_LENGTHS = f"WITH {X.EXAMPLES} SELECT source_row, CAST(strlen(prompt) AS BIGINT) AS prompt_bytes, CAST(strlen(completion) AS BIGINT) AS completion_bytes, CAST(strlen(prompt) + strlen(completion) + 3 AS BIGINT) AS length, CAST(greatest(0, strlen(prompt) + strlen(completion) + 3 - 512) AS BIGINT) AS left_truncated FROM examples"


@query(_LENGTHS)
def sft_lengths(spark, sf_dir):
    rows = X.examples(spark, sf_dir)
    n = W.sft_length(F.col("prompt"), F.col("completion"))
    return rows.select("source_row", F.octet_length("prompt").cast("long").alias("prompt_bytes"), F.octet_length("completion").cast("long").alias("completion_bytes"), n.alias("length"), W.truncated_count(n, 512).alias("left_truncated"))


_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: CAST('0x' || h AS INT) + 4)"


@query(f"SELECT item_id, sha256(array_to_string({_BYTES.format('text')}, ',')) AS tokens, CAST(strlen(text) AS BIGINT) AS n FROM benchmark")
def byte_tokens(spark, sf_dir):
    b = X.table(spark, sf_dir, "benchmark").withColumn("t", W.byte_tokens(F.col("text")))
    return b.select("item_id", F.sha2(F.array_join(F.col("t").cast("array<string>"), ","), 256).alias("tokens"), F.size("t").cast("long").alias("n"))


@query(f"WITH {X.EXAMPLES}, t AS (SELECT source_row, [1] || {_BYTES.format('prompt')} || [3] || {_BYTES.format('completion')} || [2] AS t FROM examples), c AS (SELECT source_row, CASE WHEN len(t) > 64 THEN [t[1]] || t[-63:] ELSE t END AS t FROM t) SELECT source_row, array_to_string(t, ',') AS tokens FROM c")
def left_truncated_tokens(spark, sf_dir):
    rows = X.examples(spark, sf_dir).withColumn("t", W.sft_tokens(F.col("prompt"), F.col("completion")))
    return rows.select("source_row", F.array_join(W.left_truncate(F.col("t"), 64).cast("array<string>"), ",").alias("tokens"))


@query(f"WITH {X.EXAMPLES} SELECT source_row, round((strlen(completion) + 1) * sample_weight, 6) AS denominator, CAST(strlen(completion) + 1 AS BIGINT) AS active FROM examples")
def loss_denominators(spark, sf_dir):
    rows = X.examples(spark, sf_dir).withColumn("w", W.sft_weights(F.col("prompt"), F.col("completion"), F.col("sample_weight")))
    return rows.select("source_row", F.round(L.loss_denominator(F.col("w")), 6).alias("denominator"), F.size(F.filter("w", lambda w: w > 0)).cast("long").alias("active"))


_PACK = f"""WITH RECURSIVE {X.EXAMPLES}, e AS (SELECT source_row, least(strlen(prompt) + strlen(completion) + 3, 2048) AS n, greatest(0, strlen(prompt) + strlen(completion) + 3 - 2048) AS cut FROM examples), k AS (SELECT count(*) AS rows FROM e),
p AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS token_start, n AS token_end FROM e WHERE source_row = 0
UNION ALL SELECT p.i + 1, p.sequence + CASE WHEN p.token_end + e.n > 2048 THEN 1 ELSE 0 END, CASE WHEN p.token_end + e.n > 2048 THEN 0 ELSE p.token_end END, CASE WHEN p.token_end + e.n > 2048 THEN e.n ELSE p.token_end + e.n END
FROM p, k, e WHERE e.source_row = (p.i + 1) % k.rows AND p.i < 2 * k.rows)
SELECT 'run' AS run_id, sequence, p.i % k.rows AS source_row, p.i // k.rows AS epoch, CAST(token_start AS BIGINT) AS token_start, CAST(token_end AS BIGINT) AS token_end, CAST(cut AS BIGINT) AS left_truncated FROM p, k, e WHERE e.source_row = p.i % k.rows AND sequence <= (SELECT max(sequence) FROM p, k WHERE p.i < k.rows)"""


@query(_PACK)
def deterministic_packing(spark, sf_dir):
    """The sequences that one epoch of the table needs."""
    rows = X.examples(spark, sf_dir).select(F.lit("run").alias("run_id"), "source_row", W.sft_length(F.col("prompt"), F.col("completion")).alias("length"))
    return L.pack_lengths(rows, context=2048, sequences=None)


_EPOCHS = f"""WITH RECURSIVE {X.EXAMPLES}, e AS (SELECT source AS run, row_number() OVER (PARTITION BY source ORDER BY source_row) - 1 AS i, source_row, least(strlen(prompt) + strlen(completion) + 3, 2048) AS n, greatest(0, strlen(prompt) + strlen(completion) + 3 - 2048) AS cut FROM examples),
k AS (SELECT run, count(*) AS rows FROM e GROUP BY 1),
p AS (SELECT run, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sequence, CAST(0 AS BIGINT) AS token_start, n AS token_end FROM e WHERE i = 0
UNION ALL SELECT p.run, p.i + 1, p.sequence + CASE WHEN p.token_end + e.n > 2048 THEN 1 ELSE 0 END, CASE WHEN p.token_end + e.n > 2048 THEN 0 ELSE p.token_end END, CASE WHEN p.token_end + e.n > 2048 THEN e.n ELSE p.token_end + e.n END
FROM p JOIN k ON p.run = k.run JOIN e ON e.run = p.run AND e.i = (p.i + 1) % k.rows WHERE p.i < 2 * k.rows),
m AS (SELECT p.run, max(sequence) AS last FROM p JOIN k ON p.run = k.run AND p.i < k.rows GROUP BY 1)
SELECT p.run AS run_id, sequence, e.source_row, p.i // k.rows AS epoch, CAST(token_start AS BIGINT) AS token_start, CAST(token_end AS BIGINT) AS token_end, CAST(cut AS BIGINT) AS left_truncated FROM p JOIN k ON p.run = k.run JOIN m ON p.run = m.run AND sequence <= last JOIN e ON e.run = p.run AND e.i = p.i % k.rows"""


@query(_EPOCHS)
def epoch_packing(spark, sf_dir):
    """One epoch of a run for each source, packed by jumps over many tasks."""
    rows = X.examples(spark, sf_dir).select(F.col("source").alias("run_id"), "source_row", W.sft_length(F.col("prompt"), F.col("completion")).alias("length"))
    return L.pack_lengths(rows, context=2048, sequences=None, held=0)


@query(f"WITH {X.EXAMPLES}, o AS (SELECT source_row, strlen(completion) + 1 AS c, sample_weight AS w FROM examples) SELECT source_row, round(c * w, 6) AS kept, CAST(0 AS DOUBLE) AS removed, round(c * w * 0.5, 6) AS halved FROM o")
def token_interventions(spark, sf_dir):
    """Weight sums before and after a removal and a halving of the whole span."""
    rows = X.examples(spark, sf_dir).withColumn("w", W.sft_weights(F.col("prompt"), F.col("completion"), F.col("sample_weight")))
    total = lambda w: F.round(F.aggregate(w, F.lit(0.0), lambda s, x: s + x), 6)
    whole = (F.lit(0), F.size("w"))
    return rows.select("source_row", total(F.col("w")).alias("kept"), total(L.intervene(F.col("w"), *whole, "remove")).alias("removed"), total(L.intervene(F.col("w"), *whole, "scale", 0.5)).alias("halved"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS l, list_transform(range(0, len(embedding)), lambda i: CASE WHEN i % 3 = 0 THEN 0.0 ELSE 1.0 END) AS w FROM embeddings), t AS (SELECT vec_id, list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * w[i])) AS s, list_sum(w) AS d FROM x) SELECT vec_id, round(s / d, 8) AS renormalized, round(s / 64.0, 8) AS fixed FROM t")
def normalized_losses(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("l"), F.transform("embedding", lambda x, i: F.when(i % 3 == 0, 0.0).otherwise(1.0)).alias("w"))
    return v.select("vec_id", F.round(L.normalized_loss(F.col("l"), F.col("w")), 8).alias("renormalized"), F.round(L.normalized_loss(F.col("l"), F.col("w"), F.lit(64.0)), 8).alias("fixed"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS l FROM embeddings) SELECT vec_id, round(list_sum(l[10:29]), 8) AS loss, CAST(20 AS INT) AS active FROM x")
def occurrence_losses(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("l"), F.array_repeat(F.lit(1.0), 64).alias("w"))
    loss, active = L.occurrence_loss(F.col("l"), F.col("w"), F.lit(10), F.lit(30))
    return v.select("vec_id", F.round(loss, 8).alias("loss"), active.alias("active"))


def _batches(spark, sf_dir):
    """Packed single-example sequences; some of them broken in known ways."""
    e = X.examples(spark, sf_dir)
    n = W.sft_length(F.col("prompt"), F.col("completion")).cast("int")
    e = e.withColumn("n", n).withColumn("pad", F.when(F.col("source_row") % 4 == 0, 5).otherwise(0)).withColumn("w", W.sft_weights(F.col("prompt"), F.col("completion")))
    prompt = F.concat(F.array(F.lit(False)), F.array_repeat(F.lit(True), F.octet_length("prompt")), F.array_repeat(F.lit(False), F.col("n") - 1 - F.octet_length("prompt")))
    span = F.struct(F.lit(0).alias("start"), F.when(F.col("source_row") % 9 == 0, F.col("n") + 99).otherwise(F.col("n")).alias("end"), prompt.alias("prompt"), F.transform("w", lambda x: x > 0).alias("completion"), F.lit(False).alias("reserved"))
    weights = F.concat("w", F.array_repeat(F.lit(0.0), F.col("pad")))
    return e.select(
        "source_row", F.concat(W.sft_tokens(F.col("prompt"), F.col("completion")), F.array_repeat(F.lit(0), F.col("pad"))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(True), F.col("n")), F.array_repeat(F.lit(False), F.col("pad"))).alias("attention_mask"), weights.alias("loss_weights"),
        F.col("pad").alias("padding_tokens"), F.array(span).alias("spans"), (L.loss_denominator(weights) + F.when(F.col("source_row") % 7 == 0, 1.0).otherwise(0.0)).alias("denominator"),
    )


_BROKEN = f"""WITH {X.EXAMPLES}, n AS (SELECT source_row, strlen(prompt) AS p, strlen(completion) AS c, strlen(prompt) + strlen(completion) + 3 AS n, CASE WHEN source_row % 4 = 0 THEN 5 ELSE 0 END AS pad FROM examples),
b AS (SELECT source_row, n + pad AS tokens, pad, 0 AS span_start, CASE WHEN source_row % 9 = 0 THEN n + 99 ELSE n END AS span_end, 1 + p + (n - 1 - p) AS prompt_mask, p + 2 + c + 1 AS completion_mask,
CAST(c + 1 AS DOUBLE) AS active, CAST(c + 1 + CASE WHEN source_row % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS declared FROM n) """


@query(_BROKEN + """SELECT source_row, concat_ws(',', CASE WHEN NOT (span_start >= 0 AND span_start < span_end AND span_end <= tokens - pad) THEN 'span outside' END,
CASE WHEN prompt_mask <> span_end - span_start OR completion_mask <> span_end - span_start THEN 'mask length' END, CASE WHEN abs(active - declared) > 0.00001 THEN 'denominator' END) AS issues FROM b""")
def batch_invariants(spark, sf_dir):
    return L.batch_issues(_batches(spark, sf_dir)).select("source_row", F.array_join("issues", ",").alias("issues"))


_SPANS = f"""WITH {X.EXAMPLES}, n AS (SELECT source_row AS step, strlen(prompt) + strlen(completion) + 3 AS n FROM examples),
b AS (SELECT step, 0 AS microbatch, 0 AS token_start, CASE WHEN step % 9 = 0 THEN n + 99 ELSE n END AS token_end FROM n),
o AS (SELECT step, 0 AS microbatch, CASE WHEN step % 10 = 3 THEN 1 ELSE 0 END AS token_start, token_end FROM b) """


@query(_SPANS + "SELECT 'left' AS side, count(*) AS n FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM b) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM o) HAVING count(*) > 0")
def ledger_validation(spark, sf_dir):
    """Spans of the occurrence table against those of the batches; every tenth was changed."""
    b = _batches(spark, sf_dir).select(F.col("source_row").alias("step"), F.lit(0).alias("microbatch"), F.transform("spans", lambda s: F.struct(s["start"].alias("token_start"), s["end"].alias("token_end"))).alias("spans"))
    occurrences = b.select("step", "microbatch", F.explode("spans").alias("s")).select("step", "microbatch", (F.col("s.token_start") + F.when(F.col("step") % 10 == 3, 1).otherwise(0)).alias("token_start"), F.col("s.token_end").alias("token_end"))
    return L.ledger_mismatches(occurrences, b)


@query(f"WITH {X.OCCURRENCES} SELECT step, count(*) AS occurrences, count(*) FILTER (source = 'error') AS reserved, round(avg(value), 8) AS mean_loss FROM occurrences GROUP BY 1")
def step_summary(spark, sf_dir):
    return X.occurrences(spark, sf_dir).groupBy("step").agg(F.count("*").alias("occurrences"), F.count_if(F.col("source") == "error").alias("reserved"), F.round(F.avg("value"), 8).alias("mean_loss"))


@query(f"WITH {X.OCCURRENCES} SELECT count(DISTINCT step) AS steps, count(*) AS occurrences, count(*) FILTER (source = 'error') AS reserved, min(step) AS first_step, max(step) AS last_step, count(DISTINCT step) = max(step) - min(step) + 1 AS complete FROM occurrences")
def run_inspection(spark, sf_dir):
    return X.occurrences(spark, sf_dir).agg(
        F.countDistinct("step").alias("steps"), F.count("*").alias("occurrences"), F.count_if(F.col("source") == "error").alias("reserved"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        (F.countDistinct("step") == F.max("step") - F.min("step") + 1).alias("complete"),
    )


@query("SELECT occurrence_id, count(*) AS n FROM (SELECT l_partkey AS occurrence_id FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY 1 HAVING count(*) > 1")
def patch_conflicts(spark, sf_dir):
    a = X.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("occurrence_id"))
    return L.conflicts(a.unionByName(X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("occurrence_id"))))


def _ledger_tables(spark, sf_dir):
    """The four tables of a run whose uses are events."""
    rows = X.occurrences(spark, sf_dir).withColumn("microbatch", F.lit(0))
    batches = rows.groupBy("step", "microbatch").agg(F.sort_array(F.collect_list(F.struct("occurrence_id", "source"))).alias("spans"))  # a batch's twenty
    steps = rows.groupBy("step").agg(F.count("*").alias("occurrences"), F.avg("value").alias("loss"))
    return {"occurrences": rows.select("step", "microbatch", "occurrence_id", "source"), "batches": batches, "steps": steps, "metrics": steps.select("step", F.lit("loss").alias("name"), F.col("loss").alias("value"))}


@query(f"WITH {X.OCCURRENCES} SELECT step, occurrence_id, source FROM occurrences WHERE step >= 100 AND step < 320")
def ledger_scan(spark, sf_dir):
    """A ledger of two appends, written, checked and read by a range of steps that lies in both."""
    from tracewell.sources import ledger as G
    from tracewell.sources.shared import scratch

    path, tables = scratch(spark, "ledger"), _ledger_tables(spark, sf_dir)
    G.append({n: t.where("step < 200") for n, t in tables.items()}, path)
    G.append({n: t.where("step >= 200") for n, t in tables.items()}, path)
    return G.occurrences_between(G.open_ledger(spark, path), 100, 320).select("step", "occurrence_id", "source")


@query(f"""WITH {X.OCCURRENCES}, l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY occurrence_id) - 1 AS i, sha256(occurrence_id) AS h, count(*) OVER (PARTITION BY source) AS n FROM occurrences),
""" + ",\n".join(f"l{k + 1} AS (SELECT source, i // 64 AS i, CASE WHEN count(*) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, any_value(n) AS n FROM l{k} GROUP BY 1, 2)" for k in range(4)) + """
SELECT source, h AS digest, n FROM l4""")
def history_tree(spark, sf_dir):
    """Each source's history as the root of a tree of 64: no source is in one task."""
    from tracewell.operators.digests import ordered_tree_digest

    rows = X.occurrences(spark, sf_dir).select("source", "occurrence_id", F.sha2("occurrence_id", 256).alias("event_hash"))
    return ordered_tree_digest(rows, ["source"], ["occurrence_id"], "event_hash", fanout=64)
