"""Queries on checkpoints, windows, states and statistics."""

from pyspark.sql import functions as F

from tracewell.operators import rows as R
from tracewell.operators import statistics as S
from tracewell.operators import timeline as T
from tracewell.plans import fixtures as X
from tracewell.plans import query


@query(X.RUN + "SELECT run, step, score, state FROM points")
def timeline_points(spark, sf_dir):
    return X.points(X.occurrences(spark, sf_dir))


@query(X.RUN + "SELECT 'r' AS run, start, stop, from_state, to_state, kind FROM windows")
def transition_windows(spark, sf_dir):
    return T.transitions(X.points(X.occurrences(spark, sf_dir)), ["run"])


@query(X.RUN + "SELECT start, stop, count(*) AS n, array_to_string(list(DISTINCT source ORDER BY source), ',') AS sources FROM occurrences JOIN windows ON step >= start AND step < stop GROUP BY 1, 2")
def occurrences_per_window(spark, sf_dir):
    rows = X.occurrences(spark, sf_dir)
    windows = T.transitions(X.points(rows), ["run"]).select("start", "stop")
    return T.window_summary(rows.select("step", "source"), windows).withColumn("sources", F.array_join("sources", ","))


@query(X.RUN + "SELECT occurrence_id, max(c.step) AS checkpoint_step, arg_max(hash, c.step) AS checkpoint_hash FROM occurrences o JOIN checkpoints c ON c.step <= o.step GROUP BY 1")
def asof_checkpoint(spark, sf_dir):
    rows = X.occurrences(spark, sf_dir).select("occurrence_id", "step")
    return T.as_of(rows, X.checkpoints(rows)).select("occurrence_id", "checkpoint_step", "checkpoint_hash")


@query(X.RUN + "SELECT step, hash FROM checkpoints ORDER BY step DESC LIMIT 3")
def checkpoint_tail(spark, sf_dir):
    return X.checkpoints(X.occurrences(spark, sf_dir)).orderBy(F.desc("step")).limit(3)


@query(X.RUN + "SELECT step, hash FROM checkpoints WHERE step IN (0, 25)")
def checkpoint_selection(spark, sf_dir):
    return T.chosen_checkpoints(X.checkpoints(X.occurrences(spark, sf_dir)), [0, 25])


_MONOTONE = """WITH p AS (SELECT l_suppkey % 7 AS run, l_linenumber AS step, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2), s AS (SELECT run, step, CASE WHEN q >= 25.5 THEN 1 ELSE 0 END AS v FROM p), m AS (SELECT run, coalesce(v >= lag(v) OVER (PARTITION BY run ORDER BY step), true) AS up FROM s) """


@query(_MONOTONE + "SELECT run, bool_and(up) AS monotone FROM m GROUP BY 1")
def monotonicity_check(spark, sf_dir):
    per = X.table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("run"), F.col("l_linenumber").alias("step")).agg(F.avg("l_quantity").alias("q"))
    states = per.select("run", "step", F.when(F.col("q") >= 25.5, T.PRESENT).otherwise(T.ABSENT).alias("state"))
    return T.monotone(states, ["run"])


@query("SELECT o_custkey AS run, o_orderdate AS step, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_steps(spark, sf_dir):
    return T.duplicate_steps(X.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("step")), ["run"])


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, length(text) AS l, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b >= l")
def strict_order_breaks(spark, sf_dir):
    rows = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("l"))
    return R.order_breaks(rows, ["conv_id"], "turn", "l").select("conv_id", "turn")


@query(X.RUN + "SELECT state, count(*) AS n FROM points GROUP BY 1")
def presence_states(spark, sf_dir):
    return X.points(X.occurrences(spark, sf_dir)).groupBy("state").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{how}' AS aggregation, event_type, round({sql}(value), 8) AS value FROM events GROUP BY 2" for how, sql in (("mean", "avg"), ("min", "min"), ("max", "max"), ("median", "median"))))
def probe_aggregates(spark, sf_dir):
    events = X.table(spark, sf_dir, "events")
    parts = [S.probe_aggregate(events, ["event_type"], how, "value").select(F.lit(how).alias("aggregation"), "event_type", F.round("value", 8).alias("value")) for how in S.AGGREGATES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type, round(quantile_cont(value, 0.025), 8) AS low, round(quantile_cont(value, 0.5), 8) AS mid, round(quantile_cont(value, 0.975), 8) AS high FROM events GROUP BY 1")
def linear_quantiles(spark, sf_dir):
    out = S.quantiles(X.table(spark, sf_dir, "events"), ["event_type"], "value", {"low": 0.025, "mid": 0.5, "high": 0.975})
    return out.select("event_type", *(F.round(n, 8).alias(n) for n in ("low", "mid", "high")))


@query("SELECT l_linenumber, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) AS {n}" for n, p in (("least", 0), ("decile", 0.1), ("quartile", 0.25), ("middle", 0.5), ("most", 0.999))) + " FROM lineitem GROUP BY 1")
def price_quantiles(spark, sf_dir):
    """Order statistics of large groups, selected by counts: no group's values meet anywhere."""
    at = {"least": 0.0, "decile": 0.1, "quartile": 0.25, "middle": 0.5, "most": 0.999}
    out = S.quantiles(X.table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_extendedprice", at, held=1000)
    return out.select("l_linenumber", *(F.round(n, 6).alias(n) for n in at))


_DRAWS = range(64)
_KEY = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"
_BOOT = f"""WITH d AS (SELECT l_returnflag AS g, l_discount - l_tax AS v, {", ".join(f"sha256('5:{d}:' || {_KEY}) AS h{d}" for d in range(4))} FROM lineitem),
u AS (SELECT g, v, k, CAST('0x' || substr(CASE k // 16 WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END, 4 * (k % 16) + 1, 4) AS INTEGER) AS u FROM d, range(0, 64) t(k)),
m AS (SELECT g, k, sum(v * w) / sum(w) AS m FROM (SELECT g, v, k, {" + ".join(f"CAST(u >= {t} AS INTEGER)" for t in S.DRAWN)} AS w FROM u) GROUP BY 1, 2) """


@query(_BOOT + "SELECT g, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m GROUP BY 1")
def bootstrap_interval(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") - F.col("l_tax")).alias("v"), *(F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    out = S.hashed_bootstrap(rows, ["g"], F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "v", draws=len(_DRAWS), seed=5)
    return out.select("g", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


_HOLM = "WITH t AS (SELECT p_brand AS family, p_partkey AS test_id, (p_partkey * 37 % 1000) / 1000.0 AS p FROM part), a AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test_id) + 1) * p AS a FROM t) "


@query(_HOLM + "SELECT test_id, round(least(1.0, max(a) OVER (PARTITION BY family ORDER BY p, test_id ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM a")
def holm_adjusted(spark, sf_dir):
    tests = X.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("test_id"), ((F.col("p_partkey") * 37 % 1000) / 1000.0).alias("p"))
    return S.holm(tests, ["family"]).select("test_id", F.round("adjusted", 9).alias("adjusted"))


@query("SELECT event_type AS control_id, round(avg(abs(b - a)), 8) AS mean_drift, round(max(abs(b - a)), 8) AS max_drift, avg(abs(b - a)) <= 40 AND max(abs(b - a)) <= 300 AS passes FROM (SELECT event_type, value AS b, value * 0.5 AS a FROM events) GROUP BY 1")
def control_drift(spark, sf_dir):
    before = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("control_id"), "event_id", F.col("value").alias("score"))
    pairs = S.paired(before, before.withColumn("score", F.col("score") * 0.5), ["control_id", "event_id"])
    return S.control_drift(pairs, 40.0, 300.0).select("control_id", F.round("mean_drift", 8).alias("mean_drift"), F.round("max_drift", 8).alias("max_drift"), "passes")


_VERDICT = """WITH s AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'PRESENT' WHEN 'O' THEN 'ABSENT' ELSE 'UNCERTAIN' END AS before_state, CASE WHEN o_orderkey % 3 = 0 THEN 'PRESENT' ELSE 'ABSENT' END AS after_state, o_totalprice / 1000 AS original, o_totalprice / 1500 AS cf, o_orderkey % 11 <> 0 AS controls, o_orderkey % 13 = 0 AS failed, o_orderkey % 5 = 0 AS holdout FROM orders),
e AS (SELECT *, original - cf AS effect, before_state = 'PRESENT' AND after_state = 'ABSENT' AND original - cf >= 20 AS accepted FROM s),
v AS (SELECT *, CASE WHEN failed THEN 'TARGET_FAILED' WHEN NOT controls THEN 'CONTROLS_FAILED' WHEN NOT accepted THEN 'INCONCLUSIVE' ELSE 'TARGET_PASSED' END AS status FROM e) """


@query(_VERDICT + "SELECT id, round(effect, 8) AS effect, round(effect / greatest(abs(original), 1e-12), 8) AS relative_effect, accepted, status, CASE WHEN status = 'TARGET_PASSED' AND holdout THEN 'STRONG' WHEN status = 'TARGET_PASSED' THEN 'PROVISIONAL' ELSE 'NONE' END AS claim FROM v")
def replay_verdicts(spark, sf_dir):
    o, key = X.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    before = F.when(F.col("o_orderstatus") == "F", "PRESENT").when(F.col("o_orderstatus") == "O", "ABSENT").otherwise("UNCERTAIN")
    after = F.when(key % 3 == 0, "PRESENT").otherwise("ABSENT")
    original = F.col("o_totalprice") / 1000
    rows = o.select(key.alias("id"), original.alias("original"), S.effect(original, F.col("o_totalprice") / 1500, "greater", "removal").alias("effect"), before.alias("b"), after.alias("a"))
    rows = rows.withColumn("accepted", S.accepted(F.col("b"), F.col("a"), F.col("effect"), F.lit(20), "removal"))
    rows = rows.withColumn("status", S.replay_status(F.col("id") % 13 == 0, F.col("id") % 11 != 0, F.col("accepted")))
    claim = S.causal_claim(F.col("status"), F.col("id") % 5 == 0, F.lit("BITWISE"))
    return rows.select("id", F.round("effect", 8).alias("effect"), F.round(S.relative_effect(F.col("effect"), F.col("original")), 8).alias("relative_effect"), "accepted", "status", claim.alias("claim"))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding) AS v FROM embeddings), d AS (SELECT CAST(vec_id AS VARCHAR) AS name, CAST(v AS DOUBLE) AS a, CAST(v AS DOUBLE) * CASE WHEN label = 0 THEN 1.5 ELSE 1 END AS b, label FROM x) SELECT name, bool_and(a = b) AS equal, round(max(abs(a - b)), 8) AS max_abs, round(max(abs(a - b) / greatest(abs(b), 2.2250738585072014e-308)), 8) AS max_rel FROM d GROUP BY 1")
def tensor_differences(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").cast("string").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    other = v.select("name", F.transform("values", lambda x: x * F.when(F.col("label") == 0, 1.5).otherwise(1.0)).alias("values"))
    return S.tensor_difference(v.select("name", "values"), other).select("name", "equal", F.round("max_abs", 8).alias("max_abs"), F.round("max_rel", 8).alias("max_rel"))


@query("""WITH a AS (SELECT label, [CAST(v AS DOUBLE) FOR v IN embedding] AS x, [CAST(v AS DOUBLE) + CASE WHEN label = 3 THEN 0.000001 WHEN label = 4 THEN 1.0 ELSE 0.0 END FOR v IN embedding] AS y FROM embeddings),
d AS (SELECT label, x = y AS same, list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS apart FROM a)
SELECT label, CASE WHEN bool_and(same) THEN 'BITWISE' WHEN bool_and(same OR apart <= 0.00001) THEN 'NUMERIC' ELSE 'FAILED' END AS grade FROM d GROUP BY 1""")
def audit_grades(spark, sf_dir):
    v = X.table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").cast("string").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    shift = F.when(F.col("label") == 3, 1e-6).when(F.col("label") == 4, 1.0).otherwise(0.0)
    other = v.select("name", F.transform("values", lambda x: x + shift).alias("values"))
    return S.audit_grade(S.tensor_difference(v.select("name", "values"), other).join(v.select("name", "label"), "name"), ["label"])


@query(X.RUN + ", r AS (SELECT DISTINCT step AS n FROM occurrences) SELECT n AS step, s AS schedule, round(0.1 * CASE WHEN n < 10 THEN greatest(n, 1) / 10.0 WHEN s = 'constant' THEN 1.0 WHEN s = 'linear' THEN 1 - least(1.0, (n - 10) / 390.0) ELSE (1 + cos(pi() * least(1.0, (n - 10) / 390.0))) / 2 END, 10) AS rate FROM r, (VALUES ('constant'), ('linear'), ('cosine')) b(s)")
def learning_rates(spark, sf_dir):
    """The rate of every recorded step under each schedule."""
    steps = X.occurrences(spark, sf_dir).select("step").distinct()
    parts = [steps.select("step", F.lit(s).alias("schedule"), F.round(T.learning_rate(F.col("step"), 0.1, 400, 10, s), 10).alias("rate")) for s in ("constant", "linear", "cosine")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT vec_id, round(embedding[1], 8) AS token, round(embedding[1], 8) AS sequence, round(-embedding[1], 8) AS nll, round(-embedding[2], 8) AS loss, round(embedding[1] - embedding[2], 8) AS margin,
round(embedding[1] - greatest(embedding[2], embedding[3], embedding[4]), 8) AS choice, CAST(label = 1 AS DOUBLE) AS exact, CAST(regexp_full_match('label ' || label, 'label [0-2]') AS DOUBLE) AS pattern FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)""")
def probe_scorers(spark, sf_dir):
    """All eight kinds, from log-probabilities and outputs that the vectors stand in for."""
    v = X.table(spark, sf_dir, "embeddings")
    e = lambda i: F.col("embedding")[i].cast("double")
    return v.select(
        "vec_id", F.round(S.scorer("token_log_probability", value=e(0)), 8).alias("token"), F.round(S.scorer("sequence_log_probability", value=e(0)), 8).alias("sequence"),
        F.round(S.scorer("sequence_nll", value=e(0)), 8).alias("nll"), F.round(S.scorer("scalar_loss", value=e(1)), 8).alias("loss"), F.round(S.scorer("sequence_logprob_margin", preferred=e(0), alternative=e(1)), 8).alias("margin"),
        F.round(S.scorer("multiple_choice_margin", correct=e(0), others=F.array(e(1), e(2), e(3))), 8).alias("choice"), S.scorer("greedy_exact_match_rate", output=F.col("label"), expected=F.lit(1)).alias("exact"),
        S.scorer("greedy_regex_match_rate", output=F.concat(F.lit("label "), F.col("label").cast("string")), pattern="label [0-2]").alias("pattern"),
    )
