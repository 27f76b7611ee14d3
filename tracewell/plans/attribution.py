"""Queries on candidate scores, rankings and fusion."""

from pyspark.sql import functions as F

from tracewell.functions.tokens import words
from tracewell.operators import ranking as K
from tracewell.operators import retrieval as V
from tracewell.plans import fixtures as X
from tracewell.plans import query


def _queries(spark, sf_dir):
    return X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_BM25 = f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({X.TERMS.format("text")}) AS term FROM benchmark),
d AS (SELECT doc_id, {X.TERMS.format("text")} AS w FROM documents),
c AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS a FROM d),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 8) AS raw_score FROM tf JOIN df USING (term) JOIN q USING (term), c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, doc_id) AS rank FROM s) """


def _scored(spark, sf_dir):
    return K.bm25(X.table(spark, sf_dir, "documents"), _queries(spark, sf_dir)).withColumn("raw_score", F.round("raw_score", 8))


@query(_BM25 + "SELECT query_id, doc_id, raw_score, rank FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return V.bm25_topk(X.table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", "query_id", 20)


@query(_BM25 + "SELECT query_id, doc_id, raw_score FROM s")
def bm25_scores(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(f"SELECT count(*) AS n_docs, round(greatest(avg(len({X.TERMS.format('text')})), 1.0), 8) AS avg_len FROM documents")
def bm25_corpus(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.round(F.greatest(F.avg(F.size(words(F.col("text")))), F.lit(1.0)), 8).alias("avg_len"))


_RANDOM = "round(CAST(CAST(('0x' || substr(sha256('17' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0, 12)"


@query(f"SELECT doc_id, s AS raw_score, row_number() OVER (ORDER BY s DESC, doc_id) AS rank FROM (SELECT doc_id, {_RANDOM} AS s FROM documents) QUALIFY rank <= 50")
def random_rank(spark, sf_dir):
    scores = X.table(spark, sf_dir, "documents").select("doc_id", F.round(K.random_score(F.lit(17), F.col("doc_id")), 12).alias("raw_score"), F.lit("random").alias("method_id"))
    return K.ranked(scores, ["method_id"], key="doc_id", most=50).drop("method_id")


def _windows(spark, sf_dir):
    from tracewell.operators.timeline import transitions

    rows = X.occurrences(spark, sf_dir)
    return rows, transitions(X.points(rows), ["run"]).where("kind = 'ABSENT_TO_PRESENT'").select("start", "stop")


@query(X.RUN + "SELECT occurrence_id, min(greatest(0, start - step, step - stop)) AS distance, round(1.0 / (1 + min(greatest(0, start - step, step - stop))), 9) AS raw_score FROM occurrences, (SELECT start, stop FROM windows WHERE kind = 'ABSENT_TO_PRESENT') GROUP BY 1")
def temporal_scores(spark, sf_dir):
    rows, windows = _windows(spark, sf_dir)
    return K.temporal(rows.select("occurrence_id", "step"), windows).where("distance IS NOT NULL").select("occurrence_id", "distance", F.round("raw_score", 9).alias("raw_score"))


_HASHED = """, f AS ({0}), h AS (SELECT k, CAST('0x' || substr(sha256(f), 9, 8) AS UBIGINT) % 256 AS bucket, sum(CASE WHEN CAST('0x' || substr(sha256(f), 18, 1) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM f GROUP BY 1, 2 HAVING v <> 0),
e AS (SELECT k, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS value FROM h) """
_FEATURES = "SELECT k, unnest(w) AS f FROM t UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || chr(31) || w[i + 1])) FROM t"


@query(f"WITH t AS (SELECT item_id AS k, {X.TERMS.format('text')} AS w FROM benchmark)" + _HASHED.format(_FEATURES) + "SELECT k AS item_id, CAST(bucket AS BIGINT) AS bucket, round(value, 9) AS value FROM e")
def hashed_embedding(spark, sf_dir):
    return K.hashed_embedding(X.table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("value", F.round("value", 9))


@query(f"WITH t AS (SELECT doc_id AS k, {X.TERMS.format('text')} AS w FROM documents UNION ALL SELECT -1 - item_id, {X.TERMS.format('text')} FROM benchmark)" + _HASHED.format(_FEATURES) + "SELECT -1 - b.k AS query_id, a.k AS doc_id, round(sum(a.value * b.value), 8) + 0.0 AS raw_score FROM e a JOIN e b USING (bucket) WHERE a.k >= 0 AND b.k < 0 GROUP BY 1, 2")
def hashed_cosine(spark, sf_dir):
    scores = K.hashed_cosine(X.table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", "query_id")
    return scores.withColumn("raw_score", F.round("raw_score", 8) + 0.0)


@query(f"WITH t AS (SELECT doc_id AS k, {X.TERMS.format('text')} AS w FROM documents UNION ALL SELECT -1 - item_id, {X.TERMS.format('text')} FROM benchmark)" + _HASHED.format(_FEATURES) + ", s AS (SELECT -1 - b.k AS query_id, a.k AS doc_id, round(sum(a.value * b.value), 8) + 0.0 AS raw_score FROM e a JOIN e b USING (bucket) WHERE a.k >= 0 AND b.k < 0 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20")
def hashed_topk(spark, sf_dir):
    """The twenty documents nearest to each benchmark text; no table of all pairs."""
    return V.hashed_topk(X.table(spark, sf_dir, "documents"), _queries(spark, sf_dir), "doc_id", "query_id", 20)


def _gradients(spark, sf_dir):
    """Each vector at three checkpoints, scaled; a behavior gradient for each checkpoint is the mean vector of a label."""
    vectors = X.table(spark, sf_dir, "embeddings")
    scaled = vectors.select(F.col("vec_id").alias("key"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("checkpoint"), "embedding").select("key", "checkpoint", F.transform("embedding", lambda x: x.cast("double") * F.col("checkpoint")).alias("gradient"))
    cells = vectors.where("label < 3").select((F.col("label") + 1).alias("checkpoint"), F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("checkpoint", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    behaviors = means.groupBy("checkpoint").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("gradient"))
    return scaled, behaviors, vectors


_VECTORS = """WITH cells AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
b AS (SELECT label + 1 AS checkpoint, i, avg(x) AS m FROM cells WHERE label < 3 GROUP BY 1, 2) """


@query(_VECTORS + "SELECT vec_id AS key, round(sum(0.1 * checkpoint * checkpoint * x * m), 9) AS raw_score FROM cells JOIN b USING (i) GROUP BY 1")
def tracin_scores(spark, sf_dir):
    scaled, behaviors, _ = _gradients(spark, sf_dir)
    rates = spark.range(1, 4).select(F.col("id").cast("int").alias("checkpoint"), (F.col("id") * 0.1).alias("rate"))
    return K.tracin(scaled, behaviors, rates).withColumn("raw_score", F.round("raw_score", 9))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) / (sqrt(0.01 * CAST(x AS DOUBLE) * CAST(x AS DOUBLE) / (1 - pow(0.999, 10))) + 1e-8), 8) AS DECIMAL(18, 8))), ',') AS preconditioned FROM embeddings")
def adam_preconditioned(spark, sf_dir):
    rows = X.table(spark, sf_dir, "embeddings")
    second = F.transform("embedding", lambda x: 0.01 * x.cast("double") * x.cast("double"))
    made = K.adam_precondition(F.col("embedding"), second, F.lit(10))
    return rows.select("vec_id", F.array_join(F.transform(made, lambda x: F.round(x, 8).cast("decimal(18,8)").cast("string")), ",").alias("preconditioned"))


_SIGNS = "signs AS (SELECT r, c, CASE WHEN CAST('0x' || substr(sha256('7:' || r || ':' || c), 1, 1) AS INT) % 2 = 1 THEN 1.0 ELSE -1.0 END / sqrt(8.0) AS s FROM range(0, 8) a(r), range(0, 64) b(c)) "


@query(_VECTORS + f", {_SIGNS}" + "SELECT vec_id, CAST(r AS INT) AS dim, round(sum(x * s), 8) AS value FROM cells JOIN signs ON i = c GROUP BY 1, 2")
def rademacher_projection(spark, sf_dir):
    out = K.project(X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "7", 8, "embedding", "p")
    return out.select("vec_id", F.posexplode("p").alias("dim", "value")).withColumn("value", F.round("value", 8))


@query(_VECTORS + f", {_SIGNS}, g AS (SELECT vec_id, r, k, sum(s * (k * x) / (sqrt(0.01 * x * x * k * k / (1 - pow(0.999, k))) + 1e-8)) AS p FROM cells JOIN signs ON i = c, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2, 3), o AS (SELECT checkpoint AS k, r, sum(s * m) AS p FROM b JOIN signs ON i = c GROUP BY 1, 2)" + "SELECT vec_id AS key, round(sum(g.p * o.p), 8) AS raw_score FROM g JOIN o USING (k, r) GROUP BY 1")
def trajectory_sketch(spark, sf_dir):
    scaled, behaviors, _ = _gradients(spark, sf_dir)
    second = F.transform("gradient", lambda x: 0.01 * x * x)
    moved = scaled.withColumn("gradient", K.adam_precondition(F.col("gradient"), second, F.col("checkpoint")))
    left = K.project(moved, "7", 8, "gradient", "p").select("key", "checkpoint", F.col("p").alias("gradient"))
    right = K.project(behaviors, "7", 8, "gradient", "p").select("checkpoint", F.col("p").alias("gradient"))
    rates = spark.range(1, 4).select(F.col("id").cast("int").alias("checkpoint"), F.lit(1.0).alias("rate"))
    return K.tracin(left, right, rates).withColumn("raw_score", F.round("raw_score", 8))


@query(_VECTORS + f", {_SIGNS}, o AS (SELECT vec_id, r, sum(x * s) AS p FROM cells JOIN signs ON i = c GROUP BY 1, 2)" + "SELECT a.vec_id, round(sum(a.p * z.p), 8) AS raw_score FROM o a JOIN (SELECT r, p FROM o WHERE vec_id = 0) z USING (r) GROUP BY 1")
def projected_inner_product(spark, sf_dir):
    out = K.project(X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "7", 8, "embedding", "p")
    first = out.where("vec_id = 0").select(F.col("p").alias("q"))
    return out.crossJoin(F.broadcast(first)).select("vec_id", F.round(K.dot(F.col("p"), F.col("q")), 8).alias("raw_score"))


_METHODS = (("label", "quality"), ("toxic", "toxic"))
_SCORES = """WITH s AS (SELECT 'length' AS method_id, CAST(d.doc_id AS VARCHAR) AS occurrence_id, CAST(n_chars AS DOUBLE) AS raw_score FROM documents d JOIN labels USING (doc_id)
UNION ALL SELECT 'words', CAST(d.doc_id AS VARCHAR), CAST(len(string_split(text, ' ')) AS DOUBLE) FROM documents d JOIN labels USING (doc_id)
UNION ALL SELECT 'toxic', CAST(doc_id AS VARCHAR), CAST(toxic AS DOUBLE) FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY method_id ORDER BY raw_score DESC, occurrence_id) AS rank FROM s) """


def _rankings(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id")
    key = F.col("doc_id").cast("string").alias("occurrence_id")
    scores = docs.select(key, F.explode(F.map_from_arrays(F.array(F.lit("length"), F.lit("words")), F.array(F.col("n_chars").cast("double"), F.size(F.split("text", " ")).cast("double")))).alias("method_id", "raw_score"))
    toxic = X.table(spark, sf_dir, "labels").select(key, F.lit("toxic").alias("method_id"), F.col("toxic").cast("double").alias("raw_score"))
    return K.ranked(K.union_rankings(scores, toxic), ["method_id"])


@query(_SCORES + "SELECT method_id, occurrence_id, raw_score, rank FROM r")
def union_rankings(spark, sf_dir):
    return _rankings(spark, sf_dir).select("method_id", "occurrence_id", "raw_score", "rank")


@query(_SCORES + "SELECT occurrence_id, round(sum(1.0 / (60 + rank)), 10) AS rrf, string_agg(method_id || '=' || rank, ',' ORDER BY method_id) AS ranks FROM r GROUP BY 1")
def rrf_fusion(spark, sf_dir):
    fused = K.reciprocal_rank_fusion(_rankings(spark, sf_dir))
    ranks = F.array_join(F.transform(F.array_sort(F.map_entries("method_ranks")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return fused.select("occurrence_id", F.round("rrf", 10).alias("rrf"), ranks.alias("ranks"))


@query(_SCORES + "SELECT occurrence_id, round(sum(1.0 / (60 + rank)), 10) AS rrf FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def fused_candidate_limit(spark, sf_dir):
    fused = K.reciprocal_rank_fusion(_rankings(spark, sf_dir)).select("occurrence_id", F.round("rrf", 10).alias("rrf"))
    return K.candidates(fused, 40)


@query(_SCORES + "SELECT method_id, occurrence_id, rank FROM r WHERE rank <= CASE method_id WHEN 'length' THEN 10 WHEN 'words' THEN 5 ELSE 0 END")
def quota_union(spark, sf_dir):
    return K.quota_union(_rankings(spark, sf_dir), {"length": 10, "words": 5, "toxic": 0}).select("method_id", "occurrence_id", "rank")


@query(_SCORES + "SELECT method_id, count(*) AS n, min(rank) AS low, max(rank) AS high, count(DISTINCT rank) AS kinds, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS valid FROM r GROUP BY 1")
def ranking_validity(spark, sf_dir):
    return K.ranking_issues(_rankings(spark, sf_dir))


@query(_SCORES + ", v AS (SELECT CAST(doc_id AS VARCHAR) AS occurrence_id FROM labels WHERE quality = 0) SELECT method_id, CAST(count(v.occurrence_id) AS BIGINT) AS hits, round(count(v.occurrence_id) / count(*), 9) AS precision, round(count(v.occurrence_id) / (SELECT count(*) FROM v), 9) AS recall FROM r LEFT JOIN v USING (occurrence_id) WHERE rank <= 25 GROUP BY 1")
def precision_recall_at_k(spark, sf_dir):
    relevant = X.table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("occurrence_id"))
    return K.precision_recall(_rankings(spark, sf_dir), relevant, 25).select("method_id", "hits", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_RANKED = "WITH w AS (SELECT lang, doc_id, n_chars, len(string_split(text, ' ')) AS n_words FROM documents), a AS (SELECT lang, doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS x, rank() OVER (PARTITION BY lang ORDER BY n_words) + (count(*) OVER (PARTITION BY lang, n_words) - 1) / 2.0 AS y FROM w) "


def _sizes(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"))


@query(_RANKED + "SELECT lang, round(corr(x, y), 9) AS rho FROM a GROUP BY 1")
def spearman_correlation(spark, sf_dir):
    return K.spearman(_sizes(spark, sf_dir), "n_chars", "n_words", ["lang"]).withColumn("rho", F.round("rho", 9))


@query(_RANKED + "SELECT doc_id, CAST(x AS DOUBLE) AS average_rank FROM a")
def average_ranks(spark, sf_dir):
    return K.average_ranks(_sizes(spark, sf_dir), "n_chars", "average_rank", ["lang"]).select("doc_id", F.col("average_rank").cast("double").alias("average_rank"))
