"""Candidate scores, stable rankings and their fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.functions.tokens import words
from tracewell.operators import sweep
from tracewell.operators.retrieval import MOST_ASKED, Hashed, blocks, bm25_all
from tracewell.operators.timeline import FEW, beside, few, few_of
from tracewell.sources.shared import spread

RRF_CONSTANT = 60


#: Terms of queries that go to every task.
TERMS = 200_000
#: Rows of a ranking that one task sorts.
SORTED = 1_000_000


def ranked(scores: DataFrame, by: list[str], score: str = "raw_score", key: str = "occurrence_id", most: int | None = None, sorted_rows: int = SORTED) -> DataFrame:
    """rank 1..n by falling score, then key; without ties.

    With most, only ranks up to it: a filter on row_number that Spark pushes below the shuffle as a group limit. Without, rankings
    that are too long for a task are swept by range."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    if most is not None:
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    if few(scores, sorted_rows):
        return scores.withColumn("rank", F.row_number().over(order))
    place = scores.withColumn("__falling", -F.col(score))
    return sweep.sweep(place, by, ["__falling", key], {"rank": ("sum", F.lit(1).cast("long"))}).withColumn("rank", F.col("rank").cast("int")).drop("__falling")


def bm25(documents: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", query: str = "query_id", k1: float = 1.5, b: float = 0.75, most: int = TERMS) -> DataFrame:
    """query, doc, raw_score: Okapi BM25 of every document for each query's distinct terms.

    idf is ln(1 + (N - df + 0.5) / (df + 0.5)). Documents without a term aren't listed (their score is zero). Queries of few terms go to
    every task, where a document meets them all; of more, terms are counted before the shuffle and joined."""
    asked = queries.select(F.col(query), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    told = few_of(asked.withColumnRenamed("term", "t"), most)
    if told is not None:
        return bm25_all(documents, told, doc, query, dict(queries.dtypes)[query], text, k1, b)
    terms = asked.select("term").distinct()
    listed = documents.select(F.col(doc), words(F.col(text)).alias("w"))
    lengths = listed.select(doc, F.size("w").alias("len"))
    corpus = lengths.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"))
    tf = listed.select(doc, F.size("w").alias("len"), F.explode("w").alias("term")).join(terms, "term").groupBy(doc, "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # from the same exchange
    weighed = tf.join(df, "term").crossJoin(F.broadcast(corpus))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return weighed.select(doc, "term", part.alias("part")).join(asked, "term").groupBy(query, doc).agg(F.sum("part").alias("raw_score"))


def random_score(seed: Column, key: Column) -> Column:
    """The first 64 bits of SHA-256(seed, NUL, key) over 2^64."""
    digest = F.sha2(F.concat(seed.cast("string"), F.lit("\0"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def temporal(events: DataFrame, windows: DataFrame, step: str = "step", most: int = FEW) -> DataFrame:
    """events with distance and raw_score 1 / (1 + distance) to the nearest window (start, stop; closed); null without windows.

    Few windows are merged where they overlap, which changes no distance; then the nearest is that which starts last at or before
    the step, or the next one, found by halving in a task. More are swept together with the events."""
    told = few_of(windows.select("start", "stop").where("start IS NOT NULL"), most)
    if told is None:
        return sweep.distances(events, windows, step).withColumn("raw_score", 1 / (1 + F.col("distance")))
    told = told.take(pc.sort_indices(told, [("start", "ascending")]))
    reach = list(accumulate(told["stop"].to_pylist(), lambda a, b: b if a is None or b is not None and b > a else a))
    marks = pa.table({"start": told["start"], "reach": pa.array(reach, told["stop"].type)})  # how far the windows that began by then reach
    placed = beside(events, step, marks, "start", {"__reach": "reach"}, {"__next": "start"})
    nearest = F.least(F.when(F.col("__reach").isNotNull(), F.greatest(F.lit(0), F.col(step) - F.col("__reach"))), F.col("__next") - F.col(step)).cast("long")
    return placed.withColumn("distance", nearest).withColumn("raw_score", 1 / (1 + F.col("distance"))).drop("__reach", "__next")


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """key, vector: array of (bucket, value), the unit vector of each row's signed hashed words and adjacent pairs, by bucket.

    A batch of rows is hashed by its distinct features and summed by bucket, without a shuffle."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hashed(dim)
        for block in blocks(batches):
            dense = own.units(block.column("w"))
            x, y = np.nonzero(dense)
            ends = pa.array(np.searchsorted(x, np.arange(block.num_rows + 1)).astype(np.int32))
            cells = pa.StructArray.from_arrays([pa.array(y.astype(np.int64)), pa.array(dense[x, y])], ["bucket", "value"])
            yield pa.RecordBatch.from_arrays([block.column(key), pa.ListArray.from_arrays(ends, cells)], [key, "vector"])

    return spread(rows.select(key, text)).select(key, words(F.col(text)).alias("w")).mapInArrow(run, f"`{key}` {kind}, vector array<struct<bucket: bigint, value: double>>")


def hashed_embedding(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """key, bucket, value: the same, a row for each bucket that isn't zero."""
    return hashed_vectors(rows, key, text, dim).select(key, F.explode("vector").alias("e")).select(key, "e.bucket", "e.value")


def hashed_cosine(rows: DataFrame, asked: DataFrame, key: str, asked_key: str, text: str = "text", dim: int = 256) -> DataFrame:
    """key, asked_key, raw_score: dot products of the rows' vectors with all asked ones that share a bucket with them. For the best few of each see hashed_topk.

    Asked vectors are few: after a check of their number they go to the tasks as a matrix, and a batch of rows is multiplied by it;
    more than that meet by a join on buckets."""
    if not few(asked, MOST_ASKED // dim):
        return sparse_dot(hashed_embedding(rows, key, text, dim), hashed_embedding(asked, asked_key, text, dim), key, asked_key)
    told = asked.select(asked_key, words(F.col(text)).alias("w")).toArrow()
    names = pa.array(told[asked_key].to_pylist(), to_arrow_type(asked.schema[asked_key].dataType))
    matrix = Hashed(dim).units(pa.array(told["w"].to_pylist(), pa.list_(pa.string()))).T.copy()
    there = (matrix != 0).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Hashed(dim)
        for block in blocks(batches):
            dense = own.units(block.column("w"))
            x, y = np.nonzero((dense != 0).astype(np.float32) @ there > 0)
            yield pa.RecordBatch.from_arrays([block.column(key).take(pa.array(x)), names.take(pa.array(y)), pa.array((dense @ matrix)[x, y])], [key, asked_key, "raw_score"])

    kinds = dict(rows.dtypes)[key], dict(asked.dtypes)[asked_key]
    return spread(rows.select(key, text)).select(key, words(F.col(text)).alias("w")).mapInArrow(run, f"`{key}` {kinds[0]}, `{asked_key}` {kinds[1]}, raw_score double")


def sparse_dot(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """left_key, right_key, raw_score: dot products of sparse vectors that share a bucket; right is the side of few vectors."""
    r = right.select(right_key, "bucket", F.col("value").alias("other"))
    return left.join(r, "bucket").groupBy(left_key, right_key).agg(F.sum(F.col("value") * F.col("other")).alias("raw_score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tracin(gradients: DataFrame, behaviors: DataFrame, rates: DataFrame, key: str = "key") -> DataFrame:
    """key, raw_score: sum over checkpoints of rate times <gradient, behavior gradient>; checkpoints that all three have.

    behaviors and rates have a row a checkpoint; they are broadcast where their numbers are few enough, else joined."""
    per = behaviors.withColumnRenamed("gradient", "behavior").join(rates, "checkpoint")
    numbers = behaviors.agg(F.sum(F.size("gradient"))).first()[0] or 0
    return gradients.join(F.broadcast(per) if numbers <= MOST_ASKED else per, "checkpoint").groupBy(key).agg(F.sum(F.col("rate") * dot(F.col("gradient"), F.col("behavior"))).alias("raw_score"))


def adam_precondition(gradient: Column, second: Column, step: Column, beta2: float = 0.999, eps: float = 1e-8) -> Column:
    """g / (sqrt(v / (1 - beta2^t)) + eps)."""
    corrected = 1 - F.pow(F.lit(beta2), step)
    return F.zip_with(gradient, second, lambda g, v: g.cast("double") / (F.sqrt(v.cast("double") / corrected) + eps))


def rademacher_sign(seed: str, row: Column, column: Column) -> Column:
    """+1 or -1 by the low bit of a hash of seed, row and column."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), row.cast("string"), column.cast("string")), 256)
    return F.when(F.conv(F.substring(digest, 1, 1), 16, 10).cast("int") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))


#: Columns of signs that are made at a time.
COLUMNS = 1 << 14


def sign_block(seed: str, target: int, first: int, last: int) -> np.ndarray:
    """The signs of source components first to last, a row each: the same low bits as rademacher_sign."""
    made = [hashlib.sha256(f"{seed}:{r}:{c}".encode()).digest()[0] >> 4 & 1 for c in range(first, last) for r in range(target)]
    return (np.array(made, np.float64) * 2 - 1).reshape(last - first, target)


def project(rows: DataFrame, seed: str, target: int, vector: str, out: str, columns: int = COLUMNS, most: int = MOST_ASKED) -> DataFrame:
    """rows with out: target signed sums of their vector's components over sqrt(target). Vectors of any length, nulls give null.

    Signs are hashes of counters, made in the task a block of components at a time, and vectors are folded by block: no matrix is
    sent or held whole. The first blocks, up to most numbers, are kept from batch to batch; further ones are made again."""
    names = [c for c in rows.columns if c != out]
    kinds = dict(rows.dtypes)
    width = max(1, min(columns, most // target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            listed = batch.column("__v")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(listed), 0), np.int64)
            flat = np.asarray(pc.fill_null(listed.flatten(), 0.0), np.float64)
            starts, sums = np.cumsum(sizes) - sizes, np.zeros((len(sizes), target))
            for first in range(0, int(sizes.max(initial=0)), width):
                signs = held.get(first)
                if signs is None:
                    keep = (len(held) + 1) * width * target <= most
                    signs = sign_block(seed, target, first, first + width if keep else min(first + width, int(sizes.max())))
                    if keep:
                        held[first] = signs
                for a in range(0, len(sizes), 1024):
                    own = np.minimum(np.maximum(sizes[a : a + 1024] - first, 0), width)
                    part = np.zeros((len(own), int(own.max(initial=0))))
                    at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                    part[np.repeat(np.arange(len(own)), own), at] = flat[np.repeat(starts[a : a + 1024] + first, own) + at]
                    sums[a : a + 1024] += part @ signs[: part.shape[1]]
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * target), pa.array((sums / np.sqrt(float(target))).ravel()), mask=listed.is_null())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], [*names, out])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{out}` array<double>"])
    return rows.select(*names, F.transform(vector, lambda x: x.cast("double")).alias("__v")).mapInArrow(run, schema)


def reciprocal_rank_fusion(rankings: DataFrame, constant: int = RRF_CONSTANT) -> DataFrame:
    """occurrence_id, rrf, method_ranks: sum of 1 / (constant + rank) over methods (method_id, occurrence_id, rank)."""
    return rankings.groupBy("occurrence_id").agg(F.sum(1 / (constant + F.col("rank"))).alias("rrf"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("method_id", "rank")))).alias("method_ranks"))


def candidates(fused: DataFrame, limit: int) -> DataFrame:
    """The limit best of a fusion, ties by occurrence; between 1 and 1,000,000."""
    if not 1 <= limit <= 1_000_000:
        raise ValueError("between 1 and 1,000,000 candidates")
    return fused.orderBy(F.desc("rrf"), "occurrence_id").limit(limit)


def union_rankings(*rankings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rankings)


def quota_union(rankings: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """The first quota rows of each method; a method without a quota, or a negative one, is refused."""
    if any(q < 0 for q in quotas.values()):
        raise ValueError("a quota can't be negative")
    quota = F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("method_id")) if quotas else F.lit(None)
    checked = F.when(quota.isNull(), F.raise_error(F.concat(F.lit("no quota for method "), "method_id")).cast("int")).otherwise(quota)
    return rankings.where(F.col("rank") <= checked)


def ranking_issues(rankings: DataFrame) -> DataFrame:
    """Per method whether its ranks are 1..n, each once."""
    per = rankings.groupBy("method_id").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.countDistinct("rank").alias("kinds"))
    return per.withColumn("valid", (F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("kinds") == F.col("n")))


def precision_recall(ranking: DataFrame, relevant: DataFrame, k: int, key: str = "occurrence_id") -> DataFrame:
    """method_id, hits, precision (of min(k, n)) and recall of the first k; relevant has a row for each key."""
    total = relevant.select(key).distinct()
    top = ranking.where(F.col("rank") <= k).join(total.withColumn("hit", F.lit(1)), key, "left")
    per = top.groupBy("method_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return per.crossJoin(F.broadcast(total.agg(F.count("*").alias("relevant")))).select("method_id", "hits", (F.col("hits") / F.col("n")).alias("precision"), F.coalesce(F.try_divide("hits", "relevant"), F.lit(0.0)).alias("recall"))


def average_ranks(rows: DataFrame, value: str, out: str, by: list[str]) -> DataFrame:
    """rows with out: the mean of the ranks that ties share, from the least value; nulls are the least.

    Only the distinct values of a group and how often each occurs are put in order; rows meet theirs by a join."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate([*by, value])), (before + (F.col("__n") + 1) / 2).alias(out))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([*by, value])])
    return rows.join(told, same, "left").drop(*(f"__{i}" for i in range(len(by) + 1)))


def spearman(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, rho: correlation of average ranks; zero where either is constant."""
    both = average_ranks(average_ranks(rows, a, "__ra", by), b, "__rb", by)
    return both.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_pop("__ra", "__rb"), F.stddev_pop("__ra") * F.stddev_pop("__rb")), F.lit(0.0)).alias("rho"))
