"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Each text's counts give a vector of transformed statistics. Per language and source,
minimum-covariance-determinant estimates (location and scatter of the densest part)
come from concentration steps: keep the share of rows nearest the last estimate, estimate
again, as long as the determinant falls. Steps go from three deterministic starts (spreads alone, correlations of
bounded scores, correlations of directions), and a group takes the one with the least determinant. Scatters are
regularised: to each statistic's variance that of chance is added, so that a statistic that hardly varies can't
make a determinant of zero. A text is rejected by its Mahalanobis distance. Quantiles come from counts per bin,
so that no group is gathered anywhere: a group sends at most its bins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import release, written

BLANK = "[\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\f\r"
#: The statistics, and the spread that chance gives each in any text.
CHANCE = {"length": 1.0, "symbols": 0.3, "lines": 0.14, "repeats": 0.1}
#: Bins a unit of each statistic, for medians: fifty to the spread of chance.
BINS = {a: round(50 / s) for a, s in CHANCE.items()}
#: Share of a group that the estimates rest on; fewer outliers than the rest can't move them far.
SHARE = 0.6
#: Makes the scatter of the nearest 0.6 of four-dimensional normal rows that of all: 0.6 / P(chi2_6 < chi2_4 quantile of 0.6).
CONSISTENT = 1.824
#: Squared distance of a rejected text: the chi2_4 quantile of 1 - 1e-9.
CUT = 48.1
#: Steps end when no group's log determinant falls by more than this (bins let the share vary by as much), or after so many.
SETTLED, MOST_STEPS = 0.02, 30
#: Rows that a language and source need for estimates of their own; smaller ones share their language's, then one for all.
LEAST_ROWS = 50
P = "__q_"
NAMES = list(CHANCE)


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with __q_n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    c = lambda name: F.col(P + name)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    docs = docs.withColumn(P + "words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK)))
    docs = docs.withColumn(P + "lines", F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""))
    docs = docs.withColumn(P + "n_words", F.size(c("words")).cast("long"))
    five = F.transform(F.slice(c("words"), 1, F.greatest(F.lit(0), F.size(c("words")) - 4)), lambda w, i: F.xxhash64(w, *(F.get(c("words"), i + j) for j in range(1, 5))))
    docs = docs.withColumn(P + "five", five)
    docs = docs.withColumn(P + "same", F.when(F.size(F.array_distinct(c("five"))) < F.size(c("five")), F.sort_array(F.transform(c("five"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = F.filter(c("same"), lambda x, i: ((i > 0) & (F.get(c("same"), i - 1)["h"] == x["h"])) | (F.get(c("same"), i + 1)["h"] == x["h"]))
    docs = docs.withColumn(P + "at", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(c("at"), F.struct(F.lit(-5).alias("before"), F.lit(0).cast("long").alias("total")), lambda a, x: F.struct(x.alias("before"), (a["total"] + F.least(F.lit(5), x - a["before"])).alias("total")), lambda a: a["total"])
    docs = docs.withColumn(P + "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    docs = docs.withColumn(P + "word_chars", F.char_length(F.array_join(c("words"), "")).cast("long"))
    docs = docs.withColumn(P + "n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    docs = docs.withColumn(P + "n_lines", F.size(c("lines")).cast("long"))
    docs = docs.withColumn(P + "n_dup_lines", c("n_lines") - F.size(F.array_distinct(c("lines"))))
    docs = docs.withColumn(P + "base_failed", (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words")))
    return docs.drop(*(P + x for x in ("words", "lines", "five", "same", "at")))


def binned_quantile(rows: DataFrame, by: list[str], value: Column, share: float, per_unit: int, name: str) -> DataFrame:
    """by, name: the upper edge of the bin of width 1/per_unit where each group's share of values is reached."""
    bins = rows.groupBy(*by, F.floor(value * per_unit).alias("__bin")).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy("__bin")
    reached = bins.withColumn("__c", F.sum("__n").over(order)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    return reached.where(F.col("__c") >= F.ceil(F.col("__all") * share)).groupBy(*by).agg(((F.min("__bin") + 1) / per_unit).alias(name))


def pools(rows: DataFrame) -> DataFrame:
    """__q_lang, __q_source, __q_pool: whose estimates a language and source take."""
    keys = [P + "lang", P + "source"]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < LEAST_ROWS).groupBy(P + "lang").agg(F.sum("n").alias("of_lang"))
    both = sizes.join(small, P + "lang", "left")
    pool = F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("source "), F.to_json(F.struct(*keys)))).when(F.col("of_lang") >= LEAST_ROWS, F.concat(F.lit("lang "), F.col(P + "lang"))).otherwise("all")
    return both.select(*keys, pool.alias(P + "pool"))


def distance(rows: DataFrame) -> DataFrame:
    """rows, joined with estimates m_i and l_ij (lower Cholesky factors), with __q_d2: forward substitution, squares summed."""
    solved: list[Column] = []
    for i, a in enumerate(NAMES):
        rest = F.col(f"__qx_{a}") - F.col(f"__qm_{a}")
        for j in range(i):
            rest = rest - F.col(f"__ql_{i}{j}") * F.col(f"__qy_{j}")
        rows = rows.withColumn(f"__qy_{i}", rest / F.col(f"__ql_{i}{i}"))
        solved.append(F.col(f"__qy_{i}"))
    return rows.withColumn(P + "d2", reduce(lambda a, b: a + b, [y * y for y in solved])).drop(*(f"__qy_{i}" for i in range(len(NAMES))))


def factors(moments: DataFrame, by: list[str]) -> DataFrame:
    """by, m_i, l_ij, __q_logdet from means m_i and covariances c_ij: chance on the diagonal, Cholesky, log determinant."""
    for i, a in enumerate(NAMES):
        for j in range(i + 1):
            own = F.coalesce(F.col(f"__qc_{i}{j}"), F.lit(0.0)) * CONSISTENT
            moments = moments.withColumn(f"__qc_{i}{j}", own + CHANCE[a] ** 2 if i == j else own)
    for i in range(len(NAMES)):
        for j in range(i + 1):
            left = F.col(f"__qc_{i}{j}")
            for k in range(j):
                left = left - F.col(f"__ql_{i}{k}") * F.col(f"__ql_{j}{k}")
            moments = moments.withColumn(f"__ql_{i}{j}", F.sqrt(F.greatest(left, F.lit(1e-6))) if i == j else left / F.col(f"__ql_{j}{j}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.ln(f"__ql_{i}{i}") for i in range(len(NAMES))])
    return moments.select(*by, *(f"__qm_{a}" for a in NAMES), *(f"__ql_{i}{j}" for i in range(len(NAMES)) for j in range(i + 1)), logdet.alias(P + "logdet"))


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def starts(rows: DataFrame) -> DataFrame:
    """__q_pool, __q_start, m_i, c_ij of rows (__q_pool, __qx_*): medians, with three scatters from scores by median distances:
    independent; of tanh of the scores; of the scores' directions."""
    pool = [P + "pool"]
    middle = written(reduce(lambda a, b: a.join(b, P + "pool"), [binned_quantile(rows, pool, F.col(f"__qx_{a}"), 0.5, BINS[a], f"__qm_{a}") for a in NAMES]), "quality-start")
    spread = reduce(lambda a, b: a.join(b, P + "pool"), [binned_quantile(rows.join(middle, P + "pool"), pool, F.abs(F.col(f"__qx_{a}") - F.col(f"__qm_{a}")), 0.5, BINS[a], f"__qs_{a}") for a in NAMES])
    spread = spread.select(*pool, *(F.sqrt(F.pow(1.4826 * F.col(f"__qs_{a}"), 2) + CHANCE[a] ** 2).alias(f"__qs_{a}") for a in NAMES))
    both = written(middle.join(spread, P + "pool"), "quality-start")
    scored = rows.join(both, P + "pool")
    for a in NAMES:
        scored = scored.withColumn(f"__qz_{a}", (F.col(f"__qx_{a}") - F.col(f"__qm_{a}")) / F.col(f"__qs_{a}"))
    norm = F.greatest(F.sqrt(reduce(lambda a, b: a + b, [F.col(f"__qz_{a}") ** 2 for a in NAMES])), F.lit(1e-9))
    turned = scored.withColumn(P + "norm", norm)
    bounded = [F.avg(F.tanh(f"__qz_{NAMES[i]}") * F.tanh(f"__qz_{NAMES[j]}")).alias(f"__qb_{i}{j}") for i, j in _pairs()]
    pointed = [F.avg(F.col(f"__qz_{NAMES[i]}") * F.col(f"__qz_{NAMES[j]}") / F.col(P + "norm") ** 2).alias(f"__qd_{i}{j}") for i, j in _pairs()]
    told = turned.groupBy(P + "pool").agg(*bounded, *pointed).join(both, P + "pool")
    scale = lambda i, j: F.col(f"__qs_{NAMES[i]}") * F.col(f"__qs_{NAMES[j]}")
    shapes = [lambda i, j: F.lit(1.0 if i == j else 0.0), lambda i, j: F.col(f"__qb_{i}{j}"), lambda i, j: F.col(f"__qd_{i}{j}")]
    parts = [told.select(*pool, F.lit(n).alias(P + "start"), *(f"__qm_{a}" for a in NAMES), *((shape(i, j) * scale(i, j)).alias(f"__qc_{i}{j}") for i, j in _pairs())) for n, shape in enumerate(shapes)]
    return reduce(DataFrame.unionByName, parts)


def determinants(rows: DataFrame) -> DataFrame:
    """__q_pool, __q_start, m_i, l_ij, __q_logdet: of each pool of rows (__q_pool, __qx_*) the estimates with the least determinant found.

    A pool's best is kept at every step, so a step whose determinant rises (bins let the share vary) does no harm."""
    by = [P + "pool", P + "start"]
    xs = [f"__qx_{a}" for a in NAMES]
    estimate = written(factors(starts(rows), by), "quality-estimate")
    best = None
    for _ in range(MOST_STEPS):
        measured = distance(rows.join(estimate, P + "pool")).select(*by, *xs, F.log2(F.col(P + "d2") + 1e-6).alias("log"))
        limit = binned_quantile(measured, by, F.col("log"), SHARE, 64, "limit")
        nearest = measured.join(limit, by).where("log < limit")
        moments = nearest.groupBy(*by).agg(*(F.avg(f"__qx_{a}").alias(f"__qm_{a}") for a in NAMES), *(F.covar_pop(f"__qx_{NAMES[i]}", f"__qx_{NAMES[j]}").alias(f"__qc_{i}{j}") for i, j in _pairs()))
        now = written(factors(moments, by), "quality-estimate")
        fallen = 1.0
        if best is None:
            kept = now
        else:
            new, old = (x.select(*by, F.struct(P + "logdet", *(c for c in x.columns if c not in (*by, P + "logdet"))).alias(n)) for x, n in ((now, "new"), (best, "old")))
            met = new.join(old, by)
            fallen = met.agg(F.max(F.col(f"old.{P}logdet") - F.col(f"new.{P}logdet"))).first()[0] or 0.0
            kept = written(met.select(*by, F.least("old", "new").alias("s")).select(*by, "s.*").select(*now.columns), "quality-best")
        if best is not None and best is not estimate:
            release(best)
        best, estimate = kept, now
        if fallen <= SETTLED:
            break
    least = best.groupBy(P + "pool").agg(F.min(F.struct(P + "logdet", P + "start", *(c for c in best.columns if c not in (*by, P + "logdet")))).alias("s"))
    return written(least.select(P + "pool", "s.*"), "quality-least")


def judged(docs: DataFrame) -> DataFrame:
    """docs (a written table with the counts too) with __q_kept.

    Null texts have no words and fail the base rule; null languages and sources are groups like
    others; an empty table stays empty; rows that repeat count each."""
    kept = [c for c in docs.columns if c not in ("__q_lang", "__q_source")]
    docs = with_counts(docs)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    docs = written(docs.withColumn(P + "lang", text_of("lang")).withColumn(P + "source", text_of("source")), "quality-counts")
    c = lambda name: F.col(P + name)
    good = docs.where(~c("base_failed")).select(P + "lang", P + "source", P + "n_words", P + "word_chars", P + "n_symbols", P + "n_lines", P + "n_dup_lines", P + "n_repeat_words")
    pool = written(pools(good), "quality-pools")
    keys = [P + "lang", P + "source"]
    centre = written(binned_quantile(good.join(pool, keys), [P + "pool"], c("word_chars") / c("n_words"), 0.5, 200, "__q_centre"), "quality-centres")

    def vectors(rows: DataFrame) -> DataFrame:
        rows = rows.join(pool, keys, "left").join(centre, P + "pool", "left")
        n = F.greatest(c("n_words"), F.lit(1)).cast("double")  # a text without words has failed; its vector only mustn't divide by zero
        return (
            rows.withColumn("__qx_length", (c("word_chars") - n * F.col("__q_centre")) / F.sqrt(n)).withColumn("__qx_symbols", F.log1p(100 * c("n_symbols") / F.greatest(c("word_chars"), F.lit(1))))
            .withColumn("__qx_lines", c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))).withColumn("__qx_repeats", c("n_repeat_words") / n).drop("__q_centre")
        )

    xs = [f"__qx_{a}" for a in NAMES]
    rows = written(vectors(good).select(P + "pool", *xs), "quality-vectors")
    estimate = determinants(rows)
    told = distance(vectors(docs).join(estimate, P + "pool", "left"))
    verdict = ~c("base_failed") & (F.coalesce(c("d2"), F.lit(0.0)) <= CUT)
    counts = [P + x for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return told.withColumn(P + "kept", verdict).select(*kept, *counts, P + "d2", P + "logdet", P + "kept")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance, log_determinant of every row.

    distance is the Mahalanobis distance, log_determinant that of the group's scatter; both are null where the base rule failed and the
    group has no estimate. Null texts have no words and fail; null languages and sources are groups; rows that repeat count each;
    a null id stays null; an empty table gives no rows; other columns aren't read."""
    rows = judged(docs.select("doc_id", F.col("text"), F.col("lang"), F.col("source"))).drop("text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(P + n).alias(n) for n in names), F.sqrt(P + "d2").alias("distance"), F.col(P + "logdet").alias("log_determinant"))


def keep(docs: DataFrame) -> DataFrame:
    """docs without the texts that the rules reject, columns as they are."""
    return judged(docs).where(P + "kept").select(*docs.columns)
