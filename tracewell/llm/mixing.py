"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a target of words: its weight's share of the whole mix, at most so many times its own size, and what that
cuts off goes to the others by weight. Documents get hash-random keys and are sorted by range within their source; prefix
sums of their sizes, summed by range first, tell where the source's budget ends. A budget above the source's size takes
whole epochs first; the document where the rest ends gives its first words, so that every budget is met exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, running, unused, written

BLANKS = " \t\n\x0b\f\r"
BLANK = "[\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: The mix has 3/2 of all words; no source gives more than twice its own.
SHARE, MOST_EPOCHS = (3, 2), 2
SEED = "mix"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """__m_source, __m_source_size, __m_target of sizes (__m_source, not null, its order that of the weights; __m_source_size).

    Resharing what the bounds cut off, again and again, ends at one level: a source gets least(most_epochs * size, level * weight).
    Sources by bound over weight, least first: those at their bound are the first of them, and prefix sums tell how many."""
    numerator, denominator = share
    placed = running(sizes, [], [F.col("__m_source").asc()], F.lit(1).cast("long"), "__m_rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("__m_rank_before") % len(weights) + 1).cast("int")).cast("long")
    weighed = written(placed.select("__m_source", "__m_source_size", weight.alias("__m_weight")), "mixing-weights")
    ratio = [(F.col("__m_source_size") / F.col("__m_weight")).asc(), F.col("__m_source").asc()]
    sized = running(weighed, [], ratio, F.col("__m_source_size"), "__m_size")
    both = written(running(sized, [], ratio, F.col("__m_weight"), "__m_w"), "mixing-levels")
    #: What is left for the sources from this one on, and their weights; the first source that its bound doesn't hold tells the level.
    left = numerator * F.col("__m_size_all") - denominator * most_epochs * F.col("__m_size_before")
    rest = F.col("__m_w_all") - F.col("__m_w_before")
    free = left.cast("double") * F.col("__m_weight") <= (denominator * most_epochs * F.col("__m_source_size")).cast("double") * rest
    level = both.where(free).agg(F.min(F.struct(F.col("__m_size_before"), F.col("__m_w_before"), left.alias("left"), rest.alias("rest"))).alias("level"))
    bound = (most_epochs * F.col("__m_source_size")).cast("double")
    got = (F.col("level.left") * F.col("__m_weight")).cast("double") / (denominator * F.col("level.rest")).cast("double")
    out = both.join(F.broadcast(level))
    return out.select("__m_source", "__m_source_size", F.when(F.col("level").isNull(), bound).otherwise(F.least(got, bound)).alias("__m_target"))


def taken(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most_epochs: int = MOST_EPOCHS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source), and its column row if one is named.

    taken: words that the mix takes, repeats counted; a source's sum is its target, rounded. Null and wordless texts have size 0
    and give nothing; a null source is one, the last in order; a null doc_id has a key like others; rows that repeat count each, and
    which of several equal rows the budget cuts doesn't show; an empty table gives no rows; other columns aren't read."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("-"))))
    there = docs.select(doc_id.alias("doc_id"), source.alias("__m_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("__m_key"), F.xxhash64(text).alias("__m_text"), *([row] if row else []))
    there = written(there, "mixing-sizes")
    sizes = written(there.groupBy("__m_source").agg(F.sum("size").alias("__m_source_size")), "mixing-sources")
    order = [F.col("__m_key").asc(), F.col("doc_id").asc(), F.col("size").asc(), F.col("__m_text").asc()]
    sums = running(there, ["__m_source"], order, F.col("size"), "__m_sum").join(targets(sizes, weights, share, most_epochs), "__m_source")
    budget = F.round("__m_target").cast("long")
    size = F.greatest(F.col("__m_source_size"), F.lit(1))
    epochs = F.floor(budget / size)
    cut = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("__m_source_size") - F.col("__m_sum_before")))
    out = epochs * F.col("size") + cut
    return sums.select("doc_id", "size", F.col("__m_source_size").alias("source_size"), F.col("__m_target").alias("target"), out.cast("long").alias("taken"), *([row] if row else []))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, most_epochs: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the columns of docs and an epoch from 0, a row for each time that a document is taken; its text is what is taken.

    The document where a budget ends gives its first words, without blanks at either end; others give their whole texts. Wordless and
    null texts give no row; rows that repeat are taken each; an empty table gives no rows; a column called epoch keeps its name and the
    new one gets an underscore."""
    row, epoch = unused(docs, "__m_row"), unused(docs, "epoch")
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "mixing-documents")
    uses = taken(kept, weights, share, most_epochs, seed, row).where("taken > 0").select(row, F.col("size").alias("__m_size"), F.col("taken").alias("__m_taken"))
    each = kept.join(uses, row).withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__m_taken") - 1) / F.col("__m_size")))))
    words = F.least(F.col("__m_size"), F.col("__m_taken") - F.col(epoch) * F.col("__m_size"))
    whole = F.ltrim(F.col("text"), F.lit(BLANKS))
    after = F.element_at(F.split(whole, BLANK, (words + 1).cast("int")), -1)
    first = F.rtrim(F.left(whole, F.char_length(whole) - F.char_length(after)), F.lit(BLANKS))
    return each.withColumn("text", F.when(words < F.col("__m_size"), first).otherwise(F.col("text"))).select(*docs.columns, epoch)


SQL = r"""
    WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
    p AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
        CAST(sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s),
    l AS (SELECT 3 * total - 4 * before AS l_left, rest AS l_rest FROM p WHERE (3 * total - 4 * before) * w <= 4 * source_size * rest ORDER BY before, rest DESC LIMIT 1),
    t AS (SELECT source, source_size, least(CAST(l_left * w AS DOUBLE) / CAST(2 * l_rest AS DOUBLE), CAST(2 * source_size AS DOUBLE)) AS target FROM p, l),
    o AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '-')), d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, CAST((budget // greatest(source_size, 1)) * size + greatest(0, least(size, budget - (budget // greatest(source_size, 1)) * source_size - before)) AS BIGINT) AS taken FROM o"""
