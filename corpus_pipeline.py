"""The corpus pipeline: quality rules, quality classifier, near copies, repeated passages, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import classifier, packing, quality, repeats, simhash
from tracewell.llm.common import held_out, release, release_unread, spread, table, tables_there, trim, written
from tracewell.llm.queries import tokenizer_path

#: Words of a passage that counts as repeated.
PASSAGE_WORDS = 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage wrote on its way.
_made: set[str] = set()


def tidied(stage: Stage) -> Stage:
    """stage, after the tables of the one before are deleted but for what docs still reads: its result has been written by then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_unread(_made, docs)
        _made.clear()
        trim()
        before = tables_there()
        out = stage(spark, docs, sf_dir)
        _made.update(tables_there() - before)
        return out

    return run


@tidied
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that the rules or their robust distance reject.

    Null, empty and wordless texts have too few words and go; rows that repeat are judged alike; null languages and sources
    are groups of their own; an empty table stays empty; other columns, whatever their names, come through as they are."""
    return quality.keep(spread(docs))


@tidied
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the texts that the classifier scores below 0.7; it learns from the labelled documents that are left.

    Null and empty texts score as the labels' share; without labelled rows all score 0.5 and go; rows that repeat score alike;
    an empty table stays empty; other columns come through as they are."""
    model = classifier.fit(docs.where(~held_out(4, 2)), table(spark, sf_dir, "labels"))
    return classifier.keep(spread(docs), model, threshold=0.7)


@tidied
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. SimHash blocks find them first, the
    sets decide, and a join of the sets finds those whose fingerprints are too far apart.

    The least doc_id of a group stays, a null one last; null, empty and wordless texts are copies of each other; of rows that
    repeat one stays; an empty table stays empty; other columns come through as they are."""
    return simhash.keep_one(spread(docs), words=5, similarity=0.8)


@tidied
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 50 words or more that occur twice or more, anywhere, every occurrence; n_chars tells the text that is left.

    Null texts stay null, and a text that is all passage stays as an empty one; rows that repeat are each other's passages; an
    empty table stays empty; other columns come through as they are."""
    left = repeats.remove_repeats(spread(docs), repeats.word_unit(PASSAGE_WORDS))
    kind = dict(docs.dtypes).get("n_chars")
    return left.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns) if kind else left


@tidied
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 2048 tokens.

    Null and empty texts are the end token alone; rows that repeat are packed each; a null doc_id stays null; an empty table
    gives no pieces."""
    return packing.pack(spread(docs), tokenizer_path(), max_tokens=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the fits and fingerprints; tests hold stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents; a stage's goes when the next one's is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(last)
    return docs
