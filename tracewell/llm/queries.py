"""The queries opN_<name> and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import audio, bpe, classifier, html, lm, merkle, mixing, negatives, packing, quality, repeats, simhash, warc
from tracewell.llm.common import held_out, spread, table, written

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under the model of those that aren't held out, its counts, the unigram base and perplexity.

    Null and empty texts are their end alone; rows that repeat score alike; a null id is held out; extra columns aren't read; an empty table gives no rows."""
    return lm.score(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 400 bytes that start anywhere else, and its words in passages of 50 that occur elsewhere.

    Null texts are empty; texts below 400 bytes keep all; rows that repeat are each other's copies; a null id stays null; extra columns aren't read; an empty table gives no rows."""
    return repeats.digest_repeats(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), min_bytes=400)


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document; kept only where its statistics lie near those of its language and source.

    Null and empty texts fail the base rule; null languages and sources are groups; rows that repeat count each; a null id stays null; extra columns aren't read; an empty table gives no rows."""
    return quality.verdicts(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")))


def op4_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document.

    Null, empty and wordless texts have fingerprint zero, linked like others; rows that repeat share a fingerprint; a null id is no component's least unless all are null; extra columns aren't read; an empty table gives no rows."""
    return simhash.classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), words=3, max_bits=3)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens.

    Null and empty texts are the end token; rows that repeat are packed each; a null id stays null; extra columns aren't read; an empty table gives no rows."""
    return packing.pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path(), max_tokens=2048, end_id=0)


def op6_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rebuilt record of the pages' archive tells.

    Null html is empty, a null url too; of equal payloads the largest page_id is the response, and a null id counts as the least; rows that repeat it are responses too; extra columns aren't read; an empty table gives no rows."""
    return warc.read(*warc.archive(table(spark, sf_dir, "pages")))


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from a table of media, each text stored as mu-law samples, its decoded sound as 16-bit samples at 16 kHz, and features of that.

    Null and empty texts are 64 zero bytes; equal texts have equal values; a null id stays null; extra columns aren't read; an empty table gives no rows."""
    media = written(audio.store(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), "media")
    return audio.read_back(media)


def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digest of each text's ids, and digest of what they decode to.

    Null texts are empty and have no ids; rows that repeat are encoded each; equal ranks merge from the left; a null id stays null; extra columns aren't read; an empty table gives no rows."""
    return bpe.round_trip(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), tokenizer_path())


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page.

    Null and empty html have none; null urls share a wrapper; rows that repeat count each; a null id stays null; extra columns aren't read; an empty table gives no rows."""
    return html.main_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op10_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score by a classifier that learns from the labelled rows that aren't held out.

    Null, empty and wordless texts get the score of no evidence; rows that repeat score alike; a null id isn't held out; labels other than 0 and 1 aren't learned; extra columns aren't read; an empty table gives no rows."""
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(4, 2)
    model = classifier.fit(docs.where(~out), table(spark, sf_dir, "labels"))
    return classifier.score(spread(docs), model, out, threshold=0.7)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, subroot, root and proof, and what its siblings lead to after the texts of a third have been lower-cased.

    A null field is written as -; a null language is the first group; a null id comes first and isn't tampered with; rows that repeat are leaves each; texts may have any length; extra columns aren't read; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(spread(docs), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first negatives of each anchor and positive whose scores lie within the positive's window.

    Null labels and vectors and null or infinite components take no part; ties go by id, null ids last; rows that repeat are rows each; long vectors are met by panels; extra columns aren't read; an empty table gives no rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(negatives.quantised(spread(vectors)), F.col("id") % 100 == 0)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words that the mix takes of it.

    Null and wordless texts have size 0; a null source is the last; a null id is sorted like others; rows that repeat count each; extra columns aren't read; an empty table gives no rows."""
    return mixing.taken(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


QUERIES = {f.__name__: f for f in (op1_pitman_yor, op2_suffix_array_dedup, op3_robust_outliers, op4_simhash_blocks, op5_best_fit_packing, op6_content_addressed_warc, op7_telephony_audio, op8_segment_tree_bpe, op9_wrapper_induction, op10_subword_classifier, op11_merkle_manifest, op12_hard_negatives, op13_mixing)}

ORACLES: dict[str, str] = {
    "op6_content_addressed_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
        w AS (SELECT html, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
            CASE WHEN n >= 1000 AND p.page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND p.page_id IS DISTINCT FROM m THEN m END AS refers_to
        FROM p LEFT JOIN w ON p.html = w.html""",
    "op11_merkle_manifest": merkle.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_mixing": mixing.SQL,
}
