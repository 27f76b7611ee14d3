"""Queries on identities, duplicates, groups and sources."""

from pyspark.sql import functions as F

from tracewell.functions import canonical as C
from tracewell.operators import rows as R
from tracewell.plans import fixtures as X
from tracewell.plans import query

_JSON = """'{"canonicalization_version":1,"completion":' || to_json(nfc_normalize(completion)) || ',"labels":null,"metadata":{},"prompt":' || to_json(nfc_normalize(prompt)) || ',"sample_weight":' || CAST(sample_weight AS VARCHAR) || '}'"""


def _identified(spark, sf_dir):
    rows = X.examples(spark, sf_dir)
    return rows.withColumn("example_id", C.example_id(C.nfc(F.col("prompt")), C.nfc(F.col("completion")), F.col("sample_weight")))


@query(f"WITH {X.EXAMPLES} SELECT source_row, 'ex_' || sha256({_JSON}) AS example_id FROM examples")
def example_identity(spark, sf_dir):
    return _identified(spark, sf_dir).select("source_row", "example_id")


_OCC = """'occ_' || sha256('{"batch_position":' || (source_row % 4) || ',"example_id":"' || e || '","global_step":' || (source_row // 4) || ',"identity_schema_version":1,"microbatch_index":0,"packed_token_span":{"end":' || (strlen(prompt) + strlen(completion) + 3) || ',"start":0},"run_id":"run"}')"""


@query(f"WITH {X.EXAMPLES} SELECT source_row, {_OCC} AS occurrence_id FROM (SELECT *, 'ex_' || sha256({_JSON}) AS e FROM examples)")
def occurrence_identity(spark, sf_dir):
    from tracewell.functions.tokens import sft_length

    rows = _identified(spark, sf_dir)
    made = C.occurrence_id(F.lit("run"), F.floor(F.col("source_row") / 4), F.lit(0), F.col("source_row") % 4, F.lit(0), sft_length(F.col("prompt"), F.col("completion")), F.col("example_id"))
    return rows.select("source_row", made.alias("occurrence_id"))


@query(f"""WITH {X.EXAMPLES} SELECT source_row // 4 AS step, 'pack_' || sha256('{{"batch_position":0,"examples":["' || string_agg('ex_' || sha256({_JSON}), '","' ORDER BY source_row) || '"],"microbatch":0,"packed_sequence_count":' || (source_row // 4) || ',"run_id":"run","step":' || (source_row // 4) || '}}') AS packed_id FROM examples GROUP BY source_row // 4""")
def packed_identity(spark, sf_dir):
    """Ids of sequences of four examples, a sequence a step."""
    step = F.floor(F.col("source_row") / 4)
    own = F.transform(F.sort_array(F.collect_list(F.struct("source_row", "example_id"))), lambda x: x["example_id"])
    rows = _identified(spark, sf_dir).groupBy(step.alias("step")).agg(own.alias("examples"))  # four a group
    return rows.select("step", C.packed_id(F.lit("run"), F.col("step"), F.lit(0), F.lit(0), F.col("step"), F.col("examples")).alias("packed_id"))


@query(f"WITH {X.EXAMPLES} SELECT count(*) AS n, count(*) FILTER (regexp_full_match('ex_' || sha256({_JSON}), 'ex_[0-9a-f]{{64}}')) AS valid FROM examples")
def identity_pattern(spark, sf_dir):
    return _identified(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("example_id").rlike(C.EXAMPLE_ID)).alias("valid"))


_KEYS = "SELECT sha256(coalesce(text, '')) AS key, doc_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS n FROM documents"


def _keyed(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))


@query(_KEYS)
def duplicate_groups_all(spark, sf_dir):
    return R.duplicate_groups(_keyed(spark, sf_dir), "key", "doc_id")


@query(_KEYS + " QUALIFY n > 1")
def duplicate_groups_multi(spark, sf_dir):
    return R.duplicate_groups(_keyed(spark, sf_dir), "key", "doc_id", 2)


def _policy(name, policy, key_sql, window=1):
    sql = f"WITH {X.OCCURRENCES}, m AS (SELECT DISTINCT '{policy}:' || {key_sql} AS group_id, occurrence_id FROM occurrences) SELECT group_id, occurrence_id, count(*) OVER (PARTITION BY group_id) AS n FROM m"

    def run(spark, sf_dir):
        return R.grouped(X.occurrences(spark, sf_dir), policy, window)

    run.__name__ = name
    query(sql)(run)


_policy("group_by_occurrence", "occurrence", "occurrence_id")
_policy("group_by_example", "example", "CAST(example_id AS VARCHAR)")
_policy("group_by_source", "source", "source")
_policy("group_by_time_window", "time_window", "CAST(step // 10 AS VARCHAR)", 10)
_policy("group_by_metadata", "metadata:k", "coalesce(json_extract_string(metadata, '$.k'), 'null')")


@query(f"WITH {X.OCCURRENCES} SELECT source, sha256(string_agg(sha256(occurrence_id), chr(10) ORDER BY occurrence_id) || chr(10)) AS digest, count(*) AS n FROM occurrences GROUP BY 1")
def history_hash(spark, sf_dir):
    rows = X.occurrences(spark, sf_dir).withColumn("event_hash", F.sha2("occurrence_id", 256))
    return R.ordered_digest(rows, ["source"], ["occurrence_id"], "event_hash")


@query(f"WITH {X.EXAMPLES} SELECT source, sha256(string_agg({_JSON}, chr(10) ORDER BY source_row) || chr(10)) AS digest, count(*) AS n FROM examples GROUP BY 1")
def dataset_fingerprint(spark, sf_dir):
    rows = X.examples(spark, sf_dir)
    rows = rows.withColumn("record", C.example_json(C.nfc(F.col("prompt")), C.nfc(F.col("completion")), F.col("sample_weight")))
    return R.ordered_digest(rows, ["source"], ["source_row"], "record")


@query(f"WITH {X.EXAMPLES} SELECT source_row, prompt, completion, 'null' AS labels_json, '{{\"turn\":' || turn || '}}' AS metadata_json, CASE WHEN source = 'conv0' THEN 1.0 ELSE sample_weight END AS sample_weight FROM examples")
def role_projection(spark, sf_dir):
    """Roles picked by declared names; missing labels are null, metadata a JSON object, a missing weight one."""
    from tracewell.sources.datasets import Roles, project_roles

    raw = X.examples(spark, sf_dir).select("source_row", F.col("prompt").alias("question"), F.col("completion").alias("answer"), "turn", F.when(F.col("source") != "conv0", F.col("sample_weight")).alias("importance"))
    return project_roles(raw, Roles("question", "answer", metadata=("turn",), weight="importance"), "source_row")


@query("SELECT doc_id, CASE WHEN text = '' OR text IS NULL THEN 'completion is empty' ELSE 'weight outside' END AS reason FROM documents WHERE text = '' OR text IS NULL OR n_chars > 10000")
def rejected_rows(spark, sf_dir):
    from tracewell.sources.datasets import rejections

    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("prompt"), F.col("text").alias("completion"), (F.col("n_chars") / 10.0).alias("sample_weight"))
    return rejections(docs, "doc_id")


@query(f"WITH {X.OCCURRENCES} SELECT step, occurrence_id, source FROM occurrences WHERE step >= 100 AND step < 140")
def step_range_scan(spark, sf_dir):
    return X.occurrences(spark, sf_dir).where("step >= 100 AND step < 140").select("step", "occurrence_id", "source")


@query(f"WITH {X.OCCURRENCES} SELECT occurrence_id, source, count(*) OVER (PARTITION BY example_id) AS uses FROM occurrences WHERE source <> 'error'")
def eligible_occurrences(spark, sf_dir):
    """Removal may name rows that aren't reserved (error events stand for reserved rows)."""
    from pyspark.sql import Window

    rows = X.occurrences(spark, sf_dir).where(F.col("source") != F.lit("error"))
    return rows.select("occurrence_id", "source", F.count("*").over(Window.partitionBy("example_id")).alias("uses"))


@query("SELECT p.item_id, i.doc_id, d.source, substr(sha256(d.text), 1, 12) AS text_hash FROM (SELECT item_id, item_id * 7 AS doc_id FROM benchmark) p JOIN labels i ON p.doc_id = i.doc_id JOIN documents d ON d.doc_id = i.doc_id")
def two_hop_lookup(spark, sf_dir):
    items = X.table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 7).alias("doc_id"))
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "source", F.substring(F.sha2("text", 256), 1, 12).alias("text_hash"))
    return items.join(X.table(spark, sf_dir, "labels").select("doc_id"), "doc_id").join(docs, "doc_id").select("item_id", "doc_id", "source", "text_hash")


@query("SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def family_attach(spark, sf_dir):
    """Each member with its family and the family's size; no family is gathered."""
    both = X.table(spark, sf_dir, "documents").select("doc_id", "source").join(X.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id")
    sizes = both.groupBy(F.col("source").alias("family")).agg(F.count("*").alias("n"))
    return both.join(sizes, F.col("source").eqNullSafe(F.col("family"))).select("doc_id", "source", "n")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def anti_join_unknown(spark, sf_dir):
    return X.table(spark, sf_dir, "labels").select("doc_id").join(X.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def semi_join_eligible(spark, sf_dir):
    return X.table(spark, sf_dir, "labels").select("doc_id", "quality").join(X.table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id"), "doc_id", "left_semi")


@query("SELECT 'left' AS side, count(*) AS n FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 1) HAVING count(*) > 0 UNION ALL SELECT 'right', count(*) FROM (SELECT lang, source FROM documents WHERE doc_id % 2 = 1 EXCEPT ALL SELECT lang, source FROM documents WHERE doc_id % 2 = 0) HAVING count(*) > 0")
def set_equality(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    return R.differences(docs.where("doc_id % 2 = 0").select("lang", "source"), docs.where("doc_id % 2 = 1").select("lang", "source"))


@query("SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS completion FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def conversation_pairs(spark, sf_dir):
    """Each user turn with the assistant's next one, by an equi join of the table with itself."""
    turns = X.table(spark, sf_dir, "conversations")
    left = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("next"))
    right = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("next"), F.col("text").alias("completion"))
    return left.join(right, ["conv_id", "next"]).drop("next")


@query("""SELECT event_id, '{"list":["' || event_type || '","' || event_type || chr(233) || '",null],"map":{"' || event_type || '":' || CAST(value AS VARCHAR) || '},"props":{"k":' || (props->>'$.k') || '},"z":' || CAST(value * 1e20 AS VARCHAR) || ',"' || chr(233) || '":true}' AS record FROM events""")
def canonical_records(spark, sf_dir):
    """Nested structs, arrays and maps as canonical JSON: keys in order and composed, large numbers as Python prints them."""
    kind, value = F.col("event_type"), F.col("value")
    events = X.table(spark, sf_dir, "events")
    record = events.select(
        "event_id", (value * 1e20).alias("z"), F.lit(True).alias("e\u0301"), F.from_json("props", "k int").alias("props"),
        F.array(kind, F.concat(kind, F.lit("e\u0301")), F.lit(None)).alias("list"), F.create_map(kind, value).alias("map"),
    )
    fields = record.drop("event_id")
    return record.select("event_id", C.canonical_column(F.struct(*fields.columns), fields.schema).alias("record"))


@query("""SELECT event_id, '{"a":' || CAST(CAST(CAST(value AS VARCHAR) || 'E1' AS DOUBLE) AS VARCHAR) || ',"b":{"k":' || (props->>'$.k') || '}}' AS record FROM events""")
def canonical_props(spark, sf_dir):
    """JSON texts in canonical form."""
    text = F.concat(F.lit('{ "b" :'), F.col("props"), F.lit(',\n"\\u0061": '), F.col("value").cast("string"), F.lit("E1}"))
    return X.table(spark, sf_dir, "events").select("event_id", C.canonical_text(text).alias("record"))


_PATTERNS = {"two_numbers": ".*[0-9]+.*[0-9]+.*", "no_number": "[^0-9]*", "sentences": r"[^.]*\.[^.]*\.[^!]*", "worst": "[a-z ]*[a-zA-Z ]*[a-zA-Z ]*[a-zA-Z, ]*[a-zA-Z,. ]*#"}


@query("SELECT doc_id, " + ", ".join(f"regexp_full_match(text, '{p}') AS {n}" for n, p in _PATTERNS.items()) + " FROM documents")
def safe_patterns(spark, sf_dir):
    """Whole texts against patterns, of which a backtracking engine would try the last over and over."""
    from tracewell.functions.safe_regex import full_match

    return X.table(spark, sf_dir, "documents").select("doc_id", *(full_match(F.col("text"), p).alias(n) for n, p in _PATTERNS.items()))
