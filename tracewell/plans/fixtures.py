"""Stand-ins for a recorded run, derived from the supplied tables; retrieval labels and states here are no causal findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.rows import numbered
from tracewell.operators.timeline import presence_state

#: Events in a step, steps between checkpoints, and the level and half-width of a checkpoint's presence interval.
BATCH, EVERY, LEVEL, HALF = 20, 25, 49.5, 0.5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_row, conv_id, turn, prompt, completion, source, sample_weight: each user turn that an assistant's follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("completion"))
    pairs = turns.where("role = 'user' AND next_role = 'assistant' AND completion <> ''").drop("role", "next_role")
    rows = numbered(pairs, F.floor(F.col("conv_id") / 64), [F.col("conv_id"), F.col("turn")])
    return rows.select("source_row", "conv_id", "turn", "prompt", "completion", F.concat(F.lit("conv"), (F.col("conv_id") % 5).cast("string")).alias("source"), (0.5 + (F.col("conv_id") % 3) * 0.25).alias("sample_weight"))


EXAMPLES = """turns AS (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS next_role, lead(text) OVER w AS completion FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
examples AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS source_row, conv_id, turn, prompt, completion, 'conv' || (conv_id % 5) AS source, CAST(0.5 + (conv_id % 3) * 0.25 AS DOUBLE) AS sample_weight FROM turns WHERE role = 'user' AND next_role = 'assistant' AND completion <> '')"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, occurrence_id, example_id, source, value, metadata: events in order of time, twenty a step."""
    events = table(spark, sf_dir, "events")
    rows = numbered(events, F.date_trunc("hour", "ts"), [F.col("ts"), F.col("event_id")], "at")
    return rows.select(F.floor(F.col("at") / BATCH).alias("step"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("occurrence_id"), F.col("user_id").alias("example_id"), F.col("event_type").alias("source"), "value", F.col("props").alias("metadata"))


OCCURRENCES = f"""occurrences AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // {BATCH} AS step, 'e' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS occurrence_id, user_id AS example_id, event_type AS source, value, props AS metadata FROM events)"""


def checkpoints(rows: DataFrame) -> DataFrame:
    """step and hash of every checkpoint of occurrences."""
    steps = rows.select((F.floor(F.col("step") / EVERY) * EVERY).alias("step")).distinct()
    return steps.select("step", F.concat(F.lit("ck_"), F.substring(F.sha2(F.col("step").cast("string"), 256), 1, 16)).alias("hash"))


CHECKPOINTS = f"""checkpoints AS (SELECT DISTINCT (step // {EVERY}) * {EVERY} AS step, 'ck_' || substr(sha256(CAST((step // {EVERY}) * {EVERY} AS VARCHAR)), 1, 16) AS hash FROM occurrences)"""


def points(rows: DataFrame) -> DataFrame:
    """run, step, score, state: mean value from a checkpoint to the next, and whether its interval is on one side of the level."""
    per = rows.groupBy((F.floor(F.col("step") / EVERY) * EVERY).alias("step")).agg(F.round(F.avg("value"), 6).alias("score"))
    return per.select(F.lit("r").alias("run"), "step", "score", presence_state(F.col("score") - HALF, F.col("score") + HALF, LEVEL).alias("state"))


POINTS = f"""points AS (SELECT 'r' AS run, step, score, CASE WHEN score - {HALF} >= {LEVEL} THEN 'PRESENT' WHEN score + {HALF} < {LEVEL} THEN 'ABSENT' ELSE 'UNCERTAIN' END AS state
FROM (SELECT (step // {EVERY}) * {EVERY} AS step, round(avg(value), 6) AS score FROM occurrences GROUP BY 1))"""
WINDOWS = """pairs AS (SELECT *, lead(step) OVER (ORDER BY step) AS next_step, lead(state) OVER (ORDER BY step) AS next_state FROM points),
windows AS (SELECT step AS start, next_step AS stop, state AS from_state, next_state AS to_state, CASE WHEN 'UNCERTAIN' IN (state, next_state) THEN 'UNSTABLE' WHEN next_state = 'PRESENT' THEN 'ABSENT_TO_PRESENT' ELSE 'PRESENT_TO_ABSENT' END AS kind
FROM pairs WHERE next_step IS NOT NULL AND (state <> next_state OR state = 'UNCERTAIN'))"""
RUN = f"WITH {OCCURRENCES}, {CHECKPOINTS}, {POINTS}, {WINDOWS} "
#: Terms as the ranking tokenizer has them, in SQL.
TERMS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"


def kinds(spark: SparkSession, sf_dir: str) -> list[str]:
    """The event types of the table, in order: the candidate groups, at most twelve."""
    found = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().limit(13).collect()]
    if len(found) > 12:
        raise ValueError("between 1 and 12 groups")
    return sorted(found)


def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subset, accepted, effect, controls_passed, recall, seconds: each set of event types that a user had on some day, with the mean value of such days as its effect."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_set("event_type")).alias("subset"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))  # a set of few kinds
    per = days.groupBy("subset").agg(F.sum("cents").alias("cents"), F.count("*").alias("days"), F.max("n").alias("most"))
    value = F.round(F.col("cents") / 100.0 / F.col("days"), 6)
    return per.select("subset", value.alias("effect"), (value >= 100.0).alias("accepted"), (F.col("most") <= 6).alias("controls_passed"), F.round(F.least(F.lit(1.0), F.col("days") / 50.0), 6).alias("recall"), (F.col("days") * 0.5).alias("seconds"))


SUBSETS = """days AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type ORDER BY event_type) AS subset, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n FROM events GROUP BY 1, 2),
subsets AS (SELECT subset, CAST(round(CAST(sum(cents) AS DOUBLE) / 100.0 / count(*), 6) AS DOUBLE) AS effect, round(CAST(sum(cents) AS DOUBLE) / 100.0 / count(*), 6) >= 100.0 AS accepted, max(n) <= 6 AS controls_passed,
CAST(round(least(1.0, count(*) / 50.0), 6) AS DOUBLE) AS recall, CAST(count(*) * 0.5 AS DOUBLE) AS seconds FROM days GROUP BY 1)"""
