"""The verbs of a causal-debugging session: init, train, inspect, audit, test, bisect, index, blame, replay, verify, report."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import ranking as K
from tracewell.operators import timeline as T
from tracewell.replay import evidence as E
from tracewell.replay import search, store
from tracewell.replay import training as R
from tracewell.sources.files import initialize, outside

init = initialize
train = R.record
test = R.branch
METHODS = ("random", "temporal", "bm25", "hashed", "tracin", "trajectory")


def audit(recording: R.Recording, start: int, stop: int, tolerance: float = 1e-5, path: str | Path | None = None) -> dict:
    """Replays an unchanged stretch and grades it; with a run's folder the result is kept there."""
    found = R.audit(recording, start, stop, tolerance)
    if path is not None:
        store.save_audit(path, [found])
    return found


def verify(bundle: str | Path, recording: R.Recording | None = None, contract: R.Contract | None = None) -> dict:
    """The certificate of a bundle that holds in itself and, where they are given, against its run and contract."""
    if (recording is None) != (contract is None):
        raise ValueError("a run is checked with its contract")
    return E.read_bundle(bundle) if recording is None else E.check_source(bundle, recording, contract)


def write_index(ranking: DataFrame, path: str | Path) -> None:
    """A ranking as Parquet by method, and JSON lines of each method in order of rank; both are written by the cluster."""
    out = str(path).rstrip("/")
    ranking.write.partitionBy("method_id").parquet(f"{out}/index")
    told = ranking.select("method_id", F.to_json(F.struct("rank", "occurrence_id", "raw_score")).alias("value"), "rank")
    told.repartitionByRange("method_id", "rank").sortWithinPartitions("method_id", "rank").select("method_id", "value").write.partitionBy("method_id").text(f"{out}/json")


def inspect(spark: SparkSession, recording: R.Recording) -> dict:
    """Counts of a run and whether every step has its batches."""
    t = R.ledgers(spark, recording)
    row = t["occurrences"].agg(F.count("*").alias("n"), F.count_if("reserved").alias("reserved"), F.countDistinct("example_id").alias("examples")).first()
    steps = t["steps"].count()
    return {"run_hash": recording.run_hash(), "steps": steps, "microbatches": len(recording.events), "occurrences": row["n"], "reserved": row["reserved"], "examples": row["examples"], "checkpoints": sorted(recording.checkpoints), "complete": steps * recording.training.microbatches == len(recording.events)}


def bisect(spark: SparkSession, recording: R.Recording, contract: R.Contract) -> tuple[DataFrame, DataFrame]:
    """Timeline points of every checkpoint, and transition windows; the points are evaluated once."""
    points = R.timeline(spark, recording, contract).cache()
    return points, T.transitions(points, ["run"])


def index(spark: SparkSession, recording: R.Recording, contract: R.Contract, methods: tuple[str, ...] = METHODS, seed: int = 0, projected: int = 16) -> DataFrame:
    """method_id, occurrence_id, raw_score, rank of every method; the timeline is evaluated once, for the windows."""
    occurrences = R.ledgers(spark, recording)["occurrences"].select("occurrence_id", "example_id", "step").cache()
    examples = spark.createDataFrame([(e["example_id"], e["prompt"] + " " + e["completion"]) for e in {x["example_id"]: x for x in recording.examples}.values()], "example_id string, text string")
    events = occurrences.join(examples, "example_id")
    query = spark.createDataFrame([(0, contract.query_text())], "query_id int, text string")
    parts: dict[str, DataFrame] = {}
    if "random" in methods:
        parts["random"] = occurrences.select("occurrence_id", K.random_score(F.lit(seed), F.col("occurrence_id")).alias("raw_score"))
    if "temporal" in methods:
        _, windows = bisect(spark, recording, contract)
        chosen = windows.where("kind = 'ABSENT_TO_PRESENT'").select("start", "stop")
        if chosen.isEmpty():
            last = sorted(recording.checkpoints)[-2:]
            chosen = spark.createDataFrame([(last[0], last[-1])], "start long, stop long")
        parts["temporal"] = K.temporal(occurrences, chosen).select("occurrence_id", "raw_score")
    if "bm25" in methods:
        parts["bm25"] = occurrences.join(K.bm25(events, query, doc="occurrence_id").select("occurrence_id", "raw_score"), "occurrence_id", "left").select("occurrence_id", F.coalesce("raw_score", F.lit(0.0)).alias("raw_score"))
    if "hashed" in methods:
        dots = K.hashed_cosine(events, query, "occurrence_id", "query_id")
        parts["hashed"] = occurrences.join(dots.select("occurrence_id", "raw_score"), "occurrence_id", "left").select("occurrence_id", F.coalesce("raw_score", F.lit(0.0)).alias("raw_score"))
    if {"tracin", "trajectory"} & set(methods):
        gradients = R.gradients(spark, recording).cache()
        probes = [(c, R.objective_gradient(R.view(recording, s), contract.scorer, contract.search).tolist()) for c, s in sorted(recording.checkpoints.items())]
        size = len(probes[0][1])
        behaviors = spark.createDataFrame(probes, "checkpoint long, gradient array<double>")
        rates = spark.createDataFrame([(c, recording.training.optimizer.rate) for c in recording.checkpoints], "checkpoint long, rate double")
        if "tracin" in methods:
            parts["tracin"] = _fan_out(K.tracin(gradients, behaviors, rates), occurrences)
        if "trajectory" in methods:
            seconds = spark.createDataFrame([(c, [float(x) for n in sorted(s.model) for x in s.moments[n][1].ravel()]) for c, s in recording.checkpoints.items() if s.step], "checkpoint long, second array<double>")
            o = recording.training.optimizer
            moved = gradients.join(F.broadcast(seconds) if size * len(recording.checkpoints) <= K.MOST_ASKED else seconds, "checkpoint").withColumn("gradient", K.adam_precondition(F.col("gradient"), F.col("second"), F.col("checkpoint"), o.beta2, o.eps))
            left = K.project(moved, str(seed), projected, "gradient", "p").select("key", "checkpoint", F.col("p").alias("gradient"))
            right = K.project(behaviors, str(seed), projected, "gradient", "p").select("checkpoint", F.col("p").alias("gradient"))
            parts["trajectory"] = _fan_out(K.tracin(left, right, rates.withColumn("rate", F.lit(1.0))), occurrences)
    named = [rows.select(F.lit(name).alias("method_id"), "occurrence_id", "raw_score") for name, rows in parts.items()]
    return K.ranked(K.union_rankings(*named), ["method_id"])


def _fan_out(scores: DataFrame, occurrences: DataFrame) -> DataFrame:
    return occurrences.join(scores.withColumnRenamed("key", "example_id"), "example_id").select("occurrence_id", "raw_score")


def blame(
    spark: SparkSession, recording: R.Recording, contract: R.Contract, output: str | Path, candidates: int = 8, budget: int = 64, width: int = 8, methods: tuple[str, ...] = METHODS, normalization: str = "fixed", lease: str | Path | None = None
) -> dict | None:
    """Ranks, searches, replays the winner with the holdout unsealed and writes a bundle; None where no patch is accepted.

    Rankings propose; only the executed replays are evidence. normalization: whether losses keep their recorded denominators or are
    divided by the weights that are left. lease: a folder where the holdout's one use is kept for all processes."""
    renormalize = normalization == "renormalized"
    end = max(recording.checkpoints)
    stretch = sorted(recording.checkpoints)[-2:]
    grade = audit(recording, stretch[0], stretch[-1])["grade"]
    if grade == "FAILED" or not contract.controls or not contract.holdout:
        raise ValueError("blame needs an audited run, a control and a holdout")
    seen = contract.search_view()
    ranking = index(spark, recording, seen, methods).cache()
    eligible = R.ledgers(spark, recording)["occurrences"].where(~F.col("reserved")).select("occurrence_id")
    fused = K.candidates(K.reciprocal_rank_fusion(ranking).join(eligible, "occurrence_id", "left_semi"), candidates)
    names = [r["occurrence_id"] for r in fused.select("occurrence_id").collect()]  # at most candidates rows
    found = search.reduce(R.evaluator(spark, recording, seen, {n: [n] for n in names}, renormalize=renormalize), names, budget, width)
    if found.selected is None:
        return None
    document = E.PatchDocument(recording.run_hash(), contract.content_hash(), (("remove", 0.0, tuple(sorted(found.selected))),), normalization)
    document.check(recording.run_hash(), contract.content_hash(), {s["occurrence_id"] for e in recording.events for s in e["spans"]})
    result = R.branch(recording, seen, document.to_patch(), renormalize=renormalize)
    sealed = R.branch(recording, contract, document.to_patch(), R.Holdout(contract, lease).unseal(document.hash()), renormalize)
    after = R.replay(recording, R.start_for(recording, document.to_patch()), end, document.to_patch(), renormalize)
    controls = [{"id": str(c.get("id", i)), "drift": d, "limit": contract.drift_limit, "passed": d <= contract.drift_limit} for i, (c, d) in enumerate(zip(contract.controls, result["drift"], strict=True))]
    certificate = {
        "schema_version": 1, "run_hash": document.run_hash, "contract_hash": document.contract_hash, "patch_hash": document.hash(), "patch": document.body(), "audit_grade": grade,
        "original_state": recording.checkpoints[end].hashes()["model"], "counterfactual_state": result["state_hash"], "effect": result["effect"], "required_effect": contract.required_effect,
        "controls_passed": result["controls_passed"], "holdout_passed": sealed["accepted"], "status": result["status"], "minimality_grade": found.grade, "replay_budget": budget, "replay_count": found.replays,
        "speculative_replays": found.speculative, "claim": E.claim_for(result["status"], sealed["accepted"], result["controls_passed"], grade), "environment": E.environment(),
        "original_score": result["original"], "counterfactual_score": result["counterfactual"], "controls": controls, "removals": [{"removed": i, "accepted": a} for i, a in found.minimality],
        "complete_subsets": False, "warnings": ["interactions were seen: subsets of what was tested may act otherwise"] if found.interactions else [],
    }
    rows = [r.asDict() for r in ranking.where(F.col("occurrence_id").isin(names) | (F.col("rank") <= 100)).orderBy("method_id", "rank").collect()]
    dense = [{"method_id": r["method_id"], "occurrence_id": r["occurrence_id"], "rank": i + 1} for m in sorted({r["method_id"] for r in rows}) for i, r in enumerate(x for x in rows if x["method_id"] == m)]
    tested = [{"subset": sorted(s), "accepted": o["accepted"], "effect": o["effect"], "controls": o["controls_passed"], "status": o["status"], "hash": o["experiment_hash"]} for s, o in found.experiments]
    E.write_bundle(outside(output), certificate, {"ranking.json": json.dumps(dense).encode(), "experiments.json": json.dumps(tested).encode(), **E.tensor_files(after.model)})
    return certificate


def replay(recording: R.Recording, contract: R.Contract, bundle: str | Path) -> bool:
    """Whether the bundle's patch, executed again, gives what it certifies."""
    certificate = E.read_bundle(bundle)
    patch = {i: (op, factor) for op, factor, names in certificate["patch"]["operations"] for i in names}
    return E.verify_again(certificate, R.branch(recording, contract, patch, renormalize=certificate["patch"]["normalization"] == "renormalized"))


def report(bundle: str | Path, form: str = "markdown") -> str:
    return {"markdown": E.markdown, "html": E.html_report}[form](bundle)
