"""Recorded runs on disk, opened only if every part agrees with the rest; and a cache of executed replays."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import tokens
from tracewell.functions.canonical import cache_key
from tracewell.operators.reduction import stale_entries
from tracewell.replay import training as R
from tracewell.replay.model import AdamW, ModelConfig, config_dict
from tracewell.sources import datasets, files
from tracewell.sources.ledger import open_ledger, write_ledger

TENSORS = "step long, part string, name string, dtype string, shape array<int>, data binary, alias string, sha256 string"


def tensor_rows(recording: R.Recording) -> list[tuple]:
    """A row for each tensor of each checkpoint; tied tensors carry their bytes once, under the first name."""
    rows = []
    for step, state in sorted(recording.checkpoints.items()):
        parts = [("model", n, t) for n, t in sorted(state.model.items())] + [(k, n, t) for n, pair in sorted(state.moments.items()) for k, t in zip("mv", pair, strict=True)]
        first: dict[int, str] = {}
        for part, name, t in parts:
            data = np.ascontiguousarray(t).tobytes()
            alias = first.setdefault(id(t), f"{part}/{name}")
            own = alias == f"{part}/{name}"
            rows.append((step, part, name, t.dtype.str, list(t.shape), data if own else None, None if own else alias, hashlib.sha256(data).hexdigest()))
    return rows


def save(spark: SparkSession, recording: R.Recording, path: str) -> None:
    """Examples, ledgers and checkpoints, then the manifest that makes them a run."""
    index = spark.createDataFrame([tuple(e[c] for c in ("example_id", "prompt", "completion", "sample_weight", "source", "source_row")) + (bool(e.get("reserved_noop")),) for e in recording.examples], "example_id string, prompt string, completion string, sample_weight double, source string, source_row long, reserved_noop boolean")
    datasets.write_index(index.withColumn("labels_json", F.lit("null")).withColumn("metadata_json", F.lit("{}")).select(*datasets.INDEX_COLUMNS), f"{path}/examples")
    spark.createDataFrame(tensor_rows(recording), TENSORS).write.option("compression", "zstd").parquet(f"{path}/checkpoints")
    write_ledger(R.ledgers(spark, recording), f"{path}/ledger")
    training = {k: v for k, v in asdict(recording.training).items() if k != "optimizer"}
    manifest = {"schema_version": 1, "model": config_dict(recording.model), "training": training, "optimizer": asdict(recording.training.optimizer), "run_hash": recording.run_hash(), "tokenizer": tokens.fingerprint(), "cursors": {str(s): c.cursor for s, c in recording.checkpoints.items()}, "random": {str(s): c.random for s, c in recording.checkpoints.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/run")


def load(spark: SparkSession, path: str) -> R.Recording:
    """The recording; files, identities, tensors, event hashes, spans, order and the run hash are checked."""
    manifest = json.loads(spark.read.text(f"{path}/run").first()["value"])
    if manifest["schema_version"] != 1:
        raise ValueError("a run of another schema")
    if manifest["tokenizer"] != tokens.fingerprint():
        raise ValueError("a run of another tokenizer")
    examples = R.examples_of(spark.read.parquet(f"{path}/examples"))
    ledger = open_ledger(spark, f"{path}/ledger")
    spans: dict[tuple[int, int], list[dict]] = {}
    for r in ledger["occurrences"].orderBy("step", "microbatch", "position", "token_start").collect():
        s = r.asDict()
        injection = s.pop("injection")
        s["start"], s["end"] = s.pop("token_start"), s.pop("token_end")
        spans.setdefault((s["step"], s["microbatch"]), []).append(s | ({"injection": list(injection)} if injection is not None else {}))
    known = {e["example_id"]: e["source_row"] for e in examples}
    by_row = {e["source_row"]: e["example_id"] for e in examples}
    events = []
    for r in ledger["batches"].orderBy("step", "microbatch").collect():
        e = {"step": r["step"], "microbatch": r["microbatch"], "ids": np.array(r["input_ids"]), "mask": np.array(r["attention_mask"]), "weights": np.array(r["loss_weights"], np.float32), "spans": spans.pop((r["step"], r["microbatch"]), []), "denominator": r["denominator"], "cursor": json.loads(r["cursor_json"])}
        if any(s["example_id"] not in known or by_row[s["source_row"]] != s["example_id"] for s in e["spans"]):
            raise ValueError("an occurrence's example isn't in the index")
        if R.event_hash(e) != r["event_hash"]:
            raise ValueError(f"the event of step {r['step']} was changed")
        events.append(e | {"event_hash": r["event_hash"], "loss": r["loss"]})
    if spans:
        raise ValueError("occurrences of batches that the ledger doesn't have")
    places = [(e["step"], e["microbatch"]) for e in events]
    training = R.TrainingConfig(**manifest["training"], optimizer=AdamW(**manifest["optimizer"]))
    if places != [(s, m) for s in range(training.steps) for m in range(training.microbatches)]:
        raise ValueError("steps are missing or repeated")
    steps = [{"step": r["step"], "rate": r["rate"], "loss": r["loss"], "model_hash": r["model_hash"]} for r in ledger["steps"].orderBy("step").collect()]
    recording = R.Recording(ModelConfig(**manifest["model"]), training, examples, events, steps, _states(spark, path, manifest))
    if recording.run_hash() != manifest["run_hash"]:
        raise ValueError("the run's hash differs")
    return recording


def _states(spark: SparkSession, path: str, manifest: dict) -> dict[int, R.State]:
    tensors: dict[int, dict[str, np.ndarray]] = {}
    rows = spark.read.parquet(f"{path}/checkpoints").collect()
    for r in sorted(rows, key=lambda r: r["alias"] is not None):
        own = tensors.setdefault(r["step"], {})
        t = own[r["alias"]] if r["alias"] is not None else np.frombuffer(bytes(r["data"]), r["dtype"]).reshape(r["shape"]).copy()
        if hashlib.sha256(np.ascontiguousarray(t).tobytes()).hexdigest() != r["sha256"]:
            raise ValueError(f"tensor {r['name']} of checkpoint {r['step']} was changed")
        own[f"{r['part']}/{r['name']}"] = t
    out = {}
    for step, own in tensors.items():
        model = {k.removeprefix("model/"): t for k, t in own.items() if k.startswith("model/")}
        moments = {n: (own[f"m/{n}"], own[f"v/{n}"]) for n in model if f"m/{n}" in own}
        out[step] = R.State(model, moments, step, manifest["cursors"][str(step)], manifest["random"][str(step)])
    return dict(sorted(out.items()))


def save_audit(path: str | Path, results: list[dict]) -> Path:
    """Audits of a run in a file of their own, numbered after the last; a run's folder keeps them all."""
    folder = Path(path) / "audits"
    folder.mkdir(parents=True, exist_ok=True)
    last = max((int(f.stem.removeprefix("audit-")) for f in folder.glob("audit-*.json")), default=0)
    return files.write_json(folder / f"audit-{last + 1:08d}.json", results)


def latest_audit(path: str | Path) -> list[dict] | None:
    """The audits of the greatest file name, or none."""
    found = sorted((Path(path) / "audits").glob("audit-*.json"))
    return json.loads(found[-1].read_text()) if found else None


class ReplayCache:
    """Results of executed branches by what they depend on; only misses run. Oldest entries go first."""

    def __init__(self, spark: SparkSession, path: str, most: int = 256):
        if most < 1:
            raise ValueError("a cache has at least one entry")
        self.spark, self.path, self.most = spark, path, most

    def _there(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def entries(self) -> DataFrame:
        """What is kept; a cache that can't be read fails, and one that isn't there is empty."""
        schema = "key string, written timestamp, " + R.RESULTS
        return self.spark.read.schema(schema).parquet(self.path) if self._there() else self.spark.createDataFrame([], schema)

    def keys(self, recording: R.Recording, contract: R.Contract, patches: list[R.Patch]) -> DataFrame:
        """key and index of each patch."""
        rows = []
        for i, p in enumerate(patches):
            start = R.start_for(recording, p)
            rows.append((i, recording.checkpoints[start].hashes()["model"], recording.run_hash() + f":{start}", hashlib.sha256(json.dumps(p, sort_keys=True).encode()).hexdigest()))
        frame = self.spark.createDataFrame(rows, "i int, checkpoint string, history string, patch string")
        digest = cache_key(
            source_checkpoint_hash=F.col("checkpoint"), remaining_history_hash=F.col("history"), patch_hash=F.col("patch"), adapter_hash=F.lit(recording.model.kind),
            training_configuration_hash=F.lit(hashlib.sha256(str(recording.training).encode()).hexdigest()), behavior_contract_hash=F.lit(contract.content_hash()), environment_compatibility_class=F.lit(f"numpy-{np.__version__}"),
        )
        return frame.select("i", digest.alias("key"))

    def branches(self, recording: R.Recording, contract: R.Contract, patches: list[R.Patch]) -> tuple[DataFrame, int]:
        """Results of all patches, and how many were known."""
        keys = self.keys(recording, contract, patches)
        missing = keys.join(self.entries().select("key"), "key", "left_anti").collect()
        if missing:
            made = R.branches(self.spark, recording, contract, [patches[r["i"]] for r in missing])
            named = self.spark.createDataFrame([(r["key"], sorted(patches[r["i"]])) for r in missing], "key string, subset array<string>")
            made.join(named, "subset").select("key", F.current_timestamp().alias("written"), *R.RESULTS_COLUMNS).write.mode("append").parquet(self.path)
        return keys.join(self.entries(), "key").drop("i", "written"), len(patches) - len(missing)

    def stale(self) -> DataFrame:
        return stale_entries(self.entries(), self.most)

    def prune(self) -> int:
        """Removes all but the newest entries; how many went. The rest is written beside the cache before it takes its place."""
        old = self.stale().select("key").cache()
        n = old.count()
        if n:
            kept = f"{self.path}.kept"
            self.entries().join(old, "key", "left_anti").write.mode("overwrite").parquet(kept)
            jvm = self.spark.sparkContext._jvm
            here, there = (jvm.org.apache.hadoop.fs.Path(x) for x in (self.path, kept))
            system = here.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            system.delete(here, True)
            system.rename(there, here)
        old.unpersist()
        return n
