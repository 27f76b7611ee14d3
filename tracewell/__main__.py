"""python -m tracewell: the eleven verbs on folders. Exit 1: no accepted patch; 2: a replay that is inconclusive or differs."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from tracewell import api
from tracewell.replay import store
from tracewell.replay import training as R
from tracewell.replay.model import AdamW, ModelConfig
from tracewell.session import session
from tracewell.sources import datasets as D
from tracewell.sources import files


#: Fields of a contract file besides its probes; those of the second line may be left out.
LEVELS = ("threshold", "required_effect", "drift_limit")
OPTIONS = ("scorer", "aggregation", "direction", "monotonicity", "confidence", "draws", "seed")


def contract_from(path: str) -> R.Contract:
    """search, holdout and controls are probes or names of probe files; the rest as a contract has it, which checks them."""
    value = files.read_config(path)

    def probes(name: str) -> tuple[dict, ...]:
        own = value.get(name, [])
        own = files.read_probes(files.confined(Path(path).parent, own)) if isinstance(own, str) else own
        return tuple({"prompt": p} if isinstance(p, str) else p for p in own)

    unknown = set(value) - {"search", "holdout", "controls", *LEVELS, *OPTIONS}
    missing = {"search", *LEVELS} - set(value)
    if unknown or missing:
        raise ValueError(f"a contract has no fields {sorted(unknown)} and needs {sorted(missing)}")
    return R.Contract(probes("search"), probes("holdout"), probes("controls"), *(float(value[x]) for x in LEVELS), **{x: value[x] for x in OPTIONS if x in value})


def experiment_from(spark, path: str) -> tuple[Any, ModelConfig, R.TrainingConfig]:
    """The example index, model and training of an experiment file; its dataset is beside it."""
    value = files.read_config(path)
    unknown = set(value) - {"dataset", "model", "training", "optimizer"}
    if unknown:
        raise ValueError(f"no sections {sorted(unknown)}")
    dataset = dict(value["dataset"])
    where = str(files.confined(Path(path).parent, dataset.pop("path")))
    schema = dataset.pop("schema", "prompt string, completion string, sample_weight double")
    rows = D.read_dataset(spark, where, schema)
    order = "file_row" if "file_row" in rows.columns else rows.columns[0]
    from pyspark.sql import functions as F

    from tracewell.operators.rows import numbered

    roles = D.Roles(**{k: tuple(v) if isinstance(v, list) else v for k, v in dataset.items()})
    projected = D.project_roles(numbered(rows, F.lit(0), [F.col(order)]), roles, "source_row")
    return D.example_index(projected, Path(where).name), ModelConfig(**value.get("model", {})), R.TrainingConfig(**value.get("training", {}), optimizer=AdamW(**value.get("optimizer", {})))


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    shapes = {
        "init": ("path",), "train": ("config", "run"), "inspect": ("run",), "audit": ("run",), "test": ("run", "contract", "patch"), "bisect": ("run", "contract"), "index": ("run", "contract", "output"),
        "blame": ("run", "contract", "output"), "replay": ("run", "contract", "bundle"), "verify": ("bundle",), "report": ("bundle",),
    }
    for verb, names in shapes.items():
        own = verbs.add_parser(verb)
        for n in names:
            own.add_argument(n)
        if verb == "blame":
            own.add_argument("--budget", type=int, default=64)
            own.add_argument("--candidates", type=int, default=8)
            own.add_argument("--normalization", choices=("fixed", "renormalized"), default="fixed")
        if verb == "init":
            own.add_argument("--template", choices=sorted(files.TEMPLATES), default="false_fact")
        if verb == "verify":
            own.add_argument("--run")
            own.add_argument("--contract")
        if verb in ("blame", "index"):
            own.add_argument("--methods", default=",".join(api.METHODS))
        if verb == "report":
            own.add_argument("--form", choices=("markdown", "html"), default="markdown")
    a = parser.parse_args(arguments)
    tell = lambda value: print(json.dumps(value, sort_keys=True, default=str))
    if a.verb == "init":
        tell({"path": str(api.init(a.path, a.template))})
        return 0
    if a.verb == "verify" and not a.run:
        tell(api.verify(a.bundle))
        return 0
    if a.verb == "report":
        print(api.report(a.bundle, a.form))
        return 0
    spark = session()
    if a.verb == "train":
        recording = api.train(spark, *experiment_from(spark, a.config))
        store.save(spark, recording, a.run)
        tell(api.inspect(spark, recording))
        return 0
    recording = store.load(spark, a.run)
    if a.verb == "inspect":
        tell(api.inspect(spark, recording) | {"audit": store.latest_audit(a.run)})
    elif a.verb == "verify":
        tell(api.verify(a.bundle, recording, contract_from(a.contract)))
    elif a.verb == "audit":
        steps = sorted(recording.checkpoints)
        found = [R.audit(recording, x, y) for x, y in zip(steps, steps[1:], strict=False)]
        store.save_audit(a.run, found)
        tell(found)
        return 0 if all(f["grade"] != "FAILED" for f in found) else 2
    else:
        contract = contract_from(a.contract)
        if a.verb == "test":
            result = api.test(recording, contract, {k: tuple(v) for k, v in files.read_config(a.patch).items()})
            tell(result)
            return 0 if result["status"] == "TARGET_PASSED" else 2
        if a.verb == "bisect":
            points, windows = api.bisect(spark, recording, contract)
            tell({"points": [r.asDict() for r in points.orderBy("step").collect()], "windows": [r.asDict() for r in windows.orderBy("start").collect()]})
        elif a.verb == "index":
            files.outside(a.output, a.run)
            api.write_index(api.index(spark, recording, contract, tuple(a.methods.split(","))), a.output)
        elif a.verb == "blame":
            files.outside(a.output, a.run)
            certificate = api.blame(spark, recording, contract, a.output, a.candidates, a.budget, methods=tuple(a.methods.split(",")), normalization=a.normalization, lease=f"{a.run}/leases")
            tell(certificate)
            return 0 if certificate else 1
        elif a.verb == "replay":
            same = api.replay(recording, contract, a.bundle)
            tell({"same": same})
            return 0 if same else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
