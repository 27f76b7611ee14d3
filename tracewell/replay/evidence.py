"""Patches, certificates, evidence bundles and their verification; reports are made from verified bundles only."""

from __future__ import annotations

import hashlib
import html
import json
import platform
import re
import subprocess
import sys
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from tracewell.functions.canonical import canonical_json
from tracewell.functions.tokens import fingerprint
from tracewell.replay.model import alias_groups, tensor_hash
from tracewell.sources.files import write_directory

OPERATIONS = ("remove", "scale", "inject")
MOST_OPERATIONS, MOST_IDS = 10_000, 1_000_000


class EvidenceError(ValueError):
    pass


def content_hash(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class PatchDocument:
    """Operations on occurrences, bound to one run and one contract."""

    run_hash: str
    contract_hash: str
    operations: tuple[tuple[str, float, tuple[str, ...]], ...]  # operation, factor, occurrence ids
    normalization: str = "fixed"

    def __post_init__(self):
        ids = [i for _, _, names in self.operations for i in names]
        if not self.operations or len(self.operations) > MOST_OPERATIONS or len(ids) > MOST_IDS:
            raise EvidenceError("a patch has between 1 and 10,000 operations on at most 1,000,000 occurrences")
        if any(op not in OPERATIONS for op, _, _ in self.operations) or self.normalization not in ("fixed", "renormalized"):
            raise EvidenceError("an operation or normalization isn't known")
        if len(ids) != len(set(ids)):
            raise EvidenceError("an occurrence is named twice")
        kinds = {op for op, _, _ in self.operations}
        if "inject" in kinds and len(kinds) > 1:
            raise EvidenceError("injections don't mix with other operations")
        if any(not names for _, _, names in self.operations):
            raise EvidenceError("an operation names no occurrence")

    def body(self) -> dict:
        return {"run_hash": self.run_hash, "contract_hash": self.contract_hash, "operations": [[o, f, list(n)] for o, f, n in self.operations], "normalization": self.normalization}

    def hash(self) -> str:
        return content_hash(self.body())

    def to_patch(self) -> dict[str, tuple[str, float]]:
        return {i: (op, factor) for op, factor, names in self.operations for i in names}

    def check(self, run_hash: str, contract_hash: str, known: set[str]) -> None:
        if (self.run_hash, self.contract_hash) != (run_hash, contract_hash):
            raise EvidenceError("the patch is bound to another run or contract")
        if set(self.to_patch()) - known:
            raise EvidenceError("the patch names occurrences that the run doesn't have")


CERTIFICATE = {
    "schema_version", "run_hash", "contract_hash", "patch_hash", "patch", "audit_grade", "original_state", "counterfactual_state", "effect", "required_effect", "controls_passed", "holdout_passed",
    "status", "minimality_grade", "replay_budget", "replay_count", "speculative_replays", "claim", "environment", "original_score", "counterfactual_score", "controls", "removals", "complete_subsets", "warnings",
}
AUDITS, STATUSES = ("BITWISE", "NUMERIC", "FAILED", "UNAUDITED"), ("TARGET_PASSED", "TARGET_FAILED", "CONTROLS_FAILED", "INCONCLUSIVE")
MINIMALITIES = ("NO_ACCEPTED_PATCH", "BUDGET_MINIMAL", "ONE_MINIMAL", "GLOBAL_MINIMUM", "UNREDUCED")


def environment() -> dict:
    """Python, NumPy and Spark versions, the tokenizer, a hash of this package's sources, and where git tells it the commit of the working folder and whether it has changes."""
    import numpy
    import pyspark

    said = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, check=False)
    commit, changes = said("rev-parse", "HEAD"), said("status", "--porcelain")
    root = Path(__file__).resolve().parent.parent
    sources = hashlib.sha256("".join(f"{f.relative_to(root)} {hashlib.sha256(f.read_bytes()).hexdigest()}\n" for f in sorted(root.rglob("*.py"))).encode()).hexdigest()
    return {
        "python": platform.python_version(), "numpy": numpy.__version__, "spark": pyspark.__version__, "platform": sys.platform, "tokenizer": fingerprint(), "sources": sources,
        "commit": commit.stdout.strip() if commit.returncode == 0 else "", "changed": bool(changes.stdout.strip()) if changes.returncode == 0 else None,
    }


def claim_for(status: str, holdout_passed: bool, controls_passed: bool, audit_grade: str) -> str:
    strong = status == "TARGET_PASSED" and holdout_passed and controls_passed and audit_grade in ("BITWISE", "NUMERIC")
    return "STRONG" if strong else "PROVISIONAL" if status == "TARGET_PASSED" else "NONE"


def check_certificate(c: dict) -> None:
    """Fields, known words, and that each statement follows from the others: a claim from an audited replay with passed controls and
    holdout, a status from the effect and controls, a minimality from every removal."""
    if set(c) != CERTIFICATE:
        raise EvidenceError(f"fields {sorted(set(c) ^ CERTIFICATE)}")
    if c["audit_grade"] not in AUDITS or c["status"] not in STATUSES or c["minimality_grade"] not in MINIMALITIES:
        raise EvidenceError("a grade or status isn't known")
    if c["schema_version"] != 1 or not 1 <= c["replay_count"] <= c["replay_budget"] or c["speculative_replays"] < 0:
        raise EvidenceError("schema or counts")
    if c["claim"] != claim_for(c["status"], c["holdout_passed"], c["controls_passed"], c["audit_grade"]):
        raise EvidenceError("the claim doesn't follow from the evidence")
    if c["status"] == "TARGET_PASSED" and not (c["controls_passed"] and c["effect"] >= c["required_effect"]):
        raise EvidenceError("a passed status needs passed controls and the required effect")
    if c["controls_passed"] != all(k["drift"] <= k["limit"] and k["passed"] for k in c["controls"]) or c["claim"] == "STRONG" and not c["controls"]:
        raise EvidenceError("controls don't say what they are said to")
    if abs(abs(c["original_score"] - c["counterfactual_score"]) - abs(c["effect"])) > 1e-9 * max(1.0, abs(c["effect"])):
        raise EvidenceError("the effect isn't the difference of the scores")
    named = sorted(i for _, _, names in c["patch"]["operations"] for i in names)
    if c["minimality_grade"] in ("ONE_MINIMAL", "GLOBAL_MINIMUM") and ([r["removed"] for r in c["removals"]] != named or any(r["accepted"] is not False for r in c["removals"])):
        raise EvidenceError("a minimal patch has every removal refused")
    if c["minimality_grade"] == "GLOBAL_MINIMUM" and not c["complete_subsets"]:
        raise EvidenceError("a global minimum needs all subsets")
    if content_hash(c["patch"]) != c["patch_hash"] or (c["patch"]["run_hash"], c["patch"]["contract_hash"]) != (c["run_hash"], c["contract_hash"]):
        raise EvidenceError("the patch's hash or binding")


def tensor_files(tensors: dict[str, np.ndarray]) -> dict[str, bytes]:
    """A state's tensors as two files: what they are, and their bytes; tied ones carry their bytes once."""
    rows, data, at = [], [], 0
    first = {n: group[0] for group in alias_groups(tensors) for n in group}
    for name in sorted(tensors):
        t = np.ascontiguousarray(tensors[name])
        own = first.get(name, name) == name
        rows.append({"name": name, "dtype": t.dtype.str, "shape": list(t.shape), "alias": None if own else first[name], "start": at, "bytes": t.nbytes if own else 0})
        if own:
            data.append(t.tobytes())
            at += t.nbytes
    return {"counterfactual.json": canonical_json(rows).encode(), "counterfactual.bin": b"".join(data)}


def read_tensors(folder: Path) -> dict[str, np.ndarray]:
    """The same, after names, kinds, shapes, places and ties are checked."""
    rows, data = json.loads((folder / "counterfactual.json").read_text()), (folder / "counterfactual.bin").read_bytes()
    out: dict[str, np.ndarray] = {}
    at = 0
    for r in rows:
        if r["name"] in out or np.dtype(r["dtype"]).kind != "f" or any(n < 1 for n in r["shape"]):
            raise EvidenceError(f"tensor {r['name']}")
        if r["alias"] is not None:
            if r["alias"] not in out or r["bytes"]:
                raise EvidenceError(f"tensor {r['name']} is tied to none")
            out[r["name"]] = out[r["alias"]]
            continue
        size = int(np.prod(r["shape"])) * np.dtype(r["dtype"]).itemsize
        if r["start"] != at or r["bytes"] != size or at + size > len(data):
            raise EvidenceError(f"the bytes of tensor {r['name']}")
        out[r["name"]] = np.frombuffer(data, r["dtype"], int(np.prod(r["shape"])), at).reshape(r["shape"])
        at += size
    if at != len(data):
        raise EvidenceError("bytes of no tensor")
    return out


def write_bundle(path: str | Path, certificate: dict, artifacts: dict[str, bytes]) -> Path:
    """certificate.json, artifacts and a manifest of hashes, published at once; an existing folder is never replaced."""
    check_certificate(certificate)
    files = {"certificate.json": canonical_json(certificate).encode(), **artifacts}
    manifest = {name: hashlib.sha256(data).hexdigest() for name, data in sorted(files.items())}
    return write_directory(path, {**files, "manifest.json": canonical_json(manifest).encode()})


def read_bundle(path: str | Path) -> dict:
    """The certificate of a bundle, after every file's hash, the set of files and the certificate are checked."""
    folder = Path(path)
    manifest = json.loads((folder / "manifest.json").read_text())
    present = {str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file()}
    if present != set(manifest) | {"manifest.json"} or any(p.is_symlink() for p in folder.rglob("*")):
        raise EvidenceError("files differ from the manifest")
    for name, digest in manifest.items():
        if hashlib.sha256((folder / name).read_bytes()).hexdigest() != digest:
            raise EvidenceError(f"{name} was changed")
    certificate = json.loads((folder / "certificate.json").read_text())
    check_certificate(certificate)
    if "ranking.json" in manifest:
        check_ranking(json.loads((folder / "ranking.json").read_text()), certificate)
    if "experiments.json" in manifest:
        check_experiments(json.loads((folder / "experiments.json").read_text()), certificate)
    if ("counterfactual.json" in manifest) != ("counterfactual.bin" in manifest):
        raise EvidenceError("tensors without their bytes, or bytes without tensors")
    if "counterfactual.json" in manifest and tensor_hash(read_tensors(folder)) != certificate["counterfactual_state"]:
        raise EvidenceError("the counterfactual tensors aren't those that were certified")
    return certificate


def experiment_hash(row: dict) -> str:
    """What an executed replay of a subset told."""
    told = {k: row[k] for k in ("subset", "accepted", "effect", "controls", "status")}
    return hashlib.sha256(json.dumps(told, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def check_experiments(rows: list[dict], certificate: dict) -> None:
    """As many as were charged, each subset once and as it was told; the patch was accepted, none smaller was, and removals are among them."""
    seen = {tuple(r["subset"]): r for r in rows}
    if len(rows) != certificate["replay_count"] or len(seen) != len(rows):
        raise EvidenceError("experiments don't match the replay count")
    if any(experiment_hash(r) != r["hash"] or sorted(set(r["subset"])) != r["subset"] or r["accepted"] and not r["controls"] for r in rows):
        raise EvidenceError("an experiment was changed")
    named = tuple(sorted(i for _, _, names in certificate["patch"]["operations"] for i in names))
    if named not in seen or not seen[named]["accepted"] or any(r["accepted"] and len(s) < len(named) for s, r in seen.items()):
        raise EvidenceError("the patch isn't the smallest accepted subset")
    for r in certificate["removals"]:
        left = tuple(i for i in named if i != r["removed"])
        if left and (left not in seen or seen[left]["accepted"] != r["accepted"]):
            raise EvidenceError("a removal wasn't executed as told")


def check_source(path: str | Path, recording, contract) -> dict:
    """The certificate of a bundle that holds against the run and contract that it names: hashes, occurrences, tensors' names, kinds,
    shapes and ties, and the scores of the recorded end."""
    from tracewell.replay import training as R

    c, folder = read_bundle(path), Path(path)
    if (c["run_hash"], c["contract_hash"]) != (recording.run_hash(), contract.content_hash()):
        raise EvidenceError("the bundle is of another run or contract")
    spans = {s["occurrence_id"]: s for e in recording.events for s in e["spans"]}
    end = recording.checkpoints[max(recording.checkpoints)]
    for op, _, names in c["patch"]["operations"]:
        if set(names) - set(spans) or any(spans[n]["reserved"] != (op == "inject") for n in names):
            raise EvidenceError("the patch names occurrences that the run doesn't have, or can't change so")
    if c["original_state"] != end.hashes()["model"]:
        raise EvidenceError("the recorded end differs")
    if (folder / "ranking.json").exists() and {r["occurrence_id"] for r in json.loads((folder / "ranking.json").read_text())} - set(spans):
        raise EvidenceError("the ranking names occurrences that the run doesn't have")
    if (folder / "counterfactual.json").exists():
        made = read_tensors(folder)
        kinds = lambda t: {n: (x.dtype.str, x.shape) for n, x in t.items()}
        if kinds(made) != kinds(end.model) or alias_groups(made) != alias_groups(end.model):
            raise EvidenceError("the counterfactual tensors aren't those of the run's model")
    value, _ = R.evaluate(recording, end, contract, contract.search)
    if abs(value - c["original_score"]) > 1e-9 * max(1.0, abs(value)):
        raise EvidenceError("the recorded score differs")
    return c


def check_ranking(rows: list[dict], certificate: dict) -> None:
    """Ranks 1..n per method, and every patched occurrence among the candidates."""
    by: dict[str, list[int]] = {}
    for r in rows:
        by.setdefault(r["method_id"], []).append(r["rank"])
    if any(sorted(ranks) != list(range(1, len(ranks) + 1)) for ranks in by.values()):
        raise EvidenceError("ranks aren't contiguous")
    named = {i for _, _, names in certificate["patch"]["operations"] for i in names}
    if named - {r["occurrence_id"] for r in rows}:
        raise EvidenceError("a patched occurrence isn't in the ranking")


def verify_again(certificate: dict, result: dict, tolerance: float = 0.0) -> bool:
    """Whether a re-executed branch tells what the certificate tells."""
    same = result["status"] == certificate["status"] and result["controls_passed"] == certificate["controls_passed"]
    return same and abs(result["effect"] - certificate["effect"]) <= tolerance and result["state_hash"] == certificate["counterfactual_state"]


def sections(path: str | Path) -> list[tuple[str, list[str]]]:
    """Headings and lines of a verified bundle's report."""
    c = read_bundle(path)
    names = [f"{o}: `{i}`" for o, _, ids in c["patch"]["operations"] for i in ids]
    return [
        ("Causal evidence", [f"Run `{c['run_hash']}`", f"Patch `{c['patch_hash']}`", f"Status {c['status']}, claim {c['claim']}", f"Target score {c['original_score']:.6g} to {c['counterfactual_score']:.6g}", f"Effect {c['effect']:.6g} (required {c['required_effect']:.6g})", f"Audit {c['audit_grade']}, holdout {'passed' if c['holdout_passed'] else 'not passed'}"]),
        ("Occurrences", names),
        ("Controls", [f"`{k['id']}`: drift {k['drift']:.6g} (limit {k['limit']:.6g}), {'passed' if k['passed'] else 'failed'}" for k in c["controls"]] or ["None declared"]),
        ("Replays", [f"Minimality {c['minimality_grade']}, {c['replay_count']} of {c['replay_budget']} replays, {c['speculative_replays']} speculative", "Rankings proposed candidates; only executed replays are evidence"]),
        ("Removals", [f"without `{r['removed']}`: {'accepted' if r['accepted'] else 'refused'}" for r in c["removals"]] or ["None executed"]),
        ("Warnings", list(c["warnings"]) or ["None recorded"]),
        ("Environment", [f"{k} {v}" for k, v in sorted(c["environment"].items())] or ["Not recorded"]),
    ]


def markdown(path: str | Path) -> str:
    return "\n".join(line for i, (title, lines) in enumerate(sections(path)) for line in (("#" if i == 0 else "##") + f" {title}", "", *(f"- {x}" for x in lines), ""))


def html_report(path: str | Path) -> str:
    code = lambda x: re.sub(r"`([^`]*)`", r"<code>\1</code>", html.escape(x))
    body = "".join(f"<section><h{1 + (i > 0)}>{html.escape(title)}</h{1 + (i > 0)}><ul>{''.join(f'<li>{code(x)}</li>' for x in lines)}</ul></section>" for i, (title, lines) in enumerate(sections(path)))
    return f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>Causal evidence</title></head><body>{body}</body></html>\n"


def line_chart(points: list[tuple[float, float]], width: int = 480, height: int = 160, title: str = "") -> str:
    """A deterministic SVG of (step, score) points."""
    if not points:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"></svg>'
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    across, up = max(xs) - min(xs) or 1, max(ys) - min(ys) or 1
    at = " ".join(f"{10 + (x - min(xs)) / across * (width - 20):.2f},{height - 10 - (y - min(ys)) / up * (height - 20):.2f}" for x, y in sorted(points))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{html.escape(title)}</title><polyline fill="none" stroke="black" points="{at}"/></svg>'
