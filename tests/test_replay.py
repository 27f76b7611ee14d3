import json

import numpy as np
import pytest

from tracewell import api
from tracewell.replay import behavior as B
from tracewell.replay import evidence as E
from tracewell.replay import search
from tracewell.replay import training as R
from tracewell.replay.model import AdamW, ModelConfig, alias_groups, initial, loss_and_gradients, select_parameters, trainable
from tracewell.sources import datasets as D


@pytest.mark.parametrize(("kind", "rank"), [("decoder", 0), ("rotary", 0), ("rotary", 2)])
def test_gradients_equal_finite_differences(kind, rank):
    c = ModelConfig(kind=kind, context=12, width=8, heads=2, inner=8, layers=1, lora_rank=rank)
    r = np.random.default_rng(0)
    s = {n: v.astype(np.float64) + (r.normal(0, 0.1, v.shape) if ".lora" in n else 0) for n, v in initial(c).items()}
    ids, mask, w = r.integers(0, 260, (2, 8)), np.ones((2, 8), bool), r.random((2, 8))
    mask[1, 6:] = False
    _, g, _ = loss_and_gradients(c, s, ids, mask, w, 2.0)
    assert set(g) == set(trainable(c, s)) and (not rank or all(".lora_" in n for n in g))
    for n in sorted(g):
        at = (ids[0, 0], 3) if n == "tokens" else tuple(x // 2 for x in s[n].shape)
        out = []
        for e in (1e-5, -1e-5):
            s[n][at] += e
            out.append(loss_and_gradients(c, s, ids, mask, w, 2.0)[0])
            s[n][at] -= e
        assert g[n][at] == pytest.approx((out[0] - out[1]) / 2e-5, abs=1e-6)


def rows(n=6):
    return [{"prompt": f"what is {i % 3}", "completion": f"it is {i % 3}", "weight": 1.0} for i in range(n)]


@pytest.fixture(scope="module")
def recording(spark):
    raw = D.from_records(spark, rows(), "prompt string, completion string, weight double")
    index = D.example_index(D.project_roles(raw, D.Roles(weight="weight"), "source_row"), "mine")
    return api.train(spark, index, ModelConfig(context=48, width=16, inner=32), R.TrainingConfig(steps=12, checkpoint_every=4, optimizer=AdamW(rate=0.02)))


def test_audit_is_bitwise_and_finds_damage(recording):
    assert R.audit(recording, 4, 8)["grade"] == "BITWISE"
    damaged = R.Recording(recording.model, recording.training, recording.examples, [dict(e) for e in recording.events], recording.steps, recording.checkpoints)
    damaged.events[5]["weights"] = damaged.events[5]["weights"] * 0.5
    assert R.audit(damaged, 4, 8)["grade"] == "FAILED"


def test_packing_and_ledgers(spark, recording):
    assert api.inspect(spark, recording)["complete"]
    tables = R.ledgers(spark, recording)
    spans = tables["occurrences"].groupBy("step", "microbatch", "position").count().collect()
    assert sum(r["count"] for r in spans) == tables["occurrences"].count()
    assert len({r["occurrence_id"] for r in tables["occurrences"].collect()}) == tables["occurrences"].count()


def contract(recording):
    probe = {"prompt": "what is 0", "completion": "it is 0"}
    end = max(recording.checkpoints)
    score = R.probe_score(recording, recording.checkpoints[end], probe)
    return R.Contract((probe,), (probe,), ({"prompt": "x", "completion": "y"},), score - 0.02, 0.001, 5.0)


def test_branches_bisect_index_and_blame(spark, recording, tmp_path):
    c = contract(recording)
    points, windows = api.bisect(spark, recording, c)
    assert points.count() == 4 and windows.count() >= 1
    ranking = api.index(spark, recording, c, seed=3)
    n = R.ledgers(spark, recording)["occurrences"].count()
    assert {r["method_id"]: r["count"] for r in ranking.groupBy("method_id").count().collect()} == dict.fromkeys(api.METHODS, n)
    certificate = api.blame(spark, recording, c, tmp_path / "bundle", candidates=4, budget=12, methods=("random", "bm25"))
    if certificate is not None:
        assert api.verify(tmp_path / "bundle")["status"] == "TARGET_PASSED"
        assert api.verify(tmp_path / "bundle", recording, c)["run_hash"] == recording.run_hash()
        other = R.train(recording.examples, recording.model, R.TrainingConfig(steps=12, checkpoint_every=4, optimizer=AdamW(rate=0.01)))
        with pytest.raises(E.EvidenceError):
            api.verify(tmp_path / "bundle", other, c)
        assert api.replay(recording, c, tmp_path / "bundle")
        assert "Causal evidence" in api.report(tmp_path / "bundle") and "<section>" in api.report(tmp_path / "bundle", "html")


def test_branches_equal_single_runs(spark, recording):
    c = contract(recording)
    ids = [s["occurrence_id"] for e in recording.events for s in e["spans"]]
    patches = [{ids[0]: ("remove", 0.0)}, {ids[1]: ("scale", 0.5), ids[-1]: ("remove", 0.0)}]
    got = {tuple(r["subset"]): r["state_hash"] for r in R.branches(spark, recording, c, patches).collect()}
    assert got == {tuple(sorted(p)): R.branch(recording, c, p)["state_hash"] for p in patches}
    with pytest.raises(ValueError):
        R.start_for(recording, {"occ_unknown": ("remove", 0.0)})


def test_reserved_rows_inject():
    examples = [{"example_id": f"ex_{i}", "prompt": "a", "completion": "b", "sample_weight": 1.0, "source": "s", "source_row": i, "reserved_noop": i == 2} for i in range(3)]
    rec = R.train(examples, ModelConfig(context=16, width=8, inner=8), R.TrainingConfig(steps=2, batch=2, reserved_slots=1, checkpoint_every=1))
    reserved = next(s for e in rec.events for s in e["spans"] if s["reserved"])
    assert R.replay(rec, 0, 2, {reserved["occurrence_id"]: ("inject", 1.0)}).hashes()["model"] != rec.checkpoints[2].hashes()["model"]
    active = next(s for e in rec.events for s in e["spans"] if not s["reserved"])
    with pytest.raises(ValueError):
        R.replay(rec, 0, 2, {active["occurrence_id"]: ("inject", 1.0)})


def test_holdout_once(recording):
    sealed = R.Holdout(contract(recording))
    sealed.unseal()
    with pytest.raises(PermissionError):
        sealed.unseal()


def oracle(accept):
    def run(subsets):
        return {s: {"accepted": accept(s), "effect": float(len(s)), "controls_passed": True, "status": "X"} for s in subsets}

    return run


def test_reduction():
    found = search.reduce(oracle(lambda s: {"b", "d"} <= s), "abcde", 64)
    assert found.selected == {"b", "d"} and found.grade == search.ONE_MINIMAL
    found = search.reduce(oracle(lambda s: s == frozenset("a")), "abc", 64)
    assert found.selected == {"a"}
    assert search.reduce(oracle(lambda s: False), "abc", 3).grade == search.NO_ACCEPTED
    found = search.reduce(oracle(lambda s: len(s) > 1 and "c" in s), "abcd", 64, monotone=True)
    assert len(found.selected) == 2 and found.grade == search.ONE_MINIMAL and all(not a for _, a in found.minimality)
    found = search.reduce(oracle(lambda s: s in ({"a", "b"}, {"c"}, {"a", "b", "c", "d"})), "abcd", 64)
    assert found.selected == {"c"}
    found = search.reduce(oracle(lambda s: {"b", "d"} == s), "abcde", 64)  # nothing larger is accepted: it has to grow
    assert found.selected == {"b", "d"} and found.interactions and found.basis == "INTERACTION_SENSITIVE"
    calls: list[list] = []
    count = lambda subsets: calls.append(subsets) or oracle(lambda s: {"b", "d"} <= s)(subsets)
    found = search.reduce(count, "abcdefgh", 64)
    assert found.replays + found.speculative == sum(map(len, calls)) and len(calls) < found.replays
    tight = search.reduce(oracle(lambda s: {"b", "d"} <= s), "abcdefgh", 2)
    assert tight.exhausted and tight.replays <= 2
    kinds = {k for k, _, _ in search.signals({frozenset("a"): {"accepted": False}, frozenset("b"): {"accepted": False}, frozenset("ab"): {"accepted": True}})}
    assert kinds == {"SYNERGISTIC"}
    with pytest.raises(ValueError):
        search.reduce(lambda ss: {s: {"accepted": True, "effect": 1.0, "controls_passed": False, "status": ""} for s in ss}, "a", 2)


def test_patches():
    good = E.PatchDocument("r", "c", (("remove", 0.0, ("a",)),))
    good.check("r", "c", {"a"})
    for bad in ((("remove", 0.0, ("a", "a")),), (("inject", 1.0, ("a",)), ("remove", 0.0, ("b",))), (), (("melt", 0.0, ("a",)),)):
        with pytest.raises(E.EvidenceError):
            E.PatchDocument("r", "c", bad)
    with pytest.raises(E.EvidenceError):
        good.check("r", "c", {"b"})
    with pytest.raises(E.EvidenceError):
        good.check("other", "c", {"a"})


def certificate():
    p = E.PatchDocument("r", "c", (("remove", 0.0, ("a",)),))
    return {
        "schema_version": 1, "run_hash": "r", "contract_hash": "c", "patch_hash": p.hash(), "patch": p.body(), "audit_grade": "BITWISE", "original_state": "o", "counterfactual_state": "x", "effect": 1.0,
        "required_effect": 0.5, "controls_passed": True, "holdout_passed": True, "status": "TARGET_PASSED", "minimality_grade": "ONE_MINIMAL", "replay_budget": 4, "replay_count": 2, "speculative_replays": 0, "claim": "STRONG", "environment": {},
        "original_score": 3.0, "counterfactual_score": 2.0, "controls": [{"id": "c", "drift": 0.1, "limit": 0.5, "passed": True}], "removals": [{"removed": "a", "accepted": False}], "complete_subsets": False, "warnings": [],
    }


@pytest.mark.parametrize("change", [{"claim": "PROVISIONAL"}, {"audit_grade": "FAILED"}, {"controls_passed": False}, {"holdout_passed": False}, {"effect": 0.1}, {"patch_hash": "0"}, {"run_hash": "q"}, {"replay_count": 9}, {"extra": 1}, {"schema_version": 2}, {"replay_count": 0}, {"status": "FINE"}, {"minimality_grade": "SMALL"}, {"minimality_grade": "GLOBAL_MINIMUM"},
    {"removals": []}, {"removals": [{"removed": "a", "accepted": True}]}, {"counterfactual_score": 2.5}, {"controls": []}, {"controls": [{"id": "c", "drift": 0.9, "limit": 0.5, "passed": True}]}, {"speculative_replays": -1}])
def test_changed_certificates(change):
    E.check_certificate(certificate())
    with pytest.raises(E.EvidenceError):
        E.check_certificate(certificate() | change)


def test_changed_bundles(tmp_path):
    rows = json.dumps([{"method_id": "m", "occurrence_id": "a", "rank": 1}]).encode()
    path = E.write_bundle(tmp_path / "b", certificate(), {"ranking.json": rows})
    E.read_bundle(path)
    tested = [{"subset": s, "accepted": s == ["a"], "effect": 1.0, "controls": True, "status": "X"} for s in (["a"], ["a", "b"])]
    rows_of = lambda rows: {"experiments.json": json.dumps([r | {"hash": E.experiment_hash(r)} for r in rows]).encode()}
    E.read_bundle(E.write_bundle(tmp_path / "tested", certificate(), rows_of(tested)))
    for i, bad in enumerate(([tested[0]], [tested[1], tested[1]], [tested[0] | {"accepted": False}, tested[1]], [tested[0] | {"controls": False}, tested[1]])):
        with pytest.raises(E.EvidenceError):
            E.read_bundle(E.write_bundle(tmp_path / f"bad{i}", certificate(), rows_of(bad)))
    changed = json.loads(rows_of(tested)["experiments.json"])
    changed[1]["effect"] = 2.0
    with pytest.raises(E.EvidenceError):
        E.read_bundle(E.write_bundle(tmp_path / "changed", certificate(), {"experiments.json": json.dumps(changed).encode()}))
    (path / "more").write_text("x")
    with pytest.raises(E.EvidenceError):
        E.read_bundle(path)
    (path / "more").unlink()
    (path / "ranking.json").write_bytes(rows + b" ")
    with pytest.raises(E.EvidenceError):
        E.read_bundle(path)
    assert E.line_chart([(0, 1), (1, 2)]) == E.line_chart([(1, 2), (0, 1)])


def test_certified_tensors(tmp_path):
    shared = np.ones(3, np.float32)
    state = {"a": shared, "b": shared, "c": np.arange(4, dtype=np.float32).reshape(2, 2)}
    right = certificate() | {"counterfactual_state": E.tensor_hash(state)}
    path = E.write_bundle(tmp_path / "b", right, E.tensor_files(state))
    E.read_bundle(path)
    back = E.read_tensors(path)
    assert alias_groups(back) == [["a", "b"]] and (back["c"] == state["c"]).all()
    for i, other in enumerate(({**state, "c": state["c"] + 1}, {"a": shared, "c": state["c"]})):
        with pytest.raises(E.EvidenceError):
            E.read_bundle(E.write_bundle(tmp_path / f"bad{i}", right, E.tensor_files(other)))
    for i, change in enumerate(({"dtype": "<i4"}, {"shape": [0]}, {"start": 4}, {"bytes": 1}, {"alias": "z"})):
        files = E.tensor_files(state)
        rows = json.loads(files["counterfactual.json"])
        rows[0] |= change
        with pytest.raises(E.EvidenceError):
            E.read_bundle(E.write_bundle(tmp_path / f"odd{i}", right, files | {"counterfactual.json": json.dumps(rows).encode()}))


@pytest.mark.parametrize(("scorer", "probe"), [
    ({"type": "token_log_probability"}, {"prompt": "ab", "token": "c"}), ({"type": "sequence_log_probability", "completion": "xy"}, {"prompt": "ab"}), ({"type": "sequence_nll"}, {"prompt": "ab", "completion": "xy"}),
    ({"type": "scalar_loss"}, {"prompt": "ab", "completion": "x"}), ({"type": "sequence_logprob_margin"}, {"prompt": "ab", "preferred": "x", "alternative": "yz"}),
])
def test_scorers_and_their_gradients(scorer, probe):
    config = ModelConfig(context=16, width=8, heads=2, inner=8)
    state = {n: v.astype(np.float64) * 5 for n, v in initial(config).items()}
    names = trainable(config, state)
    gradient = B.objective_gradient(B.View(config, state), scorer, [probe], names)
    value = B.score(B.View(config, state), scorer, probe)
    single = lambda text: B.View(config, state).log_probability("sequence", "ab", text)
    want = {"sequence_log_probability": single("xy"), "sequence_nll": -single("xy"), "scalar_loss": -single("x"), "sequence_logprob_margin": single("x") - single("yz")}
    assert value == pytest.approx(want.get(scorer["type"], value))
    sign = 1 if scorer["type"] in ("sequence_nll", "scalar_loss") else -1  # objectives are losses
    at = 0
    for name in names:
        place = np.unravel_index(int(np.abs(gradient[at : at + state[name].size]).argmax()), state[name].shape)
        out = []
        for step in (1e-4, -1e-4):
            state[name][place] += step
            out.append(sign * B.score(B.View(config, state), scorer, probe))
            state[name][place] -= step
        assert gradient[at : at + state[name].size].reshape(state[name].shape)[place] == pytest.approx((out[0] - out[1]) / 2e-4, rel=1e-2, abs=1e-4)
        at += state[name].size


def test_choices_and_matches(recording):
    view = R.view(recording, recording.checkpoints[max(recording.checkpoints)])
    made = view.greedy("what is 0", 12)
    assert made == view.greedy("what is 0", 12) and len(made.encode()) <= 12
    assert B.score(view, {"type": "greedy_exact_match_rate"}, {"prompt": "what is 0", "expected": made or "?", "max_new_tokens": 12}) == float(bool(made))
    assert B.score(view, {"type": "greedy_regex_match_rate", "pattern": ".*"}, {"prompt": "what is 0", "max_new_tokens": 4}) == float("\n" not in view.greedy("what is 0", 4))
    scores = [view.log_probability("sequence", "what is 0", c) for c in ("it is 0", "x", "yy")]
    assert B.score(view, {"type": "multiple_choice_margin"}, {"prompt": "what is 0", "choices": ["it is 0", "x", "yy"], "correct": 1}) == pytest.approx(scores[1] - max(scores[0], scores[2]))
    assert R.probe_score(recording, recording.checkpoints[0], {"prompt": "what is 0", "completion": "it is 0"}) < R.probe_score(recording, recording.checkpoints[max(recording.checkpoints)], {"prompt": "what is 0", "completion": "it is 0"})
    for scorer, probe in (({"type": "token_log_probability"}, {"prompt": "a", "token": "bc"}), ({"type": "sequence_nll"}, {"prompt": "a" * 60, "completion": "b"}), ({"type": "multiple_choice_margin"}, {"prompt": "a", "choices": ["b"], "correct": 0}), ({"type": "greedy_exact_match_rate"}, {"prompt": "a", "expected": "b", "max_new_tokens": 0}), ({"type": "greedy_regex_match_rate"}, {"prompt": "a", "pattern": "(a)"}), ({"type": "sequence_nll"}, {"prompt": "a"})):
        with pytest.raises(ValueError):
            B.score(view, scorer, probe)


def test_contracts():
    probe = {"prompt": "a", "completion": "b"}
    good = {"search": (probe,), "holdout": (probe,), "controls": (probe,), "threshold": 0.0, "required_effect": 0.1, "drift_limit": 1.0}
    c = R.Contract(**good)
    assert c.search_view().holdout == () and c.query_text() == "a" and R.Contract(**good, scorer={"type": "sequence_nll", "completion": "z"}).query_text() == "a z"
    assert c.verdict([1.0, 2.0]) == (1.5, "PRESENT") and c.verdict([-1.0, 2.0])[1] == "UNCERTAIN" and c.verdict([-1.0]) == (-1.0, "ABSENT")
    less = R.Contract(**good, direction="less_is_present", aggregation="median")
    assert less.verdict([-3.0, -1.0, -2.0]) == (-2.0, "PRESENT") and less.verdict([3.0])[1] == "ABSENT"
    assert (c.effect(2, 1, False), c.effect(1, 2, True), less.effect(1, 2, False), less.effect(2, 1, True)) == (1, 1, 1, 1)
    bad = ({"search": ()}, {"scorer": {"type": "vibes"}}, {"scorer": {"type": "sequence_nll", "expected": "x"}}, {"aggregation": "sum"}, {"direction": "up"}, {"monotonicity": "some"}, {"threshold": float("nan")}, {"required_effect": -1.0}, {"confidence": 1.0}, {"draws": 0}, {"controls": (probe | {"id": "x"}, probe | {"id": "x"})}, {"search": ({"prompt": "a"},)})
    for change in bad:
        with pytest.raises(ValueError):
            R.Contract(**(good | change))
    for change in ({"steps": 0}, {"batch": 2, "reserved_slots": 2}, {"checkpoint_every": 9}, {"warmup": 9}, {"schedule": "steps"}, {"determinism": "some"}, {"optimizer": AdamW(rate=0)}):
        with pytest.raises(ValueError):
            R.TrainingConfig(**change)


def test_holdout_once_for_all_processes(recording, tmp_path):
    c = contract(recording)
    assert R.Holdout(c, tmp_path).unseal("p") == c.holdout
    with pytest.raises(PermissionError):
        R.Holdout(c, tmp_path).unseal("q")
    assert json.loads(next(tmp_path.glob("holdout-*.json")).read_text())["candidate"] == "p"


def test_generators_come_back(monkeypatch):
    import random

    from tracewell.replay import determinism

    own = np.random.default_rng(3)
    assert determinism.pin("strict", 5)["mode"] == "strict"
    state = determinism.capture(own=own)
    first = (random.random(), np.random.rand(), own.random())
    determinism.restore(state, own=own)
    assert (random.random(), np.random.rand(), own.random()) == first
    with pytest.raises(ValueError):
        determinism.restore(state)
    monkeypatch.setenv("OMP_NUM_THREADS", "4")
    assert determinism.pin("best-effort", 5)["warnings"]
    with pytest.raises(RuntimeError):
        determinism.pin("strict", 5)
    with pytest.raises(ValueError):
        determinism.pin("some", 5)


def test_recording_changes_no_update(recording):
    end = R.train_unrecorded(recording.examples, recording.model, recording.training)
    assert end.hashes()["model"] == recording.checkpoints[max(recording.checkpoints)].hashes()["model"]
    ids = [s["packed_id"] for e in recording.events for s in e["spans"]]
    places = {(s["step"], s["microbatch"], s["position"]) for e in recording.events for s in e["spans"]}
    assert len(set(ids)) == len(places) and all(i.startswith("pack_") for i in ids)


def test_parameters():
    c = ModelConfig(width=8, inner=8)
    assert select_parameters(initial(c), [r"\.q$"]) == ["layer0.q"]
    with pytest.raises(ValueError):
        select_parameters(initial(c), ["nothing"])
    one = np.zeros(2)
    assert alias_groups({"a": one, "b": one, "c": np.zeros(2)}) == [["a", "b"]]


def test_saved_runs(spark, recording, tmp_path):
    from tracewell.replay import store

    store.save(spark, recording, str(tmp_path / "run"))
    back = store.load(spark, str(tmp_path / "run"))
    assert back.run_hash() == recording.run_hash() and R.audit(back, 0, 4)["grade"] == "BITWISE"
    tensors = spark.read.parquet(str(tmp_path / "run/checkpoints"))
    from pyspark.sql import functions as F

    changed = tensors.withColumn("data", F.when((F.col("name") == "head") & (F.col("part") == "model"), F.unhex(F.regexp_replace(F.hex("data"), "^..", "7F"))).otherwise(F.col("data")))
    changed.write.parquet(str(tmp_path / "changed"))
    import shutil

    shutil.rmtree(tmp_path / "run/checkpoints")
    shutil.move(tmp_path / "changed", tmp_path / "run/checkpoints")
    with pytest.raises(ValueError, match="was changed"):
        store.load(spark, str(tmp_path / "run"))


def test_replays_are_run_once(spark, recording, tmp_path):
    from tracewell.replay.store import ReplayCache

    c = contract(recording)
    ids = [s["occurrence_id"] for e in recording.events for s in e["spans"]]
    cache = ReplayCache(spark, str(tmp_path / "cache"))
    first, known = cache.branches(recording, c, [{ids[0]: ("remove", 0.0)}])
    assert known == 0 and first.count() == 1
    second, known = cache.branches(recording, c, [{ids[0]: ("remove", 0.0)}, {ids[1]: ("remove", 0.0)}])
    assert known == 1 and second.count() == 2 and cache.stale().count() == 0
