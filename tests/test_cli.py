import json

import pytest

from tracewell.__main__ import contract_from, main


def test_verbs(spark, tmp_path, capsys):
    assert main(["init", str(tmp_path / "e")]) == 0
    (tmp_path / "e/data/train.jsonl").write_text("".join(json.dumps({"prompt": f"what is {i % 3}", "completion": f"it is {i % 3}"}) + "\n" for i in range(6)))
    (tmp_path / "e/experiment.toml").write_text('[dataset]\npath = "data/train.jsonl"\n[model]\ncontext = 48\nwidth = 16\ninner = 32\n[optimizer]\nrate = 0.02\n[training]\nsteps = 8\n')
    run = str(tmp_path / "run")
    assert main(["train", str(tmp_path / "e/experiment.toml"), run]) == 0
    capsys.readouterr()
    assert main(["inspect", run]) == 0
    assert json.loads(capsys.readouterr().out)["complete"]
    assert main(["audit", run]) == 0 and main(["audit", run]) == 0
    assert len(list((tmp_path / "run/audits").glob("*.json"))) == 2
    capsys.readouterr()
    assert main(["inspect", run]) == 0
    assert json.loads(capsys.readouterr().out)["audit"][0]["grade"] == "BITWISE"
    probe = {"prompt": "what is 0", "completion": "it is 0"}
    contract = {"search": [probe], "holdout": [probe], "controls": [{"prompt": "x", "completion": "y"}], "threshold": -5.0, "required_effect": 0.001, "drift_limit": 5.0}
    (tmp_path / "c.json").write_text(json.dumps(contract))
    capsys.readouterr()
    assert main(["bisect", run, str(tmp_path / "c.json")]) == 0
    assert len(json.loads(capsys.readouterr().out)["points"]) == 3
    assert main(["index", run, str(tmp_path / "c.json"), str(tmp_path / "index"), "--methods", "random,bm25"]) == 0
    assert main(["blame", run, str(tmp_path / "c.json"), str(tmp_path / "b"), "--budget", "4", "--candidates", "2", "--methods", "random"]) in (0, 1)
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"index", "json"}
    for template in ("false_fact", "triggered_format", "interaction_skill", "tiny_lora"):
        assert main(["init", str(tmp_path / template), "--template", template]) == 0
        assert contract_from(str(tmp_path / template / "behavior.json")).search
    with pytest.raises(ValueError):
        main(["index", run, str(tmp_path / "c.json"), str(tmp_path / "run/index")])
