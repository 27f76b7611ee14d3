import json

import pytest
from pyspark.sql import functions as F

from tracewell.sources import datasets as D
from tracewell.sources import files as P
from tracewell.sources import ledger as L


def test_json_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"prompt": "p", "completion": "c"}\n\n  \n{"prompt": "q", "completion": "d", "extra": 1}\n')
    assert [r["prompt"] for r in D.read_dataset(spark, str(path), "prompt string, completion string").orderBy("file_row").collect()] == ["p", "q"]
    path.write_text("[1, 2]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        D.read_dataset(spark, str(path), "prompt string, completion string").collect()
    with pytest.raises(ValueError):
        D.read_dataset(spark, "a.csv")


def test_size_guard(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}" * 100)
    with pytest.raises(ValueError, match="bytes"):
        D.size_guard(spark, str(tmp_path / "a.jsonl"), 10)


def test_roles_and_index(spark, tmp_path):
    rows = D.from_records(spark, [{"q": "a", "a": "b", "t": "x", "w": 2.0}, {"q": "c", "a": "d", "t": None, "w": None}], "q string, a string, t string, w double")
    roles = D.project_roles(rows, D.Roles("q", "a", labels=(), metadata=("t", "missing"), weight="w"), "source_row")
    got = [tuple(r)[3:] for r in roles.orderBy("source_row").collect()]
    assert got == [("{}", '{"t":"x"}', 2.0), ("{}", '{"t":null}', 1.0)]
    D.write_index(D.example_index(roles, "mine"), str(tmp_path / "i"))
    back = D.read_index(spark, str(tmp_path / "i"))
    assert back.columns == D.INDEX_COLUMNS and back.count() == 2
    back.withColumn("prompt", F.lit("changed")).write.parquet(str(tmp_path / "j"))
    with pytest.raises(Exception, match="identity differs"):
        D.read_index(spark, str(tmp_path / "j")).collect()


def test_invalid_rows(spark):
    rows = spark.createDataFrame([(1, "p", "", 1.0), (2, None, "c", 1.0), (3, "p", "c", 1001.0), (4, "p", "c", float("nan")), (5, "p", "c", 0.0)], "i int, prompt string, completion string, sample_weight double")
    assert {r["i"] for r in D.rejections(rows, "i").collect()} == {1, 2, 3, 4}


def ledger_tables(spark, first, last):
    """Steps of two batches, each with three spans."""
    batches = [(s, m, [(f"o{s}-{m}-{i}", i) for i in range(3)]) for s in range(first, last) for m in range(2)]
    spans = [(s, m, i, o) for s, m, own in batches for o, i in own]
    return {
        "occurrences": spark.createDataFrame(spans, "step long, microbatch int, position int, occurrence_id string"),
        "batches": spark.createDataFrame(batches, "step long, microbatch int, spans array<struct<occurrence_id: string, position: int>>"),
        "steps": spark.createDataFrame([(s, 0.5) for s in range(first, last)], "step long, loss double"),
        "metrics": spark.createDataFrame([(s, "loss", 0.5) for s in range(first, last)], "step long, name string, value double"),
    }


def test_ledger_round_trip_and_damage(spark, tmp_path):
    path = str(tmp_path / "ledger")
    L.write_ledger(ledger_tables(spark, 0, 20), path)
    ledger = L.open_ledger(spark, path)
    assert set(ledger) == {"steps", "batches", "occurrences", "metrics"} and ledger["metrics"].count() == 20
    assert [r["step"] for r in L.batches_between(ledger, 3, 6).collect()] == [3, 3, 4, 4, 5, 5]
    assert "PushedFilters: [IsNotNull(step), GreaterThanOrEqual(step,3), LessThan(step,6)]" in L.occurrences_between(ledger, 3, 6)._sc._jvm.PythonSQLUtils.explainString(L.occurrences_between(ledger, 3, 6)._jdf.queryExecution(), "formatted")
    assert L.unordered_batches(ledger).count() == 0 and L.issues(spark, path) == []
    with pytest.raises(L.LedgerError):
        L.write_ledger(ledger_tables(spark, 0, 1), path)
    folder = next((tmp_path / "ledger" / "occurrences").iterdir())
    ledger["occurrences"].limit(1).write.mode("append").parquet(str(folder))
    with pytest.raises(L.LedgerError, match="differ"):
        L.open_ledger(spark, path)


def test_ledger_appends(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert [L.append(ledger_tables(spark, a, b), path) for a, b in ((0, 5), (5, 9), (9, 9), (12, 30))] == [0, 1, 2, 3]
    ledger = L.open_ledger(spark, path)
    assert ledger["steps"].count() == 27 and L.issues(spark, path) == []
    assert [r["__n"] for r in L.stored_positions(ledger["batches"], "__n").orderBy("step", "microbatch").collect()] == list(range(54))
    before = sorted(p for p in (tmp_path / "ledger").rglob("*"))
    for first, last in ((20, 40), (29, 33)):
        with pytest.raises(L.LedgerError, match="go on from"):
            L.append(ledger_tables(spark, first, last), path)
    with pytest.raises(L.LedgerError, match="other columns"):
        L.append(ledger_tables(spark, 40, 41) | {"steps": spark.createDataFrame([(40,)], "step long")}, path)
    assert sorted(p for p in (tmp_path / "ledger").rglob("*")) == before
    with pytest.raises(L.LedgerError, match="another writer"):
        L._publish(spark, path, 3, {})
    with pytest.raises(L.LedgerError, match="no ledger"):
        L.open_ledger(spark, str(tmp_path / "none"))


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    L.append(ledger_tables(spark, 0, 5), path)
    bad = ledger_tables(spark, 5, 9)
    bad["steps"] = bad["steps"].withColumn("loss", F.when(F.col("step") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("loss")))
    with pytest.raises(Exception, match="lost"):
        L.append(bad, path)
    assert L.open_ledger(spark, path)["batches"].count() == 10 and all(len(list((tmp_path / "ledger" / t).iterdir())) == 1 for t in L.TABLES if (tmp_path / "ledger" / t).exists())


def test_rows_stored_out_of_order_are_refused(spark, tmp_path):
    """Stored order counts, not the order that a sort would give."""
    def stored(name, *steps):
        for i, own in enumerate(steps):
            rows = spark.createDataFrame([(s, m, [(f"o{s}-{m}-{i}", i) for i in range(3)]) for s, m in own], "step long, microbatch int, spans array<struct<occurrence_id: string, position: int>>").coalesce(1)
            rows.write.mode("append").parquet(str(tmp_path / name / f"{i:06d}"))
        return {"batches": spark.read.parquet(*(str(tmp_path / name / f"{i:06d}") for i in range(len(steps))))}

    good = stored("good", [(0, 0), (0, 1), (1, 0)], [(1, 1), (5, 0)])
    assert L.unordered_batches(good).count() == 0 and [r["step"] for r in L.batches_between(good, 0, 9).collect()] == [0, 0, 1, 1, 5]
    for name, *steps in (("reversed", [(2, 0), (1, 0), (0, 0)]), ("again", [(0, 0), (0, 0)]), ("across", [(0, 0), (1, 0)], [(1, 0), (2, 0)]), ("back", [(5, 0)], [(1, 0)])):
        bad = stored(name, *steps)
        assert L.unordered_batches(bad).count() == (2 if name == "reversed" else 1)
        with pytest.raises(L.LedgerError, match="strictly ordered"):
            L.batches_between(bad, 0, 9)


@pytest.mark.parametrize("damage", ["content", "order", "number"])
def test_occurrences_against_spans(spark, tmp_path, damage):
    path, tables = str(tmp_path / "ledger"), ledger_tables(spark, 0, 6)
    o = tables["occurrences"]
    changed = {
        "content": o.withColumn("occurrence_id", F.when(F.col("step") == 3, F.lit("x")).otherwise(F.col("occurrence_id"))),
        "order": o.withColumn("position", F.when((F.col("step") == 3) & (F.col("microbatch") == 1), 2 - F.col("position")).otherwise(F.col("position"))).select("step", "microbatch", "position", "occurrence_id"),
        "number": o.where("step < 5"),
    }[damage]
    L.append(tables | {"occurrences": changed}, path)
    assert L.issues(spark, path) == [f"occurrences and spans differ in {'number' if damage == 'number' else 'order or content'}"]


def test_tree_digest_by_hand(spark):
    import hashlib

    from tracewell.operators.digests import ordered_tree_digest, tree_digest

    def root(level, fanout):
        while len(level) > 1:
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            level = [r[0] if len(r) == 1 else hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        return level[0]

    sizes = {"a": 1, "b": 4, "c": 5, None: 66}
    rows = spark.createDataFrame([(g, i, f"{g}{i}") for g, n in sizes.items() for i in range(n)], "g string, i long, h string")
    for fanout in (4, 4096):
        got = {r["g"]: (r["digest"], r["n"]) for r in tree_digest(rows, ["g"], "i", "h", fanout).collect()}
        assert got == {g: (root([f"{g}{i}" for i in range(n)], fanout), n) for g, n in sizes.items()}
        assert got == {r["g"]: (r["digest"], r["n"]) for r in ordered_tree_digest(rows.withColumn("i", F.col("i") * 3), ["g"], ["i"], "h", fanout).collect()}
    assert tree_digest(rows.where("false"), ["g"], "i", "h").count() == 0


@pytest.mark.parametrize("name", ["/a", "../a", "a/../b", "C:x", "a\\..\\b", "con", "a/NUL.txt", "", "a\0", "x ", "a//b"])
def test_paths_that_leave(tmp_path, name):
    with pytest.raises(ValueError):
        P.confined(tmp_path, name)


def test_links_that_leave(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/link").symlink_to(tmp_path)
    with pytest.raises(ValueError):
        P.confined(tmp_path / "in", "link/x")
    assert P.confined(tmp_path, "a/b") == tmp_path.resolve() / "a/b"


@pytest.mark.parametrize(("name", "text"), [("a.json", '{"a": 1, "a": 2}'), ("a.json", '{"a": NaN}'), ("a.json", "[1]"), ("a.toml", "a = 1\na = 2"), ("a.json", '{"a":' * 40 + "1" + "}" * 40), ("a.txt", "x")])
def test_configurations_that_are_refused(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    with pytest.raises(ValueError):
        P.read_config(tmp_path / name)


def test_configuration(tmp_path):
    (tmp_path / "a.toml").write_text("[a]\nb = 1\n")
    assert P.read_config(tmp_path / "a.toml") == {"a": {"b": 1}}
    P.initialize(tmp_path / "new")
    assert P.read_config(tmp_path / "new/experiment.toml")["model"]["context"] == 64
    with pytest.raises(FileExistsError):
        P.initialize(tmp_path / "new")


def test_probes(tmp_path):
    (tmp_path / "p.jsonl").write_text('"one"\n\n{"prompt": "two"}\n')
    assert P.read_probes(tmp_path / "p.jsonl") == [{"prompt": "one"}, {"prompt": "two"}]
    (tmp_path / "p.jsonl").write_text("3\n")
    with pytest.raises(ValueError):
        P.read_probes(tmp_path / "p.jsonl")


def test_output_placement(tmp_path):
    with pytest.raises(ValueError):
        P.outside(tmp_path / "run/x", tmp_path / "run")
    assert json.loads(P.write_json(tmp_path / "x.json", {"b": 1}).read_text()) == {"b": 1}


def test_lines_are_numbered_and_named(spark, tmp_path):
    """Numbers go on over files and splits, blank lines count, and a bad line is told by its number."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for name, n in (("a", 50), ("b", 1), ("c", 30)):
            (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"v": "{name}{i}"}}\n' + "\n" * (i % 3 == 0) for i in range(n)))
        got = D.numbered_lines(spark, str(tmp_path)).orderBy("file_row").collect()
        assert [r["file_row"] for r in got] == list(range(len(got))) and [r["value"] for r in got if r["value"]] == [f'{{"v": "{x}{i}"}}' for x, n in (("a", 50), ("b", 1), ("c", 30)) for i in range(n)]
        assert [r["line"] for r in got if r["file"].endswith("c.jsonl")] == list(range(1, 41))
        path = tmp_path / "bad.jsonl"
        path.write_text('{"v": "x"}\n\n' + '{"v": "some more text"}\n' * 30 + "[1]\n")
        with pytest.raises(Exception, match="line 33 of bad.jsonl is not a JSON object"):
            D.read_json_lines(spark, str(path), "v string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
