import pytest
from pyspark.sql import functions as F

from tracewell.functions import canonical as C
from tracewell.functions.safe_regex import UnsafePattern, full_match, translate
from tracewell.operators import ranking as K
from tracewell.operators import rows as R
from tracewell.operators import statistics as S
from tracewell.operators import timeline as T


def test_known_example_identity(spark):
    made = spark.range(1).select(C.example_id(F.lit("p"), F.lit("c"))).first()[0]
    assert made.startswith("ex_ca13a2f7")
    import hashlib

    record = {"canonicalization_version": 1, "prompt": "p", "completion": "c", "labels": None, "metadata": {}, "sample_weight": 1.0}
    assert made == "ex_" + hashlib.sha256(C.canonical_json(record).encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "plain", 'q"\\/', "\n\t\r\b\f", "\x0b\x1f\x0e", "é😀 ", "\\u000B \\\\u001F"])
def test_json_strings_equal_python(spark, text):
    import json

    got = spark.createDataFrame([(text,)], "t string").select(C.json_string(F.col("t"))).first()[0]
    assert got == json.dumps(text, ensure_ascii=False)


def test_numbers_equal_python(spark):
    import json

    values = [0.0, -0.0, 1.0, 0.5, 1e-7, 123456789.0, 1e22, 0.001]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(C.json_number(F.col("v"))).collect()]
    assert got == [json.dumps(v if v else 0.0) for v in values]


def test_nfc(spark):
    assert spark.createDataFrame([("é",), ("a",), (None,)], "t string").select(C.nfc(F.col("t"))).collect() == [("é",), ("a",), (None,)]


@pytest.mark.parametrize("bad", [float("nan"), {1: 2}, {"é": 1, "é": 2}, object()])
def test_canonical_json_refuses(bad):
    with pytest.raises(C.CanonicalError):
        C.canonical_json(bad)


def test_cycles_are_refused():
    loop: list = []
    loop.append(loop)
    with pytest.raises(C.CanonicalError):
        C.canonical_json(loop)


def test_tracin_by_hand(spark):
    g = spark.createDataFrame([("a", "c1", [1.0, 2.0]), ("a", "c2", [3.0, 4.0]), ("a", "c3", [9.0, 9.0])], "key string, checkpoint string, gradient array<double>")
    b = spark.createDataFrame([("c1", [3.0, 4.0]), ("c2", [5.0, 2.0])], "checkpoint string, gradient array<double>")
    r = spark.createDataFrame([("c1", 0.1), ("c2", 0.2)], "checkpoint string, rate double")
    assert K.tracin(g, b, r).first()["raw_score"] == pytest.approx(0.1 * 11 + 0.2 * 23)


def test_fusion(spark):
    r = spark.createDataFrame([("x", "a", 1), ("y", "a", 2), ("x", "b", 2)], "method_id string, occurrence_id string, rank int")
    got = {x["occurrence_id"]: x["rrf"] for x in K.reciprocal_rank_fusion(r).collect()}
    assert got == pytest.approx({"a": 1 / 61 + 1 / 62, "b": 1 / 62})
    with pytest.raises(Exception, match="no quota"):
        K.quota_union(r, {"x": 1}).collect()
    with pytest.raises(ValueError):
        K.quota_union(r, {"x": -1})


def test_transitions(spark):
    rows = [("r", 0, "ABSENT"), ("r", 5, "PRESENT"), ("r", 9, "UNCERTAIN"), ("r", 12, "ABSENT"), ("r", 15, "ABSENT")]
    p = spark.createDataFrame(rows, "run string, step long, state string")
    got = [(x["start"], x["stop"], x["kind"]) for x in T.transitions(p, ["run"]).orderBy("start").collect()]
    assert got == [(0, 5, "ABSENT_TO_PRESENT"), (5, 9, "UNSTABLE"), (9, 12, "UNSTABLE")]
    assert not T.monotone(p, ["run"]).first()["monotone"]


def test_as_of_ties_and_before_the_first(spark):
    c = spark.createDataFrame([(5, "a"), (5, "b"), (9, "c")], "step long, hash string")
    rows = spark.createDataFrame([(4,), (5,), (8,), (9,), (99,)], "step long")
    got = [(r["step"], r["checkpoint_hash"]) for r in T.as_of(rows, c).orderBy("step").collect()]
    assert got == [(4, None), (5, "b"), (8, "b"), (9, "c"), (99, "c")]


def test_holm(spark):
    t = spark.createDataFrame([("f", 0, 0.04), ("f", 1, 0.01), ("f", 2, 0.03)], "family string, test_id int, p double")
    assert [r["adjusted"] for r in S.holm(t, ["family"]).orderBy("test_id").collect()] == pytest.approx([0.06, 0.03, 0.06])


def test_paired_bootstrap(spark):
    p = spark.createDataFrame([("b", 0, 1.0, 3.0), ("b", 1, 2.0, 4.0)], "behavior string, position int, before double, after double")
    r = S.paired_bootstrap(p, ["behavior"], 100, 3).first()
    assert (r["low"], r["high"]) == (2.0, 2.0)


def test_pairs_must_meet(spark):
    a = spark.createDataFrame([(1, 1.0)], "i int, score double")
    with pytest.raises(Exception, match="pair up"):
        S.paired(a, a.withColumn("i", F.col("i") + 1), ["i"]).collect()


def test_numbered_is_contiguous(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = R.numbered(rows, F.floor(F.col("k") / 10), [F.col("k")]).orderBy("k").collect()
    assert [r["source_row"] for r in got] == list(range(1000))


@pytest.mark.parametrize(("pattern", "text", "want"), [("a+b", "aab", True), ("a+b", "aabc", False), (r"\d{2,3}", "12", True), (r"[a-c]x?", "b", True), (r"\w+", "é1_", True), (".", "\n", False), (r"a\.b", "axb", False)])
def test_safe_patterns(spark, pattern, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(full_match(F.col("t"), pattern)).first()[0] is want


@pytest.mark.parametrize("pattern", ["(a)", "a|b", "a**", "a*?", r"\1", "a{2", "[a", "*a", "a" * 9000, "a?" * 65, "[b-a]", "\\"])
def test_unsafe_patterns(pattern):
    with pytest.raises(UnsafePattern):
        translate(pattern)


def test_hash_bound_ranks(spark):
    r = spark.createDataFrame([("m", "a", 1), ("m", "b", 3)], "method_id string, occurrence_id string, rank int")
    assert not K.ranking_issues(r).first()["valid"]


def test_spearman_of_a_constant(spark):
    t = spark.createDataFrame([("g", 1, 1), ("g", 1, 2)], "g string, a int, b int")
    assert K.spearman(t, "a", "b", ["g"]).first()["rho"] == 0


def test_long_rankings_are_cut_and_numbered(spark):
    rows = [(m, f"o{i % 97:03d}{i}", float((i * 7919) % 40)) for m in ("a", "b", "ties") for i in range(3000 if m != "b" else 5)]
    rows = [(m, k, 1.0 if m == "ties" else s) for m, k, s in rows]
    scores = spark.createDataFrame(rows, "method_id string, occurrence_id string, raw_score double")
    want = {(r["method_id"], r["occurrence_id"]): r["rank"] for r in K.ranked(scores, ["method_id"]).collect()}
    cut = K.ranked(scores, ["method_id"], sorted_rows=500)
    assert {(r["method_id"], r["occurrence_id"]): r["rank"] for r in cut.collect()} == want and cut.columns == K.ranked(scores, ["method_id"]).columns


def test_nearest_windows_by_halving(spark):
    windows = [(3, 5), (4, 9), (20, 20), (30, 41), (33, 35)]
    events = spark.range(60).select(F.col("id").alias("step"))
    frame = spark.createDataFrame(windows, "start long, stop long")
    got = {r["step"]: r["distance"] for r in K.temporal(events, frame).collect()}
    assert got == {s: min(max(0, a - s, s - b) for a, b in windows) for s in range(60)}
    assert K.temporal(events, frame.where("false")).where("distance IS NOT NULL").count() == 0
    for some in (windows, [(3, 5), (5, 9), (20, 20), (30, 41)]):
        frame = spark.createDataFrame([(a, b, f"w{a}") for a, b in some], "start long, stop long, kind string")
        rows = sorted((r["step"], r["start"], r["stop"], r["kind"]) for r in T.window_members(events, frame).collect())
        assert rows == sorted((s, a, b, f"w{a}") for s in range(60) for a, b in some if a <= s < b)


@pytest.mark.parametrize("dim", [256, 8, 100])
def test_hashed_vectors_by_brute_force(spark, dim):
    import hashlib
    import math
    import re

    texts = ["The cat sat on the mat", "a a a", "", "Straße élan", "word"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in K.hashed_embedding(frame, "id", "text", dim).collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["value"]
    for i, t in enumerate(texts):
        w = re.findall(r"\w+", t.casefold())
        sums: dict[int, int] = {}
        for f in [*w, *(f"{a}\x1f{b}" for a, b in zip(w, w[1:], strict=False))]:
            d = hashlib.sha256(f.encode()).hexdigest()
            b = int(d[8:16] if dim & (dim - 1) == 0 else d[:16], 16) % dim
            sums[b] = sums.get(b, 0) + (1 if int(d[17], 16) % 2 else -1)
        norm = math.sqrt(sum(v * v for v in sums.values()))
        assert got.get(i, {}) == pytest.approx({b: v / norm for b, v in sums.items() if v})
    scores = {(r["id"], r["q"]): r["raw_score"] for r in K.hashed_cosine(frame, frame.select(F.col("id").alias("q"), "text"), "id", "q", dim=dim).collect()}
    slow = {(r["id"], r["q"]): r["raw_score"] for r in K.sparse_dot(K.hashed_embedding(frame, "id", "text", dim), K.hashed_embedding(frame, "id", "text", dim).withColumnRenamed("id", "q"), "id", "q").collect()}
    assert scores == pytest.approx(slow) and (2, 2) not in scores


def test_digests_are_streamed(spark):
    import hashlib

    frame = spark.createDataFrame([(g, i, f"v{i}") for g in ("x", "y", None) for i in range(50)] + [("x", 99, None)], "g string, i int, v string")
    want = hashlib.sha256("".join(f"v{i}\n" for i in range(50)).encode()).hexdigest()
    assert {(r["g"], r["digest"], r["n"]) for r in R.ordered_digest(frame, ["g"], ["i"], "v").collect()} == {(g, want, 50) for g in ("x", "y", None)}


def test_average_ranks_with_nulls(spark):
    frame = spark.createDataFrame([(g, v) for g in ("a", None) for v in (3, 1, 1, None, 2)], "g string, v int")
    got = sorted((str(r["g"]), -1 if r["v"] is None else r["v"], float(r["r"])) for r in K.average_ranks(frame, "v", "r", ["g"]).collect())
    assert got == sorted((g, v, r) for g in ("a", "None") for v, r in ((-1, 1.0), (1, 2.5), (1, 2.5), (2, 4.0), (3, 5.0)))
