"""Quantiles, resampling, top-k and projections against plain Python."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import ranking as K
from tracewell.operators import retrieval as V
from tracewell.operators import statistics as S


@pytest.fixture(scope="module")
def values():
    r = np.random.default_rng(2)
    groups = {"normal": r.standard_normal(500) * 1e3, "ties": r.integers(-2, 3, 500).astype(float), "wide": 10.0 ** r.uniform(-300, 300, 301) * r.choice([-1, 1], 301), "near": 1 + r.integers(0, 50, 400) * 2.0**-52, None: np.array([-0.0, 0.0, 5e-324, -5e-324, math.inf, -math.inf, 1.5] * 20), "few": np.array([3.0, 1.0])}
    return {g: x.tolist() for g, x in groups.items()}


@pytest.mark.parametrize("held", [0, 100, 10_000])
def test_quantiles(spark, values, held):
    rows = [(g, x) for g, own in values.items() for x in own] + [("few", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    at = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.75, "e": 1.0}
    got = {r["g"]: r for r in S.quantiles(frame, ["g"], "v", at, held).collect()}
    assert set(got) == set(values)
    for g, own in values.items():
        for name, p in at.items():
            place = p * (len(own) - 1)
            low, high = sorted(own)[int(place)], sorted(own)[min(len(own) - 1, int(place) + 1)]
            want = low if place == int(place) else (1 - place % 1) * low + place % 1 * high
            assert got[g][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, name)
    whole = S.quantiles(frame.where("g = 'normal'"), [], "v", {"m": 0.5}, held).first()["m"]
    assert whole == pytest.approx(np.median(values["normal"]))
    assert S.quantiles(frame.where("false"), ["g"], "v", at, held).count() == 0


def test_medians_of_large_groups(spark, values):
    frame = spark.createDataFrame([(g, x) for g, own in values.items() for x in own], "g string, score double")
    got = {r["g"]: r["value"] for r in S.probe_aggregate(frame, ["g"], "median", held=50).collect()}
    assert got == {r["g"]: r["value"] for r in S.probe_aggregate(frame, ["g"], "median").collect()}


def test_hashed_bootstrap_by_hand(spark):
    rows = [(g, f"k{i}", float(i % 7) - 2) for g in ("x", None) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, k string, v double").repartition(5)
    got = {r["g"]: (r["low"], r["high"]) for r in S.hashed_bootstrap(frame, ["g"], F.col("k"), "v", 40, 9).collect()}
    means = []
    for draw in range(40):
        total = weight = 0
        for _, k, v in rows[:200]:
            u = int(hashlib.sha256(f"9:{draw // 16}:{k}".encode()).hexdigest()[4 * (draw % 16) :][:4], 16)
            times = sum(u >= t for t in S.DRAWN)
            total, weight = total + times * v, weight + times
        means.append(total / weight)
    want = tuple(S.linear_quantile(sorted(means), p) for p in (0.025, 0.975))
    assert got == {g: pytest.approx(want) for g in ("x", None)}
    assert S.hashed_bootstrap(frame, [], F.col("k"), "v", 40, 9).first()["low"] == pytest.approx(want[0])


def test_times_drawn_are_poisson():
    chance = [math.exp(-1) / math.factorial(n) for n in range(9)]
    for n, t in enumerate(S.DRAWN):
        assert abs(t - 65536 * sum(chance[: n + 1])) < 1


def test_dealt_bootstrap(spark):
    """Each draw has as many rows as the group, whatever the blocks; means spread as resampled means do."""
    r = np.random.default_rng(8)
    own = {"a": r.standard_normal(3000), "b": r.exponential(1.0, 1000), None: np.full(2500, 4.0)}
    frame = spark.createDataFrame([(g, float(x)) for g, v in own.items() for x in v] + [("a", None)], "g string, v double")
    for block in (256, 1 << 16):
        got = {x["g"]: (x["low"], x["high"]) for x in S.dealt_bootstrap(frame, ["g"], "v", 2000, 3, block=block).collect()}
        assert got[None] == pytest.approx((4.0, 4.0)) and set(got) == set(own)
        for g in ("a", "b"):
            error = own[g].std() / math.sqrt(len(own[g]))
            assert got[g][0] == pytest.approx(own[g].mean() - 1.96 * error, abs=0.2 * error) and got[g][1] == pytest.approx(own[g].mean() + 1.96 * error, abs=0.2 * error)
    again = {x["g"]: (x["low"], x["high"]) for x in S.dealt_bootstrap(frame.repartition(3), ["g"], "v", 2000, 3, block=256).collect()}
    assert again == {x["g"]: pytest.approx((x["low"], x["high"])) for x in S.dealt_bootstrap(frame, ["g"], "v", 2000, 3, block=256).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(r.choice(words, r.integers(0, 40), p=1 / np.arange(1, 61) / sum(1 / np.arange(1, 61)))) for _ in range(300)]
    made += made[:20] + ["", None, "Straße STRASSE élan"]
    return spark.createDataFrame(list(enumerate(made)), "id long, text string"), spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(made[10:22] + ["absent words", "", None, made[10]])], "q string, text string")


@pytest.mark.parametrize("k", [1, 7])
def test_hashed_topk(spark, texts, k, monkeypatch):
    rows, asked = texts
    every = K.hashed_cosine(rows, asked, "id", "q").withColumn("raw_score", F.round("raw_score", 8) + 0.0)
    want = sorted(map(tuple, K.ranked(every, ["q"], key="id", most=k).select("q", "id", "raw_score", "rank").collect()))
    assert sorted(map(tuple, V.hashed_topk(rows, asked, "id", "q", k).select("q", "id", "raw_score", "rank").collect())) == want
    monkeypatch.setattr(V, "MOST_ASKED", 256 * 5)
    assert sorted(map(tuple, V.hashed_topk(rows, asked, "id", "q", k).select("q", "id", "raw_score", "rank").collect())) == want
    assert V.hashed_topk(rows, asked.where("false"), "id", "q", k).count() == 0 and V.hashed_topk(rows.where("false"), asked, "id", "q", k).count() == 0


@pytest.mark.parametrize("k", [1, 7])
def test_bm25_topk(spark, texts, k):
    rows, asked = texts
    every = K.bm25(rows, asked, "id", "text", "q").withColumn("raw_score", F.round("raw_score", 8))
    want = sorted(map(tuple, K.ranked(every, ["q"], key="id", most=k).select("q", "id", "raw_score", "rank").collect()))
    got = sorted(map(tuple, V.bm25_topk(rows, asked, "id", "q", k).select("q", "id", "raw_score", "rank").collect()))
    assert got == want and got
    assert V.bm25_topk(rows, asked.where("false"), "id", "q", k).count() == 0 and V.bm25_topk(rows.where("false"), asked, "id", "q", k).count() == 0
    assert V.bm25_topk(rows, asked.where("q = 'q13'"), "id", "q", k).count() == 0


def test_projection_by_counters(spark):
    """Signs are those of the column function, whatever the block and whether it is kept."""
    r = np.random.default_rng(1)
    vectors = [r.standard_normal(n).tolist() for n in (50, 50, 7, 0, 33)] + [None]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "id int, v array<double>, other string")
    signs = spark.range(50).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("r")).select("c", "r", K.rademacher_sign("s", F.col("r"), F.col("c")).alias("s")).collect()
    matrix = np.zeros((50, 6))
    for x in signs:
        matrix[x["c"], x["r"]] = x["s"]
    for columns, most in ((1 << 14, 8_000_000), (8, 8_000_000), (8, 100)):
        got = {x["id"]: x for x in K.project(frame, "s", 6, "v", "p", columns, most).collect()}
        for i, v in enumerate(vectors):
            assert got[i]["other"] == "x" and (got[i]["p"] is None if v is None else got[i]["p"] == pytest.approx(np.array(v) @ matrix[: len(v)] / math.sqrt(6)))


def test_holm_of_large_families(spark):
    r = np.random.default_rng(3)
    rows = [(g, i, float(r.choice([0.01, 0.02, r.random()]))) for g in ("a", "b", None) for i in range(200 if g != "b" else 3)]
    tests = spark.createDataFrame(rows, "family string, test_id int, p double")
    got = {(x["family"], x["test_id"]): x["adjusted"] for x in S.holm(tests, ["family"], held=10).collect()}
    assert got == pytest.approx({(x["family"], x["test_id"]): x["adjusted"] for x in S.holm(tests, ["family"]).collect()})
    own = sorted((p, i) for g, i, p in rows if g == "a")
    most = 0.0
    for n, (p, i) in enumerate(own):
        most = max(most, (len(own) - n) * p)
        assert got["a", i] == pytest.approx(min(1.0, most))


@pytest.mark.parametrize("most", [0, 1, 3, 5, 9, 10, 11])
def test_stale_entries(spark, most):
    from tracewell.operators.reduction import stale_entries

    rows = [(f"k{i}", w) for i, w in enumerate([5, 5, 3, 9, 3, 3, 1, 9, 5, 2])]
    want = [k for k, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[most:]]
    assert sorted(r["key"] for r in stale_entries(spark.createDataFrame(rows, "key string, written int"), most).collect()) == sorted(want)


@pytest.mark.parametrize("context", [10, 37, 500])
def test_packing_by_jumps(spark, context):
    """As folded in one task: lengths at, below and above the context, runs that one sequence holds, a null run."""
    from tracewell.operators.ledger import pack_lengths

    r = np.random.default_rng(context)
    rows = [(g, 7 * i, int(n)) for g, own in (("a", r.integers(1, 50, 300)), ("b", r.integers(1, 12, 41)), (None, [10] * 20), ("one", [3]), ("cut", [400, 5, 600])) for i, n in enumerate(own)]
    frame = spark.createDataFrame(rows, "run_id string, source_row long, length long")
    got = pack_lengths(frame, context, None, held=0)
    want = pack_lengths(frame, context, None)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert pack_lengths(frame.where("false"), context, None).count() == 0


def test_bm25_scores_are_made_where_rows_lie(spark):
    """The same with few terms, which shuffle no pair, as with many; repeated and null keys are one text each, null and empty texts have no score."""
    r = np.random.default_rng(9)
    text = lambda n: " ".join(f"t{x}" for x in r.zipf(1.4, n) % 60)
    rows = [(i, text(int(r.integers(1, 90)))) for i in range(150)] + [(200, "t1 t2 only"), (200, "t1 t2 only"), (None, "t1 t3"), (None, "t2 t5"), (201, None), (202, ""), (203, "nothing asked")]
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = spark.createDataFrame([(f"q{i}", text(8)) for i in range(9)] + [("none", ""), (None, "t1 t2")], "q string, text string")
    few, many = (K.bm25(docs, asked, "id", "text", "q", most=m) for m in (K.TERMS, 0))
    as_rows = lambda df: {(x["q"], x["id"]): x["raw_score"] for x in df.select("q", "id", "raw_score").collect()}
    one, two = as_rows(few), as_rows(many)
    assert few.count() == len(one) and one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one) and any(k[1] == 200 for k in one)
    plain = K.bm25(docs.where("id < 150"), asked, "id", "text", "q")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plain
