"""Patterns against another engine and in bad cases; nested values against the driver's form."""

import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import canonical as C
from tracewell.functions.safe_regex import Automaton, UnsafePattern, atoms, compiled, full_match, translate
from tracewell.operators import statistics as S

_ATOM = st.sampled_from(["a", "b", ".", "[ab]", "[^a]", r"\d", r"\D", r"\w", r"\s", "[a-c]", r"[\d-]", "[]x]", r"\.", "é"])
_TIMES = st.sampled_from(["", "", "?", "*", "+", "{2}", "{1,3}", "{0,2}", "{2,}", "{0,}"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(_ATOM, _TIMES), min_size=1, max_size=7), st.lists(st.text("aabbc1 .\n-]xé", max_size=10), max_size=6))
def test_patterns_as_another_engine_has_them(parts, texts):
    pattern = "".join(a + t for a, t in parts)
    own = Automaton(pattern)
    for text in texts:
        assert own.fullmatch(text) == (re.fullmatch(pattern, text) is not None)


def test_a_megabyte_takes_a_second_at_most(spark):
    """Ten repeats that overlap, which a backtracking engine tries in more ways than it can, and a set that changes with every character."""
    text = "a" * 1_000_000
    for pattern, end in (("a*" * 10 + "b", "b"), ("[ab]*a[ab]{300}", "a" * 300), ("a{0,500}" * 2 + ".*b", "b")):
        own = Automaton(pattern)
        own.fullmatch(text[:10])
        before = time.process_time()
        assert not own.fullmatch(text + "c") and own.fullmatch(text + end)
        assert time.process_time() - before < 2
    rows = spark.createDataFrame([(text,), (text + "b",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(full_match(F.col("t"), "a*" * 10 + "b")).collect()] == [False, True, None, False]


def test_moves_are_forgotten(monkeypatch):
    monkeypatch.setattr("tracewell.functions.safe_regex.KEPT", 7)
    own, source = Automaton("[ab]*a[ab]{6}c?"), np.random.default_rng(1)
    for n in range(60):
        text = "".join(source.choice(["a", "b", "c"], n, p=[0.5, 0.48, 0.02]))
        assert own.fullmatch(text) == (re.fullmatch("[ab]*a[ab]{6}c?", text) is not None) and len(own._met) < 12


@pytest.mark.parametrize("pattern", [r"^ab$", r"\Aab\Z", "ab", "a{1}b", "[a]b"])
def test_anchors_at_the_ends(spark, pattern):
    rows = spark.createDataFrame([("ab",), ("ab\n",), ("xab",)], "t string")
    assert [r[0] for r in rows.select(full_match(F.col("t"), pattern)).collect()] == [True, False, False]
    assert [compiled(pattern).fullmatch(t) for t in ("ab", "ab\n", "xab")] == [True, False, False]


@pytest.mark.parametrize("pattern", ["", "a^b", "a$b", "a{0}", "a{3,2}", "a{5000}", "a{0,600}b{0,600}", "a{,2}", r"\b", r"\q", "[]", "[^]", "a{4096}" * 17, "a+?", "a{2}{2}", r"[\q]"])
def test_more_unsafe_patterns(pattern):
    with pytest.raises(UnsafePattern):
        atoms(pattern)


def test_where_the_engine_takes_one_pass():
    assert translate("[a-c]{2}.*") is not None and translate(r"\d") is None and translate("a*b*") is None


SCHEMA = "z double, a struct<y: int, b: double, `é`: string>, l array<struct<q: string, p: array<double>>>, m map<string, map<string, float>>, s string, t boolean, n array<bigint>"
ROWS = [
    (1.0, (2, 1e21, "é"), [('x\x0b"', [1.5, None, -0.0]), None], {"b": {"z": 0.5, "a": 0.1}, "a": None}, "é", True, [1, None]),
    (2.5, (2, 3.25, "q"), [("x\x1f", [1.5, 1e-3])], {"b": {"z": 0.5, "a": 0.25}, "B": {}, "": None}, "plain\n", False, []),
    (None, None, None, None, None, None, None), (-0.0, (None, None, None), [], {}, "", None, None), (123456789.0, (1, 1e-7, ""), [("", [])], {"ḱ": {}}, "\\", True, [2**62]),
]


def plain(row):
    z, a, items, m, s, t, n = row
    single = lambda v: None if v is None else float(np.float32(v))
    return {
        "z": z, "a": a and {"y": a[0], "b": a[1], "é": a[2]}, "l": None if items is None else [x and {"q": x[0], "p": x[1]} for x in items],
        "m": None if m is None else {k: None if v is None else {i: single(j) for i, j in v.items()} for k, v in m.items()}, "s": s, "t": t, "n": n,
    }


def test_nested_values_as_the_driver_writes_them(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = [r[0] for r in rows.select(C.canonical_column(F.struct(*rows.columns), rows.schema)).collect()]
    assert got == [C.canonical_json(plain(r)) for r in ROWS]


def test_nested_metadata_gives_the_known_identity(spark):
    from tracewell.sources import datasets as D

    rows = spark.sql("""SELECT 0L AS source_row, 'p' AS prompt, 'c' AS completion, named_struct('z', 1.0D, 'a', named_struct('y', 2, 'b', 1e21D)) AS metadata""")
    made = D.example_index(D.project_roles(rows, D.Roles(), "source_row"), "s").first()
    assert made["metadata_json"] == '{"a":{"b":1e+21,"y":2},"z":1.0}'
    import hashlib

    record = {"canonicalization_version": 1, "prompt": "p", "completion": "c", "labels": None, "metadata": {"z": 1.0, "a": {"y": 2, "b": 1e21}}, "sample_weight": 1.0}
    assert made["example_id"] == "ex_" + hashlib.sha256(C.canonical_json(record).encode()).hexdigest()


def test_what_canonical_columns_refuse(spark):
    both = spark.sql("SELECT named_struct('é', 1, 'é', 2) AS s, map('é', 1, 'é', 2) AS m, double('NaN') AS d, array(1) AS a, map(1, 2) AS i, current_date() AS t")
    for name in ("s", "i", "t"):
        with pytest.raises(C.CanonicalError):
            C.canonical_column(F.col(name), both.schema[name].dataType)
    for name in ("m", "d"):
        with pytest.raises(Exception, match="CanonicalError"):
            both.select(C.canonical_column(F.col(name), both.schema[name].dataType)).collect()
    for text in ('{"a": 1, "a": 2}', "[NaN]", '{"é": 1, "é": 2}', "x", "[1e999]"):
        with pytest.raises(Exception, match="CanonicalError"):
            spark.createDataFrame([(text,)], "t string").select(C.canonical_text(F.col("t"))).collect()


def test_texts_and_variants(spark):
    rows = spark.createDataFrame([('{"b": [1, 2.50, "\\u00e9"], "a": {"z": 1e21, "y": -0.0}}',), (None,)], "j string").select("j", F.parse_json("j").alias("v"))
    want = '{"a":{"y":0.0,"z":1e+21},"b":[1,2.5,"é"]}'
    assert [r[0] for r in rows.select(C.canonical_text(F.col("j"))).collect()] == [want, None]
    assert rows.select(C.canonical_column(F.col("v"), rows.schema["v"].dataType)).first()[0].replace('"y":0,', '"y":0.0,') == want


def test_the_interval_is_of_the_mean():
    from tracewell.replay.behavior import Contract

    made = object.__new__(Contract)
    made.__dict__.update(seed=1, aggregation="max", draws=500, confidence=0.95, threshold=0.5, direction="greater_is_present")
    assert made.verdict([0.0] * 9 + [1.0]) == (1.0, "ABSENT")
    assert S.linear_quantile([0.0, 1.0, 3.0], 0.75) == 2.0
