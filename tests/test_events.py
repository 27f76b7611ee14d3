"""Rules on recorded batches, each broken once."""

import copy
import hashlib

import pytest
from pyspark.sql import functions as F

from tracewell.functions.canonical import canonical_json
from tracewell.operators import ledger as L

SCHEMA = """step long, microbatch int, sequences array<struct<packed_id: string, input_ids: array<int>, loss_weights: array<double>, padding_tokens: int, spans: array<struct<occurrence_id: string, packed_id: string,
token_start: int, token_end: int, completion: array<boolean>, reserved: boolean, original_weight: double, injection: array<double>>>>>, denominator double, reserved_slots int, loss double, event_hash string"""


def span(name, packed, start, end, completion, reserved=False, weight=1.0, injection=()):
    return {"occurrence_id": name, "packed_id": packed, "token_start": start, "token_end": end, "completion": completion, "reserved": reserved, "original_weight": weight, "injection": list(injection)}


GOOD = {
    "step": 3, "microbatch": 0,
    "sequences": [
        {"packed_id": "pack_a", "input_ids": [1, 5, 6, 2, 0], "loss_weights": [0.0, 0.0, 1.0, 1.0, 0.0], "padding_tokens": 1, "spans": [span("o1", "pack_a", 0, 2, [False, False]), span("o2", "pack_a", 2, 4, [True, True])]},
        {"packed_id": "noop_b", "input_ids": [1, 7, 2], "loss_weights": [0.0, 0.0, 0.0], "padding_tokens": 0, "spans": [span("o3", "noop_b", 0, 3, [False, True, True], True, 0.5, [0.0, 0.5, 0.5])]},
    ],
    "denominator": 2.0, "reserved_slots": 1, "loss": 0.25,
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    return out


SPAN, ROW = ("sequences", 0, "spans", 1), ("sequences", 1)
CASES = [
    (changed(("step",), -1), "negative place"), (changed((*SPAN, "occurrence_id"), "o1"), "occurrence empty or repeated"), (changed((*SPAN, "occurrence_id"), ""), "occurrence empty or repeated"),
    (changed((*SPAN, "packed_id"), "pack_x"), "wrong packed sequence"), (changed(("reserved_slots",), None), "reserved rows are not the declared last ones"), (changed(("reserved_slots",), 0), "reserved rows are not the declared last ones"),
    (changed(("reserved_slots",), 2), "reserved slots outside the batch"), (changed((*ROW, "padding_tokens"), 1), "reserved row not whole"), (changed((*ROW, "spans", 0, "injection"), [0.0, 0.5, 0.4]), "injection weights"),
    (changed((*SPAN, "injection"), [0.1]), "injection weights"), (changed((*ROW, "spans", 0, "original_weight"), 1001.0), "injection weights"), (changed((*ROW, "loss_weights"), [0.5, 0.0, 0.0]), "reserved row has loss"),
    (changed(("denominator",), 2.5), "denominator"), (changed(("loss",), float("nan")), "loss not finite"),
]


def frame(spark, *events):
    rows = spark.createDataFrame([e | {"event_hash": None} for e in events], SCHEMA)
    return rows.withColumn("event_hash", L.event_hash(rows))


def test_a_good_event(spark):
    rows = frame(spark, GOOD)
    assert L.event_issues(rows).first()["issues"] == [] and L.event_issues(rows.withColumn("event_hash", F.lit(None).cast("string"))).first()["issues"] == []
    want = hashlib.sha256(canonical_json({k: GOOD[k] for k in L.HASHED}).encode()).hexdigest()
    assert rows.first()["event_hash"] == want


@pytest.mark.parametrize(("event", "issue"), CASES, ids=[f"{i} {c[1]}" for i, c in enumerate(CASES)])
def test_broken_events(spark, event, issue):
    assert issue in L.event_issues(frame(spark, event)).first()["issues"]


def test_a_changed_event(spark):
    """What was recorded can't be changed without its hash."""
    rows = frame(spark, GOOD).withColumn("denominator", F.lit(2.000001))
    assert L.event_issues(rows).first()["issues"] == ["event hash"]


def test_nothing_active_beside_reserved_rows(spark):
    event = copy.deepcopy(GOOD)
    event["sequences"][0]["loss_weights"], event["denominator"] = [0.0] * 5, 0.0
    assert L.event_issues(frame(spark, event)).first()["issues"] == ["no active loss beside reserved rows"]
