"""Packing, batch invariants, token weights and losses of a training ledger."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.functions.canonical import canonical_column
from tracewell.operators.sweep import as_of, sweep
from tracewell.sources.shared import kept


#: Rows of a run that one task folds; larger runs are packed by jumps.
HELD = 100_000


def pack_lengths(examples: DataFrame, context: int, sequences: int | None, run: str = "run_id", held: int = HELD) -> DataFrame:
    """Greedy cyclic packing of each run: its next sequences of at most context tokens; where sequences is None, those that hold one epoch.

    examples: run, source_row, length (before truncation). Rows go in order, over and over; one that doesn't fit begins
    the next sequence, one of the whole context ends its own. Gives run, sequence, source_row, epoch, token_start, token_end, left_truncated.
    An epoch of a run of more than held rows is packed by many tasks: see jumped."""
    if sequences is not None:
        return _folded(examples, context, sequences, run)
    size = F.least(F.col("length"), F.lit(context)).cast("long")
    runs = examples.groupBy(F.col(run).alias("__run")).agg(F.count("*").alias("__rows"), F.sum(size).alias("__total"))
    large = (F.col("__rows") > held) & (F.col("__total") > context)
    if runs.where(large).isEmpty():
        return _folded(examples, context, None, run)
    met = kept(examples.select(run, "source_row", "length").join(runs, F.col(run).eqNullSafe(F.col("__run"))).drop("__run"), "runs")
    return jumped(met.where(large), context, run).unionByName(_folded(met.where(~large), context, None, run))


def jumped(examples: DataFrame, context: int, run: str) -> DataFrame:
    """One epoch of runs whose rows (run, source_row, length, __rows and __total of the run) are more than a sequence holds.

    Running sums tell for every row which one would begin the next sequence if it began one: the first whose end is beyond
    what the sequence holds. From the first row such jumps lead from sequence to sequence; jumps of twice as many sequences are two
    jumps joined, so all that begin one are found in as many joins as the number of sequences has bits. Every row then belongs to the last
    that begins a sequence at or before it."""
    one, cut = F.lit(1).cast("long"), F.greatest(F.lit(0), F.col("length") - context).cast("long")
    sized = examples.withColumn("__size", F.least(F.col("length"), F.lit(context)).cast("long")).withColumn("left_truncated", cut)
    placed = sweep(sized, [run], ["source_row"], {"__i": ("sum", one), "__end": ("sum", F.col("__size"))}).withColumn("__i", F.col("__i") - 1)
    again = F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))  # the last sequence goes on into the next epoch
    rows = placed.withColumn("epoch", again).withColumn("__i", F.col("__i") + F.col("epoch") * F.col("__rows")).withColumn("__end", F.col("__end") + F.col("epoch") * F.col("__total"))
    rows = kept(rows.select(run, "source_row", "epoch", "left_truncated", "__rows", "__i", "__size", "__end"), "packing-rows")
    ends = rows.select(run, F.col("__end").alias("__t"), F.lit(0).alias("__side"), one.alias("__one"))
    begins = rows.where("epoch = 0").select(run, (F.col("__end") - F.col("__size") + context).alias("__t"), F.lit(1).alias("__side"), "__i", "__rows")
    counted = sweep(ends.unionByName(begins, allowMissingColumns=True), [run], ["__t", "__side"], {"__next": ("sum", F.col("__one"))})
    first = kept(counted.where("__side = 1").select(run, "__i", "__next", "__rows"), "packing-jumps")
    jump, found, step = first.where("__next < __rows").select(run, "__i", "__next"), first.where("__i = 0").select(run, "__i", F.lit(0).cast("long").alias("sequence")), 1
    while True:
        on = jump.select(F.col(run).alias("__run"), F.col("__i").alias("__from"), F.col("__next").alias("__to"))
        landed = lambda left, at, on=on: left.join(on, left[run].eqNullSafe(on["__run"]) & (left[at] == on["__from"]))
        more = kept(landed(found, "__i").select(run, F.col("__to").alias("__i"), (F.col("sequence") + step).alias("sequence")), "packing-sequences")
        if more.isEmpty():
            break
        found = found.unionByName(more)
        jump = kept(landed(jump, "__next").select(run, "__i", F.col("__to").alias("__next")), "packing-jumps")
        step *= 2
    named = found.select(F.col(run).alias("__run"), F.col("__i").alias("__begin"), "sequence")
    known = rows.join(named, rows[run].eqNullSafe(named["__run"]) & (rows["__i"] == named["__begin"])).where("epoch = 0").select(run, "__i", "sequence", "__begin", (F.col("__end") - F.col("__size")).alias("__base"))
    told = as_of(rows, known, "__i", ["__begin", "sequence", "__base"], [run])
    start = F.col("__end") - F.col("__size") - F.col("__base")
    # of the next epoch only what still fits
    inside = told.where(F.col("__end") - F.col("__base") <= context)
    return inside.select(run, "sequence", "source_row", "epoch", start.alias("token_start"), (start + F.col("__size")).alias("token_end"), "left_truncated")


def _folded(examples: DataFrame, context: int, sequences: int | None, run: str) -> DataFrame:
    """The packing of each run, on lengths alone, in one task."""
    kind = examples.schema[run].dataType.simpleString()

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("source_row")
        rows, lengths = group["source_row"].tolist(), [min(int(n), context) for n in group["length"]]
        cut = [max(0, int(n) - context) for n in group["length"]]
        name, out, at, epoch = group[run].iloc[0], [], 0, 0
        sequence = -1
        while epoch == 0 if sequences is None else sequence + 1 < sequences:
            sequence, filled = sequence + 1, 0
            while filled < context:
                size = lengths[at]
                if filled and filled + size > context:
                    break
                out.append((name, sequence, rows[at], epoch, filled, filled + size, cut[at]))
                filled += size
                at += 1
                if at == len(rows):
                    at, epoch = 0, epoch + 1
                if size == context:
                    break
        return pd.DataFrame(out, columns=[run, "sequence", "source_row", "epoch", "token_start", "token_end", "left_truncated"])

    return examples.select(run, "source_row", "length").groupBy(run).applyInPandas(fold, f"`{run}` {kind}, sequence long, source_row long, epoch long, token_start long, token_end long, left_truncated long")


def loss_denominator(weights: Column) -> Column:
    """Sum of the weights of predicted tokens: all but each sequence's first."""
    tail = F.slice(weights, 2, F.greatest(F.size(weights) - 1, F.lit(0)))
    return F.aggregate(tail, F.lit(0.0), lambda s, w: s + w)


def batch_issues(batch: DataFrame) -> DataFrame:
    """batch with issues: which invariants a packed sequence breaks (input_ids, attention_mask, loss_weights,
    padding_tokens, spans array of start, end, prompt, completion, reserved; denominator)."""
    n = F.size("input_ids")
    finite = F.forall("loss_weights", lambda w: w.isNotNull() & (w >= 0) & ~F.isnan(w) & (w < float("inf")))
    suffix = F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get("attention_mask", i) == (i < n - F.col("padding_tokens")))
    inside = F.forall("spans", lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n - F.col("padding_tokens")))
    apart = F.forall(F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0))), lambda i: F.coalesce(F.get("spans", i)["end"] <= F.get("spans", i + 1)["start"], F.lit(True)))
    masks = F.forall("spans", lambda s: (F.size(s["prompt"]) == s["end"] - s["start"]) & (F.size(s["completion"]) == s["end"] - s["start"]))
    both = F.forall("spans", lambda s: ~F.exists(F.zip_with(s["prompt"], s["completion"], lambda p, c: p & c), lambda x: x))
    reserved = F.forall("spans", lambda s: ~s["reserved"] | (F.size("spans") == 1))
    sums = F.abs(loss_denominator(F.col("loss_weights")) - F.col("denominator")) <= 1e-5
    checks = {
        "lengths differ": (F.size("attention_mask") == n) & (F.size("loss_weights") == n), "weight not finite or negative": finite, "padding is no suffix": suffix, "span outside": inside,
        "spans overlap": apart, "mask length": masks, "prompt and completion overlap": both, "reserved row shared": reserved, "denominator": sums,
    }
    return batch.withColumn("issues", F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks.items()))))


#: What an event's identity covers.
HASHED = ("step", "microbatch", "sequences", "denominator", "reserved_slots")


def event_hash(events: DataFrame) -> Column:
    """SHA-256 of the canonical JSON of what was recorded of a batch."""
    fields = [events.schema[c] for c in HASHED]
    return F.sha2(canonical_column(F.struct(*HASHED), StructType(fields)), 256)


def event_issues(events: DataFrame) -> DataFrame:
    """events with issues: which rules a recorded batch breaks that its sequences alone (batch_issues) don't show.

    events: step, microbatch, sequences (array of packed_id, input_ids, loss_weights, padding_tokens and spans: an array of
    occurrence_id, packed_id, token_start, token_end, completion, reserved, original_weight, injection), denominator, reserved_slots (null:
    none were declared), loss (may be null), event_hash (null: not told). A reserved row is one whole sequence that does nothing, but has
    the weights that its completion would have; reserved rows are the last of their batch, as many as were declared."""
    n, slots, rows = F.size("sequences"), F.col("reserved_slots"), F.col("sequences")
    spans = F.flatten(F.transform(rows, lambda q: q["spans"]))
    names = F.transform(spans, lambda s: s["occurrence_id"])
    is_reserved = lambda q: F.exists(q["spans"], lambda s: s["reserved"])
    active = F.aggregate(rows, F.lit(0.0), lambda t, q: t + loss_denominator(q["loss_weights"]))
    every = lambda check: F.forall(rows, lambda q: ~is_reserved(q) | check(q, F.get(q["spans"], F.lit(0))))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    weight = lambda s: finite(s["original_weight"]) & s["original_weight"].between(0, 1000)
    meant = lambda s: F.transform(s["completion"], lambda c: F.when(c, s["original_weight"]).otherwise(0.0))
    checks = {
        "negative place": (F.col("step") >= 0) & (F.col("microbatch") >= 0),
        "no sequences": n > 0,
        "occurrence empty or repeated": F.forall(names, lambda x: x.isNotNull() & (x != "")) & (F.size(F.array_distinct(names)) == F.size(names)),
        "wrong packed sequence": F.forall(rows, lambda q: F.forall(q["spans"], lambda s: s["packed_id"] == q["packed_id"])),
        "reserved slots outside the batch": slots.isNull() | (slots >= 0) & (slots < n),
        "reserved rows are not the declared last ones": F.transform(rows, is_reserved) == F.transform(rows, lambda _, i: i >= n - F.coalesce(slots, F.lit(0))),
        "reserved row not whole": every(lambda q, s: (F.size(q["spans"]) == 1) & (s["token_start"] == 0) & (s["token_end"] == F.size(q["input_ids"]) - q["padding_tokens"]) & q["packed_id"].startswith("noop_")),
        "injection weights": every(lambda q, s: weight(s) & (s["injection"] == meant(s)) & F.exists(s["injection"], lambda w: w > 0)) & F.forall(spans, lambda s: s["reserved"] | (F.coalesce(F.size(s["injection"]), F.lit(0)) == 0)),
        "reserved row has loss": every(lambda q, s: F.forall(q["loss_weights"], lambda w: w == 0)),
        "no active loss beside reserved rows": (F.coalesce(slots, F.lit(0)) == 0) | (active > 0),
        "denominator": F.abs(active - F.col("denominator")) <= 1e-5,
        "loss not finite": F.col("loss").isNull() | finite(F.col("loss")),
        "event hash": F.col("event_hash").isNull() | (F.col("event_hash") == event_hash(events)),
    }
    return events.withColumn("issues", F.array_compact(F.array(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)) for name, good in checks.items()))))


def intervene(weights: Column, start: Column, end: Column, operation: str, factor: float | None = None, restored: Column | None = None) -> Column:
    """Token weights with a span's set to zero, multiplied or restored (from the weights that its reserved row would have)."""
    if operation == "remove":
        new = lambda w, i: F.lit(0.0)
    elif operation == "scale":
        new = lambda w, i: w * factor
    elif operation == "inject":
        new = lambda w, i: F.get(restored, (i - start).cast("int"))
    else:
        raise ValueError(f"operation {operation}")
    return F.transform(weights, lambda w, i: F.when((i >= start) & (i < end), new(w, i)).otherwise(w))


def normalized_loss(losses: Column, weights: Column, fixed: Column | None = None) -> Column:
    """Sum of loss times weight over the fixed (original) denominator, or over the weights' sum; 0 where that is 0."""
    total = F.aggregate(F.zip_with(losses, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    below = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w) if fixed is None else fixed
    return F.when(below == 0, 0.0).otherwise(total / below)


def occurrence_loss(losses: Column, weights: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Weighted loss and active tokens of a span: predictions [max(1, start) - 1, max(1, end) - 1)."""
    first, last = F.greatest(start, F.lit(1)) - 1, F.greatest(end, F.lit(1)) - 1
    cut = lambda x: F.slice(x, (first + 1).cast("int"), (last - first).cast("int"))
    both = F.zip_with(cut(losses), cut(weights), lambda x, w: x * w)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.size(F.filter(cut(weights), lambda w: w > 0))


def conflicts(operations: DataFrame) -> DataFrame:
    """occurrence_id, n: occurrences that more than one operation names."""
    return operations.groupBy("occurrence_id").agg(F.count("*").alias("n")).where("n > 1")


def ledger_mismatches(occurrences: DataFrame, batches: DataFrame) -> DataFrame:
    """side, n: spans that only one of the occurrence table and the batches' span lists has."""
    from tracewell.operators.rows import differences

    spans = batches.select("step", "microbatch", F.explode("spans").alias("s")).select("step", "microbatch", "s.*")
    return differences(occurrences.select(*spans.columns), spans)
