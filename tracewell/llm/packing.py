"""Vector best-fit packing of token pieces into sequences.

Every piece demands a vector: its tokens, one document, and attention cost (tokens
squared). A sequence has a residual of each. Pieces go by falling size into the
feasible sequence with the best score: the smallest weighted residual norm after
the placement, or the largest weighted dot product of demand and residual.

Pieces of one size are alike, so the plan is made on the histogram of sizes (at most
``max_tokens`` rows, whatever the input) and moves whole groups of equal sequences at
a time. Pieces find their place by their rank among pieces of their size.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.bpe import PATTERN, chunks, tokenizer
from tracewell.llm.common import map_batches, written

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> tiktoken.Encoding:
    """The library's encoder over the tokenizer's own ranks: ids of tokens in order of merging."""
    bpe = tokenizer(path)
    ranks = {b: i for i, b in enumerate(bpe.token_bytes) if b and i not in bpe.special.values()}
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=bpe.special)


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int) -> DataFrame:
    """A row per piece: a document's ids then end_id, cut into max_tokens, the remainder first.

    Null and empty texts are end_id alone; rows that repeat are cut each; a null id stays null; an empty table gives no rows;
    nth tells pieces of a length of one task apart, so ties have an order within a run."""

    def run(batches):
        seen = np.zeros(max_tokens + 1, np.int64)
        part = TaskContext.get().partitionId()
        encoder, end = fast_encoder(tokenizer_path), np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                    data = np.concatenate([np.array(encoder.encode(text, allowed_special="all"), "<u4"), end])
                    first = len(data) % max_tokens or max_tokens
                    for piece, stop in enumerate(range(first, len(data) + 1, max_tokens)):
                        start = max(0, stop - max_tokens) if piece else 0
                        rows.append((doc_id, piece, start, stop - start, zlib.crc32(data[start:stop].tobytes()), part, int(seen[stop - start])))
                        seen[stop - start] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def plan(sizes: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, score: str = "residual_norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Rows (size, first rank, pieces, first sequence, offset, pieces per sequence), by size and rank.

    score: residual_norm (smallest after placement wins) or dot_product (largest wins)."""
    limit = np.array([max_tokens, max_docs, max_cost], float)
    scale = np.array(weights) / limit**2
    states = np.empty((1024, 3))
    groups: list[list[tuple[int, int]]] = []  # of each state: (first sequence, how many)
    index: dict[tuple, int] = {}
    rows, sequences = [], 0

    def room(state, size: int) -> int:
        return int(min(state[0] // size, state[1], state[2] // (size * size)))

    def put(state: tuple, first: int, many: int) -> None:
        nonlocal states
        if state[0] <= 0 or state[1] <= 0 or state[2] <= 0:
            return
        if state not in index:
            index[state] = len(groups)
            groups.append([])
            if len(groups) > len(states):
                states = np.concatenate([states, np.empty_like(states)])
            states[index[state]] = state
        groups[index[state]].append((first, many))

    for size in sorted(sizes, reverse=True):
        if size > max_tokens or size * size > max_cost or max_docs < 1:
            raise ValueError(f"a piece of {size} tokens can't meet the limits")
        demand, left, rank = np.array([size, 1, size * size], float), sizes[size], 0
        while left:
            open_ = np.array([len(g) > 0 for g in groups], bool) if groups else np.zeros(0, bool)
            fits = open_ & (states[: len(groups)] >= demand).all(1)
            at = np.flatnonzero(fits)
            if len(at):
                if score == "dot_product":
                    best = at[np.argmax((states[at] * demand * scale).sum(1))]
                else:
                    best = at[np.argmin(((states[at] - demand) ** 2 * scale).sum(1))]
                state = tuple(int(x) for x in states[best])
                first, many = groups[best].pop()
            else:
                state, first, many = tuple(int(x) for x in limit), sequences, left
            each = min(room(state, size), left)
            used = min(many, left // each)
            placed = used * each
            rows.append((size, rank, placed, first, max_tokens - state[0], each))
            put((state[0] - each * size, state[1] - each, state[2] - each * size * size), first, used)
            if len(at):
                if many > used:
                    groups[best].append((first + used, many - used))
            else:
                sequences = max(sequences, first + used)
            left -= placed
            rank += placed
    out = np.array(rows, np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0, max_docs: int | None = None, max_cost: int | None = None, score: str = "residual_norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    max_docs pieces and max_cost of squared tokens a sequence; by default neither binds before the tokens do
    (max_tokens pieces, max_tokens squared), but what is left of each weighs in the score. Null and empty texts are the one token end_id; rows that repeat are packed each;
    a null id stays null; an empty table gives no rows; other columns aren't read."""
    pieces = written(cut_pieces(docs, tokenizer_path, max_tokens, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    rows = plan(histogram, max_tokens, max_docs or max_tokens, max_cost or max_tokens**2, score, weights)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("part", "length", before.alias("base")), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        starts = np.searchsorted(rows[:, 0], size)  # first row of the size, then the last with rank at most ours
        low, high = starts, np.searchsorted(rows[:, 0], size, side="right") - 1
        while (low < high).any():
            middle = (low + high + 1) // 2
            below = rows[middle, 1] <= rank
            low, high = np.where(below, middle, low), np.where(below, high, middle - 1)
        found = rows[low]
        nth = rank - found[:, 1]
        sequence, offset = found[:, 3] + nth // found[:, 5], found[:, 4] + nth % found[:, 5] * size
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return map_batches(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
