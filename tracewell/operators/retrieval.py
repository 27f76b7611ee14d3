"""The best few rows for each of many asked texts, without a table of all pairs.

A batch of rows is scored against all asked texts at once, and a task keeps the best k rows of each; only those leave it and
are ranked. BM25 goes through postings, of asked terms alone: a row tells its length and its terms, which are stored once
and read twice. A block of postings bounds what any of its rows can score, so that most texts pass by most blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewell.functions.tokens import words
from tracewell.sources.shared import kept, spread

#: Rows that meet all asked texts at once, features that a task remembers, numbers of a matrix that goes to every task.
BLOCK, KNOWN, MOST_ASKED = 512, 1 << 18, 8_000_000
UNIT = b"\x1f"


class Hashed:
    """Rows of words as unit vectors of signed hashed words and adjacent pairs."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def _feature(self, f: bytes) -> int:
        """Twice the bucket, and one more where the sign is plus."""
        if f not in self.known:
            if len(self.known) >= KNOWN:
                self.known.clear()
            d = hashlib.sha256(f).digest()
            bucket = int.from_bytes(d[4:8] if self.dim & (self.dim - 1) == 0 and self.dim <= 1 << 32 else d[:8]) % self.dim
            self.known[f] = bucket * 2 + (d[8] & 1)
        return self.known[f]

    def sums(self, listed: pa.ListArray) -> np.ndarray:
        """The signed counts of each row by bucket."""
        n, sizes = len(listed), np.asarray(pc.fill_null(pc.list_value_length(listed), 0), np.int64)
        coded = listed.flatten().dictionary_encode()
        names = [w.encode() for w in coded.dictionary.to_pylist()]
        at, row = np.asarray(coded.indices, np.int64), np.repeat(np.arange(n), sizes)
        same = row[1:] == row[:-1]
        pairs, of = np.unique((at[:-1] * len(names) + at[1:])[same], return_inverse=True)
        one = np.array([self._feature(w) for w in names], np.int64)
        two = np.array([self._feature(names[p // len(names)] + UNIT + names[p % len(names)]) for p in pairs.tolist()], np.int64)
        codes = np.concatenate([one[at], two[of]]) if len(at) else np.zeros(0, np.int64)
        rows = np.concatenate([row, row[:-1][same]]) if len(at) else np.zeros(0, np.int64)
        flat = np.bincount(rows * self.dim + (codes >> 1), weights=(codes & 1) * 2 - 1, minlength=n * self.dim) if len(codes) else np.zeros(n * self.dim)
        return flat.reshape(n, self.dim)

    def units(self, listed: pa.ListArray) -> np.ndarray:
        sums = self.sums(listed)
        return sums / np.maximum(np.sqrt(np.square(sums).sum(1, keepdims=True)), 1e-300)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class Best:
    """Rows with the k greatest scores of each of n asked texts, ties by the smaller key."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.asked, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None
        self.least = np.full(n, -np.inf)

    def add(self, asked: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        """Scores of asked texts with the rows of those keys; below the k-th so far they are passed over."""
        good = score >= self.least[asked]
        asked, score, key = asked[good], score[good], key.take(pa.array(np.flatnonzero(good)))
        if self.key is not None:
            asked, score, key = np.concatenate([self.asked, asked]), np.concatenate([self.score, score]), pa.concat_arrays([self.key, key])
        if not len(asked):
            return
        place = np.empty(len(key), np.int64)
        place[np.asarray(pc.sort_indices(key))] = np.arange(len(key))
        order = np.lexsort((place, -score, asked))
        nth = np.arange(len(order)) - np.searchsorted(asked[order], asked[order])
        chosen = order[nth < self.k]
        self.asked, self.score, self.key = asked[chosen], score[chosen], key.take(pa.array(chosen))
        full = order[nth == self.k - 1]
        self.least[asked[full]] = score[full]


def _ranked(found: DataFrame, asked_key: str, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(asked_key).orderBy(F.col("raw_score").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _named(best: Best, names: pa.Array, key: str, asked_key: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([names.take(pa.array(best.asked)), best.key, pa.array(best.score)], [asked_key, key, "raw_score"])


def hashed_topk(rows: DataFrame, asked: DataFrame, key: str, asked_key: str, k: int, text: str = "text", dim: int = 256, digits: int = 8) -> DataFrame:
    """asked_key, key, raw_score, rank: for each asked text the k rows whose vectors have the greatest dot products with its own, rounded, among those that
    share a bucket with it; ties by key.

    Asked texts go to the tasks in parts of MOST_ASKED numbers, each part in a pass of its own over the rows."""
    own, part = Hashed(dim), MOST_ASKED // dim
    wanted = asked.select(F.col(asked_key), words(F.col(text)).alias("w")).withColumn("__part", F.pmod(F.xxhash64(asked_key), F.lit(-(-asked.count() // part) or 1)))
    kinds = dict(rows.dtypes)[key], dict(asked.dtypes)[asked_key]
    found = None
    for p in (r[0] for r in wanted.select("__part").distinct().collect()):
        few = wanted.where(F.col("__part") == p).select(asked_key, "w").toArrow().combine_chunks()
        names = pa.array(few[asked_key].to_pylist(), to_arrow_type(asked.schema[asked_key].dataType))
        matrix = own.units(pa.array(few["w"].to_pylist(), pa.list_(pa.string()))).T.copy()
        there = (matrix != 0).astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], names=names, matrix=matrix, there=there) -> Iterator[pa.RecordBatch]:
            vectors, best = Hashed(dim), Best(len(names), k)
            for block in blocks(batches):
                dense = vectors.units(block.column("w"))
                score = np.round(dense @ matrix, digits) + 0.0
                x, y = np.nonzero((score >= best.least) & ((dense != 0).astype(np.float32) @ there > 0))
                best.add(y, score[x, y], block.column(key).take(pa.array(x)))
            if best.key is not None:
                yield _named(best, names, key, asked_key)

        one = spread(rows.select(key, text)).select(key, words(F.col(text)).alias("w")).mapInArrow(run, f"`{asked_key}` {kinds[1]}, `{key}` {kinds[0]}, raw_score double")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.sparkSession.createDataFrame([], f"`{asked_key}` {kinds[1]}, `{key}` {kinds[0]}, raw_score double, rank int")
    return _ranked(found, asked_key, key, k)


def postings(rows: DataFrame, terms: pa.Array, key: str, text: str) -> DataFrame:
    """key, len (words; null of a null text), terms (places in terms, ascending) and tf of each row."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 * BLOCK):
            listed = block.column("w")
            sizes = np.asarray(pc.fill_null(pc.list_value_length(listed), 0), np.int64)
            at = np.asarray(pc.fill_null(pc.index_in(listed.flatten(), terms), -1), np.int64)
            row, known = np.repeat(np.arange(len(sizes)), sizes), at >= 0
            cells, tf = np.unique(row[known] * len(terms) + at[known], return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(sizes) + 1) * len(terms)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (cells % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([block.column(key), pa.array(sizes.astype(np.int32), mask=np.asarray(listed.is_null())), *lists], [key, "len", "terms", "tf"])

    return spread(rows.select(key, text)).select(key, words(F.col(text)).alias("w")).mapInArrow(run, f"`{key}` {kind}, len int, terms array<int>, tf array<int>")


def _asked(listed: pa.Table, asked_key: str) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms and keys of asked texts (asked_key, t), and the asked texts of each term, by term, with where each term's start."""
    terms, names = pc.unique(listed["t"]), pc.unique(listed[asked_key])
    term, text_of = np.asarray(pc.index_in(listed["t"], terms), np.int64), np.asarray(pc.index_in(listed[asked_key], names), np.int64)
    order = np.argsort(term, kind="stable")
    return terms, names, text_of[order], np.searchsorted(term[order], np.arange(len(terms) + 1))


def _idf(told: DataFrame, n: int, terms: int) -> np.ndarray:
    """ln(1 + (n - df + 0.5) / (df + 0.5)) of each term of postings."""
    counts = told.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row an asked term
    df = np.zeros(terms)
    df[np.asarray(counts["t"])] = np.asarray(counts["df"])
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


def _weights(block: pa.RecordBatch, idf: np.ndarray, average: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each posting of a block."""
    sizes = np.asarray(pc.list_value_length(block.column("terms")), np.int64)
    at, tf = np.asarray(block.column("terms").flatten(), np.int64), np.asarray(block.column("tf").flatten(), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, at, idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.asarray(pc.fill_null(block.column("len"), 0), np.float64)[row] / average))


def bm25_all(rows: DataFrame, listed: pa.Table, key: str, asked_key: str, kind: str, text: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """asked_key (of type kind), key, raw_score: Okapi BM25 of every row that has a term of an asked text, whose terms are listed (asked_key, t).

    A row is scored where its postings lie, so no pair is shuffled; rows that repeat a key are put together first, as one text."""
    schema = f"`{asked_key}` {kind}, `{key}` {dict(rows.dtypes)[key]}, raw_score double"
    terms, names, askers, starts = _asked(listed, asked_key)
    if not len(terms):
        return rows.sparkSession.createDataFrame([], schema)
    told = kept(postings(rows, terms, key, text), "postings")
    n, average = told.agg(F.count("*"), F.greatest(F.avg("len"), F.lit(1.0))).first()
    again = told.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n")).where("__n > 1")
    if not again.isEmpty():
        same = F.col(key).eqNullSafe(F.col("__k"))
        cells = told.join(again, same, "left_semi").select(key, "len", F.explode(F.arrays_zip("terms", "tf")).alias("c"))
        cells = cells.groupBy(key, "c.terms").agg(F.sum("c.tf").cast("int").alias("tf"), F.max("len").alias("len"))
        merged = cells.groupBy(key).agg(F.max("len").alias("len"), F.collect_list(F.struct("terms", "tf")).alias("c"))  # the terms of one text
        told = told.join(again, same, "left_anti").unionByName(merged.select(key, "len", "c.terms", "c.tf"))
    idf = _idf(told, n, len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 64):
            row, at, weight = _weights(block, idf, average, k1, b)
            each = starts[at + 1] - starts[at]
            cells = np.repeat(row, each) * len(names) + askers[np.repeat(starts[at], each) + _upto(each)]
            if block.num_rows * len(names) <= MOST_ASKED:
                score = np.bincount(cells, weights=np.repeat(weight, each), minlength=block.num_rows * len(names))
                found = np.unique(cells) if not score.all() else np.arange(len(score))
                score = score[found]
            else:
                found, of = np.unique(cells, return_inverse=True)
                score = np.bincount(of, weights=np.repeat(weight, each), minlength=len(found))
            for start in range(0, len(found), 1 << 16):
                part = found[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part % len(names))), block.column(key).take(pa.array(part // len(names))), pa.array(score[start : start + (1 << 16)])], [asked_key, key, "raw_score"])

    return told.mapInArrow(run, schema)


def bm25_topk(rows: DataFrame, asked: DataFrame, key: str, asked_key: str, k: int, text: str = "text", k1: float = 1.5, b: float = 0.75, digits: int = 8) -> DataFrame:
    """asked_key, key, raw_score, rank: for each asked text the k rows of greatest Okapi BM25, rounded, among those with one of its terms; ties by key.

    Each row is split into words once. Asked texts are few: their distinct terms, which go to every task, are refused beyond MOST_ASKED."""
    pairs = asked.select(F.col(asked_key), F.explode(F.array_distinct(words(F.col(text)))).alias("t"))
    if pairs.limit(MOST_ASKED + 1).count() > MOST_ASKED:
        raise ValueError(f"asked texts have more than {MOST_ASKED} terms; ask in parts")
    listed = pairs.toArrow()
    terms, names, askers, starts = _asked(listed, asked_key)
    schema = f"`{asked_key}` {dict(asked.dtypes)[asked_key]}, `{key}` {dict(rows.dtypes)[key]}, raw_score double"
    if not len(terms):
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    told = kept(postings(rows, terms, key, text), "postings")
    n, average = told.agg(F.count("*"), F.greatest(F.avg("len"), F.lit(1.0))).first()
    idf = _idf(told, n, len(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for block in blocks(batches):
            row, at, weight = _weights(block, idf, average, k1, b)
            most = np.zeros(len(terms))  # of each term in this block
            np.maximum.at(most, at, weight)
            seen = np.flatnonzero(most)
            each = starts[seen + 1] - starts[seen]
            asker = askers[np.repeat(starts[seen], each) + _upto(each)]
            bound = np.bincount(asker, weights=np.repeat(most[seen], each), minlength=len(names))
            alive = (bound > 0) & (bound + 10.0**-digits >= best.least)
            each = starts[at + 1] - starts[at]
            asker, where = askers[np.repeat(starts[at], each) + _upto(each)], np.repeat(np.arange(len(at)), each)
            good = alive[asker]
            cells, of = np.unique(row[where[good]] * len(names) + asker[good], return_inverse=True)
            score = np.round(np.bincount(of, weights=weight[where[good]], minlength=len(cells)), digits)
            best.add(cells % len(names), score, block.column(key).take(pa.array(cells // len(names))))
        if best.key is not None:
            yield _named(best, names, key, asked_key)

    return _ranked(told.mapInArrow(run, schema), asked_key, key, k)


def _upto(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
