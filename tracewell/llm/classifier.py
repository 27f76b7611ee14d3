"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hashed whole form and character
n-grams; a document's is the mean of its words'; a softmax layer gives the class. Training is numpy stochastic
gradient descent over a bounded sample of labelled rows, in one task of an executor. To score, each vector meets
the softmax layer once: a word then has one number, the difference of its two logits.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import slices, trim


BUCKETS = 1 << 17
GRAMS = (3, 4)
#: A feature for each word that repeats the one before it, which an average of words can't show.
AGAIN = b"\x00again"
#: Labelled rows that the model learns from at most, those with the least hash of their id, and bytes of their texts; one that doesn't fit is passed over.
MOST_ROWS, MOST_BYTES = 4000, 64_000_000
#: Words that a worker remembers; beyond it the memory starts afresh, results are the same.
REMEMBERED = 250_000


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, with ends marked."""
    if word == AGAIN:
        return [zlib.crc32(AGAIN) % BUCKETS]
    marked = b"<" + word + b">"
    crc = zlib.crc32
    return [crc(marked) % BUCKETS, *(crc(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1))]


def words_of(text: str) -> list[bytes]:
    words = text.encode().split()
    again = sum(map(bytes.__eq__, words[1:], words))
    return words + [AGAIN] * again


@dataclass
class Model:
    vectors: np.ndarray  # buckets x size
    layer: np.ndarray  # size x 2
    bias: np.ndarray  # 2

    def scalars(self) -> np.ndarray:
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0])

    def projected(self) -> Model:
        """A model that scores alike, of vectors of one number."""
        return Model(self.scalars()[:, None], np.array([[0, 1]], np.float32), self.bias)


def matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, buckets and weights of each text's features; weights sum to 1 a text that has words."""
    bounds, buckets, weights = [0], [], []
    known: dict[bytes, np.ndarray] = {}
    for text in texts:
        words = words_of(text)
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        parts, shares = [], []
        for w, n in counts.items():
            own = known.get(w)
            if own is None:
                own = known[w] = np.array(features(w), np.int32)
            parts.append(own)
            shares.append(np.full(len(own), n / len(words) / len(own), np.float32))
        if parts:
            found, place = np.unique(np.concatenate(parts), return_inverse=True)
            buckets.append(found.astype(np.int32))
            weights.append(np.bincount(place, np.concatenate(shares)).astype(np.float32))
            bounds.append(bounds[-1] + len(found))
        else:
            bounds.append(bounds[-1])
    empty = np.zeros(0)
    return np.array(bounds), np.concatenate(buckets) if buckets else empty.astype(np.int32), np.concatenate(weights) if weights else empty.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, size: int = 8, epochs: int = 6, rate: float = 4.0, batch: int = 16, seed: int = 7) -> Model:
    """Softmax regression on averaged vectors, both learned by gradient descent with a falling rate.

    Without rows, or with one class, the model tells that share alone."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
    layer, n = random.normal(0, 0.1, (size, 2)).astype(np.float32), len(texts)
    share = (float(np.sum(labels)) + 1) / (n + 2)
    bias = np.log(np.array([1 - share, share], np.float32))
    bounds, buckets, weights = matrix(texts)
    steps, step = epochs * -(-n // batch), 0
    for _ in range(epochs):
        order = random.permutation(n)
        for start in range(0, n, batch):
            rows = order[start : start + batch]
            own = [slice(bounds[r], bounds[r + 1]) for r in rows]
            at = np.concatenate([buckets[s] for s in own])
            share_of = np.concatenate([weights[s] for s in own])
            owner = np.repeat(np.arange(len(rows)), [s.stop - s.start for s in own])
            hidden = np.zeros((len(rows), size), np.float32)
            gathered = vectors[at] * share_of[:, None]
            for d in range(size):
                hidden[:, d] = np.bincount(owner, gathered[:, d], len(rows))
            logits = hidden @ layer + bias
            logits -= logits.max(1, keepdims=True)
            wrong = np.exp(logits)
            wrong /= wrong.sum(1, keepdims=True)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            pace = rate * (1 - step / steps)
            back = wrong @ layer.T
            layer -= pace * hidden.T @ wrong / len(rows)
            bias -= 0.1 * pace * wrong.mean(0)
            change = back[owner] * (pace * share_of)[:, None]
            touched, place = np.unique(at, return_inverse=True)
            for d in range(size):
                vectors[touched, d] -= np.bincount(place, change[:, d], len(touched)).astype(np.float32)
            step += 1
    return Model(vectors, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, **options) -> Model:
    """A projected model of labels.quality by the texts of docs, of at most most_rows labelled rows and most_bytes of text; labels other than 0 and 1 are left out.

    Null texts are empty; rows that repeat, and labels that do, are learned each; without rows the model tells half."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    order = (F.xxhash64("doc_id"), "doc_id", "label", "hash")
    share = 3.0 * most_rows / max(1, labels.count())
    while True:
        # least hashes are sought among the least alone, so that tasks don't send most_rows each; among more where those are too few
        near = labels.where(F.xxhash64("doc_id") < int(share * 2**64) - 2**63) if share < 1 else labels
        chosen = near.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order[:3]).limit(most_rows)
        sized = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "hash", F.octet_length("text").alias("n")).orderBy(*order).limit(most_rows).collect()
        if len(sized) == most_rows or share >= 1:
            break
        share *= 4
    left, wanted = most_bytes, []
    for r in sized:
        if r["n"] <= left:
            left -= r["n"]
            wanted.append(r)
    if not wanted:
        return train([], np.zeros(0, np.int64), **options).projected()
    rows = [(r["doc_id"], r["hash"], r["label"]) for r in wanted]
    ids = docs.sparkSession.createDataFrame(sorted({r[:2] for r in rows}), "doc_id long, hash long")

    def run(batches):
        texts = {}
        for batch in batches:
            texts.update(zip(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash")), strict=True), batch.column("text").to_pylist(), strict=True))
        model = train([texts[r[:2]] for r in rows], np.array([r[2] for r in rows], np.int64), **options).projected()
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (model.vectors, model.layer, model.bias)], ["vectors", "layer", "bias"])
        texts.clear()
        trim()

    # one task, since a step needs the one before; the driver gets a number a bucket, and no text
    texts = docs.join(F.broadcast(ids), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).repartition(1)
    vectors, layer, bias = (np.frombuffer(x, np.float32).copy() for x in texts.mapInArrow(run, "vectors binary, layer binary, bias binary").collect()[0])
    return Model(vectors[:, None], layer.reshape(-1, 2), bias)


class Scores(dict):
    """Each word's difference of logits, computed when it is first met."""

    def __init__(self, scalars: np.ndarray, bias: float):
        super().__init__()
        self.scalars, self.bias = scalars, bias

    def __missing__(self, word: bytes) -> float:
        own = features(word)
        value = self[word] = float(self.scalars[own].sum()) / len(own)
        return value

    def score(self, text: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        words = words_of(text)
        logit = self.bias + (sum(map(self.__getitem__, words)) / len(words) if words else 0.0)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))


def score(docs: DataFrame, model: Model, held_out, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row's whole text.

    Null, empty and wordless texts get the model's score of no evidence; rows that repeat score
    alike; a null id stays null; an empty table gives no rows; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.scalars(), float(model.bias[1] - model.bias[0])))  # BUCKETS numbers, whatever the input

    def run(batches):
        memory = Scores(*shared.value)
        for batch in batches:
            scores = [memory.score(t or "") for part in slices(batch) for t in part.column("text").to_pylist()]
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score below threshold, columns as they are; null texts score as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast((model.scalars(), float(model.bias[1] - model.bias[0])))

    def run(batches):
        memory = Scores(*shared.value)
        for batch in batches:
            for part in slices(batch):
                good = [memory.score(t or "") >= threshold for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns))
