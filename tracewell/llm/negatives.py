"""Hard negatives by integer inner products, searched under an orthogonal rotation.

Vectors are integers. An orthogonal matrix of principal directions, learned from all rows' second moments, turns them so
that leading components hold most of a product. A search accumulates partial products a panel of components at a time; what
remains is at most the product of the residual norms, and rounding at most a slack that the norms bound, so a pair that
can't come within an anchor's windows is discarded early. Only survivors are multiplied as integers, and only those
products decide. Rows are dealt to shards of bounded size; the anchors pass through every shard in batches, and each shard
gives its best few of every anchor, which Spark ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import trim, written

#: Rows of a shard and of a block of it, anchors that meet it at a time, components of a panel, pairs verified at a time.
SHARD, BLOCK, ASKED, PANEL, PAIRS = 1 << 17, 2048, 128, 16, 1 << 15
#: Largest component and squared norm: products and 100 times their bounds stay within 64 bits.
MOST, MOST_SQUARED = 2.0**28, 2.0**56
NONE = 1 << 62
FOUND = "key string, window int, id long, score long"


def quantised(df: DataFrame, scale: int = 256, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, q: floor(scale * x) of each component x of the rows that take part: no null label, null vector, null or infinite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    there = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    whole = lambda x: F.floor(x.cast("double") * scale)
    q = F.transform(vector, lambda x: F.when(F.abs(x.cast("double") * scale) < MOST, whole(x)).otherwise(F.raise_error(F.lit("a component is too large for 64-bit products"))).cast("int"))
    return there.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    n, flat = len(column), np.asarray(column.flatten(), np.int32)
    size = np.asarray(column.value_lengths(), np.int64)
    if (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), np.int32)
    out[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def rotation(rows: DataFrame) -> tuple[np.ndarray | None, int]:
    """The principal directions of all rows' second moments, as columns, the leading first; and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((0, 0)), 0
        for batch in batches:
            if batch.num_rows:
                width = max([len(total), *np.asarray(batch["q"].value_lengths())])
                total = np.pad(total, (0, width - len(total)))
                x = _matrix(batch["q"], width).astype(np.float64)
                total, n = total + x.T @ x, n + batch.num_rows
        i, j = np.triu_indices(len(total))
        yield pa.record_batch([pa.array([*i, -1], pa.int32()), pa.array([*j, -1], pa.int32()), pa.array([*total[i, j], n], pa.float64())], ["i", "j", "s"])
        trim()

    sums = rows.select("q").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    i, j, s = (np.asarray(sums[c]) for c in ("i", "j", "s"))
    n = int(s[i < 0].sum())
    if not n:
        return None, 0
    own = i >= 0
    width = int(i[own].max()) + 1 if own.any() else 0
    moments = np.zeros((width, width))
    moments[i[own], j[own]] = moments[j[own], i[own]] = s[own]
    return np.linalg.eigh(moments)[1][:, ::-1].copy(), n


class Shard:
    """Rows of a shard, in the order of their labels, turned."""

    def __init__(self, batches: list[pa.RecordBatch], turn: np.ndarray):
        label = np.concatenate([np.asarray(b["label"]) for b in batches])
        order = np.argsort(label, kind="stable")
        self.label = label[order]
        self.null = np.concatenate([np.asarray(b["id"].is_null()) for b in batches])[order]
        self.id = np.concatenate([np.asarray(b["id"].fill_null(0)) for b in batches])[order]
        self.whole = np.concatenate([_matrix(b["q"], len(turn)) for b in batches])[order]
        self.turned, self.tails = turned(self.whole, turn)


def panels(width: int) -> list[tuple[int, int]]:
    return [(a, min(width, a + PANEL)) for a in range(0, width, PANEL)] or [(0, 0)]


def turned(whole: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows under the rotation in 32-bit floats, and their norms from each panel's start, rounded up; the last column is zero."""
    parts, tails = np.empty(whole.shape, np.float32), np.zeros((len(whole), len(panels(len(turn))) + 1))
    for a in range(0, len(whole), BLOCK):
        full = whole[a : a + BLOCK].astype(np.float64)
        if (np.square(full).sum(1) > MOST_SQUARED).any():
            raise ValueError("a vector is too long for 64-bit products")
        full = full @ turn
        parts[a : a + BLOCK] = full
        squares = np.square(full)
        for k, (start, _) in enumerate(panels(len(turn))):
            tails[a : a + BLOCK, k] = np.sqrt(squares[:, start:].sum(1))
    return parts, (tails * (1 + 2.0**-20)).astype(np.float32)


class Best:
    """The first k rows in each window of each anchor, as met so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.width = low.shape[1]
        self.least = np.where(low <= high, low, NONE)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, asked: np.ndarray, score: np.ndarray, null: np.ndarray, id: np.ndarray) -> None:
        found = [self.rows]
        for w in range(self.width):
            at = (score >= self.least[asked, w]) & (score <= self.high[asked, w])
            found.append([asked[at] * self.width + w, score[at], null[at].astype(np.int64), id[at]])
        if not any(len(f[0]) for f in found[1:]):
            return
        window, score, null, id = (np.concatenate([f[n] for f in found]) for n in range(4))
        order = np.lexsort((id, null, -score, window))
        window = window[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = place < self.k
        self.rows = [window[kept], *(x[order][kept] for x in (score, null, id))]
        last = place == self.k - 1
        flat = self.least.reshape(-1)
        flat[window[last]] = np.maximum(flat[window[last]], score[order][last])


def search(shard: Shard, rows: slice, anchors: np.ndarray, turn: np.ndarray, best: Best, other: np.ndarray | None) -> None:
    """Adds to best what rows of the shard give the anchors; other: the anchors' labels, whose own rows then don't count."""
    asked, tails = turned(anchors, turn)
    width = len(turn)
    #: Partial products in 32-bit floats err by less than this share of the norms' product; the turn's own error is far less.
    slack = np.float32((width + 16) * 2.0**-23)
    for a in range(rows.start, rows.stop, BLOCK):
        at = np.arange(a, min(rows.stop, a + BLOCK))
        least = np.nextafter(best.least.min(1).astype(np.float32), np.float32(-np.inf))
        most = np.nextafter(np.where(best.least < NONE, best.high, -NONE).max(1).astype(np.float32), np.float32(np.inf))
        partial, alive = np.zeros((len(at), len(anchors)), np.float32), None
        there = least < NONE
        alive = np.broadcast_to(there, partial.shape) if other is None else there & (shard.label[at][:, None] != other)
        for k, (start, stop) in enumerate(panels(width)):
            partial += shard.turned[at, start:stop] @ asked[:, start:stop].T
            bound = np.outer(shard.tails[at, k + 1], tails[:, k + 1]) + slack * np.outer(shard.tails[at, 0], tails[:, 0])
            alive = alive & (partial + bound >= least) & (partial - bound <= most)
            some = alive.any(1)
            if some.sum() < len(at) / 2:
                at, partial, alive, bound = at[some], partial[some], alive[some], bound[some]
            if not len(at):
                break
        if len(at):
            _verify(shard, at, anchors, partial, bound, alive, best)


def _verify(shard: Shard, at: np.ndarray, anchors: np.ndarray, partial: np.ndarray, bound: np.ndarray, alive: np.ndarray, best: Best) -> None:
    """Adds the integer products of the pairs that are alive, largest first, so that each part shortens the rest."""
    i, j = np.nonzero(alive)
    order = np.argsort(-partial[i, j], kind="stable")
    i, j, upper = i[order], j[order], (partial + bound)[i[order], j[order]]
    for a in range(0, len(i), PAIRS):
        x, y, u = i[a : a + PAIRS], j[a : a + PAIRS], upper[a : a + PAIRS]
        if a:
            again = u >= np.nextafter(best.least.min(1).astype(np.float32), np.float32(-np.inf))[y]
            x, y = x[again], y[again]
        rows = at[x]
        score = np.einsum("nd,nd->n", shard.whole[rows].astype(np.int64), anchors[y].astype(np.int64))
        best.add(y, score, shard.null[rows], shard.id[rows])


def _windows(scores: pa.ListArray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of low * p <= 100 * score <= high * p for each p of each anchor; empty ones fill the rest."""
    each = scores.to_pylist()
    p = np.zeros((len(each), max([1, *map(len, each)])), np.int64)
    there = np.zeros(p.shape, bool)
    for n, s in enumerate(each):
        p[n, : len(s)], there[n, : len(s)] = s, True
    return np.where(there, -(-low * p // 100), 1), np.where(there, high * p // 100, 0)


def candidates(rows: DataFrame, asked: DataFrame, turn: np.ndarray, shards: int, k: int, between: tuple[int, int] | None) -> DataFrame:
    """FOUND: of each shard the first k rows of each asked anchor (key, label, q, scores), by score, then id.

    between None: rows of the anchor's label, in one window; else rows of other labels in a window for each of scores."""

    def answer(shard: Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label = np.asarray(batch["label"])
        batch = batch.take(pa.array(np.argsort(label, kind="stable")))
        label, whole = np.asarray(batch["label"]), _matrix(batch["q"], len(turn))
        own = [(m, m + len(label[label == x])) for m, x in zip(*np.unique(label, return_index=True)[::-1], strict=True)] if between is None else [(0, len(label))]
        for first, last in ((a, min(b, a + ASKED)) for m, b in own for a in range(m, b, ASKED)):
            part = batch.slice(first, last - first)
            if between is None:
                low, high = np.full((last - first, 1), -NONE + 1), np.full((last - first, 1), NONE - 1)
                rows = slice(*np.searchsorted(shard.label, [label[first], label[first] + 1]))
            else:
                (low, high), rows = _windows(part["scores"], *between), slice(0, len(shard.label))
            best = Best(low, high, k)
            search(shard, rows, whole[first:last], turn, best, None if between is None else label[first:last])
            window, score, null, id = best.rows
            keys = part["key"].take(pa.array(window // best.width))
            yield pa.RecordBatch.from_arrays([keys, pa.array(window % best.width, pa.int32()), pa.array(id, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], ["key", "window", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            number, side = np.asarray(batch["shard"]), np.asarray(batch["side"])
            edges = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(side) != 0)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if number[a] != now:
                    now, held, shard = number[a], [], None
                if side[a] == 0:
                    held.append(batch.slice(a, b - a).select(["id", "label", "q"]))
                elif held or shard is not None:
                    if shard is None:
                        shard, held = Shard(held, turn), []
                    yield from answer(shard, batch.slice(a, b - a))
        trim()

    dealt = rows.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")).withColumn("side", F.lit(0))
    dealt = dealt.withColumn("key", F.lit(None).cast("string")).withColumn("scores", F.lit(None).cast("array<long>"))
    sent = asked.select(F.lit(None).cast("long").alias("id"), "label", "q", "key", "scores").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("side", F.lit(1))
    return dealt.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "side").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 10, between: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor and positive among rows (id, label, q).

    A score is the inner product with the anchor; higher ones come first, ties by the smaller id, null ids last. An anchor's positives are its first
    n_positives other rows of its label; a positive's negatives the first n_negatives rows of other labels with
    between[0] * positive_score <= 100 * negative_score <= between[1] * positive_score. Rows that repeat are rows each: one of several equal
    ones is the anchor, the rest others, and each is asked. Vectors shorter than the longest count as ending in zeros; a component from
    2 ** 28 or a squared norm above 2 ** 56 is refused, since products must fit 64 bits; an empty table gives no rows."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    turn, n = rotation(rows)
    if turn is None:
        return rows.sparkSession.createDataFrame([], schema)
    shards = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // SHARD))
    own = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    key = F.sha2(F.to_json(F.struct("id", "label", "q")), 256)
    anchors = written(rows.where(anchor).groupBy("id", "label", "q").agg(F.count("*").alias("copies")).select("*", key.alias("key"), own.alias("own"), F.array().cast("array<long>").alias("scores")), "negatives-anchors")
    near = _ranked(candidates(rows, anchors, turn, shards, n_positives + 1, None), n_positives + 1).join(anchors.select("key", F.col("id").alias("anchor_id"), "own", "copies"), "key")
    itself = F.min(F.when((F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(Window.partitionBy("key"))
    place = F.col("rank") - (F.col("rank") > F.coalesce(F.col("itself"), F.lit(n_positives + 2))).cast("int")
    others = near.withColumn("itself", itself).where(~F.col("rank").eqNullSafe(F.col("itself"))).withColumn("place", place).where(F.col("place") <= n_positives)
    positives = written(others.select("key", "anchor_id", "copies", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    scores = F.transform(F.sort_array(F.collect_list(F.struct("window", "positive_score"))), lambda x: x["positive_score"])
    asked = written(anchors.drop("scores").join(positives.groupBy("key").agg(scores.alias("scores")), "key").select("key", "label", "q", "scores"), "negatives-asked")
    found = _ranked(candidates(rows, asked, turn, shards, n_negatives, between), n_negatives)
    out = found.join(positives, ["key", "window"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
