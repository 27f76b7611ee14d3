"""Hierarchical Pitman-Yor language model over word pairs.

Restaurants: one for each context word, all with one parent, whose own parent is uniform. A
table in a child sends a customer to the parent. A round of Gibbs sampling draws, for each word of each
restaurant, its number of tables given all other tables of the round before and the parent; then the parent's
given all tables. Draws are exact from generalised Stirling numbers where a word has few customers, and
Metropolis steps with their saddle-point form where it has many. Every draw takes its random numbers from a
hash of restaurant, word and round, so it doesn't matter where it is made. Predictive probabilities
are averaged over rounds, each with its tables and its parent.

Pairs are dealt into shards by context; a common context is dealt by its next word too, and a common pair by its
documents. Shards hear of what they share with others by joins: the parent's tables of their words, the
customers and tables of whole contexts, the customers of whole pairs. Nothing grows with the vocabulary on the driver.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bucketed, held_out, release, slices, trim, written

START, END = 0, 1  # hashes of the two marks; of V words two share one with a chance of V**2 / 2**65
SHARD_BYTES = 10_500_000
#: Shards of a pack, which a task takes one after another, summing each document's parts; buckets of the table of shards, at most.
TOGETHER, MOST_BUCKETS = 2, 20_000
#: Documents whose sums are put together in one task, and words of shards whose customers are seated in one.
RANGE, WORDS = 20_000, 300_000
#: A context or pair whose load is more than this share of a shard's is dealt to several, so there are at most shards / SPLIT of them; every task
#: knows them, so beyond MOST_COMMON of a kind only those are dealt that have more than a MOST_COMMON-th of all tokens. They are
#: found in a sample of about so many tokens a shard, which shapes the shards and no score.
SPLIT, SAMPLED, MOST_COMMON = 0.25, 1600, 1_000_000
#: Tokens gathered before a map task deals them out.
DEAL = 1_500_000
#: Customers of a word up to which its tables are drawn exactly.
EXACT = 48
STRENGTH, ROOT_STRENGTH, ROOT_DISCOUNT = 10.0, 1.0, 0.1
#: Rounds before those that are averaged, and those; Metropolis steps of a draw.
BURN_IN, SAMPLES, METROPOLIS = 1, 2, 3


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 0 and more in the least type that holds them, sorted ones as differences, byte by byte, compressed."""
    out = []
    for a in arrays:
        rising = len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.concatenate([a[:1], a[1:] - a[:-1]])
        top = int(a.max()) if len(a) else 0
        a = a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
        out.append(struct.pack("<BBq", a.dtype.itemsize, rising, len(a)) + a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(data):
        width, rising, n = struct.unpack_from("<BBq", data, at)
        a = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at + 10).reshape(width, n).T).view(f"<u{width}").reshape(n)
        out.append(np.cumsum(a, dtype=np.uint64 if width == 8 else np.int64) if rising else a)
        at += 10 + n * width
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def uniform(u: np.ndarray, w: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1) for each restaurant and word, another for each turn."""
    h = mixed(u * np.uint64(0x9E3779B97F4A7C15) + mixed(w + np.uint64((turn * 0xD1342543DE82EF95) % (1 << 64))))
    return ((mixed(h) >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


class Codes(dict):
    """A number for each word, in order of appearance; 0 and 1 are the marks."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = [b"", b""]
        self[b" "] = END  # no word has a blank

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.words)
        self.words.append(word)
        return self[word]


class Common(NamedTuple):
    """Common contexts and pairs (hashes, ascending) and into how many parts they are dealt."""

    contexts: np.ndarray
    context_parts: np.ndarray
    pairs: np.ndarray
    pair_parts: np.ndarray

    @staticmethod
    def parts_of(known: np.ndarray, parts: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.ones(len(asked), np.uint64)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return np.where(known[at] == asked, parts[at], np.uint64(1))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(u * np.uint64(0x9E3779B97F4A7C15) + w)


def common(docs: DataFrame, size: int, shards: int) -> Common:
    """What a sample of texts, counted in the cluster, tells to be common; only that comes to the driver."""

    def run(batches):
        codes: dict[bytes, int] = {}
        for batch in batches:
            found = []
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    words = text.encode().lower().split()
                    for w in words:
                        if w not in codes:
                            codes[w] = xxhash.xxh3_64_intdigest(w)
                    h = np.array([START, *(codes[w] for w in words), END], np.uint64)
                    found += [(h[:-1], pair_hash(h[:-1], h[1:]))]
                codes.clear()
            for kind in (0, 1):
                hashes, n = np.unique(np.concatenate([f[kind] for f in found]) if found else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array(n)], ["kind", "h", "n"])

    none = np.zeros(0, np.uint64)
    if shards == 1:
        return Common(none, none, none, none)
    every = max(1, size // (8 * SAMPLED * shards))
    counts = docs.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(every)) == 0).select("text").mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-sample")
    total = counts.where("kind = 0").agg(F.sum("n")).first()[0] or 1
    many = counts.where(F.col("n") > max(8, SPLIT * total / shards, total / MOST_COMMON)).toArrow()  # at most MOST_COMMON of a kind: their counts sum to total
    release(counts)
    of, hashes, n = np.asarray(many["kind"], np.int64), np.asarray(many["h"], np.int64).view(np.uint64), np.asarray(many["n"], np.float64)
    out = []
    for kind in (0, 1):
        own = np.flatnonzero(of == kind)
        own = own[np.argsort(hashes[own])]
        out += [hashes[own], np.ceil(n[own] * shards / total / SPLIT).astype(np.uint64)]
    return Common(*out)


def deal(docs: DataFrame, shards: int, known: Common) -> DataFrame:
    """shard, blob: (words' hashes, documents' keys, train flags, contexts, next words, documents, counts) of its pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most MOST_COMMON contexts and pairs

    def shard_of(u: np.ndarray, w: np.ndarray, key: np.ndarray) -> np.ndarray:
        k = shared.value
        place = mixed(u) + mixed(w) % Common.parts_of(k.contexts, k.context_parts, u)
        if len(k.pairs):
            place = place + mixed(key) % Common.parts_of(k.pairs, k.pair_parts, pair_hash(u, w))
        return (place % np.uint64(shards)).astype(np.int64)

    def flush(codes: Codes, tokens: list[np.ndarray], lengths: list[int], keys: list[int], train: list[bool]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        hashes = np.array([START, END, *map(digest, codes.words[2:])], np.uint64)
        w = np.concatenate(tokens)
        tokens.clear()
        n_docs, n_words = len(keys), len(hashes)
        triple = np.empty(len(w), np.int64)  # context, word, document in one number
        triple[0], triple[1:] = START, w[:-1]
        triple[triple == END] = START
        triple *= n_words
        triple += w
        triple *= n_docs
        triple += np.repeat(np.arange(n_docs, dtype=np.int32), lengths)
        triple.sort()
        first = np.flatnonzero(np.concatenate([[True], triple[1:] != triple[:-1]]))
        count = np.diff(first, append=len(triple)).astype(np.int32)
        triple = triple[first]
        d = (triple % n_docs).astype(np.int32)
        triple //= n_docs
        w, u = (triple % n_words).astype(np.int32), (triple // n_words).astype(np.int32)
        del triple, first
        all_keys, all_train = np.array(keys, np.int64), np.array(train, np.uint8)
        shard = shard_of(hashes[u], hashes[w], all_keys.view(np.uint64)[d]).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        u, w, d, count, shard = u[order], w[order], d[order], count[order], shard[order]
        del order
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            words, place = np.unique(np.concatenate([u[a:b], w[a:b]]), return_inverse=True)
            own, dd = np.unique(d[a:b], return_inverse=True)
            blob = pack(hashes[words], all_keys[own].view(np.uint64), all_train[own], place[: b - a], place[b - a :], dd, count[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    def run(batches):
        codes, tokens, lengths, keys, train, total = Codes(), [], [], [], [], 0
        for batch in batches:
            for key, learn, text in (row for part in slices(batch) for row in zip(*(part.column(c).to_pylist() for c in ("key", "train", "text")), strict=True)):
                words = text.encode().lower().split()
                words.append(b" ")
                tokens.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                lengths.append(len(words))
                keys.append(key)
                train.append(learn)
                total += len(words)
                if total >= DEAL:
                    yield from flush(codes, tokens, lengths, keys, train)
                    codes, tokens, lengths, keys, train, total = Codes(), [], [], [], [], 0
                    trim()
        if total:
            yield from flush(codes, tokens, lengths, keys, train)
        del codes
        trim()

    return docs.select("key", "train", "text").mapInArrow(run, "shard int, blob binary")


STATE = "pack int, shard int, pairs binary, uses binary, words long, train_tokens long, known_words long, ends long, once long, twice long, contexts array<struct<u:long,customers:long,kinds:long>>, common array<struct<u:long,w:long,customers:long>>"


def gather(dealt: DataFrame, known: Common) -> DataFrame:
    """A row per shard. pairs: (words, contexts, next words, training counts, whether they are common), by context;
    uses: (documents' keys, uses of each pair, documents, counts). contexts and common: its parts of what several shards may have."""
    shared = dealt.sparkSession.sparkContext.broadcast(known)

    def run(part: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in part.column("blob").to_pylist()]
        words = np.unique(np.concatenate([b[0] for b in blobs]))
        offset = np.cumsum([0, *(len(b[1]) for b in blobs)])
        keys, train = np.concatenate([b[1] for b in blobs]), np.concatenate([b[2] for b in blobs]).astype(bool)
        pair, docs, counts = [], [], []
        for b, first in zip(blobs, offset[:-1].tolist(), strict=True):
            place = np.searchsorted(words, b[0])
            pair.append(place[b[3]] * len(words) + place[b[4]])
            docs.append((b[5].astype(np.int64) + first).astype(np.uint32))
            counts.append(b[6].astype(np.uint32))
        del blobs, b
        pair, docs, counts = np.concatenate(pair), np.concatenate(docs), np.concatenate(counts)
        order = np.argsort(pair)
        pair, docs, counts = pair[order], docs[order], counts[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        u, w = np.divmod(pair[first], len(words))
        uses = np.diff(first, append=len(pair))
        del pair
        learned = np.add.reduceat(np.where(train[docs], counts, np.uint32(0)), first, dtype=np.int64)
        k = shared.value
        is_common = np.isin(pair_hash(words[u], words[w]), k.pairs)
        alone = np.where(is_common, 0, learned)
        edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        customers, kinds = np.add.reduceat(learned, edge), np.add.reduceat((alone > 0).astype(np.int64), edge)
        context = words[u[edge]]
        parted = np.isin(context, k.contexts)  # a common pair's context is common too
        signed = lambda h: int(np.int64(h.view(np.int64)))
        row = {
            "pack": part.column("shard")[0].as_py() // TOGETHER, "shard": part.column("shard")[0].as_py(), "pairs": pack(words, u, w, learned, is_common.astype(np.uint8)), "uses": pack(keys, uses, docs, counts), "words": len(words), "train_tokens": int(learned.sum()),
            "known_words": int(((customers > 0) & ~parted & (context != START)).sum()), "ends": int(learned[words[w] == END].sum()), "once": int((alone == 1).sum()), "twice": int((alone == 2).sum()),
            "contexts": [{"u": signed(h), "customers": int(c), "kinds": int(n)} for h, c, n in zip(context[parted], customers[parted], kinds[parted], strict=True)],
            "common": [{"u": signed(words[u[i]]), "w": signed(words[w[i]]), "customers": int(learned[i])} for i in np.flatnonzero(is_common)],
        }
        numbers = lambda *names: pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        kind = pa.schema([("pack", pa.int32()), ("shard", pa.int32()), ("pairs", pa.binary()), ("uses", pa.binary()), *((n, pa.int64()) for n in ("words", "train_tokens", "known_words", "ends", "once", "twice")), ("contexts", numbers("u", "customers", "kinds")), ("common", numbers("u", "w", "customers"))])
        return pa.Table.from_pylist([row], kind)

    return dealt.groupBy("shard").applyInArrow(run, STATE)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def log_stirling(discount: float, most: int) -> np.ndarray:
    """log of the generalised Stirling number of each customers and tables up to most: S(c+1,t) = S(c,t-1) + (c - t d) S(c,t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)), -np.inf) + out[c, 1 : c + 2]
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], stay)
    return out


def saddle_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers: c!/(t! d^t) [z^c] (1 - (1-z)^d)^t at its saddle point; x is -log(1-z)."""
    t = np.minimum(t, c - 0.5)  # as many tables as customers have their saddle at zero
    low, high = np.full(len(c), -30.0), np.full(len(c), 6.0)  # of log x
    goal = np.log(c / t)
    for _ in range(32):
        at = (low + high) / 2
        x = np.exp(at)
        steep = np.log(d) + np.log(-np.expm1(-x)) + (1 - d) * x - np.log(-np.expm1(-d * x))
        below = steep < goal
        low, high = np.where(below, at, low), np.where(below, high, at)
    x = np.exp((low + high) / 2)
    z = -np.expm1(-x)
    spread = np.maximum(c * (1 + (1 - d) * z * np.exp(x) - c / t), 1e-9)
    return log_gamma(c + 1.0) - log_gamma(t + 1.0) - t * np.log(d) + t * np.log(-np.expm1(-d * x)) - c * np.log(z) - 0.5 * np.log(2 * math.pi * spread)


def draw_tables(c: np.ndarray, t: np.ndarray, others: np.ndarray, prior: np.ndarray, strength: float, discount: float, stirling: np.ndarray, random: Callable[[int], np.ndarray]) -> np.ndarray:
    """New numbers of tables of words with c customers, given their restaurants' other tables and the parent's probability.

    random: uniform numbers for the words, others for each turn."""
    t = t.copy()
    few = np.flatnonzero((c > 1) & (c < len(stirling)))
    order = few[np.argsort(c[few], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(c[order]) > 0, [True]])) if len(order) else np.zeros(1, np.int64)
    told = random(0)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        for start in range(a, b, 100_000):
            rows = order[start : min(b, start + 100_000)]
            n = int(c[rows[0]])
            grow = np.cumsum(np.log((strength + discount * (others[rows, None] + np.arange(n))) * prior[rows, None]), axis=1) + stirling[n, 1 : n + 1]
            weight = np.cumsum(np.exp(grow - grow.max(1, keepdims=True)), axis=1)
            t[rows] = 1 + (weight < told[rows][:, None] * weight[:, -1:]).sum(1)
    many = np.flatnonzero(c >= len(stirling))
    if len(many):
        cc, base, rate = c[many].astype(float), strength / discount + others[many], np.log(prior[many] * discount)
        weight = lambda k: saddle_stirling(cc, k, discount) + log_gamma(base + k) + k * rate
        a = (strength + discount * others[many]) * prior[many]
        now = np.where(t[many] > 1, t[many], np.clip(np.rint(a * np.log1p(cc / np.maximum(a, 1e-9))), 1, cc)).astype(float)
        level = weight(now)
        stay = np.log1p(-1 / (1 + np.sqrt(cc) / 4))  # steps are geometric, of one at least
        for turn in range(METROPOLIS):
            step = 1 + np.floor(np.log(random(3 * turn + 1)[many]) / stay)
            new = now + np.where(random(3 * turn + 2)[many] < 0.5, step, -step)
            inside = (new >= 1) & (new <= cc)
            new = np.where(inside, new, now)
            value = weight(new)
            take = inside & (np.log(random(3 * turn + 3)[many]) < value - level)
            now, level = np.where(take, new, now), np.where(take, value, level)
        t[many] = now.astype(np.int64)
    return t


#: Kinds of rows that shards get: words with their customers and tables in the parent (packed), a parted context's customers and tables, a
#: common pair's customers and whether this shard sends its tables, a shard's own tables (packed). Turn: the round that they are of.
WORD, CONTEXT, PAIR, TABLES = range(4)
FACTS = "pack int, shard int, kind int, turn int, a long, b long, x long, y long, tables binary"


class Facts:
    """What a pack's shards get from elsewhere, and the parent's numbers of each round: (customers, tables)."""

    def __init__(self, rows: pa.Table, parent: dict[int, tuple[float, float]], vocabulary: int):
        self.parent, self.vocabulary, self._known = parent, vocabulary, {}
        whole = lambda c: pc.fill_null(rows.column(c), -1).to_numpy()
        kind, turn = whole("kind"), whole("turn")
        self._rows, self._shard = {}, whole("shard")
        for k in np.unique(kind):
            for n in np.unique(turn[kind == k]):
                self._rows[int(k), int(n)] = np.flatnonzero((kind == k) & (turn == n))
        self._columns = {c: whole(c) for c in ("a", "b", "x", "y")}
        self._tables = rows.column("tables")

    def numbers(self, kind: int, turn: int, *columns: str) -> list[np.ndarray]:
        rows = self._rows.get((kind, turn), np.zeros(0, np.int64))
        return [self._columns[c][rows] for c in columns]

    def pairs(self, shard: int) -> dict[tuple[int, int], tuple[int, int]]:
        """Customers of common pairs of a shard, and whether it sends their tables."""
        rows = self._rows.get((PAIR, 0), np.zeros(0, np.int64))
        a, b, x, y = (self._columns[c][rows[self._shard[rows] == shard]].tolist() for c in ("a", "b", "x", "y"))
        return dict(zip(zip(a, b, strict=True), zip(x, y, strict=True), strict=True))

    def tables(self, shard: int, turn: int) -> np.ndarray:
        rows = self._rows[TABLES, turn]
        return unpack(self._tables[int(rows[self._shard[rows] == shard][0])].as_py())[0].astype(np.int64)

    def _seated(self, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The pack's words, ascending, and what their own customers add to their probabilities."""
        if turn not in self._known:
            parts = [unpack(self._tables[int(i)].as_py()) for i in self._rows.get((WORD, turn), ())]
            w = np.concatenate([np.zeros(0, np.uint64), *(p[0].astype(np.uint64) for p in parts)])
            own = np.concatenate([np.zeros(0), *(p[1].astype(float) - ROOT_DISCOUNT * p[2] for p in parts)])
            order = np.argsort(w)
            self._known[turn] = w[order], own[order]
        return self._known[turn]

    def prior(self, words: np.ndarray, turn: int) -> np.ndarray:
        """The parent's probability of each word, as of a round."""
        customers, tables = self.parent[turn]
        w, own = self._seated(turn)
        out = np.full(len(words), (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (self.vocabulary + 1))
        if len(w):
            at = np.minimum(np.searchsorted(w, words), len(w) - 1)
            out += np.where(w[at] == words, own[at], 0.0)
        return out / (ROOT_STRENGTH + customers)


class Restaurants:
    """The restaurants of a shard, or parts of them, with what it was told of the whole."""

    def __init__(self, shard: int, pairs: bytes, facts: Facts, strength: float, discount: float):
        self.words, u, w, c, shared = unpack(pairs)
        self.u, self.w, self.c = u.astype(np.int32), w.astype(np.int32), c.astype(np.int64)
        self.strength, self.discount, self.facts = strength, discount, facts
        self.edge = np.flatnonzero(np.concatenate([[True], self.u[1:] != self.u[:-1]]))
        self.of = np.repeat(np.arange(len(self.edge), dtype=np.int32), np.diff(self.edge, append=len(self.u)))
        self.context = self.words[self.u[self.edge]]
        self.customers = np.add.reduceat(self.c, self.edge)
        #: whether the shard sends a pair's tables on: of a common pair one shard does
        self.mine = np.ones(len(self.c), bool)
        at = np.flatnonzero(shared == 1)
        if len(at):
            whole = facts.pairs(shard)
            for i in at.tolist():
                self.c[i], self.mine[i] = whole[int(self.words[self.u[i]].view(np.int64)), int(self.words[self.w[i]].view(np.int64))]
        self.stirling = log_stirling(discount, EXACT)

    def _parted(self, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of parted contexts, and their customers and tables as of a round."""
        u, customers, tables = self.facts.numbers(CONTEXT, turn, "a", "x", "y")
        order = np.argsort(u.view(np.uint64))
        known = u.view(np.uint64)[order]
        at = np.minimum(np.searchsorted(known, self.context), max(0, len(known) - 1))
        here = np.flatnonzero(known[at] == self.context) if len(known) else np.zeros(0, np.int64)
        return here, customers[order][at[here]], tables[order][at[here]]

    def totals(self, t: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each whole restaurant, as of a round in which pairs here have t tables."""
        customers, tables = self.customers.copy(), np.add.reduceat(t, self.edge)
        here, c, n = self._parted(turn)
        customers[here], tables[here] = c, n
        return customers, tables

    def first(self) -> np.ndarray:
        return (self.c > 0).astype(np.int64)

    def sweep(self, t: np.ndarray, turn: int, seed: int) -> np.ndarray:
        """Tables of the round after turn."""
        out = t.copy()
        seated = np.flatnonzero(self.c > 0)
        _, tables = self.totals(t, turn)
        u, w = self.words[self.u[seated]], self.words[self.w[seated]]
        prior = self.facts.prior(self.words, turn)[self.w[seated]]
        random = lambda k: uniform(u, w, seed + 16 * (turn + 1) + k)
        out[seated] = draw_tables(self.c[seated], t[seated], tables[self.of[seated]] - t[seated], prior, self.strength, self.discount, self.stirling, random)
        return out

    def predictive(self, t: np.ndarray, turn: int) -> np.ndarray:
        customers, tables = self.totals(t, turn)
        prior = self.facts.prior(self.words, turn)[self.w]
        return (self.c - self.discount * t + (self.strength + self.discount * tables[self.of]) * prior) / (self.strength + customers[self.of])

    def told(self, t: np.ndarray, parted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kind, hashes and tables: those that go to the parent by word, and those of parted contexts."""
        sent = np.where(self.mine, t, 0)
        used = np.unique(self.w)
        yield WORD, self.words[used], np.bincount(self.w, sent, len(self.words)).astype(np.int64)[used]
        here = np.flatnonzero(np.isin(self.context, parted))
        yield CONTEXT, self.context[here], np.add.reduceat(sent, self.edge)[here]


def _shards(part: pa.Table) -> Iterator[tuple[int, bytes]]:
    for i in range(part.num_rows):
        yield part.column("shard")[i].as_py(), part.column("pairs")[i].as_py()


class Model:
    """A fitted model: written shards, tables and parents; the driver knows a few numbers and what is common."""

    def __init__(self, docs: DataFrame, strength: float = STRENGTH, samples: int = SAMPLES, burn_in: int = BURN_IN, seed: int = 11, shard_bytes: int | None = None):
        """docs: key, train, text (no nulls)."""
        self.samples, self.burn_in, self.seed, self.strength = samples, burn_in, seed * 1_000_003, strength
        size, rows = (x or 0 for x in docs.agg(F.sum(F.octet_length("text") + 1), F.count("*")).first())
        self.shards = max(1, math.ceil(size / (shard_bytes or SHARD_BYTES)))
        self.common = common(docs, size, self.shards)
        self.state = bucketed(gather(deal(docs, self.shards, self.common), self.common), "lm-shards", "pack", min(4 * math.ceil(self.shards / TOGETHER), MOST_BUCKETS))  # of more buckets than packs fewer hold two
        self.ranges = max(1, rows // RANGE)
        self.parent: dict[int, tuple[float, float]] = {}
        self._wholes()
        facts, last, old = self.static, None, ()
        for turn in range(burn_in + samples + 1):
            told = self._round(facts, turn)
            words = self._parent(told, last, turn)
            contexts = self._contexts(told, turn)
            own = told.where(F.col("kind") == TABLES)
            now = words.unionByName(contexts).unionByName(own.select(*(c.split()[0] for c in FACTS.split(", "))))
            facts = self.static.unionByName(now)
            if turn > burn_in:
                self.kept = now if turn == burn_in + 1 else self.kept.unionByName(now)
            if turn <= burn_in + 1:  # of the round before no more is needed
                release(*old)
            old, last = (told, self.roots, contexts), self.roots

    def _wholes(self) -> None:
        """Whole contexts and pairs of those that are parted, and what follows from them: counts, discount, the facts that no round changes."""
        sums = self.state.agg(*(F.sum(n).alias(n) for n in ("words", "train_tokens", "known_words", "ends", "once", "twice"))).first()
        self.word_ranges = (sums["words"] or 0) // WORDS + 1
        pairs = self.state.select("pack", "shard", F.explode("common").alias("h")).select("pack", "shard", "h.*")
        whole = pairs.groupBy("u", "w").agg(F.sum("customers").alias("c"), F.min("shard").alias("sender"))
        self.pairs = written(whole, "lm-pairs")
        contexts = self.state.select("pack", F.explode("contexts").alias("h")).select("pack", "h.*")
        extra = self.pairs.where("c > 0").groupBy("u").agg(F.count("*").alias("more"))
        whole = contexts.groupBy("u").agg(F.sum("customers").alias("c"), F.sum("kinds").alias("kinds")).join(extra, "u", "left").select("u", "c", (F.col("kinds") + F.coalesce("more", F.lit(0))).alias("kinds"))
        self.contexts = written(whole, "lm-contexts")
        self.members = written(contexts.select("pack", "u").distinct(), "lm-members")
        none = lambda kind: F.lit(None).cast(kind)
        told = pairs.join(self.pairs, ["u", "w"]).select("pack", "shard", F.lit(PAIR).alias("kind"), F.lit(0).alias("turn"), F.col("u").alias("a"), F.col("w").alias("b"), F.col("c").alias("x"), (F.col("shard") == F.col("sender")).cast("long").alias("y"), none("binary").alias("tables"))
        self.static = written(told, "lm-facts")
        common_pairs = self.pairs.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        parted = self.contexts.agg(F.count_if((F.col("c") > 0) & (F.col("u") != START))).first()[0]
        once, twice = (sums["once"] or 0) + common_pairs[0], (sums["twice"] or 0) + common_pairs[1]
        self.train_tokens, self.ends = sums["train_tokens"] or 0, sums["ends"] or 0
        self.vocabulary = (sums["known_words"] or 0) + parted + (self.ends > 0)
        self.discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))

    def _round(self, facts: DataFrame, turn: int) -> DataFrame:
        """FACTS of a round: tables by word and by parted context for others, and the shard's own; one for each kind of pair at first."""
        strength, discount, seed, parent, vocabulary, ranges = self.strength, self.discount, self.seed, dict(self.parent), self.vocabulary, self.word_ranges
        shared = self.state.sparkSession.sparkContext.broadcast(self.common.contexts)

        def run(part: pa.Table, own: pa.Table) -> pa.Table:
            told, out = Facts(own, parent, vocabulary), []
            sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORD: [], CONTEXT: []}
            for shard, pairs in _shards(part):
                r = Restaurants(shard, pairs, told, strength, discount)
                t = r.sweep(told.tables(shard, turn - 1), turn - 1, seed) if turn else r.first()
                for kind, a, x in r.told(t, shared.value):
                    sums[kind].append((a, x))
                out.append({"pack": shard // TOGETHER, "shard": shard, "kind": TABLES, "turn": turn, "tables": pack(t)})
                del r, t
                trim()
            own_pack = part.column("pack")[0].as_py()
            for kind, parts in sums.items():
                a, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
                x = np.bincount(place, np.concatenate([y for _, y in parts]), len(a)).astype(np.int64)
                if kind == CONTEXT:
                    out += [{"pack": own_pack, "kind": kind, "turn": turn, "a": int(h.view(np.int64)), "x": int(n)} for h, n in zip(a, x, strict=True)]
                    continue
                at = range_of(a, ranges)
                edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                out += [{"pack": own_pack, "kind": kind, "turn": turn, "a": int(at[i]), "tables": pack(a[i:j], x[i:j])} for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            return pa.Table.from_pylist(out, schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in FACTS.split(", "))])
        state = self.state.select("pack", "shard", "pairs")
        return written(state.groupBy("pack").cogroup(facts.groupBy("pack")).applyInArrow(run, FACTS), "lm-round")

    def _contexts(self, told: DataFrame, turn: int) -> DataFrame:
        """Whole tables of parted contexts, for each pack that has a part."""
        sums = told.where(F.col("kind") == CONTEXT).groupBy(F.col("a").alias("u")).agg(F.sum("x").alias("t"))
        rows = self.members.join(self.contexts, "u").join(sums, "u")
        none = lambda kind: F.lit(None).cast(kind)
        return written(rows.select("pack", none("int").alias("shard"), F.lit(CONTEXT).alias("kind"), F.lit(turn).alias("turn"), F.col("u").alias("a"), none("long").alias("b"), F.col("c").alias("x"), F.col("t").alias("y"), none("binary").alias("tables")), "lm-contexts")

    def _parent(self, told: DataFrame, last: DataFrame | None, turn: int) -> DataFrame:
        """Seats all tables as customers of the parent; its customers and tables go to the packs that have the word.

        Words are dealt by ranges of their hashes, each with its tables of the round before; a task seats a range."""
        vocabulary, seed = self.vocabulary, self.seed
        stirling = log_stirling(ROOT_DISCOUNT, EXACT)
        before = self.parent[turn - 1][1] if turn else float(vocabulary)

        def seat(part: pa.Table) -> pa.Table:
            packs = part.column("pack").to_pylist()
            blobs = [unpack(b) for b in part.column("tables").to_pylist()]
            mine = [(p, b) for p, b in zip(packs, blobs, strict=True) if p >= 0]
            sizes = [len(b[0]) for _, b in mine]
            words, place = np.unique(np.concatenate([b[0].astype(np.uint64) for _, b in mine]), return_inverse=True)
            c = np.bincount(place, np.concatenate([b[1] for _, b in mine]), len(words)).astype(np.int64)
            t = (c > 0).astype(np.int64)
            for p, b in zip(packs, blobs, strict=True):
                if p < 0 and len(b[0]):  # tables of the round before, of words that had several; each is here still
                    t[np.searchsorted(words, b[0].astype(np.uint64))] = b[1]
            random = lambda k: uniform(np.zeros(len(words), np.uint64), words, seed + 16 * turn + k)
            drawn = draw_tables(c, t, np.maximum(0.0, before - t), np.full(len(c), 1 / (vocabulary + 1)), ROOT_STRENGTH, ROOT_DISCOUNT, stirling, random)
            rows, at = [], 0
            for (p, _), n in zip(mine, sizes, strict=True):
                own = place[at : at + n]
                rows.append({"pack": p, "range": part.column("range")[0].as_py(), "tables": pack(words[own], c[own], drawn[own])})
                at += n
            several = drawn > 1
            rows.append({"pack": -1, "range": part.column("range")[0].as_py(), "x": int(c.sum()), "y": int(drawn.sum()), "tables": pack(words[several], drawn[several])})
            return pa.Table.from_pylist(rows, pa.schema([("pack", pa.int32()), ("range", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("tables", pa.binary())]))

        rows = told.where(F.col("kind") == WORD).select("pack", F.col("a").alias("range"), "tables")
        if last is not None:
            rows = rows.unionByName(last.where("pack < 0").select("pack", "range", "tables"))
        self.roots = written(rows.groupBy("range").applyInArrow(seat, "pack int, range long, x long, y long, tables binary"), "lm-parent")
        customers, tables = self.roots.where("pack < 0").agg(F.sum("x"), F.sum("y")).first()
        self.parent[turn] = (float(customers or 0), float(tables or 0))
        none = lambda kind: F.lit(None).cast(kind)
        numbers = (none("long").alias(c) for c in ("a", "b", "x", "y"))
        return self.roots.where("pack >= 0").select("pack", none("int").alias("shard"), F.lit(WORD).alias("kind"), F.lit(turn).alias("turn"), *numbers, "tables")

    def scores(self) -> DataFrame:
        """key, n_words, n_known, ends, base, score: sums over the words of each key's texts."""
        strength, discount, parent, vocabulary = self.strength, self.discount, dict(self.parent), self.vocabulary
        turns = range(self.burn_in + 1, self.burn_in + self.samples + 1)
        norm = self.train_tokens + 0.1 * (self.vocabulary + 1)

        def scored(r: Restaurants, shard: int, uses: bytes) -> tuple[np.ndarray, ...]:
            p = np.zeros(len(r.u))
            for turn in turns:
                t = r.facts.tables(shard, turn)
                p += r.predictive(t, turn)
            p /= len(turns)
            log = np.log10(p, out=p)
            is_word, is_end = r.words[r.u] != START, r.words[r.w] == END
            customers, _ = r.totals(t, turns[-1])
            u_known, u_base = (customers > 0)[r.of] & is_word, np.log10((customers + 0.1) / norm)[r.of]
            del r
            keys, used, docs, counts = unpack(uses)
            pair = np.repeat(np.arange(len(log), dtype=np.int32), used)

            def total(value: np.ndarray) -> np.ndarray:
                out = np.zeros(len(keys))
                for start in range(0, len(pair), 500_000):
                    at = slice(start, start + 500_000)
                    out += np.bincount(docs[at], value[pair[at]] * counts[at], len(keys))
                return out

            return keys, total(is_word), total(u_known), total(is_end), total(np.where(is_word, u_base, 0.0)), total(log)

        def run(part: pa.Table, own: pa.Table) -> pa.Table:
            sums, told = None, Facts(own, parent, vocabulary)
            for i, (shard, pairs) in enumerate(_shards(part)):
                now = scored(Restaurants(shard, pairs, told, strength, discount), shard, part.column("uses")[i].as_py())
                sums = merged([now] if sums is None else [sums, now])
                trim()
            return _part_rows(ranges, *sums)

        def whole(part: pa.Table) -> pa.Table:
            sums = merged([x for b in part.to_batches() for x in _unpacked(b)])
            kinds = (np.int64, np.int64, np.int64, np.float64, np.float64)
            return pa.table({"key": pa.array(sums[0].view(np.int64))} | {n: pa.array(x.astype(k)) for n, x, k in zip(SUMS, sums[1:], kinds, strict=True)})

        ranges = self.ranges
        facts = self.static.unionByName(self.kept)
        parts = self.state.select("pack", "shard", "pairs", "uses").groupBy("pack").cogroup(facts.groupBy("pack")).applyInArrow(run, PARTS)
        return parts.groupBy("range").applyInArrow(whole, "key long, n_words long, n_known long, ends long, base double, score double")


SUMS = ("n_words", "n_known", "ends", "base", "score")
PARTS = "range int, counts binary, base binary, score binary"


def merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Keys in order, and the sums of each column of (keys, n_words, n_known, ends, base, score)."""
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(place, np.concatenate([p[i] for p in parts]), len(keys)) for i in range(1, 6))


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges each hash falls in."""
    return ((hashes.astype(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _part_rows(ranges: int, keys: np.ndarray, *sums: np.ndarray) -> pa.Table:
    """A row for each range of keys."""
    at = range_of(keys, ranges)
    edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
    rows = [(int(at[a]), pack(keys[a:b].astype(np.uint64), *(x[a:b].astype(np.int64) for x in sums[:3])), sums[3][a:b].tobytes(), sums[4][a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("range", "counts", "base", "score"), kinds, strict=True))})


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    for counts, base, score_ in zip(*(batch.column(c).to_pylist() for c in ("counts", "base", "score")), strict=True):
        yield (*unpack(counts), np.frombuffer(base), np.frombuffer(score_))


def score(docs: DataFrame, out=None, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row's whole text,
    by a model of the rows that aren't held out (out; by default where crc32 of the id mod 10 is 0).

    Null texts are empty: their one token is the end. A null id counts as the empty text, whose
    remainder is 0. Rows that repeat count each and score alike; without training rows every word is unseen;
    an empty table gives no rows; other columns aren't read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (held_out(10, 0) if out is None else out).alias("held_out"))
    keyed = docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text", "held_out").alias("key"), "text")
    model = Model(keyed.select("key", (~F.col("held_out")).alias("train"), "text"), **options)
    norm = model.train_tokens + 0.1 * (model.vocabulary + 1)
    joined = keyed.select("doc_id", "held_out", "key").join(model.scores(), "key")
    each = lambda c: (F.col(c) / F.col("ends")).cast("long")  # noqa: E731  rows that repeat share a key
    return joined.select(
        "doc_id", "held_out", (each("n_words") + 1).alias("n_tokens"), (each("n_known") + int(model.ends > 0)).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("ends") + F.lit(math.log10((model.ends + 0.1) / norm))).alias("base_score"), (F.col("score") / F.col("ends")).alias("score"), F.pow(F.lit(10.0), -F.col("score") / (F.col("n_words") + F.col("ends"))).alias("perplexity"),
    )
