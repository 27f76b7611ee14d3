"""Strings that occur twice or more, by enhanced suffix arrays.

A text is a string of symbols: its bytes, or the hashes of its words. Every window of a unit's size
belongs to the least k-gram hash inside it (its anchor), so equal windows meet under one anchor.
Windows that follow each other with one anchor make a segment; segments travel as digests, not text.

1. Segments of one digest are equal: a kind, of which one is read; a kind of several is a repeat as a whole.
2. Where an anchor has several kinds, an enhanced suffix array is made of them (order of the suffixes that
   windows start, common prefixes of neighbours, preceding symbols) and scanned with a stack for the intervals of its
   common-prefix tree. Those whose occurrences differ on the left are the maximal repeats, each with all its occurrences.
3. Anchors with more text than one array takes (a very common line) are told apart by a further hash of their
   windows, the least of those that few of their kinds have, and so on, until the parts are small enough: equal windows have equal hashes at every step.

A repeat that is longer than a segment is told piece by piece, in groups that overlap by all of a window but a symbol.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, map_batches, release, trim, unused, written

#: Bytes of an anchor's kinds that go into one suffix array; beyond it the anchor is told apart further.
ANCHOR_BYTES = 400_000
#: Kinds of an anchor in which hashes are counted, and the share of them from which a hash is common: both only shape its parts.
COUNTED, COMMON = 200, 0.05
#: Pieces of an anchor that are told apart in one task, about.
TOGETHER = 1000
#: Bytes of kinds that a suffix array is made of, about, and that a task gets.
ARRAY_BYTES, BUCKET_BYTES = 100_000, 2_000_000
#: Symbols that are hashed at a time; longer texts are cut with an overlap, which changes no window's anchor.
BUFFER = 1_000_000
#: Words that a worker remembers the hashes of.
REMEMBERED = 250_000
_B, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POSITION, _LAST = np.uint64((1 << 24) - 1), np.uint64((1 << 64) - 1)


class Unit(NamedTuple):
    """What texts are strings of, symbols of a window, and of the grams by whose hashes windows meet."""

    words: bool
    size: int
    k: int

    @property
    def width(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.words else 1


def byte_unit(size: int) -> Unit:
    return Unit(False, size, max(1, size // 4))


def word_unit(size: int) -> Unit:
    return Unit(True, size, max(1, size // 4))


class Words(dict):
    """The hash of each word, computed when it is first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def symbols(text: bytes, unit: Unit, known: Words) -> np.ndarray:
    if not unit.words:
        return np.frombuffer(text, np.uint8)
    words = text.split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            inverse = np.uint64(pow(int(_B), -1, 1 << 64))
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _B)]))
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]))
        return cls.up[:n], cls.down[:n]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of each k symbols that start at a position."""
    n = len(data)
    up, down = _Powers.of(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(up[:n] * (data.astype(np.uint64) + np.uint64(1)), out=total[1:])
    h = (total[k:] - total[: n + 1 - k]) * down[: n + 1 - k]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values, by block prefixes and suffixes."""
    n = len(values)
    padded = np.full(-(-n // width) * width, _LAST, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[np.ndarray], unit: Unit) -> tuple[np.ndarray, ...]:
    """Text's index, start, window count, anchor hash and digest of each segment of texts."""
    size, k = unit.size, unit.k
    found: list[tuple[np.ndarray, ...]] = []
    step = BUFFER - size + 1
    batch: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        data = np.concatenate([t for _, _, t in batch])
        grams = gram_hashes(data, k)
        keyed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        least = (sliding_least(keyed, size - k + 1) & _POSITION).astype(np.int64)
        sizes = np.array([len(t) for _, _, t in batch])
        first = np.cumsum(sizes) - sizes
        changed = np.ones(len(least) + 1, bool)
        changed[1:-1] = least[1:] != least[:-1]
        changed[first[first < len(changed)]] = True
        changed[np.minimum(first + sizes - size + 1, len(least))] = True
        starts = np.flatnonzero(changed[:-1])
        ends = np.append(starts[1:], len(least))
        owner = np.searchsorted(first, starts, side="right") - 1
        inside = starts <= first[owner] + sizes[owner] - size
        starts, ends, owner = starts[inside], ends[inside], owner[inside]
        digest, raw, width = xxhash.xxh3_64_intdigest, memoryview(data).cast("B"), unit.width
        digests = np.array([digest(raw[a:b]) for a, b in zip((starts * width).tolist(), ((ends + size - 1) * width).tolist(), strict=True)], np.uint64)
        index = np.array([i for i, _, _ in batch])[owner]
        base = np.array([b for _, b, _ in batch])[owner]
        found.append((index, starts - first[owner] + base, ends - starts, grams[least[starts]].view(np.int64), digests.view(np.int64)))
        batch.clear()

    total = 0
    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text) - size + 1), step):
            part = text[base : base + BUFFER]
            if len(part) >= size:
                if batch and total + len(part) > BUFFER:
                    flush()
                    total = 0
                batch.append((i, base, part))
                total += len(part)
    if batch:
        flush()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def apart(data: np.ndarray, unit: Unit, common: np.ndarray) -> Iterator[tuple[int, int, int | None]]:
    """(start, windows, hash) of the parts of a segment by the least of its hashes that aren't common; None for windows that have only those."""
    grams = gram_hashes(data, unit.k)
    keyed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    keyed[np.isin(grams.view(np.int64), common)] = _LAST
    least = sliding_least(keyed, unit.size - unit.k + 1)
    edges = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield a, b - a, None if least[a] == _LAST else int(grams[int(least[a] & _POSITION)])


class Intervals(NamedTuple):
    """Maximal repeats of an enhanced suffix array: symbols, first and last rank, the least that encloses each (or -1)."""

    length: np.ndarray
    first: np.ndarray
    last: np.ndarray
    parent: np.ndarray


class SuffixArray:
    """The enhanced suffix array of the suffixes that start windows of kinds (their bytes), in order, with common prefixes."""

    def __init__(self, kinds: list[bytes], unit: Unit):
        width = unit.width
        self.unit, self.kinds = unit, kinds
        counts = [max(0, len(d) // width - unit.size + 1) for d in kinds]
        suffixes = [d[at : at + len(d)] for d, n in zip(kinds, counts, strict=True) for at in range(0, n * width, width)]
        order = np.array(sorted(range(len(suffixes)), key=suffixes.__getitem__), np.int64)
        del suffixes
        n = np.array(counts, np.int64)
        self.kind = np.repeat(np.arange(len(kinds)), n)[order]
        self.start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[order]
        raw = b"".join(kinds) + bytes(8)
        size = np.array([len(d) for d in kinds], np.int64)
        self._place = (np.cumsum(size) - size)[self.kind] + self.start * width
        self._rest = size[self.kind] - self.start * width
        self._raw = raw
        self.common = self._common_prefixes()
        before = np.frombuffer(raw, np.uint8) if width == 1 else None
        left = self._place - width
        inside = self.start > 0
        self.left = np.full(len(order), 0, np.int64)
        if len(order):
            at = np.where(inside, left, 0)
            self.left = before[at].astype(np.int64) if before is not None else self._eights()[at].view(np.int64)
        self.none = ~inside  # nothing before in the segment: differs from all

    def _eights(self) -> np.ndarray:
        """The eight bytes that start at each place."""
        return np.ndarray((len(self._raw) - 7,), "<u8", self._raw, strides=(1,))

    def _common_prefixes(self) -> np.ndarray:
        """Symbols that each suffix shares with the one before it; eight bytes of all pairs that still agree at a time."""
        n = len(self.kind)
        common = np.zeros(n, np.int64)
        if n < 2:
            return common
        eights = self._eights()
        shortest = np.minimum(self._rest[1:], self._rest[:-1])
        one, two = self._place[:-1], self._place[1:]
        same, active, at = shortest.copy(), np.arange(n - 1), 0
        while len(active):
            differ = eights[one[active] + at] ^ eights[two[active] + at]
            found = differ != 0
            low = differ[found]
            same[active[found]] = at + (np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            at += 8
            active = active[~found]
            active = active[shortest[active] > at]
        common[1:] = np.minimum(same, shortest) // self.unit.width
        return common

    def maximal(self) -> Intervals:
        """Intervals of the common-prefix tree of a window or more whose occurrences differ on the left, by length."""
        common, n = self.common, len(self.kind)
        high = common >= self.unit.size
        edges = np.flatnonzero(np.diff(np.concatenate([[False], high, [False]]).astype(np.int8)))
        change = np.concatenate([[False], (self.left[1:] != self.left[:-1]) | self.none[1:] | self.none[:-1]]) if n else np.zeros(0, bool)
        differs = np.cumsum(change)
        low, top = edges[::2] - 1, edges[1::2] - 1
        # where all are preceded by one symbol the repeat goes on to the left, and so do those inside it
        diverse = differs[low] != differs[top] if len(low) else np.zeros(0, bool)
        found: list[tuple[int, int, int]] = []
        for lo, hi in zip(low[diverse].tolist(), top[diverse].tolist(), strict=True):
            stack: list[list[int]] = []  # [common prefix, first rank] of the open intervals
            for at, now in enumerate([*common[lo + 1 : hi + 1].tolist(), 0], lo + 1):
                first = at - 1
                while stack and stack[-1][0] > now:
                    length, first = stack.pop()
                    if differs[first] != differs[at - 1]:
                        found.append((length, first, at - 1))
                if now >= self.unit.size and (not stack or stack[-1][0] < now):
                    stack.append([now, first])
        found.sort()
        length, first, last = (np.array([f[i] for f in found], np.int64) for i in range(3))
        self.deepest = np.full(n, -1, np.int64)
        parent = np.full(len(found), -1, np.int64)
        for i, (_, a, b) in enumerate(found):
            parent[i] = self.deepest[a]
            self.deepest[a : b + 1] = i
        return Intervals(length, first, last, parent)

    def text(self, rank: int, length: int) -> bytes:
        return self._raw[self._place[rank] : self._place[rank] + length * self.unit.width]


def maximal_repeats(texts: list[bytes], unit: Unit) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(symbols, (text, start) of all occurrences) of each maximal repeat of a window or more among texts."""
    array = SuffixArray(texts, unit)
    for length, first, last, _ in zip(*array.maximal(), strict=True):
        yield int(length), sorted(zip(array.kind[first : last + 1].tolist(), array.start[first : last + 1].tolist(), strict=True))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


PIECES = "unit int, anchor long, stuck int, digest long, n long, several boolean, own long, key long, start long, windows int, data binary"
FOUND = "unit int, anchor long, digest long, n long, own long, key long, start long, stop long, repeat long, parent long, occurrences long, across boolean"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key; rows that repeat share it, and their spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("own"))


def _segment_rows(keyed: DataFrame, units: list[Unit]) -> DataFrame:
    """unit, anchor, digest, own, key, start, windows of each segment; starts and windows count symbols."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        known, parts = Words(), []
        for u, unit in enumerate(units):
            index, start, windows, anchor, digest = segments([symbols(t, unit, known) for t in texts], unit)
            taken = pa.array(index, pa.int64())
            parts.append(pa.record_batch([pa.array(np.full(len(index), u, np.int32)), pa.array(anchor), pa.array(digest), batch.column("own").take(taken), batch.column("key").take(taken), pa.array(start), pa.array(windows.astype(np.int32))], ["unit", "anchor", "digest", "own", "key", "start", "windows"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]

    least = min(u.size if not u.words else 2 * u.size - 1 for u in units)  # a word has a byte, and one before the next
    return map_batches(keyed.select("own", "key", "text").where(F.octet_length("text") >= least), run, "unit int, anchor long, digest long, own long, key long, start long, windows int")


def _kinds(rows: DataFrame, n: Column, several: Column) -> DataFrame:
    """unit, anchor, digest, n, several (texts), own, key, start, windows (of one row of each kind): all fixed-width, so that rows meet in hash tables.

    The row is that whose place has the least hash; windows of a kind are equally many."""
    place = F.xxhash64("key", "start")
    one = (F.min_by(c, place).alias(c) for c in ("own", "key", "start"))
    return rows.groupBy("unit", "anchor", "digest").agg(F.sum(n).alias("n"), (several | (F.min("key") != F.max("key"))).alias("several"), *one, F.max("windows").alias("windows"))


def _mixed(kinds: DataFrame, units: list[Unit], n: str = "n") -> DataFrame:
    """unit, anchor, kinds, bytes of the anchors that have several kinds, one of which alone: only there can more be found."""
    size, width = (F.element_at(F.array(*(F.lit(x) for x in xs)), F.col("unit") + 1) for xs in ([u.size for u in units], [u.width for u in units]))
    sums = kinds.groupBy("unit", "anchor").agg(F.count("*").alias("kinds"), F.min(n).alias("least"), F.sum((F.col("windows") + size - 1) * width).alias("bytes"))
    return sums.where("kinds > 1 AND least = 1").select("unit", "anchor", "kinds", "bytes")


#: Anchors that are sent to every task, at most; more meet their kinds by a shuffle.
SENT = 500_000


def _few(anchors: DataFrame) -> DataFrame:
    """anchors, a written table, for a broadcast where they are few enough."""
    return F.broadcast(anchors) if anchors.count() <= SENT else anchors


def _pieces(keyed: DataFrame, kinds: DataFrame, units: list[Unit]) -> DataFrame:
    """The text of one segment of each kind of mixed anchors."""
    mixed = written(_mixed(kinds, units).select("unit", "anchor"), "repeat-anchors")
    wanted = kinds.join(_few(mixed), ["unit", "anchor"])
    by_doc = wanted.groupBy("own", "key").agg(F.collect_list(F.struct("unit", "anchor", "digest", "n", "several", "start", "windows")).alias("wanted"))
    texts = keyed.select("own", "key", "text").join(by_doc, ["own", "key"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted, known, data = batch.column("wanted"), Words(), []
        bounds = np.diff(wanted.offsets.to_numpy())
        rows = wanted.flatten()
        unit, start, windows = (rows.field(c).to_numpy() for c in ("unit", "start", "windows"))
        at = 0
        for text, many in zip(batch.column("text").to_pylist(), bounds.tolist(), strict=True):
            raw = [None] * len(units)
            for i in range(at, at + many):
                u = units[unit[i]]
                if raw[unit[i]] is None:
                    raw[unit[i]] = memoryview(symbols(text.encode(), u, known)).cast("B")
                data.append(bytes(raw[unit[i]][start[i] * u.width : (start[i] + windows[i] + u.size - 1) * u.width]))
            at += many
        owner = pa.array(np.repeat(np.arange(batch.num_rows), bounds))
        columns = [rows.field("unit"), rows.field("anchor"), pa.array(np.zeros(len(rows), np.int32)), rows.field("digest"), rows.field("n"), rows.field("several"), batch.column("own").take(owner), batch.column("key").take(owner), rows.field("start"), rows.field("windows"), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

    pieces = written(map_batches(texts, run, PIECES).dropDuplicates(["unit", "anchor", "digest"]), "repeat-texts")  # rows that repeat tell theirs twice
    release(mixed)
    return pieces


def _deeper(pieces: DataFrame, hot: DataFrame, units: list[Unit]) -> DataFrame:
    """Parts of the pieces of hot anchors (unit, anchor, kinds), by a hash more.

    Windows that have common hashes alone stay together; when they are too many again, each goes by its own digest."""
    by = ["unit", "anchor"]
    pieces = pieces.join(hot.select(*by, "kinds"), by)

    def count(part: pa.Table) -> pa.Table:
        unit = units[part.column("unit")[0].as_py()]
        data = [np.unique(gram_hashes(np.frombuffer(d, np.uint64 if unit.words else np.uint8), unit.k)) for d in part.column("data").to_pylist()]
        hashes, n = np.unique(np.concatenate(data), return_counts=True)
        common = hashes[n > max(1, COMMON * len(data))].view(np.int64)
        return pa.table({"unit": pa.array([part.column("unit")[0].as_py()], pa.int32()), "anchor": pa.array([part.column("anchor")[0].as_py()], pa.int64()), "common": pa.array([common], pa.list_(pa.int64()))})

    counted = pieces.where(F.pmod(F.xxhash64("digest"), F.ceil(F.col("kinds") / COUNTED)) == 0).select(*by, "data").groupBy(*by).applyInArrow(count, "unit int, anchor long, common array<long>")
    salts = F.ceil(F.col("kinds") / TOGETHER).cast("int")
    told = hot.join(counted, by, "left").select(*by, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "common")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("digest", F.lit(1)), salts).cast("int")).drop("kinds")
    names = [c.split()[0] for c in PIECES.split(", ")]

    def split(part: pa.Table, told: pa.Table) -> pa.Table:
        common = np.array(told.column("common")[0].as_py() or [], np.int64)
        out: list[tuple] = []
        for u, anchor, stuck, n, several, own, key, start, windows, data in zip(*(part.column(c).to_pylist() for c in ("unit", "anchor", "stuck", "n", "several", "own", "key", "start", "windows", "data")), strict=True):
            unit = units[u]
            array = np.frombuffer(data, np.uint64 if unit.words else np.uint8)
            parts = ((a, 1, None) for a in range(windows)) if stuck > 1 else apart(array, unit, common)
            for at, many, hashed in parts:
                own_data = data[at * unit.width : (at + many + unit.size - 1) * unit.width]
                digest = _signed(xxhash.xxh3_64_intdigest(own_data))
                by = digest if stuck > 1 else 0 if hashed is None else _signed(hashed)
                chained = _signed(xxhash.xxh3_64_intdigest(anchor.to_bytes(8, "little", signed=True) + by.to_bytes(8, "little", signed=True)))
                out.append((u, chained, stuck + 1 if hashed is None else 0, digest, n, several, own, key, start + at, many, own_data))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(names, kinds, strict=True))})

    return salted.groupBy(*by, "salt").cogroup(told.groupBy(*by, "salt")).applyInArrow(split, PIECES)


def _scan(pieces: DataFrame, units: list[Unit], total: int) -> DataFrame:
    """FOUND: occurrences of maximal repeats among the pieces of each anchor, each under the longest that starts at its place."""

    def arrays(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.sort_by([("unit", "ascending"), ("anchor", "ascending")])
        unit, anchor = part.column("unit").to_numpy(), part.column("anchor").to_numpy()
        size = np.cumsum(pc.binary_length(part.column("data")).to_numpy().astype(np.int64))
        edges = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (unit[1:] != unit[:-1]), [True]]))
        start = 0
        for i in range(1, len(edges)):
            a, b = edges[start], edges[i]
            if i + 1 == len(edges) or unit[b] != unit[a] or size[edges[i + 1] - 1] - (size[a - 1] if a else 0) > ARRAY_BYTES:
                yield one(part.slice(a, b - a), units[unit[a]])
                start = i

    def one(part: pa.Table, unit: Unit) -> pa.Table:
        data = part.column("data").to_pylist()
        array = SuffixArray(data, unit)
        found = array.maximal()
        ranks = np.flatnonzero(array.deepest >= 0)
        group, kind = array.deepest[ranks], array.kind[ranks]
        own, key, many = (part.column(c).to_numpy() for c in ("own", "key", "n"))
        several = part.column("several").to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(many[array.kind])])
        o, k, s = own[array.kind], key[array.kind], several[array.kind]
        texts = np.cumsum(np.concatenate([[0], ((o[1:] != o[:-1]) | (k[1:] != k[:-1])).astype(np.int64)])) if len(o) else np.zeros(0, np.int64)
        spread = np.cumsum(s.astype(np.int64))
        across = (texts[found.last] != texts[found.first]) | (spread[found.last] - spread[found.first] + s[found.first] > 0) if len(found.length) else np.zeros(0, bool)
        names = np.array([_signed(xxhash.xxh3_64_intdigest(array.text(a, n))) for a, n in zip(found.first.tolist(), found.length.tolist(), strict=True)], np.int64)
        parent = np.where(found.parent >= 0, names[found.parent], 0) if len(names) else names
        taken = pa.array(kind)
        begin = part.column("start").to_numpy()[kind] + array.start[ranks]
        columns = [part.column(c).take(taken) for c in ("unit", "anchor", "digest", "n", "own", "key")]
        return pa.table([*columns, pa.array(begin), pa.array(begin + found.length[group]), pa.array(names[group]), pa.array(parent[group]), pa.array((sums[found.last + 1] - sums[found.first])[group]), pa.array(across[group])], [c.split()[0] for c in FOUND.split(", ")])

    def run(part: pa.Table) -> pa.Table:
        out = pa.concat_tables(arrays(part.combine_chunks()))
        trim()
        return out

    buckets = max(1, total // BUCKET_BYTES)
    return pieces.withColumn("bucket", F.pmod(F.xxhash64("unit", "anchor"), F.lit(buckets))).groupBy("bucket").applyInArrow(lambda part: run(part.drop_columns(["bucket"])), FOUND)


def found_repeats(docs: DataFrame, units: list[Unit], anchor_bytes: int = ANCHOR_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """(found, tables): occurrences of maximal repeats in one segment of each kind, and of whole segments that repeat, as FOUND
    (a row of the former with n above 1 stands for all segments of its kind); and the written tables that found reads."""
    keyed = _keyed(docs)
    rows = written(_segment_rows(keyed, units), "repeat-segments")
    kinds = written(_kinds(rows, F.lit(1), F.lit(False)), "repeat-kinds")
    size = F.element_at(F.array(*(F.lit(u.size) for u in units)), F.col("unit") + 1)

    def whole(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        """Segments of kinds of several, as repeats."""
        met = rows.join(kinds.where("n > 1").select("unit", "anchor", "digest", F.col("n").alias("occurrences"), F.col("several").alias("across")), ["unit", "anchor", "digest"])
        return met.select("unit", "anchor", "digest", F.col("occurrences").alias("n"), "own", "key", "start", (F.col("start") + F.col("windows") + size - 1).alias("stop"), F.xxhash64("unit", "anchor", "digest").alias("repeat"), F.lit(0).cast("long").alias("parent"), "occurrences", "across")

    tables = [written(whole(rows, kinds), "repeat-whole")]
    found = tables[:]
    release(rows)
    pieces = _pieces(keyed, kinds, units)
    release(kinds)
    while True:
        mixed = written(_mixed(pieces, units), "repeat-anchors")
        total, hot = mixed.agg(F.sum(F.when(F.col("bytes") <= anchor_bytes, F.col("bytes"))), F.count_if(F.col("bytes") > anchor_bytes)).first()
        few = pieces.join(_few(mixed.where(F.col("bytes") <= anchor_bytes).select("unit", "anchor")), ["unit", "anchor"], "left_semi")
        tables.append(written(_scan(few, units, total or 0), "repeat-found"))
        found.append(tables[-1])
        if not hot:
            release(mixed, pieces)
            break
        # a part that several pieces have is a repeat; of each kind of parts one goes on
        parts = written(_deeper(pieces, mixed.where(F.col("bytes") > anchor_bytes), units), "repeat-parts")
        kinds = written(_kinds(parts, F.col("n"), F.bool_or("several")), "repeat-kinds")
        found.append(whole(parts.where("n = 1").drop("n", "several"), kinds))
        tables += [parts, kinds]
        chosen = kinds.select("unit", "anchor", "digest", F.col("n").alias("all"), F.col("several").alias("others"), "own", "key", "start")
        chosen = parts.join(chosen, ["unit", "anchor", "digest", "own", "key", "start"]).withColumn("n", F.col("all")).withColumn("several", F.col("others")).drop("all", "others")
        release(mixed, pieces)
        pieces = written(chosen.dropDuplicates(["unit", "anchor", "digest"]), "repeat-texts")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, tables


def repeat_groups(docs: DataFrame, unit: Unit) -> DataFrame:
    """repeat, parent, length, occurrences, across, doc_id, start, stop, copies, segment: maximal repeats of a window of unit or more, a
    row for each occurrence, under the longest repeat that starts there; those that enclose it in the tree (parent, 0 where none
    does) have it too. Symbols count from 0; across tells whether several texts have it.

    A repeat is told within segments (see above). A segment that several texts have whole is a repeat with all its occurrences; what
    else repeats in it is told for one of them, with how many copies there are and the repeat (segment) that lists them.
    Null and empty texts have none; rows that repeat are one text, each other's copies; a null id is told as null; an empty table gives none."""
    found, _ = found_repeats(docs, [unit])
    doc_id = F.when(F.col("own") != -(2**63), F.col("own")).alias("doc_id")
    return found.select("repeat", "parent", (F.col("stop") - F.col("start")).alias("length"), "occurrences", "across", doc_id, "start", "stop", F.col("n").alias("copies"), F.xxhash64("unit", "anchor", "digest").alias("segment"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def whole_characters(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """The span widened to whole UTF-8 characters."""
    while start > 0 and data[start] & 0xC0 == 0x80:
        start -= 1
    while stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop += 1
    return start, stop


def spans_by_text(docs: DataFrame, units: list[Unit], **options) -> DataFrame:
    """own, key, spans (unit, start, stop) of each text that has any; spans overlap and may be told more than once."""
    found, tables = found_repeats(docs, units, **options)
    # in segments that repeat whole nothing else counts
    own = found.where((F.col("n") == 1) | (F.col("repeat") == F.xxhash64("unit", "anchor", "digest")))
    by_doc = own.groupBy("own", "key").agg(F.collect_set(F.struct("unit", "start", "stop")).alias("spans"))
    out = written(by_doc, "repeat-spans")
    release(*tables)
    return out


def _spans_of(column: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
    """(unit, start, stop) of each row's spans, a row's at a time."""
    offsets, rows = column.offsets.to_numpy(), column.values
    fields = [rows.field(c) for c in ("unit", "start", "stop")]
    for i in range(len(column)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        yield list(zip(*(f.slice(a, b - a).to_pylist() for f in fields), strict=True)) if b > a and column[i].is_valid else []


def digest_repeats(docs: DataFrame, min_bytes: int = 400, passage_words: int = 50, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words, n_passages of every row.

    The last two: words that stand in passages of passage_words or more which occur anywhere else, and the runs that they make.
    Null texts are empty; texts of fewer than min_bytes keep all; rows that repeat count as each
    other's copies; a null id stays null; an empty table gives no rows; other columns aren't read."""
    by_doc = spans_by_text(docs, [byte_unit(min_bytes), word_unit(passage_words)], **options)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), _spans_of(batch.column("spans")), strict=True):
            data = text.encode()
            merged = merge([(a, b) for u, a, b in spans if u == 0])
            passages = merge([(a, b) for u, a, b in spans if u == 1])
            digest, at = hashlib.sha256(), 0
            for start, stop in merged:
                digest.update(data[at:start])
                at = stop
            digest.update(data[at:])
            rows.append((len(data), sum(b - a for a, b in merged), len(merged), digest.hexdigest(), sum(b - a for a, b in passages), len(passages)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    joined = _keyed(docs).join(by_doc, ["own", "key"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long")


def remove_repeats(docs: DataFrame, unit: Unit, text: str = "text", **options) -> DataFrame:
    """docs with repeats of a window of unit or more cut from the text, every occurrence; bytes are widened to whole characters,
    words go from the first's first byte to the last's last.

    Null texts stay null, empty ones empty; rows that repeat are each other's copies; an empty table stays empty; other columns stay as they are."""
    by_doc = spans_by_text(docs.withColumn("text", F.col(text)), [unit], **options)
    own, key, told = (unused(docs, c) for c in ("__own", "__key", "__spans"))
    spans = by_doc.select(F.col("own").alias(own), F.col("key").alias(key), F.col("spans").alias(told))
    value = F.col(text).cast("string")
    joined = docs.join(spans, (F.xxhash64(F.col("doc_id").cast("long"), value) == F.col(key)) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.col(own)), "left").drop(own, key)
    kinds, names = {f.name: f.dataType.simpleString() for f in docs.schema.fields}, docs.columns
    word = re.compile(WORD.encode())

    def cut(data: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        found = merge([(a, b) for _, a, b in spans])
        if unit.words:
            bounds = [m.span() for m in word.finditer(data)]
            found = [(bounds[a][0], bounds[b - 1][1]) for a, b in found]
        else:
            found = merge([whole_characters(data, a, b) for a, b in found])
        out, at = [], 0
        for start, stop in found:
            out.append(data[at:start])
            at = stop
        return b"".join([*out, data[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [cut(value.encode(), spans).decode() if spans else value for value, spans in zip(batch.column(text).to_pylist(), _spans_of(batch.column(told)), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == text else batch.column(c) for c in names], names)

    return map_batches(joined, run, ", ".join(f"`{c}` {'string' if c == text else kinds[c]}" for c in names))
