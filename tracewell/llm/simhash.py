"""SimHash fingerprints, linked by pigeonhole blocks.

A fingerprint's 64 bits are split into blocks; two that differ in at most max_bits bits agree in
all but max_bits blocks, so each choice of `agree` blocks makes a table whose key is those
blocks' bits, and every close pair shares a key in some table. Only distinct fingerprints
meet, and a bucket gives the edges of a spanning forest of its close pairs, never all pairs.
Large buckets are cut into chunks of which every two meet in a task of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, release, slices, trim, unused, written

BITS = 64
#: Fingerprints of a bucket that meet in one task; larger buckets are cut into chunks of half of it.
TOGETHER = 2048
SEED = 42


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each run of words, lower-case A-Z, joined by a space; of all words where there are fewer."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


#: Hashes whose bits are unpacked at a time.
UNPACKED = 100_000


def fingerprint(hashes: list[int]) -> int:
    """Bit set where over half of hashes have it; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), UNPACKED):
        part = np.array(hashes[start : start + UNPACKED], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row's whole text; null texts are empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(shingle_hashes(t or "", words)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, fp long")


def masks(max_bits: int, agree: int) -> list[int]:
    """Each choice of agree blocks, as the mask of their bits (signed); max_bits + agree blocks in all."""
    blocks = max_bits + agree
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(bounds, bounds[1:], strict=False)]
    whole = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what close pairs within left, or between left and right, connect."""
    nodes = np.unique(left if right is None else np.concatenate([left, right]))
    a = np.searchsorted(nodes, np.unique(left))
    b = a if right is None else np.searchsorted(nodes, np.unique(right))
    values = nodes.view(np.uint64)
    label = np.arange(len(nodes))
    edges = []
    rows = max(1, 1_000_000 // max(1, len(b)))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for start in range(0, len(a), rows):
        part = a[start : start + rows]
        x, y = np.nonzero(np.bitwise_count(values[part][:, None] ^ values[b][None, :]) <= max_bits)
        for i, j in zip(part[x].tolist(), b[y].tolist(), strict=True):
            if i != j and (u := root(i)) != (v := root(j)):
                label[max(u, v)] = min(u, v)
                edges.append((int(nodes[i]), int(nodes[j])))
    return edges


def links(distinct: DataFrame, max_bits: int, agree: int, together: int = TOGETHER) -> DataFrame:
    """a, b: edges between distinct fingerprints fp that connect all that pairs of at most max_bits differing bits connect."""
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(max_bits, agree))))
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # of few enough members one chunk; else chunk i meets each chunk j, as the first of two where i <= j
    chunks = F.when(F.col("n") <= together, 1).otherwise(F.ceil(F.col("n") * 2 / together)).cast("int")
    members = keyed.join(sizes, ["t", "key"]).withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    met = members.select("fp", "t", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "mine")
    groups = met.groupBy("t", "key", "i", "j").agg(F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("mine") != F.col("i"), F.col("fp"))).alias("right"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for i, j, left, right in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "left", "right")), strict=True):
            if i == j and len(left) == 2:
                if ((left[0] ^ left[1]) & (2**64 - 1)).bit_count() <= max_bits:  # signed, so masked to their 64 bits
                    out.append((left[0], left[1]))
            elif left and (right or i == j):
                out += forest(np.array(left, np.int64), None if i == j else np.array(right, np.int64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return map_batches(groups.select("i", "j", "left", "right"), run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node that edges (a, b) reach, by alternating large and small stars.

    Each round is written to the shared folder; only a count and a hash sum come to the driver."""
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = written(ordered, "links"), None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        last, current = current, written(small.distinct(), "links")
        release(last)
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            found = written(current.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root"), "roots")
            release(current)
            return found
        before = state
    raise RuntimeError(f"links still change after {most_rounds} rounds")


def classes(docs: DataFrame, words: int = 3, max_bits: int = 3, agree: int = 3, together: int = TOGETHER) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach) of every row.

    Null and empty texts have fingerprint zero, linked like any other; rows that repeat share a
    fingerprint; a null id stays null and is no component's least unless all its ids are null (then
    null); an empty table gives no rows; other columns aren't read."""
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits, agree, together))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = joined.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Longs of a shingle set's parity bitmap. Texts that make a shingle common, and how many common ones (the most common) the order of prefixes tells apart.
PARITY, LEAST_COMMON, COMMON = 8, 8, 250_000
#: Prefixes have the lower fifth of a text's hashes, and some more where common ones are passed over: hashes below this are counted.
COUNTED = 0.35


class Shingles:
    """Distinct 64-bit hashes of a text's runs of words, ascending; of all words as one where there are fewer."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.power = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(words)], np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        found, known, words = text.encode().lower().split(), self.known, self.words
        if len(found) < words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
        if len(known) > 250_000:
            known.clear()
        for word in set(found).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, SEED)
        own = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        return np.unique(sum((own[i : len(own) - words + 1 + i] * self.power[i] for i in range(words)), np.zeros(len(own) - words + 1, np.uint64)))


def arrays(parts: list[np.ndarray]) -> pa.Array:
    """A column of lists of longs."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) of the most common shingles, and in how many texts they are.

    They only order the prefixes, and any order finds the same pairs; counts are over all texts, so that what many share stays out of
    prefixes at every size, and texts that share it alone don't meet."""
    limit = np.uint64(int(COUNTED * 2**64))

    def run(batches):
        of = Shingles(words)
        for batch in batches:
            for part in slices(batch):
                found = [own[: np.searchsorted(own, limit)] for own in map(of, part.column("text").to_pylist())]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], ["h", "n"])
        of.known.clear()
        trim()

    counts = docs.select("text").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COMMON)
    counts = written(counts, "common-shingles")
    many = counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toArrow()
    fit = np.cumsum(np.asarray(many["c"], np.int64)) <= COMMON
    rows = counts.where(F.col("n") >= int(np.asarray(many["n"])[fit].min() if fit.any() else 1 << 62)).toArrow()
    release(counts)
    hashes, n = np.asarray(rows["h"], np.int64).view(np.uint64), np.asarray(rows["n"], np.int64)
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set's hashes, so many that sets of at least this Jaccard similarity share one: such a set
    has ceil(similarity * n) of the n, so they can't all be outside."""
    most = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
    if not len(common):
        return own[:most]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, counts[at], 0)
    return own[np.argsort(rank, kind="stable")[:most]] if rank.any() else own[:most]


def parity(own: np.ndarray) -> np.ndarray:
    """Bitmap that each hash flips a bit of, of a power of two bits, as many as hashes at least; two differ in no more bits than their sets in members."""
    bits = np.uint64(max(PARITY * 64, 1 << (len(own) - 1).bit_length()))
    flips = np.bincount((own % bits).astype(np.int64), minlength=int(bits)) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bitmap: np.ndarray, longs: int) -> np.ndarray:
    """The bitmap that fewer bits would have had."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, longs), axis=0)


def prefixes(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """id, n (shingles), map (the parity bitmap), p0, p1, ... (the same folded) and prefix of every row's whole text."""
    common, counts = common_shingles(docs, words)
    names = [f"p{i}" for i in range(PARITY)]

    def run(batches):
        of = Shingles(words)
        for batch in batches:
            for part in slices(batch):
                sizes, small, maps, firsts = [], [], [], []
                for text in part.column("text").to_pylist():
                    own = of(text)
                    sizes.append(len(own))
                    maps.append(parity(own))
                    small.append(folded(maps[-1], PARITY))
                    firsts.append(prefix(own, common, counts, similarity))
                bits = np.array(small, np.int64).reshape(-1, PARITY)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int32()), *(pa.array(bits[:, i].copy()) for i in range(PARITY)), pa.array([m.tobytes() for m in maps], pa.binary()), arrays(firsts)], ["id", "n", *names, "map", "prefix"])
        of.known.clear()
        trim()

    return docs.select("id", "text").mapInArrow(run, "id long, n int, " + ", ".join(f"{x} long" for x in names) + ", map binary, prefix array<long>")


def sets(docs: DataFrame, words: int) -> DataFrame:
    """id, own: every row's shingles."""

    def run(batches):
        of = Shingles(words)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), arrays([of(t) for t in part.column("text").to_pylist()])], ["id", "own"])
        of.known.clear()
        trim()

    return docs.select("id", "text").mapInArrow(run, "id long, own array<long>")


def may_share(similarity: float):
    """Condition on x and y, where they first share a shingle at positions at: after it enough are left of both to be close.

    A pair of at least this similarity meets it at the first shingle in the order of prefixes that both have."""
    both = F.col("x.n") + F.col("y.n")
    return F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= both * (similarity / (1 + similarity)) - 1e-9


def may_be_close(similarity: float):
    """Condition on x and y that each pair of at least this similarity meets, by sizes and parity bitmaps."""
    apart = sum((F.bit_count(F.col(f"x.p{i}").bitwiseXOR(F.col(f"y.p{i}"))) for i in range(PARITY)), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    return (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * similarity - 1e-9) & (apart <= both * ((1 - similarity) / (1 + similarity)) + 1e-9)


def sieve(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose whole parity bitmaps don't rule out this similarity."""
    left, right = (maps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("map").alias(f"m{c}")) for c in "ab")
    most = (1 - similarity) / (1 + similarity)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        limit = (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) * most + 1e-9
        apart = []
        for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
            one, two = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
            least = min(len(one), len(two))
            apart.append(int(np.bitwise_count((folded(one, least) ^ folded(two, least)).view(np.uint64)).sum()))
        good = pa.array(np.array(apart, np.int64) <= limit)
        return batch.select(["a", "b"]).filter(good)

    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb"), run, "a long, b long")


def close(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b), a written table, whose sets have at least this Jaccard similarity."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = written(sets(docs.join(needed, "id", "left_semi").dropDuplicates(["id"]), words), "sets")
    met = pairs.join(own.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = written(met.where(common >= (F.size("x") + F.size("y") - common) * similarity - 1e-9).select("a", "b"), "close")
    release(own, pairs)
    return found


#: Rounds in which a text meets a few others, and how many; what they leave is linked exactly after them.
ROUNDS, OTHERS = 2, 8


def centred(known: DataFrame, turn: int) -> DataFrame:
    """a, b: for each text b that shares a key with texts of another root, a few of them: of every key's centres those that most of
    the text's keys have. A key's centre is at first the text most of whose own keys are shared (of copies with changes of their own
    what they are copies of), later one by hash."""
    first = F.struct((-F.col("share")).alias("s"), F.xxhash64("id").alias("h"), "root", "id")
    later = F.struct(F.xxhash64("root", F.lit(turn)).alias("s"), F.xxhash64("id", F.lit(turn)).alias("h"), "root", "id")
    centres = known.groupBy("key").agg(F.min(later if turn else first).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key", F.col("c.root").alias("centre"), F.col("c.id").alias("a"))
    met = known.join(centres, "key").where("root != centre").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= OTHERS).select("a", "b")


def alike(docs: DataFrame, words: int, max_bits: int, agree: int, together: int = TOGETHER) -> DataFrame:
    """a, b: texts (id, of each the text) of one fingerprint, each with the least id of it, and the least ids of fingerprints that links gives."""
    prints = written(fingerprints(docs.select(F.col("id").alias("doc_id"), "text"), words).groupBy("doc_id").agg(F.first("fp").alias("fp")), "fingerprints")
    heads = written(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    same = prints.join(heads, "fp").where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    left, right = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")) for c in "ab")
    near = links(heads.select("fp"), max_bits, agree, together).distinct().join(left, "a").join(right, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    found = written(same.unionByName(near), "alike")
    release(prints, heads)
    return found


def near_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, together: int = TOGETHER, rounds: int = ROUNDS, max_bits: int = 3, agree: int = 3) -> DataFrame:
    """node, root: texts (by their hash) linked by Jaccard similarity of their sets of word shingles, exactly.

    First come texts whose fingerprints differ in at most max_bits bits, met by blocks (alike), where their sets are that similar.
    Fingerprints tell of few changes alone, so what they leave is linked by the sets:
    sets of at least this similarity share a member of their prefixes. In a few rounds each text meets some that share such a
    shingle and aren't linked yet, which links most of a group; then all those texts meet that share one and aren't linked yet. The
    order of prefixes has shingles by the number of texts that have them, so texts meet over what few share. Positions, sizes and parity bitmaps leave out only pairs that can't be close; the sets themselves decide. Rows that repeat an id are one text; an
    empty table gives no rows."""
    first = [F.first(c).alias(c) for c in ("n", *(f"p{i}" for i in range(PARITY)), "map", "prefix")]
    made = written(prefixes(docs, words, similarity), "prefixes")
    distinct = written(made.groupBy("id").agg(*first), "prefixes-distinct")
    release(made)
    prints, maps, keyed = distinct.drop("prefix", "map"), distinct.select("id", "n", "map"), distinct.select("id", F.posexplode("prefix").alias("at", "key"))
    there = written(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "key"), "shared-shingles")
    shared = there
    own = shared.groupBy("id").agg(F.count("*").alias("shared")).join(distinct.select("id", F.size("prefix").alias("all")), "id")
    own = written(own.select("id", (F.col("shared") / F.col("all")).alias("share")), "own-shingles")
    shared = shared.join(own.select("id", "share"), "id")

    def checked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(prints.alias("x"), F.col("a") == F.col("x.id")).join(prints.alias("y"), F.col("b") == F.col("y.id")).where(may_be_close(similarity)).select("a", "b")
        found = close(written(sieve(near, maps, similarity), "sieved-pairs"), docs, words, similarity)
        release(pairs)
        return found

    def linked(roots: DataFrame) -> DataFrame:
        return written(shared.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "key", "at", "share", F.coalesce("root", "id").alias("root")), "linked-shingles")

    edges = checked(alike(docs, words, max_bits, agree, together))
    roots = components(edges)
    known = linked(roots)
    for turn in range(rounds):
        more = checked(written(centred(known, turn), "centres"))
        before, edges = edges, written(edges.unionByName(more), "close")
        last, roots = (known, roots), components(edges)
        known = linked(roots)
        none = more.isEmpty()
        release(*last, before, more)
        if none:
            break
    release(there, roots)
    mixed = known.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    # of few enough members one chunk; else each member meets all, a chunk of them in a task
    mixed = mixed.select("key", F.ceil(F.col("members") / together).cast("int").alias("chunks"))
    members = written(known.join(mixed, "key").join(prints, "id"), "unlinked-shingles")
    release(known, own)
    left = members.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).alias("x")
    right = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.chunk") == F.col("y.chunk"))
    rest = left.join(right, same & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & may_share(similarity) & may_be_close(similarity)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    rest = written(rest.distinct(), "unlinked-pairs")
    release(members)
    more = close(written(sieve(rest, maps, similarity), "sieved-pairs"), docs, words, similarity)
    release(rest, distinct)
    found = components(edges.unionByName(more))
    release(edges, more)
    return found


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: the one of least doc_id (null counts as greatest; one of rows that repeat).

    Null texts count as empty, and are copies of each other; columns stay as they are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine, order = unused(docs, "__id"), unused(docs, "__own")
    keyed = docs.withColumn(mine, F.xxhash64(text)).withColumn(order, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    roots = near_components(docs.select(F.xxhash64(text).alias("id"), text.alias("text")), words, similarity)
    first = keyed.select(F.col(mine).alias("id"), F.col(order).alias("own")).groupBy("id").agg(F.min("own").alias("own"))
    grouped = first.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = grouped.groupBy("root").agg(F.min(F.struct("own", "id")).alias("best")).select(F.col("best.id").alias(mine), F.col("best.own").alias(unused(keyed, "__best")))
    kept = keyed.join(best, mine).where(F.col(order).eqNullSafe(F.col(unused(keyed, "__best"))))
    return kept.dropDuplicates([mine]).select(*docs.columns)
