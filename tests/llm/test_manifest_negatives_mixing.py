"""The Merkle manifest, hard negatives and mixing: against plain Python and DuckDB."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import merkle, mixing, negatives, queries
from tracewell.llm.common import running

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """The rows of the manifest of (doc_id, source, lang, n_chars, text), node by node."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    digest = lambda r: sha("".join(map(field, r)))

    def climb(nodes):
        """The root, and the path of each node: of each level what is left and right of it."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for n, i in enumerate(at):
                run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
                paths[n].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
                at[n] = i // 8
            nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    there = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for g in langs}
    climbed = {g: climb([digest(r) for r in there[g]]) for g in langs}
    root, above = climb([climbed[g][0] for g in langs])
    for g, up in zip(langs, above, strict=True):
        for r, path in zip(there[g], climbed[g][1], strict=True):
            now = (*r[:4], r[4].translate(LOWER)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None else r
            node = digest(now)
            for left, right in path + up:
                node = sha(left + node + right)
            yield r[0], digest(r), climbed[g][0], root, sha("".join(a + b for a, b in path + up)), node, node == root


def manifest(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 AS g", "2 AS id", "3 AS leaf", "4 AS at", "5 AS n")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return sorted(map(tuple, merkle.manifest(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 1100, "é": 65, "z": 64, "": 513, None: 2}, {f"l{i}": 1 + i % 3 for i in range(530)}], ids=str)
def test_manifest_against_plain_python(spark, sizes):
    rows = [(7 * i % n, "s" if i % 5 else None, g, i, f"Text {i} É") for g, n in sizes.items() for i in range(n)]
    assert manifest(spark, rows) == sorted(plain_manifest(rows), key=repr)


def test_manifest_of_odd_rows(spark, odd, empty):
    rows = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (None, None, None, None, None), (None, "a", "en", 1, "X"), (2, "a", "en", 0, ""), (3, "a", "en", None, "É" * 70000), (-5, "", "", -1, None)]
    want = list(plain_manifest(rows))
    assert manifest(spark, rows) == sorted(want, key=repr)
    assert not all(r[-1] for r in plain_manifest([(i, "a", "en", 1, "Abc") for i in range(20)]))
    got = merkle.manifest(odd).collect()
    assert len(got) == odd.count() and all(r["verified"] for r in got) and merkle.manifest(empty).count() == 0


def test_repeated_rows_of_one_group_spread(spark):
    """A third of all rows are equal, and yet ranges are cut through them."""
    same = spark.range(3000).select(F.lit("g").alias("g"), F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"))
    got = running(same, ["g"], [F.col("k").asc()], F.lit(2).cast("long"), "n").collect()
    assert sorted(r["n_before"] for r in got) == list(range(0, 6000, 2)) and {r["n_all"] for r in got} == {6000}
    assert [r["k"] for r in sorted(got, key=lambda r: r["n_before"])] == sorted(r["k"] for r in got)


def plain_negatives(rows):
    """The rows that mining gives, by all products."""
    out = []
    for a, (anchor, own, q) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        others = sorted(((-int(np.dot(q, x)), i is None, i or 0, i, label) for n, (i, label, x) in enumerate(rows) if n != a), key=lambda t: t[:3])
        for p, _, _, positive, _ in [x for x in others if x[4] == own][:5]:
            fit = [x for x in others if x[4] != own and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(anchor, positive, n + 1, x[3], -p, -x[0]) for n, x in enumerate(fit[:10])]
    return out


def whole(rows):
    return [(i, label, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, label, v in rows]


@pytest.mark.parametrize("kind", ["normal", "flat", "skewed", "ties"])
def test_negatives_against_all_products(spark, kind):
    r = np.random.default_rng(3)
    n, d = (700, 40) if kind != "ties" else (400, 3)
    v = r.standard_normal((n, d)) * {"normal": 1, "flat": 1, "skewed": 1 / np.arange(1, d + 1), "ties": 0.01}[kind]
    if kind == "flat":  # all nearly alike: products differ in their last digits alone
        v = (3 + v / 500) * np.where(np.arange(n) % 3 == 1, 0.88, 1)[:, None]
    v = v.astype(np.float32)
    rows = [(25 * i, int(i % 3), x.tolist()) for i, x in enumerate(v)]
    got = negatives.mine(negatives.quantised(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")), F.col("id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(plain_negatives(whole(rows))) and got


def test_negatives_of_odd_rows(spark):
    r = np.random.default_rng(5)
    v = lambda: (1 + r.standard_normal(8) / 3).tolist()
    one, two = v(), v()
    good = [(100, 1, one), (100, 1, one), (100, 1, two), (0, 1, v()), (None, 1, v()), (None, 2, one), (-300, 2, two), (5, 2, two), (5, 2, two), (6, 2, [0.5] * 3), (8, 1, []), (9, 2, [x / 2 for x in one]), (10, 1, [x / 2 for x in one]), (11, 2, [0.0] * 8), (200, 3, [0.0] * 8), (300, 3, [-1.0] * 8)]
    odd = [(400, None, one), (500, 1, None), (600, 1, [None, 1.0]), (700, 1, [float("nan")]), (800, 2, [float("inf")])]
    frame = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS key", "2 AS q", "3 AS id", "4 AS shard", "5 AS scores")
    got = negatives.mine(negatives.quantised(frame), F.col("id") % 100 == 0).collect()
    padded = [(i, label, np.pad(q, (0, 8 - len(q)))) for i, label, q in whole(good)]
    assert sorted(map(tuple, got), key=repr) == sorted(plain_negatives(padded), key=repr)
    assert negatives.mine(negatives.quantised(frame.where("false")), F.col("id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="too large for 64-bit"):
        negatives.mine(negatives.quantised(spark.createDataFrame([(0, 1, [1e30])], "vec_id long, label int, embedding array<double>")), F.col("id") == 0).collect()


def test_early_discards_are_exact_and_many():
    """Pairs that panels discard can't be among the best; on vectors with leading directions they are most of all pairs."""
    r = np.random.default_rng(7)
    x = np.floor(256 * r.standard_normal((6000, 64)) / np.arange(1, 65)).astype(np.int32)
    turn = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1].copy()
    shard = object.__new__(negatives.Shard)
    shard.label, shard.id, shard.null, shard.whole = np.zeros(6000, np.int64), np.arange(6000), np.zeros(6000, bool), x
    shard.turned, shard.tails = negatives.turned(x, turn)
    met = []
    best = negatives.Best(np.full((20, 1), -negatives.NONE + 1), np.full((20, 1), negatives.NONE - 1), 6)
    add, best.add = best.add, lambda j, *rest: (met.append(len(j)), add(j, *rest))
    negatives.search(shard, slice(0, 6000), x[:20], turn, best, None)
    products = x.astype(np.int64) @ x[:20].T.astype(np.int64)
    for a in range(20):
        at = best.rows[0] == a
        assert list(zip(-best.rows[1][at], best.rows[3][at], strict=True)) == sorted(zip(-products[:, a], range(6000), strict=True))[:6]
    assert sum(met) < 0.5 * 6000 * 20


def level(sizes, weights=(5, 2, 1)):
    """Targets by cutting and resharing in fractions."""
    goal, free, out = Fraction(3, 2) * sum(sizes), set(range(len(sizes))), {}
    w = [weights[i % 3] for i in range(len(sizes))]
    while free:
        rest = goal - sum(out.values())
        got = {i: rest * w[i] / sum(w[j] for j in free) for i in free}
        above = {i for i in free if got[i] > 2 * sizes[i]}
        if not above:
            return [float((out | got)[i]) for i in range(len(sizes))]
        out |= {i: Fraction(2 * sizes[i]) for i in above}
        free -= above
    return [float(out[i]) for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[10], [100, 1, 1], [1, 1, 100], [0, 0], [0, 50, 7, 300, 2, 2, 9], [5] * 30, [3, 1000, 10, 10, 800, 1, 4000]], ids=str)
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"0{i:03}", n) for i, n in enumerate(sizes)], "__m_source string, __m_source_size long")
    got = [r["__m_target"] for r in mixing.targets(frame).orderBy("__m_source").collect()]
    assert got == pytest.approx(level(sizes), rel=1e-12)


def test_mixing_of_odd_rows(spark, odd, empty):
    got = mixing.taken(odd).collect()
    assert len(got) == odd.count() and mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0
    sums, targets = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source_size"]] += r["taken"]
        targets[r["source_size"]] = r["target"]
    assert len(targets) == 4 and all(abs(sums[s] - targets[s]) <= 0.5 for s in sums)
    again = mixing.taken(odd.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_the_mix_itself(spark, odd):
    """Each use of a document is a row; together they hold the words that were to be taken, whole texts but where a budget ends."""
    texts = odd.withColumn("text", F.concat(F.lit(" \n"), "text", F.lit("\t")))
    rows = mixing.mix(texts.selectExpr("*", "1 AS epoch")).collect()
    words = Counter()
    for r in rows:
        words[r["doc_id"], r["source"]] += len((r["text"] or "").replace("\x1f", "_").encode().split())
    want = Counter()
    for r, n in {(d["doc_id"], d["source"]): 0 for d in texts.collect()}.items():
        want[r] = n
    taken = mixing.taken(texts.withColumn("__row", F.struct("doc_id", "source")), row="__row").collect()
    for r in taken:
        want[tuple(r["__row"])] += r["taken"]
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in want.items() if v}
    assert set(rows[0].asDict()) == {*texts.columns, "epoch", "epoch_"}


def test_mixing_is_native(spark, data):
    plan = queries.op13_mixing(spark, data)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_hard_negatives", "op13_mixing"])
def test_query_equals_sql(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = c.sql(queries.ORACLES[name])
    order = lambda rows, names: sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in rows), key=repr)
    assert order([tuple(r) for r in got.collect()], got.columns) == order(want.fetchall(), want.columns)
