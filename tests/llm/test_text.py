"""Language model, repeats, quality rules, near copies and the classifier: against brute force and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import classifier, lm, quality, repeats, simhash
from tracewell.llm.common import held_out

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# language model


@pytest.mark.parametrize("shard_bytes", [lm.SHARD_BYTES, 40_000])
def test_counts_and_base_scores(spark, data, odd, monkeypatch, shard_bytes):
    monkeypatch.setattr(lm, "SHARD_BYTES", shard_bytes)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    split = [(r["doc_id"], zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 10 == 0, [*WORD.findall(lower(r["text"])), ""]) for r in rows]
    c = Counter(w for _, out, words in split if not out for w in words)
    n, v = sum(c.values()), len(c)
    want = sorted((d is None, d or 0, out, len(w), sum(1 for x in w if c[x]), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for d, out, w in split)
    got = lm.score(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_of_nothing(empty, spark):
    assert lm.score(empty).count() == 0
    only = spark.createDataFrame([(None, "a b")], "doc_id long, text string")  # held out: no training rows
    assert lm.score(only).first()["n_known"] == 0


def test_stirling_numbers():
    d, table = 0.4, lm.log_stirling(0.4, 12)

    def slow(c, t):
        if c == t == 0:
            return 1.0
        if c < t or t <= 0:
            return 0.0
        return slow(c - 1, t - 1) + (c - 1 - t * d) * slow(c - 1, t)

    for c in range(1, 10):
        for t in range(1, c + 1):
            assert math.exp(table[c, t]) == pytest.approx(slow(c, t))
    exact = lm.log_stirling(0.6, 80)[80, 3:60]
    close = lm.saddle_stirling(np.full(57, 80.0), np.arange(3.0, 60.0), 0.6)
    assert np.abs((close - exact) - (close - exact).mean()).max() < 0.25
    assert lm.log_gamma(np.array([0.5, 3.0, 50.0])) == pytest.approx([math.lgamma(x) for x in (0.5, 3.0, 50.0)], abs=1e-6)


def test_tables_as_seated_one_by_one():
    """Drawn tables of a word against a sampler that moves single customers between explicit tables."""
    strength, discount, prior, others, c = 2.0, 0.5, 0.3, 4, 6
    random = np.random.default_rng(5)
    drawn = lm.draw_tables(np.full(20000, c), np.ones(20000, np.int64), np.full(20000, float(others)), np.full(20000, prior), strength, discount, lm.log_stirling(discount, 20), lambda _: random.random(20000))
    tables, counts = [c], Counter()
    for step in range(60000):
        at = random.choice(len(tables), p=np.array(tables) / c)
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
        weights = np.array([*(t - discount for t in tables), (strength + discount * (others + len(tables))) * prior])
        at = random.choice(len(weights), p=weights / weights.sum())
        if at == len(tables):
            tables.append(1)
        else:
            tables[at] += 1
        counts[len(tables)] += step > 1000
    total = sum(counts.values())
    for t in range(1, c + 1):
        assert (drawn == t).mean() == pytest.approx(counts[t] / total, abs=0.02)


def test_many_customers_move_as_few_do():
    random, n = np.random.default_rng(2), 4000
    args = (np.full(n, 5.0), np.full(n, 0.01), 5.0, 0.6)
    exact = lm.draw_tables(np.full(n, 60), np.ones(n, np.int64), *args, lm.log_stirling(0.6, 64), lambda _: random.random(n))
    t = np.ones(n, np.int64)
    for _ in range(40):
        t = lm.draw_tables(np.full(n, 60), t, *args, lm.log_stirling(0.6, 8), lambda _: random.random(n))
    assert t.mean() == pytest.approx(exact.mean(), rel=0.06)


def keyed(docs):
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), (~held_out(10, 0)).alias("train"), F.coalesce("text", F.lit("")).alias("text"))


def sums_by_context(model):
    """Each context's predictive probabilities, summed over all words, for the rounds that are averaged; customers and parts of each."""
    facts = model.static.unionByName(model.kept).toArrow()
    out = {}
    for turn in range(model.burn_in + 1, model.burn_in + model.samples + 1):
        found: dict[int, dict] = {}
        for row in model.state.select("pack", "shard", "pairs").collect():
            told = lm.Facts(facts.filter(pa.compute.equal(facts["pack"], row["pack"])), model.parent, model.vocabulary)
            r = lm.Restaurants(row["shard"], bytes(row["pairs"]), told, model.strength, model.discount)
            t = told.tables(row["shard"], turn)
            p, prior, (customers, tables) = r.predictive(t, turn), told.prior(r.words, turn)[r.w], r.totals(t, turn)
            for i in range(len(r.c)):
                u, w = int(r.context[r.of[i]]), int(r.words[r.w[i]])
                own = found.setdefault(u, {"words": {}, "whole": set(), "shards": set()})
                assert own["words"].setdefault(w, (p[i], prior[i])) == (p[i], prior[i])  # a common pair is told alike everywhere
                own["whole"].add((int(customers[r.of[i]]), int(tables[r.of[i]])))
                own["shards"].add(row["shard"])
        for u, own in found.items():
            ((customers, tables),) = own["whole"]
            back = (model.strength + model.discount * tables) / (model.strength + customers)
            out[u, turn] = (sum(x for x, _ in own["words"].values()) + back * (1 - sum(y for _, y in own["words"].values())), customers, len(own["shards"]))
    return out


@pytest.mark.parametrize("shard_bytes", [20_000, 10**9])
def test_predictive_sums_to_one(spark, shard_bytes):
    random = np.random.default_rng(1)
    texts = [" ".join(["the", f"w{int(x)}"] * 1 + (["of", "the"] if x % 3 else ["and"])) for x in random.zipf(1.3, 6000) % 400]
    docs = spark.createDataFrame([(i, " ".join(texts[20 * i : 20 * i + 20])) for i in range(300)], "doc_id long, text string")
    model = lm.Model(keyed(docs).drop("doc_id"), shard_bytes=shard_bytes)
    found = sums_by_context(model)
    assert all(total == pytest.approx(1, abs=1e-9) for total, _, _ in found.values())
    parts = {n for _, customers, n in found.values() if customers > 1500}
    assert parts and (max(parts) > 2) == (shard_bytes < 10**6) and (len(model.common.pairs) > 0) == (shard_bytes < 10**6)
    customers, tables = model.parent[model.burn_in + model.samples]
    known = {}
    for r in model.roots.where("pack >= 0").collect():
        for w, c, n in zip(*lm.unpack(bytes(r["tables"])), strict=True):
            assert known.setdefault(int(w), (int(c), int(n))) == (int(c), int(n))
    rows = [x for x in known.values() if x[0]]
    fresh = (lm.ROOT_STRENGTH + lm.ROOT_DISCOUNT * tables) / (model.vocabulary + 1)
    mass = sum(c - lm.ROOT_DISCOUNT * n + fresh for c, n in rows) + (model.vocabulary + 1 - len(rows)) * fresh
    assert sum(c for c, _ in rows) == customers and sum(n for _, n in rows) == tables
    assert len(rows) == model.vocabulary and mass / (lm.ROOT_STRENGTH + customers) == pytest.approx(1, abs=1e-9)


def test_scores_do_not_depend_on_shards(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    whole, cut = ({r["doc_id"]: r for r in lm.score(docs, shard_bytes=n).collect()} for n in (10**9, 30_000))
    for d, r in whole.items():
        assert r["score"] == pytest.approx(cut[d]["score"], rel=1e-9) and r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))


def test_scores_of_few_rounds_are_near_those_of_many(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    few, many = (lm.score(docs, burn_in=b, samples=s).agg(F.sum("score"), F.sum("n_tokens")).first() for b, s in ((lm.BURN_IN, lm.SAMPLES), (6, 4)))
    assert abs(few[0] - many[0]) / few[1] < 2e-3


def test_packed_arrays():
    arrays = [np.array([], np.int64), np.array([5, 5, 9]), np.array([3, 1, 2**40], np.uint64), np.arange(1000, dtype=np.uint64) * np.uint64(2**50)]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert a.tolist() == b.tolist()


# repeats


def brute_repeats(texts, size, words):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    parts = [t.split() for t in texts]
    windows = Counter(tuple(p[i : i + words]) for p in parts for i in range(len(p) - words + 1))
    out = []
    for n, t in enumerate(texts):
        covered = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        spans = sum(1 for i, c in enumerate(covered) if c and (not i or not covered[i - 1]))
        told = bytearray(len(parts[n]))
        for i in range(len(parts[n]) - words + 1):
            if windows[tuple(parts[n][i : i + words])] > 1:
                told[i : i + words] = b"\1" * words
        runs = sum(1 for i, c in enumerate(told) if c and (not i or not told[i - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(t, covered, strict=True) if not c)).hexdigest(), sum(told), runs))
    return out


@pytest.mark.parametrize(("size", "words", "most", "letters"), [(12, 3, 400_000, 2), (12, 2, 30, 2), (24, 4, 400_000, 3), (24, 4, 60, 3), (40, 6, 1, 2)])
def test_repeats_of_random_texts(spark, size, words, most, letters):
    """most: bytes of an anchor's texts beyond which it is told apart by further hashes."""
    random = np.random.default_rng(size + most)
    alphabet = np.array([*range(97, 97 + letters), 32], np.uint8)
    base = [bytes(random.choice(alphabet, random.integers(0, 300))) for _ in range(40)]
    texts = [*base, *(b[5:60] + base[(i + 1) % 40][:50] for i, b in enumerate(base)), b"a" * 200, b"ab " * 70, base[0]]
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in repeats.digest_repeats(docs, size, words, anchor_bytes=most).orderBy("doc_id").collect()]
    assert got == brute_repeats(texts, size, words)


def test_a_very_common_line_and_passage(spark):
    """One line and one passage in 2000 documents of their own words: the anchors that they share are told apart."""
    random = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in random.integers(0, 10**6, n))
    line, passage = word(14), word(150)
    texts = [f"{word(40)}\n{line}\n{word(40)} {passage} {word(30)}" for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = repeats.digest_repeats(docs, 400, anchor_bytes=20_000).collect()
    start = {i: len(t.encode()) - len(t[t.index(passage) :].encode()) for i, t in enumerate(texts)}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        at = start[r["doc_id"]]
        assert 0 <= r["n_removed"] - len(passage) <= 16 and r["n_spans"] == 1 and 150 <= r["n_passage_words"] <= 153
        near = [hashlib.sha256(data[: at - a] + data[at + len(passage) + b :]).hexdigest() for a in range(17) for b in range(17) if a + b == r["n_removed"] - len(passage)]  # chance lets neighbours agree
        assert r["kept_sha256"] in near


def test_groups_tell_all_occurrences(spark):
    random = np.random.default_rng(6)
    passage = bytes(random.integers(97, 123, 60, dtype=np.uint8)).decode()
    texts = [f"{chr(65 + i) * 7}{passage}{chr(75 + i) * 9}" for i in range(5)] + [f"zz{passage[:45]}yy", passage[20:] + "x", "nothing here " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = repeats.repeat_groups(docs, repeats.byte_unit(30)).collect()
    seen: dict[bytes, set] = {}
    for t, text in enumerate(texts):
        for i in range(len(text) - 29):
            seen.setdefault(text[i : i + 30].encode(), set()).add((t, i))
    told = set()
    for r in rows:
        text = texts[r["doc_id"]][r["start"] : r["stop"]]
        same = [(t, i) for t, x in enumerate(texts) for i in range(len(x)) if x.startswith(text, i)]
        assert r["length"] == len(text) >= 30 and r["occurrences"] == len(same) > 1 and r["across"]
        told |= {(r["doc_id"], i) for i in range(r["start"], r["stop"] - 29)}
    assert {p for places in seen.values() if len(places) > 1 for p in places if texts[p[0]]} >= told
    assert {p[0] for places in seen.values() if len(places) > 1 for p in places} == {r["doc_id"] for r in rows}


def brute_maximal(texts, size):
    """(string, occurrences) of every string of size or more whose occurrences differ, or end, on both sides."""
    places: dict[bytes, list] = {}
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + size, len(text) + 1):
                places.setdefault(text[i:j], []).append((t, i))
    out = set()
    for string, own in places.items():
        left = [texts[t][i - 1 : i] or (t, i) for t, i in own]
        right = [texts[t][i + len(string) : i + len(string) + 1] or (t, i) for t, i in own]
        if len(own) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
            out.add((len(string), tuple(sorted(own))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_maximal_repeats_by_brute_force(seed):
    random = np.random.default_rng(seed)
    texts = [bytes(random.integers(97, 99 + seed % 2, random.integers(0, 40), dtype=np.uint8)) for _ in range(6)]
    unit = repeats.Unit(False, 3, 1)
    found = {(n, tuple(at)) for n, at in repeats.maximal_repeats(texts, unit)}
    assert found == brute_maximal(texts, 3)
    words = [np.frombuffer(t, np.uint8).astype(np.uint64).tobytes() for t in texts]
    assert {(n, tuple(at)) for n, at in repeats.maximal_repeats(words, repeats.Unit(True, 3, 1))} == found


def test_repeats_of_odd_rows(odd, empty):
    got = repeats.digest_repeats(odd, 400).collect()
    assert len(got) == odd.count() and repeats.digest_repeats(empty, 400).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[5]["n_removed"] == by[5]["n_bytes"] and by[4]["n_removed"] == 50000 and by[1]["n_removed"] == 0 and by[2]["n_bytes"] == 0
    assert by[5]["n_passage_words"] == by[6]["n_passage_words"] == 20000 and by[4]["n_passage_words"] == 0
    assert repeats.repeat_groups(empty, repeats.byte_unit(400)).count() == 0 and repeats.repeat_groups(odd, repeats.word_unit(50)).where("doc_id = 5").count() > 0
    cut = repeats.remove_repeats(odd, repeats.byte_unit(400))
    assert cut.columns == odd.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[5] == "" and texts[2] is None and texts[7] == {r["doc_id"]: r["text"] for r in odd.collect()}[7]


def test_removal_keeps_whole_characters(spark):
    same = "é" * 200
    docs = spark.createDataFrame([(1, "ab" + same + "cd"), (2, "xy" + same + "z")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs, repeats.byte_unit(101)).collect()} == {1: "abcd", 2: "xyz"}


def test_removal_of_words(spark):
    same = " ".join(f"é{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"one\n{same}\ttwo"), (2, "three " + same.replace(" ", "\n") + "  four")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs, repeats.word_unit(50)).collect()} == {1: "one\n\ttwo", 2: "three   four"}


# quality rules


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if seen[r] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_by_brute_force(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
    texts = docs.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *brute_counts(r["text"])) for r in texts)
    got = quality.verdicts(docs)
    rows = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])


def test_outliers_go_and_clean_rows_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.verdicts(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.2


def numpy_determinant(x, random, trials=150):
    """The least log determinant that concentration steps from random starts find, its centre and scatter."""
    h, chance, best = math.ceil(quality.SHARE * len(x)), np.diag([c**2 for c in quality.CHANCE.values()]), None
    for _ in range(trials):
        rows, last = random.choice(len(x), 6, replace=False), None
        while True:
            centre = x[rows].mean(0)
            scatter = quality.CONSISTENT * np.cov(x[rows].T, bias=True) + chance
            now = np.linalg.slogdet(scatter)[1]
            if len(rows) == h and last is not None and now > last - 1e-9:
                break
            last = now if len(rows) == h else None
            away = x - centre
            rows = np.argsort(np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter), away))[:h]
        if best is None or now < best[0]:
            best = (now, centre, scatter)
    return best


def test_determinants_by_brute_force(spark):
    random = np.random.default_rng(17)
    pools, frames = {}, []
    for name, far in (("near", 6.0), ("far", 40.0), ("many", 12.0)):
        mix = random.normal(0, 1.5, (4, 4))
        good = random.normal(0, 1, (420, 4)) @ mix + random.normal(0, 5, 4)
        bad = random.normal(0, 0.3, (200 if name == "many" else 60, 4)) + good.mean(0) + far * random.normal(0, 1, 4)
        pools[name] = np.concatenate([good, bad])
        frames += [(name, *map(float, row)) for row in pools[name]]
    frame = spark.createDataFrame(frames, "__q_pool string, " + ", ".join(f"__qx_{a} double" for a in quality.NAMES))
    found = {r["__q_pool"]: r.asDict() for r in quality.determinants(frame).collect()}
    for name, x in pools.items():
        logdet, centre, scatter = numpy_determinant(x, random)
        own = found[name]
        factor = np.array([[own[f"__ql_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        mean = np.array([own[f"__qm_{a}"] for a in quality.NAMES])
        assert own["__q_logdet"] < logdet + 0.15 and own["__q_logdet"] == pytest.approx(np.linalg.slogdet(factor @ factor.T)[1])
        distance = lambda m, k: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(k), x - m)  # noqa: B023, E731
        a, b = distance(mean, factor @ factor.T), distance(centre, scatter)
        assert np.median(np.abs(a / b - 1)) < 0.15 and ((a > quality.CUT) != (b > quality.CUT)).mean() < 0.02


def test_rules_run_no_python(spark, data, odd, empty):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = quality.verdicts(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert quality.verdicts(empty).count() == 0
    assert quality.keep(odd).columns == odd.columns


# near copies


def brute_print(text, words):
    found = WORD.findall(lower(text))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] if len(found) >= words else ([" ".join(found)] if found else [])
    import xxhash

    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def components(ids, prints, most):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most and root(i) != root(j):
                label[max(root(i), root(j))] = min(root(i), root(j))
    best: dict[int, int] = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(ids))]


def test_classes_by_brute_force(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    prints = [brute_print(r["text"], 3) for r in rows]
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, f"{p:016x}", c if c is not None else -1) for r, p, c in zip(rows, prints, components([r["doc_id"] for r in rows], prints, 3), strict=True))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in simhash.classes(docs).collect())
    assert got == want


@pytest.mark.parametrize("together", [4, 2048])
def test_links_of_crowded_prints(spark, together):
    random = np.random.default_rng(3)
    base = [int(random.integers(0, 2**63)) for _ in range(6)]
    prints = sorted({b ^ sum(1 << int(i) for i in random.choice(64, random.integers(0, 5), replace=False)) for b in base for _ in range(25)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, 3, 3, together)).collect()}
    want = components(list(range(len(prints))), prints, 3)
    groups: dict[int, set] = {}
    for s, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({g.pop() for g in groups.values()}) == len(set(want))


def test_pairs_of_unlike_signs(spark):
    """Two that share a bucket alone: their difference as a signed number has few bits, as 64 bits many."""
    far, near = -(8 << 32), -(1 << 63)
    for other, want in ((far, 0), (near, 1)):
        frame = spark.createDataFrame([(0,), (other,)], "fp long")
        assert simhash.links(frame, 3, 3).distinct().count() == want


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(1, 201)} == {0} and got[501] == 500


def test_no_rows_no_classes(empty):
    assert simhash.classes(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def jaccard(a, b):
    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (WORD.findall(lower(a)), WORD.findall(lower(b)))]
    return len(runs[0] & runs[1]) / max(1, len(runs[0] | runs[1]))


def test_one_of_each_group_stays(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 200 and 4000")
    kept = {r["doc_id"]: r["text"] for r in simhash.keep_one(docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    seen: dict[str, list[int]] = {}
    for d, t in rows:
        for w in set(WORD.findall(lower(t))):
            seen.setdefault(w, []).append(d)
    texts = dict(rows)
    near = Counter((a, b) for ds in seen.values() if 1 < len(ds) <= 12 for i, a in enumerate(sorted(ds)) for b in sorted(ds)[i + 1 :])
    close = [(a, b) for (a, b), n in near.items() if n > 5 and jaccard(texts[a], texts[b]) >= 0.8]
    assert len(close) > 50
    assert sum(1 for a, b in close if a in kept and b in kept) <= 0.03 * len(close)  # a pair at 0.8 has a stated chance to share no block
    linked = {d for (a, b) in near if jaccard(texts[a], texts[b]) >= 0.6 for d in (a, b)}
    assert {d for d, _ in rows} - set(kept) <= linked
    left = simhash.keep_one(odd).collect()
    assert len(left) == len({(r["text"] or "").lower() for r in odd.collect() if (r["text"] or "").strip()}) + 1 and simhash.keep_one(odd).columns == odd.columns


# classifier


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").limit(3000)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = classifier.fit(docs.where(~held_out(4, 2)), labels, most_rows=600)
    rows = classifier.score(docs, model, held_out(4, 2)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert right > 0.95 and sum(r["predicted"] for r in rows if r["quality"]) / sum(1 for r in rows if r["quality"]) > 0.98


def test_classifier_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, None), (7, 3), (None, 1)], "doc_id long, quality int")
    model = classifier.fit(odd, labels)
    rows = classifier.score(odd, model, F.lit(False)).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert classifier.score(empty, model, F.lit(False)).count() == 0 and classifier.keep(odd, model).columns == odd.columns
    nothing = classifier.fit(empty, labels)
    assert classifier.score(odd, nothing, F.lit(True)).first()["score"] == pytest.approx(0.5, abs=0.05)


def test_driver_gets_no_text_to_learn_from(spark, monkeypatch):
    """Features are made on the executors, and the model is that of the chosen rows in their order."""
    rows = [(i, f"{'good' if i % 2 else 'bad'} word {i} here {i % 5}") for i in range(60)]
    docs, labels = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    order = [r["doc_id"] for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()][:50]
    wanted = classifier.train([dict(rows)[i] for i in order], np.array([i % 2 for i in order]), epochs=3)

    def refuse(texts):
        raise AssertionError(f"the driver makes features of {len(texts)} texts")

    monkeypatch.setattr(classifier, "matrix", refuse)
    more = labels.unionByName(spark.range(1000, 6000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("quality")))  # of no documents
    for told in (labels, more):
        model = classifier.fit(docs, told, most_rows=50, epochs=3)
        assert np.allclose(model.scalars(), wanted.scalars(), atol=1e-5) and np.allclose(model.bias, wanted.bias, atol=1e-5)
        assert model.vectors.nbytes < 1_000_000


def test_scores_by_brute_force():
    """The score of a text from its words' vectors, averaged, through the softmax layer, as it is written down."""
    texts = ["good word here", "bad word there again again", "neither", ""]
    model = classifier.train(texts, np.array([1, 0, 1, 0]), size=4, epochs=3)
    scores = classifier.Scores(model.scalars(), float(model.bias[1] - model.bias[0]))
    for text in [*texts, "an unseen text of other words", "x" * 300]:
        vectors = [np.mean([model.vectors[b] for b in classifier.features(w)], axis=0) for w in classifier.words_of(text)]
        logits = (np.mean(vectors, axis=0) if vectors else np.zeros(4)) @ model.layer + model.bias
        assert scores.score(text) == pytest.approx(float(np.exp(logits[1]) / np.exp(logits).sum()), rel=1e-4)


def test_training_learns_a_word():
    texts = ["good word here", "bad word here"] * 40
    model = classifier.train(texts, np.array([1, 0] * 40))
    score = classifier.Scores(model.scalars(), float(model.bias[1] - model.bias[0])).score
    assert score("good word here") > 0.9 and score("bad word here") < 0.1


def test_copies_that_lack_a_passage(spark):
    random = np.random.default_rng(9)
    docs = []
    for i in range(60):
        words = [f"w{x}" for x in random.integers(0, 5000, 300)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:100] + words[130:]))]
    left = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    kept = [r["doc_id"] for r in left.collect()]
    assert all(2 * i in kept for i in range(60)) and len(kept) <= 62


def test_every_pair_at_the_similarity_is_linked(spark):
    random = np.random.default_rng(4)
    docs, pairs = [], []
    for i in range(240):
        words = [f"w{x}" for x in random.integers(0, 9000, int(random.integers(100, 300)))]
        cut, at = len(words) // 5 - 1, int(random.integers(0, len(words) // 2))
        change = [words[cut:], words[: len(words) - cut], words[:at] + words[at + cut - 4 :], words[:at] + [f"n{x}" for x in range(cut // 2 - 4)] + words[at + cut // 2 - 4 :]][i % 4]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(change))]
        pairs.append(jaccard(docs[-2][1], docs[-1][1]))
    want = {i for i, j in enumerate(pairs) if j >= 0.8}
    assert len(want) > 150 and sum(j < 0.83 for j in pairs) > 100
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i for i in range(240) if 2 * i + 1 not in kept} == want and all(2 * i in kept for i in range(240))


def test_a_group_about_the_similarity_links_as_brute_force(spark):
    random = np.random.default_rng(5)
    base, texts = [f"l{i}" for i in range(100)], []
    for i in range(150):
        words = list(base)
        for at in random.integers(0, 95, int(random.integers(1, 4))):
            words[at : at + 3] = [f"n{i}", f"m{random.integers(0, 3)}", "x"]
        texts.append(" ".join(words))
    want = list(range(150))
    for i in range(150):
        for j in range(i):
            if want[i] != want[j] and jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert 5 < len(set(want)) < 145
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for together in (16, 2048):
        roots = {r["node"]: r["root"] for r in simhash.near_components(frame, together=together).collect()}
        assert [roots.get(i, i) for i in range(150)] == want


def test_near_copies_meet_by_fingerprints_first(spark, monkeypatch):
    """Blocks of fingerprints give the pairs of few bits and of equal prints; those that aren't similar are linked by none, and the pipeline's stage asks them."""
    random = np.random.default_rng(6)
    texts = []
    for _ in range(20):
        words = [f"w{x}" for x in random.integers(0, 9000, 400)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[3:]), " ".join(words).upper()]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for t in texts]
    pairs = {tuple(sorted(map(int, r))) for r in simhash.alike(frame, 5, 3, 3).collect()}
    assert len(pairs) >= 20 and all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in pairs)
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == components(list(range(len(texts))), prints, 3)
    asked = []
    monkeypatch.setattr(simhash, "links", lambda *a, own=simhash.links: asked.append(a) or own(*a))
    assert simhash.keep_one(frame.withColumnRenamed("id", "doc_id")).count() == 20 and len(asked) == 1
