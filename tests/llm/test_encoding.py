"""BPE, packing, audio: against the library, brute force and scalar decoders."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm import audio, bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    own = bpe.tokenizer(PATH)
    ids = own.encode([text])[0]
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert own.decode(ids).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_tree_and_matrix_agree():
    own = bpe.tokenizer(PATH)
    pieces = [b"", b"a", b"the", b" international", b"aaaaaaaa", bytes(range(8)), b"ababab", b" 12345"]
    assert own.encode_many(pieces, 16) == [np.array(own.encode_tree(p), "<u4").tobytes() for p in pieces]


def test_round_trip_of_odd_rows(odd, empty):
    got = bpe.round_trip(odd, PATH).collect()
    assert len(got) == odd.count() and bpe.round_trip(empty, PATH).count() == 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            want = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_id_columns(odd):
    assert "ids" in bpe.encode_column(odd.drop("ids"), PATH).columns


def pack_checked(docs, **options):
    limit = options.get("max_tokens", 2048)
    rows = packing.pack(docs, PATH, **options).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit and len(own) <= options.get("max_docs", limit) and sum(r["length"] ** 2 for r in own) <= options.get("max_cost", limit**2)
    return rows, len(by)


def test_packing_of_odd_rows(odd, empty):
    rows, n = pack_checked(odd, max_tokens=512)
    assert packing.pack(empty, PATH).count() == 0
    assert n == -(-sum(r["length"] for r in rows) // 512)
    for r in odd.where("doc_id in (1, 3, 5, 9)").dropDuplicates(["doc_id"]).collect():
        ids = [*LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        own = sorted((x for x in rows if x["doc_id"] == r["doc_id"]), key=lambda x: (x["piece"], x["sequence_id"]))
        for x in own:
            part = ids[x["start"] : x["start"] + x["length"]]
            assert len(part) == x["length"] and x["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert all(x["length"] == 512 for x in own if x["piece"])


@pytest.mark.parametrize("options", [{"max_docs": 3}, {"max_cost": 200_000}, {"score": "dot_product", "weights": (1.0, 1.0, 1.0), "max_docs": 5, "max_cost": 200_000}])
def test_other_capacities(spark, data, options):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 900")
    rows, _ = pack_checked(docs, max_tokens=1024, **options)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_plan_against_single_best_fit():
    random = np.random.default_rng(0)
    sizes = random.integers(1, 100, 500)
    histogram = {int(s): int((sizes == s).sum()) for s in set(sizes.tolist())}
    used = []
    for options in ({}, {"weights": (1.0, 0.0, 0.0)}, {"score": "dot_product"}):
        bins: dict[int, int] = {}
        for size, _, n, first, _, each in packing.plan(histogram, 100, 100, 10_000, **options).tolist():
            for i in range(n):
                bins[first + i // each] = bins.get(first + i // each, 0) + size
        assert sum(bins.values()) == sizes.sum() and max(bins.values()) <= 100
        used.append(len(bins))
    assert used[0] <= used[1]  # the other residuals cost no sequence
    free: list[int] = []  # one piece at a time
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(100 - s)
    assert max(used) <= len(free) + 1
    with pytest.raises(ValueError):
        packing.plan({101: 1}, 100, 10, 10_000)


def test_telephone_tables():
    # fixed points of G.711
    assert [int(audio.TABLES[audio.MULAW][c]) for c in (0x00, 0x80, 0x7F, 0xFF)] == [-32124, 32124, 0, 0]
    assert [int(audio.TABLES[audio.ALAW][c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    for tag in (audio.MULAW, audio.ALAW):
        table = audio.TABLES[tag]
        back = table[np.frombuffer(audio.compress(table.astype(np.int64), tag), np.uint8)]
        assert (back == table).all()


def test_adpcm_against_scalar():
    random = np.random.default_rng(1)
    data = bytearray(random.integers(0, 256, 3 * 36 + 20, dtype=np.uint8).tobytes())
    for b in range(0, len(data), 36):
        data[b + 2] %= 89
    out = []
    for b in range(0, len(data), 36):
        block = data[b : b + 36]
        value = int.from_bytes(block[:2], "little", signed=True)
        index = block[2]
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(audio.INDEX_CHANGE[code])))
                out.append(value)
    got = audio.decode_ima([bytes(data), b"", bytes(data[:72]), b"abc"], 36)
    assert got[0].tolist() == out and len(got[1]) == 0 and got[2].tolist() == out[:130] and len(got[3]) == 0


def test_media_column(spark):
    good = audio.wav(b"\x00\xff" * 40, audio.MULAW)
    rows = spark.createDataFrame([(1, good), (2, None), (3, b"junk"), (4, audio.wav(b"\0" * 72, audio.IMA_ADPCM, bits=4, block=36)), (5, audio.wav(b"\1\0" * 8, audio.PCM, bits=16, block=2))], "i int, media binary")
    got = {r["i"]: r for r in audio.decode_media(rows, rate=16000).collect()}
    assert got[1]["n_samples"] == 160 and got[2]["pcm"] is None and got[2]["error"] is None and got[3]["error"] and got[4]["n_samples"] == 2 * 65 * 2 and got[5]["n_samples"] == 16


def test_audio_of_odd_rows(odd, empty):
    got = audio.read_back(audio.store(odd)).collect()
    assert len(got) == odd.count() and audio.read_back(audio.store(empty)).count() == 0
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect() if r["doc_id"] is not None}
    for r in got:
        if r["doc_id"] is not None:
            data = texts[r["doc_id"]]
            padded = data + bytes(-len(data) % 64 or (0 if data else 64))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert r["media_sha256"] == hashlib.sha256(audio.wav(padded, audio.MULAW)).hexdigest()
            pcm = audio.resample(audio.TABLES[audio.MULAW][np.frombuffer(padded, np.uint8)], 8000, 16000).astype("<i2")
            assert (r["pcm_bytes"], r["pcm_sha256"]) == (2 * len(pcm), hashlib.sha256(pcm.tobytes()).hexdigest())
            (adpcm,) = audio.decode_ima([padded], 64)
            assert r["feature"] == f"pcm {audio.feature(pcm)} alaw {audio.feature(audio.TABLES[audio.ALAW][np.frombuffer(padded, np.uint8)])} ima {audio.feature(adpcm)}"


def test_audio_query_gives_the_decoded_sound(spark, data):
    """The samples themselves come with their digest, those that decode_media gives of the stored files."""
    got = {r["doc_id"]: r for r in queries.op7_telephony_audio(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {r["doc_id"]: r for r in audio.decode_media(audio.store(docs)).collect()}
    assert got.keys() == want.keys() and len(got) == docs.count()
    for i, r in got.items():
        assert bytes(r["pcm"]) == bytes(want[i]["pcm"]) and hashlib.sha256(r["pcm"]).hexdigest() == r["pcm_sha256"] and len(r["pcm"]) == r["pcm_bytes"] == 4 * r["payload_bytes"]
