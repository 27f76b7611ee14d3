"""Telephony audio in media columns: mu-law and A-law by lookup tables, IMA ADPCM
blocks decoded by numpy across the blocks of all files of a batch, resampled 16-bit PCM, and WAV containers."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

#: WAV format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: IMA step index changes by code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: IMA step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
    544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711: inverted bits; sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711: even bits inverted; sign, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def compress(samples: np.ndarray, tag: int) -> bytes:
    """The code whose table value is nearest each sample (the lower code on ties)."""
    table = TABLES[tag].astype(np.int64)
    order = np.argsort(table, kind="stable")
    values = table[order]
    high = np.clip(np.searchsorted(values, samples), 1, 255)
    nearer = np.abs(values[high - 1] - samples) <= np.abs(values[high] - samples)
    return order[np.where(nearer, high - 1, high)].astype(np.uint8).tobytes()


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks of one size, a row each; each step decodes one code of every block."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    samples = np.empty((len(codes) + 1, len(blocks)), np.int16)
    samples[0] = value
    for i, code in enumerate(codes):
        code = code.astype(np.int32)
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, 88)
        samples[i + 1] = value
    return samples.T


def decode_ima(files: list[bytes], block: int) -> list[np.ndarray]:
    """Samples of each file's blocks, of all files at once; a last short block of a file counts by its bytes."""
    if block < 5:
        raise ValueError("an ADPCM block has a header of 4 bytes and codes")
    whole = [len(f) // block for f in files]
    joined = b"".join(f[: n * block] for f, n in zip(files, whole, strict=True))
    samples = decode_blocks(np.frombuffer(joined, np.uint8).reshape(-1, block)) if joined else np.zeros((0, 0), np.int16)
    out, at = [], 0
    for f, n in zip(files, whole, strict=True):
        parts = [samples[at : at + n].ravel()] if n else []
        at += n
        if len(f) - n * block > 4:
            parts.append(decode_blocks(np.frombuffer(f, np.uint8)[n * block :].reshape(1, -1)).ravel())
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int16))
    return out


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate, the first sample kept in place."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    n = max(1, len(samples) * to // rate)
    return np.rint(np.interp(np.arange(n) * (rate / to), np.arange(len(samples)), samples)).astype(np.int16)


def wav(data: bytes, tag: int, rate: int = 8000, bits: int = 8, block: int = 1) -> bytes:
    """A mono RIFF file; chunks are padded to even lengths."""
    form = struct.pack("<HHIIHHH", tag, 1, rate, rate * bits // 8, block, bits, 0)
    fact = struct.pack("<4sII", b"fact", 4, len(data) * 8 // bits)
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def read_wav(stored: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block bytes and data of a mono RIFF file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif name == b"data":
            data = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[1] != 1:
        raise ValueError("a mono WAV file has a format and data")
    return form[0], form[2], form[4], data


def to_pcm(stored: bytes, rate: int | None = None) -> np.ndarray:
    """16-bit samples of a mu-law, A-law, IMA ADPCM or PCM file, at a rate if one is given."""
    tag, own, block, data = read_wav(stored)
    if tag in TABLES:
        samples = TABLES[tag][np.frombuffer(data, np.uint8)]
    elif tag == IMA_ADPCM:
        (samples,) = decode_ima([data], block)
    elif tag == PCM:
        samples = np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    else:
        raise ValueError(f"format tag {tag}")
    return resample(samples, own, rate or own)


def decode_media(rows: DataFrame, media: str = "media", rate: int = 16000) -> DataFrame:
    """rows with columns pcm (16-bit little-endian at rate; null where media is null or can't
    be read), n_samples and error. Columns of these names are replaced; empty files have an error, files without
    samples an empty pcm; rows that repeat are decoded each; an empty table gives no rows."""
    rest = [c for c in rows.columns if c not in ("pcm", "n_samples", "error")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pcm, counts, errors = [], [], []
        for stored in batch.column(media).to_pylist():
            try:
                samples = None if stored is None else to_pcm(stored, rate)
                errors.append(None)
            except (ValueError, struct.error) as e:
                samples = None
                errors.append(str(e))
            pcm.append(None if samples is None else samples.astype("<i2").tobytes())
            counts.append(None if samples is None else len(samples))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(pcm, pa.binary()), pa.array(counts, pa.int64()), pa.array(errors, pa.string())], [*rest, "pcm", "n_samples", "error"])

    return map_batches(rows.select(*rest), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "pcm binary, n_samples long, error string"]))


def feature(samples: np.ndarray) -> str:
    """Samples, peak, mean square, zero crossings and the sum of absolute differences: whole numbers, so equal everywhere."""
    wide = samples.astype(np.int64)
    crossings = int(((wide[1:] >= 0) != (wide[:-1] >= 0)).sum())
    return f"n={len(wide)};peak={int(np.abs(wide).max())};ms={int((wide * wide).sum()) // len(wide)};zc={crossings};tv={int(np.abs(np.diff(wide)).sum())}"


def store(docs: DataFrame, tag: int = MULAW, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as the codes of a telephony file, zeros up to a positive multiple of 64."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, media = [], []
        for text in batch.column("text").to_pylist():
            data = (text or "").encode()
            sizes.append(len(data))
            media.append(wav(data + bytes(-len(data) % 64 or (0 if data else 64)), tag, rate))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame, rate: int = 16000, block: int = 64) -> DataFrame:
    """pcm (each stored file decoded to 16-bit samples at rate, as decode_media gives them), digests of it and of the payload read from
    the file, and features of what the payload is as mu-law (that PCM), as A-law codes and as IMA ADPCM blocks.

    Null and empty texts: 64 zero bytes. Equal texts have equal values; a null id stays null; an
    empty table gives no rows; other columns aren't read."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", "pcm"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        files = batch.column("media").to_pylist()
        payloads = [read_wav(media)[3] for media in files]
        ima = decode_ima(payloads, block)
        for media, data, adpcm in zip(files, payloads, ima, strict=True):
            pcm = to_pcm(media, rate)
            stored_pcm = pcm.astype("<i2").tobytes()
            told = f"pcm {feature(pcm)} alaw {feature(TABLES[ALAW][np.frombuffer(data, np.uint8)])} ima {feature(adpcm)}"
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), told, len(stored_pcm), hashlib.sha256(stored_pcm).hexdigest(), stored_pcm))
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])

    return map_batches(stored.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, pcm binary")
