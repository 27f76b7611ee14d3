"""Byte-level BPE by a segment tree over adjacent pair ranks.

A leaf holds rank * width + position of the pair that starts there; the minimum at
the root is the leftmost pair of lowest rank. A merge changes three leaves, each
with one path of minima to the root. Short pieces of a batch share one tree matrix
(one column each); long pieces get a tree of their own.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches

_SPACE = r"\p{White_Space}"
#: Fixed value: the public byte-level pre-tokenizer pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with white space spelled out, which \s of this module isn't just.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?!\P{{White_Space}})|{_SPACE}+")
#: The same for texts of ASCII only, where the sets are small.
ASCII_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
NEVER = np.int64(1) << 40
#: Pieces that a worker remembers; beyond it the memory starts afresh, results are the same.
REMEMBERED = 300_000
WIDTHS = (8, 16, 32)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where printable, else 256 and up in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.alphabet = byte_alphabet()
        as_byte = {c: b for b, c in enumerate(self.alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.array([vocab[c] for c in self.alphabet], np.int64)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(as_byte[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pair_rank = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.known: dict[str, bytes] = {}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge; b below 0 is no symbol."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((b >= 0) & (a >= 0) & (self.pair_keys[at] == keys), self.pair_ranks[at], -1)

    def encode_tree(self, piece: bytes) -> list[int]:
        """One piece by a tree of its own; O(n log n)."""
        n = len(piece)
        if n < 2:
            return [int(self.byte_ids[b]) for b in piece]
        width = 1 << (n - 1).bit_length()
        symbols = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, merged, never = self.pair_rank.get, self.merged, int(NEVER)
        tree = [never] * (2 * width)
        for i in range(n - 1):
            rank = rank_of((symbols[i], symbols[i + 1]))
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: int) -> None:
            node = width + i
            tree[node] = value
            node >>= 1
            while node:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low
                node >>= 1

        def pair(i: int) -> int:
            rank = rank_of((symbols[i], symbols[after[i]])) if after[i] < n else None
            return never if rank is None else rank * width + i

        while tree[1] < never:
            rank, i = divmod(tree[1], width)
            j = after[i]
            symbols[i] = int(merged[rank])
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, never)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of at most width bytes, a column of the tree matrix each; ids as little-endian uint32 bytes."""
        m = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, m)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        inside = np.arange(width)[:, None] < lengths
        symbols = np.full((width + 1, m), -1, np.int64)
        symbols[:width] = np.where(inside, self.byte_ids[flat.T], -1)
        after = np.repeat(np.arange(1, width + 2)[:, None], m, 1)
        after[:-1][after[:-1] >= np.maximum(lengths, 1)] = width  # the place past the end
        before = np.repeat(np.arange(-1, width)[:, None], m, 1)
        tree = np.full((2 * width, m), NEVER, np.int64)
        rank = self.ranks(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width, m)
        tree[width:] = np.where(rank >= 0, rank * width + np.arange(width)[:, None], NEVER)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])

        def put(i: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
            node = width + i
            tree[node, column] = value
            node >>= 1
            while node[0]:
                tree[node, column] = np.minimum(tree[2 * node, column], tree[2 * node + 1, column])
                node >>= 1

        while len(column := np.flatnonzero(tree[1] < NEVER)):
            rank, i = np.divmod(tree[1, column], width)
            j = after[i, column]
            symbols[i, column] = self.merged[rank]
            further = after[j, column]
            symbols[j, column] = -1
            after[i, column] = further
            before[further, column] = i
            put(j, column, np.full(len(column), NEVER))
            rank = self.ranks(symbols[i, column], symbols[further, column])
            put(i, column, np.where(rank >= 0, rank * width + i, NEVER))
            p = before[i, column]
            some = p >= 0
            p, c = p[some], column[some]
            if len(c):
                rank = self.ranks(symbols[p, c], symbols[i[some], c])
                put(p, c, np.where(rank >= 0, rank * width + p, NEVER))
        kept = symbols[:width].T
        data = kept[kept >= 0].astype("<u4").tobytes()
        ends = np.cumsum((kept >= 0).sum(1)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces and remembers them."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            width = next((w for w in WIDTHS if len(data) <= w), 0)
            groups.setdefault(width, []).append((piece, data))
        for width, group in groups.items():
            if width and len(group) > 8:
                for start in range(0, len(group), 20_000):
                    part = group[start : start + 20_000]
                    self.known.update(zip([p for p, _ in part], self.encode_many([d for _, d in part], width), strict=True))
            else:
                for piece, data in group:
                    self.known[piece] = np.array(self.encode_tree(data), "<u4").tobytes()

    def parts(self, text: str) -> list[tuple[list[str], int | None]]:
        """Runs of pieces, each with the special token that ends it."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [((ASCII_PIECES if text.isascii() else PIECES).findall(text), None)]
        out, at = [], 0
        for found in self.split_special.finditer(text):
            out.append((PIECES.findall(text[at : found.start()]), self.special[found[0]]))
            at = found.end()
        return [*out, (PIECES.findall(text[at:]), None)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.parts(t) for t in texts]
        self.learn({p for parts in split for pieces, _ in parts for p in pieces if p not in self.known})
        known = self.known.__getitem__
        special = {i: np.array([i], "<u4").tobytes() for i in self.special.values()} | {None: b""}
        return [b"".join(b"".join(map(known, pieces)) + special[end] for pieces, end in parts) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; bytes that aren't UTF-8 become U+FFFD, as the library does."""
        data = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()
        return data


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


#: Characters of text that are split at a time; bounds a worker's memory.
CHUNK = 4_000_000


def chunks(texts: list[str], size: int = CHUNK):
    """Ranges of rows of about size characters in all."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_column(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs' rows with column ids (array<int>) in the text's place; null texts give no ids."""
    rest = [c for c in docs.columns if c not in (text, "ids")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, texts = tokenizer(path), [t or "" for t in batch.column(text).to_pylist()]
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for a, b in chunks(texts) for x in bpe.encode(texts[a:b])]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(ids, pa.list_(pa.int32()))], [*rest, "ids"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return map_batches(docs.select(*rest, text), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "ids array<int>"]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    Null and empty texts: 0 tokens and the digest of nothing. A null id stays null; repeated
    rows give repeated results; an empty table gives none; other columns aren't read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, texts = tokenizer(path), [t or "" for t in batch.column("text").to_pylist()]
        counts, ids, decoded = [], [], []
        for a, b in chunks(texts):
            for data in bpe.encode(texts[a:b]):
                counts.append(len(data) // 4)
                ids.append(hashlib.sha256(data).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(data)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
