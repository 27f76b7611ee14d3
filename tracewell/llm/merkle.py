"""Merkle manifest of a dataset.

Each row is a leaf; per group the leaves in order are nodes, of which every run of FANOUT becomes their hash, until one is
left: the group's subroot. Subroots in order are the leaves of the tree that ends in the root. The tree is climbed in
aligned blocks of FANOUT ** LEVELS nodes: a block is one row with its digests as one contiguous matrix, hashed a level at
a time, a run a row of the reshaped matrix. Only blocks' tops go on to the next climb, so a table of n rows takes
log(n) / LEVELS of them. On the way down a block's path to the root goes to the blocks below it, and at the leaves every
sibling is found by index arithmetic. No group and no level is ever in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import running, trim, written

#: Nodes of a run, levels of an aligned block, bytes of a digest and of its hex text.
FANOUT, LEVELS, RAW, HEX = 8, 3, 32, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "g string, block long, total long, leaves binary, changed binary, ids binary, known binary"
PATH = "g string, at long, path array<struct<left: binary, right: binary>>, subroot binary, root binary"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def encoded(value: Column) -> Column:
    """A field of a leaf: - if null, else its length in UTF-8 bytes, a colon and its text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """SHA-256 of a row's encoded fields, its text being text."""
    fields = [encoded(text if name == "text" else F.col(name)) for name in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def height(total: int, fanout: int = FANOUT) -> int:
    """Levels above total nodes."""
    levels, there = 0, 1
    while there < total:
        levels, there = levels + 1, there * fanout
    return levels


def hexed(raw: np.ndarray) -> np.ndarray:
    """Digests, a row each, as their hex text in ASCII."""
    return np.frombuffer(raw.tobytes().hex().encode(), np.uint8).reshape(len(raw), HEX)


def unhexed(nodes: np.ndarray) -> bytes:
    return bytes.fromhex(nodes.tobytes().decode())


def level_above(nodes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The hashes of every run of fanout rows, the last of which may be shorter."""
    whole = len(nodes) // fanout * fanout
    runs = nodes[:whole].reshape(-1, fanout * HEX)
    made = [hashlib.sha256(run).digest() for run in runs] + ([hashlib.sha256(nodes[whole:].tobytes()).digest()] if whole < len(nodes) else [])
    return hexed(np.frombuffer(b"".join(made), np.uint8).reshape(-1, RAW))


def levelwise(leaves: np.ndarray, levels: int, fanout: int = FANOUT) -> list[np.ndarray]:
    """leaves and the levels above them."""
    out = [leaves]
    for _ in range(levels):
        out.append(level_above(out[-1], fanout))
    return out


def siblings(tree: list[np.ndarray], i: int, fanout: int = FANOUT) -> list[tuple[bytes, bytes]]:
    """What stands left and right of leaf i's ancestor, or itself, in its run, level by level."""
    out = []
    for nodes in tree[:-1]:
        start = i // fanout * fanout
        out.append((nodes[start:i].tobytes(), nodes[i + 1 : start + fanout].tobytes()))
        i //= fanout
    return out


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The hex digest that a hex digest and its siblings lead to."""
    for left, right in path:
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


def blocks(nodes: DataFrame, name: str) -> DataFrame:
    """NODES of nodes (g, at, total, leaf, and for documents changed and id): a row an aligned block."""
    documents = "id" in nodes.columns
    size = FANOUT**LEVELS

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table["at"]))
        one = table.slice(0, 1)
        raw = b"".join(table["leaf"].to_pylist())
        changed = known = ids = b""
        if documents:
            there = np.array(table["changed"].is_valid())
            both = np.frombuffer(raw, np.uint8).reshape(-1, RAW).copy()
            if there.any():
                both[there] = np.frombuffer(b"".join(table["changed"].drop_null().to_pylist()), np.uint8).reshape(-1, RAW)
            changed, ids, known = both.tobytes(), np.array(table["id"].fill_null(0), "<i8").tobytes(), np.array(table["id"].is_valid()).tobytes()
        return pa.table({"g": one["g"], "block": one["block"], "total": one["total"], "leaves": pa.array([raw], pa.binary()), "changed": pa.array([changed], pa.binary()), "ids": pa.array([ids], pa.binary()), "known": pa.array([known], pa.binary())})

    kept = ["g", (F.floor(F.col("at") / size)).alias("block"), "at", "total", "leaf", *(["changed", "id"] if documents else [])]
    return written(nodes.select(*kept).groupBy("g", "block").applyInArrow(pack, NODES), name)


def _tree(leaves: bytes, total: int) -> list[np.ndarray]:
    """A block's levels; those of a group whose other blocks go on climb all LEVELS, those of a lone block to its one node."""
    return levelwise(hexed(np.frombuffer(leaves, np.uint8).reshape(-1, RAW)), min(LEVELS, height(total)))


def tops(packed: DataFrame) -> DataFrame:
    """g, at, total, leaf: the blocks' top nodes, as the nodes of the next climb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = [unhexed(_tree(x.as_py(), t.as_py())[-1]) for x, t in zip(batch["leaves"], batch["total"], strict=True)]
            total = [-(-t // FANOUT**LEVELS) for t in batch["total"].to_pylist()]
            yield pa.record_batch([batch["g"], batch["block"], pa.array(total, pa.int64()), pa.array(top, pa.binary())], ["g", "at", "total", "leaf"])
        trim()

    return packed.select("g", "block", "total", "leaves").mapInArrow(run, "g string, at long, total long, leaf binary")


def climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every climb from nodes (g, at, total, leaf, ...) and the nodes that are left, one a group."""
    packed = [blocks(nodes, f"{name}-blocks")]
    levels = height(packed[0].agg(F.max("total")).first()[0] or 0)
    for _ in range(1, -(-levels // LEVELS)):
        packed.append(blocks(tops(packed[-1]), f"{name}-blocks"))
    return packed, written(tops(packed[-1]), f"{name}-tops")


def _paths(row: dict) -> tuple[list[np.ndarray], list[tuple[bytes, bytes]]]:
    return _tree(row["leaves"], row["total"]), [(x["left"], x["right"]) for x in row["path"]]


def paths_below(packed: DataFrame, above: DataFrame, own: bool) -> DataFrame:
    """PATH of each node of the blocks, given those of the blocks' tops; own: a node is its own subroot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("at", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))), ("subroot", pa.binary()), ("root", pa.binary())])
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tree, rest = _paths(row)
                rows = []
                for i, node in enumerate(tree[0]):
                    path = [{"left": a, "right": b} for a, b in (*siblings(tree, i), *rest)]
                    rows.append({"g": row["g"], "at": row["block"] * FANOUT**LEVELS + i, "path": path, "subroot": node.tobytes() if own else row["subroot"], "root": row["root"]})
                yield pa.RecordBatch.from_pylist(rows, schema)
        trim()

    return _met(packed, above).mapInArrow(run, PATH)


def _met(packed: DataFrame, above: DataFrame) -> DataFrame:
    return packed.join(above.withColumnRenamed("at", "block"), ["g", "block"])


def descend(packed: list[DataFrame], above: DataFrame, name: str, own: bool = False) -> DataFrame:
    """PATH of the nodes of the first climb, down from those of the last one's tops."""
    for p in reversed(packed):
        above = written(paths_below(p, above, own), f"{name}-paths")
    return above


def proofs(packed: DataFrame, above: DataFrame) -> DataFrame:
    """RESULT of each document of the blocks, given the PATH of their tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                tree, rest = _paths(row)
                n, beyond, reached = len(tree[0]), b"".join(a + b for a, b in rest), {}
                own, changed = tree[0], hexed(np.frombuffer(row["changed"], np.uint8).reshape(-1, RAW))
                proof, folded = [], []
                for i in range(n):
                    path = siblings(tree, i)
                    proof.append(hashlib.sha256(b"".join(a + b for a, b in path) + beyond).hexdigest())
                    top = fold(changed[i].tobytes(), path)
                    if top not in reached:
                        reached[top] = fold(top, rest).decode()
                    folded.append(reached[top])
                root, subroot = row["root"].decode(), row["subroot"].decode()
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=~np.frombuffer(row["known"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes().decode() for x in own]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), pa.array([x == root for x in folded])], names)
        trim()

    return _met(packed, above).mapInArrow(run, RESULT)


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """RESULT of each row of docs (doc_id, source, lang, n_chars, text): its leaf, its language's subroot, the root, the digest of its
    siblings, and the root that the siblings give for the row as it is now, which has text instead of its own where tampered.

    A null field is written as -; a null language is a group, the first, and null ids come before others; rows that repeat are leaves
    each, those with one id in order of their digests; texts may have any length, only digests are moved; a lone row is its own
    subroot and, alone in the table, the root; an empty table has no root and gives no rows; other columns aren't read."""
    now = F.lit(None).cast("binary") if tampered is None or text is None else F.when(tampered, leaf(text))
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = written(docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("id"), leaf(F.col("text")).alias("leaf"), now.alias("changed")), "merkle-leaves")
    one = F.lit(1).cast("long")
    placed = running(leaves, ["g"], [F.col("id").asc(), F.col("leaf").asc()], one, "n").withColumnsRenamed({"n_before": "at", "n_all": "total"})
    packed, subroots = climb(placed, "merkle")
    ordered = running(subroots.select("g", "leaf"), [], [F.col("g").asc()], one, "n").withColumnsRenamed({"n_before": "at", "n_all": "total"})
    groups = written(ordered, "merkle-groups")
    forest, root = climb(groups.withColumn("g", F.lit("")), "merkle-forest")
    last = F.encode(F.lower(F.hex("leaf")), "utf-8")
    start = root.select("g", "at", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), last.alias("subroot"), last.alias("root"))
    down = descend(forest, start, "merkle-forest", own=True).drop("g").join(groups.select("g", "at"), "at").withColumn("at", F.lit(0).cast("long"))
    paths = descend(packed[1:], written(down.select("g", "at", "path", "subroot", "root"), "merkle-paths"), "merkle")
    return proofs(packed[0], paths)


def _unrolled(levels: int = 9) -> str:
    """SQL: the tree climbed level by level, FANOUT ** levels rows a language at most (more than any table that DuckDB is asked about here has)."""

    def climb(start: str, by: str, tag: str) -> str:
        out = f"{tag}0 AS ({start})"
        for k in range(levels):
            out += f""",
            {tag}r{k} AS (SELECT {by}, i // 8 AS r, list(h ORDER BY i) AS run, any_value(n) AS n FROM {tag}{k} GROUP BY {by}, i // 8),
            {tag}{k + 1} AS (SELECT {by}, r AS i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, (n + 7) // 8 AS n FROM {tag}r{k})"""
        return out

    def descend(start: str, by: str, tag: str, p: str) -> str:
        out = f"{p}0 AS ({start})"
        for k in range(levels):
            j = "i" if k == 0 else f"i // {8**k}"
            left, right = f"array_to_string(run[:({j}) % 8], '')", f"array_to_string(run[({j}) % 8 + 2:], '')"
            out += f""",
            {p}{k + 1} AS (SELECT x.* EXCLUDE (proof, folded), CASE WHEN y.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
                CASE WHEN y.n = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded FROM {p}{k} x JOIN {tag}r{k} y ON x.{by} = y.{by} AND ({j}) // 8 = y.r)"""
        return out

    def field(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(text if name == "text" else name) for name in FIELDS) + ")"

    steps = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "bits0 AS (SELECT range AS b, range AS c FROM range(256))" + "".join(f", bits{k + 1} AS (SELECT b, {steps} AS c FROM bits{k})" for k in range(8))
    return f"""
        WITH {table}, crcs AS (SELECT list(c ORDER BY b) AS crc FROM bits8),
        ids AS (SELECT doc_id AS id, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
            lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS crc32 FROM (SELECT DISTINCT doc_id FROM documents), crcs),
        leaves AS (SELECT d.doc_id, coalesce('=' || lang, '') AS g, {digest("text")} AS leaf,
            CASE WHEN crc32 % 3 = 0 THEN {digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {digest("text")} END AS now
            FROM documents d LEFT JOIN ids ON d.doc_id IS NOT DISTINCT FROM ids.id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
        {climb("SELECT g, i, leaf AS h, n FROM placed", "g", "t")},
        subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t{levels}),
        {climb("SELECT 0 AS one, i, h, n FROM subroots", "one", "f")},
        {descend("SELECT g, i, doc_id, leaf, '' AS proof, now AS folded FROM placed", "g", "t", "p")},
        {descend(f"SELECT 0 AS one, s.i, p.doc_id, p.leaf, s.h AS subroot, p.proof, p.folded FROM p{levels} p JOIN subroots s ON p.g = s.g", "one", "f", "q")}
        SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM q{levels}, (SELECT h FROM f{levels})"""


SQL = _unrolled()
