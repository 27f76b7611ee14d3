"""Ledgers on disk: four append-only tables in segments, and a manifest for each append.

A segment is what one append brings to a table, written by Spark's own Parquet sink, whose tasks commit or abort their
files. Nothing reads a segment until a manifest that lists it is there, which comes last and under a number that only one
writer can take; what an append that failed has left behind is never read. A manifest has each file's rows, bytes and the
root of a hash tree over its rows, made from ranges of the file that are read in parallel, however large it is. Rows are
read back in the order in which they are stored, and that order is checked.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.digests import row_hash, tree_digest

#: The tables, and the columns that order each, as far as it has them.
ORDER = {"steps": ["step"], "batches": ["step", "microbatch"], "occurrences": ["step", "microbatch", "position", "token_start"], "metrics": ["step", "name"]}
TABLES = tuple(ORDER)
VERSION = 1


class LedgerError(ValueError):
    pass


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    jvm, target, system = _system(spark, path)
    found = system.globStatus(jvm.org.apache.hadoop.fs.Path(target, "manifest-*.json")) or []
    return sorted(int(f.getPath().getName()[9:-5]) for f in found)


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """The manifest under its number, whole, unless another writer has taken it."""
    jvm, target, system = _system(spark, path)
    made = jvm.org.apache.hadoop.fs.Path(target, f".manifest-{uuid.uuid4().hex}")
    stream = system.create(made, False)
    stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(made, jvm.org.apache.hadoop.fs.Path(target, f"manifest-{number:06d}.json"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        system.delete(made, False)
        raise LedgerError(f"append {number} was made by another writer") from e


def manifest(spark: SparkSession, path: str) -> dict:
    """The latest manifest."""
    numbers = _numbers(spark, path)
    if not numbers:
        raise LedgerError(f"no ledger at {path}")
    found = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest-{numbers[-1]:06d}.json").collect()))
    if found.get("schema_version") != VERSION or set(found.get("tables", {})) != set(TABLES):
        raise LedgerError("the ledger's version or tables are others")
    return found


def _segment(path: str, table: str, name: str) -> str:
    return f"{path}/{table}/{name}"


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and bytes of a segment's files."""
    jvm, target, system = _system(spark, folder)
    return {f.getPath().getName(): f.getLen() for f in system.listStatus(target) if f.getPath().getName().endswith(".parquet")}


def _told(spark: SparkSession, folder: str, most: int) -> dict[str, dict]:
    """Each file's bytes, rows and root; a file without rows has no root. most: rows of the segment."""
    stored = spark.read.parquet(folder)
    rows = stored.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("_metadata.row_index").alias("at"), row_hash(*stored.columns).alias("h"))
    roots = {r["file"]: r for r in tree_digest(rows, ["file"], "at", "h", most=most).collect()}  # a row a file
    return {name: {"bytes": size, "rows": roots[name]["n"] if name in roots else 0, "root": roots[name]["digest"] if name in roots else None} for name, size in _files(spark, folder).items()}


def _ends(rows: DataFrame, keys: list[str]) -> tuple[int, list | None, list | None]:
    """Rows, and the least and greatest key."""
    key = F.struct(*keys)
    n, first, last = rows.agg(F.count("*"), F.min(key), F.max(key)).first()
    return n, first and list(first), last and list(last)


def append(tables: dict[str, DataFrame], path: str) -> int:
    """Appends rows to each table; gives the append's number, from 0. What one appends must come after all that is there.

    Rows are sorted by step, so that a step range prunes files' row groups. A failed append changes nothing that is read."""
    if set(tables) != set(TABLES):
        raise LedgerError(f"a ledger has the tables {TABLES}")
    spark = next(iter(tables.values())).sparkSession
    before = _numbers(spark, path)
    number = before[-1] + 1 if before else 0
    found = manifest(spark, path) if before else {"schema_version": VERSION, "tables": {t: {"rows": 0, "segments": []} for t in TABLES}}
    name = f"{number:06d}-{uuid.uuid4().hex}"
    try:
        for table, rows in tables.items():
            told, folder = found["tables"][table], _segment(path, table, name)
            if told["segments"] and [list(f) for f in rows.dtypes] != told["columns"]:
                raise LedgerError(f"{table} has other columns")
            told["columns"] = [list(f) for f in rows.dtypes]
            keys = [c for c in ORDER[table] if c in rows.columns]
            rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").option("compression", "zstd").parquet(folder)
            n, first, last = _ends(spark.read.schema(rows.schema).parquet(folder), keys)
            ends = [s["last"] for s in told["segments"] if s["last"]]
            if first and ends and table in ("steps", "batches") and first <= ends[-1] or first and ends and first < ends[-1]:
                raise LedgerError(f"{table} go on from {ends[-1]}, not {first}")
            files = _told(spark, folder, n)
            told["segments"].append({"name": name, "first": first, "last": last, "files": files})
            told["rows"] += sum(f["rows"] for f in files.values())
        _publish(spark, path, number, found)
    except Exception:
        for table in TABLES:
            _, target, system = _system(spark, _segment(path, table, name))
            system.delete(target, True)
        raise
    return number


def write_ledger(tables: dict[str, DataFrame], path: str) -> None:
    """A ledger of one append; there must be none."""
    spark = next(iter(tables.values())).sparkSession
    if _numbers(spark, path):
        raise LedgerError("a ledger is there already")
    append(tables, path)


def open_ledger(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables as the latest manifest has them; with verify, after every file's bytes, rows and tree are checked."""
    found, out = manifest(spark, path), {}
    for table in TABLES:
        told = found["tables"][table]
        for s in told["segments"] if verify else ():
            folder = _segment(path, table, s["name"])
            if _files(spark, folder) != {f: x["bytes"] for f, x in s["files"].items()} or _told(spark, folder, sum(x["rows"] for x in s["files"].values())) != s["files"]:
                raise LedgerError(f"files of {table} differ from the manifest")
        schema = ", ".join(f"`{n}` {k}" for n, k in told["columns"])
        out[table] = spark.read.schema(schema).parquet(*(_segment(path, table, s["name"]) for s in told["segments"]))
    return out


def batches_between(ledger: dict[str, DataFrame], start: int, stop: int) -> DataFrame:
    """Batches of steps [start, stop), in order; a pushed-down range. Stored out of order, they are refused."""
    found = unordered_batches(ledger, start, stop).first()
    if found is not None:
        raise LedgerError(f"batches aren't strictly ordered: {tuple(found)}")
    return _between(ledger["batches"], start, stop).orderBy("step", "microbatch")


def occurrences_between(ledger: dict[str, DataFrame], start: int, stop: int) -> DataFrame:
    return _between(ledger["occurrences"], start, stop)


def _between(rows: DataFrame, start: int, stop: int | None) -> DataFrame:
    rows = rows.where(F.col("step") >= start)
    return rows if stop is None else rows.where(F.col("step") < stop)


def stored_place() -> list[Column]:
    """What orders rows as they are stored: the segment, the file's number and name, the row in the file."""
    parts = F.split("_metadata.file_path", "/")
    name = F.element_at(parts, -1)
    return [F.element_at(parts, -2).alias("__segment"), F.char_length(F.regexp_extract(name, r"^part-(\d+)", 1)).alias("__digits"), name.alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.col("_metadata.row_index").alias("__row")]


def unordered_batches(ledger: dict[str, DataFrame], start: int = 0, stop: int | None = None) -> DataFrame:
    """step, microbatch, before: batches stored after one that isn't before them; in a good ledger there are none.

    Keys alone are read. A split's rows are compared with one another in their order in the file, and the first of each with the last of the split before it."""
    key = F.struct("step", "microbatch")
    rows = _between(ledger["batches"], start, stop).select("step", "microbatch", *stored_place()).withColumn("__key", key)
    split = ["__segment", "__digits", "__file", "__split"]
    inside = rows.withColumn("before", F.lag("__key").over(Window.partitionBy(*split).orderBy("__row")))
    ends = rows.groupBy(*split).agg(F.min_by("__key", "__row").alias("__key"), F.max_by("__key", "__row").alias("__last"))  # a row a split
    across = ends.withColumn("before", F.lag("__last").over(Window.orderBy(*split)))
    both = inside.select("__key", "before").unionByName(across.select("__key", "before"))
    return both.where("before >= __key").select("__key.*", "before")


def stored_positions(rows: DataFrame, at: str) -> DataFrame:
    """rows of a stored table with their place in it, from 0: a file's rows come after those of the files before it."""
    placed = rows.select("*", *stored_place())
    files = ["__segment", "__digits", "__file"]
    counts = placed.groupBy(*files).agg((F.max("__row") + 1).alias("__n"))  # a row a file
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*files).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__file", before.alias("__before"))
    return placed.join(offsets, "__file").withColumn(at, F.col("__before") + F.col("__row")).select(*rows.columns, at)


def issues(spark: SparkSession, path: str, spans: str = "spans") -> list[str]:
    """What is wrong with a ledger whose batches list their occurrences' spans in the column of that name (an array of structs).

    Counts are held against the manifest. The occurrence table and the batches' spans must be one sequence, in stored order: both are
    numbered where they stand and digested as trees."""
    found, ledger, out = manifest(spark, path), open_ledger(spark, path, verify=False), []
    for table in TABLES:
        if ledger[table].count() != found["tables"][table]["rows"]:
            out.append(f"count of {table} differs from the manifest")
    if not unordered_batches(ledger).isEmpty():
        out.append("batches aren't strictly ordered")
    batches = stored_positions(ledger["batches"].select("step", "microbatch", spans), "__at")
    listed = sequence(batches.select("__at", F.posexplode(spans).alias("__i", "__s")).select("__at", "__i", "__s.*"), ["__at", "__i"])
    names = [f.name for f in ledger["batches"].schema[spans].dataType.elementType.fields]
    stored = stored_positions(ledger["occurrences"].select(*names), "__n")
    one, two = (tree_digest(x.select(F.lit(0).alias("g"), "__n", row_hash(*names).alias("h")), ["g"], "__n", "h").first() for x in (listed, stored))
    if (one and one["n"]) != (two and two["n"]):
        out.append("occurrences and spans differ in number")
    elif one and one["digest"] != two["digest"]:
        out.append("occurrences and spans differ in order or content")
    return out


def sequence(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with __n, their number from 0 in the order of the columns."""
    from tracewell.operators.sweep import sweep

    return sweep(rows, [], order, {"__n": ("sum", F.lit(1).cast("long"))}).withColumn("__n", F.col("__n") - 1)
