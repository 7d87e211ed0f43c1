"""Shared working storage: intermediate and derived tables live as Parquet in the checkpoint folder."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, named by spark.checkpoint.dir."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/ladderspark-{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- tables that are replaced together

END = "end"  # last line of a commit; without it the commit isn't there yet
_COMMITS = "_commits"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    found = matching(spark, f"{root}/{_COMMITS}/*.commit")
    return sorted(((int(f.rsplit("/", 1)[1].split(".")[0]), f) for f in found), reverse=True)


def _read_commit(spark: SparkSession, file: str) -> dict[str, dict] | None:
    """Table -> folder and schema; None if the commit is not complete."""
    fs, path = _fs(spark, file)
    stream = fs.open(path)
    try:
        lines = bytes(stream.readAllBytes()).decode("utf-8").split("\n")
    finally:
        stream.close()
    return {t["name"]: t for t in map(json.loads, lines[:-1])} if lines[-1] == END else None


def _current(spark: SparkSession, root: str) -> tuple[int, dict[str, dict]]:
    for number, file in _commits(spark, root):
        tables = _read_commit(spark, file)
        if tables is not None:
            return number, tables
    return 0, {}


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables under root as of one commit. What is read later stays that commit's, whatever is committed meanwhile."""
    _, tables = _current(spark, root)
    return {n: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{root}/{t['folder']}") for n, t in tables.items()}


def commit_tables(spark: SparkSession, root: str, new: dict[str, DataFrame], *, based_on: int | None = None) -> int:
    """Replace the given tables under root together, keep the others; returns the number of the commit.

    The rows are complete in new folders before anything refers to them. Then one small file, which is created only if nobody else has created it, makes all of them
    current at once: no folder is renamed, so this holds on object stores too. A reader sees the state before or after, never a mix. Whoever loses the race for the number
    gets a FileExistsError and leaves no trace but unused folders; with ``based_on`` (a number from ``version``) this also holds for any commit since then.
    """
    number, tables = _current(spark, root)
    if based_on is not None and number != based_on:
        raise FileExistsError(f"{root} is at commit {number}, not {based_on}")
    highest = max([n for n, _ in _commits(spark, root)], default=0)
    tables = dict(tables)
    folders = {name: f"data/{name}-{uuid.uuid4().hex[:12]}" for name in new}
    # Together, so that the few last tasks of one table do not keep the others waiting.
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(lambda name: new[name].write.parquet(f"{root}/{folders[name]}"), new))
    for name, df in new.items():
        tables[name] = {"name": name, "folder": folders[name], "schema": df.schema.jsonValue()}
    fs, path = _fs(spark, f"{root}/{_COMMITS}/{highest + 1:012d}.commit")
    try:
        stream = fs.create(path, False)
    except Exception as e:
        raise FileExistsError(f"another commit took number {highest + 1} of {root}") from e
    try:
        stream.write(bytearray("\n".join([*map(json.dumps, tables.values()), END]), "utf-8"))
    finally:
        stream.close()
    return highest + 1


def version(spark: SparkSession, root: str) -> int:
    """Number of the current commit, 0 if there is none."""
    return _current(spark, root)[0]


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete commits before the last ``keep`` complete ones, and the folders that only they refer to. Readers of kept commits aren't disturbed."""
    complete = [(n, f, t) for n, f in _commits(spark, root) if (t := _read_commit(spark, f)) is not None]
    used = {t["folder"] for _, _, tables in complete[:keep] for t in tables.values()}
    old = {t["folder"] for _, _, tables in complete[keep:] for t in tables.values()}
    remove(spark, [f for _, f, _ in complete[keep:]] + [f"{root}/{f}" for f in old - used])


def overwrite_table(df: DataFrame, path: str) -> DataFrame:
    """Replace all rows of a derived table in one step (S10); the input may itself read the old table."""
    spark = df.sparkSession
    commit_tables(spark, path, {"table": df})
    return read_tables(spark, path)["table"]


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of a stored table's files."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength()


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Folders and files whose path fits the pattern."""
    fs, path = _fs(spark, pattern)
    found = fs.globStatus(path)
    return [f.getPath().toString() for f in found] if found else []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for p in paths:
        fs, path = _fs(spark, p)
        fs.delete(path, True)


_tables: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that is built once per application and dataset, then read from storage."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialize(build(), name)
    return _tables[key]


def forget() -> None:
    """Drop the registry of stored tables, so that the next use builds them again."""
    _tables.clear()
