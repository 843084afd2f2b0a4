"""A catalog that grows by small batches, kept as sorted runs in levels.

A version adds one small run to level 0 of each table it writes. When a level holds ``FANOUT`` runs of a table, they
become one run of the next level, sorted by the table's key and cut into files by ranges of it. So a table of n batches
has a number of runs that grows with the logarithm of n, and each row is rewritten as often.

A version counts once its commit is written: the list of all files that are live after it, with their levels, sizes and
least and greatest keys, and which batch of which writer it holds. It is written last, so what a crash leaves behind is
never read, and the next version takes its place. A lookup opens the files alone whose ranges can hold a wanted key.
Runs that were merged stay where they are, for readers of earlier versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import numbers_in, written

#: Runs of a level that become one of the next.
FANOUT = 8
#: Rows of a file, about.
FILE_ROWS = 1_000_000
#: Leading characters of keys by which files are chosen; so many distinct ones at most reach the driver (16**3 for hex digits).
PREFIX = 3

COMMIT = "name string, level int, run string, path string, rows long, least string, greatest string"


@dataclass(frozen=True)
class Table:
    """A table by name, its key (a string column), its columns, and how several rows of one key become one."""

    name: str
    key: str
    columns: str
    merged: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)


@dataclass(frozen=True)
class File:
    name: str
    level: int
    run: str
    path: str
    rows: int
    least: str
    greatest: str


@dataclass(frozen=True)
class Commit:
    """A version (-1: none yet), its live files, and the writer's batch that it holds."""

    version: int = -1
    files: tuple[File, ...] = ()
    writer: str = ""
    batch: int = -1


def commit_path(catalog: str, version: int) -> str:
    return f"{catalog}/commits/version={version:012d}"


def commit_at(spark: SparkSession, catalog: str, version: int) -> Commit | None:
    """A version, or None if it was never committed."""
    try:
        rows = spark.read.schema(COMMIT).parquet(commit_path(catalog, version)).collect()  # one row a file
    except AnalysisException:
        return None
    mark = next((r for r in rows if not r.name), None)
    return mark and Commit(version, tuple(File(*r) for r in rows if r.name), mark.run, mark.rows)


def versions(spark: SparkSession, catalog: str) -> list[int]:
    """All committed versions, by the names of their commits; nothing in them is read."""
    return numbers_in(spark, f"{catalog}/commits", "version")


def last_commit(spark: SparkSession, catalog: str) -> Commit:
    known = versions(spark, catalog)
    return commit_at(spark, catalog, known[-1]) if known else Commit()


def read_files(spark: SparkSession, table: Table, files: Iterable[File]) -> DataFrame:
    chosen = [f.path for f in files if f.name == table.name]
    return spark.read.schema(table.columns).parquet(*chosen) if chosen else spark.createDataFrame([], table.columns)


def count_of(files: Iterable[File], table: Table) -> int:
    return sum(f.rows for f in files if f.name == table.name)


def files_for(files: Iterable[File], table: Table, keys: DataFrame) -> list[File]:
    """The files of a table whose ranges can hold one of ``keys`` (a column named as the table's key)."""
    wanted = {r[0] for r in keys.select(F.substring(table.key, 1, PREFIX)).distinct().collect()}
    ours = [f for f in files if f.name == table.name]
    return [f for f in ours if any(f.least[:PREFIX] <= w <= f.greatest[:PREFIX] for w in wanted if w is not None)]


def lookup(spark: SparkSession, files: Iterable[File], table: Table, keys: DataFrame) -> DataFrame:
    """Merged rows of a table for ``keys``, out of the files that can hold them."""
    found = read_files(spark, table, files_for(files, table, keys))
    return table.merged(found.join(keys.select(table.key).distinct(), table.key, "left_semi"))


def write_run(spark: SparkSession, rows: DataFrame, table: Table, run: str, level: int) -> list[File]:
    """Writes a sorted run, its files apart by ranges of the key, and describes them."""
    names, key = [c.split()[0] for c in table.columns.split(", ")], F.col(table.key)
    seen = Observation()
    # written once as it comes: its number of rows tells into how many files it is sorted
    held = written(rows.select(*names).observe(seen, F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")), "run")
    n = seen.get["n"]
    dealt = held.repartitionByRange(-(-n // FILE_ROWS), table.key) if n > FILE_ROWS else held.coalesce(1)
    dealt.sortWithinPartitions(table.key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{table.key}", "true").parquet(run)
    if n <= FILE_ROWS:  # one file
        return [File(table.name, level, run, run, n, seen.get["lo"], seen.get["hi"])] if n else []
    sizes = spark.read.schema(table.columns).parquet(run).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*"), F.min(key), F.max(key))
    return [File(table.name, level, run, *r) for r in sizes.collect()]  # one row a file


def append(spark: SparkSession, catalog: str, last: Commit, added: dict[str, DataFrame], tables: dict[str, Table], writer: str, batch: int, fanout: int = FANOUT) -> Commit:
    """The version after ``last``: each table's new rows as a run of level 0, then merges of full levels, then the commit."""
    if fanout < 2:
        raise ValueError("a run of the next level takes two runs at least")
    version, files = last.version + 1, list(last.files)
    for name, rows in added.items():
        table = tables[name]
        files += write_run(spark, rows, table, f"{catalog}/runs/{name}/{version:012d}-0", 0)
        level = 0
        while len({f.run for f in files if f.name == name and f.level == level}) >= fanout:
            full = [f for f in files if f.name == name and f.level == level]
            level += 1
            made = write_run(spark, table.merged(read_files(spark, table, full)), table, f"{catalog}/runs/{name}/{version:012d}-{level}", level)
            files = [f for f in files if f not in full] + made
    rows = [(f.name, f.level, f.run, f.path, f.rows, f.least, f.greatest) for f in files]
    spark.createDataFrame([("", 0, writer, "", batch, "", ""), *rows], COMMIT).coalesce(1).write.mode("overwrite").parquet(commit_path(catalog, version))
    return Commit(version, tuple(files), writer, batch)


def keep_appending(spark: SparkSession, catalog: str, tables: dict[str, Table], writer: str, make: Callable[[DataFrame, int, Commit], dict[str, DataFrame]], fanout: int = FANOUT) -> Callable[[DataFrame, int], None]:
    """A step for ``foreachBatch``: each batch becomes one version; one that was committed already is passed over.

    Versions are listed once, when the step is made; after that each batch knows the one before it.
    """
    state = {"last": last_commit(spark, catalog)}

    def step(batch: DataFrame, number: int) -> None:
        last = state["last"]
        if (last.writer, last.batch) != (writer, number):
            state["last"] = append(batch.sparkSession, catalog, last, make(batch, number, last), tables, writer, number, fanout)

    return step
