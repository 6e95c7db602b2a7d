"""Versioned tables in a shared folder, plus JDBC reads and small sinks.

A table is never read and overwritten in one plan: a write goes to a new version
folder, and the marker that Spark's commit leaves there makes the version current.
A failed or repeated write leaves the current version untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakesight.operators.keyed import last_write_wins
from lakesight.schema import SALES_COLUMNS, SALES_EMBEDDINGS, SALES_RAW, SNAPSHOT
from lakesight.session import spark_path

MIN_ROWS = 10

# The three tables a schema reset drops and creates.
SCHEMA_TABLES = {
    "sales_raw": SALES_RAW,
    "sales_embeddings": SALES_EMBEDDINGS,
    "batch_analytics": SNAPSHOT,
}

# What a finished write leaves in its folder.
COMMIT_MARKERS = ["_SUCCESS", "_delta_log"]


class TableStore:
    def __init__(self, spark: SparkSession, root: str, file_format: str = "parquet") -> None:
        self.spark = spark
        self.root = spark_path(root).rstrip("/")
        self.file_format = file_format

    def _files(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        folder, files = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def _committed(self, path: str) -> bool:
        folder, files = self._files(path)
        return any(files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(folder, m)) for m in COMMIT_MARKERS)

    def _newest(self, name: str, pattern: str) -> re.Match | None:
        """The highest committed folder of a table whose name fits the pattern."""
        fitting = filter(None, (re.fullmatch(pattern, n) for n in self._names(f"{self.root}/{name}")))
        for found in sorted(fitting, key=lambda m: m[0], reverse=True):
            if self._committed(f"{self.root}/{name}/{found[0]}"):
                return found
        return None

    def _claim(self, folder: str) -> int:
        """The next number of a series. Making its file succeeds for one writer only; the others go on to the next."""
        names = [*self._names(f"{folder}/claims"), *self._names(folder)]
        taken = [int(m[1]) for m in (re.fullmatch(r"[ve]?(\d+)(-e\d+)?", n) for n in names) if m]
        number = max(taken, default=0) + 1
        while True:
            path, files = self._files(f"{folder}/claims/{number:08d}")
            if files.createNewFile(path):
                return number
            number += 1

    def _save(self, rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
        """Write files that no reader takes for a table yet; returns them as read back."""
        writer = rows.write.format(self.file_format).mode("errorifexists")
        if self.file_format != "delta":
            writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.save(path)
        return self.spark.read.format(self.file_format).schema(rows.schema).load(path)

    def _commit(self, path: str) -> None:
        folder, files = self._files(path)
        if not self._committed(path):
            files.createNewFile(self.spark._jvm.org.apache.hadoop.fs.Path(folder, COMMIT_MARKERS[0]))

    def _current(self, name: str) -> tuple[int, int] | None:
        """Version number and the last edit it contains."""
        found = self._newest(name, r"v(\d+)-e(\d+)")
        return (int(found[1]), int(found[2])) if found else None

    def _edits(self, name: str) -> list[int]:
        """Numbers of the committed edits, rising."""
        folder = f"{self.root}/{name}/edits"
        numbers = sorted(int(n[1:]) for n in self._names(folder) if re.fullmatch(r"e\d+", n))
        return [n for n in numbers if self._committed(f"{folder}/e{n:08d}")]

    def _last_edit(self, name: str) -> int:
        """The last edit before which none is still being written, so that folding up to it forgets none."""
        done, last = set(self._edits(name)), 0
        for number in sorted(int(n) for n in self._names(f"{self.root}/{name}/edits/claims") if n.isdigit()):
            if number not in done:
                break
            last = number
        return last

    def last_edit(self, name: str) -> int:
        """The number of the last edit that is certain to have all earlier ones before it; 0 without edits."""
        return max(self._last_edit(name), self._current(name)[1] if self.exists(name) else 0)

    def edited_keys(self, name: str, key: str, after: int, upto: int) -> DataFrame:
        """The keys that the edits behind ``after`` put or deleted, up to ``upto``."""
        paths = [f"{self.root}/{name}/edits/e{n:08d}" for n in self._edits(name) if after < n <= upto]
        if not paths:
            return self.read(name).select(key).limit(0)
        return self.spark.read.format(self.file_format).load(paths).select(key).distinct()

    def version(self, name: str) -> int | None:
        """The current version, or None before the first write."""
        current = self._current(name)
        return current[0] if current else None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        current = self._current(name)
        if current is None:
            raise FileNotFoundError(f"table {name!r} has no version in {self.root}")
        return self.spark.read.format(self.file_format).load(self._folder(name, *current))

    def _folder(self, name: str, version: int, edit: int) -> str:
        return f"{self.root}/{name}/v{version:08d}-e{edit:08d}"

    def is_empty(self, name: str) -> bool:
        return not self.exists(name) or self.read(name).limit(1).isEmpty()

    def write(
        self, name: str, rows: DataFrame, partition_by: Sequence[str] = (), check: Callable[[DataFrame], object] | None = None
    ) -> DataFrame:
        """Publish a new version and read it back, which also cuts the lineage.

        The new rows are the whole table: edits recorded so far no longer apply. ``check``
        sees the written rows before they become the table, and raises to keep them out.
        """
        return self._publish(name, rows, self._last_edit(name), partition_by, check)

    def _publish(
        self, name: str, rows: DataFrame, edit: int, partition_by: Sequence[str] = (),
        check: Callable[[DataFrame], object] | None = None,
    ) -> DataFrame:
        path = self._folder(name, self._claim(f"{self.root}/{name}"), edit)
        saved = self._save(rows, path, partition_by)
        if check:
            check(saved)
        self._commit(path)
        return self.read(name)

    # ---- row edits ---------------------------------------------------------------------

    def edit(self, name: str, rows: DataFrame, delete: bool = False) -> None:
        """Record puts or deletes without rewriting the table.

        ``rows`` hold each key once: whole rows for a put, keys for a delete.
        """
        self.edit_all({name: rows}, delete)

    def edit_all(self, edits: dict[str, DataFrame], delete: bool = False) -> None:
        """Edits of several tables: all are written before the first becomes visible."""
        paths = []
        for name, rows in edits.items():
            number = self._claim(f"{self.root}/{name}/edits")
            columns = [
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.read(name).schema
            ]
            paths.append(f"{self.root}/{name}/edits/e{number:08d}")
            self._save(rows.select(*columns, F.lit(delete).alias("_deleted"), F.lit(number).alias("_edit")), paths[-1])
        for path in paths:
            self._commit(path)

    def current(self, name: str, key: str = "id", upto: int | None = None) -> DataFrame:
        """The table with its open edits applied, the latest edit of a key deciding.

        Few edits are broadcast against the table by their measured size, so reading
        does not shuffle it; :meth:`compact` folds them in when they grow.
        """
        base = self.read(name)
        folded = self._current(name)[1]
        open_edits = [n for n in self._edits(name) if n > folded and (upto is None or n <= upto)]
        if not open_edits:
            return base
        paths = [f"{self.root}/{name}/edits/e{n:08d}" for n in open_edits]
        changed = last_write_wins(self.spark.read.format(self.file_format).load(paths), key, ["_edit"])
        puts = changed.where(~F.col("_deleted")).select(*base.columns)
        return base.join(changed.select(key), key, "left_anti").select(*base.columns).unionByName(puts)

    def compact(self, name: str, key: str = "id") -> DataFrame:
        """Write the table with its edits folded in as the next version; edits that arrive meanwhile stay open."""
        last = self._last_edit(name)
        return self._publish(name, self.current(name, key, last), last)

    # ---- append-only tables ---------------------------------------------------------------

    def append(self, name: str, rows: DataFrame, run: str) -> None:
        """Add the rows of one run to an append-only table; a repeated run replaces its rows."""
        rows.write.format(self.file_format).mode("overwrite").save(f"{self.root}/{name}/appended/run={run}")

    def runs(self, name: str) -> list[str]:
        """The names of the finished runs of an append-only table, rising."""
        folder = f"{self.root}/{name}/appended"
        names = [n.removeprefix("run=") for n in self._names(folder) if n.startswith("run=")]
        return sorted(n for n in names if self._committed(f"{folder}/run={n}"))

    def read_run(self, name: str, run: str) -> DataFrame:
        return self.spark.read.format(self.file_format).load(f"{self.root}/{name}/appended/run={run}")

    def read_appended(self, name: str) -> DataFrame:
        """All runs, the name of each in the column ``run``."""
        path = f"{self.root}/{name}/appended"
        return self.spark.read.format(self.file_format).option("basePath", path).load(path)


def load_once(
    store: TableStore, name: str, rows: Callable[[], DataFrame], force: bool = False,
    check: Callable[[DataFrame], object] | None = None,
) -> tuple[DataFrame, bool]:
    """Write the table unless it already holds rows; says whether it was written."""
    if not force and not store.is_empty(name):
        return store.read(name), False
    return store.write(name, rows(), check=check), True


def require_rows(df: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Refuse to go on with fewer rows than a real table would have."""
    seen = df.limit(least).count()
    if seen < least:
        raise RuntimeError(f"the sales table has only {seen} rows; load it first")
    return df


def snapshot_sales(
    store: TableStore, sales: DataFrame, name: str = "sales", source: DataFrame | None = None
) -> DataFrame:
    """Guarded full refresh of the batch copy, returned as read back.

    Where the sales are the result of joins, ``source`` names the stored table whose
    rows they come from, so that the guard need not run the joins.
    """
    require_rows(sales if source is None else source)
    return store.write(name, sales)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "sales_raw",
    columns: Sequence[str] = tuple(SALES_COLUMNS),
    bounds: Sequence[str] = (),
    properties: dict[str, str] | None = None,
    key: str = "id",
) -> DataFrame:
    """Read the columns of a database table in parallel.

    ``bounds`` are rising keys; each task fetches the keys between two of them, which the
    database finds by its key index, and the first one those without a key as well. Needs
    the database's JDBC driver on the classpath.
    """
    source = f"(SELECT {', '.join(columns)} FROM {table}) AS t"
    if not bounds:
        return spark.read.jdbc(url, source, properties=properties or {})
    quoted = ["'" + b.replace("'", "''") + "'" for b in bounds]
    ranges = [f"{key} < {quoted[0]} OR {key} IS NULL"]
    ranges += [f"{key} >= {a} AND {key} < {b}" for a, b in zip(quoted, quoted[1:], strict=False)]
    ranges.append(f"{key} >= {quoted[-1]}")
    return spark.read.jdbc(url, source, predicates=ranges, properties=properties or {})


def reset_schema(spark: SparkSession, database: str, force: bool = False) -> list[str]:
    """Create the catalogue tables that are missing; ``force`` drops them first."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in SCHEMA_TABLES.items():
        if force:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return list(SCHEMA_TABLES)


def vector_report(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Is the vector column there, and do all its values have the right length?"""
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.ArrayType):
        return df.agg(
            F.lit(False).alias("has_column"), F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_bad")
        )
    right = F.coalesce(F.size(column) == dimension, F.lit(False))
    return df.agg(
        F.lit(True).alias("has_column"), F.count("*").alias("n_rows"), F.count_if(~right).alias("n_bad")
    )


def require_vectors(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Raise when a vector is missing or has another length."""
    report = vector_report(df, dimension, column).first()
    if not report["has_column"]:
        raise RuntimeError(f"column {column!r} is missing")
    if report["n_bad"]:
        raise ValueError(f"{report['n_bad']} of {report['n_rows']} vectors do not have length {dimension}")
    return df.withColumn(column, F.col(column).cast("array<float>"))


def bootstrap(spark: SparkSession, root: str) -> DataFrame:
    """Write and read back one hundred rows, to see that storage works."""
    path = f"{spark_path(root).rstrip('/')}/gold/bootstrap_metrics"
    spark.range(100).toDF("x").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The one-row summary as a JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(spark_path(path))
