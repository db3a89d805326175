"""SQLite databases of files as one table: a Python data source whose partitions are ranges of a database's rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a range, and of a batch that leaves it.
RANGE_ROWS, BATCH_ROWS = 100_000, 4_096
_SCHEMA = pa.schema([("name", pa.string()), ("path", pa.string()), ("content", pa.string()), ("db_path", pa.string())])


def _opened(path: str):
    import sqlite3

    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return closing(db)


@dataclass
class Range(InputPartition):
    """Rows of a database from one row id to another; all of them where it has no row ids."""

    path: str
    first: int | None = None
    last: int | None = None


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, keyword: str | None, rows: int):
        self.paths, self.table, self.keyword, self.rows = paths, table, keyword, rows

    def partitions(self) -> list[InputPartition]:
        return [r for p in self.paths for r in self._ranges(p)]

    def _ranges(self, path: str) -> list[Range]:
        import sqlite3

        with _opened(path) as db:
            try:
                # both ends of the table's own index
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()  # noqa: S608
            except sqlite3.OperationalError:
                low = None
        if low is None:
            return [Range(path)]  # a view, a table without row ids, or an empty one
        return [Range(path, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no databases
            return
        conditions, values = [], []
        if partition.first is not None:
            conditions.append("rowid BETWEEN ? AND ?")
            values += [partition.first, partition.last]
        if self.keyword is not None:
            conditions.append("(name LIKE ? OR content LIKE ?)")
            values += [f"%{self.keyword}%"] * 2
        where = f" WHERE {' AND '.join(conditions)}" if conditions else ""
        text = lambda v: v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
        with _opened(partition.path) as db:
            found = db.execute(f'SELECT name, path, content FROM "{self.table}"{where}', values)  # noqa: S608
            while rows := found.fetchmany(BATCH_ROWS):
                columns = [pa.array([text(v) for v in c], pa.string()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([partition.path] * len(rows), pa.string())], schema=_SCHEMA)


class SqliteFiles(DataSource):
    """Options: ``paths`` (joined by line feeds), ``table`` (letters, digits, underscores), ``keyword``, which the database itself looks for, and ``rows``, how many a partition has."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def schema(self) -> str:
        return "name string, path string, content string, db_path string"

    def reader(self, schema) -> DataSourceReader:
        table = self.options.get("table", "files")
        if not table.replace("_", "").isalnum():
            raise ValueError("table must be a plain name")
        return _Reader([p for p in self.options["paths"].split("\n") if p], table, self.options.get("keyword"), int(self.options.get("rows", RANGE_ROWS)))


def read(spark: SparkSession, paths: list[str], table: str = "files") -> DataFrame:
    """name, path, content, db_path of all databases; a database given twice counts twice."""
    spark.dataSource.register(SqliteFiles)
    return spark.read.format("sqlite_files").option("paths", "\n".join(paths)).option("table", table).load()


def search(spark: SparkSession, paths: list[str], keyword: str, table: str = "files") -> DataFrame:
    """Rows whose name or content is like %keyword%; the condition is evaluated by SQLite, so other rows never leave it."""
    spark.dataSource.register(SqliteFiles)
    return spark.read.format("sqlite_files").option("paths", "\n".join(paths)).option("table", table).option("keyword", keyword).load()


def absolute(rows: DataFrame) -> DataFrame:
    """Adds abs_path: relative paths start at their database's BASE_PATH row."""
    base = rows.where("name = 'BASE_PATH'").groupBy("db_path").agg(F.min("path").alias("_base"))
    out = rows.join(base, "db_path", "left")
    rooted = F.col("path").rlike(r"^(/|[A-Za-z]:)") | F.col("_base").isNull()
    return out.withColumn("abs_path", F.when(rooted, F.col("path")).otherwise(F.concat_ws("/", "_base", "path"))).drop("_base")
