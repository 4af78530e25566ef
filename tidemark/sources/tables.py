"""Keyed tables as append-only logs of parquet.

A write appends its rows and then commits them (``commits``); nothing is rewritten,
so a reader never meets a half-replaced table and a small batch stays small. Per
key, or per key and column, the last commit counts, whichever writer it came from.
A micro-batch that is repeated after a failure is written again: of the attempts
at one batch of a run only the last is read. Writes of different runs all stay.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark import schema
from tidemark.operators import upsert
from tidemark.sources.commits import Commits

_ATTEMPT = T.StructField("attempt", T.StringType())


class KeyedTables:
    """Tables below one folder, by default those of ``schema.TABLES``.

    ``tables`` maps a name to (schema, key). The tables in ``by_column`` are
    filled by several writers, each with columns of its own.
    """

    def __init__(self, spark: SparkSession, path: str, tables=None, by_column=("agg_events",)):
        self.spark = spark
        self.path = path.rstrip("/")
        self.tables = tables or schema.TABLES
        self.by_column = by_column
        self.commits = Commits(spark, f"{self.path}/_commits")

    # -- table commands ------------------------------------------------------

    def _schema(self, name: str) -> T.StructType:
        return T.StructType([*self.tables[name][0], _ATTEMPT])

    def _empty(self, name: str, mode: str) -> None:
        rows = self.spark.createDataFrame([], self._schema(name))
        rows.write.mode(mode).parquet(f"{self.path}/{name}")

    def init(self) -> None:
        """Create the tables that do not exist yet."""
        self.commits.init()
        for name in self.tables:
            self._empty(name, "ignore")

    def reset(self) -> None:
        """Truncate all tables."""
        self.commits.clear()
        for name in self.tables:
            self._empty(name, "overwrite")

    def drop(self, name: str) -> None:
        """Delete one table if it exists."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # -- rows ----------------------------------------------------------------

    def write(self, name: str, rows: DataFrame, writer: str, batch: int = 0, run: str | None = None) -> None:
        """Upsert ``rows``; columns they lack are NULL. See ``write_all``."""
        self.write_all({name: rows}, writer, batch, run)

    def write_all(self, rows: dict[str, DataFrame], writer: str, batch: int = 0, run: str | None = None) -> None:
        """Upsert rows of several tables under one commit: a reader sees all or none.

        With ``run``, a batch that the run has committed before is replaced; without,
        the write is a run of its own. The partitions stay as the query made them,
        each file in key order."""
        attempt = uuid.uuid4().hex
        for name, frame in rows.items():
            full, key = self.tables[name]
            typed = upsert.require_keys(frame, key).select(
                *[
                    (F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in full
                ],
                F.lit(attempt).alias("attempt"),
            )
            typed.sortWithinPartitions(*key).write.mode("append").parquet(f"{self.path}/{name}")
        self.commits.add(list(rows), attempt, writer, run or attempt, batch)

    def _rows(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            raise ValueError(f"table {name} does not exist; call init()") from error

    def log(self, name: str) -> DataFrame:
        """The rows of all writes that count, with ``writer``, ``run``, ``batch`` and
        ``place``, the commit's place in the order of all."""
        return self._rows(name).join(self.commits.of(name), "attempt").drop("attempt")

    def read(self, name: str) -> DataFrame:
        """The current rows: the last commit, per key and row or, for the tables in
        ``by_column``, per key and column."""
        full, key = self.tables[name]
        log = self.log(name).drop("batch", "writer", "run")
        merge = upsert.merge_columns if name in self.by_column else upsert.latest
        order = "place" if name in self.by_column else ["place"]
        return merge(log, key, order).select(*full.fieldNames())

    def lay_out(self, name: str, buckets: int = 16) -> DataFrame:
        """The current rows once more, laid out by key: files are buckets of the first
        key column, each in key order. A read by that column opens one bucket, and
        grouping or joining by the key, the column included, needs no exchange.

        The layout is a table of the session's catalog below this folder; later
        writes aren't in it. All rows of one value of the column go to one file."""
        full, key = self.tables[name]
        label = f"{name}_{uuid.uuid4().hex}"
        rows = self.read(name).repartition(buckets, key[0])
        (
            rows.write.format("parquet").option("path", f"{self.path}/_by_key/{label}")
            .bucketBy(buckets, key[0]).sortBy(*key).saveAsTable(label)
        )
        return self.spark.table(label)

    def counts(self) -> DataFrame:
        """Rows per table."""
        return count_tables({name: self.read(name) for name in self.tables})


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for each table, also for an empty one."""
    result = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        result = row if result is None else result.unionByName(row)
    return result
