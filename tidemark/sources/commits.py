"""The order and identity of writes to a folder of tables.

A write appends rows under an attempt of its own and then adds one commit, a small
file whose number is its place in the order of all commits. Rows of an attempt
without a commit are not seen. One commit may cover several tables, which then
change together.

A commit names its writer, run and batch. Attempts at one batch of one run of a
writer stand for each other, and the last counts; writes of different runs never
do. A stream's run is the identity that Spark keeps in its checkpoint, so a restart
from it goes on in the same run; a batch job has a fresh run unless it names one.

Numbers are taken by creating the file, which fails if it is there. File systems
where creation isn't exclusive need one writer at a time.
"""

from __future__ import annotations

import json
from typing import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

COMMIT = "place bigint, attempt string, writer string, run string, batch bigint, tables array<string>"


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._jvm = spark.sparkContext._jvm
        self._next = 0

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, place: int) -> str:
        return f"{place:015d}.json"

    def init(self) -> None:
        self._files().mkdirs(self._path())

    def clear(self) -> None:
        self._files().delete(self._path(), True)
        self._next = 0
        self.init()

    def _first_free(self, files) -> int:
        """Numbers are taken without gaps, so the first free one is found by halving."""
        taken = lambda n: n < 1 or files.exists(self._path(self._name(n)))
        low, step = max(self._next - 1, 0), 1
        if not taken(low):
            low = 0
        while taken(low + step):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if taken(middle) else (low, middle)
        return high

    def add(self, tables: Sequence[str], attempt: str, writer: str, run: str, batch: int) -> int:
        """Make the attempt's rows seen; gives its place in the order."""
        files = self._files()
        place = self._first_free(files)
        while True:
            try:
                out = files.create(self._path(self._name(place)), False)
                break
            except Py4JJavaError as error:
                if not error.java_exception.getClass().getSimpleName().endswith("FileAlreadyExistsException"):
                    raise
                place += 1
        entry = {"place": place, "attempt": attempt, "writer": writer, "run": run, "batch": batch, "tables": list(tables)}
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self._next = place + 1
        return place

    def all(self) -> DataFrame:
        """Every commit, also those that a repeated batch has replaced. A file that is
        just being written is no commit yet."""
        return self.spark.read.schema(COMMIT).json(self.folder).where("attempt IS NOT NULL AND tables IS NOT NULL")

    def of(self, table: str) -> DataFrame:
        """``attempt, writer, run, batch, place`` of the commits that count for a
        table: the last of each batch. One short row per batch."""
        last = F.max(F.struct("place", "attempt")).alias("last")
        counted = self.all().where(F.array_contains("tables", table)).groupBy("writer", "run", "batch").agg(last)
        return counted.select("last.attempt", "writer", "run", "batch", "last.place")


def checkpoint_run(spark: SparkSession, checkpoint: str) -> str:
    """The identity of the query that a checkpoint belongs to."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
