"""Helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows of an Arrow batch sent to Python at most. Texts of a hundred kB then take a hundred MB at most.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that a frame doesn't have, whatever the case of its own."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of a frame by name, also where a name holds a dot or a backtick."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in df.columns]


_TOOLS: dict = {}


def let_go(operator: str) -> None:
    """Give back what a Python worker holds of any other operator, also to the system: what
    has been freed would else stay with the worker and add up with the stages of a pipeline."""
    if _TOOLS.get("operator") == operator:
        return
    _TOOLS.clear()
    _TOOLS["operator"] = operator
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tool(operator: str, key, make):
    """What tasks of an operator need, made once in a Python worker. A worker that goes
    on to another operator lets go of it, so it holds the tables of one at a time."""
    let_go(operator)
    if key not in _TOOLS:
        _TOOLS[key] = make()
    return _TOOLS[key]


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` if it is larger, so that
    long texts don't make a batch outgrow a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def clean_text(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_sample(rows: DataFrame, key: str, each: int, keys: int, *order: str) -> DataFrame:
    """Up to ``each`` rows of every value of ``key``, by a hash of ``doc_id``, for at
    most ``keys`` values, the most frequent ones. Adds ``sample_rank`` and
    ``sample_total``, the rows that the value has in all. ``order`` breaks ties.

    A threshold on the hash leaves about twice the wanted rows of a value, so that
    the ranking never holds a large group."""
    marked = rows.withColumn("sample_hash", F.xxhash64("doc_id", F.lit("sample")))
    totals = {
        r[0]: r[1]
        for r in marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), key).limit(keys).collect()
    }
    share, total = F.lit(0.0), F.lit(0).cast("bigint")
    for value, n in totals.items():
        share = F.when(F.col(key) == value, F.lit(min(1.0, 2 * each / n))).otherwise(share)
        total = F.when(F.col(key) == value, F.lit(n).cast("bigint")).otherwise(total)
    place = F.pmod(F.col("sample_hash"), F.lit(1 << 30)) / float(1 << 30)
    near = marked.withColumn("sample_total", total).where((F.col("sample_total") > 0) & (place < share))
    first = Window.partitionBy(key).orderBy("sample_hash", *order)
    return near.withColumn("sample_rank", F.row_number().over(first)).where(F.col("sample_rank") <= each).drop("sample_hash")
