"""Session settings and the shared folder for files that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: list[str] = []


def build_session(app: str = "tidemark", cpus: str | int = "*", **extra: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    n = str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster
    the executors of different machines would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        if not _LOCAL_BASE:
            _LOCAL_BASE.append(tempfile.mkdtemp(prefix="tidemark-"))
        base = _LOCAL_BASE[0]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a frame that several readers need to the shared folder and read it
    back. It outlives executors, cuts the lineage, and its size is known to the
    planner, which then broadcasts it only if it is small. The shuffle files that
    made it go once it is written, not when the driver happens to collect them."""
    folder = work_dir(df.sparkSession, "staged")
    with session_conf(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def session_conf(spark: SparkSession, **settings: str):
    """Set SQL options for the duration of a block and put the old ones back.

    Keyword names use ``__`` for the dots of the option name.
    """
    names = {key.replace("__", "."): value for key, value in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
