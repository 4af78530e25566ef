"""Where messages come from and go to: broker, files or socket.

Every source yields the columns ``value`` (text) and, where the medium has it,
``arrival`` (timestamp). The broker format needs its connector on the class
path of the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schema


def event_source(
    spark: SparkSession,
    kind: str,
    *,
    topics: str | None = None,
    servers: str | None = None,
    path: str | None = None,
    host: str | None = None,
    port: int | None = None,
    starting_offsets: str = "latest",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Streaming frame of messages.

    ``kafka``: ``topics`` is a comma list. More input tasks than topic
    partitions come from the option ``minPartitions``, which needs no shuffle.
    ``parquet``: files of (value, arrival). ``text``: lines. ``socket``: lines.
    """
    options = options or {}
    if kind == "kafka":
        if not topics or not servers:
            raise ValueError("kafka needs topics and servers")
        raw = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("subscribe", topics)
            .option("startingOffsets", starting_offsets)
            .options(**options)
            .load()
        )
        return raw.select(
            F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrival")
        )
    if kind == "parquet":
        return spark.readStream.schema(schema.PAYLOAD).options(**options).parquet(path)
    if kind == "text":
        return spark.readStream.options(**options).text(path)
    if kind == "socket":
        return (
            spark.readStream.format("socket")
            .option("host", host)
            .option("port", port)
            .options(**options)
            .load()
        )
    raise ValueError(f"unknown source {kind!r}")


def event_sink(df: DataFrame, kind: str, *, topic: str | None = None, servers: str | None = None,
               path: str | None = None) -> None:
    """Append a batch frame with ``value`` to a broker topic or to files."""
    if kind == "kafka":
        (
            df.select("value")
            .write.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
            .save()
        )
    elif kind == "parquet":
        df.select("value", "arrival").write.mode("append").parquet(path)
    elif kind == "text":
        df.select("value").write.mode("append").text(path)
    elif kind == "console":
        df.select("value").show(truncate=False)
    else:
        raise ValueError(f"unknown sink {kind!r}")
