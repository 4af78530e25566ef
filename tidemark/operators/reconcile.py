"""Truth of the sender against the result of a stream job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import timewin as tw
from tidemark.functions.measures import PLAIN
from tidemark.operators import aggregate

KEYS = ("window_time", "device_id", "category")
SIDES = ("ingest_sendtime", "ingest_devicetime", "downstream")
BASES = {"ingest_devicetime": "device_ms", "ingest_sendtime": "send_ms"}


def originals(feed: DataFrame) -> DataFrame:
    """The sender counts a message once, not its repeats."""
    return feed.filter(F.col("patterncode") != "re")


def truth(feed: DataFrame, side: str = "ingest_devicetime", measure=PLAIN) -> DataFrame:
    """Sums of the original messages by device time or by send time."""
    sums = aggregate.window_sums(
        originals(feed), tw.to_timestamp(F.col(BASES[side])), measure
    )
    return as_side(sums, side)


def as_side(sums: DataFrame, side: str) -> DataFrame:
    """Name the sums after the writer they belong to."""
    return sums.select(
        *KEYS, F.col("m1_sum").alias(f"m1_sum_{side}"), F.col("m2_sum").alias(f"m2_sum_{side}")
    )


def merge_sides(*sides: DataFrame) -> DataFrame:
    """Wide rows out of frames that hold different columns of the same key, each
    key at most once per frame. A missing side stays NULL.

    Union and one grouped sum: one shuffle, where full outer joins need one per
    side and cannot combine before it.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    sums = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in sums])


def reconcile(feed: DataFrame, downstream_parts: DataFrame | None, measure=PLAIN) -> DataFrame:
    """Both truths of a feed and the downstream sums, one wide row per key. Without
    downstream sums, both truths.

    The events go into the grouping as they are, once per time basis, next to
    the packed partial sums of the stream job (``window``, device, category,
    ``m1``, ``m2``). All sums finish in a single shuffle and the originals are
    read once for both truths.
    """
    basis = F.explode(
        F.array(*[
            F.struct(F.lit(side).alias("side"), F.col(ms).alias("ms")) for side, ms in BASES.items()
        ])
    )
    packed = originals(feed).select(
        "device_id", "category",
        F.col("measure1").alias("m1"),
        measure.pack(F.col("measure2")).alias("m2"),
        basis.alias("basis"),
    )
    truths = packed.select(
        F.col("basis.side").alias("side"),
        tw.floor_ms(F.col("basis.ms")).alias("start_ms"),
        "device_id", "category", "m1", "m2",
    )
    sides = SIDES
    if downstream_parts is None:
        sides = tuple(side for side in SIDES if side in BASES)
    else:
        parts = downstream_parts.select(
            F.lit("downstream").alias("side"),
            F.unix_millis(F.col("window.start")).alias("start_ms"),
            "device_id", "category", "m1", "m2",
        )
        truths = truths.unionByName(parts)
    sums = []
    for side in sides:
        mine = F.col("side") == side
        sums += [F.sum(F.when(mine, F.col(m))).alias(f"{m}_sum_{side}") for m in ("m1", "m2")]
    wide = truths.groupBy("start_ms", "device_id", "category").agg(*sums)
    return wide.select(
        tw.label_end(F.col("start_ms")).alias("window_time"),
        "device_id", "category",
        *[f"m1_sum_{side}" for side in sides],
        *[measure.unpack(F.col(f"m2_sum_{side}")).alias(f"m2_sum_{side}") for side in sides],
    )


def with_deltas(wide: DataFrame, measure=PLAIN) -> DataFrame:
    """Downstream minus truth by device time. A side that is text, as some jobs
    write it, is read as a number."""
    def delta(m: str, kind: str):
        return F.col(f"{m}_sum_downstream").cast(kind) - F.col(f"{m}_sum_ingest_devicetime").cast(kind)

    m2 = measure.unpack(
        measure.pack(F.col("m2_sum_downstream").cast("double"))
        - measure.pack(F.col("m2_sum_ingest_devicetime").cast("double"))
    )
    return wide.withColumns(
        {
            "delta_m1_sum_downstream_ingestdevice": delta("m1", "bigint"),
            "delta_m2_sum_downstream_ingestdevice": m2,
        }
    )


def is_exception():
    """A delta that is not zero. A missing side has a NULL delta and counts."""
    return ~F.col("delta_m1_sum_downstream_ingestdevice").eqNullSafe(F.lit(0))


# Columns of the report and of the list of exceptions, in their order.
REPORT = (
    "category", "window_time", "m1_sum_ingest_devicetime", "m1_sum_downstream",
    "delta_m1_sum_downstream_ingestdevice", "m1_sum_ingest_sendtime",
    "m2_sum_ingest_devicetime", "m2_sum_downstream",
    "delta_m2_sum_downstream_ingestdevice", "m2_sum_ingest_sendtime", "device_id",
)
EXCEPTION = (
    "window_time", "device_id", "category", "m1_sum_ingest_devicetime", "m1_sum_downstream",
    "delta_m1_sum_downstream_ingestdevice",
)


def report(wide: DataFrame, measure=PLAIN) -> DataFrame:
    """All keys with both deltas, in the order device, category, window."""
    return with_deltas(wide, measure).select(*REPORT).orderBy("device_id", "category", "window_time")


def exceptions(wide: DataFrame, measure=PLAIN) -> DataFrame:
    return with_deltas(wide, measure).filter(is_exception()).select(*EXCEPTION)


def counts(wide: DataFrame, measure=PLAIN) -> DataFrame:
    """One row: exceptions, all keys, and the sentence a user reads."""
    totals = with_deltas(wide, measure).agg(
        F.count_if(is_exception()).alias("exceptions"), F.count(F.lit(1)).alias("total")
    )
    return totals.withColumn(
        "summary", F.format_string("%d exceptions out of %d", "exceptions", "total")
    )
