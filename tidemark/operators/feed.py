"""Reproducible event feeds with late and repeated messages.

A feed is derived from a table of readings by integer arithmetic on the
sequence number, so any engine gets the same rows in any partitioning.
Products are reduced modulo their divisor first and stay inside a bigint for
sequence numbers far beyond a trillion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import codec, timewin as tw


@dataclass(frozen=True)
class FeedPlan:
    devices: int = 4
    start_ms: int = 1704067200000
    gap_ms: int = 50
    late_permille: int = 10
    late_base_ms: int = 120000
    late_spread_ms: int = 300000
    resend_permille: int = 50


DEFAULT = FeedPlan()

# The columns of a feed.
FEED_COLUMNS = (
    "s", "message_id", "device_id", "category", "measure1", "measure2",
    "send_ms", "device_ms", "patterncode",
)


def _mixed(s: Column, factor: int, modulus: int) -> Column:
    """(s * factor) mod modulus without overflow."""
    return (s % modulus) * F.lit(factor % modulus) % modulus


def _k(props: Column) -> Column:
    """Field ``k`` of a JSON object, NULL if it is no whole number. An object that holds nothing else is read
    by a pattern, at a quarter of the cost; all others go to the JSON parser."""
    only_k = F.regexp_extract(props, r'^\s*\{\s*"k"\s*:\s*(0|-?[1-9]\d{0,17})\s*\}\s*$', 1)
    return F.coalesce(
        F.when(only_k != "", only_k.cast("bigint")), F.get_json_object(props, "$.k").try_cast("bigint")
    )


def readings(events: DataFrame, plan: FeedPlan = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sequence number, device, category and measures out of the events table."""
    return events.select(
        F.col("event_id").alias("s"),
        F.concat(F.lit("dev-"), (F.col("user_id") % plan.devices).cast("string")).alias("device_id"),
        F.col("event_type").alias("category"),
        _k(F.col("props")).alias("measure1"),
        codec.finite(F.col("value")).alias("measure2"),
        *keep,
    )


def _send_ms(plan: FeedPlan) -> Column:
    return F.lit(plan.start_ms) + F.col("s") * plan.gap_ms


def base_feed(rows: DataFrame, plan: FeedPlan = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """Give every reading a message id and a paced send time."""
    return rows.select(
        "s",
        F.concat_ws("-", "device_id", F.col("s").cast("string")).alias("message_id"),
        "device_id", "category", "measure1", "measure2",
        _send_ms(plan).alias("send_ms"),
        *keep,
    )


def mark_late(base: DataFrame, plan: FeedPlan = DEFAULT) -> DataFrame:
    """A small share carries a device time minutes before its send time."""
    s = F.col("s")
    late = _mixed(s, 7919, 1000) < plan.late_permille
    delay = F.lit(plan.late_base_ms) + _mixed(s, 104729, plan.late_spread_ms)
    return base.select(
        "*",
        F.when(late, F.col("send_ms") - delay).otherwise(F.col("send_ms")).alias("device_ms"),
        F.when(late, "late").otherwise("").alias("patterncode"),
    )


def _senders(sequence: DataFrame, plan: FeedPlan) -> DataFrame:
    """(target, again_ms): who repeats which earlier message and when."""
    return sequence.filter(_mixed(F.col("s"), 15485863, 1000) < plan.resend_permille).select(
        F.expr("s * ((s % 1000) * 31 % 1000) div 1000").alias("target"),
        (_send_ms(plan) + 1).alias("again_ms"),
    )


def _as_copies(rows: DataFrame) -> DataFrame:
    return rows.select(
        "s", "message_id", "device_id", "category", "measure1", "measure2",
        F.col("again_ms").alias("send_ms"), "device_ms", F.lit("re").alias("patterncode"),
    )


def resend(originals: DataFrame, plan: FeedPlan = DEFAULT) -> DataFrame:
    """Some rows send an earlier message once more: same id, device time and
    values, new send time.

    An equi-join on the sequence number, with the small sender side filtered
    before it.
    """
    senders = _senders(originals.select("s"), plan)
    return _as_copies(originals.join(senders, originals["s"] == senders["target"]))


def build_feed(events: DataFrame, plan: FeedPlan = DEFAULT) -> DataFrame:
    """The whole feed. It has no row order; ``send_ms`` is the arrival order.

    The repeats are joined on the events as they are stored and derived after
    that, so the rows that nobody repeats are not derived a second time.
    """
    originals = mark_late(base_feed(readings(events, plan), plan), plan)
    senders = _senders(events.select(F.col("event_id").alias("s")), plan)
    again = events.join(senders, events["event_id"] == senders["target"])
    keep = ("again_ms",)
    copies = _as_copies(mark_late(base_feed(readings(again, plan, keep), plan, keep), plan))
    return originals.unionByName(copies)


def to_payload(feed: DataFrame) -> DataFrame:
    """What a broker would hand over: the text and the time it arrived."""
    return feed.select(
        codec.encode_events(feed).alias("value"),
        tw.to_timestamp(F.col("send_ms")).alias("arrival"),
    )


def from_payload(messages: DataFrame, scale: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(events with ``send_ms`` taken from the arrival time, quarantine)."""
    good, quarantine = codec.split_valid(codec.parse_payload(messages, scale=scale))
    return good.withColumn("send_ms", F.unix_millis("arrival")), quarantine
