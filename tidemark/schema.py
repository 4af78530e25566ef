"""Schemas of the event contract and of the three stored tables. Column names and
order are fixed values."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One message as a broker delivers it: the payload text and its arrival time.
PAYLOAD = _schema(("value", T.StringType()), ("arrival", T.TimestampType()))

EVENT = _schema(
    ("message_id", T.StringType()),
    ("device_id", T.StringType()),
    ("device_ms", T.LongType()),
    ("event_time", T.TimestampType()),
    ("category", T.StringType()),
    ("measure1", T.LongType()),
    ("measure2", T.DoubleType()),
)

RAW_EVENTS = _schema(
    ("message_id", T.StringType()),
    ("device_id", T.StringType()),
    ("device_time", T.TimestampType()),
    ("send_time", T.TimestampType()),
    ("category", T.StringType()),
    ("measure1", T.LongType()),
    ("measure2", T.DoubleType()),
)
RAW_EVENTS_KEY = ("message_id", "send_time")

AGG_EVENTS = _schema(
    ("window_time", T.StringType()),
    ("device_id", T.StringType()),
    ("category", T.StringType()),
    ("m1_sum_ingest_sendtime", T.LongType()),
    ("m1_sum_ingest_devicetime", T.LongType()),
    ("m1_sum_downstream", T.LongType()),
    ("m2_sum_ingest_sendtime", T.DoubleType()),
    ("m2_sum_ingest_devicetime", T.DoubleType()),
    ("m2_sum_downstream", T.DoubleType()),
)
AGG_EVENTS_KEY = ("device_id", "category", "window_time")

DEBUG = _schema(("id", T.StringType()), ("message", T.StringType()))
DEBUG_KEY = ("id",)

# name -> (schema, key); the key order is also the stored order.
TABLES = {
    "raw_events": (RAW_EVENTS, RAW_EVENTS_KEY),
    "agg_events": (AGG_EVENTS, AGG_EVENTS_KEY),
    "debug": (DEBUG, DEBUG_KEY),
}

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def of(text: str) -> T.StructType:
    """A schema out of "name type, name type"; unlike Spark's own parser it needs no session."""
    return _schema(*((name, _KINDS[kind]) for name, kind in (field.split() for field in text.split(", "))))
