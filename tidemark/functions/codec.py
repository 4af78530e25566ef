"""Payload text to typed event columns and back, and the other text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import timewin as tw
from tidemark.functions.measures import has_decimals

# Field order and separator of the message payload.
SEPARATOR = "|"
PAYLOAD_FIELDS = ("message_id", "device_id", "device_ms", "category", "measure1", "measure2")


def encode_payload(
    message_id: Column,
    device_id: Column,
    device_ms: Column,
    category: Column,
    measure1: Column,
    measure2: Column,
) -> Column:
    """One pipe-separated line. A NULL becomes an empty field: ``concat_ws``
    alone would leave the field out and shift the ones behind it."""
    fields = (message_id, device_id, device_ms, category, measure1, measure2)
    return F.concat_ws(SEPARATOR, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def encode_events(df: DataFrame) -> Column:
    return encode_payload(*[F.col(name) for name in PAYLOAD_FIELDS])


def _once(value: Column) -> Column:
    """Evaluate an expression a single time per row.

    Catalyst copies the definition of a column into every later filter that
    uses it, so one test on a parsed field would split the line again for each
    field. It does not move filters below a generator.
    """
    return F.explode(F.array(value))


def finite(measure: Column) -> Column:
    """The measure, NULL if it is infinite or not a number. NaN is above infinity."""
    return F.when(F.abs(measure) < float("inf"), measure)


def parse_payload(df: DataFrame, value: str = "value", scale: int | None = None) -> DataFrame:
    """Add the typed event columns and ``reason``.

    ``reason`` is NULL for a good line and otherwise names the first fault, so
    a bad line neither stops the job nor vanishes. With ``scale``, a second
    measure of more decimals, or too large to count in them, is a fault. Other
    columns are kept.
    """
    keep = list(df.columns)

    def field(i: int) -> Column:
        return F.try_element_at(F.col("_parts"), F.lit(i + 1))

    millis = field(2).try_cast("bigint")
    typed = F.struct(
        F.size("_parts").alias("n"),
        field(0).alias("message_id"),
        field(1).alias("device_id"),
        F.when(millis.between(tw.MIN_MS, tw.MAX_MS), millis).alias("device_ms"),
        field(3).alias("category"),
        field(4).try_cast("bigint").alias("measure1"),
        finite(field(5).try_cast("double")).alias("measure2"),
    )
    blank = {name: F.coalesce(F.col(f"_event.{name}"), F.lit("")) == "" for name in PAYLOAD_FIELDS}
    finer = F.lit(False) if scale is None else ~has_decimals(F.col("_event.measure2"), scale)
    reason = (
        F.when(F.col(value).isNull(), "empty value")
        .when(F.col("_event.n") < len(PAYLOAD_FIELDS), "too few fields")
        .when(blank["message_id"], "empty message_id")
        .when(blank["device_id"], "empty device_id")
        .when(F.col("_event.device_ms").isNull(), "bad timestamp")
        .when(blank["category"], "empty category")
        .when(F.col("_event.measure1").isNull(), "bad measure1")
        .when(F.col("_event.measure2").isNull() | finer, "bad measure2")
    )
    return (
        df.select(*keep, _once(F.split(F.col(value), r"\|", -1)).alias("_parts"))
        .select(*keep, _once(typed).alias("_event"))
        .select(
            *keep,
            "_event.message_id",
            "_event.device_id",
            "_event.device_ms",
            tw.to_timestamp(F.col("_event.device_ms")).alias("event_time"),
            "_event.category",
            "_event.measure1",
            "_event.measure2",
            reason.alias("reason"),
        )
    )


def split_valid(parsed: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good events, quarantine) of a parsed frame."""
    good = parsed.filter(F.col("reason").isNull()).drop("reason", value)
    quarantine = parsed.filter(F.col("reason").isNotNull()).select(value, "reason")
    return good, quarantine


def parse_strict(df: DataFrame, value: str = "value", scale: int | None = None) -> DataFrame:
    """Parse and fail the job on the first bad line."""
    parsed = parse_payload(df, value, scale)
    fault = F.raise_error(F.concat(F.col("reason"), F.lit(": "), F.coalesce(value, F.lit("NULL"))))
    # A filter, because an unused checked column would be pruned.
    passed = F.when(F.col("reason").isNull(), F.lit(True)).otherwise(fault.cast("boolean"))
    return parsed.filter(passed).drop("reason", value)


# The text forms of an event, an aggregate and a window key.
def render_event(style: str = "tab") -> Column:
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PAYLOAD_FIELDS]
    if style == "tab":
        return F.concat(F.concat_ws("\t", *text), F.lit("\n"))
    if style == "comma":
        message_id, device_id, device_ms, category, measure1, measure2 = text
        return F.concat(
            message_id, F.lit(","), device_id, F.lit(", "), device_ms, F.lit(", "),
            category, F.lit(","), measure1, F.lit(", "), measure2,
        )
    raise ValueError(f"unknown style {style!r}")


def render_aggregate() -> Column:
    names = ("window_time", "device_id", "category", "m1_sum_downstream", "m2_sum_downstream")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]
    return F.concat(F.concat_ws("\t", *text), F.lit("\n"))


def debug_message(window: Column) -> Column:
    """One event of a window with the window bounds in epoch milliseconds."""
    return F.concat(
        F.lit("MESSAGE_ID="), F.col("message_id"),
        F.lit(", DEVICE_ID="), F.col("device_id"),
        F.lit(", TIMESTAMP="), F.col("device_ms").cast("string"),
        F.lit(", time window start="), F.unix_millis(window.getField("start")).cast("string"),
        F.lit(", time window end="), F.unix_millis(window.getField("end")).cast("string"),
        F.lit(", CATEGORY="), F.col("category"),
        F.lit(", M1="), F.col("measure1").cast("string"),
        F.lit(", M2="), F.col("measure2").cast("string"),
    )


def window_key_text(device_id: Column, category: Column, start_ms: Column) -> Column:
    """``[device, category@start]``"""
    return F.concat(
        F.lit("["), device_id, F.lit(", "), category, F.lit("@"), start_ms.cast("string"), F.lit("]")
    )


def parse_window_key(key: Column, size_ms: int = tw.WINDOW_MS) -> dict[str, Column]:
    """Device, category and window-end label out of a window key text."""
    bare = F.translate(key, "[]", "")
    device = F.split_part(bare, F.lit(","), F.lit(1))
    rest = F.split_part(bare, F.lit(","), F.lit(2))
    start = F.split_part(rest, F.lit("@"), F.lit(2)).try_cast("bigint")
    return {
        "device_id": device,
        "category": F.trim(F.split_part(rest, F.lit("@"), F.lit(1))),
        "window_time": tw.ms_text(start + size_ms),
    }


def demo_payload(i: Column, at_ms: Column) -> Column:
    """``user_id:{i};{time};event_number_{i}``"""
    n = i.cast("string")
    return F.concat(F.lit("user_id:"), n, F.lit(";"), tw.ms_text(at_ms), F.lit(";event_number_"), n)
