"""Time columns: epoch milliseconds, windows and their text labels.

Labels are built through TIMESTAMP_NTZ, so they show UTC whatever the
session time zone is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WINDOW_MS = 5000

# Epoch milliseconds of years 1 to 9999, the range a TIMESTAMP can show.
MIN_MS, MAX_MS = -62135596800000, 253402300799999


def duration(ms: int) -> str:
    """Interval text for ``window`` and ``withWatermark``."""
    return f"{ms} milliseconds"


def to_timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def ms_text(ms: Column, fraction: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC; a fraction is shown only on request."""
    whole = ms if fraction else floor_ms(ms, 1000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", whole, epoch).cast("string")


def time_text(ts: Column) -> Column:
    return ms_text(F.unix_millis(ts), fraction=True)


def floor_ms(ms: Column, size_ms: int = WINDOW_MS) -> Column:
    """Start of the tumbling window, also right before 1970."""
    return ms - F.pmod(ms, F.lit(size_ms))


def label_start(ms: Column, size_ms: int = WINDOW_MS) -> Column:
    return ms_text(floor_ms(ms, size_ms), fraction=True)


def label_end(ms: Column, size_ms: int = WINDOW_MS) -> Column:
    return ms_text(floor_ms(ms, size_ms) + size_ms, fraction=True)


def window_of(ts: Column, size_ms: int = WINDOW_MS, slide_ms: int | None = None) -> Column:
    """Tumbling window, or sliding when ``slide_ms`` is below ``size_ms``.

    ``window`` drops rows without a time, so send those to quarantine first.
    """
    if slide_ms is None or slide_ms == size_ms:
        return F.window(ts, duration(size_ms))
    return F.window(ts, duration(size_ms), duration(slide_ms))


def window_label(window: Column, label: str = "end") -> Column:
    if label not in ("start", "end"):
        raise ValueError(f"label must be 'start' or 'end', not {label!r}")
    return time_text(window.getField(label))


def lateness_seconds(send_ms: Column, device_ms: Column) -> Column:
    return (send_ms - device_ms) / F.lit(1000.0)
