"""Stream jobs with keyed state of their own: late rows, and sums that take back
what an earlier copy of a message added.

They work on batches of rows in pandas, as Spark hands them to keyed state. State is
keyed by a hash of the message, so that a call takes in many messages at once. Where
the messages of a micro-batch come from several slices of a replay (``slice`` and
``watermark_ms``), the result is that of a micro-batch for each slice.
"""

from __future__ import annotations

import pickle
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import timewin as tw
from tidemark.functions.measures import PLAIN
from tidemark.operators import reconcile

LATE = "message_id string, device_id string, device_ms bigint, category string, measure1 bigint, measure2 double, send_ms bigint"


# Before any watermark.
NEVER = -(1 << 62)


def _salt(events: DataFrame, *by: str) -> Column:
    """A part of the keyed state, several for each state partition."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(*by), F.lit(4 * n))


def _slice_columns(events: DataFrame) -> dict[str, Column]:
    """``slice`` and ``watermark_ms`` without NULL, also where there are none."""
    told = "watermark_ms" in events.columns
    return {
        "slice": F.col("slice") if told else F.lit(0).cast("bigint"),
        "watermark_ms": F.coalesce("watermark_ms", F.lit(NEVER)) if told else F.lit(NEVER),
    }


def late_rows(events: DataFrame, size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """The events of a watermarked stream whose window had closed before their
    micro-batch, or slice, with ``window_end_ms`` and the ``watermark_ms`` that closed it.
    A second output beside the sums, which drop them. For append mode.

    The operator keeps no state; it is keyed, by a hash, to see the watermark.
    """
    arrival = "arrival" if "arrival" in events.columns else "device_ms"
    names = [f.split()[0] for f in LATE.split(", ")]
    keyed = events.withColumns({
        "send_ms": F.unix_millis("arrival") if "arrival" in events.columns else F.lit(None).cast("bigint"),
        "salt": _salt(events, "message_id", "device_ms", arrival),
        "watermark_ms": _slice_columns(events)["watermark_ms"],
    }).select("event_time", "salt", "watermark_ms", *names)

    def late(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        for part in parts:
            end = (part["device_ms"] // size_ms + 1) * size_ms
            told = np.maximum(part["watermark_ms"], watermark)
            closed = end <= told
            if closed.any():
                yield part.loc[closed, names].assign(window_end_ms=end[closed], watermark_ms=told[closed])

    return keyed.groupBy("salt").applyInPandasWithState(
        late, f"{LATE}, window_end_ms bigint, watermark_ms bigint", "unused int", "append", GroupStateTimeout.NoTimeout
    )


def first_within(events: DataFrame, delay_ms: int) -> DataFrame:
    """One event per message id for a delay, by the watermarks of slices: a copy is let
    through again once the watermark of its slice is ``delay_ms`` above the time of the
    one let through last. The earliest copy of a slice counts. For append mode."""
    kept = [f for f in events.schema if f.name not in ("slice", "watermark_ms")]
    names = [f.name for f in kept]
    keyed = events.withColumns({**_slice_columns(events), "salt": _salt(events, "message_id"), "at": F.unix_millis("event_time")})

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        rows = _one_per(["message_id", "slice"], parts, ["arrival"], "first").sort_values("slice").reset_index(drop=True)
        if not len(rows):
            return
        through = np.ones(len(rows), bool)
        known = rows["message_id"].isin(list(held)) | rows["message_id"].duplicated(keep=False)
        some = rows.loc[known]
        for i, message, at, watermark in zip(some.index, some["message_id"], some["at"], some["watermark_ms"]):
            through[i] = message not in held or watermark >= held[message] + delay_ms
            if through[i]:
                held[message] = int(at)
        new = rows.loc[through]
        held.update(zip(new["message_id"], new["at"].tolist()))
        least = int(rows["watermark_ms"].max()) - delay_ms
        state.update((pickle.dumps({message: at for message, at in held.items() if at > least}),))
        yield new[names]

    return keyed.groupBy("salt").applyInPandasWithState(
        step, T.StructType(kept), "held binary", "append", GroupStateTimeout.NoTimeout
    )


def _one_per(key: list[str], parts: Iterator[pd.DataFrame], order: list[str], keep: str) -> pd.DataFrame:
    """The first or last row of each key. Copies are dropped part by part, so that a
    message that floods the stream is held once."""
    def picked(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(order, na_position="first").drop_duplicates(key, keep=keep)

    found = []
    for part in parts:
        found.append(picked(part))
        if len(found) == 16:
            found = [picked(pd.concat(found))]
    return picked(pd.concat(found)) if found else pd.DataFrame(columns=[*key, *order])


def earliest_in_slices(events: DataFrame, size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """The first copy per message and window among those of a micro-batch, so that the
    slice in which a message first came is known. Keeps no state; a stream without a watermark yet."""
    times = [f.name for f in events.schema if isinstance(f.dataType, T.TimestampType)]
    plain = events.withColumns({"at": tw.floor_ms(F.unix_millis("event_time"), size_ms), **{c: F.unix_micros(c) for c in times}})

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["slice", "arrival"], na_position="first")
        return ordered.drop_duplicates(["message_id", "at"])[events_columns]

    events_columns = events.columns
    first = plain.withColumn("salt", _salt(events, "message_id")).groupBy("salt").applyInPandas(pick, plain.drop("at").schema)
    return first.withColumns({c: F.timestamp_micros(c) for c in times})


# Parts that a device and category is split into, by message, so that a busy one isn't one task's.
CLOCK_SALTS = 16


def processing_sums(events: DataFrame, measure=PLAIN, size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """Sums per window of the time of processing, closed by a timer of the clock and not
    by a watermark: a window is put out once its end has passed, also when nothing more
    arrives. A message counts once in a window. For append mode.

    Rows are parts of a window's sums, to be added up: each device and category is
    split by message. The state holds one window's message ids.
    """
    keyed = events.select(
        "message_id", "device_id", "category", "measure1", measure.pack(F.col("measure2")).cast("double").alias("m2"),
        F.pmod(F.xxhash64("message_id"), F.lit(CLOCK_SALTS)).alias("salt"),
    )
    names = ["end_ms", "device_id", "category", "m1", "m2"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        end, ids, m1, m2 = (*state.get[:1], pickle.loads(state.get[1]), *state.get[2:]) if state.exists else (None, set(), 0, 0.0)
        if end is not None and end <= now:
            yield pd.DataFrame([(end, key[0], key[1], m1, m2)], columns=names)
            state.remove()
            end, ids, m1, m2 = None, set(), 0, 0.0
        if state.hasTimedOut:
            if end is not None:
                state.setTimeoutDuration(end - now)
            return
        for part in parts:
            for message, one, two in zip(part["message_id"], part["measure1"], part["m2"]):
                if message not in ids:
                    ids.add(message)
                    m1, m2 = m1 + int(one), m2 + float(two)
        end = end or now - now % size_ms + size_ms
        state.update((end, pickle.dumps(ids), m1, m2))
        state.setTimeoutDuration(end - now)

    found = keyed.groupBy("device_id", "category", "salt").applyInPandasWithState(
        step, "end_ms bigint, device_id string, category string, m1 bigint, m2 double",
        "end_ms bigint, ids binary, m1 bigint, m2 double", "append", GroupStateTimeout.ProcessingTimeTimeout,
    )
    return found.select(tw.ms_text(F.col("end_ms")).alias("window_time"), "device_id", "category", "m1", "m2")


DELTA = T.StructType([
    T.StructField("window_time", T.StringType()), T.StructField("device_id", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("m1", T.LongType()), T.StructField("m2", T.DoubleType()),
    T.StructField("slice", T.LongType()),
])
DELTAS = {"deltas": (DELTA, reconcile.KEYS)}


def last_copy_deltas(events: DataFrame, delay_ms: int, measure=PLAIN, size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """Signed changes of the sums when the last copy per message and window counts:
    a copy that differs from the one before takes that one's values back from its
    device and category and adds its own. For update mode.

    A window closes when the watermark, the latest window end less ``delay_ms``,
    reaches its end; later copies are dropped and its messages are forgotten. Of the
    copies in a micro-batch, or slice, only the last is seen.
    """
    order = ["arrival", "device_id", "category", "measure1", "m2"]
    values = order[1:]
    closing = closes_of(events, size_ms).select(
        "message_id", "device_id", "category", "measure1", measure.pack(F.col("measure2")).cast("double").alias("m2"), "arrival",
        "closes", F.unix_millis("closes").alias("closes_ms"), *[c.alias(name) for name, c in _slice_columns(events).items()],
        _salt(events, "message_id").alias("salt"),
    ).where("closes_ms > watermark_ms").withWatermark("closes", tw.duration(delay_ms))
    names = ["closes", "device_id", "category", "m1", "m2", "slice"]

    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [pickle.loads(state.get[0])] if state.exists else []
        new = pd.DataFrame() if state.hasTimedOut else _one_per(["message_id", "closes_ms", "slice"], parts, ["slice", *order], "last")
        closed = state.getCurrentWatermarkMs()
        if len(new):
            held.append(new[["message_id", "closes_ms", "slice", "closes", *values]].assign(new=True))
            closed = max(closed, int(new["watermark_ms"].max()))
        copies = pd.concat(held).reset_index(drop=True)
        if len(new):
            copies = copies.sort_values(["message_id", "closes_ms", "new", "slice"], kind="stable").reset_index(drop=True)
            before = copies.iloc[np.maximum(np.arange(len(copies)) - 1, 0)].reset_index(drop=True)
            again = (copies["message_id"] == before["message_id"]) & (copies["closes_ms"] == before["closes_ms"]) & (copies.index > 0)
            same = again.copy()
            for c in values:
                same &= copies[c] == before[c]
            added = copies.loc[copies["new"] & ~same]
            replaced = copies["new"] & ~same & again
            taken = before.loc[replaced].assign(
                closes=copies.loc[replaced, "closes"], slice=copies.loc[replaced, "slice"],
                measure1=-before.loc[replaced, "measure1"], m2=-before.loc[replaced, "m2"],
            )
            rows = pd.concat([part for part in (added, taken) if len(part)]) if len(added) else added
            if len(rows):
                yield rows.rename(columns={"measure1": "m1"})[names].astype({"m1": "int64", "slice": "int64"})
        left = copies.drop_duplicates(["message_id", "closes_ms"], keep="last")
        left = left.loc[left["closes_ms"] > closed].assign(new=False)
        if not len(left):
            state.remove()
            return
        state.update((pickle.dumps(left),))
        state.setTimeoutTimestamp(max(int(left["closes_ms"].max()), state.getCurrentWatermarkMs()) + 1)

    return closing.groupBy("salt").applyInPandasWithState(
        change, "closes timestamp, device_id string, category string, m1 bigint, m2 double, slice bigint",
        "held binary", "update", GroupStateTimeout.EventTimeTimeout,
    )


def closes_of(events: DataFrame, size_ms: int = tw.WINDOW_MS) -> DataFrame:
    """``closes``: the end of an event's window."""
    return events.withColumn("closes", tw.to_timestamp(tw.floor_ms(F.unix_millis("event_time"), size_ms) + size_ms))


def deltas_into(tables, writer: str):
    """``foreachBatch`` function: the changes of a micro-batch, added up per key and slice."""

    def write(rows: DataFrame, batch_id: int, run: str | None = None) -> None:
        changed = rows.groupBy(tw.time_text(F.col("closes")).alias("window_time"), "device_id", "category", "slice").agg(
            F.sum("m1").alias("m1"), F.sum("m2").alias("m2")
        )
        tables.write("deltas", changed, writer, batch_id, run)

    return write


def parts_into(tables, writer: str):
    """``foreachBatch`` function: parts of window sums, added up per key."""

    def write(rows: DataFrame, batch_id: int, run: str | None = None) -> None:
        added = rows.groupBy(*reconcile.KEYS).agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
        tables.write("deltas", added, writer, batch_id, run)

    return write


def versions(tables, measure=PLAIN) -> DataFrame:
    """Every version of every sum, numbered, from the stored changes. A window's
    versions are as many as the micro-batches, or slices, that changed it."""
    so_far = Window.partitionBy(*reconcile.KEYS).orderBy("place", "slice")
    return tables.log("deltas").select(
        *reconcile.KEYS, F.row_number().over(so_far).cast("bigint").alias("version"),
        F.sum("m1").over(so_far).alias("m1_sum"), measure.unpack(F.sum("m2").over(so_far)).alias("m2_sum"),
    )
