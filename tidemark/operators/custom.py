"""Aggregates of the caller's own, in batch and as a stream.

An aggregator has a start value, takes in rows a batch at a time, merges two values
and gives a result. In batch each task first takes in the rows of its frequent keys, so
a key that holds a third of them leaves a task as one value; rows of other keys pass as
they are, and are taken in where all of a key is together. Keys are grouped in parts, by
a hash, so that a call goes to many keys and not to each. In a stream the values are
keyed state of such parts, and the result is put out when the window closes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Any, Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import timewin as tw

# Keys whose values a task holds before it passes them on.
HELD_KEYS = 100_000
# Rows that a task looks at together, and those of a key among them that make it frequent.
LOOKED_AT = 100_000
FREQUENT = 8
# Parts that the keys are grouped in: a group costs milliseconds, its keys a fraction of one each.
PARTS = 1 << 12


@dataclass(frozen=True)
class Aggregator:
    """``start()``, ``add(value, rows)`` with a pandas frame of ``columns``, ``merge(a, b)``,
    and ``finish(value)``, a tuple for the columns of ``result`` (DDL). ``merge`` must not
    depend on order or grouping, and values must stay small whatever they took in."""

    columns: tuple[str, ...]
    result: str
    start: Callable[[], Any]
    add: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple]


def _codes(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, int]:
    """A number from 0 for the key of each row, and how many there are."""
    codes = np.zeros(table.num_rows, np.int64)
    for key in keys:
        column = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = codes * max(len(column.dictionary), 1) + column.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(wide, return_inverse=True)[1]
    return codes, int(codes.max()) + 1 if len(codes) else 0


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in order of their key, as they come, and where the rows of each key begin and end."""
    order = np.argsort(codes, kind="stable")
    ends = np.flatnonzero(np.diff(codes[order])) + 1
    return order, np.concatenate([[0], ends]), np.concatenate([ends, [len(codes)]])


def aggregate_by(df: DataFrame, keys: list[str], own: Aggregator) -> DataFrame:
    """One row per key with the columns of the result."""
    columns = [c for c in own.columns if c not in keys]
    plain = df.select(F.pmod(F.xxhash64(*keys), F.lit(PARTS)).alias("part"), *keys, *columns)
    packed = [f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema]
    wide = ", ".join([*packed, "value binary"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}

        def values() -> pa.RecordBatch:
            names = ["part", *keys]
            found = {name: pa.array([key[i] for key in held], schema.field(name).type) for i, name in enumerate(names)}
            found |= {c: pa.nulls(len(held), schema.field(c).type) for c in columns}
            found["value"] = pa.array([pickle.dumps(v) for v in held.values()], pa.binary())
            held.clear()
            return pa.RecordBatch.from_arrays(list(found.values()), list(found))

        def looked_at(table: pa.Table) -> Iterator[pa.RecordBatch]:
            codes, n = _codes(table, keys)
            often = np.bincount(codes, minlength=n)[codes] >= FREQUENT
            some = table.filter(pa.array(often))
            if some.num_rows:
                order, begins, ends = _runs(codes[often])
                some = some.take(pa.array(order))
                heads = some.take(pa.array(begins))
                frame = some.select(list(own.columns)).to_pandas()
                for key, a, b in zip(zip(*(heads.column(k).to_pylist() for k in ("part", *keys))), begins, ends):
                    held[key] = own.add(held[key] if key in held else own.start(), frame.iloc[a:b])
            rest = table.filter(pa.array(~often))
            yield from rest.append_column("value", pa.nulls(rest.num_rows, pa.binary())).to_batches()
            if len(held) > HELD_KEYS:
                yield values()

        schema, waiting, n = None, [], 0
        for batch in batches:
            schema = batch.schema
            waiting.append(batch)
            n += batch.num_rows
            if n >= LOOKED_AT:
                yield from looked_at(pa.Table.from_batches(waiting))
                waiting, n = [], 0
        if n:
            yield from looked_at(pa.Table.from_batches(waiting))
        if held:
            yield values()

    fields = [f.split() for f in own.result.split(", ")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def finish(table: pa.Table) -> pa.Table:
        order, begins, ends = _runs(_codes(table, keys)[0])
        table = table.take(pa.array(order))
        heads = table.take(pa.array(begins)).select(keys)
        packs = table.column("value")
        is_row = packs.is_null().to_numpy()
        frame = table.filter(pa.array(is_row)).select(list(own.columns)).to_pandas()
        rows_before = np.concatenate([[0], np.cumsum(is_row)])
        packs = packs.filter(pa.array(~is_row)).to_pylist()
        results = []
        for a, b in zip(begins, ends):
            i, j = rows_before[a], rows_before[b]
            found = [pickle.loads(pack) for pack in packs[a - i:b - j]]
            if j > i:
                found.append(own.add(own.start(), frame.iloc[i:j]))
            whole = found[0]
            for value in found[1:]:
                whole = own.merge(whole, value)
            results.append(own.finish(whole))
        for (name, kind), values in zip(fields, zip(*results)):
            heads = heads.append_column(name, pa.array(values, kinds[kind]))
        return heads

    parts = plain.mapInArrow(partial, wide)
    return parts.groupBy("part").applyInArrow(finish, ", ".join([*packed[1:len(keys) + 1], own.result]))


def stream_aggregate_by(windowed: DataFrame, keys: list[str], own: Aggregator) -> DataFrame:
    """The same per ``window`` of a watermarked stream, put out in append mode when the
    window closes, with ``window_time``. The frame has ``window`` and no event time."""
    kinds = {f.name: f.dataType.simpleString() for f in windowed.select(*keys).schema}
    out = ", ".join(["window_time string", *(f"{k} {kinds[k]}" for k in keys), own.result])
    names = [f.split()[0] for f in own.result.split(", ")]
    n = int(windowed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = windowed.withColumns({
        "window_time": tw.window_label(F.col("window")), "closes_ms": F.unix_millis(F.col("window.end")),
    }).select(
        "window", "window_time", "closes_ms", *keys, *[c for c in own.columns if c not in keys],
        F.pmod(F.xxhash64("window", *keys), F.lit(4 * n)).alias("part"),
    )
    by = ["closes_ms", "window_time", *keys]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for part in parts:
                # Columns of Python values, so that a missing key is None.
                table = pa.Table.from_pandas(part[by], preserve_index=False)
                order, begins, ends = _runs(_codes(table, by)[0])
                heads = zip(*(table.column(k).take(pa.array(order[begins])).to_pylist() for k in by))
                frame = part[list(own.columns)].iloc[order]
                for head, a, b in zip(heads, begins, ends):
                    held[head] = own.add(held[head] if head in held else own.start(), frame.iloc[a:b])
        watermark = state.getCurrentWatermarkMs()
        closed = [(*head[1:], *own.finish(held.pop(head))) for head in [h for h in held if h[0] <= watermark]]
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(h[0] for h in held) - 1, watermark + 1))
        elif state.exists:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=["window_time", *keys, *names])

    return keyed.groupBy("part").applyInPandasWithState(
        step, out, "value binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def _count_values(held: dict, rows: pd.DataFrame) -> dict:
    for value in rows[rows.columns[0]].to_numpy().tolist():
        if value is not None and value == value:
            held[int(value)] = held.get(int(value), 0) + 1
    return held


def _together(a: dict, b: dict) -> dict:
    return {value: a.get(value, 0) + b.get(value, 0) for value in a.keys() | b.keys()}


def _median(held: dict) -> tuple:
    total, seen = sum(held.values()), 0
    for value in sorted(held):
        seen += held[value]
        if 2 * seen >= total:
            return value, total
    return None, 0


def median_of(column: str) -> Aggregator:
    """The lower median of whole numbers and their count, exact: the value is a count for
    each different number."""
    return Aggregator((column,), "median bigint, n bigint", dict, _count_values, _together, _median)
