"""Insert-or-replace on a key, as pure DataFrame functions.

Both forms are a union and one grouped aggregate, so repeated writes of a hot
key are combined before the shuffle. Applying the same rows twice changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def require_keys(df: DataFrame, keys) -> DataFrame:
    """Fail on a row without a full key instead of storing it."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    names = ", ".join(keys)
    fault = F.raise_error(F.lit(f"NULL in key ({names})")).cast("boolean")
    return df.filter(F.when(missing, fault).otherwise(F.lit(True)))


def latest(log: DataFrame, keys, order) -> DataFrame:
    """The last written row per key. Rows equal in ``order`` are told apart by
    their values, never by their position."""
    keys, order = list(keys), list(order)
    rest = [c for c in log.columns if c not in keys and c not in order]
    return (
        log.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def merge_columns(log: DataFrame, keys, order: str) -> DataFrame:
    """Per key and column the last value that was written; a column a writer
    leaves NULL is untouched."""
    keys = list(keys)
    rest = [c for c in log.columns if c not in keys and c != order]
    picks = [
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in rest
    ]
    return log.groupBy(*keys).agg(*picks)


def _stacked(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("_seq", F.lit(0)).unionByName(
        new.withColumn("_seq", F.lit(1)), allowMissingColumns=True
    )


def upsert_full(old: DataFrame, new: DataFrame, keys, order=()) -> DataFrame:
    """``new`` rows replace ``old`` rows of the same key. ``order`` names
    columns that tell which of several new rows is the last."""
    stacked = _stacked(old, require_keys(new, keys))
    tagged = stacked.withColumns({f"_by_{c}": F.col(c) for c in order})
    return latest(tagged, keys, ["_seq", *[f"_by_{c}" for c in order]]).select(*old.columns)


def upsert_partial(old: DataFrame, new: DataFrame, keys) -> DataFrame:
    """``new`` may hold only some columns; the others keep their value.

    Two plain maxima per column, so numeric tables stay in the hash aggregate.
    """
    stacked = _stacked(old, require_keys(new, keys))

    def written(c: str, seq: int):
        return F.max(F.when(F.col("_seq") == seq, F.col(c)))

    picks = [
        F.coalesce(written(c, 1), written(c, 0)).alias(c) for c in old.columns if c not in keys
    ]
    return stacked.groupBy(*keys).agg(*picks).select(*old.columns)
