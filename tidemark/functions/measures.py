"""How the second measure is summed.

The measure is a double. Summing doubles gives a last digit that depends on
the order of rows, which differs from run to run on a cluster, so two sides of
a comparison may differ by rounding alone. ``Fixed(scale)`` sums scaled
integers: exact, independent of order, and held in a long, so Spark keeps the
hash aggregate. A reading with more decimals is never rounded: the parser puts
it into quarantine when it is told the scale, and one that gets here fails.
``Plain`` sums the doubles as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


def _scaled(value: Column, scale: int) -> Column:
    return F.rint(value * F.lit(float(10**scale)))


def has_decimals(value: Column, scale: int) -> Column:
    """Whether a double is a number of at most that many decimals, and small enough
    to be exact in them. The quotient is rounded correctly, so it gives back the
    very double such a number has."""
    scaled = _scaled(value, scale)
    return (F.abs(scaled) < float(2**53)) & (scaled / F.lit(float(10**scale)) == value)


@dataclass(frozen=True)
class Plain:
    scale = None

    def pack(self, value: Column) -> Column:
        return value

    def unpack(self, total: Column) -> Column:
        return total


@dataclass(frozen=True)
class Fixed:
    scale: int

    def pack(self, value: Column) -> Column:
        fault = F.raise_error(F.concat(F.lit(f"more than {self.scale} decimals or too large: "), value.cast("string")))
        return F.when(has_decimals(value, self.scale), _scaled(value, self.scale).cast("bigint")).when(
            value.isNotNull(), fault.cast("bigint")
        )

    def unpack(self, total: Column) -> Column:
        return total / F.lit(float(10**self.scale))


PLAIN = Plain()
CENTS = Fixed(2)
