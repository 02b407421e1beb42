"""Expressions over colours; channels are integers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance from black to white.
FARTHEST = (3 * 255 * 255) ** 0.5


def to_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB in upper case."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)))


def from_hex(color: Column) -> Column:
    """struct<r, g, b> of #RRGGBB in either case."""
    return F.struct(*(F.conv(F.substring(color, at, 2), 16, 10).cast("int").alias(n) for n, at in (("r", 2), ("g", 4), ("b", 6))))


def distance(r: Column, g: Column, b: Column, key: tuple[int, int, int]) -> Column:
    """Euclidean distance to a key colour."""
    return F.sqrt(sum(((c - k) * (c - k) for c, k in zip((r, g, b), key, strict=True)), F.lit(0)).cast("double"))


def spill(r: Column, g: Column, b: Column, key: tuple[int, int, int]) -> Column:
    """How much of the key colour shines through: by how much all its high channels exceed its low
    ones.  A key that is high or low in every channel spills nothing."""
    high = [c for c, k in zip((r, g, b), key, strict=True) if k >= 128]
    low = [c for c, k in zip((r, g, b), key, strict=True) if k < 128]
    if not high or not low:
        return F.lit(0)
    least = F.least(*high) if len(high) > 1 else high[0]
    most = F.greatest(*low) if len(low) > 1 else low[0]
    return F.greatest(least - most, F.lit(0))


def despilled(channel: Column, key: int, amount: Column, where: Column, strength: float = 1.0) -> Column:
    """A channel without spill; only high channels of the key are lowered, truncating."""
    if key < 128:
        return channel
    return F.when(where, F.greatest(channel - (amount * strength).cast("int"), F.lit(0))).otherwise(channel)
