"""Expressions over sizes, grids, anchors, scales and frame rates.  Rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import dims


def half_even(x: Column) -> Column:
    return F.bround(x).cast("int")


def fit_within(w: Column, h: Column, tw: Column, th: Column) -> Column:
    """struct<w, h>: the largest size of the same shape within a target, truncated, one at least."""
    scale = F.least(tw / w, th / h)
    return F.struct(F.greatest(F.lit(1), (w * scale).cast("int")).alias("w"), F.greatest(F.lit(1), (h * scale).cast("int")).alias("h"))


def cell_box(index: Column, cols: Column, rows: Column, w: Column, h: Column) -> Column:
    """struct<left, top, right, bottom> of a cell of a grid over an image of any size."""
    c, r = index % cols, F.floor(index / cols)
    edge = lambda n, size, of: half_even(n * size / of)
    return F.struct(edge(c, w, cols).alias("left"), edge(r, h, rows).alias("top"), edge(c + 1, w, cols).alias("right"), edge(r + 1, h, rows).alias("bottom"))


def size_violations(w: Column, h: Column) -> Column:
    """array<string>: which limits a size breaks."""
    long, short, pixels = F.greatest(w, h), F.least(w, h), w * h
    found = F.array(
        F.when((w % dims.SIZE_MULTIPLE != 0) | (h % dims.SIZE_MULTIPLE != 0), "multiple"),
        F.when(long > dims.MAX_RATIO * short, "ratio"),
        F.when(pixels < dims.MIN_PIXELS, "too_small"),
        F.when(pixels > dims.MAX_PIXELS, "too_large"),
        F.when(long > dims.MAX_SIDE, "side"),
    )
    return F.array_compact(found)


def aspect_mismatch(w: Column, h: Column, w2: Column, h2: Column) -> Column:
    """Relative drift of the shape from the one asked for."""
    asked, got = w / h, w2 / h2
    return F.abs(got - asked) / asked


def uneven_upscale(scale: Column) -> Column:
    """Whether a scale enlarges by no whole number."""
    return (scale > 1) & (F.abs(scale - F.bround(scale)) > 1e-6)


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds to wait after an attempt (from 1)."""
    return F.least(F.lit(base) * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0))), F.lit(most))


def frames_at(frames: Column, fps: Column, target: Column, least: int = 2, most: int = 24) -> Column:
    """Frames of the same duration at another rate, within limits."""
    return F.least(F.lit(most), F.greatest(F.lit(least), half_even(frames * target / fps)))


def gap_share(total: Column, gaps: Column, gap: Column) -> Column:
    """In-betweens of one of several gaps (from 0); what is left over goes to the first ones."""
    return F.floor(total / gaps).cast("int") + (gap < total % gaps).cast("int")
