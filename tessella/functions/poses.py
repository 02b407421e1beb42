"""Expressions over scales, size bands and sampled pose sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.geometry import half_even

# How tall a figure may be in an action, as a share of its standing height.
BANDS = {"idle": (0.95, 1.05), "walk": (0.92, 1.05), "attack": (0.85, 1.12), "hurt": (0.80, 1.05), "cast": (0.88, 1.12)}
MOST_GROWTH = 8


def target_height(subject_ratio: Column, reference_ratio: Column, share: Column, canvas: Column) -> Column:
    """Height of a subject on its canvas, by its share of a reference; the canvas without one."""
    return F.when(reference_ratio > 0, share * (subject_ratio / F.nullif(reference_ratio, F.lit(0.0))) * canvas).otherwise(canvas.cast("double"))


def scale_to(wanted: Column, w: Column, h: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """Scale to a wanted height that still fits the canvas."""
    return F.least(wanted / h, canvas_w / w, canvas_h / h)


def band_factor(height: Column, action: Column, standing: Column) -> Column:
    """What brings a height into its action's band; 1 without a band or below one pixel."""
    low = F.coalesce(*(F.when(action == a, standing * b[0]) for a, b in BANDS.items()))
    high = F.coalesce(*(F.when(action == a, standing * b[1]) for a, b in BANDS.items()))
    return F.when((height < 1) | (standing < 1) | low.isNull(), 1.0).otherwise(F.least(F.greatest(height, low), high) / F.when(height > 0, height))


def picked(count: Column, beats: Column, loop: Column) -> Column:
    """array<int>: which of ``beats`` poses (from 0) a sequence of ``count`` frames shows.

    A loop divides the circle and rounds up, so that it does not end where it begins; other
    sequences run from the first pose to the last.
    """
    at = F.sequence(F.lit(0), count - 1)
    return F.when(loop, F.transform(at, lambda i: F.ceil(i * beats / count).cast("int") % beats)).otherwise(
        F.transform(at, lambda i: F.when(count > 1, half_even(i * (beats - 1) / F.greatest(count - 1, F.lit(1)))).otherwise(0))
    )


def between(count: Column, beats: Column) -> Column:
    """array<struct<pose, next, percent>>: linear samples between poses, in whole percent."""
    at = F.sequence(F.lit(0), count - 1)

    def one(i: Column) -> Column:
        x = F.when(count > 1, i * (beats - 1) / F.greatest(count - 1, F.lit(1))).otherwise(0.0)
        pose = F.floor(x).cast("int")
        return F.struct(pose.alias("pose"), F.least(pose + 1, beats - 1).alias("next"), half_even((x - pose) * 100).alias("percent"))

    return F.transform(at, one)


def grown_size(w: Column, h: Column, wanted: Column, canvas: Column) -> Column:
    """struct<w, h>: a frame brought to a wanted height; null if it is empty or would grow beyond
    MOST_GROWTH canvases."""
    scale = wanted / F.when(h > 0, h)
    ok = (h > 0) & (w > 0) & (F.greatest(w, h) * scale <= MOST_GROWTH * canvas)
    return F.when(ok, F.struct(F.greatest(F.lit(1), half_even(w * scale)).alias("w"), F.greatest(F.lit(1), half_even(h * scale)).alias("h")))


def frame_order(keyframes: Column, frames: Column, loop: Column) -> Column:
    """array<string>: the frames of a sequence in order, key:i for the i-th keyframe and gap:i:j for the
    j-th in-between after it.

    A loop has a gap after every keyframe, other sequences none after the last; what is left over
    goes to the first gaps.  Fewer frames than keyframes leave no gaps filled.
    """
    gaps, more = F.when(loop, keyframes).otherwise(keyframes - 1), F.greatest(frames - keyframes, F.lit(0))

    def after(i: Column) -> Column:
        n = F.when(i < gaps, F.floor(more / F.greatest(gaps, F.lit(1))).cast("int") + (i < more % F.greatest(gaps, F.lit(1))).cast("int")).otherwise(0)
        filled = F.transform(F.sequence(F.lit(1), n), lambda j: F.format_string("gap:%d:%d", i, j - 1))
        return F.concat(F.array(F.format_string("key:%d", i)), F.when(n > 0, filled).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(F.sequence(F.lit(0), keyframes - 1), after))


#: Sizes that images are made at, the largest that is suggested, and the share of its
#: native height below which a figure loses detail.
SIZES, MOST_SUGGESTED, ENOUGH = (16, 24, 32, 48, 64, 96, 128), 96, 0.85


def lost_detail(native: Column, target: Column) -> Column:
    """Share of a figure's native height that a target drops; null where it drops little, or without heights."""
    return F.when((native > 0) & (target > 0) & (target < native * ENOUGH), F.lit(1) - target / native)


def suggested_size(native: Column) -> Column:
    """The least size that holds a native height, within what is suggested."""
    return F.least(F.lit(MOST_SUGGESTED), F.coalesce(*(F.when(native <= s, s) for s in SIZES), F.lit(SIZES[-1])))
