"""Measures of sequences of frames and of series of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent_difference(mask: DataFrame, frames: DataFrame, key: str, pixels: int) -> DataFrame:
    """(key, frame_idx, diff): share of pixels in which a frame's mask differs from the next one's.

    ``frames``: key, frame_idx, loop, n (frames of the sequence).  The last frame is held against
    the first only where loop is true.
    """
    area = frames.join(mask.groupBy(key, "frame_idx").agg(F.count(F.lit(1)).alias("area")), [key, "frame_idx"], "left")
    area = area.select(key, "frame_idx", "loop", "n", F.coalesce("area", F.lit(0)).alias("area"))
    pairs = area.withColumn("next", (F.col("frame_idx") + 1) % F.col("n")).filter("n > 1 AND (loop OR next > 0)")
    after = area.select(key, F.col("frame_idx").alias("next"), F.col("area").alias("next_area"))
    size = area.select(key, "n").distinct()
    shifted = mask.join(size, key).select(key, F.pmod(F.col("frame_idx") - 1 + F.col("n"), F.col("n")).alias("frame_idx"), "x", "y")
    both = mask.select(key, "frame_idx", "x", "y").join(shifted, [key, "frame_idx", "x", "y"]).groupBy(key, "frame_idx").agg(F.count(F.lit(1)).alias("both"))
    out = pairs.join(after, [key, "next"]).join(both, [key, "frame_idx"], "left")
    diff = (F.col("area") + F.col("next_area") - 2 * F.coalesce("both", F.lit(0))) / F.lit(pixels)
    return out.select(key, "frame_idx", diff.alias("diff"))


def order_stats(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """n, max_over_min, local_outlier (neighbours wrap around) and parity_cv of series of three
    values or more; ``at`` numbers a series from 0."""
    w = Window.partitionBy(key).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = (F.coalesce(F.lag(value).over(w), F.last(value).over(whole)) + F.coalesce(F.lead(value).over(w), F.first(value).over(whole))) / 2
    rows = series.withColumn("local", F.col(value) / F.greatest(near, F.lit(1e-9)))
    cv = lambda p: F.when((F.count(F.when(F.col(at) % 2 == p, 1)) > 1) & (F.avg(F.when(F.col(at) % 2 == p, F.col(value))) > 0), F.stddev_pop(F.when(F.col(at) % 2 == p, F.col(value))) / F.nullif(F.avg(F.when(F.col(at) % 2 == p, F.col(value))), F.lit(0.0)))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.max("local").alias("local_outlier"),
        F.greatest(F.coalesce(cv(0), F.lit(0.0)), F.coalesce(cv(1), F.lit(0.0))).alias("parity_cv"),
    )
    ratio = F.when(F.col("low") > 0, F.col("high") / F.when(F.col("low") > 0, F.col("low"))).otherwise(F.lit(float("inf")))
    return out.filter("n >= 3").select(key, "n", ratio.alias("max_over_min"), "local_outlier", "parity_cv")


def exact_duplicates(frames: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """(key, first, at): frames that equal an earlier one of their sequence, and the first such."""
    first = frames.groupBy(key, digest).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return frames.join(first, [key, digest]).filter(F.col(at) > F.col("first")).select(key, "first", at)


def mirror_flips(mask: DataFrame, by: list[str], key: str, width: int | Column, height: int | Column) -> DataFrame:
    """For each frame chirality (overlap with the first frame, less that of its mirror image),
    judged (it is not symmetric) and flipped.  Frames are centred on their mean, around the edges.

    ``width`` and ``height`` may be columns that ``by`` has."""
    middle = lambda size: F.floor(F.lit(size) / 2).cast("int")
    mean = mask.groupBy(*by).agg((middle(height) - F.avg("y").cast("int")).alias("dy"), (middle(width) - F.avg("x").cast("int")).alias("dx"))
    px = mask.join(mean, by).select(*by, F.pmod(F.col("x") + F.col("dx"), F.lit(width)).alias("x"), F.pmod(F.col("y") + F.col("dy"), F.lit(height)).alias("y"))
    flip = px.withColumn("x", F.lit(width - 1) - F.col("x"))
    area = px.groupBy(*by).agg(F.count(F.lit(1)).alias("area"))
    first = px.filter("frame_idx = 0").select(key, "x", "y")
    base = area.filter("frame_idx = 0").select(key, F.col("area").alias("first_area"))
    same = px.join(first, [key, "x", "y"]).groupBy(*by).agg(F.count(F.lit(1)).alias("same"))
    other = flip.join(first, [key, "x", "y"]).groupBy(*by).agg(F.count(F.lit(1)).alias("other"))
    own = px.join(flip, [*by, "x", "y"]).groupBy(*by).agg(F.count(F.lit(1)).alias("own"))
    rows = area.join(base, key, "left").join(same, by, "left").join(other, by, "left").join(own, by, "left").na.fill(0, ["same", "other", "own", "first_area"])
    iou = lambda both, a, b: both / (a + b - both)
    a, f = F.col("area"), F.col("first_area")
    chirality = iou(F.col("same"), a, f) - iou(F.col("other"), a, f)
    judged = iou(F.col("own"), a, a) < 0.90
    return rows.select(*by, F.bround(chirality, 4).alias("chirality"), judged.alias("judged"), (judged & (chirality < -0.03)).alias("flipped"))


def pixel_difference(px: DataFrame, key: str, frame: str, size: int) -> DataFrame:
    """(key, frame, diff): the share of pixels whose colour differs from that of the frame before.

    ``px`` has every pixel of every frame.  A pixel meets itself in the next frame by its place.
    """
    before = px.select(key, (F.col(frame) + 1).alias(frame), "x", "y", *(F.col(c).alias(f"{c}0") for c in "rgba"))
    both = px.join(before, [key, frame, "x", "y"])
    other = F.when(F.struct(*"rgba") != F.struct(*(f"{c}0" for c in "rgba")), 1).otherwise(0)
    return both.groupBy(key, frame).agg((F.sum(other) / size).alias("diff"))
