"""Measures of frames from their opaque pixels.

``mask`` is a DataFrame of opaque pixels (key columns, x, y): a sparse mask.  Every measure reduces
within the task before it shuffles, so a frame costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_metrics(mask: DataFrame, by: list[str]) -> DataFrame:
    """area, left, top, right, bottom (half-open), height, centre (mean x) and baseline by frame."""
    out = mask.groupBy(*by).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("left_px"), F.min("y").alias("top_px"),
        (F.max("x") + 1).alias("right_px"), (F.max("y") + 1).alias("bottom_px"), F.avg("x").alias("centre_x"),
    )
    return out.withColumn("height", F.col("bottom_px") - F.col("top_px")).withColumn("baseline", F.col("bottom_px"))


def with_blank(frames: DataFrame, metrics: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of every frame: a frame without opaque pixels has area and height 0 and is blank."""
    out = frames.select(*by).join(metrics, by, "left")
    return out.withColumns({"area": F.coalesce("area", F.lit(0)), "height": F.coalesce("height", F.lit(0)), "blank": F.col("area").isNull()})


def relative_spread(value: Column) -> Column:
    """(max - min) / mean of the positive values; 0 for fewer than two of them."""
    v = F.when(value > 0, value.cast("double"))
    return F.when(F.count(v) >= 2, (F.max(v) - F.min(v)) / F.avg(v)).otherwise(F.lit(0.0))


def variation(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Variation of height and silhouette over the frames of a sequence."""
    return metrics.groupBy(*by).agg(
        relative_spread(F.col("height")).alias("height_variation"), relative_spread(F.col("area")).alias("silhouette_variation"), F.count(F.lit(1)).alias("frames"),
    )


def anchor_measurement(metrics: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """Largest distance of baseline and centre from the bottom centre, and their spreads; blank
    frames are left out, and a sequence of blank frames has zeros."""
    off = F.greatest(F.abs(F.col("baseline") - F.lit(height)).cast("double"), F.abs(F.col("centre_x") - F.lit(width / 2)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return metrics.groupBy(*by).agg(
        zero(F.max(off)).alias("max_drift"), zero((F.max("baseline") - F.min("baseline")).cast("double")).alias("baseline_spread"),
        zero(F.max("centre_x") - F.min("centre_x")).alias("centre_spread"),
    )


def union_bounds(metrics: DataFrame, by: list[str]) -> DataFrame:
    """The box around the content of all frames of a sequence; none for blank sequences."""
    return metrics.filter("area > 0").groupBy(*by).agg(*(f(c).alias(c) for c, f in (("left_px", F.min), ("top_px", F.min), ("right_px", F.max), ("bottom_px", F.max))))


def place(mask: DataFrame, metrics: DataFrame, by: list[str], canvas: tuple[int, int], anchor: tuple[float, float] = (0.5, 1.0)) -> DataFrame:
    """Pixels moved so that each frame's anchor hits the canvas's; what leaves the canvas is cut."""
    tx, ty = round(anchor[0] * canvas[0]), round(anchor[1] * canvas[1])
    shift = metrics.select(*by, F.bround(F.lit(tx) - F.col("centre_x")).cast("int").alias("dx"), F.bround(F.lit(ty) - F.col("baseline")).cast("int").alias("dy"))
    moved = mask.join(shift, by).withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).drop("dx", "dy")
    return moved.filter((F.col("x") >= 0) & (F.col("x") < canvas[0]) & (F.col("y") >= 0) & (F.col("y") < canvas[1]))


def mirrored(mask: DataFrame, width: int) -> DataFrame:
    return mask.withColumn("x", F.lit(width - 1) - F.col("x"))


def foot_span(mask: DataFrame, metrics: DataFrame, by: list[str], share: float = 0.1) -> DataFrame:
    """Width of what stands in the lowest tenth of each frame's content, two rows at least."""
    band = metrics.select(*by, (F.col("bottom_px") - F.greatest(F.lit(2), F.bround(F.col("height") * share).cast("int"))).alias("from_y"))
    rows = mask.join(band, by).filter("y >= from_y")
    return rows.groupBy(*by).agg((F.max("x") - F.min("x") + 1).alias("foot_span"))


def beat_signature(spans: DataFrame, by: list[str]) -> DataFrame:
    """spans: by, stride (boolean), foot_span.  Narrowest stride over the widest of the others."""
    low, high = F.min(F.when(F.col("stride"), F.col("foot_span"))), F.max(F.when(~F.col("stride"), F.col("foot_span")))
    out = spans.groupBy(*by).agg(low.cast("double").alias("stride_min"), high.cast("double").alias("other_max")).filter("stride_min IS NOT NULL AND other_max IS NOT NULL")
    ratio = F.when(F.col("other_max") > 0, F.col("stride_min") / F.when(F.col("other_max") > 0, F.col("other_max"))).otherwise(F.lit(float("inf")))
    return out.withColumn("separation", ratio).withColumn("consistent", F.col("separation") > 1)


def cell_margins(mask: DataFrame, by: list[str], cols: int, rows: int, width: int, height: int) -> DataFrame:
    """margin: the smallest distance of content from the border of its cell, as a share of the cell's
    size, over the cells of a grid that have content.

    ``mask``: opaque pixels.  Pixels are reduced to the box of their cell before anything else.
    """

    def cut(at: str, n: int, size: int) -> tuple[F.Column, F.Column, F.Column]:
        edges = [round(i * size / n) for i in range(n + 1)]
        cell = sum((F.when(F.col(at) >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
        known = F.array(*map(F.lit, edges))
        return cell, known[cell], known[cell + 1] - known[cell]

    (cx, x0, w), (cy, y0, h) = cut("x", cols, width), cut("y", rows, height)
    at = mask.select(*by, cx.alias("cx"), cy.alias("cy"), (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), w.alias("w"), h.alias("h"))
    box = at.groupBy(*by, "cx", "cy", "w", "h").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("b"))
    least = F.least(F.col("l") / F.col("w"), F.col("t") / F.col("h"), (F.col("w") - 1 - F.col("r")) / F.col("w"), (F.col("h") - 1 - F.col("b")) / F.col("h"))
    return box.groupBy(*by).agg(F.min(least).alias("margin"))


def heights(mask: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, typical, peak): the median and the largest height of content over the frames of a key."""
    each = mask.groupBy(key, frame).agg((F.max("y") - F.min("y") + 1).alias("h"))
    return each.groupBy(key).agg(F.median("h").alias("typical"), F.max("h").cast("double").alias("peak"))
