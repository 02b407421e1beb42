"""Two passes over an asset's actions: what only all of them together can fix, then each by it.

The first pass measures every action by itself.  Of an asset, the action whose subject is tallest in
its cell fixes the scale, and the frames of all measured actions fix one palette.  The second pass
is a join with these, so nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import poses
from tessella.operators import palette


def measured(actions: DataFrame, seed: str = "seed") -> DataFrame:
    """The actions that count: neither the seed, whose composition is its own, nor interpolated ones,
    whose frames come from no sheet.  ``actions`` has the columns action and interpolated."""
    return actions.filter((F.col("action") != seed) & ~F.coalesce("interpolated", F.lit(False)))


def profiles(actions: DataFrame, by: list[str], canvas_height: int) -> DataFrame:
    """reference, subject_ratio, canvas_fraction of each asset that has a measured action.

    ``actions``: the key columns, action, place (the order of its source), interpolated,
    content_height and cell_height (in the source), output_height (on the canvas).  The first in
    place among equally tall ones is the reference; a cell without height counts as one pixel.
    """
    if canvas_height <= 0:
        raise ValueError("a canvas has a height")
    rows = measured(actions).withColumn("ratio", F.col("content_height") / F.greatest(F.lit(1), F.col("cell_height")))
    best = rows.groupBy(*by).agg(F.max_by(F.struct("action", "ratio", "output_height"), F.struct("ratio", (-F.col("place")).alias("p"))).alias("b"))
    return best.select(*by, F.col("b.action").alias("reference"), F.col("b.ratio").alias("subject_ratio"), (F.col("b.output_height") / F.lit(canvas_height)).alias("canvas_fraction"))


def scaled(actions: DataFrame, found: DataFrame, by: list[str], canvas: tuple[int, int]) -> DataFrame:
    """``actions`` with target_height and scale under their asset's profile, and whether the scale
    enlarges by no whole number; assets without a profile fill their canvas.

    ``actions`` also has content_width; a subject never leaves the canvas.  No content gives no scale.
    """
    rows = actions.join(found, by, "left")
    ratio = F.col("content_height") / F.greatest(F.lit(1), F.col("cell_height"))
    height = poses.target_height(ratio, F.col("subject_ratio"), F.col("canvas_fraction"), F.lit(canvas[1]))
    rows = rows.withColumn("target_height", F.when(F.col("subject_ratio").isNull(), F.lit(float(canvas[1]))).otherwise(height))
    some = (F.col("content_height") > 0) & (F.col("content_width") > 0)
    scale = F.when(some, poses.scale_to(F.col("target_height"), F.col("content_width"), F.col("content_height"), F.lit(canvas[0]), F.lit(canvas[1])))
    rows = rows.withColumn("scale", scale)
    return rows.withColumn("uneven", F.coalesce((F.col("scale") > 1) & (F.abs(F.col("scale") - F.bround("scale")) > 1e-6), F.lit(False)))


def warnings(scaled_actions: DataFrame, by: list[str], canvas_height: int) -> DataFrame:
    """What is worth saying of actions from :func:`scaled`: overrun (the share by which an action had to
    be shrunk to stay on the canvas), lost (the share of its height that the canvas drops) and
    suggested (a size that would hold it); null where there is nothing to say."""
    wanted = F.when(F.col("content_height") > 0, F.col("target_height") / F.col("content_height"))
    overrun = F.when(F.col("scale") < wanted - 1e-6, 1 - F.col("scale") / wanted)
    lost = poses.lost_detail(F.col("content_height"), F.lit(canvas_height))
    return scaled_actions.select(*by, "action", overrun.alias("overrun"), lost.alias("lost"), F.when(lost.isNotNull(), poses.suggested_size(F.col("content_height"))).alias("suggested"))


def shared_palettes(px: DataFrame, by: list[str], colors_max: int) -> DataFrame:
    """entry, r, g, b: the colours that the frames of all measured actions of an asset share.

    ``px``: the key columns, action, interpolated, r, g, b, a.  Counted by colour before they meet.
    """
    cut = palette.median_cut(palette.color_counts(measured(px), by), by, colors_max)
    entries = cut.select(*by, *(F.col(f"entry_{c}").alias(c) for c in "rgb")).distinct()
    return entries.withColumn("entry", F.row_number().over(Window.partitionBy(*by).orderBy("r", "g", "b")) - 1)


def recolored(px: DataFrame, palettes: DataFrame, by: list[str]) -> DataFrame:
    """``px`` in the nearest colours of its asset's palette, the first entry among equally near ones;
    transparent pixels are black, assets without a palette keep their colours.

    An asset's distinct colours meet its entries, then its pixels meet its distinct colours.
    """
    listed = palettes.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("entry", "r", "g", "b"))).alias("entries"))
    known = palette.color_counts(px, by).select(*by, "r", "g", "b").join(listed, by)
    far = lambda e: sum((e[c] - F.col(c)) * (e[c] - F.col(c)) for c in "rgb")
    best = F.array_min(F.transform("entries", lambda e: F.struct(far(e).alias("d"), e["entry"].alias("entry"), *(e[c].alias(c) for c in "rgb"))))
    new = known.select(*by, "r", "g", "b", best.alias("n")).select(*by, "r", "g", "b", *(F.col(f"n.{c}").alias(f"new_{c}") for c in "rgb"))
    rows = px.join(new, [*by, "r", "g", "b"], "left")
    paint = {c: F.when(F.col("a") > 0, F.coalesce(f"new_{c}", c)).otherwise(0).alias(c) for c in "rgb"}
    return rows.select(*(paint.get(c, F.col(c)) for c in px.columns))
