"""Separating figures from a key-coloured background.  ``px``: key columns, x, y, r, g, b."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import colors
from tessella.operators import stencil

BINS = 256


def distance_histogram(px: DataFrame, by: list[str], key: tuple[int, int, int]) -> DataFrame:
    """(bin, n) of the pixels' distances to the key; the farthest distance is in the last bin."""
    d = colors.distance(F.col("r"), F.col("g"), F.col("b"), key)
    bin_ = F.least(F.floor(d * BINS / F.lit(colors.FARTHEST)), F.lit(BINS - 1)).cast("int")
    return px.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu(histogram: DataFrame, by: list[str]) -> DataFrame:
    """threshold: the upper edge of the bin that parts the histogram best, the first of equal ones.

    Only bins that occur are looked at: empty ones repeat the parting of the bin before them.
    """
    step = colors.FARTHEST / BINS
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    mass = F.col("n") * (F.col("bin") * 2 + 1)  # centres in half bins: whole numbers, summed exactly
    rows = histogram.withColumns({"w": F.sum("n").over(upto), "m": F.sum(mass).over(upto), "wt": F.sum("n").over(whole), "mt": F.sum(mass).over(whole)})
    low, high = F.col("m") / F.col("w"), (F.col("mt") - F.col("m")) / F.nullif(F.col("wt") - F.col("w"), F.lit(0))
    between = F.coalesce(F.col("w").cast("double") * (F.col("wt") - F.col("w")) * (low - high) * (low - high), F.lit(0.0))
    best = rows.withColumn("between", between).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("between"), "bin")))
    return best.filter("place = 1").select(*by, ((F.col("bin") + 1) * F.lit(step)).alias("threshold"))


def keyed(px: DataFrame, thresholds: DataFrame, by: list[str], key: tuple[int, int, int]) -> DataFrame:
    """Pixels with distance, background (at most the threshold) and halo (beyond it, below 200)."""
    d = colors.distance(F.col("r"), F.col("g"), F.col("b"), key)
    rows = px.join(thresholds, by).withColumn("distance", d)
    return rows.withColumns({"background": F.col("distance") <= F.col("threshold"), "halo": (F.col("distance") > F.col("threshold")) & (F.col("distance") < 200)})


def key_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """background_ratio, halo pixels, and whether the ratio is beyond 0.20 to 0.98."""
    ratio = F.avg(F.col("background").cast("int"))
    return rows.groupBy(*by).agg(ratio.alias("background_ratio"), F.count_if("halo").alias("halo"), (~ratio.between(0.20, 0.98)).alias("suspicious"))


def cut_out(px: DataFrame, limits: DataFrame, by: list[str], key: tuple[int, int, int], width: int | str, height: int | str) -> DataFrame:
    """``px`` with distance, threshold, ground and a, cut out of its background: what is near the key
    and connected with the border becomes 0, 0, 0, 0, all else opaque.

    ``limits``: the key columns and threshold, found by :func:`otsu` or stored; images without one
    are left out.  A hole in a figure keeps its colours, however near the key they are.
    """
    d = colors.distance(F.col("r"), F.col("g"), F.col("b"), key)
    rows = px.join(limits.select(*by, "threshold"), by).withColumn("distance", d)
    rows = stencil.grounded(rows.withColumn("under", F.col("distance") <= F.col("threshold")), by, "under", width, height)
    dark = {c: F.when(F.col("ground"), 0).otherwise(F.col(c)).alias(c) for c in "rgb"}
    a = F.when(F.col("ground"), 0).otherwise(255).alias("a")
    return rows.select(*(dark.get(c, F.col(c)) for c in rows.columns if c != "a"), a)


def cut_out_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of images that were cut out: background_ratio, halo pixels (beyond the threshold, nearer than
    200), whether the ratio is beyond 0.20 to 0.98, holes (near the key but not ground) and filled
    (ground that was not near it)."""
    ratio = F.avg(F.col("ground").cast("int"))
    return rows.groupBy(*by).agg(
        ratio.alias("background_ratio"), F.count_if((F.col("distance") > F.col("threshold")) & (F.col("distance") < 200)).alias("halo"),
        (~ratio.between(0.20, 0.98)).alias("suspicious"), F.count_if(F.col("under") & ~F.col("ground")).alias("holes"), F.count_if(~F.col("under") & F.col("ground")).alias("filled"),
    )


def residue(px: DataFrame, by: list[str], key: tuple[int, int, int], tolerance: float = 90.0) -> DataFrame:
    """Share of opaque pixels (a > 0) within tolerance of the key."""
    d = colors.distance(F.col("r"), F.col("g"), F.col("b"), key)
    return px.filter("a > 0").groupBy(*by).agg(F.avg((d <= tolerance).cast("int")).alias("residue"))


def spill_ratio(px: DataFrame, by: list[str], key: tuple[int, int, int], margin: int = 24) -> DataFrame:
    """Share of opaque pixels that the key spills over by more than the margin."""
    s = colors.spill(F.col("r"), F.col("g"), F.col("b"), key)
    return px.filter("a > 0").groupBy(*by).agg(F.avg((s > margin).cast("int")).alias("spill_ratio"))


def despill(px: DataFrame, key: tuple[int, int, int], edge: str = "edge") -> DataFrame:
    """Opaque pixels of the edge band (column ``edge``) without spill; transparent ones are zeroed."""
    amount = colors.spill(F.col("r"), F.col("g"), F.col("b"), key)
    where = (F.col("a") > 0) & F.col(edge)
    new = {c: F.when(F.col("a") > 0, colors.despilled(F.col(c), k, amount, where)).otherwise(0) for c, k in zip("rgb", key, strict=True)}
    return px.select(*[new[c].alias(c) if c in new else F.col(c) for c in px.columns])


def defringed(px: DataFrame, by: list[str], key: tuple[int, int, int], width: int, height: int, strength: float = 1.0, reach: int = 2, edge_only: bool = True) -> DataFrame:
    """``px`` with the key's spill taken off figures, times ``strength``, cut to whole numbers.

    Only opaque pixels within ``reach`` of transparent ones or of the image's border change, or all of
    them with ``edge_only`` off or a reach below 1.  Images with a changed pixel have their transparent
    ones zeroed; others are as they were, as is all with a key that is high or low in every channel.
    ``px`` has a row for every pixel; key columns are not null.
    """
    rows, banded = px, edge_only and reach >= 1
    if banded:
        band = stencil.edge_band(px.filter("a > 0"), by, width, height, reach).withColumn("_edge", F.lit(True))
        rows = px.join(band, [*by, "x", "y"], "left")
    amount = colors.spill(F.col("r"), F.col("g"), F.col("b"), key)
    hit = (F.col("a") > 0) & (amount > 0) & (F.coalesce("_edge", F.lit(False)) if banded else F.lit(True))
    rows = rows.withColumn("_hit", hit)
    touched = rows.filter("_hit").select(*by).distinct().withColumn("_touched", F.lit(True))
    rows = rows.join(touched, by, "left")
    clear = F.coalesce("_touched", F.lit(False)) & (F.col("a") == 0)
    new = {c: F.when(clear, 0).otherwise(colors.despilled(F.col(c), k, amount, F.col("_hit"), strength)) for c, k in zip("rgb", key, strict=True)}
    return rows.select(*[new[c].cast(px.schema[c].dataType).alias(c) if c in new else F.col(c) for c in px.columns])


def without_residue(px: DataFrame, key: tuple[int, int, int], tolerance: float = 90.0) -> DataFrame:
    """``px`` with opaque pixels within tolerance of the key made transparent and black; :func:`residue`
    tells their share beforehand."""
    near = (F.col("a") > 0) & (colors.distance(F.col("r"), F.col("g"), F.col("b"), key) <= tolerance)
    return px.select(*[F.when(near, 0).otherwise(F.col(c)).cast(px.schema[c].dataType).alias(c) if c in "rgba" else F.col(c) for c in px.columns])


def transparent_residue(px: DataFrame, by: list[str]) -> DataFrame:
    """Transparent pixels that still have a colour."""
    dirty = (F.col("a") == 0) & ((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0))
    return px.groupBy(*by).agg(F.count_if(dirty).alias("residue"))


def zero_transparent(px: DataFrame) -> DataFrame:
    return px.withColumns({c: F.when(F.col("a") > 0, F.col(c)).otherwise(0) for c in "rgb"})
