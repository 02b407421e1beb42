"""Bringing enlarged pixel art back to one pixel a block, if the blocks are real.

``px``: the key columns ``by`` of an image, x, y, r, g, b, a.  ``sizes``: the key columns, width,
height, block (the size that was found, null without one) and fixed (the size is given, not found).
Every image has a target size of its own, so the resizing is worked out from columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least block, the least drop in colours and the greatest error of blocks that are
#: believed, and the share of a block about its middle that is not its soft edge.
LEAST_BLOCK, LEAST_REDUCTION, MOST_ERROR, CORE = 3, 4.0, 20.0, 0.6


def block_grid(sizes: DataFrame) -> DataFrame:
    """``sizes`` with cols, rows (blocks of an image) and block_w, block_h (whole pixels of one)."""
    whole = lambda c: F.greatest(F.lit(1), F.bround(c).cast("int"))
    out = sizes.withColumns({"cols": whole(F.col("width") / F.col("block")), "rows": whole(F.col("height") / F.col("block"))})
    return out.withColumns({"block_w": whole(F.col("width") / F.col("cols")), "block_h": whole(F.col("height") / F.col("rows"))})


def _taken(at: str, old: Column, new: Column) -> Column:
    """The new places, if any, that a nearest-neighbour resize fills from an old one: a new place i
    takes the old one under its middle, (2 i + 1) old / (2 new)."""
    first = lambda p: F.ceil((p * 2 * new - old) / (old * 2)).cast("int")
    lo, hi = F.greatest(F.lit(0), first(F.col(at))), F.least(new, first(F.col(at) + 1)) - 1
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def fitted(px: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Opaque pixels of images resized to whole blocks: bx, by_ (the block), ix, iy (place in it) and
    the columns of ``grid``.  Nothing is shuffled but the few images' sizes."""
    rows = px.filter("a > 0").join(grid, by)
    rows = rows.withColumn("nx", F.explode(_taken("x", F.col("width"), F.col("cols") * F.col("block_w"))))
    rows = rows.withColumn("ny", F.explode(_taken("y", F.col("height"), F.col("rows") * F.col("block_h"))))
    part = lambda n, size: (F.floor(F.col(n) / F.col(size)).cast("int"), F.col(n) % F.col(size))
    (bx, ix), (by_, iy) = part("nx", "block_w"), part("ny", "block_h")
    return rows.select(*by, bx.alias("bx"), by_.alias("by_"), ix.alias("ix"), iy.alias("iy"), "r", "g", "b", "block_w", "block_h")


def block_colors(fit: DataFrame, by: list[str], core: bool) -> DataFrame:
    """Median channels of each block, truncated, and whether more than half of it is opaque.

    ``core``: of the pixels about its middle only, for images without transparency.  Blocks that are
    not opaque are black, those without opaque pixels have no row.
    """
    inset = lambda size: F.floor(F.col(size) * (1 - CORE) / 2)
    inner = F.lit(True)
    if core:
        inner = (F.col("ix") >= inset("block_w")) & (F.col("ix") < F.col("block_w") - inset("block_w"))
        inner &= (F.col("iy") >= inset("block_h")) & (F.col("iy") < F.col("block_h") - inset("block_h"))
    share = F.count(F.lit(1)) / (F.first("block_w") * F.first("block_h"))
    one = fit.groupBy(*by, "bx", "by_").agg((share > 0.5).alias("opaque"), *(F.median(F.when(inner, F.col(c))).cast("int").alias(c) for c in "rgb"))
    return one.select(*by, "bx", "by_", "opaque", *(F.when(F.col("opaque"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in "rgb"))


def block_errors(px: DataFrame, grid: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """error: the mean over an image's opaque pixels of the greatest difference to its blocks, enlarged
    again; 0 where there are fewer than two blocks across or down."""
    under = lambda at, n, size: F.floor((F.col(at) * 2 + 1) * F.col(n) / (F.col(size) * 2)).cast("int")
    rows = px.filter("a > 0").join(grid.filter("cols >= 2 AND rows >= 2"), by)
    rows = rows.withColumns({"bx": under("x", "cols", "width"), "by_": under("y", "rows", "height")})
    both = rows.join(blocks.select(*by, "bx", "by_", *(F.col(c).alias(f"m{c}") for c in "rgb")), [*by, "bx", "by_"], "left")
    gap = F.greatest(*(F.abs(F.col(c) - F.coalesce(f"m{c}", F.lit(0))) for c in "rgb"))
    return both.groupBy(*by).agg(F.avg(gap).alias("error"))


def snap(px: DataFrame, sizes: DataFrame, by: list[str], core: bool = False) -> tuple[DataFrame, DataFrame]:
    """What became of each image, and its pixels.

    First: the key columns, block, width, height, colors_before, colors_after, applied; a row for every
    row of ``sizes``.  Second: the key columns, x, y, r, g, b, a of opaque pixels.  An image becomes its
    blocks if their size is fixed or, when found, if the colours drop to a fourth at least and the
    error stays within bounds; else it stays as it is (and where the error was too large, its block
    is 1).  Images without opaque pixels have no colours; they shrink only if their block is fixed.
    ``core``: see :func:`block_colors`.
    """
    sizes = sizes.select(*by, F.col("width").cast("int"), F.col("height").cast("int"), F.col("block").cast("double"), F.coalesce("fixed", F.lit(False)).alias("fixed"))
    grid = block_grid(sizes.filter(F.col("block") >= LEAST_BLOCK))
    blocks = block_colors(fitted(px, grid, by), by, core)
    count = lambda rows, name: rows.select(*by, "r", "g", "b").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    facts = sizes.join(grid.select(*by, "cols", "rows"), by, "left")
    facts = facts.join(count(px.filter("a > 0"), "before"), by, "left").join(count(blocks.filter("opaque"), "after"), by, "left").join(block_errors(px, grid, blocks, by), by, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("before", "after", "error")}
    facts = facts.withColumns(zero).withColumn("drops", F.col("before") / F.greatest(F.lit(1), F.col("after")) >= LEAST_REDUCTION)
    good = F.col("drops") & (F.col("error") <= MOST_ERROR)
    facts = facts.withColumn("applied", F.col("cols").isNotNull() & (F.col("fixed") | good))
    wrong = F.col("cols").isNotNull() & ~F.col("fixed") & F.col("drops") & ~good
    pick = lambda a, b: F.when(F.col("applied"), F.col(a)).otherwise(F.col(b))
    out = facts.select(
        *by, F.when(wrong, 1.0).otherwise(F.coalesce("block", F.lit(1.0))).alias("block"), pick("cols", "width").alias("width"), pick("rows", "height").alias("height"),
        F.col("before").alias("colors_before"), pick("after", "before").alias("colors_after"), "applied",
    )
    done = out.filter("applied").select(*by)
    snapped = blocks.filter("opaque").join(done, by).select(*by, F.col("bx").alias("x"), F.col("by_").alias("y"), "r", "g", "b", F.lit(255).alias("a"))
    kept = px.filter("a > 0").join(done, by, "left_anti").select(*by, "x", "y", "r", "g", "b", "a")
    return out, snapped.unionByName(kept)
