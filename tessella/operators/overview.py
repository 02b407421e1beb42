"""Overview pictures: all groups of frames of a sheet in rows, tiles repeated and enlarged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what is behind the frames.
BACKGROUND = (32, 32, 40)


def layout(frames: DataFrame, by: list[str], group: str = "group") -> DataFrame:
    """Where each frame goes: x0, y0, and the picture's width and height.

    ``frames``: the key columns, ``group``, frame, width, height.  Groups are rows in their order,
    frames follow one another; every cell has the size of the largest frame, and a smaller one stands
    in the middle of it, the odd pixel right and below.
    """
    whole, inner = Window.partitionBy(*by), Window.partitionBy(*by, group)
    rows = frames.withColumns({"row": F.dense_rank().over(whole.orderBy(group)) - 1, "col": F.row_number().over(inner.orderBy("frame")) - 1, "cell_w": F.max("width").over(whole), "cell_h": F.max("height").over(whole)})
    middle = lambda at, cell, size: (F.col(at) * F.col(cell) + F.floor((F.col(cell) - F.col(size)) / 2)).cast("int")
    rows = rows.withColumns({"x0": middle("col", "cell_w", "width"), "y0": middle("row", "cell_h", "height")})
    full = {"sheet_w": (F.max("col").over(whole) + 1) * F.col("cell_w"), "sheet_h": (F.max("row").over(whole) + 1) * F.col("cell_h")}
    return rows.withColumns(full).select(*by, group, "frame", "x0", "y0", "sheet_w", "sheet_h")


def contact_sheet(px: DataFrame, frames: DataFrame, by: list[str], group: str = "group") -> tuple[DataFrame, DataFrame]:
    """Sizes (the key columns, width, height) and the opaque pixels of the pictures, before a background.

    ``px``: the key columns, group, frame, x, y, r, g, b, a; transparent pixels let the background through.
    """
    at = layout(frames, by, group)
    sizes = at.groupBy(*by).agg(F.max("sheet_w").alias("width"), F.max("sheet_h").alias("height"))
    placed = px.filter("a > 0").join(at, [*by, group, "frame"])
    return sizes, placed.select(*by, (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "r", "g", "b")


def painted(sizes: DataFrame, px: DataFrame, by: list[str], background: tuple[int, int, int] = BACKGROUND) -> DataFrame:
    """Every pixel of the pictures: those of ``px`` over the background."""
    every = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    both = every.select(*by, "x", "y").join(px, [*by, "x", "y"], "left")
    return both.select(*by, "x", "y", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip("rgb", background, strict=True)))


def tile_patches(px: DataFrame, by: list[str], width: int, height: int, repeat: int = 3, scale: int = 4) -> DataFrame:
    """The opaque pixels of a picture with a row for each tile, in the order of tile_id: the tile
    ``repeat`` times across and down, enlarged.  A tile shows its seams only next to itself.

    Nothing but the tiles' numbers is shuffled: a pixel becomes all the pixels that show it.
    """
    ids = px.select(*by, "tile_id").distinct().withColumn("row", F.row_number().over(Window.partitionBy(*by).orderBy("tile_id")) - 1)
    steps = F.sequence(F.lit(0), F.lit(repeat * scale - 1))
    at = lambda c, size, step: F.floor(F.col(step) / scale) * size * scale + F.col(c) * scale + F.col(step) % scale
    rows = px.filter("a > 0").join(ids, [*by, "tile_id"]).withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
    return rows.select(*by, at("x", width, "i").cast("int").alias("x"), (F.col("row") * (height * repeat * scale) + at("y", height, "j")).cast("int").alias("y"), "r", "g", "b")
