"""Neighbourhoods, morphology and connected components of masks.

Stencils over sparse masks are written as scatter and count: every pixel sends itself to its
neighbours and the counts tell the rest, so transparent pixels cost nothing and the shuffle is keyed
by frame and place.  Components are found image by image in Arrow, since an image is small and
nothing crosses its border.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sent(mask: DataFrame, by: list[str], reach: int) -> DataFrame:
    """Each pixel in every place within reach, its own among them."""
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)))
    out = mask.select(*by, "x", "y", F.explode(steps).alias("s"))
    return out.select(*by, (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))


def neighbour_counts(mask: DataFrame, by: list[str]) -> DataFrame:
    """(x, y, neighbours): opaque pixels among the eight around each opaque pixel."""
    seen = _sent(mask, by, 1).groupBy(*by, "x", "y").agg((F.count(F.lit(1)) - 1).alias("neighbours"))
    return mask.select(*by, "x", "y").join(seen, [*by, "x", "y"])


def isolated(mask: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Pixels with fewer opaque neighbours than ``least``."""
    return neighbour_counts(mask, by).filter(F.col("neighbours") < least)


def without_isolated(mask: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    return neighbour_counts(mask, by).filter(F.col("neighbours") >= least).drop("neighbours")


def dilated(mask: DataFrame, by: list[str], width: int, height: int, reach: int = 1) -> DataFrame:
    """The places within reach of the mask, inside the image."""
    return _sent(mask, by, reach).distinct().filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def eroded(mask: DataFrame, by: list[str], width: int, height: int, reach: int = 1, outside: bool = False) -> DataFrame:
    """Pixels whose whole neighbourhood is in the mask; outside: whether what lies beyond the image
    counts as in it."""
    seen = _sent(mask, by, reach).groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    span = lambda c, size: F.least(F.col(c) + reach, F.lit(size - 1)) - F.greatest(F.col(c) - reach, F.lit(0)) + 1
    whole = span("x", width) * span("y", height) if outside else F.lit((2 * reach + 1) ** 2)
    return mask.select(*by, "x", "y").join(seen.filter(F.col("n") >= whole) if not outside else seen, [*by, "x", "y"]).filter(F.col("n") >= whole).drop("n")


def edge_band(mask: DataFrame, by: list[str], width: int, height: int, reach: int = 2) -> DataFrame:
    """Pixels of the mask within reach of what is not in it, the image's border included."""
    return mask.select(*by, "x", "y").join(eroded(mask, by, width, height, reach), [*by, "x", "y"], "left_anti")


def opened(mask: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    return dilated(eroded(mask, by, width, height, 1, outside=True), by, width, height)


def closed(mask: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    return eroded(dilated(mask, by, width, height), by, width, height, 1, outside=True)


def _roots(place: np.ndarray, span: int) -> np.ndarray:
    """For each of the sorted places (row by row, ``span`` to a row) the number of the first one that
    it is four-connected with."""
    low = np.arange(len(place))
    links = []
    for step in (1, span):
        at = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        hit = np.flatnonzero(place[at] == place + step)
        links.append((hit, at[hit]))
    a, b = (np.concatenate([link[k] for link in links]) for k in (0, 1))
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def components(mask: DataFrame, by: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(x, y, component): four-connected components, numbered from 0 in the order of their first
    pixel by row.  Images are independent of each other; each is one group.  ``keep``: columns of
    the mask that stay with its pixels."""
    names = [*by, "x", "y", *keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mask.select(*names).schema) + ", component int"

    def label(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        span = int(x.max()) - int(x.min()) + 2
        low = _roots((y - y.min()).astype(np.int64) * span + (x - x.min()), span)
        number = np.unique(low, return_inverse=True)[1].astype(np.int32)
        return table.select(names).take(pa.array(order)).append_column("component", pa.array(number))

    return mask.select(*names).groupBy(*by).applyInArrow(label, schema)


#: Width of the frame of set pixels that an image gets before its mask is cleaned.
FRAME = 3


def grounded(px: DataFrame, by: list[str], under: str, width: int | str, height: int | str) -> DataFrame:
    """All rows of ``px`` with ``ground``: whether the pixel belongs to the mask ``under`` (a boolean
    column) after opening and closing, and is connected there with the outside of the image.

    What lies outside counts as set, so a mask keeps its outermost ring, and parts of it that a
    figure encloses are not ground.  ``width`` and ``height`` are numbers or columns.  An image is
    one group: its mask is reconstructed from the border by the components of the cleaned mask.
    A null ``under`` is not in the mask; pixels without a row are not either.
    """
    size = lambda v: F.lit(v) if isinstance(v, int) else F.col(v)
    rows = px.select("*", size(width).cast("int").alias("_w"), size(height).cast("int").alias("_h"), F.coalesce(F.col(under), F.lit(False)).alias("_under"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in px.schema) + ", ground boolean"
    names = px.columns

    def clean(table: pa.Table) -> pa.Table:
        x, y, set_ = (table[c].to_numpy() for c in ("x", "y", "_under"))
        grid = np.ones((table["_h"][0].as_py() + 2 * FRAME, table["_w"][0].as_py() + 2 * FRAME), bool)
        grid[FRAME:-FRAME, FRAME:-FRAME] = False
        grid[y + FRAME, x + FRAME] = set_
        for grow in (False, True, True, False):
            wide = np.pad(grid, 1, constant_values=True)
            near = [wide[i : i + grid.shape[0], j : j + grid.shape[1]] for i in range(3) for j in range(3)]
            grid = np.logical_or.reduce(near) if grow else np.logical_and.reduce(near)
        at = np.flatnonzero(grid.ravel())
        rows, cols = np.divmod(at, grid.shape[1])
        low = _roots(rows * (grid.shape[1] + 1) + cols, grid.shape[1] + 1)
        # The first place is a corner, and all of the border is connected with it.
        grid.ravel()[at[low != 0]] = False
        return table.select(names).append_column("ground", pa.array(grid[y + FRAME, x + FRAME]))

    return rows.groupBy(*by).applyInArrow(clean, schema)


def component_boxes(labelled: DataFrame, by: list[str]) -> DataFrame:
    """area and half-open box of each component."""
    return labelled.groupBy(*by, "component").agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("left_px"), F.min("y").alias("top_px"), (F.max("x") + 1).alias("right_px"), (F.max("y") + 1).alias("bottom_px"),
    )


def crossing(labelled: DataFrame, by: list[str], width: int, height: int, cols: int, rows: int) -> DataFrame:
    """Components that touch more than one cell of a grid."""
    cell = F.floor(F.col("x") * cols / width) + cols * F.floor(F.col("y") * rows / height)
    return labelled.groupBy(*by, "component").agg(F.count_distinct(cell).alias("cells")).filter("cells > 1")


def overlaps(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(a, b) of components of one image whose boxes intersect, a < b.

    A range join within images: an image has few components, so the key is the image.
    """
    a = boxes.select(*by, *(F.col(c).alias(f"{c}_a") for c in ("component", "left_px", "top_px", "right_px", "bottom_px")))
    b = boxes.select(*by, *(F.col(c).alias(f"{c}_b") for c in ("component", "left_px", "top_px", "right_px", "bottom_px")))
    meet = (F.col("component_a") < F.col("component_b")) & (F.col("left_px_a") < F.col("right_px_b")) & (F.col("left_px_b") < F.col("right_px_a"))
    meet &= (F.col("top_px_a") < F.col("bottom_px_b")) & (F.col("top_px_b") < F.col("bottom_px_a"))
    return a.join(b, by).filter(meet).select(*by, F.col("component_a").alias("a"), F.col("component_b").alias("b"))


def grouped(boxes: DataFrame, by: list[str], count: int, share: float = 0.20, least: int = 120) -> DataFrame:
    """Each component with the seed it belongs to: seeds are the ``count`` largest among those of at
    least max(least, share of the largest), the rest goes to the nearest seed's centre."""
    from pyspark.sql import Window

    whole = Window.partitionBy(*by)
    large = F.greatest(F.lit(least).cast("double"), F.max("area").over(whole) * share)
    rows = boxes.withColumn("big", F.col("area") >= large)
    rows = rows.withColumn("n_big", F.sum(F.col("big").cast("int")).over(whole))
    rows = rows.withColumn("usable", F.col("big") | (F.col("n_big") < count))
    order = Window.partitionBy(*by).orderBy(F.desc("usable"), F.desc("area"), "component")
    rows = rows.withColumns({"seed": F.row_number().over(order) <= count, "cx": F.col("left_px") + F.col("right_px"), "cy": F.col("top_px") + F.col("bottom_px")})
    seeds = rows.filter("seed").select(*by, F.col("component").alias("to"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    near = rows.join(seeds, by).withColumn("d", (F.col("cx") - F.col("sx")) * (F.col("cx") - F.col("sx")) + (F.col("cy") - F.col("sy")) * (F.col("cy") - F.col("sy")))
    return near.groupBy(*by, "component").agg(F.min(F.struct("d", "to"))["to"].alias("seed"))
