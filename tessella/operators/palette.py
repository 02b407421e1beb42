"""Colours of images: palettes, overflow, snapping, reduction, blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import colors


def color_counts(px: DataFrame, by: list[str]) -> DataFrame:
    """(r, g, b, n) of opaque pixels: everything about palettes works on distinct colours."""
    return px.filter("a > 0").groupBy(*by, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def palette(counts: DataFrame, by: list[str]) -> DataFrame:
    """palette: sorted #RRGGBB of a group, and how many."""
    each = counts.select(*by, colors.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("c"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_set("c")).alias("palette"), F.count_distinct("c").alias("n_colors"))


def overflow(counts: DataFrame, allowed: DataFrame, by: list[str]) -> DataFrame:
    """Share of opaque pixels whose colour is not in ``allowed`` (r, g, b).  Distinct colours are
    joined, each group's once, so a palette of any size is shuffled like them."""
    known = allowed.select("r", "g", "b").distinct().withColumn("ok", F.lit(1))
    rows = counts.join(known, ["r", "g", "b"], "left")
    return rows.groupBy(*by).agg((F.sum(F.when(F.col("ok").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("overflow"))


def snap(counts: DataFrame, targets: list[tuple[int, int, int]]) -> DataFrame:
    """Each distinct colour with the number of its nearest target, the first of equally near ones,
    and the squared distance."""
    near = F.array(*(
        F.struct(
            ((F.col("r") - r) * (F.col("r") - r) + (F.col("g") - g) * (F.col("g") - g) + (F.col("b") - b) * (F.col("b") - b)).alias("d2"), F.lit(i).alias("target")
        ) for i, (r, g, b) in enumerate(targets)
    ))
    best = F.array_min(near)
    return counts.withColumns({"target": best["target"], "d2": best["d2"]})


def median_cut(counts: DataFrame, by: list[str], colors_max: int) -> DataFrame:
    """(r, g, b, entry_r, entry_g, entry_b): the distinct colours of each group and the mean of the
    box that each falls in.  The box of the widest channel is cut at the median pixel until there
    are ``colors_max``; a group holds distinct colours, not pixels."""
    names = [*by, "r", "g", "b"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.select(*names).schema) + ", entry_r int, entry_g int, entry_b int"

    def cut(table: pa.Table) -> pa.Table:
        rgb = np.stack([table[c].to_numpy() for c in "rgb"], axis=1).astype(np.int64)
        n = table["n"].to_numpy()
        order = np.lexsort(rgb.T[::-1])
        boxes = [order]
        while len(boxes) < colors_max:
            wide = [(int((rgb[b].max(0) - rgb[b].min(0)).max()), -i) for i, b in enumerate(boxes)]
            width, i = max(wide)
            if width == 0:
                break
            box = boxes[-i]
            channel = int((rgb[box].max(0) - rgb[box].min(0)).argmax())
            box = box[np.argsort(rgb[box, channel], kind="stable")]
            upto = np.cumsum(n[box])
            at = int(np.clip(np.searchsorted(upto, upto[-1] / 2) + 1, 1, len(box) - 1))
            # Equal values of the channel stay together.
            while at < len(box) and rgb[box[at], channel] == rgb[box[at - 1], channel]:
                at += 1
            if at == len(box):
                at = int(np.searchsorted(rgb[box, channel], rgb[box[-1], channel]))
            boxes[-i] = box[:at]
            boxes.append(box[at:])
        entry = np.zeros((len(rgb), 3), np.int32)
        for b in boxes:
            entry[b] = (rgb[b] * n[b, None]).sum(0) // n[b].sum()
        out = table.select(names)
        for j, c in enumerate("rgb"):
            out = out.append_column(f"entry_{c}", pa.array(entry[:, j]))
        return out

    return counts.groupBy(*by).applyInArrow(cut, schema)


def block_medians(px: DataFrame, by: list[str], width: int, height: int, cols: int, rows: int) -> DataFrame:
    """Median channels of each of cols x rows blocks over opaque pixels, truncated; a block is
    opaque if more than half of its pixels are."""
    cell = {"bx": F.floor(F.col("x") * cols / width).cast("int"), "by": F.floor(F.col("y") * rows / height).cast("int")}
    opaque = F.col("a") > 0
    med = lambda c: F.coalesce(F.median(F.when(opaque, F.col(c))).cast("int"), F.lit(0)).alias(c)
    return px.withColumns(cell).groupBy(*by, "bx", "by").agg(*(med(c) for c in "rgb"), (F.avg(opaque.cast("int")) > 0.5).alias("opaque"))


def reconstruction_error(px: DataFrame, blocks: DataFrame, by: list[str], width: int, height: int, cols: int, rows: int) -> DataFrame:
    """Mean over opaque pixels of the largest channel difference to their block."""
    cell = {"bx": F.floor(F.col("x") * cols / width).cast("int"), "by": F.floor(F.col("y") * rows / height).cast("int")}
    block = blocks.select(*by, "bx", "by", *(F.col(c).alias(f"m{c}") for c in "rgb"))
    both = px.filter("a > 0").withColumns(cell).join(block, [*by, "bx", "by"])
    return both.groupBy(*by).agg(F.avg(F.greatest(*(F.abs(F.col(c) - F.col(f"m{c}")) for c in "rgb"))).alias("error"))


def nearest_resize(px: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """Images of ``px`` (any keys, x, y, r, g, b, a) at a new size, each pixel that of the nearest
    source pixel; transparent pixels are black.

    Which source column and row a new one takes is known beforehand, so a pixel becomes as many
    pixels as it covers and nothing is shuffled.
    """

    def covered(at: str, size: int, new: int) -> F.Column:
        # New pixel i takes the source pixel under its middle, (2 i + 1) size / (2 new).
        every = [[i for i in range(new) if (2 * i + 1) * size // (2 * new) == s] for s in range(size)]
        return F.array(*(F.array(*map(F.lit, some)).cast("array<int>") for some in every))[F.col(at)]

    dark = [F.when(F.col("a") > 0, F.col(c)).otherwise(0).alias(c) for c in "rgb"]
    rest = [c for c in px.columns if c not in ("x", "y", "r", "g", "b")]
    rows = px.select(*rest, *dark, F.explode(covered("x", width, new_width)).alias("x"), covered("y", height, new_height).alias("ys"))
    return rows.select(*[c for c in rows.columns if c != "ys"], F.explode("ys").alias("y"))


def introduced(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(r, g, b): colours of opaque pixels after a step that no opaque pixel of the group had before."""
    seen = lambda px: px.filter("a > 0").select(*by, "r", "g", "b").distinct()
    return seen(after).join(seen(before), [*by, "r", "g", "b"], "left_anti")
