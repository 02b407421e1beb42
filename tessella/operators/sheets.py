"""Taking sheets of figures apart: by components, by shared slots, by plain cells; and what lies
where a sheet's cells meet.

``px``: the key columns ``by`` of a sheet, x, y, r, g, b, a; only opaque pixels count.
``layouts``: the key columns, width, height, cols, rows, frames; one row a sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.lineage import cut
from tessella.operators import stencil

#: Seeds have at least this area or share of the largest component, fragments that are
#: kept these; free space around a figure.
SEED_AREA, SEED_SHARE, NOISE_AREA, NOISE_SHARE, PADDING = 120, 0.20, 12, 0.002, 4
LAYOUT = ["width", "height", "cols", "rows", "frames"]


def _band(top: str, bottom: str) -> Column:
    """The row of the grid in whose band the middle of a box lies."""
    return F.least(F.col("rows") - 1, F.floor((F.col(top) + F.col(bottom)) * F.col("rows") / (F.col("height") * 2))).cast("int")


def figures(boxes: DataFrame, layouts: DataFrame, by: list[str], seed_area: float = SEED_AREA, seed_share: float = SEED_SHARE, noise_area: float = NOISE_AREA, noise_share: float = NOISE_SHARE) -> DataFrame:
    """component, frame, seed and box of the components that make a sheet's figures.

    As many figures as the layout has frames are sought: the largest components are their seeds,
    numbered in reading order (by bands of the grid's rows, then from left to right); every other
    component that is no noise goes to the seed whose middle is nearest, the first of equal ones.
    Sheets with fewer components than frames have no rows.  Equal areas go by the component's number.
    """
    sheet = Window.partitionBy(*by)
    rows = boxes.join(layouts.select(*by, *LAYOUT), by).withColumns({"n": F.count(F.lit(1)).over(sheet), "largest": F.max("area").over(sheet)})
    rows = rows.filter("n >= frames").withColumn("large", F.col("area") >= F.greatest(F.lit(float(seed_area)), F.col("largest") * seed_share))
    enough = F.sum(F.col("large").cast("int")).over(sheet) >= F.col("frames")
    rows = rows.withColumn("usable", F.col("large") | ~enough)
    rows = rows.withColumn("rank", F.row_number().over(sheet.orderBy(F.desc("usable"), F.desc("area"), "component")))
    rows = rows.withColumns({"seed": F.col("rank") <= F.col("frames"), "band": _band("top_px", "bottom_px"), "cx": F.col("left_px") + F.col("right_px"), "cy": F.col("top_px") + F.col("bottom_px")})
    rows = rows.withColumn("order", F.row_number().over(sheet.orderBy(F.desc("seed"), "band", "cx", "rank")) - 1)
    rows = rows.withColumn("seeds", F.collect_list(F.when(F.col("seed"), F.struct("order", "cx", "cy"))).over(sheet))
    far = lambda s: (s["cx"] - F.col("cx")) * (s["cx"] - F.col("cx")) + (s["cy"] - F.col("cy")) * (s["cy"] - F.col("cy"))
    nearest = F.array_min(F.transform("seeds", lambda s: F.struct(far(s).alias("d"), s["order"].alias("order"))))["order"]
    kept = F.col("seed") | (F.col("area") >= F.greatest(F.lit(float(noise_area)), F.col("largest") * noise_share))
    frame = F.when(F.col("seed"), F.col("order")).otherwise(nearest).cast("int")
    return rows.filter(kept).select(*by, "component", frame.alias("frame"), "seed", "area", "left_px", "top_px", "right_px", "bottom_px", *LAYOUT)


def viewports(found: DataFrame, by: list[str], padding: int = PADDING) -> DataFrame:
    """For each figure of :func:`figures` its box, fragments and where it goes: dx, dy, frame_w, frame_h.

    All figures of a sheet share one size.  Heights are kept relative to the top of the figures in
    the same row of the grid, so what rises stays risen; across, each figure is centred.
    """
    one = found.groupBy(*by, "frame", *LAYOUT).agg(
        F.min("left_px").alias("left_px"), F.min("top_px").alias("top_px"), F.max("right_px").alias("right_px"), F.max("bottom_px").alias("bottom_px"), (F.count(F.lit(1)) - 1).alias("fragments"),
    ).withColumn("band", _band("top_px", "bottom_px"))
    sheet, row = Window.partitionBy(*by), Window.partitionBy(*by, "band")
    one = one.withColumns({"row_top": F.min("top_px").over(row), "row_bottom": F.max("bottom_px").over(row)})
    one = one.withColumns({
        "frame_w": F.max(F.col("right_px") - F.col("left_px")).over(sheet) + 2 * padding,
        "frame_h": F.max(F.col("row_bottom") - F.col("row_top")).over(sheet) + 2 * padding,
    })
    dx = F.floor((F.col("frame_w") - (F.col("right_px") - F.col("left_px"))) / 2).cast("int") - F.col("left_px")
    return one.withColumns({"dx": dx, "dy": F.lit(padding) - F.col("row_top")})


def overlapping(views: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of a sheet's figures whose boxes intersect: overlaps, one row a sheet."""
    box = F.struct("frame", "left_px", "top_px", "right_px", "bottom_px")
    listed = views.groupBy(*by).agg(F.collect_list(box).alias("boxes"))
    meets = lambda a, b: (a["frame"] < b["frame"]) & (a["left_px"] < b["right_px"]) & (b["left_px"] < a["right_px"]) & (a["top_px"] < b["bottom_px"]) & (b["top_px"] < a["bottom_px"])
    met = F.aggregate("boxes", F.lit(0), lambda n, a: n + F.size(F.filter("boxes", lambda b: meets(a, b))))
    return listed.select(*by, met.cast("long").alias("overlaps"))


def cells(px: DataFrame, layouts: DataFrame, by: list[str]) -> DataFrame:
    """Pixels by cell: frame, x and y within it, cell_w, cell_h.

    A sheet is first cropped about its middle to a multiple of its columns and rows, the odd pixel
    going right or below; cells are numbered row by row, and those beyond ``frames`` are left out.
    """
    rows = px.filter("a > 0").join(layouts.select(*by, *LAYOUT), by)
    rows = rows.withColumns({"cell_w": F.floor(F.col("width") / F.col("cols")).cast("int"), "cell_h": F.floor(F.col("height") / F.col("rows")).cast("int")})
    inner = lambda c, size, n, cell: F.col(c) - F.floor((F.col(size) - F.col(n) * F.col(cell)) / 2).cast("int")
    rows = rows.withColumns({"ix": inner("x", "width", "cols", "cell_w"), "iy": inner("y", "height", "rows", "cell_h")})
    rows = rows.filter((F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < F.col("cols") * F.col("cell_w")) & (F.col("iy") < F.col("rows") * F.col("cell_h")))
    frame = F.floor(F.col("iy") / F.col("cell_h")) * F.col("cols") + F.floor(F.col("ix") / F.col("cell_w"))
    rows = rows.withColumn("frame", frame.cast("int")).filter("frame < frames")
    return rows.withColumns({"x": F.col("ix") % F.col("cell_w"), "y": F.col("iy") % F.col("cell_h")}).drop("ix", "iy")


def _shared_range(slots: DataFrame, by: list[str], padding: int) -> DataFrame:
    """The rows of a cell that the figures of a sheet use in any of its cells, with free space: top, bottom."""
    return slots.groupBy(*by).agg(F.greatest(F.lit(0), F.min("y") - padding).alias("top"), F.least(F.first("cell_h"), F.max("y") + 1 + padding).alias("bottom"))


def split(px: DataFrame, layouts: DataFrame, by: list[str], method: str = "auto", padding: int = PADDING, **areas: float) -> tuple[DataFrame, DataFrame]:
    """A sheet's frames, as what was found of each sheet and as pixels.

    First: the key columns, method, frames, frame_w, frame_h, fragments, overlaps; a row for every
    layout.  Second: the key columns, frame, x, y, r, g, b, a.  Methods: ``components`` (figures by
    components; a sheet that has too few gets a null method and no frames), ``stable_slots`` (cells,
    cropped to the rows that any of them uses), ``slots`` (cells), ``auto`` (components, and stable
    slots for the sheets that have too few).  Which way a sheet goes is decided in the plan.  A sheet
    without opaque pixels has whole cells.  ``areas``: those of :func:`figures`.

    Labelled pixels and figures are checkpointed, as frames and what is found of a sheet both read them.
    """
    if method not in ("auto", "components", "stable_slots", "slots"):
        raise ValueError(f"unknown method {method}")
    layouts = layouts.select(*by, *LAYOUT)
    parts, facts = [], []
    keep = [*by, "frame", "x", "y", "r", "g", "b", "a"]
    rest, left = px, layouts
    if method in ("auto", "components"):
        labelled = cut(stencil.components(px.filter("a > 0"), by, ("r", "g", "b", "a")))
        found = cut(figures(stencil.component_boxes(labelled, by), layouts, by, **areas))
        views = viewports(found, by, padding)
        moves = found.select(*by, "component", "frame").join(views.select(*by, "frame", "dx", "dy"), [*by, "frame"])
        own = labelled.join(moves, [*by, "component"])
        parts.append(own.withColumns({"x": F.col("x") + F.col("dx"), "y": F.col("y") + F.col("dy")}).select(*keep))
        one = views.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("frame_w").alias("frame_w"), F.max("frame_h").alias("frame_h"), F.sum("fragments").alias("fragments"))
        one = one.join(overlapping(views, by), by)
        facts.append(one.select(*by, F.lit("components").alias("method"), F.col("n").alias("frames"), "frame_w", "frame_h", "fragments", "overlaps"))
        left = layouts.join(one.select(*by), by, "left_anti")
        rest = px.join(left.select(*by), by, "left_semi")
    none = F.lit(0).cast("long")
    if method == "components":
        nothing = F.lit(None).cast("int")
        facts.append(left.select(*by, F.lit(None).cast("string").alias("method"), none.alias("frames"), nothing.alias("frame_w"), nothing.alias("frame_h"), none.alias("fragments"), none.alias("overlaps")))
    else:
        slots, stable = cells(rest, left, by), method != "slots"
        whole = left.withColumns({"frame_w": F.floor(F.col("width") / F.col("cols")).cast("int"), "cell_h": F.floor(F.col("height") / F.col("rows")).cast("int")})
        if stable:
            used = _shared_range(slots, by, padding)
            whole = whole.join(used, by, "left").withColumn("frame_h", F.coalesce(F.col("bottom") - F.col("top"), F.col("cell_h")))
            slots = slots.join(used, by).withColumn("y", F.col("y") - F.col("top"))
        else:
            whole = whole.withColumn("frame_h", F.col("cell_h"))
        parts.append(slots.select(*keep))
        name = "stable_slots" if stable else "slots"
        facts.append(whole.select(*by, F.lit(name).alias("method"), F.col("frames").cast("long").alias("frames"), "frame_w", "frame_h", none.alias("fragments"), none.alias("overlaps")))
    both = lambda rows: rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return both(facts), both(parts)


def uniform_sizes(frames: DataFrame, by: list[str]) -> DataFrame:
    """Of frames (the key columns, width, height): whether all are of one size, and the size that all
    can be cropped to."""
    sizes = frames.groupBy(*by).agg(F.min("width").alias("width"), F.min("height").alias("height"), F.max("width").alias("widest"), F.max("height").alias("highest"))
    return sizes.select(*by, "width", "height", ((F.col("width") == F.col("widest")) & (F.col("height") == F.col("highest"))).alias("uniform"))


def _line(index: Column, size: str, n: str) -> Column:
    """Where a line of the grid lies: half places go to the even one."""
    return F.bround(index * F.col(size) / F.col(n)).cast("int")


def _cell(at: str, size: str, n: str) -> Column:
    """The cell of a place, between lines at rounded places."""
    c = F.floor(F.col(at) * F.col(n) / F.col(size))
    return (c + (F.col(at) >= _line(c + 1, size, n)).cast("int") - (F.col(at) < _line(c, size, n)).cast("int")).cast("int")


def overflow(px: DataFrame, layouts: DataFrame, by: list[str], tolerance: int = 1) -> DataFrame:
    """Where the figures of a sheet leave their cells, measured on the whole sheet before it is cut.

    gutter_lines (inner grid lines with opaque pixels in the band of ``tolerance`` about them),
    band_pixels (of all bands), crossings (components in more than one cell), min_margin (the least
    free share at a side of the first ``frames`` cells; empty cells do not count, a sheet without
    content has 0) and clean.  One row for every layout.  Pixels are counted by column and row before
    they meet the bands, so a sheet costs its width and height in the join.
    """
    layouts = layouts.select(*by, *LAYOUT)
    opaque = px.filter("a > 0")
    sides = F.explode(F.array(F.struct(F.lit("vertical").alias("axis"), F.col("x").alias("at")), F.struct(F.lit("horizontal").alias("axis"), F.col("y").alias("at"))))
    profile = opaque.select(*by, sides.alias("s")).groupBy(*by, "s.axis", "s.at").agg(F.count(F.lit(1)).alias("n"))
    bands = None
    for axis, size, n in (("vertical", "width", "cols"), ("horizontal", "height", "rows")):
        one = layouts.filter(F.col(n) > 1).select("*", F.explode(F.sequence(F.lit(1), F.col(n) - 1)).alias("line"))
        reach = F.sequence(F.greatest(F.lit(0), _line(F.col("line"), size, n) - tolerance), F.least(F.col(size) - 1, _line(F.col("line"), size, n) + tolerance))
        one = one.select(*by, F.lit(axis).alias("axis"), "line", F.explode(reach).alias("at"))
        bands = one if bands is None else bands.unionByName(one)
    hit = bands.join(profile, [*by, "axis", "at"]).groupBy(*by, "axis", "line").agg(F.sum("n").alias("n"))
    hit = hit.groupBy(*by).agg(F.count(F.lit(1)).alias("gutter_lines"), F.sum("n").alias("band_pixels"))
    cell = F.floor(F.col("x") * F.col("cols") / F.col("width")) + F.col("cols") * F.floor(F.col("y") * F.col("rows") / F.col("height"))
    pieces = stencil.components(opaque, by).join(layouts, by).groupBy(*by, "component").agg((F.min(cell) < F.max(cell)).alias("crosses"))
    crossed = pieces.groupBy(*by).agg(F.count_if("crosses").alias("crossings"))
    placed = opaque.join(layouts, by).withColumns({"col": _cell("x", "width", "cols"), "row": _cell("y", "height", "rows")}).filter("row * cols + col < frames")
    inside = placed.groupBy(*by, *LAYOUT, "col", "row").agg(F.min("x").alias("l"), F.max("x").alias("r"), F.min("y").alias("t"), F.max("y").alias("d"))
    x0, x1, y0, y1 = _line(F.col("col"), "width", "cols"), _line(F.col("col") + 1, "width", "cols"), _line(F.col("row"), "height", "rows"), _line(F.col("row") + 1, "height", "rows")
    free = F.least((F.col("l") - x0) / (x1 - x0), (x1 - 1 - F.col("r")) / (x1 - x0), (F.col("t") - y0) / (y1 - y0), (y1 - 1 - F.col("d")) / (y1 - y0))
    margin = inside.groupBy(*by).agg(F.min(free).alias("min_margin"))
    out = layouts.join(hit, by, "left").join(crossed, by, "left").join(margin, by, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gutter_lines", "band_pixels", "crossings")} | {"min_margin": F.coalesce("min_margin", F.lit(0.0))}
    return out.withColumns(zero).select(*by, "gutter_lines", "band_pixels", "crossings", "min_margin", ((F.col("gutter_lines") == 0) & (F.col("crossings") == 0)).alias("clean"))


def cell_overflow(boxes: DataFrame, layouts: DataFrame, by: list[str], **areas: float) -> DataFrame:
    """The check that a sheet's source still comes apart into its frames: result, measured, lim,
    fragments.  ``boxes`` are the components of the sources.  PASS and the number of frames where it
    does, FAIL and 0 where it does not, SKIP where the layout is unknown (a null in it)."""
    known = layouts.dropna(subset=LAYOUT)
    found = figures(boxes, known, by, **areas).groupBy(*by).agg(F.count_if(~F.col("seed")).alias("fragments"))
    rows = layouts.join(found, by, "left").withColumn("unknown", F.greatest(*(F.col(c).isNull() for c in LAYOUT)))
    return rows.select(
        *by, F.when(F.col("unknown"), "SKIP").when(F.col("fragments").isNotNull(), "PASS").otherwise("FAIL").alias("result"),
        F.when(~F.col("unknown"), F.when(F.col("fragments").isNotNull(), F.col("frames")).otherwise(0)).cast("long").alias("measured"),
        F.when(~F.col("unknown"), F.col("frames")).cast("long").alias("lim"), F.coalesce("fragments", F.lit(0)).cast("long").alias("fragments"),
    )
