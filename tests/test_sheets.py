"""Cut-outs, splitting and overflow on small drawn sheets."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import keying, sheets, stencil

BY = ["sheet"]


def plain_ground(under):
    """Opening, closing and a flood from the border, cell by cell."""
    h, w = under.shape
    grid = np.pad(under, 3, constant_values=True)
    for all_of in (True, False, False, True):
        wide = np.pad(grid, 1, constant_values=True)
        grid = np.array([[(wide[i : i + 3, j : j + 3].all() if all_of else wide[i : i + 3, j : j + 3].any()) for j in range(w + 6)] for i in range(h + 6)])
    seen, todo = np.zeros_like(grid), deque([(0, 0)])
    while todo:
        i, j = todo.pop()
        if 0 <= i < h + 6 and 0 <= j < w + 6 and grid[i, j] and not seen[i, j]:
            seen[i, j] = True
            todo.extend([(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)])
    return seen[3:-3, 3:-3]


def test_ground_against_a_flood(spark):
    r = np.random.default_rng(5)
    drawn = [r.random((h, w)) < p for h, w, p in ((9, 14, 0.9), (12, 12, 0.95), (5, 7, 0.5), (1, 1, 1), (20, 20, 0.97), (6, 6, 0), (6, 6, 1.1))]
    ring = np.ones((24, 24), bool)
    ring[6:18, 6:18] = False
    ring[10:14, 10:14] = True  # a hole that the figure encloses
    drawn.append(ring)
    rows = [(k, x, y, bool(d[y, x]), d.shape[1], d.shape[0]) for k, d in enumerate(drawn) for y in range(d.shape[0]) for x in range(d.shape[1])]
    px = spark.createDataFrame(rows, "sheet int, x int, y int, near boolean, w int, h int")
    got = stencil.grounded(px, BY, "near", "w", "h").collect()
    assert len(got) == len(rows)
    for k, d in enumerate(drawn):
        want = plain_ground(d)
        assert all(want[r["y"], r["x"]] == r["ground"] for r in got if r["sheet"] == k)
    assert not any(r["ground"] for r in got if r["sheet"] == 7 and 6 <= r["x"] < 18 and 6 <= r["y"] < 18)
    # The same by the composition of stencils over a padded mask: its outside is component 0.
    one = px.filter("sheet = 4 AND near").select("sheet", (F.col("x") + 3).alias("x"), (F.col("y") + 3).alias("y"))
    frame = spark.createDataFrame([(4, i, j) for i in range(26) for j in range(26) if not (3 <= i < 23 and 3 <= j < 23)], "sheet int, x int, y int")
    cleaned = stencil.closed(stencil.opened(one.union(frame), BY, 26, 26), BY, 26, 26)
    outer = {(r["x"] - 3, r["y"] - 3) for r in stencil.components(cleaned, BY).filter("component = 0").collect()}
    assert {(r["x"], r["y"]) for r in got if r["sheet"] == 4 and r["ground"]} == {(x, y) for x, y in outer if 0 <= x < 20 and 0 <= y < 20}


def test_a_figure_keeps_its_hole(spark):
    key, green = (255, 0, 255), (10, 200, 10)
    image = {(x, y): key for x in range(24) for y in range(20)} | {(x, y): green for x in range(6, 18) for y in range(4, 16)} | {(x, y): key for x in range(10, 14) for y in range(8, 12)}
    px = spark.createDataFrame([("s", x, y, *c) for (x, y), c in image.items()], "sheet string, x int, y int, r int, g int, b int")
    limits = spark.createDataFrame([("s", 90.0), ("none", 1.0)], "sheet string, threshold double")
    rows = keying.cut_out(px, limits, BY, key, 24, 20)
    opaque = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in rows.filter("a > 0").collect()}
    assert opaque == {p: image[p] for p in image if 6 <= p[0] < 18 and 4 <= p[1] < 16}
    assert rows.filter("a = 0 AND (r > 0 OR g > 0 OR b > 0)").count() == 0
    s = keying.cut_out_stats(rows, BY).first()
    assert (s["holes"], s["filled"], s["halo"], s["suspicious"]) == (16, 0, 0, False) and s["background_ratio"] == pytest.approx(1 - 144 / 480)


def draw(spark, sheets_):
    """Rectangles (left, top, right, bottom) of each sheet as pixels whose colour names the rectangle."""
    rows = {}
    for name, boxes in sheets_.items():
        for i, (x0, y0, x1, y1) in enumerate(boxes):
            rows.update({(name, x, y): i for x in range(x0, x1) for y in range(y0, y1)})
    return spark.createDataFrame([(*k, i, 0, 0, 255) for k, i in rows.items()], "sheet string, x int, y int, r int, g int, b int, a int")


def layouts(spark, *rows):
    return spark.createDataFrame(rows, "sheet string, width int, height int, cols int, rows int, frames int")


FIGURES = {
    # Reading order by bands; a fragment beside the third; a speck of noise.
    "good": [(62, 6, 80, 40), (8, 10, 30, 38), (10, 60, 28, 90), (66, 55, 84, 95), (30, 62, 34, 66), (98, 2, 99, 3)],
    # All four run together, so the sheet goes by its cells.
    "joined": [(5, 5, 95, 30), (5, 30, 20, 90)],
    "empty": [],
}


def test_split_by_components_and_by_slots(spark):
    px = draw(spark, FIGURES)
    lay = layouts(spark, ("good", 100, 100, 2, 2, 4), ("joined", 101, 100, 2, 2, 4), ("empty", 90, 60, 3, 2, 5))
    facts, pixels = sheets.split(px, lay, BY)
    got = {r["sheet"]: tuple(r)[1:] for r in facts.collect()}
    # Widest box: the third figure with its fragment, 24; heights by row of the grid: 34 and 40.
    assert got == {"good": ("components", 4, 24 + 8, 40 + 8, 1, 0), "joined": ("stable_slots", 4, 50, 50, 0, 0), "empty": ("stable_slots", 5, 30, 30, 0, 0)}
    frames = {}
    for r in pixels.filter("sheet = 'good'").collect():
        frames.setdefault((r["frame"], r["r"]), []).append((r["x"], r["y"]))
    corners = {k: (min(v), max(v)) for k, v in frames.items()}
    # Second in the first row: 4 below its row's top, as drawn.
    assert corners == {
        (0, 1): ((5, 8), (26, 35)), (1, 0): ((7, 4), (24, 37)),
        (2, 2): ((4, 9), (21, 38)), (2, 4): ((24, 11), (27, 14)), (3, 3): ((7, 4), (24, 43)),
    }
    assert pixels.filter("sheet = 'joined'").count() == 90 * 25 + 15 * 60 and pixels.filter("sheet = 'joined'").agg(F.min("y"), F.max("x")).first() == (0, 49)
    only = {r["sheet"]: tuple(r)[1:3] for r in sheets.split(px, lay, BY, "components")[0].collect()}
    assert only == {"good": ("components", 4), "joined": (None, 0), "empty": (None, 0)}
    plain = sheets.split(px, lay, BY, "slots")
    assert {r["sheet"]: r["frame_h"] for r in plain[0].collect()} == {"good": 50, "joined": 50, "empty": 30}
    assert plain[1].filter("sheet = 'good'").count() == sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in FIGURES["good"])
    with pytest.raises(ValueError, match="method"):
        sheets.split(px, lay, BY, "other")


def test_overflow_of_drawn_sheets(spark):
    px = draw(spark, {"clean": [(10, 10, 40, 40), (60, 12, 90, 40)], "over": [(40, 10, 60, 40)], "near": [(30, 10, 50, 40)], "empty": []})
    lay = layouts(spark, *((s, 100, 50, 2, 1, 2) for s in ("clean", "over", "near", "empty")))
    got = {r["sheet"]: tuple(r)[1:] for r in sheets.overflow(px, lay, BY).collect()}
    assert got == {"clean": (0, 0, 0, pytest.approx(0.2), True), "over": (1, 90, 1, 0.0, False), "near": (1, 30, 0, 0.0, False), "empty": (0, 0, 0, 0.0, True)}


def test_check_that_a_source_comes_apart(spark):
    boxes = stencil.component_boxes(stencil.components(draw(spark, FIGURES), BY), BY)
    lay = layouts(spark, ("good", 100, 100, 2, 2, 4), ("joined", 100, 100, 2, 2, 4), ("empty", 90, 60, None, 2, 5))
    got = {r["sheet"]: tuple(r)[1:] for r in sheets.cell_overflow(boxes, lay, BY).collect()}
    assert got == {"good": ("PASS", 4, 4, 1), "joined": ("FAIL", 0, 4, 0), "empty": ("SKIP", None, None, 0)}


def test_sizes_of_frames(spark):
    rows = [("a", 0, 5, 6), ("a", 1, 5, 6), ("b", 0, 5, 6), ("b", 1, 4, 7)]
    frames = spark.createDataFrame(rows, "sheet string, frame int, width int, height int")
    assert sorted(map(tuple, sheets.uniform_sizes(frames, BY).collect())) == [("a", 5, 6, True), ("b", 4, 6, False)]
