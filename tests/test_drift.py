"""Stored tables against pixels, on tiles drawn by hand."""

from tessella.operators import drift, tiles

CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")
GRASS, DIRT = (80, 130, 70), (150, 90, 50)


def quads(spark, drawn):
    """Tiles of 4 x 4 whose quadrants have one colour each."""
    px = [(s, t, x, y, *colors[(x > 1) + 2 * (y > 1)]) for (s, t), colors in drawn.items() for x in range(4) for y in range(4)]
    rows = spark.createDataFrame(px, "tileset long, tile_id string, x int, y int, r int, g int, b int")
    return tiles.quadrants(rows, 4, 4).join(rows.select("tileset", "tile_id").distinct(), "tile_id")


def test_corners_three_ways(spark):
    drawn = {(s, f"{s}g"): [GRASS] * 4 for s in range(5)} | {(s, f"{s}d"): [DIRT] * 4 for s in range(5)} | {(s, f"{s}m"): [GRASS, DIRT, GRASS, (255, 0, 255)] for s in range(5)}
    q = quads(spark, drawn)
    stored = []
    for s, t in drawn:
        kind = t[1:]
        for i, c in enumerate(CORNERS):
            name = {"g": "grass", "d": "dirt"}.get(kind) or ("grass", "dirt", "grass", None)[i]
            far = 0.0 if name else None
            declared = {"g": "grass", "d": "dirt"}.get(kind)
            stored.append([s, t, c, declared, name, far])
    row = {(r[1], r[2]): r for r in stored}
    far = {(r["tile_id"], r["corner"]): r["distance"] for r in drift.measured_corners(q, spark.createDataFrame([(s, n, f"{s}{k}") for s in range(5) for n, k in (("grass", "g"), ("dirt", "d"))], "tileset long, terrain string, tile_id string"), spark.createDataFrame([(s, 12.0) for s in range(5)], "tileset long, distance_max double")).collect()}
    for r in stored:
        r[5] = far[r[1], r[2]]
    # Set 0: one stored terrain, one stored distance and one declaration are not what the pixels say.
    row["0m", "top_left"][4], row["0m", "top_right"][5], row["0m", "bottom_left"][3] = "dirt", far["0m", "top_right"] + 1e-3, "dirt"
    row["0m", "bottom_right"][3] = "grass"
    # Set 1 declares water without a base, set 2 nothing at all, set 3 lacks pixels, set 4 stores nothing.
    row["1m", "top_left"][3] = "water"
    for r in stored:
        if r[0] == 2:
            r[3] = None
    table = spark.createDataFrame([tuple(r) for r in stored], "tileset long, tile_id string, corner string, declared string, terrain string, distance double")
    limits = spark.createDataFrame([(s, 12.0) for s in range(4)], "tileset long, distance_max double")
    declared = spark.createDataFrame([*drawn, (3, "lost")], "tileset long, tile_id string")
    got = {(r["tileset"], r["target"]): (r["result"], r["table_drift"], r["declared_mismatch"], r["skip_reason"]) for r in drift.terrain_checks(table, q, limits, declared).collect()}
    want = {(0, f"{t}/{c}"): ("PASS", False, False, None) for t in ("0g", "0d") for c in CORNERS} | {
        (0, "0m/top_left"): ("FAIL", True, False, None), (0, "0m/top_right"): ("FAIL", True, False, None), (0, "0m/bottom_left"): ("FAIL", False, True, None), (0, "0m/bottom_right"): ("FAIL", False, True, None),
        (1, "tileset"): ("FAIL", None, None, None), (2, "tileset"): ("FAIL", None, None, None), (3, "tileset"): ("SKIP", None, None, "dependency_failed"), (4, "tileset"): ("SKIP", None, None, "not_applicable"),
    }
    assert got == want
    assert [tuple(r) for r in drift.terrains_without_base(table).collect()] == [(1, "water")]


def test_neighbours_both_ways(spark):
    sets = {0: ("a", "b"), 1: ("c",), 2: ("d",), 3: ("e",)}
    fits = {("right", "a", "b"), ("down", "a", "a"), ("right", "c", "c"), ("right", "d", "d"), ("down", "b", "a")}
    measures = [("horizontal" if d == "right" else "vertical", x, y, 0.5 if (d, x, y) in fits else 5.0, 1.0) for s in sets.values() for x in s for y in s for d in ("right", "down")]
    measures = spark.createDataFrame(measures, "axis string, src string, dst string, seam_ratio double, color_gap double")
    tile = "tileset long, tile_id string"
    present = spark.createDataFrame([(s, t) for s, ts in sets.items() for t in ts], tile)
    declared = present.union(spark.createDataFrame([(2, "lost")], tile))
    stored = spark.createDataFrame([(0, "right", "a", "b"), (0, "right", "a", "a"), (0, "right", "a", "a"), (0, "down", "b", "a"), (1, "right", "c", "c")], "tileset long, direction string, tile_id string, other string")
    limits = spark.createDataFrame([(0, 1.0, 28.0), (1, 1.0, 28.0), (2, 1.0, 28.0)], "tileset long, seam_max double, gap_max double")
    fresh = drift.fresh_edges(measures, limits, declared)
    assert sorted(tuple(r)[1:] for r in drift.edge_drift(stored, fresh).filter("tileset = 0").collect()) == [("down", "a", "a", "missing"), ("right", "a", "a", "surplus")]
    got = {(r["tileset"], r["target"]): (r["result"], r["measured"], r["skip_reason"]) for r in drift.adjacency_checks(stored, measures, limits, declared, present).collect()}
    assert got == {(0, "a"): ("FAIL", 2, None), (0, "b"): ("PASS", 0, None), (1, "c"): ("PASS", 0, None), (2, "tileset"): ("SKIP", None, "dependency_failed"), (3, "tileset"): ("SKIP", None, "not_applicable")}
