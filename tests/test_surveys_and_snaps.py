"""Block snapping, shared scales and palettes, overview pictures, terrain bits and packs on small fixtures."""

import colorsys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import gridsnap, jobs, overview, survey, tiles
from tessella.sources import exports

PX = "x int, y int, r int, g int, b int, a int"


def pixels(spark, images):
    rows = [(k, x, y, *map(int, im[y, x])) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, f"id string, {PX}")


def plain_snap(im, block, fixed):
    """The decision and the result for one image with transparency, array by array."""
    h, w = im.shape[:2]
    opaque = im[..., 3] > 0
    before = len({tuple(c) for c in im[opaque][:, :3]})
    if block is None or block < 3:
        return (block or 1.0, w, h, before, before, False)
    cols, rows = max(1, round(w / block)), max(1, round(h / block))
    bw, bh = max(1, round(w / cols)), max(1, round(h / rows))
    at = lambda n, old: ((2 * np.arange(n) + 1) * old) // (2 * n)
    fit = im[at(rows * bh, h)][:, at(cols * bw, w)]
    out = np.zeros((rows, cols, 4), int)
    for j in range(rows):
        for i in range(cols):
            cell = fit[j * bh : (j + 1) * bh, i * bw : (i + 1) * bw].reshape(-1, 4)
            full = cell[cell[:, 3] > 0]
            if len(full) * 2 > len(cell):
                out[j, i] = [*np.median(full[:, :3], axis=0).astype(int), 255]
    after = len({tuple(c) for c in out[out[..., 3] > 0][:, :3]})
    error = 0.0
    if rows >= 2 and cols >= 2 and opaque.any():
        back = out[at(h, rows)][:, at(w, cols)]
        error = np.abs(back[..., :3] - im[..., :3]).max(-1)[opaque].mean()
    if not fixed and before / max(1, after) < 4:
        return (block, w, h, before, before, False)
    if not fixed and error > 20:
        return (1.0, w, h, before, before, False)
    return (block, cols, rows, before, after, True)


def test_snapping_against_arrays(spark):
    r = np.random.default_rng(6)
    images, sizes, want = {}, [], {}
    for k in range(18):
        cols, rows, scale = r.integers(2, 6), r.integers(2, 5), int(r.integers(3, 6))
        small = np.concatenate([r.integers(0, 256, (rows, cols, 3)), np.where(r.random((rows, cols, 1)) < 0.8, 255, 0)], -1)
        im = small.repeat(scale, 0).repeat(scale, 1)[: rows * scale - int(r.integers(2)), :]
        if k % 3:
            im[..., :3] = np.clip(im[..., :3] + r.integers(-3, 4, im.shape[:2] + (1,)), 0, 255)
        if k == 4:
            im[..., 3] = 0
        block = [float(scale), scale + 0.5, None, 2.0, float(scale + 2)][k % 5]
        fixed = k % 4 == 3 and block is not None
        images[str(k)] = im
        sizes.append((str(k), im.shape[1], im.shape[0], block, fixed))
        want[str(k)] = plain_snap(im, block, fixed)
    table = spark.createDataFrame(sizes, "id string, width int, height int, block double, fixed boolean")
    facts, px = gridsnap.snap(pixels(spark, images), table, ["id"])
    assert {x["id"]: tuple(x)[1:] for x in facts.collect()} == want
    assert {w[5] for w in want.values()} == {True, False}
    count = {x["id"]: x["count"] for x in px.groupBy("id").count().collect()}
    assert all(count.get(k, 0) == (im[..., 3] > 0).sum() for k, im in images.items() if not want[k][5])


def test_scales_follow_the_tallest_action(spark):
    rows = [
        ("a", "seed", 0, False, 99, 10, 100, 50), ("a", "walk", 1, False, 40, 20, 80, 30), ("a", "hurt", 2, False, 50, 90, 100, 31), ("a", "idle", 3, None, 20, 10, 80, 9),
        ("a", "blend", 4, True, 79, 10, 80, 9), ("b", "seed", 0, False, 16, 8, 16, 32), ("c", "walk", 0, False, 0, 0, 10, 0),
    ]
    actions = spark.createDataFrame(rows, "asset string, action string, place int, interpolated boolean, content_height int, content_width int, cell_height int, output_height int")
    found = survey.profiles(actions, ["asset"], 32)
    assert {r["asset"]: tuple(r)[1:] for r in found.collect()} == {"a": ("walk", 0.5, 30 / 32), "c": ("walk", 0.0, 0.0)}
    got = {(r["asset"], r["action"]): (r["target_height"], r["scale"], r["uneven"]) for r in survey.scaled(actions, found, ["asset"], (32, 32)).collect()}
    assert got["a", "walk"] == (30.0, 0.75, False)
    # As tall in its cell as the reference, but too wide for the canvas.
    assert got["a", "hurt"] == (30.0, pytest.approx(32 / 90), False)
    assert got["a", "idle"] == (15.0, 0.75, False)
    assert got["b", "seed"] == (32.0, 2.0, False)
    assert got["c", "walk"] == (32.0, None, False)
    with pytest.raises(ValueError, match="height"):
        survey.profiles(actions, ["asset"], 0)


def test_all_actions_share_a_palette(spark):
    r = np.random.default_rng(2)
    rows = [(str(k % 2), ["walk", "hurt", "seed", "blend"][k % 4], k % 4 == 3, k % 8, k // 8, *map(int, r.integers(0, 256, 3)), 255 if k % 5 else 0) for k in range(400)]
    px = spark.createDataFrame(rows, f"asset string, action string, interpolated boolean, {PX}")
    entries = survey.shared_palettes(px, ["asset"], 4)
    listed = {}
    for e in entries.orderBy("asset", "entry").collect():
        listed.setdefault(e["asset"], []).append((e["r"], e["g"], e["b"]))
    # Asset 0 has measured actions only in walk; asset 1 in hurt: the seed and blends add nothing.
    assert {k: len(v) for k, v in listed.items()} == {"0": 4, "1": 4}
    alone = survey.shared_palettes(px.filter("action IN ('walk', 'hurt')"), ["asset"], 4)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, entries.collect()))
    got = {(x["asset"], x["action"], x["x"], x["y"]): (x["r"], x["g"], x["b"], x["a"]) for x in survey.recolored(px, entries, ["asset"]).collect()}
    for k, act, _, x, y, *c, a in rows:
        want = min(listed[k], key=lambda e: sum((p - q) ** 2 for p, q in zip(e, c, strict=True))) if a else (0, 0, 0)
        assert got[k, act, x, y] == (*want, a)
    assert survey.recolored(px, entries.filter("false"), ["asset"]).filter("a > 0").select("r", "g", "b").exceptAll(px.filter("a > 0").select("r", "g", "b")).count() == 0


def test_contact_sheet_of_unequal_frames(spark):
    frames = [("s", "b", 0, 3, 2), ("s", "b", 1, 2, 4), ("s", "a", 5, 1, 1), ("t", "x", 0, 2, 2)]
    px = [(s, g, f, x, y, f * 10 + 1, 2, 3, 255 if (x, y) != (0, 0) or w == 1 else 0) for s, g, f, w, h in frames for x in range(w) for y in range(h)]
    table = spark.createDataFrame(frames, "sheet string, group string, frame int, width int, height int")
    sizes, placed = overview.contact_sheet(spark.createDataFrame(px, f"sheet string, group string, frame int, {PX}"), table, ["sheet"])
    assert {tuple(r) for r in sizes.collect()} == {("s", 6, 8), ("t", 2, 2)}
    want = np.tile(np.array(overview.BACKGROUND), (8, 6, 1))
    for g, f, w, h in (("a", 5, 1, 1), ("b", 0, 3, 2), ("b", 1, 2, 4)):
        x0, y0 = 3 * (f == 1) + (3 - w) // 2, 4 * (g == "b") + (4 - h) // 2
        for x in range(w):
            for y in range(h):
                if (x, y) != (0, 0) or w == 1:
                    want[y0 + y, x0 + x] = (f * 10 + 1, 2, 3)
    got = overview.painted(sizes, placed, ["sheet"]).filter("sheet = 's'").collect()
    assert len(got) == 48 and all((r["r"], r["g"], r["b"]) == tuple(want[r["y"], r["x"]]) for r in got)


def test_tiles_next_to_themselves(spark):
    im = {t: np.arange(24).reshape(2, 3, 4) + 30 * i for i, t in enumerate("qp")}
    px = pixels(spark, im).withColumnRenamed("id", "tile_id").withColumn("set", F.lit(1))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in overview.tile_patches(px.filter("a > 3"), ["set"], 3, 2, repeat=2, scale=3).collect()}
    want = np.concatenate([np.tile(im[t].repeat(3, 0).repeat(3, 1), (2, 2, 1)) for t in "pq"])
    assert got == {(x, y): tuple(want[y, x, :3]) for y in range(want.shape[0]) for x in range(want.shape[1]) if want[y, x, 3] > 3}


def test_bits_and_their_text(spark):
    corners = {"a": ["grass"] * 4, "b": ["grass", "dirt", "dirt", "grass"], "c": ["sand", None, "sand", "sand"], "d": ["dirt", "dirt", "ash", "grass"]}
    rows = [(1, t, c, v) for t, vs in corners.items() for c, v in zip(tiles.CORNERS, vs, strict=True)]
    bits = tiles.peering_bits(spark.createDataFrame(rows, "set int, tile_id string, corner string, terrain string"), ["set"])
    assert {r["tile_id"]: tuple(r)[2:7] for r in bits.collect()} == {"a": (2, 2, 2, 2, 2), "b": (2, 2, 1, 1, 2), "c": (None,) * 5, "d": (1, 1, 1, 0, 2)}
    places = spark.createDataFrame([(1, t, i % 2, i // 2) for i, t in enumerate("abcd")], "set int, tile_id string, col int, row int")
    one = exports.tile_set(bits, places, ["set"], "atlas.png", 16, 16).first()
    lines = one["text"].split("\n")
    assert one["skipped"] == ["c"]
    assert lines[0] == '[gd_resource type="TileSet" load_steps=3 format=3]' and lines[-2] == 'sources/0 = SubResource("TileSetAtlasSource_000")'
    at = lines.index("1:0/0 = 0")
    assert lines[at + 1 : at + 7] == ["1:0/0/terrain_set = 0", "1:0/0/terrain = 2", *(f"1:0/0/terrains_peering_bit/{c}_corner = {n}" for c, n in zip(tiles.CORNERS, (2, 1, 1, 2), strict=True))]
    assert lines[lines.index("0:1/0 = 0") + 1] == "1:0/0 = 0" and "0:1/0/terrain_set = 0" not in lines
    for i, name in enumerate(["ash", "dirt", "grass"]):
        red, green, blue = colorsys.hsv_to_rgb(i * 0.6180339887498949 % 1, 0.55, 0.85)
        at = lines.index(f'terrain_set_0/terrain_{i}/name = "{name}"')
        assert lines[at + 1] == f"terrain_set_0/terrain_{i}/color = Color({red:.6f}, {green:.6f}, {blue:.6f}, 1)"
    none = exports.tile_set(bits.filter("terrain IS NULL").withColumn("names", F.array().cast("array<string>")), places.filter("tile_id = 'c'"), ["set"], "t.png", 8, 8).first()
    assert "terrain" not in none["text"] and none["skipped"] == ["c"]


def test_packs(spark):
    rows = [("p", "exported", True, None, False), ("p", "paused", None, True, None), ("q", "exported", False, False, True)]
    table = spark.createDataFrame(rows, "pack_id string, outcome string, cached boolean, resumed boolean, outcome_unknown boolean")
    got = {r["pack_id"]: r.asDict() for r in jobs.pack_counts(table).collect()}
    assert got["p"] | {} == {"pack_id": "p", "total": 2, **dict.fromkeys(jobs.OUTCOMES, 0), "exported": 1, "paused": 1, "cached": 1, "resumed": 1, "outcome_unknown": 0}
    assert got["q"]["outcome_unknown"] == 1 and jobs.pack_counts(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown outcome lost"):
        jobs.pack_counts(table.withColumn("outcome", F.lit("lost"))).collect()
