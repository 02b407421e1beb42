"""Queries over whole assets: scales and palettes that all actions share, overview pictures, terrain bits, packs.

An asset is a key of frames; its actions are the frames' numbers by five, one of them the seed, one
of them interpolated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import poses
from tessella.operators import drift, jobs, masks, overview, palette, survey, tiles
from tessella.plans import bindings as b
from tessella.plans.drift_queries import CORNERS, DECLARED, _declare, _quads
from tessella.plans.frame_queries import BLOCKS, FRAME, METRICS
from tessella.plans.registry import query
from tessella.plans.tile_queries import _VIEWS

CANVAS = (32, 32)
ACTIONS = ["walk", "seed", "attack", "idle", "blend"]


def _action() -> F.Column:
    return F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("frame_idx") % 5 + 1)


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, action, place, interpolated, content_height, content_width, cell_height, output_height."""
    boxes = masks.frame_metrics(b.mask8(spark, sf_dir, 0.2), FRAME)
    rows = boxes.withColumns({"action": _action(), "place": F.col("frame_idx") % 5})
    height, width = F.max(F.col("bottom_px") - F.col("top_px")), F.max(F.col("right_px") - F.col("left_px"))
    out = rows.groupBy("key", "action", "place").agg(height.alias("content_height"), width.alias("content_width"))
    return out.withColumns({"interpolated": F.col("action") == "blend", "cell_height": F.lit(8), "output_height": F.col("content_height") * 4 - F.col("place")})


ACT = (
    f"{b.mask_sql(0.2)}, {METRICS}, ac AS (SELECT key, frame_idx % 5 AS place, {ACTIONS}[frame_idx % 5 + 1] AS action, max(bottom_px - top_px) AS h, max(right_px - left_px) AS w FROM me GROUP BY ALL), "
    "pf AS (SELECT key, arg_min(action, (-h, place)) AS reference, max(h) / 8 AS subject_ratio, arg_min(h * 4 - place, (-h, place)) / 32 AS canvas_fraction FROM ac WHERE action NOT IN ('seed', 'blend') GROUP BY key)"
)


@query(
    f"WITH {ACT}, sc AS (SELECT key, action, reference, CASE WHEN reference IS NULL THEN 32.0 ELSE canvas_fraction * (h / 8 / subject_ratio) * 32 END AS target_height, h, w FROM ac LEFT JOIN pf USING (key)), "
    "s2 AS (SELECT *, least(target_height / h, 32 / w, 32 / h) AS scale FROM sc) SELECT key, action, reference, round(target_height, 6) AS target_height, round(scale, 6) AS scale, scale > 1 AND abs(scale - round_even(scale, 0)) > 1e-6 AS uneven FROM s2"
)
def surveyed_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of every action under the action that fixes its asset's."""
    rows = actions(spark, sf_dir)
    out = survey.scaled(rows, survey.profiles(rows, ["key"], CANVAS[1]), ["key"], CANVAS)
    return out.select("key", "action", "reference", F.round("target_height", 6).alias("target_height"), F.round("scale", 6).alias("scale"), "uneven")


@query(None)
def surveyed_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of every action have each colour of their asset's shared palette."""
    px = b.rgba4(spark, sf_dir).withColumns({"action": _action(), "interpolated": F.col("frame_idx") % 5 == 4})
    out = survey.recolored(px, survey.shared_palettes(px, ["key"], 16), ["key"])
    return out.filter("a > 0").groupBy("key", "action", "r", "g", "b").agg(F.count(F.lit(1)).alias("pixels"))


@query(
    f"WITH {b.mask_sql(0.2)}, {METRICS}, fs AS (SELECT key, frame_idx % 3 AS grp, frame_idx, vec_id, left_px, top_px, right_px - left_px AS w, height AS h, row_number() OVER (PARTITION BY key, frame_idx % 3 ORDER BY frame_idx) - 1 AS c FROM me), "
    "lo AS (SELECT *, dense_rank() OVER (PARTITION BY key ORDER BY grp) - 1 AS r, max(w) OVER k AS cw, max(h) OVER k AS ch FROM fs WINDOW k AS (PARTITION BY key)), "
    "sz AS (SELECT key, (max(c) + 1) * max(cw) AS w, (max(r) + 1) * max(ch) AS h FROM lo GROUP BY key), "
    "pt AS (SELECT lo.key, c * cw + (cw - w) // 2 + pl.x - left_px AS x, r * ch + (ch - h) // 2 + pl.y - top_px AS y, gray FROM lo JOIN pl ON pl.vec_id = lo.vec_id WHERE v > 0.2) "
    "SELECT sz.key, i AS x, j AS y, coalesce(gray, 32) AS r, coalesce(255 - gray, 32) AS g, coalesce(9, 40) + CASE WHEN gray IS NULL THEN 31 ELSE 0 END AS b FROM sz, unnest(range(sz.w)) a(i), unnest(range(sz.h)) d(j) LEFT JOIN pt ON pt.key = sz.key AND pt.x = i AND pt.y = j"
)
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the overview of each key: three rows of its frames, each as large as its content."""
    box = masks.frame_metrics(b.mask8(spark, sf_dir, 0.2), FRAME)
    frames = box.select("key", (F.col("frame_idx") % 3).alias("group"), F.col("frame_idx").alias("frame"), (F.col("right_px") - F.col("left_px")).alias("width"), "height", "left_px", "top_px", "vec_id")
    px = b.plane(spark, sf_dir).filter("v > 0.2").join(frames.select("vec_id", "left_px", "top_px", "group"), "vec_id")
    px = px.select("key", "group", F.col("frame_idx").alias("frame"), (F.col("x") - F.col("left_px")).alias("x"), (F.col("y") - F.col("top_px")).alias("y"), F.col("gray").alias("r"), (F.lit(255) - F.col("gray")).alias("g"), F.lit(9).alias("b"), F.lit(255).alias("a"))
    sizes, placed = overview.contact_sheet(px, frames.select("key", "group", "frame", "width", "height"), ["key"])
    return overview.painted(sizes, placed, ["key"])


@query(
    f"WITH {b.RGBA}, t AS (SELECT vec_id // 40 AS tileset, vec_id, x, y, r, g, b, a, dense_rank() OVER (PARTITION BY vec_id // 40 ORDER BY vec_id) - 1 AS n FROM px) "
    "SELECT tileset, tx * 8 + x * 2 + i AS x, n * 16 + ty * 8 + y * 2 + j AS y, r, g, b FROM t, range(2) a(tx), range(2) c(ty), range(2) d(i), range(2) e(j) WHERE a > 0"
)
def tile_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile twice across and down and at double size, a row for each in its tileset."""
    name = F.format_string("t%08d", "vec_id")
    px = b.rgba4(spark, sf_dir).select(F.floor(F.col("vec_id") / b.TILESET).alias("tileset"), name.alias("tile_id"), "x", "y", "r", "g", "b", "a")
    return overview.tile_patches(px, ["tileset"], 4, 4, repeat=2, scale=2)


@query(
    f"WITH {b.TILES}, {DECLARED}, qv AS (SELECT tileset, tile_id, CASE WHEN y < 2 THEN 'top_' ELSE 'bottom_' END || CASE WHEN x < 2 THEN 'left' ELSE 'right' END AS corner, k, CASE k "
    + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VIEWS))
    + " END AS v FROM ti, range(13) t(k)), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id, corner, k ORDER BY v) AS n FROM qv), "
    "dk AS (SELECT a.tileset, a.tile_id, a.corner, bs.terrain, a.k, sum(abs(a.v - c.v)) AS s FROM bs JOIN rk c ON c.tile_id = bs.base JOIN rk a ON a.tileset = bs.tileset AND a.corner = c.corner AND a.k = c.k AND a.n = c.n GROUP BY ALL), "
    "dd AS (SELECT tileset, tile_id, corner, terrain, round_even(greatest(sum(s) FILTER (k < 3) / 72, max(s) FILTER (k >= 3) / 24), 6) AS d FROM dk GROUP BY ALL), "
    "nr AS (SELECT tileset, tile_id, corner, min(d) AS d, CASE WHEN min(d) <= 30 THEN arg_min(terrain, (d, terrain)) END AS terrain FROM dd GROUP BY ALL), "
    "fc AS (SELECT tileset, tile_id, list(terrain ORDER BY CASE corner WHEN 'top_left' THEN 0 WHEN 'top_right' THEN 1 WHEN 'bottom_left' THEN 2 ELSE 3 END) FILTER (terrain IS NOT NULL) AS c FROM nr GROUP BY ALL), "
    "nm AS (SELECT tileset, list_sort(list_distinct(flatten(list(c)))) AS names FROM fc WHERE len(c) = 4 GROUP BY tileset), "
    "bt AS (SELECT fc.tileset, tile_id, CASE WHEN len(c) = 4 THEN c END AS c, coalesce(names, []) AS names FROM fc LEFT JOIN nm USING (tileset)) "
    "SELECT tileset, tile_id, (list_position(names, (SELECT arg_min(u.t, (-len(list_filter(c, lambda o: o = u.t)), list_position(c, u.t))) FROM unnest(c) u(t))) - 1)::INT AS terrain, (list_position(names, c[1]) - 1)::INT AS top_left, (list_position(names, c[2]) - 1)::INT AS top_right, "
    "(list_position(names, c[3]) - 1)::INT AS bottom_left, (list_position(names, c[4]) - 1)::INT AS bottom_right, array_to_string(names, ',') AS names FROM bt"
)
def terrain_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the terrain of each tile and of its corners within the tileset."""
    quads = _quads(spark, sf_dir)
    vec_id = F.substring("tile_id", 2, 18).cast("long")
    index = F.array_position(F.array(*map(F.lit, CORNERS)), F.col("corner")) - 1
    rows = quads.select("tileset", "tile_id", "corner", _declare(vec_id % b.TILESET, index, F.col("tileset")).alias("declared"))
    limits = quads.select("tileset").distinct().withColumn("distance_max", F.lit(30.0))
    found = tiles.peering_bits(drift.measured_corners(quads, drift.bases(rows), limits), ["tileset"])
    return found.withColumn("names", F.array_join("names", ","))


def pack_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assets of packs of a hundred customers."""
    k = F.col("o_orderkey")
    outcome = F.element_at(F.array(*map(F.lit, jobs.OUTCOMES)), (k % 11 % 6 + 1).cast("int"))
    return b.read(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("pack_id"), outcome.alias("outcome"), (k % 3 == 0).alias("cached"), F.when(k % 5 > 0, k % 5 == 1).alias("resumed"), (k % 13 == 0).alias("outcome_unknown"))


@query(
    f"WITH a AS (SELECT o_custkey // 100 AS pack_id, {jobs.OUTCOMES}[o_orderkey % 11 % 6 + 1] AS outcome, o_orderkey AS k FROM orders) SELECT pack_id, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in jobs.OUTCOMES)
    + ", count(*) FILTER (k % 3 = 0) AS cached, count(*) FILTER (k % 5 = 1) AS resumed, count(*) FILTER (k % 13 = 0) AS outcome_unknown FROM a GROUP BY pack_id"
)
def pack_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pack_counts(pack_assets(spark, sf_dir))


@query(
    "WITH j AS (SELECT o_custkey // 100 AS pack_id, o_custkey AS asset_id, CASE o_orderkey % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'derived' ELSE 'animation' END AS kind, o_orderstatus IN ('O', 'P') AS unpaid FROM orders) "
    "SELECT pack_id, count(DISTINCT asset_id) AS assets, count(*) AS total_jobs, count(*) FILTER (unpaid AND kind <> 'derived') AS estimated_api_calls, count(*) FILTER (unpaid AND kind = 'seed') AS estimated_seed_api_calls, count(*) FILTER (unpaid AND kind = 'animation') AS estimated_animation_api_calls FROM j GROUP BY pack_id"
)
def pack_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    status = F.when(F.col("o_orderstatus") == "O", "PLANNED").when(F.col("o_orderstatus") == "P", "GENERATING").otherwise("COMPLETED")
    rows = b.read(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 100).alias("pack_id"), F.col("o_custkey").alias("asset_id"), F.when(k == 0, "seed").when(k == 1, "derived").otherwise("animation").alias("kind"), status.alias("status"))
    return jobs.pack_plan(rows)


@query(
    f"WITH {ACT}, sc AS (SELECT key, action, h, w, CASE WHEN reference IS NULL THEN 32.0 ELSE canvas_fraction * (h / 8 / subject_ratio) * 32 END AS t FROM ac LEFT JOIN pf USING (key)), "
    "s2 AS (SELECT *, least(t / h, 32 / w, 32 / h) AS scale FROM sc) SELECT key, action, round(CASE WHEN scale < t / h - 1e-6 THEN 1 - scale / (t / h) END, 6) AS overrun, "
    "round(CASE WHEN 6 < h * 0.85 THEN 1 - 6 / h END, 6) AS lost, CASE WHEN 6 < h * 0.85 THEN 16 END AS suggested FROM s2"
)
def survey_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions that had to be shrunk, and those that a canvas of six pixels would spoil."""
    rows = actions(spark, sf_dir)
    out = survey.scaled(rows, survey.profiles(rows, ["key"], CANVAS[1]), ["key"], CANVAS)
    found = survey.warnings(out, ["key"], 6)
    return found.select("key", "action", F.round("overrun", 6).alias("overrun"), F.round("lost", 6).alias("lost"), "suggested")


@query(f"WITH {b.RGBA}, {BLOCKS} SELECT DISTINCT vec_id, r, g, b FROM bl WHERE opaque AND (vec_id, r, g, b) NOT IN (SELECT (vec_id, r, g, b) FROM px WHERE a > 0)")
def introduced_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that halving an image by medians brings in."""
    px = b.rgba4(spark, sf_dir)
    half = palette.block_medians(px, ["vec_id"], 4, 4, 2, 2).withColumn("a", F.when(F.col("opaque"), 255).otherwise(0))
    return palette.introduced(px, half, ["vec_id"])


@query(
    "WITH o AS (SELECT o_orderkey, (o_orderkey % 7 + 1)::INT AS k, (o_orderkey % 7 + 1 + o_custkey % 14 - 2)::INT AS n, o_orderkey % 2 = 0 AS loop FROM orders), "
    "g AS (SELECT *, CASE WHEN loop THEN k ELSE k - 1 END AS gaps, greatest(n - k, 0) AS more FROM o), "
    "f AS (SELECT o_orderkey, i, -1 AS j, 'key:' || i AS name FROM g, range(8) t(i) WHERE i < k UNION ALL SELECT o_orderkey, i, j, 'gap:' || i || ':' || j FROM g, range(8) t(i), range(16) u(j) WHERE i < gaps AND j < more // gaps + (i < more % gaps)::INT) "
    "SELECT o_orderkey, string_agg(name, ',' ORDER BY i, j) AS frames FROM f GROUP BY o_orderkey"
)
def frame_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of keyframes and in-betweens of a sequence for every order."""
    k = (F.col("o_orderkey") % 7 + 1).cast("int")
    order = poses.frame_order(k, (k + F.col("o_custkey") % 14 - 2).cast("int"), F.col("o_orderkey") % 2 == 0)
    return b.read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(order, ",").alias("frames"))
