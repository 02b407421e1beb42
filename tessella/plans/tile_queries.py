"""Queries over tiles, maps, grids and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions import geometry
from tessella.operators import tiles
from tessella.plans import bindings as b
from tessella.plans.registry import query

# Edge lines, inner differences and pair measures of tiles, in SQL.
LINES = (
    "li AS (SELECT 'horizontal' AS axis, tileset, tile_id, x AS i, y AS j, r, g, b FROM ti UNION ALL SELECT 'vertical', tileset, tile_id, y, x, r, g, b FROM ti), "
    "nd AS (SELECT p.axis, p.tile_id, p.i, sum(abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) / 12 AS d FROM li p JOIN li q ON p.axis = q.axis AND p.tile_id = q.tile_id AND p.j = q.j AND p.i = q.i + 1 GROUP BY ALL), "
    "se AS (SELECT p.axis, p.tile_id AS src, q.tile_id AS dst, sum(abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b)) / 12 AS seam, "
    "greatest(abs(sum(p.r) - sum(q.r)), abs(sum(p.g) - sum(q.g)), abs(sum(p.b) - sum(q.b))) / 4 AS color_gap "
    "FROM li p JOIN li q ON p.axis = q.axis AND p.tileset = q.tileset AND p.j = q.j AND p.i = 3 AND q.i = 0 GROUP BY ALL), "
    "pm AS (SELECT se.axis, src, dst, color_gap, seam / greatest((SELECT median(d) FROM (SELECT d FROM nd WHERE nd.axis = se.axis AND nd.tile_id = src UNION ALL SELECT d FROM nd WHERE nd.axis = se.axis AND nd.tile_id = dst)), 1) AS seam_ratio FROM se)"
)


@query(f"WITH {b.TILES}, {LINES} SELECT axis, src AS tile_id, round(seam_ratio, 6) AS seam_ratio, round(color_gap, 6) AS color_gap FROM pm WHERE src = dst")
def seam_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seam_ratio(b.tilesets(spark, sf_dir))


def _seam_ratio(px: DataFrame) -> DataFrame:
    return tiles.seams(tiles.edges(px)).select("axis", "tile_id", F.round("seam_ratio", 6).alias("seam_ratio"), F.round("color_gap", 6).alias("color_gap"))


@query(f"WITH {b.TILES}, {LINES} SELECT axis, src, dst, round(seam_ratio, 6) AS seam_ratio, round(color_gap, 6) AS color_gap, seam_ratio <= 1.0 AND color_gap <= 28 AS compatible FROM pm")
def tile_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_pairs(b.tilesets(spark, sf_dir))


def _tile_pairs(px: DataFrame) -> DataFrame:
    found = tiles.pair_measures(tiles.edges(px))
    ok = (F.col("seam_ratio") <= 1.0) & (F.col("color_gap") <= 28)
    return found.select("axis", "src", "dst", F.round("seam_ratio", 6).alias("seam_ratio"), F.round("color_gap", 6).alias("color_gap"), ok.alias("compatible"))


ALLOWED = (
    "ok AS (SELECT CASE axis WHEN 'horizontal' THEN 'right' ELSE 'down' END AS direction, src AS tile_id, dst AS other FROM pm WHERE seam_ratio <= 1.0 AND color_gap <= 28), "
    "al AS (SELECT * FROM ok UNION ALL SELECT CASE direction WHEN 'right' THEN 'left' ELSE 'up' END, other, tile_id FROM ok), "
    "ne AS (SELECT t.tile_id, d.direction, count(al.other) AS n, coalesce(string_agg(al.other, ',' ORDER BY al.other), '') AS neighbours "
    "FROM (SELECT DISTINCT tile_id FROM ti) t CROSS JOIN (VALUES ('right'), ('down'), ('left'), ('up')) d(direction) LEFT JOIN al ON al.tile_id = t.tile_id AND al.direction = d.direction GROUP BY ALL)"
)


def allowed(px: DataFrame) -> DataFrame:
    return tiles.adjacency(tiles.pair_measures(tiles.edges(px)), 1.0, 28.0)


def _neighbours(found: DataFrame) -> DataFrame:
    return found.select("tile_id", "direction", F.size("neighbours").cast("long").alias("n"), F.array_join("neighbours", ",").alias("neighbours"))


@query(f"WITH {b.TILES}, {LINES}, {ALLOWED} SELECT tile_id, direction, n, neighbours FROM ne")
def tile_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(allowed(b.tilesets(spark, sf_dir)))


@query(f"WITH {b.TILES}, {LINES}, {ALLOWED} SELECT other AS tile_id, CASE direction WHEN 'right' THEN 'left' ELSE 'up' END AS direction, count(*) AS n, string_agg(tile_id, ',' ORDER BY tile_id) AS neighbours FROM ok GROUP BY ALL")
def adjacency_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what may stand right of and below a tile alone: what it may stand right of and below."""
    return _neighbours(tiles.transposed(allowed(b.tilesets(spark, sf_dir)).filter(F.col("direction").isin("right", "down"))).filter("size(neighbours) > 0"))


GRAIN = (
    "st AS (SELECT p.tile_id, abs(p.r - q.r) AS r, abs(p.g - q.g) AS g, abs(p.b - q.b) AS b FROM ti p JOIN ti q ON p.tile_id = q.tile_id AND ((p.x = q.x + 1 AND p.y = q.y) OR (p.x = q.x AND p.y = q.y + 1))), "
    "gr AS (SELECT tile_id, greatest(median(r), 1) AS r, greatest(median(g), 1) AS g, greatest(median(b), 1) AS b FROM st GROUP BY tile_id), "
    "di AS (SELECT tile_id, " + ", ".join(f"abs(avg({c}) FILTER (x IN (0, 3) OR y IN (0, 3)) - avg({c}) FILTER (x IN (1, 2) AND y IN (1, 2))) AS {c}" for c in "rgb") + " FROM ti GROUP BY tile_id)"
)


@query(f"WITH {b.TILES}, {GRAIN} SELECT tile_id, round(greatest(di.r / gr.r, di.g / gr.g, di.b / gr.b), 6) AS border_deviation FROM di JOIN gr USING (tile_id)")
def border_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.border_deviation(b.tilesets(spark, sf_dir), 4, 4).withColumn("border_deviation", F.round("border_deviation", 6))


_VIEWS = ["r * 6", "g * 6", "b * 6", *(f"(r * {x} + g * {y} + b * {z}) * {6 // (abs(x) + abs(y) + abs(z))}" for x, y, z in tiles.PROJECTIONS)]
TERRAIN = (
    "qv AS (SELECT tile_id, CASE WHEN y < 2 THEN 'top_' ELSE 'bottom_' END || CASE WHEN x < 2 THEN 'left' ELSE 'right' END AS corner, k, CASE k "
    + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VIEWS))
    + " END AS v FROM ti, range(13) t(k)), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id, corner, k ORDER BY v) AS n FROM qv), "
    "dk AS (SELECT a.tile_id, a.corner, c.tile_id AS base, a.k, sum(abs(a.v - c.v)) AS s FROM rk a JOIN rk c ON a.corner = c.corner AND a.k = c.k AND a.n = c.n WHERE c.tile_id IN ('t000', 't001', 't002') GROUP BY ALL), "
    "dd AS (SELECT tile_id, corner, base, round_even(greatest(sum(s) FILTER (k < 3) / 72, max(s) FILTER (k >= 3) / 24), 6) AS d FROM dk GROUP BY ALL), "
    "nr AS (SELECT tile_id, corner, arg_min(base, (d, base)) AS base, min(d) AS distance FROM dd GROUP BY ALL)"
)


@query(f"WITH {b.TILES}, {TERRAIN} SELECT tile_id, corner, CASE WHEN distance <= 30 THEN CASE base WHEN 't000' THEN 'grass' WHEN 't001' THEN 'rock' ELSE 'sand' END END AS terrain, distance FROM nr".replace("(d, base)", "(d, CASE base WHEN 't000' THEN 'grass' WHEN 't001' THEN 'rock' ELSE 'sand' END)"))
def terrain_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terrain_corners(spark, b.tilesets(spark, sf_dir))


def _terrain_corners(spark: SparkSession, px: DataFrame) -> DataFrame:
    quads = tiles.quadrants(px, 4, 4)
    bases = dims.table(spark, [("t000", "grass"), ("t001", "rock"), ("t002", "sand")], "tile_id string, terrain string")
    return tiles.terrain_corners(quads, bases, 30.0)


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells of maps whose tiles come from all tilesets, one tileset a map."""
    at, sets = F.col("event_id") % 60, F.ceil(F.col("n") / b.TILESET)
    first = F.col("user_id") % sets * b.TILESET
    vec_id = first + (F.col("event_id") * 7 + F.col("user_id")) % F.least(F.lit(b.TILESET), F.col("n") - first)
    n = b.read(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    rows = b.read(spark, sf_dir, "events").crossJoin(F.broadcast(n))
    return rows.groupBy(F.col("user_id").alias("map"), (at % 10).alias("x"), F.floor(at / 10).alias("y")).agg(F.min(F.format_string("t%03d", vec_id.cast("long"))).alias("tile_id"))


@query(
    f"WITH {b.TILES}, {LINES}, {ALLOWED}, nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings), ev AS (SELECT user_id, event_id, n, user_id % ceil(n / 40.0)::BIGINT * 40 AS f FROM events, nv), ce AS (SELECT user_id AS map, event_id % 60 % 10 AS x, event_id % 60 // 10 AS y, min(printf('t%03d', f + (event_id * 7 + user_id) % least(40, n - f))) AS tile_id FROM ev GROUP BY ALL), "
    "pa AS (SELECT p.map, p.x, p.y, 'right' AS direction, p.tile_id, q.tile_id AS other FROM ce p JOIN ce q ON p.map = q.map AND q.x = p.x + 1 AND q.y = p.y "
    "UNION ALL SELECT p.map, p.x, p.y, 'down', p.tile_id, q.tile_id FROM ce p JOIN ce q ON p.map = q.map AND q.y = p.y + 1 AND q.x = p.x) "
    "SELECT map, x, y, direction, tile_id, other FROM pa ANTI JOIN ok USING (direction, tile_id, other)"
)
def map_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.map_violations(maps(spark, sf_dir), allowed(b.tilesets(spark, sf_dir))).select("map", "x", "y", "direction", "tile_id", "other")


@query(f"WITH {b.TILES}, n AS (SELECT tileset, tile_id, row_number() OVER (PARTITION BY tileset ORDER BY tile_id) - 1 AS i, ceil(sqrt(count(*) OVER (PARTITION BY tileset)))::INT AS columns FROM (SELECT DISTINCT tileset, tile_id FROM ti)) SELECT tileset, tile_id, i % columns AS col, (i // columns)::INT AS row, columns, i + 1 AS gid FROM n")
def tile_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.atlas(b.tilesets(spark, sf_dir))


@query(None)
def wave_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of 8 x 6 that a four-tile adjacency allows, one for each customer nation."""
    names = ["grass", "edge", "sand", "water"]
    near = {a: [names[j] for j in range(4) if abs(i - j) <= 1] for i, a in enumerate(names)}
    seeds = b.read(spark, sf_dir, "nation").select(F.col("n_name").alias("map"), F.col("n_nationkey").cast("string").alias("seed"))
    return tiles.generate_maps(seeds, {"right": near, "down": near}, 8, 6, {"grass": 2.0})


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requested image sizes."""
    return b.read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 16 % 4096 + 16).alias("w"), (F.col("p_size") * 40).alias("h"))


SIZES = "sz AS (SELECT p_partkey, p_partkey * 16 % 4096 + 16 AS w, p_size * 40 AS h FROM part)"


@query(
    f"WITH {SIZES} SELECT p_partkey, array_to_string(list_filter([CASE WHEN w % 16 <> 0 OR h % 16 <> 0 THEN 'multiple' END, CASE WHEN greatest(w, h) > 3 * least(w, h) THEN 'ratio' END, "
    "CASE WHEN w * h < 655360 THEN 'too_small' END, CASE WHEN w * h > 8294400 THEN 'too_large' END, CASE WHEN greatest(w, h) > 3840 THEN 'side' END], lambda s: s IS NOT NULL), ',') AS violations FROM sz"
)
def size_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes(spark, sf_dir).select("p_partkey", F.array_join(geometry.size_violations(F.col("w"), F.col("h")), ",").alias("violations"))


@query(f"WITH {SIZES} SELECT p_partkey, greatest(1, trunc(w * least(512.0::DOUBLE / w, 384.0::DOUBLE / h))::INT) AS w, greatest(1, trunc(h * least(512.0::DOUBLE / w, 384.0::DOUBLE / h))::INT) AS h FROM sz")
def fit_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = geometry.fit_within(F.col("w"), F.col("h"), F.lit(512.0), F.lit(384.0))
    return sizes(spark, sf_dir).select("p_partkey", fit["w"].alias("w"), fit["h"].alias("h"))


@query(
    f"WITH {SIZES}, g(frames, cols, rows) AS (VALUES (4, 2, 2), (6, 3, 2), (8, 4, 2), (9, 3, 3), (12, 4, 3)), c AS (SELECT p_partkey, w, h, frames, cols, rows, i, i % cols AS c, i // cols AS r FROM sz JOIN g ON true, range(12) t(i) WHERE i < frames) "
    "SELECT p_partkey, frames, i, round_even(c * w / cols, 0)::INT AS left_px, round_even(r * h / rows, 0)::INT AS top_px, round_even((c + 1) * w / cols, 0)::INT AS right_px, round_even((r + 1) * h / rows, 0)::INT AS bottom_px FROM c"
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_cells(spark, sizes(spark, sf_dir))


def _grid_cells(spark: SparkSession, parts: DataFrame) -> DataFrame:
    grid = F.broadcast(dims.table(spark, dims.GRIDS, "frames int, cols int, rows int"))
    cells = parts.crossJoin(grid).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    box = geometry.cell_box(F.col("i"), F.col("cols"), F.col("rows"), F.col("w"), F.col("h"))
    return cells.select("p_partkey", "frames", "i", *(box[s].alias(f"{s}_px") for s in ("left", "top", "right", "bottom")))


@query(
    "WITH a(action, frames, fps) AS (VALUES ('idle', 4, 6), ('walk', 8, 10), ('attack', 6, 12), ('hurt', 4, 8), ('death', 8, 8), ('cast', 6, 10), ('travel', 4, 12), ('impact', 6, 15), ('loop', 4, 8)), "
    "t AS (SELECT action, frames, fps, f AS target_fps, least(24, greatest(2, round_even(frames * f / fps, 0)::INT)) AS target FROM a, (VALUES (8), (12), (15), (24)) v(f)) "
    "SELECT action, target_fps, target, gap, (greatest(target - frames, 0) // frames + (gap < greatest(target - frames, 0) % frames)::INT)::INT AS inbetweens FROM t, range(8) g(gap) WHERE gap < frames"
)
def inbetween_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = dims.table(spark, dims.ACTIONS, "action string, frames int, fps int, loop boolean, directional boolean")
    rows = actions.withColumn("target_fps", F.explode(F.array(*map(F.lit, (8, 12, 15, 24)))))
    rows = rows.withColumn("target", geometry.frames_at(F.col("frames"), F.col("fps"), F.col("target_fps"))).withColumn("gap", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)))
    extra = F.greatest(F.col("target") - F.col("frames"), F.lit(0))
    return rows.select("action", "target_fps", "target", F.col("gap").cast("long").alias("gap"), geometry.gap_share(extra, F.col("frames"), F.col("gap")).alias("inbetweens"))
