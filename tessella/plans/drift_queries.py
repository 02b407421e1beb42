"""Queries that hold stored tables of tilesets against their pixels.

The stored side is made from the tables too, with drift by tileset: every third records its
neighbours by a stricter limit than it says, every third by a looser one; some tilesets store
nothing, some list a tile that has no pixels; corners are changed by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.lineage import cut
from tessella.operators import drift, tiles
from tessella.plans import bindings as b
from tessella.plans.registry import query
from tessella.plans.tile_queries import _VIEWS, LINES

CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")


def _declared(px: DataFrame) -> DataFrame:
    """All tiles with pixels, and one without in each fifth tileset."""
    own = px.select("tileset", "tile_id").distinct()
    lost = own.select("tileset").distinct().filter("tileset % 5 = 3").withColumn("tile_id", F.lit("lost"))
    return own.unionByName(lost)


def _limits(px: DataFrame) -> DataFrame:
    """The limits that tilesets recorded; each fifth has no table."""
    return px.select("tileset").distinct().filter("tileset % 5 <> 4").select("tileset", F.lit(1.0).alias("seam_max"), F.lit(28.0).alias("gap_max"))


def _stored_edges(measures: DataFrame, declared: DataFrame) -> DataFrame:
    seam = F.when(F.col("tileset") % 3 == 0, 1.0).when(F.col("tileset") % 3 == 1, 0.9).otherwise(1.1)
    taken = declared.select("tileset").distinct().filter("tileset % 5 <> 4").select("tileset", seam.alias("seam_max"), F.lit(28.0).alias("gap_max"))
    return drift.fresh_edges(measures, taken, declared)


EDGES = (
    f"{b.TILES}, {LINES}, pt AS (SELECT DISTINCT tileset, tile_id FROM ti), pe AS MATERIALIZED (SELECT tileset, CASE axis WHEN 'horizontal' THEN 'right' ELSE 'down' END AS direction, src AS tile_id, dst AS other, seam_ratio FROM pm JOIN pt ON src = tile_id WHERE color_gap <= 28 AND tileset % 5 <> 4), "
    "dr AS MATERIALIZED (SELECT tileset, direction, tile_id, other, CASE WHEN seam_ratio <= 1 THEN 'missing' ELSE 'surplus' END AS cause FROM pe WHERE (seam_ratio <= 1) <> (seam_ratio <= CASE tileset % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.9 ELSE 1.1 END))"
)


@query(f"WITH {EDGES} SELECT * FROM dr")
def edge_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that a tileset's table lacks or has too many of."""
    px = cut(b.tilesets(spark, sf_dir))
    measures, declared = cut(tiles.pair_measures(tiles.edges(px))), _declared(px)
    return drift.edge_drift(_stored_edges(measures, declared), drift.fresh_edges(measures, _limits(px), declared))


@query(
    f"WITH {EDGES}, dt AS (SELECT tileset, tile_id, count(DISTINCT direction) AS n FROM dr GROUP BY ALL) "
    "SELECT tileset, tile_id AS target, CASE WHEN n IS NULL THEN 'PASS' ELSE 'FAIL' END AS result, coalesce(n, 0) AS measured, NULL AS skip_reason FROM pt LEFT JOIN dt USING (tileset, tile_id) WHERE tileset % 5 < 3 "
    "UNION ALL SELECT DISTINCT tileset, 'tileset', 'SKIP', NULL, CASE tileset % 5 WHEN 4 THEN 'not_applicable' ELSE 'dependency_failed' END FROM pt WHERE tileset % 5 > 2"
)
def adjacency_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each tile's stored neighbours are those of its pixels."""
    px = cut(b.tilesets(spark, sf_dir))
    measures, declared = cut(tiles.pair_measures(tiles.edges(px))), _declared(px)
    return drift.adjacency_checks(_stored_edges(measures, declared), measures, _limits(px), declared, px)


# Tile k of a tileset: 0 to 2 are bases of three terrains (a fourth tileset in four lacks the third
# base), every fifth declares its corners, the rest declares none.
NAMES = ("grass", "rock", "sand")


def _declare(k: F.Column, corner: F.Column, tileset: F.Column) -> F.Column:
    name = lambda i: F.element_at(F.array(*map(F.lit, NAMES)), (i % 3 + 1).cast("int"))
    base = (k < 3) & ~((k == 2) & (tileset % 4 == 3))
    return F.when(base, name(k)).when(k % 5 == 3, name(k + corner))


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = cut(b.tilesets(spark, sf_dir))
    return cut(tiles.quadrants(px, 4, 4).join(px.select("tileset", "tile_id").distinct(), "tile_id"))


def _stored_corners(quads: DataFrame) -> DataFrame:
    """What tilesets have written of their corners: what the pixels said, changed here and there."""
    vec_id = F.substring("tile_id", 2, 18).cast("long")
    index = F.array_position(F.array(*map(F.lit, CORNERS)), F.col("corner")) - 1
    rows = quads.select("tileset", "tile_id", "corner", _declare(vec_id % b.TILESET, index, F.col("tileset")).alias("declared"), vec_id.alias("vec_id"), index.alias("index"))
    now = drift.measured_corners(quads, drift.bases(rows), quads.select("tileset").distinct().withColumn("distance_max", F.lit(30.0)))
    rows = rows.join(now, ["tileset", "tile_id", "corner"])
    terrain = F.when((F.col("vec_id") + F.col("index")) % 7 == 0, "grass").otherwise(F.col("terrain"))
    return rows.select("tileset", "tile_id", "corner", "declared", terrain.alias("terrain"), (F.col("distance") + F.when(F.col("vec_id") % 11 == 0, 1e-3).otherwise(0.0)).alias("distance"))


DECLARED = (
    "qd AS (SELECT t.tileset, t.tile_id, c.corner, c.i, t.tile_id[2:]::BIGINT AS vec_id, t.tile_id[2:]::BIGINT % 40 AS k FROM (SELECT DISTINCT tileset, tile_id FROM ti) t, (VALUES ('top_left', 0), ('top_right', 1), ('bottom_left', 2), ('bottom_right', 3)) c(corner, i)), "
    "sd AS (SELECT *, CASE WHEN k < 3 AND NOT (k = 2 AND tileset % 4 = 3) THEN ['grass', 'rock', 'sand'][k + 1] WHEN k % 5 = 3 THEN ['grass', 'rock', 'sand'][(k + i) % 3 + 1] END AS declared FROM qd), "
    "bs AS (SELECT DISTINCT tileset, tile_id AS base, declared AS terrain FROM sd WHERE k < 3 AND declared IS NOT NULL), "
    "nb AS (SELECT DISTINCT tileset, declared AS terrain FROM sd WHERE declared IS NOT NULL EXCEPT SELECT tileset, terrain FROM bs)"
)


@query(f"WITH {b.TILES}, {DECLARED} SELECT * FROM nb")
def terrains_without_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrains that a tileset declares without a tile that is all of it."""
    return drift.terrains_without_base(_stored_corners(_quads(spark, sf_dir)))


@query(
    f"WITH {b.TILES}, {DECLARED}, qv AS (SELECT tileset, tile_id, CASE WHEN y < 2 THEN 'top_' ELSE 'bottom_' END || CASE WHEN x < 2 THEN 'left' ELSE 'right' END AS corner, k, CASE k "
    + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_VIEWS))
    + " END AS v FROM ti, range(13) t(k)), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id, corner, k ORDER BY v) AS n FROM qv), "
    "dk AS (SELECT a.tileset, a.tile_id, a.corner, bs.terrain, a.k, sum(abs(a.v - c.v)) AS s FROM bs JOIN rk c ON c.tile_id = bs.base JOIN rk a ON a.tileset = bs.tileset AND a.corner = c.corner AND a.k = c.k AND a.n = c.n GROUP BY ALL), "
    "dd AS (SELECT tileset, tile_id, corner, terrain, round_even(greatest(sum(s) FILTER (k < 3) / 72, max(s) FILTER (k >= 3) / 24), 6) AS d FROM dk GROUP BY ALL), "
    "nr AS (SELECT tileset, tile_id, corner, min(d) AS d, CASE WHEN min(d) <= 30 THEN arg_min(terrain, (d, terrain)) END AS terrain FROM dd GROUP BY ALL), "
    "ck AS (SELECT nr.*, CASE WHEN (vec_id + i) % 7 = 0 THEN 'grass' ELSE terrain END IS DISTINCT FROM terrain OR vec_id % 11 = 0 AS table_drift, declared IS NOT NULL AND declared IS DISTINCT FROM terrain AS declared_mismatch FROM nr JOIN sd USING (tileset, tile_id, corner)) "
    "SELECT tileset, tile_id || '/' || corner AS target, CASE WHEN table_drift OR declared_mismatch THEN 'FAIL' ELSE 'PASS' END AS result, d AS measured, 30.0::DOUBLE AS lim, table_drift, declared_mismatch, NULL AS skip_reason FROM ck WHERE tileset % 5 < 3 AND tileset NOT IN (SELECT tileset FROM nb) "
    "UNION ALL SELECT DISTINCT tileset, 'tileset', CASE WHEN tileset % 5 < 3 THEN 'FAIL' ELSE 'SKIP' END, NULL, NULL, NULL, NULL, CASE tileset % 5 WHEN 4 THEN 'not_applicable' WHEN 3 THEN 'dependency_failed' END FROM ti WHERE tileset % 5 > 2 OR tileset IN (SELECT tileset FROM nb)"
)
def terrain_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether stored, declared and measured terrain of every corner agree."""
    quads = _quads(spark, sf_dir)
    limits = quads.select("tileset").distinct().filter("tileset % 5 <> 4").withColumn("distance_max", F.lit(30.0))
    return drift.terrain_checks(cut(_stored_corners(quads)), quads, limits, _declared(quads))
