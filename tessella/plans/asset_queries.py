"""Queries over margins, heights, resized frames, repair hints, job roll-ups and atlas numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import dims
from tessella.operators import checks, jobs, masks, palette, sequence, tiles
from tessella.plans import bindings as b
from tessella.plans.registry import query
from tessella.plans.tile_queries import ALLOWED, LINES, allowed

LEAST_MARGIN = 0.08


@query(
    f"WITH {b.mask_sql(0.2)}, bx AS (SELECT vec_id, min(x % 4) AS l, max(x % 4) AS r, min(y % 4) AS t, max(y % 4) AS b FROM m GROUP BY vec_id, x // 4, y // 4) "
    f"SELECT vec_id, min(least(l, t, 3 - r, 3 - b)) / 4 AS margin, min(least(l, t, 3 - r, 3 - b)) / 4 < {LEAST_MARGIN} AS overflows FROM bx GROUP BY vec_id"
)
def cell_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether content of a 2 x 2 grid comes too near to the borders of its cells."""
    found = masks.cell_margins(b.mask8(spark, sf_dir, 0.2), ["vec_id"], 2, 2, 8, 8)
    return found.withColumn("overflows", F.col("margin") < LEAST_MARGIN)


@query(f"WITH {b.mask_sql(0.2)}, h AS (SELECT key, frame_idx, max(y) - min(y) + 1 AS h FROM m GROUP BY ALL) SELECT key, median(h)::DOUBLE AS typical, max(h)::DOUBLE AS peak, CASE WHEN key % 3 = 0 THEN max(h) ELSE median(h) END::DOUBLE AS representative FROM h GROUP BY key")
def content_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typical and largest heights of animations; those that bob (every third key) are held to their peak."""
    found = masks.heights(b.mask8(spark, sf_dir, 0.2), "key", "frame_idx")
    return found.withColumn("representative", F.when(F.col("key") % 3 == 0, F.col("peak")).otherwise(F.col("typical")))


@query(f"WITH {b.mask_sql(0.2)}, h AS (SELECT key, frame_idx, max(y) - min(y) + 1 AS h FROM m GROUP BY ALL), t AS (SELECT key, median(h) AS typical FROM h GROUP BY key) SELECT median(typical)::DOUBLE AS standing FROM t WHERE key % 2 = 0")
def standing_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the typical heights of standing animations (the even keys)."""
    return masks.heights(b.mask8(spark, sf_dir, 0.2), "key", "frame_idx").filter("key % 2 = 0").agg(F.median("typical").alias("standing"))


@query(
    f"WITH {b.RGBA} SELECT p.key, p.frame_idx, sum(((p.r, p.g, p.b, p.a) <> (q.r, q.g, q.b, q.a))::INT) / 16 AS diff "
    "FROM px p JOIN px q ON p.key = q.key AND p.frame_idx = q.frame_idx + 1 AND p.x = q.x AND p.y = q.y GROUP BY ALL"
)
def pixel_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pixel_difference(b.rgba4(spark, sf_dir), "key", "frame_idx", 16)


@query(
    f"WITH {b.RGBA}, o AS (SELECT vec_id, i % 6 AS x, i // 6 AS y, (2 * (i % 6) + 1) * 4 // 12 AS sx, (2 * (i // 6) + 1) * 4 // 6 AS sy FROM range(18) t(i), (SELECT DISTINCT vec_id FROM px)) "
    "SELECT o.vec_id, o.x, o.y, CASE WHEN a > 0 THEN r ELSE 0 END AS r, CASE WHEN a > 0 THEN g ELSE 0 END AS g, CASE WHEN a > 0 THEN b ELSE 0 END AS b, a FROM o JOIN px ON px.vec_id = o.vec_id AND px.x = sx AND px.y = sy"
)
def resized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame from 4 x 4 to 6 x 3."""
    return palette.nearest_resize(b.rgba4(spark, sf_dir).select("vec_id", "x", "y", *"rgba"), 4, 4, 6, 3)


_IDS = "[" + ", ".join(f"'{c[0]}'" for c in dims.CHECKS) + "]"
_REPAIRS = "[" + ", ".join(f"'{c[2]}'" for c in dims.CHECKS) + "]"


def _targets(kind: str) -> str:
    return f"coalesce(string_agg(DISTINCT target, ',' ORDER BY target) FILTER (repair = '{kind}'), '') AS {kind}"


@query(
    f"WITH f AS (SELECT l_orderkey % 500 AS asset_id, {_REPAIRS}[(l_orderkey * 7 + l_linenumber) % {len(dims.CHECKS)} + 1] AS repair, "
    "l_returnflag || '_' || l_linestatus || '_' || (l_suppkey % 7)::VARCHAR AS target FROM lineitem WHERE l_discount >= 0.07) "
    f"SELECT asset_id, {_targets('local')}, {_targets('regenerate')} FROM f WHERE repair IS NOT NULL GROUP BY asset_id"
)
def repair_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.repair_hints(b.check_facts(spark, sf_dir), ["asset_id"], dims.checks(spark).select("id", "repair"))
    return found.select("asset_id", F.array_join("local", ",").alias("local"), F.array_join("regenerate", ",").alias("regenerate"))


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of their customer's asset."""
    status = F.when(F.col("o_orderstatus") == "O", "PLANNED").when(F.col("o_orderstatus") == "P", "GENERATING").otherwise("COMPLETED")
    k = F.col("o_orderkey")
    return b.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("asset_id"), F.concat(F.lit("j"), k.cast("string")).alias("job_id"), F.when(k % 5 == 0, "derived").otherwise("grid").alias("kind"), status.alias("status"),
        (k % 7 + 2).alias("frames"), F.when(k % 5 == 0, F.concat(F.lit("j"), (k - 1).cast("string"))).alias("derived_from"), F.when(k % 3 == 0, F.md5(k.cast("string"))).alias("input_fingerprint"),
    )


JOBS = (
    "jb AS (SELECT o_custkey AS asset_id, 'j' || o_orderkey AS job_id, CASE WHEN o_orderkey % 5 = 0 THEN 'derived' ELSE 'grid' END AS kind, "
    "CASE o_orderstatus WHEN 'O' THEN 'PLANNED' WHEN 'P' THEN 'GENERATING' ELSE 'COMPLETED' END AS status, o_orderkey % 7 + 2 AS frames, "
    "CASE WHEN o_orderkey % 5 = 0 THEN 'j' || (o_orderkey - 1) END AS derived_from, CASE WHEN o_orderkey % 3 = 0 THEN md5(o_orderkey::VARCHAR) END AS input_fingerprint FROM orders)"
)


@query(
    f"WITH {JOBS}, c AS (SELECT asset_id, status, count(*) AS n FROM jb GROUP BY ALL) SELECT asset_id, count(*) AS total_jobs, count(*) FILTER (kind <> 'derived' AND status IN ('PLANNED', 'GENERATING')) AS estimated_api_calls, "
    "count(*) FILTER (kind = 'derived') AS derived_jobs, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM c WHERE c.asset_id = jb.asset_id) AS by_status FROM jb GROUP BY asset_id"
)
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return jobs.summary(order_jobs(spark, sf_dir)).withColumn("by_status", F.array_join(entries, ","))


@query(f"WITH {JOBS} SELECT asset_id, substr(sha256(string_agg(job_id || '#' || kind || '#' || frames || '#' || coalesce(derived_from, '') || coalesce('#' || input_fingerprint, ''), '|' ORDER BY job_id)), 1, 16) AS signature FROM jb GROUP BY asset_id")
def job_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.signature(order_jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT asset_id, job_id, status FROM jb WHERE kind <> 'derived' AND status IN ('PLANNED', 'GENERATING')")
def pending_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.pending(order_jobs(spark, sf_dir)).select("asset_id", "job_id", "status")


@query(f"WITH {b.TILES}, t AS (SELECT tileset, tile_id, row_number() OVER (PARTITION BY tileset ORDER BY tile_id) AS gid FROM (SELECT DISTINCT tileset, tile_id FROM ti)), g AS (SELECT DISTINCT tileset, unnest(range(1, 44)) AS gid FROM t) SELECT g.tileset, g.gid, tile_id FROM g LEFT JOIN t USING (tileset, gid)")
def tiles_by_gid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile of each number from 1 to 43 in every tileset of 40."""
    sets = b.read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / b.TILESET).cast("long").alias("tileset")).distinct()
    gids = sets.withColumn("gid", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(43).cast("long"))))
    return tiles.by_gid(tiles.atlas(b.tilesets(spark, sf_dir)), gids)


@query(f"WITH {b.TILES}, {LINES}, {ALLOWED} SELECT direction, tile_id, other FROM al WHERE substr(other, 2)::BIGINT % 7 = 0")
def dangling_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that are gone once every seventh tile is taken out of its tileset."""
    left = b.read(spark, sf_dir, "embeddings").filter("vec_id % 7 <> 0").select(F.format_string("t%03d", "vec_id").alias("tile_id"))
    return tiles.dangling(allowed(b.tilesets(spark, sf_dir)), left)
