"""Queries over enlarged pixel art: each embedding's 4 x 4 image at 16 x 16 with soft colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import gridsnap
from tessella.plans import bindings as b
from tessella.plans.registry import query

BY = ["vec_id"]


def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, x, y, r, g, b, a: every pixel as a block of four by four whose colours differ a little."""
    four = F.sequence(F.lit(0), F.lit(3))
    rows = b.rgba4(spark, sf_dir).withColumn("dx", F.explode(four)).withColumn("dy", F.explode(four))
    x, y = F.col("x") * 4 + F.col("dx"), F.col("y") * 4 + F.col("dy")
    soft = lambda c, k: F.least(F.lit(255), F.col(c) + (x * 3 + y * 5 + x * y * k) % 5).alias(c)
    return rows.select("vec_id", x.alias("x"), y.alias("y"), soft("r", 1), soft("g", 2), soft("b", 3), "a")


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as found: right (4), wrong (5), none; each fourth image has its block given."""
    kind = F.col("vec_id") % 3
    block = F.when(kind == 0, 4.0).when(kind == 1, 5.0)
    return b.read(spark, sf_dir, "embeddings").select("vec_id", F.lit(16).alias("width"), F.lit(16).alias("height"), block.alias("block"), (F.col("vec_id") % 4 == 1).alias("fixed"))


def _sql(core: bool) -> str:
    inner = "ix >= floor(bw * 0.4 / 2) AND ix < bw - floor(bw * 0.4 / 2) AND iy >= floor(bw * 0.4 / 2) AND iy < bw - floor(bw * 0.4 / 2)" if core else "true"
    return (
        f"{b.RGBA}, en AS MATERIALIZED (SELECT vec_id, x * 4 + dx AS x, y * 4 + dy AS y, " + ", ".join(f"least(255, {c} + ((x * 4 + dx) * 3 + (y * 4 + dy) * 5 + (x * 4 + dx) * (y * 4 + dy) * {k}) % 5) AS {c}" for k, c in enumerate("rgb", 1)) + ", "
        + ("255" if core else "a") + " AS a FROM px, range(4) d(dx), range(4) e(dy)), "
        "sz AS (SELECT vec_id, vec_id % 4 = 1 AS fixed, CASE vec_id % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 5.0 END AS block, CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 END AS n, CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 5 END AS bw FROM embeddings), "
        "fi AS (SELECT sz.vec_id, i // bw AS bx, j // bw AS by_, i % bw AS ix, j % bw AS iy, bw, r, g, b FROM sz, range(16) u(i), range(16) w(j), en "
        "WHERE i < n * bw AND j < n * bw AND en.vec_id = sz.vec_id AND a > 0 AND x = (2 * i + 1) * 16 // (2 * n * bw) AND y = (2 * j + 1) * 16 // (2 * n * bw)), "
        "b0 AS (SELECT vec_id, bx, by_, count(*) > bw * bw / 2 AS opaque, " + ", ".join(f"trunc(median({c}) FILTER ({inner}))::INT AS {c}" for c in "rgb") + " FROM fi GROUP BY vec_id, bx, by_, bw), "
        "bl AS MATERIALIZED (SELECT vec_id, bx, by_, opaque, " + ", ".join(f"CASE WHEN opaque THEN coalesce({c}, 0) ELSE 0 END AS {c}" for c in "rgb") + " FROM b0), "
        "be AS (SELECT vec_id, count(DISTINCT (r, g, b)) AS n FROM en WHERE a > 0 GROUP BY vec_id), af AS (SELECT vec_id, count(DISTINCT (r, g, b)) AS n FROM bl WHERE opaque GROUP BY vec_id), "
        "er AS (SELECT en.vec_id, avg(greatest(abs(en.r - coalesce(bl.r, 0)), abs(en.g - coalesce(bl.g, 0)), abs(en.b - coalesce(bl.b, 0)))) AS e FROM en JOIN sz USING (vec_id) LEFT JOIN bl ON bl.vec_id = en.vec_id AND bx = (2 * x + 1) * sz.n // 32 AND by_ = (2 * y + 1) * sz.n // 32 WHERE a > 0 AND sz.n IS NOT NULL GROUP BY en.vec_id), "
        "fa AS (SELECT vec_id, sz.block, sz.n, fixed, coalesce(be.n, 0) AS before, coalesce(af.n, 0) AS after, coalesce(e, 0) AS e, coalesce(be.n, 0) / greatest(1, coalesce(af.n, 0)) >= 4 AS drops FROM sz LEFT JOIN be USING (vec_id) LEFT JOIN af USING (vec_id) LEFT JOIN er USING (vec_id)), "
        "ou AS MATERIALIZED (SELECT *, n IS NOT NULL AND (fixed OR (drops AND e <= 20)) AS applied, n IS NOT NULL AND NOT fixed AND drops AND e > 20 AS wrong FROM fa)"
    )


FACTS = "SELECT vec_id, CASE WHEN wrong THEN 1 ELSE coalesce(block, 1) END::DOUBLE AS block, CASE WHEN applied THEN n ELSE 16 END AS width, CASE WHEN applied THEN n ELSE 16 END AS height, before AS colors_before, CASE WHEN applied THEN after ELSE before END AS colors_after, applied FROM ou"


@query(f"WITH {_sql(False)} {FACTS}")
def snapped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the blocks of each image with transparency are believed, and what it becomes."""
    return gridsnap.snap(enlarged(spark, sf_dir), sizes(spark, sf_dir), BY)[0]


@query(f"WITH {_sql(True)} {FACTS}")
def snapped_opaque_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of images without transparency, whose blocks are judged by their middles."""
    return gridsnap.snap(enlarged(spark, sf_dir).withColumn("a", F.lit(255)), sizes(spark, sf_dir), BY, core=True)[0]


@query(f"WITH {_sql(False)} SELECT vec_id, bx AS x, by_ AS y, r, g, b FROM bl JOIN ou USING (vec_id) WHERE applied AND opaque UNION ALL SELECT vec_id, x, y, r, g, b FROM en JOIN ou USING (vec_id) WHERE NOT applied AND a > 0")
def snapped_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridsnap.snap(enlarged(spark, sf_dir), sizes(spark, sf_dir), BY)[1].select("vec_id", "x", "y", "r", "g", "b")
