"""The driver tables read as frames, pixels, tiles, jobs and checks; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Successive ids that are numbered together.
PART = 4096


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, key (the label), frame_idx within the key, embedding.

    Frames are numbered within parts of successive ids, and parts by how many frames of the key come
    before them, so a key that holds a third of all frames is never sorted in one task.
    """
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("key"), F.floor(F.col("vec_id") / PART).alias("part"), "embedding")
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("key").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("vec_id")) - 1
    numbered = rows.withColumn("place", place).join(before, F.col("key").eqNullSafe(F.col("of")) & F.col("part").eqNullSafe(F.col("at")))
    return numbered.select("vec_id", "key", (F.col("place") + F.col("before")).cast("int").alias("frame_idx"), "embedding")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's 64 numbers: vec_id, key, frame_idx, i, v."""
    out = frames(spark, sf_dir).select("vec_id", "key", "frame_idx", F.posexplode("embedding").alias("i", "v"))
    return out.withColumn("v", F.col("v").cast("double"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers as an 8 x 8 image: adds x, y and gray from 0 to 255."""
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v") + 0.6) * 212).cast("int")))
    return values(spark, sf_dir).withColumns({"x": F.col("i") % 8, "y": F.floor(F.col("i") / 8).cast("int"), "gray": gray})


def mask8(spark: SparkSession, sf_dir: str, over: float = 0.0) -> DataFrame:
    """Opaque pixels of the 8 x 8 image."""
    return plane(spark, sf_dir).filter(F.col("v") > over).select("vec_id", "key", "frame_idx", "x", "y")


def rgba4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers as a 4 x 4 image of r, g, b, a; alpha is 0 or 255."""
    px = plane(spark, sf_dir)
    channel = lambda c: F.max(F.when(F.col("i") % 4 == c, F.col("gray")))
    a = F.max(F.when(F.col("i") % 4 == 3, F.when(F.col("v") > 0, 255).otherwise(0)))
    return px.groupBy("vec_id", "key", "frame_idx", (F.floor(F.col("i") / 4) % 4).cast("int").alias("x"), F.floor(F.col("i") / 16).cast("int").alias("y")).agg(
        *(channel(c).alias(n) for c, n in enumerate("rgb")), a.alias("a")
    )


#: Tiles in a tileset.
TILESET = 40


def tilesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a 4 x 4 tile of a tileset of TILESET successive ids."""
    tileset = F.floor(F.col("vec_id") / TILESET).cast("long").alias("tileset")
    return rgba4(spark, sf_dir).select(tileset, F.format_string("t%03d", "vec_id").alias("tile_id"), "x", "y", "r", "g", "b")


#: Words that hit or nearly hit the rules over descriptions.
WORDS = ["green", "lime", "slime", "purple", "teal", "bear", "bearded", "ghost", "sword", "no shield", "plain", "without a bow, with an axe"]


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS)).cast("int") + 1)
    return read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" with "), word, F.lit(" trim")).alias("text"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, h = F.col("c_custkey") % 4, F.md5("c_name")
    text = F.when(k == 0, F.concat(F.lit("call Bearer "), h)).when(k == 1, F.concat(F.lit("api_key="), h)).when(k == 2, F.concat(F.lit("sk-"), h)).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))


#: Driver events as events of jobs.
EVENTS = {"signup": "START_EXECUTION", "error": "TRANSIENT_ERROR", "view": "PROVIDER_SUCCESS", "click": "START_PROCESSING", "purchase": "PROCESSING_DONE"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id (a user's week), ts, event_id, event."""
    event = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in EVENTS.items()), F.lit("CACHE_HIT"))
    job = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format(F.date_trunc("week", "ts"), "yyyyMMdd"))
    return read(spark, sf_dir, "events").select(job.alias("job_id"), "user_id", "ts", "event_id", event.alias("event"), "value")


#: Order priorities and line statuses as checks.
def check_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as checks: asset_id, id, target, severity, result, message, action, direction, measured."""
    from tessella import dims

    n = len(dims.CHECKS)
    at = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n
    ids = F.array(*(F.lit(c[0]) for c in dims.CHECKS))
    levels = F.array(*(F.lit(c[1]) for c in dims.CHECKS))
    result = F.when(F.col("l_discount") >= 0.07, "FAIL").when(F.col("l_tax") >= 0.07, "WARN").when(F.col("l_tax") < 0.02, "SKIP").otherwise("PASS")
    message = F.when(F.col("l_quantity") < 5, "aspect ratio changed")
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("asset_id"), F.element_at(ids, at.cast("int") + 1).alias("id"),
        F.concat_ws("_", F.col("l_returnflag"), F.col("l_linestatus"), (F.col("l_suppkey") % 7).cast("string")).alias("target"),
        F.element_at(levels, at.cast("int") + 1).alias("severity"), result.alias("result"), message.alias("message"),
        F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("direction"), F.col("l_discount").alias("measured"),
    )


# The same bindings in SQL, as common table expressions.
FRAMES = "fr AS (SELECT vec_id, label AS key, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding FROM embeddings)"
PLANE = (
    FRAMES + ", pl AS (SELECT vec_id, key, frame_idx, i, i % 8 AS x, i // 8 AS y, embedding[i + 1]::DOUBLE AS v, "
    "greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.6) * 212)::INT)) AS gray FROM fr, range(64) t(i))"
)
RGBA = (
    PLANE + ", px AS (SELECT vec_id, key, frame_idx, (i // 4) % 4 AS x, i // 16 AS y, max(gray) FILTER (i % 4 = 0) AS r, "
    "max(gray) FILTER (i % 4 = 1) AS g, max(gray) FILTER (i % 4 = 2) AS b, max(CASE WHEN v > 0 THEN 255 ELSE 0 END) FILTER (i % 4 = 3) AS a "
    "FROM pl GROUP BY ALL)"
)
TILES = RGBA + f", ti AS (SELECT vec_id // {TILESET} AS tileset, printf('t%03d', vec_id) AS tile_id, x, y, r, g, b FROM px)"


def mask_sql(over: float = 0.0) -> str:
    return PLANE + f", m AS (SELECT vec_id, key, frame_idx, x, y FROM pl WHERE v > {over})"
