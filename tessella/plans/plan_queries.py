"""Queries over plans: pose sampling, scales, merging and invalidating jobs, block rhythm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions import poses, rules
from tessella.operators import blocks, jobs
from tessella.plans import bindings as b
from tessella.plans.job_queries import GRAPH, graph
from tessella.plans.registry import query

ACTIONS = "a(action, frames, fps, loop) AS (VALUES " + ", ".join(str((a, f, r, lo)).replace("True", "true").replace("False", "false") for a, f, r, lo, _ in dims.ACTIONS) + ")"


@query(
    f"WITH {ACTIONS} SELECT action, n AS beats, i AS frame, CASE WHEN loop THEN ceil(i * n / frames)::INT % n WHEN frames > 1 THEN round_even(i * (n - 1) / (frames - 1), 0)::INT ELSE 0 END AS pose "
    "FROM a, (VALUES (3), (4), (6), (8)) v(n), range(12) t(i) WHERE i < frames"
)
def pose_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dims.table(spark, dims.ACTIONS, "action string, frames int, fps int, loop boolean, directional boolean").withColumn("beats", F.explode(F.array(*map(F.lit, (3, 4, 6, 8)))))
    return rows.select("action", "beats", F.posexplode(poses.picked(F.col("frames"), F.col("beats"), F.col("loop"))).alias("frame", "pose"))


@query(
    f"WITH {ACTIONS}, s AS (SELECT action, n, i, CASE WHEN frames > 1 THEN i * (n - 1) / (frames - 1) ELSE 0 END AS x FROM a, (VALUES (3), (4), (6), (8)) v(n), range(12) t(i) WHERE i < frames) "
    "SELECT action, n AS beats, i AS frame, floor(x)::INT AS pose, least(floor(x)::INT + 1, n - 1) AS next, round_even((x - floor(x)) * 100, 0)::INT AS percent FROM s"
)
def pose_blending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dims.table(spark, dims.ACTIONS, "action string, frames int, fps int, loop boolean, directional boolean").withColumn("beats", F.explode(F.array(*map(F.lit, (3, 4, 6, 8)))))
    return rows.select("action", "beats", F.posexplode(poses.between(F.col("frames"), F.col("beats"))).alias("frame", "p")).select("action", "beats", "frame", "p.*")


BANDS = "b(action, lo, hi) AS (VALUES " + ", ".join(f"('{a}', {lo}, {hi})" for a, (lo, hi) in poses.BANDS.items()) + ")"
PICK = "['idle', 'walk', 'attack', 'death'][p_partkey % 4 + 1]"


@query(
    f"WITH {BANDS}, p AS (SELECT p_partkey, {PICK} AS action, (p_size * 2)::DOUBLE AS height FROM part) SELECT p_partkey, "
    "round(CASE WHEN height < 1 OR lo IS NULL THEN 1 ELSE least(greatest(height, 48.0::DOUBLE * lo::DOUBLE), 48.0::DOUBLE * hi::DOUBLE) / height END, 6) AS factor FROM p LEFT JOIN b USING (action)"
)
def band_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.array(*map(F.lit, ("idle", "walk", "attack", "death"))), (F.col("p_partkey") % 4).cast("int") + 1)
    factor = poses.band_factor((F.col("p_size") * 2).cast("double"), action, F.lit(48.0))
    return b.read(spark, sf_dir, "part").select("p_partkey", F.round(factor, 6).alias("factor"))


@query(
    "SELECT p_partkey, CASE WHEN p_size > 0 AND greatest(p_size, p_partkey % 90 + 1) * (200.0::DOUBLE / p_size) <= 1024 THEN greatest(1, round_even((p_partkey % 90 + 1) * (200.0::DOUBLE / p_size), 0)::INT) END AS w, "
    "CASE WHEN p_size > 0 AND greatest(p_size, p_partkey % 90 + 1) * (200.0::DOUBLE / p_size) <= 1024 THEN 200 END AS h FROM part"
)
def grown_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = poses.grown_size(F.col("p_partkey") % 90 + 1, F.col("p_size"), F.lit(200.0), F.lit(128))
    return b.read(spark, sf_dir, "part").select("p_partkey", size["w"].alias("w"), size["h"].alias("h"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'walk_up' ELSE 'slow_walk' END AS key, CASE WHEN event_type IN ('view', 'click') THEN 'walk' ELSE 'slow_walk' END AS action, CASE WHEN event_type IN ('view', 'click') THEN 'up' END AS direction FROM events")
def animation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_type").isin("view", "click"), "walk_up").otherwise("slow_walk")
    rows = b.read(spark, sf_dir, "events").select("event_id", key.alias("key"))
    return rows.select("event_id", "key", rules.action_of(F.col("key")).alias("a")).select("event_id", "key", "a.*")


@query(f"WITH {GRAPH} SELECT job_id, status FROM jo WHERE job_id NOT LIKE 'c%' OR (substr(job_id, 2)::BIGINT) % 2 = 0 UNION ALL SELECT job_id, 'PLANNED' FROM jo WHERE job_id LIKE 'c%' AND (substr(job_id, 2)::BIGINT) % 2 = 1")
def merged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming jobs add customers that the base lacks and change none that it has."""
    every, _ = graph(spark, sf_dir)
    odd = F.col("job_id").startswith("c") & (F.substring("job_id", 2, 20).try_cast("long") % 2 == 1)
    return jobs.merged(every.filter(~F.coalesce(odd, F.lit(False))), every.filter(F.col("job_id").startswith("c")).withColumn("status", F.lit("PLANNED")))


@query(
    f"WITH RECURSIVE {GRAPH}, re AS (SELECT job_id FROM jo WHERE needs = 'n0' UNION SELECT jo.job_id FROM re JOIN jo ON jo.needs = re.job_id) "
    "SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM re) THEN 'PLANNED' ELSE status END AS status, CASE WHEN job_id IN (SELECT job_id FROM re) THEN 0 ELSE 3 END AS attempts FROM jo"
)
def cascade_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, edges = graph(spark, sf_dir)
    hit = jobs.transitive_dependents(edges, every.filter("job_id = 'n0'").select(F.col("job_id").alias("root")))
    return jobs.invalidated(every.withColumn("attempts", F.lit(3)), hit)


@query(
    f"WITH {b.PLANE}, st AS (SELECT p.vec_id, p.x AS i, sum(abs(p.gray - q.gray))::DOUBLE AS g FROM pl p JOIN pl q ON p.vec_id = q.vec_id AND p.y = q.y AND p.x = q.x + 1 GROUP BY ALL), "
    "ce AS (SELECT vec_id, i, g - avg(g) OVER (PARTITION BY vec_id) AS c FROM st), en AS (SELECT vec_id, sum(c * c) AS e FROM ce GROUP BY vec_id), "
    "ac AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.c * b.c) AS s FROM ce a JOIN ce b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 1 AND 5 GROUP BY ALL) "
    "SELECT ac.vec_id, ac.lag, round(s / e, 6) AS r FROM ac JOIN en USING (vec_id) WHERE e > 0"
)
def edge_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = blocks.edge_profile(b.plane(spark, sf_dir), ["vec_id"], "x")
    return blocks.autocorrelation(profile, ["vec_id"], 1, 5).withColumn("r", F.round("r", 6))


@query(None)
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = blocks.edge_profile(b.plane(spark, sf_dir), ["vec_id"], "x")
    return blocks.block_size(blocks.autocorrelation(profile, ["vec_id"], 1, 5), ["vec_id"])
