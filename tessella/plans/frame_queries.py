"""Queries over frames, sequences, keying, colours and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import colors
from tessella.operators import checks, keying, masks, palette, sequence, stencil
from tessella.plans import bindings as b
from tessella.plans.registry import query

FRAME = ["vec_id", "key", "frame_idx"]
MAGENTA = (255, 0, 255)
FAR = colors.FARTHEST

METRICS = (
    "me AS (SELECT vec_id, key, frame_idx, count(*) AS area, min(x) AS left_px, min(y) AS top_px, max(x) + 1 AS right_px, "
    "max(y) + 1 AS bottom_px, avg(x) AS centre_x, max(y) + 1 - min(y) AS height FROM m GROUP BY ALL)"
)


def r6(name: str) -> F.Column:
    return F.round(F.col(name), 6).alias(name)


def metrics(spark: SparkSession, sf_dir: str, over: float = 0.0) -> DataFrame:
    return masks.frame_metrics(b.mask8(spark, sf_dir, over), FRAME)


@query(f"WITH {b.mask_sql(0.2)}, {METRICS} SELECT vec_id, area, left_px, top_px, right_px, bottom_px, height, round(centre_x, 6) AS centre_x FROM me")
def frame_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, 0.2).select("vec_id", "area", "left_px", "top_px", "right_px", "bottom_px", "height", r6("centre_x"))


@query(f"WITH {b.mask_sql(0.2)}, {METRICS} SELECT fr.vec_id, coalesce(area, 0) AS area, coalesce(height, 0) AS height, area IS NULL AS blank FROM fr LEFT JOIN me USING (vec_id)")
def blank_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.with_blank(b.frames(spark, sf_dir), metrics(spark, sf_dir, 0.2), FRAME).select("vec_id", "area", "height", "blank")


def spread_sql(v: str) -> str:
    return f"CASE WHEN count(*) FILTER ({v} > 0) >= 2 THEN (max({v}) FILTER ({v} > 0) - min({v}) FILTER ({v} > 0)) / avg({v}) FILTER ({v} > 0) ELSE 0 END"


@query(
    f"WITH {b.mask_sql(0.2)}, {METRICS}, w AS (SELECT fr.key, coalesce(area, 0) AS area, coalesce(height, 0) AS height FROM fr LEFT JOIN me USING (vec_id)) "
    f"SELECT key, round({spread_sql('height')}, 6) AS height_variation, round({spread_sql('area')}, 6) AS silhouette_variation, count(*) AS frames FROM w GROUP BY key"
)
def variation_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = masks.with_blank(b.frames(spark, sf_dir), metrics(spark, sf_dir, 0.2), FRAME)
    return masks.variation(every, ["key"]).select("key", r6("height_variation"), r6("silhouette_variation"), "frames")


@query(
    f"WITH {b.mask_sql()}, {METRICS} SELECT key, round(max(greatest(abs(bottom_px - 8), abs(centre_x - 4))), 6) AS max_drift, "
    "(max(bottom_px) - min(bottom_px))::DOUBLE AS baseline_spread, round(max(centre_x) - min(centre_x), 6) AS centre_spread FROM me GROUP BY key"
)
def anchor_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.anchor_measurement(metrics(spark, sf_dir), ["key"], 8, 8).select("key", r6("max_drift"), "baseline_spread", r6("centre_spread"))


@query(
    f"WITH {b.mask_sql(0.2)}, {METRICS}, s AS (SELECT vec_id, round_even(4 - centre_x, 0)::INT AS dx, round_even(8 - bottom_px, 0)::INT AS dy FROM me), "
    "p AS (SELECT vec_id, x + dx AS x, y + dy AS y FROM m JOIN s USING (vec_id)) "
    "SELECT vec_id, count(*) AS pixels, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y FROM p WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY vec_id"
)
def placed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = masks.place(b.mask8(spark, sf_dir, 0.2), metrics(spark, sf_dir, 0.2), FRAME, (8, 8))
    return moved.groupBy("vec_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query(f"WITH {b.mask_sql(0.2)}, {METRICS} SELECT key, min(left_px) AS left_px, min(top_px) AS top_px, max(right_px) AS right_px, max(bottom_px) AS bottom_px FROM me GROUP BY key")
def shared_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.union_bounds(metrics(spark, sf_dir, 0.2), ["key"])


@query(f"WITH {b.mask_sql(0.2)}, {METRICS} SELECT m.vec_id, max(x) - min(x) + 1 AS foot_span FROM m JOIN me USING (vec_id) WHERE y >= bottom_px - greatest(2, round_even(height * 0.1, 0)::INT) GROUP BY m.vec_id")
def foot_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.foot_span(b.mask8(spark, sf_dir, 0.2), metrics(spark, sf_dir, 0.2), FRAME).select("vec_id", "foot_span")


@query(
    f"WITH {b.mask_sql(0.2)}, {METRICS}, s AS (SELECT m.key, m.frame_idx, max(x) - min(x) + 1 AS span FROM m JOIN me USING (vec_id) "
    "WHERE y >= bottom_px - greatest(2, round_even(height * 0.1, 0)::INT) GROUP BY ALL), "
    "g AS (SELECT key, min(span) FILTER (frame_idx % 4 = 0)::DOUBLE AS stride_min, max(span) FILTER (frame_idx % 4 <> 0)::DOUBLE AS other_max FROM s GROUP BY key) "
    "SELECT key, stride_min, other_max, round(stride_min / other_max, 6) AS separation, stride_min / other_max > 1 AS consistent FROM g WHERE stride_min IS NOT NULL AND other_max IS NOT NULL"
)
def beat_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = masks.foot_span(b.mask8(spark, sf_dir, 0.2), metrics(spark, sf_dir, 0.2), FRAME)
    return masks.beat_signature(spans.withColumn("stride", F.col("frame_idx") % 4 == 0), ["key"]).withColumn("separation", F.round("separation", 6))


DIFFS = (
    "n AS (SELECT key, max(frame_idx) + 1 AS n FROM fr GROUP BY key), "
    "ar AS (SELECT fr.key, fr.frame_idx, n.n, (SELECT count(*) FROM m WHERE m.vec_id = fr.vec_id) AS area, fr.vec_id FROM fr JOIN n USING (key)), "
    "pr AS (SELECT a.key, a.frame_idx, a.area, c.area AS next_area, a.vec_id, c.vec_id AS next_id FROM ar a JOIN ar c ON a.key = c.key AND c.frame_idx = (a.frame_idx + 1) % a.n "
    "WHERE a.n > 1 AND (a.key % 2 = 0 OR c.frame_idx > 0)), "
    "bo AS (SELECT pr.vec_id, count(*) AS shared FROM pr JOIN m ON m.vec_id = pr.vec_id JOIN m o ON o.vec_id = pr.next_id AND o.x = m.x AND o.y = m.y GROUP BY pr.vec_id), "
    "di AS (SELECT key, frame_idx, (area + next_area - 2 * coalesce(shared, 0)) / 64 AS diff FROM pr LEFT JOIN bo USING (vec_id))"
)


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = b.frames(spark, sf_dir).select("key", "frame_idx")
    n = frames.groupBy("key").agg((F.max("frame_idx") + 1).alias("n"))
    listed = frames.join(n, "key").withColumn("loop", F.col("key") % 2 == 0)
    return sequence.adjacent_difference(b.mask8(spark, sf_dir), listed, "key", 64)


@query(f"WITH {b.mask_sql()}, {DIFFS} SELECT key, frame_idx, diff FROM di")
def adjacent_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir)


@query(
    f"WITH {b.mask_sql()}, {DIFFS}, lo AS (SELECT *, diff / greatest(1e-9, (coalesce(lag(diff) OVER w, last_value(diff) OVER u) + coalesce(lead(diff) OVER w, first_value(diff) OVER u)) / 2) AS l "
    "FROM di WINDOW w AS (PARTITION BY key ORDER BY frame_idx), u AS (PARTITION BY key ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "pa AS (SELECT key, frame_idx % 2 AS p, CASE WHEN count(*) > 1 AND avg(diff) > 0 THEN stddev_pop(diff) / avg(diff) ELSE 0 END AS cv FROM di GROUP BY ALL) "
    "SELECT key, count(*) AS n, round(max(diff) / min(diff), 6) AS max_over_min, round(max(l), 6) AS local_outlier, round((SELECT max(cv) FROM pa WHERE pa.key = lo.key), 6) AS parity_cv "
    "FROM lo GROUP BY key HAVING count(*) >= 3"
)
def frame_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.order_stats(differences(spark, sf_dir), "key", "frame_idx", "diff").select("key", "n", r6("max_over_min"), r6("local_outlier"), r6("parity_cv"))


@query(f"WITH {b.mask_sql()}, {DIFFS} SELECT key, max(diff) AS most, max(diff) <= 0.25 AS still FROM di GROUP BY key HAVING count(*) >= 3")
def static_animation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir).groupBy("key").agg(F.max("diff").alias("most"), F.count(F.lit(1)).alias("n")).filter("n >= 3").select("key", "most", (F.col("most") <= 0.25).alias("still"))


@query(f"WITH {b.FRAMES}, f AS (SELECT key, frame_idx, min(frame_idx) OVER (PARTITION BY key, embedding) AS first FROM fr WHERE embedding IS NOT NULL) SELECT key, first, frame_idx FROM f WHERE frame_idx > first")
def duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that equal an earlier one of their key in all their values."""
    return whole_duplicates(b.frames(spark, sf_dir))


def whole_duplicates(frames: DataFrame) -> DataFrame:
    # No two numbers are written the same.
    digest = F.sha2(F.array_join(F.transform("embedding", lambda v: v.cast("string")), ",", "null"), 256)
    whole = frames.filter("embedding IS NOT NULL").select("key", "frame_idx", digest.alias("digest"))
    return sequence.exact_duplicates(whole, "key", "frame_idx", "digest")


@query(
    f"WITH {b.mask_sql()}, s AS (SELECT vec_id, 4 - trunc(avg(y))::INT AS dy, 4 - trunc(avg(x))::INT AS dx FROM m GROUP BY vec_id), "
    "c AS (SELECT vec_id, key, frame_idx, (x + dx + 8) % 8 AS x, (y + dy + 8) % 8 AS y FROM m JOIN s USING (vec_id)), "
    "ar AS (SELECT vec_id, key, frame_idx, count(*) AS area FROM c GROUP BY ALL), "
    "sa AS (SELECT c.vec_id, count(*) AS n FROM c JOIN c f ON f.key = c.key AND f.frame_idx = 0 AND f.x = c.x AND f.y = c.y GROUP BY ALL), "
    "ot AS (SELECT c.vec_id, count(*) AS n FROM c JOIN c f ON f.key = c.key AND f.frame_idx = 0 AND f.x = 7 - c.x AND f.y = c.y GROUP BY ALL), "
    "ow AS (SELECT c.vec_id, count(*) AS n FROM c JOIN c f ON f.vec_id = c.vec_id AND f.x = 7 - c.x AND f.y = c.y GROUP BY ALL), "
    "z AS (SELECT ar.vec_id, coalesce(sa.n, 0) / (ar.area + f.area - coalesce(sa.n, 0)) - coalesce(ot.n, 0) / (ar.area + f.area - coalesce(ot.n, 0)) AS ch, "
    "coalesce(ow.n, 0) / (2 * ar.area - coalesce(ow.n, 0)) < 0.90 AS judged FROM ar JOIN ar f ON f.key = ar.key AND f.frame_idx = 0 "
    "LEFT JOIN sa ON sa.vec_id = ar.vec_id LEFT JOIN ot ON ot.vec_id = ar.vec_id LEFT JOIN ow ON ow.vec_id = ar.vec_id) "
    "SELECT vec_id, round_even(ch, 4) AS chirality, judged, judged AND ch < -0.03 AS flipped FROM z"
)
def mirror_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.mirror_flips(b.mask8(spark, sf_dir), FRAME, "key", 8, 8).drop("key", "frame_idx")


HIST = f"h AS (SELECT key, least(floor(sqrt((r - 255) * (r - 255) + g * g + (b - 255) * (b - 255)) * 256 / {FAR!r}), 255)::INT AS bin, count(*) AS n FROM px GROUP BY ALL)"


@query(f"WITH {b.RGBA}, {HIST} SELECT * FROM h")
def key_distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keying.distance_histogram(b.rgba4(spark, sf_dir), ["key"], MAGENTA)


OTSU = (
    f"{HIST}, s AS (SELECT key, bin, n, sum(n) OVER u AS w, sum(n * (2 * bin + 1)) OVER u AS m, sum(n) OVER p AS wt, sum(n * (2 * bin + 1)) OVER p AS mt FROM h "
    "WINDOW u AS (PARTITION BY key ORDER BY bin ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY key)), "
    "z AS (SELECT key, bin, CASE WHEN wt = w THEN 0 ELSE w::DOUBLE * (wt - w) * (m / w - (mt - m) / (wt - w)) * (m / w - (mt - m) / (wt - w)) END AS v FROM s), "
    f"th AS (SELECT key, (arg_min(bin, (-v, bin)) + 1) * {FAR / 256!r}::DOUBLE AS threshold FROM z GROUP BY key)"
)


@query(f"WITH {b.RGBA}, {OTSU} SELECT key, round(threshold, 6) AS threshold FROM th")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keying.otsu(keying.distance_histogram(b.rgba4(spark, sf_dir), ["key"], MAGENTA), ["key"]).select("key", r6("threshold"))


@query(
    f"WITH {b.RGBA}, {OTSU}, k AS (SELECT key, sqrt((r - 255) * (r - 255) + g * g + (b - 255) * (b - 255)) AS d, threshold FROM px JOIN th USING (key)) "
    "SELECT key, round(avg((d <= threshold)::INT), 6) AS background_ratio, count(*) FILTER (d > threshold AND d < 200) AS halo, NOT (avg((d <= threshold)::INT) BETWEEN 0.20 AND 0.98) AS suspicious FROM k GROUP BY key"
)
def chroma_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = b.rgba4(spark, sf_dir)
    limit = keying.otsu(keying.distance_histogram(px, ["key"], MAGENTA), ["key"])
    return keying.key_stats(keying.keyed(px, limit, ["key"], MAGENTA), ["key"]).withColumn("background_ratio", F.round("background_ratio", 6))


@query(f"WITH {b.RGBA} SELECT key, round(avg((sqrt((r - 255) * (r - 255) + g * g + (b - 255) * (b - 255)) <= 200)::INT), 6) AS residue FROM px WHERE a > 0 GROUP BY key")
def key_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keying.residue(b.rgba4(spark, sf_dir), ["key"], MAGENTA, 200.0).select("key", r6("residue"))


@query(f"WITH {b.RGBA} SELECT key, round(avg((greatest(least(r, b) - g, 0) > 24)::INT), 6) AS spill_ratio FROM px WHERE a > 0 GROUP BY key")
def spill_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keying.spill_ratio(b.rgba4(spark, sf_dir), ["key"], MAGENTA).select("key", r6("spill_ratio"))


@query(
    f"WITH {b.RGBA}, e AS (SELECT *, a > 0 AND (x = 0 OR y = 0 OR x = 3 OR y = 3) AS edge, greatest(least(r, b) - g, 0) AS s FROM px), "
    "d AS (SELECT key, CASE WHEN a = 0 THEN 0 WHEN edge THEN greatest(r - s, 0) ELSE r END AS r, CASE WHEN a = 0 THEN 0 ELSE g END AS g, CASE WHEN a = 0 THEN 0 WHEN edge THEN greatest(b - s, 0) ELSE b END AS b FROM e) "
    "SELECT key, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b FROM d GROUP BY key"
)
def despilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = b.rgba4(spark, sf_dir).withColumn("edge", F.col("x").isin(0, 3) | F.col("y").isin(0, 3))
    return keying.despill(px, MAGENTA).groupBy("key").agg(*(F.sum(c).alias(c) for c in "rgb"))


@query(
    f"WITH {b.RGBA}, o AS (SELECT vec_id, x, y FROM px WHERE a > 0), i AS (SELECT p.vec_id, p.x, p.y FROM o p JOIN o q ON q.vec_id = p.vec_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY ALL HAVING count(*) = 9), "
    "h AS (SELECT px.*, greatest(least(px.r, px.b) - px.g, 0) AS s, px.a > 0 AND least(px.r, px.b) > px.g AND i.x IS NULL AS hit FROM px LEFT JOIN i ON i.vec_id = px.vec_id AND i.x = px.x AND i.y = px.y), "
    "t AS (SELECT *, bool_or(hit) OVER (PARTITION BY vec_id) AS touched FROM h) "
    "SELECT vec_id, x, y, CASE WHEN touched AND a = 0 THEN 0 WHEN hit THEN greatest(r - trunc(s * 0.5)::INT, 0) ELSE r END AS r, CASE WHEN touched AND a = 0 THEN 0 ELSE g END AS g, CASE WHEN touched AND a = 0 THEN 0 WHEN hit THEN greatest(b - trunc(s * 0.5)::INT, 0) ELSE b END AS b, a FROM t"
)
def defringed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the spill taken off the edges of figures."""
    return keying.defringed(b.rgba4(spark, sf_dir), ["vec_id"], MAGENTA, 4, 4, 0.5, 1).select("vec_id", "x", "y", *"rgba")


@query(
    f"WITH {b.RGBA}, n AS (SELECT *, a > 0 AND sqrt((r - 255) * (r - 255) + g * g + (b - 255) * (b - 255)) <= 200 AS near FROM px) "
    "SELECT vec_id, count(*) FILTER (a > 0 AND NOT near) AS opaque, sum(CASE WHEN near THEN 0 ELSE r + g + b END)::BIGINT AS tone FROM n GROUP BY vec_id"
)
def residue_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = keying.without_residue(b.rgba4(spark, sf_dir), MAGENTA, 200.0)
    return px.groupBy("vec_id").agg(F.count_if(F.col("a") > 0).alias("opaque"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("tone"))


@query(f"WITH {b.RGBA} SELECT vec_id, count(*) FILTER (a = 0 AND (r <> 0 OR g <> 0 OR b <> 0)) AS residue FROM px GROUP BY vec_id")
def transparent_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keying.transparent_residue(b.rgba4(spark, sf_dir), ["vec_id"])


@query(f"WITH {b.RGBA} SELECT key, count(DISTINCT (r, g, b)) AS n_colors, sha256(string_agg(DISTINCT printf('#%02X%02X%02X', r, g, b), ',' ORDER BY printf('#%02X%02X%02X', r, g, b))) AS digest FROM px WHERE a > 0 GROUP BY key")
def palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = palette.palette(palette.color_counts(b.rgba4(spark, sf_dir), ["key"]), ["key"])
    return found.select("key", "n_colors", F.sha2(F.array_join("palette", ","), 256).alias("digest"))


@query(f"WITH {b.RGBA}, al AS (SELECT r, g, b FROM px WHERE a > 0 GROUP BY ALL HAVING count(*) >= 2 OR (r + g + b) % 3 = 0) SELECT key, round(avg(CASE WHEN (r, g, b) IN (SELECT (r, g, b) FROM al) THEN 0 ELSE 1 END), 6) AS overflow FROM px WHERE a > 0 GROUP BY key")
def palette_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = b.rgba4(spark, sf_dir)
    # A palette made of all frames: colours that are used twice or whose sum is a multiple of three.
    allowed = px.filter("a > 0").groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2 OR (r + g + b) % 3 = 0")
    return palette.overflow(palette.color_counts(px, ["key"]), allowed, ["key"]).select("key", r6("overflow"))


TARGETS = [(32, 32, 32), (224, 224, 224), (200, 80, 60), (60, 160, 80), (70, 90, 200), (128, 128, 128)]
NEAR = ", ".join(f"((r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {bb}) * (b - {bb}), {i})" for i, (r, g, bb) in enumerate(TARGETS))


@query(f"WITH {b.RGBA}, s AS (SELECT key, least({NEAR}) AS n FROM px WHERE a > 0) SELECT key, n[2] AS target, count(*) AS pixels, max(n[1]) AS worst FROM s GROUP BY ALL")
def palette_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapped = palette.snap(palette.color_counts(b.rgba4(spark, sf_dir), ["key"]), TARGETS)
    return snapped.groupBy("key", "target").agg(F.sum("n").alias("pixels"), F.max("d2").alias("worst"))


@query(None)
def median_cut_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.median_cut(palette.color_counts(b.rgba4(spark, sf_dir), ["key"]), ["key"], 16)


BLOCKS = (
    "bl AS (SELECT vec_id, x // 2 AS bx, y // 2 AS \"by\", coalesce(trunc(median(r) FILTER (a > 0))::INT, 0) AS r, coalesce(trunc(median(g) FILTER (a > 0))::INT, 0) AS g, "
    "coalesce(trunc(median(b) FILTER (a > 0))::INT, 0) AS b, avg((a > 0)::INT) > 0.5 AS opaque FROM px GROUP BY ALL)"
)


@query(f"WITH {b.RGBA}, {BLOCKS} SELECT * FROM bl")
def block_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return palette.block_medians(b.rgba4(spark, sf_dir), ["vec_id"], 4, 4, 2, 2)


@query(
    f"WITH {b.RGBA}, {BLOCKS} SELECT px.vec_id, round(avg(greatest(abs(px.r - bl.r), abs(px.g - bl.g), abs(px.b - bl.b))), 6) AS error FROM px JOIN bl ON px.vec_id = bl.vec_id AND px.x // 2 = bx AND px.y // 2 = \"by\" WHERE a > 0 GROUP BY px.vec_id"
)
def reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = b.rgba4(spark, sf_dir)
    return palette.reconstruction_error(px, palette.block_medians(px, ["vec_id"], 4, 4, 2, 2), ["vec_id"], 4, 4, 2, 2).select("vec_id", r6("error"))


NEIGHBOURS = "nb AS (SELECT m.vec_id, m.x, m.y, count(o.x) AS n FROM m LEFT JOIN m o ON o.vec_id = m.vec_id AND abs(o.x - m.x) <= 1 AND abs(o.y - m.y) <= 1 AND (o.x <> m.x OR o.y <> m.y) GROUP BY ALL)"


@query(f"WITH {b.mask_sql(0.1)}, {NEIGHBOURS} SELECT vec_id, x, y FROM nb WHERE n < 1")
def isolated_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.isolated(b.mask8(spark, sf_dir, 0.1), ["vec_id"]).select("vec_id", "x", "y")


@query(
    f"WITH {b.mask_sql()}, i AS (SELECT m.vec_id, m.x, m.y FROM m JOIN m o ON o.vec_id = m.vec_id AND abs(o.x - m.x) <= 1 AND abs(o.y - m.y) <= 1 GROUP BY ALL HAVING count(*) = 9) "
    "SELECT vec_id, count(*) AS pixels, sum(x + 8 * y)::BIGINT AS places FROM m WHERE (vec_id, x, y) NOT IN (SELECT (vec_id, x, y) FROM i) GROUP BY vec_id"
)
def edge_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = stencil.edge_band(b.mask8(spark, sf_dir), ["vec_id"], 8, 8, 1)
    return band.groupBy("vec_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("x") + 8 * F.col("y")).alias("places"))


SPAN = "(least(x + 1, 7) - greatest(x - 1, 0) + 1) * (least(y + 1, 7) - greatest(y - 1, 0) + 1)"


def morph_sql(src: str, out: str, grow: bool) -> str:
    if grow:
        return f"{out} AS (SELECT DISTINCT vec_id, x + dx AS x, y + dy AS y FROM {src}, (SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) c WHERE x + dx BETWEEN 0 AND 7 AND y + dy BETWEEN 0 AND 7)"
    return f"{out} AS (SELECT p.vec_id, p.x, p.y FROM {src} p JOIN {src} o ON o.vec_id = p.vec_id AND abs(o.x - p.x) <= 1 AND abs(o.y - p.y) <= 1 GROUP BY ALL HAVING count(*) = any_value((least(p.x + 1, 7) - greatest(p.x - 1, 0) + 1) * (least(p.y + 1, 7) - greatest(p.y - 1, 0) + 1)))"


@query(
    f"WITH {b.mask_sql(-0.15)}, d0 AS (SELECT vec_id, x, y FROM m), {morph_sql('d0', 'd1', False)}, {morph_sql('d1', 'd2', True)}, {morph_sql('d2', 'd3', True)}, {morph_sql('d3', 'd4', False)} "
    "SELECT vec_id, count(*) AS pixels, sum(x + 8 * y)::BIGINT AS places FROM d4 GROUP BY vec_id"
)
def opened_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = b.mask8(spark, sf_dir, -0.15).select("vec_id", "x", "y")
    out = stencil.closed(stencil.opened(mask, ["vec_id"], 8, 8), ["vec_id"], 8, 8)
    return out.groupBy("vec_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum(F.col("x") + 8 * F.col("y")).alias("places"))


LABELS = (
    "re AS (SELECT vec_id, x, y, x + 8 * y AS c FROM m UNION SELECT m.vec_id, m.x, m.y, re.c FROM re JOIN m ON m.vec_id = re.vec_id AND abs(m.x - re.x) + abs(m.y - re.y) = 1), "
    "la AS (SELECT vec_id, x, y, min(c) AS root FROM re GROUP BY ALL), "
    "co AS (SELECT vec_id, x, y, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) - 1 AS component FROM la)"
)


@query(f"WITH RECURSIVE {b.mask_sql()}, {LABELS} SELECT vec_id, component, count(*) AS area, min(x) AS left_px, min(y) AS top_px, max(x) + 1 AS right_px, max(y) + 1 AS bottom_px FROM co GROUP BY ALL")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.component_boxes(stencil.components(b.mask8(spark, sf_dir), ["vec_id"]), ["vec_id"])


@query(f"WITH RECURSIVE {b.mask_sql()}, {LABELS} SELECT vec_id, component, count(DISTINCT x // 4 + 2 * (y // 4)) AS cells FROM co GROUP BY ALL HAVING count(DISTINCT x // 4 + 2 * (y // 4)) > 1")
def crossing_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.crossing(stencil.components(b.mask8(spark, sf_dir), ["vec_id"]), ["vec_id"], 8, 8, 2, 2)


BOXES = "bx AS (SELECT vec_id, component, count(*) AS area, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM co GROUP BY ALL)"


@query(f"WITH RECURSIVE {b.mask_sql()}, {LABELS}, {BOXES} SELECT p.vec_id, p.component AS a, q.component AS b FROM bx p JOIN bx q ON p.vec_id = q.vec_id AND p.component < q.component AND p.l < q.r AND q.l < p.r AND p.t < q.b AND q.t < p.b")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.overlaps(stencil.component_boxes(stencil.components(b.mask8(spark, sf_dir), ["vec_id"]), ["vec_id"]), ["vec_id"])


@query(
    f"WITH RECURSIVE {b.mask_sql()}, {LABELS}, {BOXES}, s AS (SELECT *, l + r AS cx, t + b AS cy, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, component) AS k FROM bx), "
    "n AS (SELECT p.vec_id, p.component, q.component AS seed, (p.cx - q.cx) * (p.cx - q.cx) + (p.cy - q.cy) * (p.cy - q.cy) AS d FROM s p JOIN s q ON p.vec_id = q.vec_id AND q.k <= 2) "
    "SELECT vec_id, component, arg_min(seed, (d, seed)) AS seed FROM n GROUP BY ALL"
)
def component_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.grouped(stencil.component_boxes(stencil.components(b.mask8(spark, sf_dir), ["vec_id"]), ["vec_id"]), ["vec_id"], 2, 0.0, 0)


@query(
    f"WITH {b.mask_sql(0.2)}, {METRICS}, w AS (SELECT fr.key, coalesce(area, 0) AS area, coalesce(height, 0) AS height FROM fr LEFT JOIN me USING (vec_id)), "
    f"v AS (SELECT key, {spread_sql('height')} AS hv, {spread_sql('area')} AS sv FROM w GROUP BY key), "
    "t(k, action, hm, sm) AS (VALUES (0, 'idle', 0.14, 0.12), (1, 'walk', 0.12, 0.20), (2, 'attack', 0.30, 0.45), (3, 'hurt', 0.30, 0.35), (4, 'death', NULL, NULL), (5, 'cast', 0.30, 0.45), (6, 'travel', 0.40, 0.60), (7, 'impact', NULL, NULL), (8, 'loop', 0.20, 0.30)), "
    "c AS (SELECT key, 'height_variation' AS id, hv AS measured, hm AS lim FROM v JOIN t ON key % 9 = k UNION ALL SELECT key, 'silhouette_variation', sv, sm FROM v JOIN t ON key % 9 = k) "
    "SELECT key, id, round(measured, 6) AS measured, CASE WHEN lim IS NULL THEN 'SKIP' WHEN measured <= lim THEN 'PASS' ELSE 'FAIL' END AS result FROM c"
)
def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric to judgement: variations of every key against its action's limits."""
    from tessella import dims

    every = masks.with_blank(b.frames(spark, sf_dir), metrics(spark, sf_dir, 0.2), FRAME)
    action = F.element_at(F.array(*(F.lit(t[0]) for t in dims.THRESHOLDS)), (F.col("key") % len(dims.THRESHOLDS)).cast("int") + 1)
    rows = masks.variation(every, ["key"]).withColumns({"action": action, "direction": F.lit("down"), "moving": F.lit("biped")})
    rows = checks.resolve_thresholds(rows)
    pairs = F.explode(F.array(*(F.struct(F.lit(f"{k}_variation").alias("id"), F.col(f"{k}_variation").alias("measured"), F.col(f"{k}_max").alias("lim")) for k in ("height", "silhouette"))))
    return checks.judged(rows.select("key", pairs.alias("c")).select("key", "c.*"), "measured", "lim").select("key", "id", r6("measured"), "result")
