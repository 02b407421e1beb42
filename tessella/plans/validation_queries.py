"""The report of animations: eight successive embeddings are the frames of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import dims
from tessella.operators import checks, sheets, stencil, validation
from tessella.plans import bindings as b
from tessella.plans import sheet_queries as s
from tessella.plans.job_queries import THRESHOLDS
from tessella.plans.registry import query

#: Actions in turn, the last one without limits; directions in turn, null for none.
NAMES = [*(t[0] for t in dims.THRESHOLDS), "dodge"]
DIRECTIONS = ["down", "up", "left", "right", None]
#: Frames of an animation; values above which a pixel is opaque.
N, OVER = 8, 0.02


def _turn(values: list, at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values)).cast("int") + 1)


def animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in 19 asks for another number of frames; the number of colours that is let pass differs."""
    a = F.col("anim")
    loops = [x[0] for x in dims.ACTIONS if x[3]]
    rows = b.read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / N).alias("anim")).distinct()
    return rows.select(
        "anim", _turn(NAMES, a).alias("action"), _turn(DIRECTIONS, F.floor(a * 7 / 10)).alias("direction"), F.when(a % 4 == 1, "floating").otherwise("biped").alias("moving"),
        _turn(NAMES, a).isin(loops).alias("loop"), F.when(a % 19 == 4, N - 2).otherwise(N).alias("expected_frames"), F.lit(8).alias("expected_width"), F.lit(8).alias("expected_height"),
        (2 + a % 3).alias("max_colors"),
    )


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the embedding that they show: one in six animations stands still, another one in six
    repeats a frame; some frames are missing or too narrow."""
    rows = b.read(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / N).alias("anim"), (F.col("vec_id") % N).cast("int").alias("frame_idx"))
    a, f = F.col("anim"), F.col("frame_idx")
    shown = F.when(a % 6 == 5, a * N).when((a % 6 == 4) & (f == 3), F.col("vec_id") - 1).otherwise(F.col("vec_id"))
    width = F.when((a % 17 == 3) & (f == 1), F.lit(None)).when((a % 13 == 7) & (f == 2), 7).otherwise(8)
    action = _turn(NAMES, a)
    return rows.select("anim", "frame_idx", shown.alias("shown"), width.alias("width"), F.lit(8).alias("height"), F.when(action != "dodge", (action == "walk") & (f % 4 == 0)).alias("stride"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of every listed frame; one in 23 animations has an empty frame, one in five keeps colours under
    transparent pixels."""
    px = b.plane(spark, sf_dir).select(F.col("vec_id").alias("shown"), "x", "y", "v", "gray")
    out = listed(spark, sf_dir).select("anim", "frame_idx", "shown").join(px, "shown")
    opaque = (F.col("v") > OVER) & ~((F.col("anim") % 23 == 6) & (F.col("frame_idx") == 6))
    out = out.withColumn("a", F.when(opaque, 255).otherwise(0))
    colored = (F.col("a") > 0) | ((F.col("anim") % 5 == 2) & (F.col("v") > 0))
    tone = F.floor(F.col("gray") / 32).cast("int") * 32
    return out.select("anim", "frame_idx", "x", "y", *(F.when(colored, c).otherwise(0).alias(n) for n, c in (("r", tone), ("g", 255 - tone), ("b", F.lit(9)))), "a")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the source of an animation, the sheet of its number, comes apart into its frames."""
    known = s.layouts(spark, sf_dir).withColumn("cols", F.when(F.col("sheet") % 7 < 6, F.col("cols")))
    boxes = stencil.component_boxes(stencil.components(s.opaque_sheets(spark, sf_dir).filter("a > 0"), s.BY), s.BY)
    return sheets.cell_overflow(boxes, known, s.BY, **s.AREAS).withColumnRenamed("sheet", "anim")


def _array(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


LOOPS = ", ".join(f"'{x[0]}'" for x in dims.ACTIONS if x[3])
CHECKS = ", ".join(f"('{i}', '{sev}')" for i, sev, _ in dims.CHECKS)
ANIMATIONS = (
    f"t(action, hm, sm, dm) AS (VALUES {THRESHOLDS}, ('dodge', NULL, NULL, NULL)), ck(id, severity) AS (VALUES {CHECKS}), "
    f"a0 AS (SELECT DISTINCT vec_id // {N} AS anim FROM embeddings), "
    f"a1 AS (SELECT anim, {_array(NAMES)}[anim % 10 + 1] AS action, {_array(DIRECTIONS)}[(anim * 7 // 10) % 5 + 1] AS direction, anim % 4 = 1 AS floating, CASE WHEN anim % 19 = 4 THEN {N - 2} ELSE {N} END AS ef, 2 + anim % 3 AS mc FROM a0), "
    f"an AS (SELECT a1.*, action IN ({LOOPS}) AS loop, CASE WHEN floating AND action = 'walk' THEN NULL ELSE round_even(hm::DOUBLE * CASE WHEN direction = 'up' THEN 1.3 ELSE 1.0 END::DOUBLE, 4) END AS height_max, "
    "CASE WHEN floating AND action = 'walk' THEN NULL ELSE round_even(sm::DOUBLE * CASE WHEN direction = 'up' THEN 1.3 ELSE 1.0 END::DOUBLE, 4) END AS silhouette_max, "
    "dm AS drift_max, CASE WHEN action = 'dodge' THEN 'custom_action_unthresholded' ELSE 'action_exempt' END AS reason FROM a1 JOIN t USING (action)), "
    f"l0 AS (SELECT vec_id, vec_id // {N} AS anim, (vec_id % {N})::INT AS f FROM embeddings), "
    f"li AS (SELECT anim, f, CASE WHEN anim % 6 = 5 THEN anim * {N} WHEN anim % 6 = 4 AND f = 3 THEN vec_id - 1 ELSE vec_id END AS shown, "
    "CASE WHEN anim % 17 = 3 AND f = 1 THEN NULL WHEN anim % 13 = 7 AND f = 2 THEN 7 ELSE 8 END AS width, CASE WHEN action <> 'dodge' THEN action = 'walk' AND f % 4 = 0 END AS stride FROM l0 JOIN an USING (anim)), "
    f"p0 AS (SELECT li.anim, li.f, x, y, v, gray // 32 * 32 AS tone, v > {OVER} AND NOT (li.anim % 23 = 6 AND li.f = 6) AS op FROM li JOIN pl ON pl.vec_id = shown), "
    "px AS MATERIALIZED (SELECT anim, f, x, y, op, CASE WHEN op OR (anim % 5 = 2 AND v > 0) THEN tone ELSE 0 END AS r, CASE WHEN op OR (anim % 5 = 2 AND v > 0) THEN 255 - tone ELSE 0 END AS g, CASE WHEN op OR (anim % 5 = 2 AND v > 0) THEN 9 ELSE 0 END AS b FROM p0), "
    "mk AS MATERIALIZED (SELECT anim, f, x, y FROM px WHERE op)"
)
PARTS = (
    "fm AS (SELECT anim, f, count(*) FILTER (op) AS area, min(x) FILTER (op) AS lo, min(y) FILTER (op) AS top, max(y) FILTER (op) + 1 AS bottom, avg(x) FILTER (op) AS cx, "
    "count(*) FILTER (NOT op AND r + g + b <> 0) AS residue, string_agg(CASE WHEN op THEN 'o' ELSE 't' END || r || '.' || g || '.' || b, ',' ORDER BY y, x) AS whole FROM px GROUP BY ALL), "
    "fr2 AS (SELECT li.*, fm.* EXCLUDE (anim, f), coalesce(bottom - top, 0) AS h FROM li LEFT JOIN fm USING (anim, f)), "
    "ba AS (SELECT anim, count(*) AS n, count(*) FILTER (width IS NULL) AS lacking, count(DISTINCT width) = 1 AS uniform, min(width) AS wl, count(*) FILTER (coalesce(area, 0) = 0) AS blank, coalesce(sum(residue), 0) AS residue, "
    "CASE WHEN count(*) FILTER (h > 0) >= 2 THEN (max(h) FILTER (h > 0) - min(h) FILTER (h > 0)) / avg(h) FILTER (h > 0) ELSE 0 END AS hv, CASE WHEN count(*) FILTER (area > 0) >= 2 THEN (max(area) FILTER (area > 0) - min(area) FILTER (area > 0)) / avg(area) FILTER (area > 0) ELSE 0 END AS sv, "
    "coalesce(max(greatest(abs(bottom - 8), abs(cx - arg_w / 2))), 0) AS drift, bool_and(stride IS NOT NULL) AS posed FROM (SELECT *, first_value(width) OVER (PARTITION BY anim ORDER BY f) AS arg_w FROM fr2) GROUP BY anim), "
    "co2 AS (SELECT anim, count(DISTINCT (r, g, b)) AS colors FROM px WHERE op GROUP BY anim), "
    "du AS (SELECT anim, count(*) - count(DISTINCT whole || ':' || width) AS copies FROM fr2 GROUP BY anim), "
    "pr AS (SELECT a.anim, a.f, a.width, q.width AS w2, a.area AS s1, q.area AS s2, q.f AS g FROM fr2 a JOIN ba USING (anim) JOIN an USING (anim) JOIN fr2 q ON q.anim = a.anim AND q.f = (a.f + 1) % n WHERE n > 1 AND (loop OR q.f > 0)), "
    "sh2 AS (SELECT pr.anim, pr.f, count(*) AS k FROM pr JOIN mk a ON a.anim = pr.anim AND a.f = pr.f JOIN mk q ON q.anim = pr.anim AND q.f = pr.g AND q.x = a.x AND q.y = a.y GROUP BY ALL), "
    "di AS (SELECT anim, f, CASE WHEN width = w2 THEN (s1 + s2 - 2 * coalesce(k, 0)) / (8 * width) ELSE 1 END AS d FROM pr LEFT JOIN sh2 USING (anim, f)), "
    "lo AS (SELECT *, d / greatest(1e-9, (coalesce(lag(d) OVER w, last_value(d) OVER u) + coalesce(lead(d) OVER w, first_value(d) OVER u)) / 2) AS l FROM di WINDOW w AS (PARTITION BY anim ORDER BY f), u AS (PARTITION BY anim ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "st AS (SELECT anim, max(d) AS most, max(l) AS outlier FROM lo GROUP BY anim HAVING count(*) >= 3), "
    "fs AS (SELECT fr2.anim, fr2.f, fr2.stride, coalesce((SELECT max(x) - min(x) + 1 FROM mk WHERE mk.anim = fr2.anim AND mk.f = fr2.f AND y >= bottom - greatest(2, round_even(h * 0.1, 0)::INT)), 0) AS span FROM fr2), "
    "be AS (SELECT anim, min(span) FILTER (stride) AS smin, max(span) FILTER (NOT stride) AS omax FROM fs GROUP BY anim), "
    "ce2 AS (SELECT anim, f, 4 - trunc(avg(y))::INT AS dy, width // 2 - trunc(avg(x))::INT AS dx, width AS w FROM mk JOIN li USING (anim, f) GROUP BY anim, f, width), "
    "cm AS MATERIALIZED (SELECT anim, f, (x + dx + w) % w AS x, (y + dy + 8) % 8 AS y, w FROM mk JOIN ce2 USING (anim, f)), "
    "ca AS (SELECT anim, f, count(*) AS area FROM cm GROUP BY ALL), "
    "c1 AS (SELECT c.anim, c.f, count(*) AS k FROM cm c JOIN cm o ON o.anim = c.anim AND o.f = 0 AND o.x = c.x AND o.y = c.y GROUP BY ALL), "
    "c2 AS (SELECT c.anim, c.f, count(*) AS k FROM cm c JOIN cm o ON o.anim = c.anim AND o.f = 0 AND o.x = c.w - 1 - c.x AND o.y = c.y GROUP BY ALL), "
    "c3 AS (SELECT c.anim, c.f, count(*) AS k FROM cm c JOIN cm o ON o.anim = c.anim AND o.f = c.f AND o.x = c.w - 1 - c.x AND o.y = c.y GROUP BY ALL), "
    "mi AS (SELECT ca.anim, coalesce(c1.k, 0) / (ca.area + coalesce(z.area, 0) - coalesce(c1.k, 0)) - coalesce(c2.k, 0) / (ca.area + coalesce(z.area, 0) - coalesce(c2.k, 0)) AS ch, coalesce(c3.k, 0) / (2 * ca.area - coalesce(c3.k, 0)) < 0.90 AS judged "
    "FROM ca LEFT JOIN ca z ON z.anim = ca.anim AND z.f = 0 LEFT JOIN c1 ON c1.anim = ca.anim AND c1.f = ca.f LEFT JOIN c2 ON c2.anim = ca.anim AND c2.f = ca.f LEFT JOIN c3 ON c3.anim = ca.anim AND c3.f = ca.f), "
    "mf AS (SELECT anim, count(*) FILTER (judged) AS judged, count(*) FILTER (judged AND ch < -0.03) AS flipped FROM mi GROUP BY anim), "
    "ov AS (SELECT sheet AS anim, CASE WHEN sheet % 7 = 6 THEN 'SKIP' WHEN fragments IS NULL THEN 'FAIL' ELSE 'PASS' END AS of_result, CASE WHEN sheet % 7 < 6 THEN CASE WHEN fragments IS NULL THEN 0 ELSE frames END END AS of_measured, CASE WHEN sheet % 7 < 6 THEN frames END AS of_lim "
    "FROM ly LEFT JOIN (SELECT sheet, count(*) FILTER (k > frames) AS fragments FROM fi GROUP BY sheet) USING (sheet)), "
    "al AS MATERIALIZED (SELECT an.*, ba.* EXCLUDE (anim), coalesce(colors, 0) AS colors, coalesce(copies, 0) AS copies, most, outlier, smin, omax, coalesce(judged, 0) AS judged, coalesce(flipped, 0) AS flipped, coalesce(of_result, 'SKIP') AS of_result, of_measured, of_lim, "
    "greatest(0, coalesce(colors, 0) - mc) / greatest(1, coalesce(colors, 0)) AS over, coalesce(posed AND direction IN ('left', 'right') AND smin IS NOT NULL AND omax IS NOT NULL, false) AS stepping, n > 1 AND uniform AND (coalesce(judged, 0) > 0 OR blank > 0) AS facing "
    "FROM an JOIN ba USING (anim) LEFT JOIN co2 USING (anim) LEFT JOIN du USING (anim) LEFT JOIN st USING (anim) LEFT JOIN be USING (anim) LEFT JOIN mf USING (anim) LEFT JOIN ov USING (anim)), "
    "ok AS (SELECT * FROM al WHERE lacking = 0)"
)


def _row(name: str, result: str, measured: str = "NULL", limit: str = "NULL", reason: str = "NULL", table: str = "ok") -> str:
    return f"SELECT anim, '{name}' AS id, {result} AS result, ({measured})::DOUBLE AS measured, ({limit})::DOUBLE AS lim, {reason} AS skip_reason FROM {table}"


def _if(ok: str) -> str:
    return f"CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END"


def _limited(name: str, value: str, limit: str, shown: str) -> str:
    return _row(name, f"CASE WHEN {limit} IS NULL THEN 'SKIP' WHEN {value} <= {limit} THEN 'PASS' ELSE 'FAIL' END", shown, limit, f"CASE WHEN {limit} IS NULL THEN reason END")


def _where(on: str, name: str, ok: str, measured: str, limit: str) -> str:
    return _row(name, f"CASE WHEN {on} THEN {_if(ok)} ELSE 'SKIP' END", f"CASE WHEN {on} THEN {measured} END", f"CASE WHEN {on} THEN {limit} END", f"CASE WHEN {on} THEN NULL ELSE 'not_applicable' END")


SEPARATION = "CASE WHEN omax > 0 THEN smin / omax ELSE 'inf'::DOUBLE END"
ROWS = " UNION ALL ".join([
    _row("frame_count", _if("n = ef"), "n", "ef", table="al"),
    _row("frame_count", "'FAIL'", table="al WHERE lacking > 0"),
    _row("frame_size", _if("uniform AND wl = 8")),
    _row("blank_frame", _if("blank = 0"), "blank", "0"),
    _row("transparent_rgb_residue", _if("residue = 0"), "residue", "0"),
    _row("cell_overflow", "of_result", "of_measured", "of_lim", "CASE WHEN of_result = 'SKIP' THEN 'not_applicable' END"),
    _limited("anchor_drift", "drift", "drift_max", "CASE WHEN drift_max IS NULL THEN drift ELSE round_even(drift, 2) END"),
    _limited("height_variation", "hv", "height_max", "round_even(hv, 4)"),
    _limited("silhouette_variation", "sv", "silhouette_max", "round_even(sv, 4)"),
    _row("palette_overflow", _if("over <= 0.02"), "round_even(over, 4)", "0.02"),
    _row("duplicate_frame_exact", _if("copies = 0"), "copies", "0"),
    _where("most IS NOT NULL", "static_animation", "most > 0.01", "round_even(most, 4)", "0.01"),
    _row("frame_order_continuity", "'SKIP'", "round_even(outlier, 3)", "NULL", "'not_applicable'"),
    _where("stepping", "beat_signature", f"{SEPARATION} > 1", f"round_even({SEPARATION}, 3)", "1.0"),
    _where("facing", "mirror_flip", "flipped = 0", "flipped", "0"),
])
REPORT = f"WITH RECURSIVE {s.SHEETS}, {s.FIGURES}, {ANIMATIONS}, {PARTS}, re2 AS ({ROWS})"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = listed(spark, sf_dir).drop("shown")
    return validation.animation_report(animations(spark, sf_dir), frames, pixels(spark, sf_dir), "anim", sources(spark, sf_dir))


@query(f"{REPORT} SELECT anim, action, direction, id, severity, result, round(measured, 6) AS measured, lim, skip_reason FROM re2 JOIN an USING (anim) JOIN ck USING (id)")
def animation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen checks of every animation."""
    return reports(spark, sf_dir).withColumn("measured", F.round("measured", 6)).select("anim", "action", "direction", "id", "severity", "result", "measured", "lim", "skip_reason")


@query(
    f"{REPORT} SELECT anim, count(*) AS total, count(*) FILTER (result = 'PASS') AS passed_checks, count(*) FILTER (result = 'FAIL') AS failed, count(*) FILTER (result = 'WARN') AS warnings, "
    "count(*) FILTER (result = 'SKIP') AS skipped, count(*) FILTER (result = 'FAIL' AND severity IN ('fatal', 'high')) = 0 AS passed FROM re2 JOIN ck USING (id) GROUP BY anim"
)
def animation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by result and whether every animation passes."""
    return checks.report(reports(spark, sf_dir).withColumnRenamed("anim", "asset_id")).withColumnRenamed("asset_id", "anim")
