"""Queries over sheets: four successive embeddings as one image of 16 x 16, and its layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import keying, sheets, stencil
from tessella.plans import bindings as b
from tessella.plans.registry import query

KEY = (255, 0, 255)
#: Distance to the key up to which a pixel may be background; value above which one is opaque.
NEAR, OVER = 140.0, -0.12
#: Areas that suit images of this size.
AREAS = {"seed_area": 3, "seed_share": 0.05, "noise_area": 2, "noise_share": 0.01}
BY = ["sheet"]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, x, y, v, gray: the images of four embeddings side by side and below each other."""
    rows = b.plane(spark, sf_dir)
    cell = F.col("vec_id") % 4
    return rows.select(F.floor(F.col("vec_id") / 4).alias("sheet"), (F.col("x") + cell % 2 * 8).cast("int").alias("x"), (F.col("y") + F.floor(cell / 2) * 8).cast("int").alias("y"), "v", "gray")


def keyed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("gray") / 2).cast("int")
    return places(spark, sf_dir).select("sheet", "x", "y", (half + 128).alias("r"), (F.lit(127) - half).alias("g"), (half + 128).alias("b"))


def opaque_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("v") > OVER, 255).otherwise(0)
    return places(spark, sf_dir).select("sheet", "x", "y", F.col("gray").alias("r"), (F.lit(255) - F.col("gray")).alias("g"), F.lit(7).alias("b"), a.alias("a"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 x 2 cells with four or three frames, or 3 x 2 with five; one sheet in seven has no layout."""
    ids = b.read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("sheet")).distinct()
    kind = F.col("sheet") % 3
    cols, frames = F.when(kind == 2, 3).otherwise(2), F.when(kind == 0, 4).when(kind == 1, 3).otherwise(5)
    return ids.select("sheet", F.lit(16).alias("width"), F.lit(16).alias("height"), cols.alias("cols"), F.lit(2).alias("rows"), frames.alias("frames"))


SHEETS = b.PLANE + ", sh AS (SELECT vec_id // 4 AS sheet, x + vec_id % 2 * 8 AS x, y + vec_id // 2 % 2 * 8 AS y, v, gray FROM pl)"


def _morph(src: str, out: str, grow: bool) -> str:
    """Growing or shrinking by a 3 x 3 square on a 22 x 22 canvas beyond which all is set."""
    near = f"FROM {src} p JOIN {src} q ON q.sheet = p.sheet AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1"
    if grow:
        edge = f"SELECT DISTINCT sheet, i AS x, j AS y FROM {src}, range(22) a(i), range(22) c(j) WHERE i IN (0, 21) OR j IN (0, 21)"
        return f"{out} AS MATERIALIZED (SELECT DISTINCT sheet, x + dx AS x, y + dy AS y FROM {src}, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) c(dy) WHERE x + dx BETWEEN 0 AND 21 AND y + dy BETWEEN 0 AND 21 UNION {edge})"
    return f"{out} AS MATERIALIZED (SELECT p.sheet, p.x, p.y {near} GROUP BY ALL HAVING count(*) = any_value((least(p.x + 1, 21) - greatest(p.x - 1, 0) + 1) * (least(p.y + 1, 21) - greatest(p.y - 1, 0) + 1)))"


GROUND = (
    f"ds AS MATERIALIZED (SELECT sheet, x, y, gray // 2 + 128 AS r, 127 - gray // 2 AS g, gray // 2 + 128 AS b, sqrt(3 * (127 - gray // 2) * (127 - gray // 2)) AS d FROM sh), "
    f"m0 AS MATERIALIZED (SELECT sheet, x + 3 AS x, y + 3 AS y FROM ds WHERE d <= {NEAR} UNION ALL SELECT sheet, i, j FROM (SELECT DISTINCT sheet FROM ds) s, range(22) a(i), range(22) c(j) WHERE i < 3 OR i > 18 OR j < 3 OR j > 18), "
    f"{_morph('m0', 'm1', False)}, {_morph('m1', 'm2', True)}, {_morph('m2', 'm3', True)}, {_morph('m3', 'm4', False)}, "
    "gr AS (SELECT DISTINCT sheet, 0 AS x, 0 AS y FROM m4 UNION SELECT m4.sheet, m4.x, m4.y FROM gr JOIN m4 ON m4.sheet = gr.sheet AND abs(m4.x - gr.x) + abs(m4.y - gr.y) = 1), "
    "kg AS MATERIALIZED (SELECT ds.*, gr.x IS NOT NULL AS ground FROM ds LEFT JOIN gr ON gr.sheet = ds.sheet AND gr.x = ds.x + 3 AND gr.y = ds.y + 3)"
)


@query(
    f"WITH RECURSIVE {SHEETS}, {GROUND} SELECT sheet, round(avg(ground::INT), 6) AS background_ratio, count(*) FILTER (d > {NEAR} AND d < 200) AS halo, NOT (avg(ground::INT) BETWEEN 0.2 AND 0.98) AS suspicious, "
    f"count(*) FILTER (d <= {NEAR} AND NOT ground) AS holes, count(*) FILTER (d > {NEAR} AND ground) AS filled FROM kg GROUP BY sheet"
)
def cut_out_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sheets come apart into background that reaches the border and what stays."""
    return keying.cut_out_stats(_cut_out(spark, sf_dir), BY).withColumn("background_ratio", F.round("background_ratio", 6))


def _cut_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = keyed_sheets(spark, sf_dir)
    limits = px.select("sheet").distinct().withColumn("threshold", F.lit(NEAR))
    return keying.cut_out(px, limits, BY, KEY, 16, 16)


@query(f"WITH RECURSIVE {SHEETS}, {GROUND} SELECT sheet, x, y, r, g, b FROM kg WHERE NOT ground")
def cut_out_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opaque pixels of sheets that were cut out."""
    return _cut_out(spark, sf_dir).filter("a > 0").select("sheet", "x", "y", "r", "g", "b")


# Components of sheets, from starts without a left or upper neighbour, then figures and viewports.
FIGURES = (
    "ly AS (SELECT DISTINCT sheet, 16 AS width, 16 AS height, CASE sheet % 3 WHEN 2 THEN 3 ELSE 2 END AS cols, 2 AS rows, CASE sheet % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 5 END AS frames FROM sh), "
    f"op AS MATERIALIZED (SELECT sheet, x, y, gray AS r, 255 - gray AS g, 7 AS b FROM sh WHERE v > {OVER}), "
    "re AS (SELECT sheet, x, y, x + 16 * y AS c FROM op o WHERE NOT EXISTS (SELECT 1 FROM op q WHERE q.sheet = o.sheet AND ((q.x = o.x - 1 AND q.y = o.y) OR (q.x = o.x AND q.y = o.y - 1))) "
    "UNION SELECT op.sheet, op.x, op.y, re.c FROM re JOIN op ON op.sheet = re.sheet AND abs(op.x - re.x) + abs(op.y - re.y) = 1), "
    "co AS MATERIALIZED (SELECT sheet, x, y, dense_rank() OVER (PARTITION BY sheet ORDER BY min(c)) - 1 AS component FROM re GROUP BY sheet, x, y), "
    "bo AS (SELECT sheet, component, count(*) AS area, min(x) AS l, min(y) AS t, max(x) + 1 AS r, max(y) + 1 AS b FROM co GROUP BY ALL), "
    "f1 AS (SELECT *, count(*) OVER s AS n, max(area) OVER s AS largest FROM bo JOIN ly USING (sheet) WINDOW s AS (PARTITION BY sheet)), "
    "f2 AS (SELECT *, count(*) FILTER (area >= greatest(3, largest * 0.05)) OVER (PARTITION BY sheet) AS n_large FROM f1 WHERE n >= frames), "
    "f3 AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY (area >= greatest(3, largest * 0.05) OR n_large < frames) DESC, area DESC, component) AS k FROM f2), "
    "se AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY least(rows - 1, (t + b) * rows // (2 * height)), l + r, k) - 1 AS frame FROM f3 WHERE k <= frames), "
    "fi AS MATERIALIZED (SELECT f3.*, CASE WHEN f3.k <= f3.frames THEN (SELECT frame FROM se WHERE se.sheet = f3.sheet AND se.k = f3.k) "
    "ELSE (SELECT arg_min(frame, ((se.l + se.r - f3.l - f3.r) ** 2 + (se.t + se.b - f3.t - f3.b) ** 2, frame)) FROM se WHERE se.sheet = f3.sheet) END AS frame FROM f3 WHERE k <= frames OR area >= greatest(2, largest * 0.01)), "
    "v1 AS (SELECT sheet, frame, rows, height, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) - 1 AS fragments FROM fi GROUP BY sheet, frame, rows, height), "
    "v2 AS (SELECT *, least(rows - 1, (t + b) * rows // (2 * height)) AS band FROM v1), "
    "v3 AS (SELECT *, min(t) OVER w AS row_top, max(b) OVER w - min(t) OVER w AS row_height FROM v2 WINDOW w AS (PARTITION BY sheet, band)), "
    "vp AS MATERIALIZED (SELECT *, max(r - l) OVER s + 8 AS frame_w, max(row_height) OVER s + 8 AS frame_h FROM v3 WINDOW s AS (PARTITION BY sheet))"
)
# Cells of the sheets that have too few components.
SLOTS = (
    "ls AS (SELECT *, width // cols AS cw, height // rows AS ch FROM ly WHERE sheet NOT IN (SELECT sheet FROM vp)), "
    "s1 AS (SELECT op.sheet, frames, cols, cw, ch, x - (width - cols * cw) // 2 AS x, y - (height - rows * ch) // 2 AS y, r, g, b, rows FROM op JOIN ls USING (sheet)), "
    "s2 AS (SELECT *, y // ch * cols + x // cw AS frame FROM s1 WHERE x >= 0 AND y >= 0 AND x < cols * cw AND y < rows * ch), "
    "sl AS MATERIALIZED (SELECT sheet, frame, x % cw AS x, y % ch AS y, r, g, b, ch FROM s2 WHERE frame < frames), "
    "ra AS (SELECT sheet, greatest(0, min(y) - 4) AS top, least(any_value(ch), max(y) + 5) AS bottom FROM sl GROUP BY sheet)"
)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sheets.split(opaque_sheets(spark, sf_dir), layouts(spark, sf_dir), BY, **AREAS)


@query(
    f"WITH RECURSIVE {SHEETS}, {FIGURES}, {SLOTS}, ov AS (SELECT p.sheet, count(*) AS n FROM vp p JOIN vp q ON p.sheet = q.sheet AND p.frame < q.frame AND p.l < q.r AND q.l < p.r AND p.t < q.b AND q.t < p.b GROUP BY p.sheet) "
    "SELECT vp.sheet, 'components' AS method, count(*) AS frames, max(frame_w) AS frame_w, max(frame_h) AS frame_h, sum(fragments)::BIGINT AS fragments, coalesce(max(ov.n), 0) AS overlaps FROM vp LEFT JOIN ov USING (sheet) GROUP BY vp.sheet "
    "UNION ALL SELECT sheet, 'stable_slots', frames, cw, coalesce(bottom - top, ch), 0, 0 FROM ls LEFT JOIN ra USING (sheet)"
)
def split_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which way every sheet is taken apart, and into what."""
    return _split(spark, sf_dir)[0]


@query(
    f"WITH RECURSIVE {SHEETS}, {FIGURES}, {SLOTS}, fp AS (SELECT co.sheet, vp.frame, co.x - vp.l + (frame_w - (vp.r - vp.l)) // 2 AS x, co.y + 4 - row_top AS y, op.r, op.g, op.b "
    "FROM co JOIN fi ON fi.sheet = co.sheet AND fi.component = co.component JOIN vp ON vp.sheet = fi.sheet AND vp.frame = fi.frame JOIN op ON op.sheet = co.sheet AND op.x = co.x AND op.y = co.y "
    "UNION ALL SELECT sheet, frame, x, y - top, r, g, b FROM sl JOIN ra USING (sheet)) SELECT sheet, frame, x, y, r, g, b FROM fp"
)
def split_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of the frames of every sheet."""
    return _split(spark, sf_dir)[1].select("sheet", "frame", "x", "y", "r", "g", "b")


def _lines(size: str, n: str) -> str:
    return f"round_even(k * {size} / {n}, 0)"


@query(
    f"WITH RECURSIVE {SHEETS}, {FIGURES}, "
    f"li AS (SELECT sheet, 'v' AS axis, k, {_lines('width', 'cols')}::INT AS p FROM ly, range(1, 9) t(k) WHERE k < cols UNION ALL SELECT sheet, 'h', k, {_lines('height', 'rows')}::INT FROM ly, range(1, 9) t(k) WHERE k < rows), "
    "hi AS (SELECT li.sheet, axis, k, count(*) AS n FROM li JOIN op ON op.sheet = li.sheet AND abs(CASE axis WHEN 'v' THEN x ELSE y END - p) <= 1 GROUP BY ALL), "
    "cr AS (SELECT sheet, component FROM co JOIN ly USING (sheet) GROUP BY ALL HAVING count(DISTINCT x * cols // width + cols * (y * rows // height)) > 1), "
    f"ce AS (SELECT ly.*, c, d, round_even(c * width / cols, 0) AS x0, round_even((c + 1) * width / cols, 0) AS x1, round_even(d * height / rows, 0) AS y0, round_even((d + 1) * height / rows, 0) AS y1 FROM ly, range(9) t(c), range(9) u(d) WHERE c < cols AND d < rows AND d * cols + c < frames), "
    "ma AS (SELECT ce.sheet, c, d, least(min((x - x0) / (x1 - x0)), min((x1 - 1 - x) / (x1 - x0)), min((y - y0) / (y1 - y0)), min((y1 - 1 - y) / (y1 - y0))) AS m FROM ce JOIN op ON op.sheet = ce.sheet AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL), "
    "o AS (SELECT sheet, (SELECT count(*) FROM hi WHERE hi.sheet = ly.sheet) AS gutter_lines, coalesce((SELECT sum(n) FROM hi WHERE hi.sheet = ly.sheet), 0)::BIGINT AS band_pixels, (SELECT count(*) FROM cr WHERE cr.sheet = ly.sheet) AS crossings, coalesce((SELECT min(m) FROM ma WHERE ma.sheet = ly.sheet), 0) AS min_margin FROM ly) "
    "SELECT sheet, gutter_lines, band_pixels, crossings, round(min_margin, 6) AS min_margin, gutter_lines = 0 AND crossings = 0 AS clean FROM o"
)
def sheet_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a sheet's figures lies on its grid lines or beyond."""
    return sheets.overflow(opaque_sheets(spark, sf_dir), layouts(spark, sf_dir), BY).withColumn("min_margin", F.round("min_margin", 6))


@query(
    f"WITH RECURSIVE {SHEETS}, {FIGURES}, fo AS (SELECT sheet, count(*) FILTER (k > frames) AS fragments FROM fi GROUP BY sheet) "
    "SELECT sheet, CASE WHEN sheet % 7 = 6 THEN 'SKIP' WHEN fragments IS NULL THEN 'FAIL' ELSE 'PASS' END AS result, CASE WHEN sheet % 7 < 6 THEN CASE WHEN fragments IS NULL THEN 0 ELSE frames END END AS measured, "
    "CASE WHEN sheet % 7 < 6 THEN frames END AS lim, CASE WHEN sheet % 7 < 6 THEN coalesce(fragments, 0) ELSE 0 END AS fragments FROM ly LEFT JOIN fo USING (sheet)"
)
def cell_overflow_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every sheet still comes apart into its frames; those without a grid are skipped."""
    known = layouts(spark, sf_dir).withColumn("cols", F.when(F.col("sheet") % 7 < 6, F.col("cols")))
    boxes = stencil.component_boxes(stencil.components(opaque_sheets(spark, sf_dir).filter("a > 0"), BY), BY)
    return sheets.cell_overflow(boxes, known, BY, **AREAS)
