"""What is stored of tilesets, held against what their pixels say now.

``declared``: tileset, tile_id of all tiles that a tileset lists.  Stored tables are judged with
the limits that were stored with them, never with today's defaults.  A tileset that lists a tile
whose pixels are missing, or has pixels of a tile that it does not list, cannot be recomputed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import tiles

#: Fixed value: stored distances may differ from recomputed ones by this.
TOLERANCE = 1e-6


def _dependency(declared: DataFrame, present: DataFrame) -> DataFrame:
    """tileset, whole: whether the tiles it lists are those whose pixels are there."""
    a = declared.select("tileset", "tile_id").distinct().withColumn("listed", F.lit(1))
    b = present.select("tileset", "tile_id").distinct().withColumn("there", F.lit(1))
    both = a.join(b, ["tileset", "tile_id"], "full")
    return both.groupBy("tileset").agg((F.count_if(F.col("listed").isNull() | F.col("there").isNull()) == 0).alias("whole"), F.count("listed").alias("n")).filter("n > 0").drop("n")


def fresh_edges(measures: DataFrame, limits: DataFrame, declared: DataFrame) -> DataFrame:
    """tileset, direction (right or down), tile_id, other: pairs that fit under their tileset's own limits.

    ``measures``: those of :func:`tiles.pair_measures`; ``limits``: tileset, seam_max, gap_max.
    """
    own = declared.select("tileset", F.col("tile_id").alias("src")).distinct().join(limits, "tileset")
    ok = measures.join(own, "src").filter((F.col("seam_ratio") <= F.col("seam_max")) & (F.col("color_gap") <= F.col("gap_max")))
    return ok.select("tileset", F.when(F.col("axis") == "horizontal", "right").otherwise("down").alias("direction"), F.col("src").alias("tile_id"), F.col("dst").alias("other"))


def edge_drift(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """tileset, direction, tile_id, other, cause: edges that only one side has; missing (the pixels
    fit, the table does not say so) or surplus (the table says so, the pixels do not fit).

    Both: tileset, direction, tile_id, other; repeated edges count once.
    """
    keys = ["tileset", "direction", "tile_id", "other"]
    a = stored.select(*keys).distinct().withColumn("was", F.lit(True))
    b = fresh.select(*keys).distinct().withColumn("now", F.lit(True))
    both = a.join(b, keys, "full").filter(F.col("was").isNull() | F.col("now").isNull())
    return both.select(*keys, F.when(F.col("was").isNull(), "missing").otherwise("surplus").alias("cause"))


def adjacency_checks(stored: DataFrame, measures: DataFrame, limits: DataFrame, declared: DataFrame, present: DataFrame) -> DataFrame:
    """tileset, target, result, measured, skip_reason: whether each tile's stored neighbours to the
    right and below are those of its pixels; measured is the number of directions that are not.

    Tilesets without ``limits`` store no table and are skipped as not_applicable, incomplete ones as
    dependency_failed, with one row whose target is ``tileset``.
    """
    drifted = edge_drift(stored, fresh_edges(measures, limits, declared)).groupBy("tileset", "tile_id").agg(F.count_distinct("direction").alias("n"))
    state = _dependency(declared, present).join(limits.select("tileset", F.lit(True).alias("known")), "tileset", "left")
    judged = declared.select("tileset", "tile_id").distinct().join(state.filter("known AND whole").select("tileset"), "tileset").join(drifted, ["tileset", "tile_id"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    checks = judged.select("tileset", F.col("tile_id").alias("target"), F.when(n == 0, "PASS").otherwise("FAIL").alias("result"), n.alias("measured"), F.lit(None).cast("string").alias("skip_reason"))
    return checks.unionByName(_skipped(state))


def _skipped(state: DataFrame) -> DataFrame:
    reason = F.when(F.col("known").isNull(), "not_applicable").otherwise("dependency_failed")
    gone = state.filter(F.col("known").isNull() | ~F.col("whole"))
    return gone.select("tileset", F.lit("tileset").alias("target"), F.lit("SKIP").alias("result"), F.lit(None).cast("long").alias("measured"), reason.alias("skip_reason"))


def bases(stored: DataFrame) -> DataFrame:
    """tileset, terrain, tile_id: for each terrain the first tile whose four declared corners are all of it."""
    whole = stored.groupBy("tileset", "tile_id").agg(F.count("declared").alias("n"), F.min("declared").alias("terrain"), F.max("declared").alias("last"))
    return whole.filter("n = 4 AND terrain = last").groupBy("tileset", "terrain").agg(F.min("tile_id").alias("tile_id"))


def terrains_without_base(stored: DataFrame) -> DataFrame:
    """tileset, terrain: declared terrains that no tile shows in all its corners."""
    declared = stored.filter("declared IS NOT NULL").select("tileset", F.col("declared").alias("terrain")).distinct()
    return declared.join(bases(stored).select("tileset", "terrain"), ["tileset", "terrain"], "left_anti")


def measured_corners(quads: DataFrame, base: DataFrame, limits: DataFrame) -> DataFrame:
    """tileset, tile_id, corner, terrain, distance of every quadrant against its tileset's bases, under
    its tileset's ``distance_max``; the first by name among equally near ones.

    ``quads``: tileset and the columns of :func:`tiles.quadrants`.  A tileset's quadrants meet its own
    few bases only.
    """
    known = quads.join(base, ["tileset", "tile_id"]).select("tileset", "corner", "terrain", F.col("marks").alias("base"))
    near = quads.join(known, ["tileset", "corner"]).withColumn("distance", tiles._quadrant_distance())
    best = near.groupBy("tileset", "tile_id", "corner").agg(F.min(F.struct("distance", "terrain")).alias("n")).join(limits, "tileset")
    terrain = F.when(F.col("n.distance") <= F.col("distance_max"), F.col("n.terrain"))
    return best.select("tileset", "tile_id", "corner", terrain.alias("terrain"), F.col("n.distance").alias("distance"), "distance_max")


def terrain_checks(stored: DataFrame, quads: DataFrame, limits: DataFrame, declared: DataFrame) -> DataFrame:
    """tileset, target (tile/corner), result, measured, lim, table_drift, declared_mismatch, skip_reason.

    ``stored``: tileset, tile_id, corner, declared, terrain, distance as they were written (declared
    and terrain may be null); ``limits``: tileset, distance_max of those that store terrain.  A corner
    fails if its stored terrain or distance is not what the pixels give now, or if they contradict
    what was declared.  Tilesets without limits are skipped as not_applicable, incomplete ones as
    dependency_failed; one that declares a terrain without a base, or none at all, fails as a whole.
    """
    state = _dependency(declared, quads).join(limits.select("tileset", F.lit(True).alias("known")), "tileset", "left")
    own = stored.join(state.filter("known AND whole").select("tileset"), "tileset")
    based = state.filter("known AND whole").select("tileset").join(bases(own).select("tileset").distinct().withColumn("some", F.lit(True)), "tileset", "left")
    bad = based.join(terrains_without_base(own).select("tileset").distinct().withColumn("lacks", F.lit(True)), "tileset", "left").filter("some IS NULL OR lacks").select("tileset")
    fine = own.join(bad, "tileset", "left_anti")
    now = measured_corners(quads.join(fine.select("tileset").distinct(), "tileset"), bases(fine), limits)
    was = fine.select("tileset", "tile_id", "corner", "declared", F.col("terrain").alias("was"), F.col("distance").alias("was_far"))
    both = was.join(now, ["tileset", "tile_id", "corner"])
    table: list[Column] = [~F.col("was").eqNullSafe(F.col("terrain")), F.coalesce(F.abs(F.col("was_far") - F.col("distance")) > TOLERANCE, F.lit(True))]
    both = both.withColumns({"table_drift": reduce(or_, table), "declared_mismatch": F.col("declared").isNotNull() & ~F.col("declared").eqNullSafe(F.col("terrain"))})
    none = F.lit(None).cast("string").alias("skip_reason")
    result = F.when(F.col("table_drift") | F.col("declared_mismatch"), "FAIL").otherwise("PASS").alias("result")
    checks = both.select("tileset", F.concat_ws("/", "tile_id", "corner").alias("target"), result, F.col("distance").alias("measured"), F.col("distance_max").cast("double").alias("lim"), "table_drift", "declared_mismatch", none)
    no, nothing = F.lit(None).cast("boolean"), F.lit(None).cast("double")
    failed = bad.select("tileset", F.lit("tileset").alias("target"), F.lit("FAIL").alias("result"), nothing.alias("measured"), nothing.alias("lim"), no.alias("table_drift"), no.alias("declared_mismatch"), none)
    gone = _skipped(state).select("tileset", "target", "result", nothing.alias("measured"), nothing.alias("lim"), no.alias("table_drift"), no.alias("declared_mismatch"), "skip_reason")
    return checks.unionByName(failed).unionByName(gone)
