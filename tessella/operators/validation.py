"""The whole report of an animation: every check of its frames as a row.

``animations``: the key, action, direction (null for none), moving, loop, expected_frames,
expected_width, expected_height, max_colors; one row each.
``frames``: the key, frame_idx from 0, width, height (null where the file is missing), stride (whether
the pose asked for is a stride; null where it isn't known); one row a listed frame.
``px``: the key, frame_idx, x, y, r, g, b, a: every pixel of the frames.

Measures of a frame come out of one aggregation of its pixels, so a frame costs a row a task before
anything is shuffled; all that follows is keyed by the animation.  The checks of an animation are made
from one wide row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import dims
from tessella.lineage import cut
from tessella.operators import checks, masks, sequence

#: The share of colours beyond the limit that is let pass, the difference of masks below
#: which nothing moves, and the directions in which a stride can be seen.
OVERFLOW_MAX, STILL, SIDEWAYS = 0.02, 0.01, ("left", "right")

ANIMATION = ["action", "direction", "moving", "loop", "expected_frames", "expected_width", "expected_height", "max_colors"]


def frame_measures(px: DataFrame, by: list[str]) -> DataFrame:
    """For each frame that has pixels: area, left_px to bottom_px, centre_x, height, baseline (null or 0
    where nothing is opaque), residue (transparent pixels with a colour) and a digest.

    Frames with equal digests have equal pixels, up to a collision of two 64-bit sums.
    """
    seen = lambda c: F.when(F.col("a") > 0, F.col(c))
    all_of = ("x", "y", "r", "g", "b", "a")
    out = px.groupBy(*by).agg(
        F.count_if(F.col("a") > 0).alias("area"), F.min(seen("x")).alias("left_px"), F.min(seen("y")).alias("top_px"),
        (F.max(seen("x")) + 1).alias("right_px"), (F.max(seen("y")) + 1).alias("bottom_px"), F.avg(seen("x")).alias("centre_x"),
        F.count_if((F.col("a") == 0) & ((F.col("r") != 0) | (F.col("g") != 0) | (F.col("b") != 0))).alias("residue"),
        F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*all_of)), F.bit_xor(F.xxhash64(F.lit(1), *all_of))).alias("digest"),
    )
    return out.withColumns({"height": F.coalesce(F.col("bottom_px") - F.col("top_px"), F.lit(0)), "baseline": F.col("bottom_px")})


def _within(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("FAIL")


def _check(name: str, result: Column, measured: Column | None = None, limit: Column | None = None, reason: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(name).alias("id"), result.alias("result"), (none if measured is None else measured).cast("double").alias("measured"),
        (none if limit is None else limit).cast("double").alias("lim"), F.when(result == "SKIP", none if reason is None else reason).cast("string").alias("skip_reason"),
    )


def _by_animation(frames: DataFrame, measures: DataFrame, key: str) -> DataFrame:
    """One row for each animation that lists frames: counts, sizes, anchor and variations."""
    rows = frames.join(measures, [key, "frame_idx"], "left")
    first = lambda c: F.min_by(c, "frame_idx")
    base = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("width").isNull() | F.col("height_px").isNull()).alias("lacking"),
        *(f(c).alias(f"{c}_{name}") for c in ("width", "height_px") for name, f in (("low", F.min), ("high", F.max), ("first", first))),
        F.count_if(F.coalesce("area", F.lit(0)) == 0).alias("blank"), F.coalesce(F.sum("residue"), F.lit(0)).alias("residue"),
        masks.relative_spread(F.col("height")).alias("height_variation"), masks.relative_spread(F.col("area")).alias("silhouette_variation"),
        F.min("baseline").alias("floor_low"), F.max("baseline").alias("floor_high"), F.min("centre_x").alias("centre_low"), F.max("centre_x").alias("centre_high"),
        F.bool_and(F.col("stride").isNotNull()).alias("posed"),
    )
    # The farthest from a point is one of the two ends.
    far = lambda c, to: F.greatest(F.abs(F.col(f"{c}_low") - to), F.abs(F.col(f"{c}_high") - to))
    drift = F.greatest(far("floor", F.col("height_px_first")).cast("double"), far("centre", F.col("width_first") / 2))
    same = (F.col("width_low") == F.col("width_high")) & (F.col("height_px_low") == F.col("height_px_high"))
    return base.withColumns({"drift": F.coalesce(drift, F.lit(0.0)), "uniform": same})


def _moves(mask: DataFrame, frames: DataFrame, animations: DataFrame, key: str) -> DataFrame:
    """most (the largest difference of successive masks) and local_outlier; animations of fewer than
    three differences have no row.  Masks of unequal size differ wholly."""
    sizes = frames.select(key, "frame_idx", F.struct("width", "height_px").alias("size"))
    n = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    listed = frames.select(key, "frame_idx").join(n, key).join(animations.select(key, "loop"), key)
    pairs = sequence.adjacent_difference(mask, listed, key, 1).join(n, key).join(sizes, [key, "frame_idx"])
    after = sizes.select(key, F.col("frame_idx").alias("next"), F.col("size").alias("next_size"))
    pairs = pairs.withColumn("next", (F.col("frame_idx") + 1) % F.col("n")).join(after, [key, "next"])
    share = F.when(F.col("size") == F.col("next_size"), F.col("diff") / (F.col("size.width") * F.col("size.height_px"))).otherwise(1.0)
    series = pairs.select(key, "frame_idx", share.alias("diff"))
    return series.groupBy(key).agg(F.max("diff").alias("most")).join(sequence.order_stats(series, key, "frame_idx", "diff").select(key, "local_outlier"), key)


def animation_report(animations: DataFrame, frames: DataFrame, px: DataFrame, key: str, overflow: DataFrame | None = None) -> DataFrame:
    """The fourteen checks of every animation: key, action, direction, id, severity, result (PASS, FAIL,
    SKIP), measured, lim and skip_reason.

    ``overflow``: key, result, measured, lim of the sources, as ``sheets.cell_overflow`` gives them; what
    has no row there is skipped.  An animation without listed frames has a failed frame_count only; one
    with missing files has its frame_count and a failed one without a measure, and nothing else.
    Variations and drift are skipped for actions without limits, and say whether the action is exempt or
    unknown.  The order of frames can't be judged from pixels, so it is measured and skipped.
    Strides are judged from the side only, where every pose is known and some are strides and some not;
    mirror flips where frames have one size and one of them is not symmetric.  Blank frames count as
    having no height, no feet and no symmetry.
    """
    animations = animations.select(key, *ANIMATION)
    frames = frames.select(key, "frame_idx", "width", F.col("height").alias("height_px"), "stride")
    whole = frames.groupBy(key).agg(F.bool_and(F.col("width").isNotNull() & F.col("height_px").isNotNull()).alias("whole")).filter("whole").select(key)
    frames_read = frames.join(whole, key, "left_semi")
    # Six steps read the pixels, and three the measures.
    px = cut(px.select(key, "frame_idx", "x", "y", "r", "g", "b", "a").repartition(key, "frame_idx"))
    measures = cut(frame_measures(px, [key, "frame_idx"]))
    mask = px.filter("a > 0").select(key, "frame_idx", "x", "y")

    base = _by_animation(frames, measures, key)
    colors = px.filter("a > 0").select(key, "r", "g", "b").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("colors"))
    digests = frames_read.join(measures, [key, "frame_idx"]).select(key, "frame_idx", F.struct("width", "height_px", "digest").alias("digest"))
    copies = sequence.exact_duplicates(digests, key, "frame_idx", "digest").groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    spans = frames_read.join(masks.foot_span(mask, measures.filter("area > 0"), [key, "frame_idx"]), [key, "frame_idx"], "left")
    beats = masks.beat_signature(spans.select(key, "stride", F.coalesce("foot_span", F.lit(0)).alias("foot_span")), [key]).select(key, "separation", "consistent")
    sized = mask.join(frames_read.select(key, "frame_idx", F.col("width").alias("w"), F.col("height_px").alias("h")), [key, "frame_idx"])
    flips = sequence.mirror_flips(sized, [key, "frame_idx", "w", "h"], key, F.col("w"), F.col("h"))
    flips = flips.groupBy(key).agg(F.count_if("judged").alias("judged"), F.count_if("flipped").alias("flipped"))

    rows = checks.resolve_thresholds(animations)
    for part in (base, colors, copies, _moves(mask, frames_read, animations, key), beats, flips):
        rows = rows.join(part, key, "left")
    if overflow is None:
        rows = rows.withColumns({"of_result": F.lit(None).cast("string"), "of_measured": F.lit(None), "of_lim": F.lit(None)})
    else:
        rows = rows.join(overflow.select(key, *(F.col(c).alias(f"of_{c}") for c in ("result", "measured", "lim"))), key, "left")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = F.col("action").isin([t[0] for t in dims.THRESHOLDS])
    exempt, other = F.when(known, "action_exempt").otherwise("custom_action_unthresholded"), F.lit("not_applicable")
    right_size = F.col("uniform") & (F.col("width_low") == F.col("expected_width")) & (F.col("height_px_low") == F.col("expected_height"))
    over = F.greatest(F.lit(0), zero("colors") - F.col("max_colors")) / F.greatest(F.lit(1), zero("colors"))

    def limited(name: str, value: str, limit: str, places: int) -> Column:
        v, most = F.col(value), F.col(limit)
        shown = F.bround(v, places) if value != "drift" else F.when(most.isNull(), v).otherwise(F.bround(v, places))
        return _check(name, F.when(most.isNull(), "SKIP").otherwise(_within(v <= most)), shown, most, exempt)

    counted = _check("frame_count", _within(zero("n") == F.col("expected_frames")), zero("n"), F.col("expected_frames"))
    stepping = F.col("posed") & F.col("direction").isin(*SIDEWAYS) & F.col("separation").isNotNull()
    facing = (F.col("n") > 1) & F.col("uniform") & ((zero("judged") > 0) | (F.col("blank") > 0))
    stepping, facing = F.coalesce(stepping, F.lit(False)), F.coalesce(facing, F.lit(False))
    moved = F.col("most").isNotNull()
    rest = [
        _check("frame_size", _within(right_size)),
        _check("blank_frame", _within(F.col("blank") == 0), F.col("blank"), F.lit(0)),
        _check("transparent_rgb_residue", _within(F.col("residue") == 0), F.col("residue"), F.lit(0)),
        _check("cell_overflow", F.coalesce("of_result", F.lit("SKIP")), F.col("of_measured"), F.col("of_lim"), other),
        limited("anchor_drift", "drift", "drift_max", 2),
        limited("height_variation", "height_variation", "height_max", 4),
        limited("silhouette_variation", "silhouette_variation", "silhouette_max", 4),
        _check("palette_overflow", _within(over <= OVERFLOW_MAX), F.bround(over, 4), F.lit(OVERFLOW_MAX)),
        _check("duplicate_frame_exact", _within(zero("copies") == 0), zero("copies"), F.lit(0)),
        _check("static_animation", F.when(moved, _within(F.col("most") > STILL)).otherwise("SKIP"), F.bround("most", 4), F.when(moved, STILL), other),
        _check("frame_order_continuity", F.lit("SKIP"), F.bround("local_outlier", 3), None, other),
        _check("beat_signature", F.when(stepping, _within(F.col("consistent"))).otherwise("SKIP"), F.when(stepping, F.bround("separation", 3)), F.when(stepping, 1.0), other),
        _check("mirror_flip", F.when(facing, _within(zero("flipped") == 0)).otherwise("SKIP"), F.when(facing, zero("flipped")), F.when(facing, 0), other),
    ]
    made = F.when(zero("n") == 0, F.array(counted)).when(F.col("lacking") > 0, F.array(counted, _check("frame_count", F.lit("FAIL")))).otherwise(F.array(counted, *rest))
    facts = rows.select(key, "action", "direction", F.explode(made).alias("c")).select(key, "action", "direction", "c.*")
    return facts.join(F.broadcast(dims.checks(animations.sparkSession).select("id", "severity")), "id")


#: Checks that say nothing of a mirrored animation, as its source has them.
DERIVED_SKIPS = ("anchor_drift", "height_variation", "silhouette_variation", "frame_order_continuity")


def derived_report(derived: DataFrame, key: str) -> DataFrame:
    """The skipped checks of animations that are mirror images of others (key, action, direction)."""
    none = F.lit(None).cast("double")
    rows = derived.select(key, "action", "direction", F.explode(F.array(*map(F.lit, DERIVED_SKIPS))).alias("id"))
    rows = rows.select("*", F.lit("SKIP").alias("result"), none.alias("measured"), none.alias("lim"), F.lit("derived_animation").alias("skip_reason"))
    return rows.join(F.broadcast(dims.checks(derived.sparkSession).select("id", "severity")), "id")
