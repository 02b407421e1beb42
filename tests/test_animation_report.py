"""The report of animations against a plain version, one animation at a time."""

import numpy as np
import pytest

from tessella.operators import validation as v

ANIMATIONS = "name string, action string, direction string, moving string, loop boolean, expected_frames int, expected_width int, expected_height int, max_colors int"
FRAMES = "name string, frame_idx int, width int, height int, stride boolean"
PX = "name string, frame_idx int, x int, y int, r int, g int, b int, a int"


def image(seed, w=6, h=5, share=0.5):
    r = np.random.default_rng(seed)
    a = (r.random((h, w)) < share) * 255
    tone = r.integers(1, 4, (h, w)) * 60 * (a > 0)
    return np.dstack([tone, tone, tone, a])


def spread(values):
    values = [x for x in values if x > 0]
    return (max(values) - min(values)) / np.mean(values) if len(values) > 1 else 0.0


def iou(a, b):
    return (a & b).sum() / (a | b).sum() if (a | b).any() else 0.0


def centred(m):
    if not m.any():
        return m
    ys, xs = np.nonzero(m)
    return np.roll(m, (m.shape[0] // 2 - int(ys.mean()), m.shape[1] // 2 - int(xs.mean())), (0, 1))


def plain(images, strides, loop, direction, size, count, most_colors):
    """(id, result, measured) but for what needs limits of an action or a source."""
    out = {"frame_count": ("PASS" if len(images) == count else "FAIL", len(images))}
    masks = [i[..., 3] > 0 for i in images]
    shapes = {m.shape for m in masks}
    out["frame_size"] = ("PASS" if shapes == {size[::-1]} else "FAIL", None)
    judge = lambda n: ("PASS" if n == 0 else "FAIL", n)
    out["blank_frame"] = judge(sum(not m.any() for m in masks))
    out["transparent_rgb_residue"] = judge(sum(int(((i[..., :3] != 0).any(-1) & ~m).sum()) for i, m in zip(images, masks)))
    whole = [(i.shape, i.tobytes()) for i in images]
    out["duplicate_frame_exact"] = judge(len(whole) - len(set(whole)))
    colors = len({tuple(p) for i, m in zip(images, masks) for p in i[m][:, :3]})
    over = max(0, colors - most_colors) / max(1, colors)
    out["palette_overflow"] = ("PASS" if over <= 0.02 else "FAIL", over)
    rows = [np.nonzero(m) for m in masks]
    out["height_variation"] = spread([y.max() - y.min() + 1 if len(y) else 0 for y, _ in rows])
    out["silhouette_variation"] = spread([m.sum() for m in masks])
    h, w = masks[0].shape
    out["anchor_drift"] = max((max(abs(y.max() + 1 - h), abs(x.mean() - w / 2)) for y, x in rows if len(y)), default=0.0)
    pairs = list(zip(masks, masks[1:])) + ([(masks[-1], masks[0])] if loop and len(masks) > 1 else [])
    diffs = [(a ^ b).mean() if a.shape == b.shape else 1.0 for a, b in pairs]
    out["static_animation"] = ("PASS" if max(diffs) > 0.01 else "FAIL", max(diffs)) if len(diffs) > 2 else ("SKIP", None)
    n = len(diffs)
    out["frame_order_continuity"] = ("SKIP", max(diffs[i] / max(1e-9, (diffs[i - 1] + diffs[(i + 1) % n]) / 2) for i in range(n)) if n > 2 else None)
    spans = []
    for y, x in rows:
        low = x[y > y.max() - max(2, round((y.max() - y.min() + 1) * 0.1))] if len(y) else []
        spans.append(low.max() - low.min() + 1 if len(low) else 0)
    step, other = [s for s, k in zip(spans, strides) if k], [s for s, k in zip(spans, strides) if k is False]
    known = None not in strides and step and other and direction in ("left", "right")
    ratio = (min(step) / max(other) if max(other) else float("inf")) if known else None
    out["beat_signature"] = ("PASS" if ratio > 1 else "FAIL", ratio) if known else ("SKIP", None)
    out["mirror_flip"] = ("SKIP", None)
    if len(masks) > 1 and len(shapes) == 1:
        c = [centred(m) for m in masks]
        judged = [iou(m, m[:, ::-1]) < 0.9 for m in c]
        if any(judged):
            out["mirror_flip"] = judge(sum(j and iou(m, c[0]) - iou(m[:, ::-1], c[0]) < -0.03 for m, j in zip(c, judged)))
    return out


def residue(i):
    out = i.copy()
    out[0, 0] = (5, 0, 0, 0)
    return out


FLAT = np.zeros((5, 6, 4), int)
BOX = FLAT.copy()
BOX[1:4, 1:5] = (10, 20, 30, 255)
CASES = {
    "plain": ([image(i) for i in range(6)], [True, False, False, True, False, False], True, "left"),
    "once": ([image(i) for i in range(10, 14)], [True, False, True, False], False, "right"),
    "no way known": ([image(i) for i in range(20, 25)], [None] * 5, True, "left"),
    "front": ([image(i) for i in range(30, 35)], [True, False, True, False, False], True, "up"),
    "blank first": ([FLAT, *(image(i) for i in range(40, 44))], [True, False, False, False, False], True, "left"),
    "blank feet": ([image(50), FLAT, FLAT, image(51)], [True, False, False, True], True, "right"),
    "all blank": ([FLAT] * 4, [True, False, True, False], True, "left"),
    "still": ([BOX] * 5, [False] * 5, False, None),
    "one frame": ([image(60)], [True], True, "left"),
    "two frames": ([image(61), image(62)[:, ::-1]], [True, False], True, "left"),
    "two sizes": ([image(70), image(71, 7), image(72), image(73), image(74)], [True, False, False, True, False], True, "left"),
    "first is wider": ([image(75, 8), image(76), image(77), image(78)], [True, False, False, True], False, "left"),
    "coloured air": ([residue(image(80)), image(81), image(82), residue(image(80)), image(83)], [False, True, False, False, False], True, "right"),
    "turned": ([image(90, share=0.3), image(90, share=0.3)[:, ::-1], image(91), image(92)], [False] * 4, False, "left"),
}


@pytest.fixture(scope="module")
def facts(spark):
    rows, frames, px = [], [], []
    for name, (images, strides, loop, direction) in CASES.items():
        rows.append((name, "attack", direction, "biped", loop, 5, 6, 5, 2))
        for k, (i, stride) in enumerate(zip(images, strides)):
            frames.append((name, k, i.shape[1], i.shape[0], stride))
            px += [(name, k, x, y, *map(int, i[y, x])) for y in range(i.shape[0]) for x in range(i.shape[1])]
    rows += [("nothing", "walk", "left", "biped", True, 4, 6, 5, 2), ("lost", "walk", "left", "biped", True, 2, 6, 5, 2), ("exempt", "death", None, "biped", False, 4, 6, 5, 2), ("custom", "roll", None, None, False, 4, 6, 5, 2), ("afloat", "walk", "up", "floating", True, 4, 6, 5, 2)]
    frames += [("lost", 0, 6, 5, True), ("lost", 1, None, None, False)]
    px += [("lost", 0, x, y, 1, 1, 1, 255) for x in range(6) for y in range(5)]
    for name in ("exempt", "custom", "afloat"):
        frames += [(name, k, 6, 5, None) for k in range(4)]
        px += [(name, k, x, y, 9, 9, 9, 255 * (x > k)) for k in range(4) for x in range(6) for y in range(5)]
    overflow = spark.createDataFrame([("plain", "PASS", 6, 6), ("once", "FAIL", 0, 5)], "name string, result string, measured long, lim long")
    # Columns that have the names of those that the report makes are not read.
    tables = spark.createDataFrame(rows, ANIMATIONS).selectExpr("*", "1 AS n"), spark.createDataFrame(frames, FRAMES).selectExpr("*", "2 AS area"), spark.createDataFrame(px, PX).selectExpr("*", "3 AS v")
    out = {}
    for r in v.animation_report(*tables, "name", overflow).collect():
        out.setdefault(r["name"], []).append(r)
    return out


@pytest.mark.parametrize("name", CASES)
def test_agrees_with_the_plain_version(facts, name):
    images, strides, loop, direction = CASES[name]
    got = {r["id"]: (r["result"], r["measured"]) for r in facts[name]}
    assert len(got) == len(facts[name]) == 14
    for check, want in plain(images, strides, loop, direction, (6, 5), 5, 2).items():
        if isinstance(want, tuple):
            assert got[check][0] == want[0], check
        measured = want[1] if isinstance(want, tuple) else want
        assert got[check][1] == (None if measured is None else pytest.approx(float(measured), abs=6e-3)), check
    # Limits of an attack.
    upward = 1.3 if direction == "up" else 1.0
    for check, most in (("height_variation", 0.30 * upward), ("silhouette_variation", 0.45 * upward), ("anchor_drift", 1)):
        assert got[check][0] == ("PASS" if plain(images, strides, loop, direction, (6, 5), 5, 2)[check] <= most else "FAIL")


def test_sources_skips_and_missing_files(facts):
    by = {n: {r["id"]: r for r in rows} for n, rows in facts.items()}
    assert by["plain"]["cell_overflow"]["result"] == "PASS" and by["once"]["cell_overflow"]["measured"] == 0 and by["front"]["cell_overflow"]["skip_reason"] == "not_applicable"
    assert [(r["id"], r["result"], r["measured"]) for r in facts["nothing"]] == [("frame_count", "FAIL", 0)]
    assert sorted((r["id"], r["result"], r["measured"] is None) for r in facts["lost"]) == [("frame_count", "FAIL", True), ("frame_count", "PASS", False)]
    for name, reason in (("exempt", "action_exempt"), ("custom", "custom_action_unthresholded"), ("afloat", "action_exempt")):
        row = by[name]["height_variation"]
        assert (row["result"], row["skip_reason"], row["lim"]) == ("SKIP", reason, None) and row["measured"] is not None
    assert by["afloat"]["anchor_drift"]["lim"] == 1 and {r["severity"] for r in facts["plain"]} == {"fatal", "high", "medium", "low"}
    assert all((r["skip_reason"] is None) == (r["result"] != "SKIP") for rows in facts.values() for r in rows)


def test_empty_tables_and_mirrored_animations(spark):
    empty = [spark.createDataFrame([], schema) for schema in (ANIMATIONS, FRAMES, PX)]
    assert v.animation_report(*empty, "name").count() == 0
    got = v.derived_report(spark.createDataFrame([("walk_right", "walk", "right")], "name string, action string, direction string"), "name").collect()
    assert {r["id"] for r in got} == set(v.DERIVED_SKIPS) and {(r["result"], r["skip_reason"]) for r in got} == {("SKIP", "derived_animation")}
