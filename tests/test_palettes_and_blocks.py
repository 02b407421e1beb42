"""Median cut and block detection against plain versions."""

import numpy as np
import pytest

from tessella.operators import blocks, palette


def cut(counts, most):
    """Boxes of colours; values of the widest channel up to the median pixel go to one side."""
    boxes = [set(counts)]
    while len(boxes) < most:
        spread = [[max(c[k] for c in box) - min(c[k] for c in box) for k in range(3)] for box in boxes]
        widest = max(map(max, spread))
        if not widest:
            break
        i = next(i for i, s in enumerate(spread) if max(s) == widest)
        k = spread[i].index(widest)
        values = sorted({c[k] for c in boxes[i]})
        total = sum(counts[c] for c in boxes[i])
        middle = next(v for v in values if 2 * sum(counts[c] for c in boxes[i] if c[k] <= v) >= total)
        if middle == values[-1]:
            middle = values[-2]
        low = {c for c in boxes[i] if c[k] <= middle}
        boxes.append(boxes[i] - low)
        boxes[i] = low
    out = {}
    for box in boxes:
        n = sum(counts[c] for c in box)
        out |= {c: tuple(sum(x[k] * counts[x] for x in box) // n for k in range(3)) for c in box}
    return out


@pytest.mark.parametrize("most", [1, 4, 16, 500])
def test_median_cut(spark, most):
    r = np.random.default_rng(most)
    groups = {"a": {}, "b": {(7, 7, 7): 3}}
    for rgb in r.integers(0, 12, (150, 3)).tolist():
        groups["a"][tuple(rgb)] = int(r.choice([1, 2, 90]))
    rows = [(k, *c, n) for k, counts in groups.items() for c, n in counts.items()]
    got = palette.median_cut(spark.createDataFrame(rows, "key string, r int, g int, b int, n long"), ["key"], most).collect()
    assert len(got) == len(rows)
    want = {k: cut(counts, most) for k, counts in groups.items()}
    assert all(want[x["key"]][x["r"], x["g"], x["b"]] == (x["entry_r"], x["entry_g"], x["entry_b"]) for x in got)


def rhythm(image, axis, least, most):
    g = np.abs(np.diff(image, axis=axis)).sum(axis=1 - axis)
    c = g - g.mean()
    if not (c * c).sum():
        return None
    found = [(c[:-lag] * c[lag:]).sum() / (c * c).sum() for lag in range(least, most + 1)]
    peaks = [(-found[i], least + i) for i in range(1, len(found) - 1) if found[i - 1] < found[i] > found[i + 1] and found[i] > 0]
    return min(peaks)[1] if peaks else None


@pytest.mark.parametrize("axis", ["x", "y"])
def test_block_size(spark, axis):
    r = np.random.default_rng(5)
    images = {f"blocks {n}": np.kron(r.integers(0, 256, (48 // n, 48 // n)), np.ones((n, n), int)) for n in (4, 6)}
    images |= {"noise": r.integers(0, 256, (48, 48)), "flat": np.full((48, 48), 9)}
    rows = [(name, x, y, int(v)) for name, image in images.items() for (y, x), v in np.ndenumerate(image)]
    px = spark.createDataFrame(rows, "asset string, x int, y int, gray int")
    found = blocks.block_size(blocks.autocorrelation(blocks.edge_profile(px, ["asset"], axis), ["asset"], 2, 16), ["asset"])
    want = {name: rhythm(image, int(axis == "x"), 2, 16) for name, image in images.items()}
    assert want["blocks 4"] == 4 and want["blocks 6"] == 6 and want["flat"] is None
    assert {x["asset"]: x["block"] for x in found.collect()} == {k: v for k, v in want.items() if v}
