"""Spill and residue against plain versions over whole images."""

import numpy as np
import pytest

from tessella.operators import keying

SIZE = (7, 6)


def images():
    r = np.random.default_rng(4)
    out = {k: np.dstack([r.integers(0, 256, (6, 7, 3)), (r.random((6, 7)) < 0.8) * 255]) for k in range(5)}
    out[5] = np.dstack([np.full((6, 7, 3), (10, 200, 10)), np.full((6, 7), 255)])  # nothing to take off
    out[5][0, 0] = (9, 8, 7, 0)
    out[6] = np.dstack([np.full((6, 7, 3), (250, 0, 240)), np.full((6, 7), 255)])  # opaque up to the border
    out[7] = np.dstack([np.full((6, 7, 3), (250, 0, 240)), np.zeros((6, 7), int)])  # nothing opaque
    return out


def plain(i, key, strength, reach, edge_only):
    high = [c for c in range(3) if key[c] >= 128]
    low = [c for c in range(3) if key[c] < 128]
    if not high or not low:
        return i
    opaque, (h, w) = i[..., 3] > 0, i.shape[:2]
    amount = np.maximum(i[..., high].min(-1) - i[..., low].max(-1), 0)
    pad = np.pad(opaque, reach)
    inside = np.array([[pad[y : y + 2 * reach + 1, x : x + 2 * reach + 1].all() for x in range(w)] for y in range(h)])
    hit = opaque & (amount > 0) & (~inside if edge_only and reach > 0 else True)
    if not hit.any():
        return i
    out = i.copy()
    for c in high:
        out[..., c] = np.where(hit, np.maximum(i[..., c] - (amount * strength).astype(int), 0), i[..., c])
    out[~opaque, :3] = 0
    return out


@pytest.fixture(scope="module")
def px(spark):
    rows = [(k, x, y, *map(int, i[y, x]), "kept") for k, i in images().items() for y in range(6) for x in range(7)]
    return spark.createDataFrame(rows, "k int, x int, y int, r int, g int, b int, a int, edge string")


def read(df):
    return {(r["k"], r["x"], r["y"]): tuple(r[c] for c in "rgba") for r in df.collect()}


@pytest.mark.parametrize("key,strength,reach,edge_only", [((255, 0, 255), 1.0, 2, True), ((255, 0, 255), 0.5, 1, True), ((0, 255, 0), 0.7, 1, True), ((0, 255, 255), 1.0, 2, False), ((255, 0, 255), 1.0, 0, True), ((0, 0, 0), 1.0, 2, True)])
def test_spill_of_edges(px, key, strength, reach, edge_only):
    out = keying.defringed(px, ["k"], key, *SIZE, strength, reach, edge_only)
    assert out.columns == px.columns and out.filter("edge = 'kept'").count() == px.count()
    want = {(k, x, y): tuple(map(int, p[y, x])) for k, i in images().items() for p in [plain(i, key, strength, reach, edge_only)] for y in range(6) for x in range(7)}
    assert read(out) == want


def test_residue_becomes_transparent(px):
    out = keying.without_residue(px, (255, 0, 255), 90.0)
    near = lambda p: p[3] > 0 and sum((int(a) - b) ** 2 for a, b in zip(p, (255, 0, 255))) ** 0.5 <= 90
    assert out.columns == px.columns
    assert read(out) == {(k, x, y): (0, 0, 0, 0) if near(i[y, x]) else tuple(map(int, i[y, x])) for k, i in images().items() for y in range(6) for x in range(7)}


def test_empty(px):
    assert keying.defringed(px.limit(0), ["k"], (255, 0, 255), *SIZE).count() == 0
    assert keying.without_residue(px.limit(0), (255, 0, 255)).count() == 0
