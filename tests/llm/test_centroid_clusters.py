import hashlib
import os
from math import floor

import numpy as np
import pytest

from tessella.llm import centroid_clusters as cc


def plain(rows, k, rounds, size):
    kept = [(i, [floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and None not in v and np.isfinite(v).all()]
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    best = [nearest(v) for _, v in kept]
    each = [sum(d for d, o in best if o == c) for c in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(str((i, c, d, each[c], sum(each), sha[c])) for (i, _), (d, c) in zip(kept, best, strict=True))


@pytest.mark.parametrize(("k", "n", "spread"), [(23, 400, 0.3), (23, 400, 0.004), (40, 30, 0.3), (7, 200, 0.0)])
def test_against_a_scan_of_all_centroids(spark, monkeypatch, k, n, spread):
    monkeypatch.setattr(cc, "GROUP", 5)
    monkeypatch.setattr(cc, "ROWS", 64)
    r = np.random.default_rng(k + n)
    base = r.normal(size=(12, 4))
    rows = [(int(i), (base[r.integers(12)] + spread * r.normal(size=4)).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None, 0.0, 0.0]), (n + 2, [float("nan")] * 4), (n + 3, [float("inf"), 0.0, 0.0, 0.0]), (n + 4, []), (n + 5, [1.0] * 5), (n + 6, [0.0] * 4), rows[0], rows[0], (None, rows[1][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS v", "3 AS upper")
    got = sorted(str(tuple(x)) for x in cc.clusters(table, k=k, size=4).collect())
    assert got == plain(rows, k, 5, 4)


def test_bounds_hold_and_filters_work():
    """Bounds never lie, and spare most vectors a scan on clustered ones."""
    r = np.random.default_rng(3)
    base = r.integers(-200, 200, (20, 8))
    x = (base[r.integers(20, size=3000)] + r.integers(-9, 10, (3000, 8))).astype(float)
    old = x[r.choice(3000, 20, replace=False)].astype(np.int64)
    groups = cc.grouped(old)
    state, scanned = cc.Round(old, None, groups).scan(x), []
    for _ in range(6):
        new = np.array([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else old[c] for c in range(20)]).astype(np.int64)
        step = cc.Round(new, old, groups)
        before = state[2].copy()
        state, old = step.assign(x, *state), new
        d = cc.squares(x, new.astype(float))
        assert (state[0] == d.argmin(1)).all()
        own = np.sqrt(d[np.arange(3000), state[0]])
        d[np.arange(3000), state[0]] = np.inf
        for g, members in enumerate(step.members):
            assert (state[2][:, g] <= np.sqrt(d[:, members].min(1)) + 1e-6).all()
        assert (state[1] >= own - 1e-6).all()
        scanned.append((state[2] != before - np.array([step.drift[m].max() for m in step.members])).mean())
    assert scanned[-1] < 0.5


def test_no_vectors_and_too_large_ones(spark):
    schema = "vec_id long, embedding array<double>"
    assert cc.clusters(spark.createDataFrame([(1, [0.5])], schema)).count() == 0
    with pytest.raises(Exception, match="not handled"):
        cc.clusters(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 0.0])], schema), k=1, size=2).collect()


def test_one_table_is_left(spark):
    from tessella.llm.store import shared_dir

    folder = f"{shared_dir(spark)}/tessella"
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert cc.clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, size=2).count() == 50
    assert len(set(os.listdir(folder)) - before) == 1
