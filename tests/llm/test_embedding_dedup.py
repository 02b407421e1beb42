import numpy as np
import pytest

from tessella.llm import embedding_dedup as e


def brute(rows, limit=0.93):
    ok = {i: np.array(v, float) for i, (_, v, lab) in enumerate(rows) if lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ok = {i: v / np.abs(v).max() for i, v in ok.items()}
    links = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= limit] for i in ok}
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((vec, len(links.get(i, [])), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize(("cell", "block", "share", "part"), [(4096, 1024, 8192, 32_768), (5, 4, 8192, 32_768), (5, 4, 7, 9)])
def test_against_all_pairs(spark, monkeypatch, cell, block, share, part):
    for name, value in (("CELL", cell), ("BLOCK", block), ("SHARE", share), ("PART", part)):
        monkeypatch.setattr(e, name, value)
    r = np.random.default_rng(4)
    base = r.normal(size=(8, 6))
    rows = [(int(100 - i), (base[r.integers(8)] + r.normal(size=6) * r.choice([0, 0.05, 0.2])).tolist(), int(r.integers(2))) for i in range(90)]
    rows += [(200, [0.0] * 6, 1), (201, None, 1), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (203, [float("nan")] * 6, 1), (204, rows[0][1], None), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (208, [1e300, 2e300], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS unit", "2 AS id")
    got = e.near_duplicates(docs).collect()
    assert sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in got) == brute(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert e.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted((str(x["vec_id"]), x["n_links"], x["kept"]) for x in e.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("None", 0, True)]


def test_every_group_has_its_own_pivots(spark):
    """log2(n + 1) + n / CELL of them, and every vector has a cell."""
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=4).tobytes(), i % 2 if i < 60 else 2, 1, 32) for i in range(400)]
    classes = spark.createDataFrame(rows, "id long, unit binary, label int, weight long, size int")
    groups = e._groups(classes)
    found = {x["label"]: x["count"] for x in e._pivots(classes, groups).groupBy("label").count().collect()}
    assert found == {0: 5, 1: 5, 2: 9}
    assert e._dealt(classes, groups, 0.1).count() == 400
