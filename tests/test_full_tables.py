"""Queries cover every row of their tables."""

import os

import duckdb
import pytest

from tessella.plans.registry import QUERIES
from tests.test_queries import SF, TABLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["seam_ratio", "tile_adjacency", "terrain_corners", "tile_atlas"])
def test_every_tile(spark, sql, name):
    assert QUERIES[name](spark, SF).select("tile_id").distinct().count() == sql.execute("SELECT count(*) FROM embeddings").fetchone()[0]


def test_maps_of_every_tileset(spark):
    from tessella.plans import tile_queries as t

    cells = {(r["map"], r["x"], r["y"]): r["tile_id"] for r in t.maps(spark, SF).collect()}
    ok = {(r["direction"], r["tile_id"], o) for r in QUERIES["tile_adjacency"](spark, SF).collect() for o in r["neighbours"].split(",")}
    want = set()
    for (m, x, y), tile in cells.items():
        for direction, at in (("right", (m, x + 1, y)), ("down", (m, x, y + 1))):
            if at in cells and (direction, tile, cells[at]) not in ok:
                want.add((m, x, y, direction, tile, cells[at]))
    assert {tuple(r) for r in QUERIES["map_violations"](spark, SF).collect()} == want
    assert len({int(c[1:]) // 40 for c in cells.values()}) > 1 and all(0 <= int(c[1:]) < 500 for c in cells.values())


def test_duplicates_are_whole_frames(spark, tmp_path):
    one = [0.01 * i - 0.3 for i in range(64)]
    rows_ = [(0, 1, one), (1, 1, [*one[:63], 0.5]), (2, 1, one), (3, 2, one), (4, 1, [*one[:63], 0.5]), (5, 1, [*one[:63], None]), (6, 1, one)]
    spark.createDataFrame(rows_, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, QUERIES["duplicate_frames"](spark, str(tmp_path)).collect())) == [(1, 0, 2), (1, 0, 5), (1, 1, 3)]
