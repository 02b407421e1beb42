"""Tiles: seams, borders, adjacency, terrain, maps.

A tile is first reduced to what joins need: its four edge lines, the mean differences of its inner
lines, and its quadrants' sorted channels.  Pairs of tiles then cost edge data, not pixels.
``px``: tile_id, x, y, r, g, b; all tiles have one width and height.  Where it has a column tileset,
tiles are paired and numbered within their tileset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the seam ratio and the colour gap between neighbours, and of the distance
#: of a corner to its terrain.
SEAM_MAX, GAP_MAX, TERRAIN_MAX, FLOOR = 3.0, 28.0, 12.0, 1.0
#: Directions that joint colours are projected on, each divided by its L1 norm.
PROJECTIONS = [(1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]
AXES = (("horizontal", "x", "y"), ("vertical", "y", "x"))


def edges(px: DataFrame) -> DataFrame:
    """(tile_id, axis, first, last, inner): the first and last line across the axis as channel
    arrays in order, and the mean absolute differences of adjacent lines."""
    out = None
    keys = [*(["tileset"] if "tileset" in px.columns else []), "tile_id"]
    for axis, along, across in AXES:
        line = px.groupBy(*keys, F.col(along).alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col(across), "r", "g", "b"))).alias("cells"))
        flat = F.flatten(F.transform("cells", lambda c: F.array(c["r"], c["g"], c["b"])))
        w = Window.partitionBy("tile_id").orderBy("i")
        diff = F.aggregate(F.zip_with("line", "before", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda a, x: a + x) / F.size("line")
        rows = line.withColumn("line", flat).withColumn("before", F.lag("line").over(w)).withColumn("diff", F.when(F.col("before").isNotNull(), diff))
        one = rows.groupBy(*keys).agg(
            F.min(F.struct("i", "line"))["line"].alias("first"), F.max(F.struct("i", "line"))["line"].alias("last"), F.array_sort(F.array_compact(F.collect_list("diff"))).alias("inner")
        ).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out.select(*keys, "axis", "first", "last", "inner")


def _median(values: Column) -> Column:
    n = F.size(values)
    s = F.array_sort(values)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def _pair_measures(first: str, last: str, inner_a: str, inner_b: str) -> dict[str, Column]:
    a, b = F.col(last), F.col(first)
    seam = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda t, x: t + x) / F.size(a)
    channel = lambda v, c: F.aggregate(F.filter(v, lambda _, i: i % 3 == c), F.lit(0).cast("long"), lambda t, x: t + x)
    gap = F.greatest(*(F.abs(channel(a, c) - channel(b, c)) / (F.size(a) / 3) for c in range(3)))
    return {"seam_ratio": seam / F.greatest(_median(F.concat(inner_a, inner_b)), F.lit(FLOOR)), "color_gap": gap}


def seams(edge: DataFrame) -> DataFrame:
    """(tile_id, axis, seam_ratio, color_gap) of each tile against itself."""
    return edge.withColumns(_pair_measures("first", "last", "inner", "inner")).select("tile_id", "axis", "seam_ratio", "color_gap")


def pair_measures(edge: DataFrame, block: int = 64) -> DataFrame:
    """(axis, src, dst, seam_ratio, color_gap) of every ordered pair of tiles, self-pairs included.

    A tileset compares all with all by its nature.  Tiles are dealt into blocks and blocks are
    joined by key, so that each task has two blocks' edges and the pairs spread over all tasks.
    Tilesets are joined by themselves: the pairs grow with their number, not with its square.
    """
    if "tileset" in edge.columns:
        a = edge.select("tileset", "axis", F.col("tile_id").alias("src"), "last", F.col("inner").alias("inner_a"))
        pairs = a.join(edge.select("tileset", "axis", F.col("tile_id").alias("dst"), "first", F.col("inner").alias("inner_b")), ["tileset", "axis"])
        return pairs.withColumns(_pair_measures("first", "last", "inner_a", "inner_b")).select("axis", "src", "dst", "seam_ratio", "color_gap")
    ids = edge.select("tile_id").distinct().count()
    blocks = max(1, -(-ids // block))
    own = edge.withColumn("own", F.pmod(F.xxhash64("tile_id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    a = own.select("axis", F.col("tile_id").alias("src"), F.col("last"), F.col("inner").alias("inner_a"), F.col("own").alias("x"), other.alias("y"))
    b = own.select("axis", F.col("tile_id").alias("dst"), F.col("first"), F.col("inner").alias("inner_b"), F.col("own").alias("y"), other.alias("x"))
    pairs = a.join(b, ["axis", "x", "y"])
    return pairs.withColumns(_pair_measures("first", "last", "inner_a", "inner_b")).select("axis", "src", "dst", "seam_ratio", "color_gap")


def adjacency(measures: DataFrame, seam_max: float = SEAM_MAX, gap_max: float = GAP_MAX) -> DataFrame:
    """(direction, tile_id, neighbours): what may stand right of and below each tile, and, by turning
    these around, left of and above it; neighbours are sorted, none gives an empty array."""
    ok = measures.filter((F.col("seam_ratio") <= seam_max) & (F.col("color_gap") <= gap_max))
    way = lambda h, v: F.when(F.col("axis") == "horizontal", h).otherwise(v)
    ahead = ok.select(way("right", "down").alias("direction"), F.col("src").alias("tile_id"), F.col("dst").alias("other"))
    back = ok.select(way("left", "up").alias("direction"), F.col("dst").alias("tile_id"), F.col("src").alias("other"))
    found = ahead.unionByName(back).groupBy("direction", "tile_id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    every = measures.select(F.col("src").alias("tile_id")).distinct().withColumn("direction", F.explode(F.array(*map(F.lit, ("right", "down", "left", "up")))))
    return every.join(found, ["direction", "tile_id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(found.schema["neighbours"].dataType)))


def border_deviation(px: DataFrame, width: int, height: int, ring: int = 1) -> DataFrame:
    """Largest channel difference between the outer ring and the centre, in units of the tile's
    grain (the median difference of neighbouring pixels, one at least)."""
    on = (F.col("x") < ring) | (F.col("x") >= width - ring) | (F.col("y") < ring) | (F.col("y") >= height - ring)
    inside = (F.col("x") >= width // 4) & (F.col("x") < width - width // 4) & (F.col("y") >= height // 4) & (F.col("y") < height - height // 4)
    right = Window.partitionBy("tile_id", "y").orderBy("x")
    below = Window.partitionBy("tile_id", "x").orderBy("y")
    steps = px.select("tile_id", *(F.abs(F.col(c) - F.lag(c).over(w)).alias(f"{c}{i}") for c in "rgb" for i, w in enumerate((right, below))))
    grain = steps.select("tile_id", F.explode(F.array(*(F.struct(*(F.col(f"{c}{i}").alias(c) for c in "rgb")) for i in (0, 1)))).alias("d"))
    grain = grain.filter("d.r IS NOT NULL").groupBy("tile_id").agg(*(F.greatest(F.median(f"d.{c}"), F.lit(FLOOR)).alias(f"g{c}") for c in "rgb"))
    mean = px.groupBy("tile_id").agg(*(F.abs(F.avg(F.when(on, F.col(c))) - F.avg(F.when(inside, F.col(c)))).alias(f"d{c}") for c in "rgb"))
    return mean.join(grain, "tile_id").select("tile_id", F.greatest(*(F.col(f"d{c}") / F.col(f"g{c}") for c in "rgb")).alias("border_deviation"))


def quadrants(px: DataFrame, width: int, height: int) -> DataFrame:
    """(tile_id, corner, marks): for each corner the three sorted channels and the sorted
    projections of its colours, in units of one sixth so that they are whole numbers."""
    corner = F.concat(F.when(F.col("y") < height // 2, "top_").otherwise("bottom_"), F.when(F.col("x") < width // 2, "left").otherwise("right"))
    views = [F.col(c) * 6 for c in "rgb"]
    for p in PROJECTIONS:
        norm = sum(map(abs, p))
        views.append((F.col("r") * p[0] + F.col("g") * p[1] + F.col("b") * p[2]) * (6 // norm))
    rows = px.select("tile_id", corner.alias("corner"), *(v.cast("long").alias(f"v{i}") for i, v in enumerate(views)))
    return rows.groupBy("tile_id", "corner").agg(F.array(*(F.array_sort(F.collect_list(f"v{i}")) for i in range(len(views)))).alias("marks"))


def _quadrant_distance() -> Column:
    """Distance of the marks of a quadrant to those of a base: the mean over the channels, or the worst projection."""
    gap = lambda i: F.aggregate(F.zip_with(F.col("marks")[i], F.col("base")[i], lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda t, x: t + x)
    size = F.size(F.col("marks")[0])
    margin = (gap(0) + gap(1) + gap(2)) / (size * 18)
    joint = F.greatest(*(gap(i) / (size * 6) for i in range(3, 13)))
    return F.bround(F.greatest(margin, joint), 6)


def terrain_corners(quads: DataFrame, bases: DataFrame, distance_max: float = TERRAIN_MAX) -> DataFrame:
    """(tile_id, corner, terrain, distance): the nearest base terrain of each corner, by name among
    equals; null beyond distance_max.  ``bases``: tile_id, terrain; more than 256 are an error."""
    if bases.limit(257).count() > 256:
        raise ValueError("more than 256 base terrains")
    base = F.broadcast(bases)
    known = quads.join(base, "tile_id").select("corner", "terrain", F.col("marks").alias("base"))
    near = quads.join(F.broadcast(known), "corner").withColumn("distance", _quadrant_distance())
    best = near.groupBy("tile_id", "corner").agg(F.min(F.struct("distance", "terrain")).alias("n"))
    return best.select("tile_id", "corner", F.when(F.col("n.distance") <= distance_max, F.col("n.terrain")).alias("terrain"), F.col("n.distance").alias("distance"))


def map_violations(cells: DataFrame, allowed: DataFrame) -> DataFrame:
    """Neighbouring cells of maps that the adjacency does not allow: map, x, y, direction, tile_id,
    other.  ``cells``: map, x, y, tile_id; ``allowed``: direction, tile_id, neighbours."""
    pairs = None
    for direction, order, across in (("right", "x", "y"), ("down", "y", "x")):
        w = Window.partitionBy("map", across).orderBy(order)
        one = cells.withColumns({"other": F.lead("tile_id").over(w), "at": F.lead(order).over(w)})
        one = one.filter(F.col("at") == F.col(order) + 1).select("map", "x", "y", F.lit(direction).alias("direction"), "tile_id", "other")
        pairs = one if pairs is None else pairs.unionByName(one)
    ok = allowed.select("direction", "tile_id", F.explode("neighbours").alias("other"))
    return pairs.join(ok, ["direction", "tile_id", "other"], "left_anti")


def atlas(tiles: DataFrame) -> DataFrame:
    """Place of each tile in a near-square atlas in the order of tile_id: col, row, columns, gid."""
    # A window without partitions sees one row a tile; a tileset is one file in the end.
    by = ["tileset"] if "tileset" in tiles.columns else []
    place = F.row_number().over(Window.partitionBy(*by).orderBy("tile_id")) - 1
    columns = F.ceil(F.sqrt(F.count(F.lit(1)).over(Window.partitionBy(*by)).cast("double"))).cast("int")
    rows = tiles.select(*by, "tile_id").distinct().withColumns({"i": place, "columns": columns})
    return rows.select(*by, "tile_id", (F.col("i") % F.col("columns")).alias("col"), F.floor(F.col("i") / F.col("columns")).cast("int").alias("row"), "columns", (F.col("i") + 1).alias("gid"))


def transposed(allowed: DataFrame) -> DataFrame:
    """Adjacency turned around: left from right, up from down; tiles without neighbours stay."""
    back = {"right": "left", "left": "right", "down": "up", "up": "down"}
    way = F.coalesce(*(F.when(F.col("direction") == a, b) for a, b in back.items()))
    turned = allowed.select(way.alias("direction"), F.explode("neighbours").alias("tile_id"), F.col("tile_id").alias("other"))
    found = turned.groupBy("direction", "tile_id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    every = allowed.select(way.alias("direction"), "tile_id")
    return every.join(found, ["direction", "tile_id"], "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(found.schema["neighbours"].dataType)))


def generate_maps(seeds: DataFrame, allowed: dict[str, dict[str, list[str]]], width: int, height: int, weights: dict[str, float] | None = None, tries: int = 8) -> DataFrame:
    """(map, x, y, tile_id): for each seed (columns map, seed) a map that the adjacency allows.

    A cell of fewest options is decided at random, what follows for its neighbours is carried on, and
    a contradiction starts the map over with another stream of chance; after ``tries`` the map has
    no rows.  Maps are made apart from each other, in as many tasks as ``seeds`` has partitions.
    """
    import random

    names = sorted(allowed["right"])
    bit = {n: 1 << i for i, n in enumerate(names)}
    ahead = {d: {bit[a]: sum(bit[b] for b in allowed[d].get(a, ()) if b in bit) for a in names} for d in ("right", "down")}
    behind = {d: {bit[b]: sum(bit[a] for a in names if ahead[d][bit[a]] & bit[b]) for b in names} for d in ("right", "down")}
    steps = ((1, 0, ahead["right"]), (-1, 0, behind["right"]), (0, 1, ahead["down"]), (0, -1, behind["down"]))

    def reach(options: int, table: dict[int, int]) -> int:
        out = 0
        for b in table:
            if options & b:
                out |= table[b]
        return out

    def solve(chance: random.Random) -> list[int] | None:
        grid = [(1 << len(names)) - 1] * (width * height)

        def carry(queue: list[int]) -> bool:
            while queue:
                at = queue.pop()
                for dx, dy, table in steps:
                    x, y = at % width + dx, at // width + dy
                    if 0 <= x < width and 0 <= y < height:
                        new = grid[y * width + x] & reach(grid[at], table)
                        if not new:
                            return False
                        if new != grid[y * width + x]:
                            grid[y * width + x] = new
                            queue.append(y * width + x)
            return True

        if not carry(list(range(width * height))):
            return None
        while open_ := [(g.bit_count(), i) for i, g in enumerate(grid) if g.bit_count() > 1]:
            least = min(open_)[0]
            at = chance.choice([i for n, i in open_ if n == least])
            options = [n for n in names if grid[at] & bit[n]]
            mass = [(weights or {}).get(n, 1.0) for n in options]
            grid[at] = bit[chance.choices(options, mass if sum(mass) > 0 else None)[0]]
            if not carry([at]):
                return None
        return grid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, seed in zip(batch.column("map").to_pylist(), batch.column("seed").to_pylist(), strict=True):
                for attempt in range(tries):
                    grid = solve(random.Random(f"{seed}:{attempt}"))
                    if grid:
                        rows += [(name, i % width, i // width, names[g.bit_length() - 1]) for i, g in enumerate(grid)]
                        break
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["map", "x", "y", "tile_id"])

    return seeds.select(F.col("map").cast("string").alias("map"), F.col("seed").cast("string").alias("seed")).mapInArrow(run, "map string, x int, y int, tile_id string")


def by_gid(atlas: DataFrame, gids: DataFrame) -> DataFrame:
    """(tileset, gid, tile_id) of ``gids`` (tileset, gid): the inverse of an atlas's numbering, from
    the places of tiles alone; null for numbers that no tile has."""
    own = atlas.select("tileset", (F.col("row") * F.col("columns") + F.col("col") + 1).alias("gid"), "tile_id")
    return gids.join(own, ["tileset", "gid"], "left")


def dangling(allowed: DataFrame, tiles: DataFrame) -> DataFrame:
    """(direction, tile_id, other): neighbours that an adjacency names and that are not tiles."""
    named = allowed.select("direction", "tile_id", F.explode("neighbours").alias("other"))
    return named.join(tiles.select(F.col("tile_id").alias("other")), "other", "left_anti").select("direction", "tile_id", "other")


#: The corners of a tile in their order.
CORNERS = ("top_left", "top_right", "bottom_left", "bottom_right")


def peering_bits(corners: DataFrame, by: list[str]) -> DataFrame:
    """For each tile whose four corners are known, its terrain and the number of every corner's terrain
    among the names of its tileset: terrain, top_left, top_right, bottom_left, bottom_right, names.

    ``corners``: the key columns of a tileset, tile_id, corner, terrain.  The tile's own terrain is the
    commonest of its corners, the first of them among equals.  A tile with an unknown corner has
    null numbers; its terrains do not count among the names.
    """
    one = corners.groupBy(*by, "tile_id").agg(*(F.max(F.when(F.col("corner") == c, F.col("terrain"))).alias(c) for c in CORNERS))
    known = F.lit(True)
    for c in CORNERS:
        known &= F.col(c).isNotNull()
    one = one.withColumn("all", F.when(known, F.array(*CORNERS)))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("all"))))
    listed = one.groupBy(*by).agg(names.alias("names"))
    rows = one.join(listed, by)
    number = lambda c: F.when(known, F.array_position("names", c) - 1).cast("int")
    count = lambda c: F.size(F.filter("all", lambda o: o == c))
    best = F.array_min(F.transform("all", lambda c, i: F.struct((-count(c)).alias("n"), i.alias("i"), c.alias("c"))))["c"]
    return rows.select(*by, "tile_id", number(best).alias("terrain"), *(number(F.col(c)).alias(c) for c in CORNERS), "names")
