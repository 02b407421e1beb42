"""Texts of export formats, as columns: JSON atlases, tile maps, tile sets, sprite frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def atlas_json(frames: DataFrame, texture: str) -> DataFrame:
    """(asset_id, json) from asset_id, key, frame_idx, fps, loop, left, top, right, bottom."""
    box = F.struct("frame_idx", F.col("left").alias("x"), F.col("top").alias("y"), (F.col("right") - F.col("left")).alias("w"), (F.col("bottom") - F.col("top")).alias("h"))
    keys = frames.groupBy("asset_id", "key").agg(F.first("fps").alias("fps"), F.first("loop").alias("loop"), F.array_sort(F.collect_list(box)).alias("f"))
    one = F.struct("key", "fps", "loop", F.transform("f", lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["w"].alias("w"), f["h"].alias("h"))).alias("frames"))
    out = keys.groupBy("asset_id").agg(F.array_sort(F.collect_list(one)).alias("animations"))
    return out.select("asset_id", F.to_json(F.struct("asset_id", F.lit(texture).alias("texture"), "animations")).alias("json"))


def gid_rows(cells: DataFrame, atlas: DataFrame) -> DataFrame:
    """(map, width, height, gids): each map's gids row by row.  ``cells``: map, x, y, tile_id."""
    placed = cells.join(atlas.select("tile_id", "gid"), "tile_id")
    out = placed.groupBy("map").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.array_sort(F.collect_list(F.struct("y", "x", "gid"))).alias("g"))
    return out.select("map", "width", "height", F.transform("g", lambda g: g["gid"]).alias("gids"))


def tmx(rows: DataFrame, tile: int, tileset: str) -> DataFrame:
    """(map, text): XML maps with their cells as comma-separated rows."""
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.array_join(F.slice("gids", (y * F.col("width") + 1).cast("int"), F.col("width").cast("int")).cast("array<string>"), ","))
    head = F.format_string(
        '<?xml version="1.0" encoding="UTF-8"?>\n<map version="1.10" orientation="orthogonal" renderorder="right-down" width="%d" height="%d" tilewidth="%d" tileheight="%d" infinite="0">\n'
        ' <tileset firstgid="1" source="%s"/>\n <layer id="1" name="ground" width="%d" height="%d">\n  <data encoding="csv">\n',
        "width", "height", F.lit(tile), F.lit(tile), F.lit(tileset), "width", "height",
    )
    return rows.select("map", F.concat(head, F.array_join(lines, ",\n"), F.lit("\n</data>\n </layer>\n</map>\n")).alias("text"))


def tmj(rows: DataFrame, tile: int, tileset: str) -> DataFrame:
    """(map, text): JSON maps."""
    layer = F.struct(F.col("gids").alias("data"), "height", F.lit(1).alias("id"), F.lit("ground").alias("name"), F.lit("tilelayer").alias("type"), F.lit(True).alias("visible"), "width")
    sets = F.array(F.struct(F.lit(1).alias("firstgid"), F.lit(tileset).alias("source")))
    whole = F.struct("height", F.lit(False).alias("infinite"), F.array(layer).alias("layers"), F.lit("orthogonal").alias("orientation"), F.lit(tile).alias("tileheight"), sets.alias("tilesets"), F.lit(tile).alias("tilewidth"), F.lit("map").alias("type"), "width")
    return rows.select("map", F.to_json(whole).alias("text"))


def tsx(tilesets: DataFrame, texture: str, tile: int) -> DataFrame:
    """(asset_id, text): XML tile sets from asset_id, columns, rows."""
    text = F.format_string(
        '<?xml version="1.0" encoding="UTF-8"?>\n<tileset version="1.10" name="%s" tilewidth="%d" tileheight="%d" tilecount="%d" columns="%d">\n <image source="%s" width="%d" height="%d"/>\n</tileset>\n',
        "asset_id", F.lit(tile), F.lit(tile), F.col("columns") * F.col("rows"), "columns", F.lit(texture), F.col("columns") * tile, F.col("rows") * tile,
    )
    return tilesets.select("asset_id", text.alias("text"))


def sprite_frames(frames: DataFrame, texture: str) -> DataFrame:
    """(asset_id, text): sprite frame resources from the columns of :func:`atlas_json`."""
    box = F.struct("frame_idx", F.format_string("Rect2(%d, %d, %d, %d)", "left", "top", F.col("right") - F.col("left"), F.col("bottom") - F.col("top")).alias("rect"))
    keys = frames.groupBy("asset_id", "key").agg(F.first("fps").alias("fps"), F.first("loop").alias("loop"), F.array_sort(F.collect_list(box)).alias("f"))
    name = lambda i: F.format_string("%s_%02d", "key", i)
    subs = F.array_join(F.transform("f", lambda f: F.concat(F.lit('[sub_resource type="AtlasTexture" id="'), name(f["frame_idx"]), F.lit('"]\natlas = ExtResource("1")\nregion = '), f["rect"], F.lit("\n"))), "\n")
    listed = F.array_join(F.transform("f", lambda f: F.concat(F.lit('{\n"duration": 1.0,\n"texture": SubResource("'), name(f["frame_idx"]), F.lit('")\n}'))), ", ")
    anim = F.concat(F.lit('{\n"frames": ['), listed, F.format_string('],\n"loop": %s,\n"name": &"%s",\n"speed": %s\n}', F.col("loop").cast("string"), "key", F.col("fps").cast("double").cast("string")))
    each = keys.select("asset_id", "key", subs.alias("subs"), anim.alias("anim"), F.size("f").alias("n"))
    out = each.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("key", "subs", "anim"))).alias("k"), F.sum("n").alias("n"))
    head = F.format_string('[gd_resource type="SpriteFrames" load_steps=%d format=3]\n\n[ext_resource type="Texture2D" path="%s" id="1"]\n\n', F.col("n") + 2, F.lit(texture))
    body = F.concat(F.array_join(F.transform("k", lambda k: k["subs"]), "\n"), F.lit("\n[resource]\nanimations = ["), F.array_join(F.transform("k", lambda k: k["anim"]), ", "), F.lit("]\n"))
    return out.select("asset_id", F.concat(head, body).alias("text"))


def representative_terrain(corners: F.Column) -> F.Column:
    """The commonest of four corners' terrains, the first in their order among equals."""
    count = lambda c: F.size(F.filter(corners, lambda o: o == c))
    scored = F.transform(corners, lambda c, i: F.struct((-count(c)).alias("n"), i.alias("i"), c.alias("c")))
    return F.array_min(scored)["c"]


def _terrain_color(index: F.Column) -> F.Column:
    """A colour for the number of a terrain: hues that follow the golden ratio, of one saturation and value."""
    hue = (index * F.lit(0.6180339887498949)) % 1.0
    value, saturation = 0.85, 0.55
    sector = F.floor(hue * 6.0).cast("int")
    part = hue * 6.0 - sector
    low, fall, rise = F.lit(value * (1.0 - saturation)), (1.0 - part * saturation) * value, (1.0 - (1.0 - part) * saturation) * value
    top = F.lit(value)
    wheel = [(top, rise, low), (fall, top, low), (low, top, rise), (low, fall, top), (rise, low, top), (top, low, fall)]
    pick = lambda k: F.coalesce(*(F.when(sector == i, w[k]) for i, w in enumerate(wheel)))
    return F.format_string("Color(%.6f, %.6f, %.6f, 1)", pick(0), pick(1), pick(2))


def tile_set(bits: DataFrame, places: DataFrame, by: list[str], texture: str, width: int, height: int) -> DataFrame:
    """(the key columns, text, skipped): a tile set resource with terrain for each tileset, and the tiles
    whose corners are not all known, which have none.

    ``bits``: :func:`tiles.peering_bits`; ``places``: the key columns, tile_id, col, row in the atlas.
    A tileset's tiles make one text, in the order of their places.
    """
    from tessella.operators.tiles import CORNERS

    rows = places.join(bits, [*by, "tile_id"], "left")
    cell = F.format_string("%d:%d/0", "col", "row")
    lines = [F.concat(cell, F.lit(" = 0")), F.when(F.col("terrain").isNotNull(), F.concat(cell, F.lit("/terrain_set = 0"))), F.concat(cell, F.lit("/terrain = "), F.col("terrain").cast("string"))]
    lines += [F.concat(cell, F.lit(f"/terrains_peering_bit/{c}_corner = "), F.col(c).cast("string")) for c in CORNERS]
    block = F.concat_ws("\n", *lines)
    one = rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("col", "row", block.alias("block")))).alias("cells"), F.max("names").alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("terrain").isNull(), F.col("tile_id")))).alias("skipped"),
    )
    body = F.array_join(F.transform("cells", lambda c: c["block"]), "\n")
    named = F.transform("names", lambda n, i: F.concat(F.format_string('terrain_set_0/terrain_%d/name = "%s"\nterrain_set_0/terrain_%d/color = ', i, n, i), _terrain_color(i), F.lit("\n")))
    terrain = F.when(F.size("names") > 0, F.concat(F.lit("terrain_set_0/mode = 1\n"), F.array_join(named, ""))).otherwise("")
    text = F.concat(
        F.format_string(
            '[gd_resource type="TileSet" load_steps=3 format=3]\n\n[ext_resource type="Texture2D" path="%s" id="1_atlas"]\n\n[sub_resource type="TileSetAtlasSource" id="TileSetAtlasSource_000"]\n'
            'texture = ExtResource("1_atlas")\ntexture_region_size = Vector2i(%d, %d)\n', F.lit(texture), F.lit(width), F.lit(height),
        ), body, F.format_string("\n\n[resource]\ntile_size = Vector2i(%d, %d)\n", F.lit(width), F.lit(height)), terrain, F.lit('sources/0 = SubResource("TileSetAtlasSource_000")\n'),
    )
    return one.select(*by, text.alias("text"), "skipped")
