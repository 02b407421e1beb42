import numpy as np
from pyspark.sql import functions as F

from tessella.operators import jobs, tiles
from tessella.sources import exports, images
from tessella.streaming import jobs as streams


def test_png_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(i, x, y, *(int(v) for v in r.integers(0, 256, 3)), int(r.choice([0, 255]))) for i in range(3) for x in range(5) for y in range(4)]
    px = spark.createDataFrame(rows, "id long, x int, y int, r int, g int, b int, a int")
    png = images.encode_png(px, "id", 5, 4).select(F.format_string("%d.png", "id").alias("name"), F.col("png").alias("content"))
    images.write_files(png, f"file://{tmp_path}/out")
    back = images.read_pixels(spark, f"{tmp_path}/out").collect()
    got = {(int(p["path"].rsplit("/", 1)[1][0]), p["x"], p["y"]): (p["r"], p["g"], p["b"], p["a"]) for p in back}
    assert got == {(i, x, y): (a, b, c, o) if o else (0, 0, 0, 0) for i, x, y, a, b, c, o in rows}
    sizes = images.read_files(spark, f"{tmp_path}/out").collect()
    assert {(s["width"], s["height"]) for s in sizes} == {(5, 4)} and len({s["sha256"] for s in sizes}) == 3


def test_export_texts(spark):
    frames = spark.createDataFrame([("a", "walk", i, 10, True) for i in range(2)], "asset_id string, key string, frame_idx int, fps int, loop boolean")
    frames = frames.select("*", images.frame_box(F.col("frame_idx"), 2, 8, 8).alias("b")).select("*", "b.*")
    text = exports.atlas_json(frames, "t.png").collect()[0]["json"]
    assert '"frames":[{"x":0,"y":0,"w":8,"h":8},{"x":8,"y":0,"w":8,"h":8}]' in text
    assert 'region = Rect2(8, 0, 8, 8)' in exports.sprite_frames(frames, "res://t.png").collect()[0]["text"]
    cells = spark.createDataFrame([("m", x, y, f"t{(x + y) % 2}") for x in range(3) for y in range(2)], "map string, x int, y int, tile_id string")
    rows = exports.gid_rows(cells, tiles.atlas(cells))
    assert "1,2,1,\n2,1,2" in exports.tmx(rows, 16, "t.tsx").collect()[0]["text"]
    assert '"data":[1,2,1,2,1,2]' in exports.tmj(rows, 16, "t.tsx").collect()[0]["text"]
    corners = spark.sql("SELECT array('b', 'a', 'a', 'b') AS c, array('x', 'y', 'y', 'z') AS d")
    got = corners.select(exports.representative_terrain(F.col("c")).alias("c"), exports.representative_terrain(F.col("d")).alias("d")).collect()[0]
    assert (got["c"], got["d"]) == ("b", "y")


def test_streamed_states_equal_the_batch_fold(spark, tmp_path):
    events = ["START_EXECUTION", "TRANSIENT_ERROR", "PROVIDER_SUCCESS", "START_PROCESSING", "PROCESSING_DONE", "EXPORT"]
    r = np.random.default_rng(2)
    rows = [(f"j{r.integers(6)}", 1_700_000_000 + i * 60, i, events[r.integers(6)] if r.random() < 0.5 else events[i % 6]) for i in range(200)]
    all_ = spark.createDataFrame(rows, "job_id string, t long, event_id long, event string").select("job_id", F.timestamp_seconds("t").alias("ts"), "event_id", "event")
    for k in range(4):
        all_.filter(F.floor(F.col("event_id") / 50) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = streams.fold(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {}
    for x in spark.sql("SELECT * FROM folded ORDER BY last").collect():
        got[x["job_id"]] = (x["status"], x["attempts"], x["rounds"], x["illegal"])
    want = {x["job_id"]: (x["status"], x["attempts"], x["rounds"], x["illegal"]) for x in jobs.fold(all_, "job_id", ["ts", "event_id"], "event").collect()}
    assert got == want and any(w[3] for w in want.values())
