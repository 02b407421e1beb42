"""Images in and out: pixel rows from image files, PNG bytes from pixel rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, x, y, r, g, b, a) of every pixel of the images under a path.

    Images come from Spark's image source, whose bytes are in the order blue, green, red(, alpha);
    images without alpha are opaque, grey ones have equal channels.  Files that are no images are
    left out.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    names = ("path", "width", "height", "x", "y", "r", "g", "b", "a")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w, h, n = row["width"], row["height"], row["nChannels"]
                data = np.frombuffer(row["data"], np.uint8).reshape(h * w, n).astype(np.int32)
                b, g, r = (data[:, min(i, n - 1)] for i in range(3)) if n > 1 else (data[:, 0],) * 3
                a = data[:, 3] if n == 4 else np.full(h * w, 255, np.int32)
                at = np.arange(h * w, dtype=np.int32)
                columns = [pa.array([row["origin"]] * (h * w)), *(pa.array(np.full(h * w, v, np.int32)) for v in (w, h)), *map(pa.array, (at % w, at // w, r, g, b, a))]
                yield pa.record_batch(columns, names)

    return rows.mapInArrow(run, "path string, width int, height int, x int, y int, r int, g int, b int, a int")


def read_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, size, sha256, width, height) of PNG files, from their first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    side = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(png, side(17)).alias("width"), F.when(png, side(21)).alias("height"))


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG of an array height x width x 4; transparent pixels lose their colour."""
    pixels = np.where(pixels[:, :, 3:] > 0, pixels, 0).astype(np.uint8)
    h, w = pixels.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * 4)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def encode_png(px: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """(by, png): each image's pixels (by, x, y, r, g, b, a) as PNG bytes; missing ones are clear."""

    def run(table: pa.Table) -> pa.Table:
        out = np.zeros((height, width, 4), np.uint8)
        out[table["y"].to_numpy(), table["x"].to_numpy()] = np.stack([table[c].to_numpy() for c in "rgba"], axis=1)
        return pa.table({by: table[by][:1], "png": pa.array([png_bytes(out)], pa.binary())})

    kind = px.schema[by].dataType.simpleString()
    return px.select(by, "x", "y", "r", "g", "b", "a").groupBy(by).applyInArrow(run, f"{by} {kind}, png binary")


def write_files(files: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files of a folder that all executors reach, each under a
    temporary name first, so that a task that runs twice leaves whole files."""

    def run(rows):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for row in rows:
            at = f"{base.rstrip('/')}/{row['name']}"
            with store.open_output_stream(f"{at}.part") as out:
                out.write(bytes(row["content"]))
            store.move(f"{at}.part", at)

    files.select("name", "content").foreachPartition(run)


def spritesheet(px: DataFrame, cols: int, width: int, height: int) -> DataFrame:
    """Frames (frame_idx, x, y, ...) side by side in rows of ``cols``."""
    at = F.col("frame_idx")
    return px.withColumns({"x": F.col("x") + at % cols * width, "y": F.col("y") + F.floor(at / cols).cast("int") * height})


def frame_box(index: F.Column, cols: int, width: int, height: int) -> F.Column:
    """struct<left, top, right, bottom> of a frame in a sheet."""
    x, y = index % cols * width, F.floor(index / cols).cast("int") * height
    return F.struct(x.alias("left"), y.alias("top"), (x + width).alias("right"), (y + height).alias("bottom"))
