"""The block size of enlarged pixel art, from the rhythm of its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_profile(px: DataFrame, by: list[str], axis: str) -> DataFrame:
    """(i, g): sum of absolute gray differences across each step of an axis (x or y)."""
    other = "y" if axis == "x" else "x"
    w = Window.partitionBy(*by, other).orderBy(axis)
    steps = px.withColumn("d", F.abs(F.col("gray") - F.lag("gray").over(w))).filter("d IS NOT NULL")
    return steps.groupBy(*by, F.col(axis).alias("i")).agg(F.sum("d").cast("double").alias("g"))


def autocorrelation(profile: DataFrame, by: list[str], least: int, most: int) -> DataFrame:
    """(lag, r) of each profile about its mean; lags from ``least`` to ``most``."""
    mean = profile.groupBy(*by).agg(F.avg("g").alias("m"))
    centred = profile.join(mean, by).withColumn("c", F.col("g") - F.col("m"))
    energy = centred.groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).alias("e"))
    lagged = centred.select(*by, "i", F.col("c").alias("a"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    pairs = lagged.join(centred.select(*by, F.col("i").alias("j"), F.col("c").alias("b")), [*by, "j"])
    sums = pairs.groupBy(*by, "lag").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return sums.join(energy, by).filter("e > 0").select(*by, "lag", (F.col("s") / F.col("e")).alias("r"))


def block_size(correlation: DataFrame, by: list[str]) -> DataFrame:
    """The lag of the highest strict local peak, the smallest of equal ones; none without a peak."""
    w = Window.partitionBy(*by).orderBy("lag")
    peaks = correlation.withColumns({"p": F.lag("r").over(w), "n": F.lead("r").over(w)}).filter("r > p AND r > n AND r > 0")
    return peaks.groupBy(*by).agg(F.min(F.struct((-F.col("r")).alias("r"), "lag"))["lag"].alias("block"))
