"""Connected components of a graph that is only ever a distributed table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow_groups import forest
from tessella.llm.store import persist

#: Parts that the edges of a node are dealt out in.
SHARES = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge; ``edges`` has long columns a and b.

    component is the smallest node that can be reached.  Rounds of large-star and small-star
    rewire the edges until each component is a star around its smallest node; their number grows
    with the logarithm of the graph.  Between steps the edges of an Arrow batch become the stars that
    they form by themselves, which takes no shuffle.  Neighbours are reduced to their minimum
    before the shuffle, and the edges of a node learn of that minimum in SHARES parts, so that those
    of a hub do not meet in a task.  Loops and repeated edges are harmless, edges with a null end are
    left out, and no edges give no rows.
    """
    now = _stars(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL"))
    while not _done(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every greater neighbour of u goes to the smallest of u and its neighbours.
        dealt = nearest.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        large = both.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SHARES)).cast("int")).join(dealt, ["u", "share"])
        large = _stars(persist(large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large"))
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        now = _stars(persist(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u > v"), "small"))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> DataFrame:
    """Written edges (u, v), v the smaller end, that connect what ``edges`` do: a star for each component
    of a batch.  Written tables have their small files read together, and so fuller batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([batch.column("u").to_numpy(), batch.column("v").to_numpy()])
            nodes, place = np.unique(ends, return_inverse=True)
            low = forest(place[: batch.num_rows], place[batch.num_rows :], len(nodes))
            some = np.flatnonzero(low != np.arange(len(nodes)))
            yield pa.record_batch([pa.array(nodes[some]), pa.array(nodes[low[some]])], ["u", "v"])

    return persist(edges.select("u", "v").mapInArrow(run, "u long, v long"), "stars")


def _done(edges: DataFrame) -> bool:
    """Whether every greater end has one smaller end only, which is no greater end itself."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    # Minimum and maximum of the nodes it points to; null for those that point to none.
    seen = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("to").isNull()).alias("pointed"))
    return seen.filter("low < high OR (low IS NOT NULL AND pointed > 0)").isEmpty()
