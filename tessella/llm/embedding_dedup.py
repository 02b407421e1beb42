"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with a cosine of at least c lie at most r = sqrt(2 - 2c) apart.  Pivots partition the
vectors: each lives in the cell of its nearest pivot.  If y within r of x lives in another cell, x is
within r of that cell's border, which the triangle inequality (and, closer still, the distance to
the plane between the two pivots) tells from x's distances to the pivots alone; x is replicated
there.  Cells are then joined independently of each other.

Vectors of one label and length are a group.  A group of n has log2(n) + n / 4096 pivots of its own, so
cells keep their size as it grows.  Equal vectors are one row with a weight.  A cell is compared
block by block, and a pair of blocks gives sums of weights and a spanning forest of its links, never
the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrow_groups import forest, runs
from tessella.llm.components import connected_components
from tessella.llm.store import looked_up, persist

#: Vectors that a cell should have in large groups, and those of a cell that are compared at once.
CELL, BLOCK = 4096, 1024
#: About how many vectors of a group find their cells in one go, and meet a block in one go.
SHARE, PART = 8192, 32_768


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; null for vectors that link with nothing."""
    for batch in batches:
        out: list[bytes | None] = []
        for v in batch.column("embedding").to_pylist():
            x = None if v is None or None in v or not v else np.array(v, np.float64)
            top = np.abs(x).max() if x is not None else 0.0
            if x is None or not np.isfinite(x).all() or top == 0:
                out.append(None)
                continue
            x = x / top
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "unit"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values)).reshape(len(values), -1)


def _groups(classes: DataFrame) -> DataFrame:
    """How many vectors (twice, n and many), pivots, shares and parts each label and length has."""
    n = F.col("n")
    groups = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    return persist(
        groups.select(
            "label", "size", "n", n.alias("many"), F.ceil(F.log2(n + 1) + n / CELL).alias("pivots"),
            F.ceil(n / SHARE).cast("int").alias("shares"), F.ceil(n / PART).cast("int").alias("parts"),
        ), "groups",
    )


def _pivots(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, size, unit, pivot, shares): the drawn pivots of each group, numbered from 0.

    Few more rows than pivots are sorted: those whose hash is among about the smallest four for each
    pivot.
    """
    drawn = F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53))
    some = looked_up(classes, groups, ["label", "size"], "n").withColumn("drawn", drawn)
    some = some.filter(F.col("drawn") * F.col("many") < 4 * F.col("pivots"))
    place = F.row_number().over(Window.partitionBy("label", "size").orderBy("drawn", "id")) - 1
    return some.withColumn("pivot", place).filter("pivot < pivots").select("label", "size", "unit", "pivot", "shares")


def _dealt(classes: DataFrame, groups: DataFrame, radius: float) -> DataFrame:
    """(label, size, id, weight, unit, cell, near): the cell of each vector and, where the border is
    near, cells of lower number, so that two cells meet in the lower one only.

    The vectors of a group are dealt out in shares, each with all pivots of the group.
    """
    by = ["label", "size", "share"]
    nothing = F.lit(None)
    rows = looked_up(classes, groups, by[:2], "n").withColumn("share", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shares")).cast("int"))
    rows = rows.select(*by, "id", "weight", "unit", nothing.cast("int").alias("pivot"))
    pivots = _pivots(classes, groups).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    pivots = pivots.select(*by, nothing.cast("long").alias("id"), nothing.cast("long").alias("weight"), "unit", "pivot")
    both = rows.unionByName(pivots).repartition(*by).sortWithinPartitions(*by, F.col("pivot").asc_nulls_last())
    slack = radius + 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, tuple(by)):
            known = group.num_rows - group["pivot"].null_count
            x = _matrix(group["unit"])
            p = x[:known] if known else np.zeros((1, x.shape[1]))
            inner = (p * p).sum(1)
            step = max(1, (1 << 20) // len(p))
            for at in range(known, len(x), step):
                mine = x[at : at + step]
                far = np.maximum(0, (mine * mine).sum(1)[:, None] + inner - 2 * mine @ p.T)
                home = far.argmin(axis=1)
                near = far[np.arange(len(mine)), home][:, None]
                apart = np.sqrt(np.maximum(0, inner[home][:, None] + inner - 2 * p[home] @ p.T))
                there = np.sqrt(far) - np.sqrt(near) <= 2 * slack
                there &= (far - near <= 2 * apart * slack + 1e-12) & (np.arange(len(p)) < home[:, None])
                others = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *there.sum(axis=1)]), pa.int32()), pa.array(np.nonzero(there)[1], pa.int32()))
                part = group.select(["label", "size", "id", "weight", "unit"]).slice(at, len(mine)).combine_chunks()
                columns = [c.chunk(0) for c in part.columns]
                yield pa.record_batch([*columns, pa.array(home, pa.int32()), others], [*part.schema.names, "cell", "near"])

    schema = f"label {classes.schema['label'].dataType.simpleString()}, size int, id long, weight long, unit binary, cell int, near array<int>"
    return persist(both.mapInArrow(run, schema), "cells")


def _met(ids: np.ndarray, weight: np.ndarray, unit: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> pa.RecordBatch:
    """(id, links, root): for each row that is linked across ``left`` and ``right`` the weight it is
    linked with and a row it is connected with; pairs inside ``left`` count once if both are the same."""
    linked = unit[left] @ unit[right].T >= cosine
    linked &= ids[left][:, None] != ids[right]
    links = np.zeros(len(ids), np.int64)
    links[left] += linked @ weight[right]
    if left is not right:
        links[right] += linked.T @ weight[left]
    some = np.flatnonzero(links)
    a, b = np.nonzero(linked)
    low = forest(np.searchsorted(some, left[a]), np.searchsorted(some, right[b]), len(some))
    return pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[some[low]])], ["id", "links", "root"])


def _joined(cells: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root), as ``_met`` gives them, of all pairs that meet in a cell.

    The vectors at home in a cell are blocks.  Each block meets itself, the cell's lower blocks and the
    vectors replicated to the cell; these come in parts, so that a task holds a block and a part.
    """
    by, keys = ["label", "size", "cell"], ["label", "size", "cell", "block", "part"]
    homes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    homes = persist(homes.join(groups.select("label", "size", "parts"), by[:2]), "blocks")
    columns = [*by, "blocks", "parts", "id", "weight", "unit"]
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int")
    home = looked_up(cells, homes, by, "n").select(*columns).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    base = home.withColumns({"block": F.col("own"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "base": F.lit(True)})
    lower = home.filter("own + 1 < blocks").withColumn("block", F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)))
    foreign = cells.withColumn("cell", F.explode("near")).join(homes, by).select(*columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    kept = [*keys, "base", "id", "weight", "unit"]
    rows = base.select(*kept)
    for other in (lower, foreign):
        rows = rows.unionByName(other.withColumns({"part": part, "base": F.lit(False)}).select(*kept))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.desc("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, tuple(keys)):
            ids, weight, unit = group["id"].to_numpy(), group["weight"].to_numpy(), _matrix(group["unit"])
            own = np.arange(np.count_nonzero(group["base"].to_numpy()))
            if group["part"][0].as_py() == 0:
                yield _met(ids, weight, unit, own, own, cosine)
            for at in range(len(own), len(ids), BLOCK):
                yield _met(ids, weight, unit, own, np.arange(at, min(at + BLOCK, len(ids))), cosine)

    return rows.mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null, their vectors have one length and the
    cosine, in double precision, is at least ``cosine``.  n_links counts the other rows that a row is
    linked with, component_id is the smallest vec_id that links reach.

    Null, empty and zero vectors, those with null or non-finite components, and rows with a null
    label or vec_id link with nothing; with a null vec_id, component_id is null and kept is true.
    Repeated rows count as others of each other.  An empty table gives no rows.  Other columns are
    not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = rows.schema["label"].dataType.simpleString()
    units = rows.mapInArrow(_units, f"vec_id long, label {kind}, unit binary")
    units = persist(units.withColumn("digest", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.md5("unit"))), "units")
    some = units.filter(F.col("digest").isNotNull())
    classes = some.groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit"))
    classes = persist(classes.withColumn("size", F.length("unit").cast("int")), "classes")
    groups = _groups(classes)
    found = persist(_joined(_dealt(classes, groups, float(np.sqrt(2 - 2 * cosine))), groups, cosine), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    of_class = classes.select("label", "digest", "id", "weight").join(links, "id", "left").join(component, "id", "left")
    of_class = of_class.select(
        "label", "digest", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"),
    )
    linked = looked_up(some.select("vec_id", "label", "digest"), persist(of_class, "decided"), ["label", "digest"], "weight")
    alone = units.filter(F.col("digest").isNull()).select("vec_id", F.lit(0).alias("links"), F.lit(None).cast("long").alias("component"))
    out = linked.select("vec_id", "links", "component").unionByName(alone)
    reached = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), reached.alias("component_id"),
        F.coalesce(F.col("vec_id") == reached, F.lit(True)).alias("kept"),
    )
