"""Clusters around centroids over whole numbers, with the bounds of Yinyang k-means.

The centroids are put into groups once.  Every vector keeps an upper bound of the distance to its own
centroid and, for each group, a lower bound of the distance to any other centroid of the group.
After a round the bounds move by what the centroids moved.  A vector whose upper bound is below all
its lower bounds keeps its cluster (global filter); else the groups whose lower bound it is not
below are scanned exactly (group filter).  Bounds are used with a margin, distances are exact, so the
result is that of a scan of all centroids, ties to the smaller number included.

A round reads the table of vectors and bounds and writes the next one; the table before is deleted.
Only centroids and sums over clusters, which are bounded by their number, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import drop, persist

#: Greatest size of a component: squares of distances between such vectors are whole in doubles.
LARGEST = 1 << 20
#: Centroids of a group, about.
GROUP = 10
#: Vectors that are worked on together in a task.
ROWS = 4096
#: Margin of the bounds, far beyond the error of a root of doubles and far below any step of distances.
MARGIN = 1e-6


def whole_vectors(embeddings: DataFrame, size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v (array of int): floor(scale * x) of each component x.

    Vectors that are null, of another size or hold null or non-finite components are left out; a
    component beyond ``LARGEST`` is an error.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.filter((F.size("e") == size) & ~F.exists("e", bad))
    # Casts of what is too large would fail or wrap; they are cut first and refused when read.
    cell = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * scale, F.lit(-2.0 * LARGEST)), F.lit(2.0 * LARGEST))), F.lit(-2 * LARGEST)), F.lit(2 * LARGEST)).cast("int")
    return rows.select("vec_id", F.transform("e", cell).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:vec_id (a null vec_id is the empty text), equal ones by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few rounds of clustering of the centroids themselves."""
    k = len(centroids)
    count = max(1, k // GROUP)
    middles = centroids[np.linspace(0, k - 1, count).astype(int)].astype(float)
    for _ in range(5):
        of = ((centroids[:, None, :] - middles[None]) ** 2).sum(2).argmin(1)
        for g in range(count):
            if (of == g).any():
                middles[g] = centroids[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c, both whole numbers in doubles."""
    return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None]


class Round:
    """Assigns vectors to new centroids, given bounds for the old ones (none: the first round)."""

    def __init__(self, new: np.ndarray, old: np.ndarray | None, groups: np.ndarray) -> None:
        self.new, self.groups = new.astype(float), groups
        self.members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
        self.drift = None if old is None else np.sqrt(((new - old).astype(float) ** 2).sum(1))

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower bounds by a scan of all centroids."""
        d = squares(x, self.new)
        own = d.argmin(1)
        upper = np.sqrt(d[np.arange(len(x)), own])
        d[np.arange(len(x)), own] = np.inf
        return own, upper, np.sqrt(np.stack([d[:, m].min(1) for m in self.members], 1))

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = own.copy()
        upper = upper + self.drift[own]
        lower = lower - np.array([self.drift[m].max() for m in self.members])
        below = lambda rows: upper[rows] + MARGIN * (1 + upper[rows])
        least = lower.min(1)
        todo = np.flatnonzero(below(slice(None)) >= least)
        upper[todo] = np.sqrt(((x[todo] - self.new[own[todo]]) ** 2).sum(1))
        todo = todo[below(todo) >= least[todo]]
        if not len(todo):
            return own, upper, lower
        before = own[todo]
        stay = ((x[todo] - self.new[before]) ** 2).sum(1)
        best, winner, reach = stay.copy(), before.copy(), below(todo)
        scans = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(reach >= lower[todo, g])
            d = squares(x[todo[rows]], self.new[members])
            scans.append((g, members, rows, d))
            at = d.argmin(1)
            here, name = d[np.arange(len(rows)), at], members[at]
            better = (here < best[rows]) | ((here == best[rows]) & (name < winner[rows]))
            best[rows[better]], winner[rows[better]] = here[better], name[better]
        moved = np.flatnonzero(winner != before)
        # The centroid that was left is one of the others of its group now, scanned or not.
        home = self.groups[before[moved]]
        lower[todo[moved], home] = np.minimum(lower[todo[moved], home], np.sqrt(stay[moved]))
        for g, members, rows, d in scans:
            d[members[None] == winner[rows][:, None]] = np.inf
            lower[todo[rows], g] = np.sqrt(d.min(1))
        own[todo], upper[todo] = winner, np.sqrt(best)
        return own, upper, lower


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"components beyond {LARGEST} are not handled")
    return x


def _round(table: DataFrame, new: np.ndarray, old: np.ndarray | None, groups: np.ndarray) -> DataFrame:
    """The vectors with cluster, upper and lower for the new centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = Round(new, old, groups)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("v"))
                if old is None:
                    own, upper, lower = step.scan(x)
                else:
                    bounds = part.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                    own, upper, lower = step.assign(x, part.column("cluster").to_numpy(), part.column("upper").to_numpy(), bounds)
                ends = np.arange(0, lower.size + 1, lower.shape[1], dtype=np.int32)
                yield pa.record_batch({
                    "vec_id": part.column("vec_id"), "v": part.column("v"), "cluster": pa.array(own.astype(np.int32)), "upper": pa.array(upper),
                    "lower": pa.ListArray.from_arrays(pa.array(ends), pa.array(lower.ravel())),
                })

    return table.mapInArrow(run, "vec_id long, v array<int>, cluster int, upper double, lower array<double>")


def _moved(table: DataFrame, old: np.ndarray) -> np.ndarray:
    """The floor of the mean of each cluster's vectors; a centroid without any stays.

    Each task adds up its vectors first; the shuffle has a row for each task, cluster and component.
    """
    k, size = old.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = part.column("cluster").to_numpy()
                np.add.at(total, own, _matrix(part.column("v")).astype(np.int64))
                n += np.bincount(own, minlength=k)
        some = np.flatnonzero(n)
        c = np.repeat(some, size)
        yield pa.record_batch({"c": pa.array(c), "i": pa.array(np.tile(np.arange(size), len(some))), "s": pa.array(total[some].ravel()), "n": pa.array(n[c])})

    sums = table.select("cluster", "v").mapInArrow(run, "c long, i long, s long, n long").groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    new = old.copy()
    for r in sums.collect():
        new[r["c"], r["i"]] = r["s"] // r["n"]
    return new


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", size: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of
    ``embeddings`` (vec_id, embedding).

    Kept are vectors of ``size`` components that are neither null nor non-finite, as whole numbers
    (:func:`whole_vectors`).  With fewer than ``k`` vectors each is a first centroid; without any
    there are no rows.  Rows that repeat, or whose vec_id is null, are vectors of their own; equal
    distances go to the smaller number.  k is a parameter and bounds all that is broadcast.  Other
    columns are not read.
    """
    vectors = whole_vectors(embeddings, size, scale)
    new, old = first_centroids(vectors, k, seed), None
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(new):
        return embeddings.sparkSession.createDataFrame([], schema)
    groups, table = grouped(new), vectors
    for done in range(rounds + 1):
        before, table = table, persist(_round(table, new, old, groups), "clusters")
        if done:
            drop(before)
        if done < rounds:
            old, new = new, _moved(table, new)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = part.column("cluster")
                d = ((_matrix(part.column("v")) - new[own.to_numpy()]) ** 2).sum(1)
                yield pa.record_batch({"vec_id": part.column("vec_id"), "cluster": own, "distance": pa.array(d.astype(np.int64))})

    rows = table.select("vec_id", "cluster", "v").mapInArrow(final, "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), ",".join(map(str, new[c].tolist()))) for c, s in inertia.items()]
    named = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, written string")
    named = named.select("cluster", "cluster_inertia", "inertia", F.sha2("written", 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
