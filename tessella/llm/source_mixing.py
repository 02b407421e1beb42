"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal mass.  Were sources poured at once, each by its exact share,
block k of a source would begin and end at known times: it may not start before the slot of the one
and is due by that of the other.  Of the released blocks the one with the earliest deadline takes the
slot.  On one track this keeps each source less than one block away from its share at every slot.

When a source runs out, the others go on by their weights among themselves (a new phase), so every
document is placed exactly once.  The driver works out the slots of all blocks, a number for each;
documents find their block from running sums: per-task sums, then offsets over tasks.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import exclusive_offsets, free_name, persist, with_row_key

#: Blocks of a source whose slots are one row of the plan.
CHUNK = 1024
#: Code points in a block, and blocks at most: a larger corpus has larger blocks, so that the plan
#: on the driver stays within 12 bytes for each of them.
BLOCK, BLOCKS = 1 << 16, 1 << 20
#: Where target weights are not given, they follow the sources' mass to this power.
TEMPER = 0.7


def plan(blocks: list[int], weights: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The slot and the phase of every block of each source, by exact weights.

    Sources of weight 0 come after all others, in equal shares.
    """
    exact = [Fraction(w) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("weights must not be negative")
    out = [(np.empty(n, np.int64), np.empty(n, np.int32)) for n in blocks]
    first, phase = 0, 0
    for group in ([i for i, w in enumerate(exact) if w > 0], [i for i, w in enumerate(exact) if w == 0]):
        group = [i for i in group if blocks[i] > 0]
        if not group:
            continue
        unit = lcm(*(exact[i].denominator for i in group))
        w = {i: int(exact[i] * unit) or 1 for i in group}
        # Sources in the order in which they run out; before each, the blocks that are used up and the weights that go on.
        ends = sorted(group, key=lambda i: (Fraction(blocks[i], w[i]), i))
        until = [Fraction(blocks[i], w[i]) for i in ends]
        used, going, number = [0], [sum(w.values())], [0]
        for p, i in enumerate(ends):
            used.append(used[-1] + blocks[i])
            going.append(going[-1] - w[i])
            number.append(number[-1] + (p + 1 == len(ends) or until[p + 1] > until[p]))
        jobs: list[tuple[int, int, int, int]] = []
        for i in group:
            n, k, release = blocks[i], 1, 0
            out[i][1][0] = phase
            while k <= n:
                # The ends of blocks k to last are within one phase.
                p = bisect_left(until, Fraction(k, w[i]))
                last = min(n, w[i] * blocks[ends[p]] // w[ends[p]])
                base, rate, mine = used[p] * w[i], going[p], w[i]
                for j in range(k, last + 1):
                    at = base + j * rate
                    jobs.append((release, -(-at // mine), i, j - 1))
                    release = at // mine
                out[i][1][k : last + 1] = phase + number[p]
                k = last + 1
        jobs.sort()
        ready: list[tuple[int, int, int]] = []
        at, total = 0, len(jobs)
        for now in range(total):
            while at < total and jobs[at][0] <= now:
                heapq.heappush(ready, jobs[at][1:])
                at += 1
            _, i, k = heapq.heappop(ready)
            out[i][0][k] = first + now
        first, phase = first + total, phase + number[-1]
    return out


def _measured(docs: DataFrame, key: str) -> DataFrame:
    """(k, doc_id, source, part, before, mass): what a task has seen of the source before the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            masses = batch.column("mass").to_numpy()
            codes = batch.column("source").dictionary_encode()
            which, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            before = np.empty(len(masses), np.int64)
            for j, name in enumerate(names):
                mine = np.flatnonzero(which == j)
                upto = np.cumsum(masses[mine]) + seen.get(name, 0)
                before[mine], seen[name] = upto - masses[mine], int(upto[-1])
            extra = [pa.array(np.full(len(masses), part, np.int32)), pa.array(before)]
            yield pa.record_batch([*batch.columns, *extra], [*batch.schema.names, "part", "before"])

    rows = docs.select(
        F.col(key).alias("k"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.greatest(F.lit(1), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))).cast("long").alias("mass"),
    )
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, doc_id long, source string, mass long, part int, before long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, row_key: str | None = None) -> DataFrame:
    """Where every row of ``docs`` (doc_id, source, text) stands in the mixture.

    Returns doc_id, source, phase, block (of its source, from 0), slot and place: rows in the order
    of (slot, place) are the mixture.  ``row_key`` names a column to return as well.

    ``weights`` are the sources' target weights, kept exactly; sources without one have the smallest
    given each, and those of weight 0 come last.  Without weights they follow the sources' mass to the
    power TEMPER.  A row's mass is its code
    points, at least one; a row belongs to the block in which it begins, so a row longer than a block
    uses up the slots of the blocks that it covers.  A null source is the source "".  Null and empty
    texts, repeated rows and rows with a null doc_id are each placed.  An empty table gives no rows.
    Other columns are not read.
    """
    keyed, key = (docs, row_key) if row_key else with_row_key(docs)
    rows = persist(_measured(keyed, key), "masses")
    dealt = rows.groupBy("source", "part").agg(F.sum("mass").alias("n"))
    offsets = persist(exclusive_offsets(dealt, "source", "part", "n", "offset"), "offsets")
    mass = {r["source"]: r["n"] for r in offsets.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names, block = sorted(mass), max(block, -(-sum(mass.values()) // BLOCKS))
    if weights:
        least = min(weights.values())
        targets = [weights.get(x, least) for x in names]
    else:
        targets = [mass[x] ** TEMPER for x in names]
    table = plan([-(-mass[x] // block) for x in names], targets)
    pieces = [(x, at // CHUNK, slots[at : at + CHUNK], numbers[at : at + CHUNK]) for x, (slots, numbers) in zip(names, table, strict=True) for at in range(0, len(slots), CHUNK)]
    columns = [list(c) for c in zip(*pieces, strict=True)] or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
    # Twelve bytes a block, BLOCKS of them at most.
    chunks = docs.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source", "chunk", "slots", "phases"]))
    found = rows.join(offsets.select("source", "part", "offset"), ["source", "part"])
    found = found.withColumn("at", F.col("before") + F.col("offset")).withColumn("block", F.floor(F.col("at") / block).cast("long"))
    found = found.withColumn("chunk", F.floor(F.col("block") / CHUNK).cast("long")).join(F.broadcast(chunks), ["source", "chunk"])
    place = (F.col("block") % CHUNK).cast("int")
    slot, phase = F.get("slots", place), F.get("phases", place)
    return found.select(
        "doc_id", "source", phase.alias("phase"), "block", slot.alias("slot"), (F.col("at") - F.col("block") * block).alias("place"),
        *([F.col("k").alias(row_key)] if row_key else []),
    )


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, partitions: int | None = None, block: int = BLOCK) -> DataFrame:
    """All rows of ``docs`` in the order of the mixture: sorted partitions of successive slots.

    ``partitions``: how many; without it adaptive execution decides.

    Every row is kept, repeated ones, null and empty texts, and null sources and doc_ids included; a
    very long text stands where its first block does.  An empty table gives no rows.
    """
    keyed, key = with_row_key(docs)
    placed = mix(keyed, weights, block, row_key=key)
    slot, place = free_name(docs, "slot"), free_name(docs, "place")
    placed = placed.select(key, F.col("slot").alias(slot), F.col("place").alias(place))
    joined = keyed.join(placed, key)
    ordered = joined.repartitionByRange(partitions, slot, place) if partitions else joined.repartitionByRange(slot, place)
    return ordered.sortWithinPartitions(slot, place, key).select(*docs.columns)
