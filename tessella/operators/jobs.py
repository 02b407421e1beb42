"""Job graphs and job states, throttling, retries and content-addressed caching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella import dims
from tessella.lineage import cut

#: Statuses whose dependants may start.
DONE = ("APPROVED", "VALIDATED", "EXPORTED")


def topological_layers(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """(job_id, layer): 0 for jobs that depend on nothing, else one more than the deepest dependency.

    ``edges``: job_id, needs; dependencies that are no jobs are ignored.  A layer takes out the edges
    that it meets, and the jobs that are left without any are the next one, so each job is found once
    and graphs may be of any depth.  Jobs that no layer reaches are on or behind a cycle, an error.
    """
    left = cut(edges.select("job_id", "needs").distinct().join(jobs.select(F.col("job_id").alias("needs")), "needs", "left_semi"))
    front = cut(jobs.select("job_id").distinct().join(left, "job_id", "left_anti").withColumn("layer", F.lit(0)))
    layers = [front]
    while not left.isEmpty():
        after = cut(left.join(front.select(F.col("job_id").alias("needs")), "needs", "left_anti"))
        front = cut(left.select("job_id").distinct().join(after, "job_id", "left_anti").withColumn("layer", F.lit(len(layers))))
        if front.isEmpty():
            raise ValueError("jobs depend on each other in a cycle")
        layers.append(front)
        left = after
    return reduce(DataFrame.unionByName, layers)


def transitive_dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, job_id): every job that needs a root, directly or not.  ``roots``: root.

    A round goes on from what the last one newly found, so cycles end as well.
    """
    front = roots.select("root", F.col("root").alias("needs"))
    out = None
    while True:
        found = front.join(edges, "needs").select("root", "job_id").distinct()
        if out is not None:
            found = found.join(out, ["root", "job_id"], "left_anti")
        found = cut(found)
        if found.isEmpty():
            return out if out is not None else found
        out = found if out is None else out.unionByName(found)
        front = found.select("root", F.col("job_id").alias("needs"))


def ready(jobs: DataFrame, edges: DataFrame) -> DataFrame:
    """Planned jobs all of whose known dependencies are done.  ``jobs``: job_id, status."""
    unmet = edges.join(jobs.select(F.col("job_id").alias("needs"), "status"), "needs").filter(~F.col("status").isin(*DONE))
    return jobs.filter("status = 'PLANNED'").join(unmet.select("job_id"), "job_id", "left_anti")


def merged(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Base rows and those of incoming whose job_id is new.

    Where both have a fingerprint, a job that both have with different ones ends the query with an
    error: its stored state would be that of another input.
    """
    fresh = incoming.join(base.select("job_id"), "job_id", "left_anti")
    if "fingerprint" not in base.columns or "fingerprint" not in incoming.columns:
        return base.unionByName(fresh)
    known = base.select("job_id", F.struct("fingerprint").alias("known_job"))
    differs = F.col("known_job").isNotNull() & ~F.col("known_job.fingerprint").eqNullSafe(F.col("fingerprint"))
    error = F.raise_error(F.concat(F.lit("job with another fingerprint: "), F.col("job_id"))).cast("boolean")
    fresh = incoming.join(known, "job_id", "left").filter(F.when(differs, error).otherwise(F.col("known_job").isNull()))
    return base.unionByName(fresh.drop("known_job"))


def conflicts(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Jobs that both have with different fingerprints."""
    both = base.select("job_id", F.col("fingerprint").alias("old")).join(incoming.select("job_id", F.col("fingerprint").alias("new")), "job_id")
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def invalidated(jobs: DataFrame, dependents: DataFrame) -> DataFrame:
    """Jobs with the dependents of invalid ones set back to planned, attempts and error cleared."""
    hit = dependents.select("job_id").distinct().withColumn("hit", F.lit(True))
    new = {"status": F.when(F.col("hit"), "PLANNED").otherwise(F.col("status")), "attempts": F.when(F.col("hit"), 0).otherwise(F.col("attempts"))}
    return jobs.join(hit, "job_id", "left").withColumns(new).drop("hit")


def step(state: Column, event: Column) -> Column:
    """A job's state struct<status, attempts, rounds, illegal> after an event; an event that the
    status does not allow changes nothing but is counted."""
    table = F.create_map(*(x for s, e, n in dims.TRANSITIONS for x in (F.lit(f"{s} {e}"), F.lit(n))))
    after = F.try_element_at(table, F.concat_ws(" ", state["status"], event))
    attempts = (
        F.when(event == "TRANSIENT_ERROR", state["attempts"] + 1)
        .when(event == "START_EXECUTION", F.greatest(state["attempts"], F.lit(1)))
        .when(event.isin("REPAIR_REGENERATE_GRID", "REPAIR_REGENERATE_SEED"), 0)
        .otherwise(state["attempts"])
    )
    rounds = F.when(event == "PLAN_REPAIR", state["rounds"] + 1).otherwise(state["rounds"])
    ok = after.isNotNull()
    return F.struct(
        F.when(ok, after).otherwise(state["status"]).alias("status"),
        F.when(ok, attempts).otherwise(state["attempts"]).cast("int").alias("attempts"),
        F.when(ok, rounds).otherwise(state["rounds"]).cast("int").alias("rounds"),
        F.when(ok, state["illegal"]).otherwise(state["illegal"] + 1).cast("int").alias("illegal"),
    )


def fold(events: DataFrame, job: str, order: list[str], event: str) -> DataFrame:
    """(job, status, attempts, rounds, illegal): each job's state after all its events, in order,
    from PLANNED.  A job's history is one value, as its record is."""
    start = F.struct(F.lit("PLANNED").alias("status"), F.lit(0).alias("attempts"), F.lit(0).alias("rounds"), F.lit(0).alias("illegal"))
    log = events.groupBy(job).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("e")))).alias("log"))
    state = F.aggregate("log", start, lambda s, r: step(s, r["e"]))
    return log.select(job, state.alias("s")).select(job, "s.*")


def throttled(calls: DataFrame, by: list[str], at: str, order: list[str], gap: float) -> DataFrame:
    """start: when each call may begin if starts keep ``gap`` seconds apart, in order.

    start_i = max over j <= i of (at_j + (i - j) * gap), a running maximum.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = calls.withColumn("i", F.row_number().over(w) - 1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("start", F.col("i") * gap + F.max(F.col(at) - F.col("i") * gap).over(upto)).drop("i")


def peak_concurrency(spans: DataFrame, by: list[str], start: str, stop: str) -> DataFrame:
    """peak: the most spans open at once; a span that ends when another begins is closed."""
    ends = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("t"), F.lit(-1).alias("d"))))
    moves = spans.select(*by, ends.alias("m")).groupBy(*by, "m.t").agg(F.sum("m.d").alias("d"))
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("open", F.sum("d").over(w)).groupBy(*by).agg(F.max("open").alias("peak"))


def cache_hits(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """hit: whether an earlier request had the same key."""
    first = requests.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return requests.join(first, key).withColumn("hit", F.struct(*order) > F.col("first")).drop("first")


#: States in which a job that calls the provider has yet to do so.
UNPAID = ["PLANNED", "GENERATING"]


def summary(jobs: DataFrame) -> DataFrame:
    """One row for each asset_id: total_jobs, estimated_api_calls, derived_jobs, and a count for each status.

    ``jobs``: asset_id, job_id, kind, status.  Derived jobs call no provider.
    """
    count = lambda on: F.count(F.when(on, 1))
    states = jobs.groupBy("asset_id", "status").agg(
        F.count(F.lit(1)).alias("n"), count((F.col("kind") != "derived") & F.col("status").isin(UNPAID)).alias("calls"), count(F.col("kind") == "derived").alias("derived")
    )
    return states.groupBy("asset_id").agg(
        F.sum("n").alias("total_jobs"), F.sum("calls").alias("estimated_api_calls"), F.sum("derived").alias("derived_jobs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),
    )


def pending(jobs: DataFrame) -> DataFrame:
    """Jobs that have yet to call the provider."""
    return jobs.filter((F.col("kind") != "derived") & F.col("status").isin(UNPAID))


def signature(jobs: DataFrame) -> DataFrame:
    """(asset_id, signature): a fingerprint of an asset's jobs that tells whether two plans are the same.

    ``jobs``: asset_id, job_id, kind, frames, derived_from, input_fingerprint.  An asset's jobs are one
    line each and make one text, in the order of their ids.
    """
    mark = F.coalesce(F.when(F.length("input_fingerprint") > 0, F.concat(F.lit("#"), "input_fingerprint")), F.lit(""))
    line = F.concat("job_id", F.lit("#"), "kind", F.lit("#"), F.col("frames").cast("string"), F.lit("#"), F.coalesce("derived_from", F.lit("")), mark)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("job_id", line.alias("line")))), lambda x: x["line"]), "|")
    return jobs.groupBy("asset_id").agg(F.substring(F.sha2(lines, 256), 1, 16).alias("signature"))


#: What may become of an asset of a pack, in the order in which it is reported.
OUTCOMES = ["exported", "validation_failed", "provider_failed", "processing_failed", "paused", "skipped", "awaiting_approval", "outcome_missing"]
FLAGS = ["cached", "resumed", "outcome_unknown"]


def pack_counts(assets: DataFrame, by: str = "pack_id") -> DataFrame:
    """For each pack total and a count of every outcome and flag, zeros included.

    ``assets``: the pack, outcome, cached, resumed, outcome_unknown; null flags are not set.  An
    outcome that is none of ``OUTCOMES`` is an error.
    """
    known = F.when(F.col("outcome").isin(OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("unknown outcome "), F.coalesce("outcome", F.lit("null")))))
    rows = assets.withColumn("outcome", known)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), *(F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in FLAGS)
    )


def pack_plan(jobs: DataFrame, by: str = "pack_id") -> DataFrame:
    """For each pack assets, total_jobs and the calls still to be paid for: of all jobs that are not
    derived, of seeds and of animations.  ``jobs``: the pack, asset_id, kind, status."""
    unpaid = F.col("status").isin(UNPAID)
    return jobs.groupBy(by).agg(
        F.count_distinct("asset_id").alias("assets"), F.count(F.lit(1)).alias("total_jobs"), F.count_if(unpaid & (F.col("kind") != "derived")).alias("estimated_api_calls"),
        F.count_if(unpaid & (F.col("kind") == "seed")).alias("estimated_seed_api_calls"), F.count_if(unpaid & (F.col("kind") == "animation")).alias("estimated_animation_api_calls"),
    )
