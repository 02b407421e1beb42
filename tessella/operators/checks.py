"""Quality checks as rows: thresholds, reports, repair plans, calibration.

``facts``: asset_id, id, target, severity, result (PASS, FAIL, WARN, SKIP), message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import dims

#: In the message of an overflow that another generation cannot mend.
FUTILE = "aspect ratio"


def resolve_thresholds(requests: DataFrame) -> DataFrame:
    """Limits for (action, direction, moving): those for the way of moving, else the action's; the
    two variations are wider upwards, the drift is not.  Unknown actions have none."""
    spark = requests.sparkSession
    base = F.broadcast(dims.thresholds(spark))
    own = F.broadcast(dims.moving_thresholds(spark).select("moving", "action", *(F.col(c).alias(f"own_{c}") for c in ("height_max", "silhouette_max", "drift_max")), F.lit(True).alias("own")))
    rows = requests.join(base, "action", "left").join(own, ["moving", "action"], "left")
    factor = F.coalesce(*(F.when(F.col("direction") == d, f) for d, f in dims.DIRECTION_FACTOR.items()), F.lit(1.0))
    pick = lambda c: F.when(F.col("own"), F.col(f"own_{c}")).otherwise(F.col(c))
    wide = lambda c: F.bround(pick(c) * factor, 4).alias(c)
    return rows.select(*requests.columns, wide("height_max"), wide("silhouette_max"), pick("drift_max").alias("drift_max"))


def judged(measured: DataFrame, value: str, limit: str) -> DataFrame:
    """result: PASS within the limit, FAIL beyond it, SKIP without a limit or a measure."""
    v, most = F.col(value), F.col(limit)
    return measured.withColumn("result", F.when(v.isNull() | most.isNull(), "SKIP").when(v <= most, "PASS").otherwise("FAIL"))


def report(facts: DataFrame) -> DataFrame:
    """Counts by result for each asset; passed unless a fatal or high check failed."""
    n = lambda r: F.count_if(F.col("result") == r)
    blocking = (F.col("result") == "FAIL") & F.col("severity").isin("fatal", "high")
    return facts.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("total"), n("PASS").alias("passed_checks"), n("FAIL").alias("failed"), n("WARN").alias("warnings"), n("SKIP").alias("skipped"),
        (F.count_if(blocking) == 0).alias("passed"),
    )


def densified(facts: DataFrame) -> DataFrame:
    """Facts with a SKIP row for every check that an asset lacks."""
    every = facts.select("asset_id").distinct().join(F.broadcast(dims.checks(facts.sparkSession).select("id", "severity")))
    lacking = every.join(facts.select("asset_id", "id").distinct(), ["asset_id", "id"], "left_anti")
    rest = [c for c in facts.columns if c not in ("asset_id", "id", "severity", "result")]
    return facts.unionByName(lacking.select("asset_id", "id", "severity", F.lit("SKIP").alias("result"), *(F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in rest)))


def repair_plan(facts: DataFrame, rounds: DataFrame | None = None, most: int = 2) -> DataFrame:
    """(asset_id, target, action, severity, reasons): what to do about failed checks.

    A target with a check that only a new generation mends is regenerated, which covers its local
    repairs; other targets with local checks are processed again; blocking checks that nothing mends
    are for a person, each by itself, as are overflows that regeneration cannot help.  Other failures
    make no step.  Assets that have used ``most`` rounds (``rounds``: asset_id, used) get none.
    """
    dim = F.broadcast(dims.checks(facts.sparkSession).select("id", F.col("repair")))
    rank = F.array_position(F.array(*(F.lit(s) for s, _ in dims.SEVERITIES)), F.col("severity"))
    failed = facts.filter("result = 'FAIL'").join(dim, "id").withColumn("rank", rank)
    if rounds is not None:
        failed = failed.join(rounds.filter(F.col("used") >= most).select("asset_id"), "asset_id", "left_anti")
    futile = (F.col("id") == "cell_overflow") & F.coalesce(F.col("message").contains(FUTILE), F.lit(False))
    target = failed.filter("repair != 'none'").groupBy("asset_id", "target").agg(
        F.bool_or(F.col("repair") == "regenerate").alias("again"), F.bool_or(futile).alias("futile"),
        *(F.max(F.when(F.col("repair") == k, F.struct("rank", "severity")))["severity"].alias(f"{k}_severity") for k in ("regenerate", "local")),
        *(F.array_sort(F.collect_set(F.when(F.col("repair") == k, F.col("id")))).alias(f"{k}_reasons") for k in ("regenerate", "local")),
    )
    action = F.when(F.col("futile"), "manual").when(F.col("again"), "regenerate_grid").otherwise("reprocess")
    pick = lambda c: F.when(F.col("again"), F.col(f"regenerate_{c}")).otherwise(F.col(f"local_{c}")).alias(c)
    steps = target.select("asset_id", "target", action.alias("action"), pick("severity"), pick("reasons"))
    manual = failed.filter((F.col("repair") == "none") & F.col("severity").isin("fatal", "high"))
    return steps.unionByName(manual.select("asset_id", "target", F.lit("manual").alias("action"), "severity", F.array("id").alias("reasons")))


def calibration(metrics: DataFrame, value: str) -> DataFrame:
    """count, min, max and mean of a metric by action and by action and direction, in one pass."""
    out = metrics.groupingSets([["action"], ["action", "direction"]], "action", "direction").agg(
        F.grouping("direction").cast("int").alias("whole_action"), F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"),
    )
    return out


def repair_hints(facts: DataFrame, by: list[str], repairs: DataFrame) -> DataFrame:
    """Targets of failed checks, sorted, by what can mend them: local and regenerate.

    ``facts``: by, id, target, result; ``repairs``: id, repair.
    """
    failed = facts.filter("result = 'FAIL'").join(F.broadcast(repairs), "id").groupBy(*by, "repair", "target").count()
    some = lambda kind: F.array_sort(F.collect_set(F.when(F.col("repair") == kind, F.col("target"))))
    return failed.groupBy(*by).agg(some("local").alias("local"), some("regenerate").alias("regenerate"))
