"""Queries over rules, jobs, caches, throttles, checks and documents as content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import dims
from tessella.functions import geometry, rules
from tessella.operators import checks, jobs, sequence
from tessella.plans import bindings as b
from tessella.plans.registry import query

WORDS = "[" + ", ".join(f"'{w}'" for w in b.WORDS) + "]"
DESCRIPTIONS = f"de AS (SELECT p_partkey, p_name || ' with ' || {WORDS}[p_partkey % {len(b.WORDS)} + 1] || ' trim' AS text FROM part)"


def any_word(words: list[str]) -> str:
    ascii_, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
    return f"(regexp_matches(lower(text), '\\b({'|'.join(ascii_)})\\b') OR " + " OR ".join(f"contains(lower(text), '{w}')" for w in other) + ")"


@query(f"WITH {DESCRIPTIONS} SELECT p_partkey, CASE " + " ".join(f"WHEN NOT {any_word(w)} THEN '{c}'" for c, w in dims.KEY_COLORS.items()) + " END AS color FROM de")
def key_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.descriptions(spark, sf_dir).select("p_partkey", rules.key_color(F.col("text")).alias("color"))


@query(f"WITH {DESCRIPTIONS} SELECT p_partkey, CASE " + " ".join(f"WHEN {any_word(w)} THEN '{k}'" for k, w in dims.MOVING.items()) + " ELSE 'biped' END AS moving FROM de")
def locomotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.descriptions(spark, sf_dir).select("p_partkey", rules.moving(F.col("text")).alias("moving"))


def unnegated(word: str) -> str:
    before = f"substr(lower(text), greatest(instr(lower(text), '{word}') - 12, 1), least(12, instr(lower(text), '{word}') - 1))"
    return f"CASE WHEN contains(lower(text), '{word}') AND NOT ({' OR '.join(f'contains({before}, {n!r})' for n in dims.NEGATIONS)}) THEN '{word}' END"


@query(f"WITH {DESCRIPTIONS} SELECT p_partkey, array_to_string(list_filter([{', '.join(map(unnegated, dims.ASYMMETRIC))}], lambda s: s IS NOT NULL), ',') AS things FROM de")
def asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.descriptions(spark, sf_dir).select("p_partkey", F.array_join(rules.asymmetric(F.col("text")), ",").alias("things"))


def _redacted(text: str) -> str:
    for pattern, kept in dims.REDACTIONS:
        quoted, kept = pattern.replace("'", "''"), kept.replace("$", "\\")
        text = f"regexp_replace({text}, '{quoted}', '{kept}***REDACTED***', 'g')"
    return text


@query(
    "WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'call Bearer ' || md5(c_name) WHEN 1 THEN 'api_key=' || md5(c_name) WHEN 2 THEN 'sk-' || md5(c_name) ELSE c_name END AS text FROM customer) "
    f"SELECT c_custkey, {_redacted('text')} AS text FROM s"
)
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.secrets(spark, sf_dir).select("c_custkey", rules.redacted(F.col("text")).alias("text"))


EVENTS = (
    "ev AS (SELECT user_id::VARCHAR || ':' || strftime(date_trunc('week', ts), '%Y%m%d') AS job_id, user_id, ts, event_id, value, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in b.EVENTS.items())
    + " ELSE 'CACHE_HIT' END AS event FROM events)"
)
STEPS = ", ".join(f"('{s}', '{e}', '{n}')" for s, e, n in dims.TRANSITIONS)


@query(
    f"WITH RECURSIVE {EVENTS}, tr(status, event, nx) AS (VALUES {STEPS}), q AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY job_id) AS n FROM ev), "
    "st AS (SELECT job_id, 0::BIGINT AS k, any_value(n) AS n, 'PLANNED' AS status, 0 AS attempts, 0 AS rounds, 0 AS illegal FROM q GROUP BY job_id UNION ALL "
    "SELECT st.job_id, st.k + 1, st.n, coalesce(tr.nx, st.status), CASE WHEN tr.nx IS NULL THEN attempts WHEN q.event = 'TRANSIENT_ERROR' THEN attempts + 1 WHEN q.event = 'START_EXECUTION' THEN greatest(attempts, 1) ELSE attempts END, "
    "rounds, illegal + (tr.nx IS NULL)::INT FROM st JOIN q ON q.job_id = st.job_id AND q.k = st.k + 1 LEFT JOIN tr ON tr.status = st.status AND tr.event = q.event) "
    "SELECT job_id, status, attempts, rounds, illegal FROM st WHERE k = n"
)
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fold(b.job_events(spark, sf_dir), "job_id", ["ts", "event_id"], "event")


@query(
    f"WITH {EVENTS}, r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM ev) "
    "SELECT event_id, round(i * 3600 + max(t - i * 3600) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), 3) AS start FROM r"
)
def throttle_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = b.job_events(spark, sf_dir).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return jobs.throttled(calls, ["user_id"], "t", ["ts", "event_id"], 3600.0).select("event_id", F.round("start", 3).alias("start"))


@query(
    "WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + (abs(value) * 1e9)::BIGINT + 1 AS z FROM events), m AS (SELECT user_id, a AS t, 1 AS d FROM s UNION ALL SELECT user_id, z, -1 FROM s), "
    "n AS (SELECT user_id, t, sum(d) AS d FROM m GROUP BY ALL), o AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS open FROM n) SELECT user_id, max(open)::BIGINT AS peak FROM o GROUP BY user_id"
)
def peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = b.read(spark, sf_dir, "events").select("user_id", begin.alias("a"), (begin + F.round(F.abs("value") * 1e9).cast("long") + 1).alias("z"))
    return jobs.peak_concurrency(spans, ["user_id"], "a", "z")


@query(f"WITH {EVENTS} SELECT job_id, count(*) FILTER (event = 'TRANSIENT_ERROR') AS errors, sum(least(pow(2, i), 30)) AS waited FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS i FROM ev WHERE event = 'TRANSIENT_ERROR') GROUP BY job_id")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    errors = b.job_events(spark, sf_dir).filter("event = 'TRANSIENT_ERROR'").withColumn("attempt", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id")))
    return errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("errors"), F.sum(geometry.retry_delay(F.col("attempt"))).alias("waited"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents) SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY key) AS hit FROM d")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cache_hits(b.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key")), "key", ["doc_id"]).select("doc_id", "hit")


@query("SELECT count(DISTINCT sha256(text)) AS entries, sum(n)::BIGINT AS bytes FROM (SELECT text, any_value(strlen(text))::BIGINT AS n FROM documents GROUP BY text)")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = b.read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.max(F.octet_length("text")).cast("long").alias("n"))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("bytes"))


@query("WITH f AS (SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS first FROM documents) SELECT lang, first, doc_id FROM f WHERE doc_id > first")
def document_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.read(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2("text", 256).alias("digest"))
    return sequence.exact_duplicates(rows, "lang", "doc_id", "digest")


@query("SELECT o_orderkey, sha256('{\"customer\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\",\"status\":\"' || o_orderstatus || '\"}') AS fingerprint FROM orders")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    canon = F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")))
    return b.read(spark, sf_dir, "orders").select("o_orderkey", F.sha2(canon, 256).alias("fingerprint"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, customers and suppliers, and orders as jobs that need their parents."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        ("region", name("r", "r_regionkey"), F.lit(None).cast("string"), F.lit("VALIDATED")),
        ("nation", name("n", "n_nationkey"), name("r", "n_regionkey"), F.when(F.col("n_nationkey") % 3 == 0, "VALIDATED").otherwise("PLANNED")),
        ("customer", name("c", "c_custkey"), name("n", "c_nationkey"), F.when(F.col("c_custkey") % 5 == 0, "EXPORTED").otherwise("PLANNED")),
        ("supplier", name("s", "s_suppkey"), name("n", "s_nationkey"), F.lit("PLANNED")),
        ("orders", name("o", "o_orderkey"), name("c", "o_custkey"), F.lit("PLANNED")),
    ]
    every = None
    for table, job, needs, status in parts:
        one = b.read(spark, sf_dir, table).select(job.alias("job_id"), needs.alias("needs"), status.alias("status"))
        every = one if every is None else every.unionByName(one)
    return every.select("job_id", "status"), every.filter("needs IS NOT NULL").select("job_id", "needs")


GRAPH = (
    "jo(job_id, needs, status) AS (SELECT 'r' || r_regionkey, NULL, 'VALIDATED' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'VALIDATED' ELSE 'PLANNED' END FROM nation "
    "UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'EXPORTED' ELSE 'PLANNED' END FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'PLANNED' FROM supplier "
    "UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'PLANNED' FROM orders)"
)


@query(f"WITH RECURSIVE {GRAPH}, la AS (SELECT job_id, 0 AS layer FROM jo WHERE needs IS NULL UNION ALL SELECT jo.job_id, layer + 1 FROM jo JOIN la ON jo.needs = la.job_id) SELECT job_id, max(layer) AS layer FROM la GROUP BY job_id")
def topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.topological_layers(*graph(spark, sf_dir))


@query(f"WITH RECURSIVE {GRAPH}, re AS (SELECT needs AS root, job_id FROM jo WHERE needs LIKE 'n%' UNION SELECT root, jo.job_id FROM re JOIN jo ON jo.needs = re.job_id) SELECT root, job_id FROM re")
def transitive_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, edges = graph(spark, sf_dir)
    return jobs.transitive_dependents(edges, known.filter("job_id LIKE 'n%'").select(F.col("job_id").alias("root")))


@query(f"WITH {GRAPH} SELECT job_id, status FROM jo WHERE status = 'PLANNED' AND (needs IS NULL OR needs IN (SELECT job_id FROM jo WHERE status IN ('APPROVED', 'VALIDATED', 'EXPORTED')))")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.ready(*graph(spark, sf_dir))


THRESHOLDS = ", ".join(f"('{a}', {h or 'NULL'}, {s or 'NULL'}, {d or 'NULL'})" for a, h, s, d in dims.THRESHOLDS)


@query(
    f"WITH t(action, h, s, d) AS (VALUES {THRESHOLDS}, ('roll', NULL, NULL, NULL)), q AS (SELECT * FROM t, (VALUES ('down'), ('up'), ('left')) v(direction), (VALUES ('biped'), ('legless')) w(moving)) "
    "SELECT action, direction, moving, CASE WHEN moving = 'legless' AND action = 'walk' THEN NULL ELSE round_even(h::DOUBLE * CASE direction WHEN 'up' THEN 1.3 ELSE 1.0 END::DOUBLE, 4) END AS height_max, "
    "CASE WHEN moving = 'legless' AND action = 'walk' THEN NULL ELSE round_even(s::DOUBLE * CASE direction WHEN 'up' THEN 1.3 ELSE 1.0 END::DOUBLE, 4) END AS silhouette_max, d AS drift_max FROM q"
)
def thresholds_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [t[0] for t in dims.THRESHOLDS] + ["roll"]
    asked = dims.table(spark, [(a, d, m) for a in names for d in ("down", "up", "left") for m in ("biped", "legless")], "action string, direction string, moving string")
    return checks.resolve_thresholds(asked)


N = len(dims.CHECKS)
FACTS = (
    f"ck(k, id, severity, repair) AS (VALUES {', '.join(str((i, *c)) for i, c in enumerate(dims.CHECKS))}), "
    f"fa AS (SELECT l_orderkey % 500 AS asset_id, ck.id, ck.severity, ck.repair, l_returnflag || '_' || l_linestatus || '_' || (l_suppkey % 7) AS target, "
    "CASE WHEN l_discount >= 0.07 THEN 'FAIL' WHEN l_tax >= 0.07 THEN 'WARN' WHEN l_tax < 0.02 THEN 'SKIP' ELSE 'PASS' END AS result, CASE WHEN l_quantity < 5 THEN 'aspect ratio changed' END AS message, "
    f"l_returnflag AS action, l_linestatus AS direction, l_discount AS measured FROM lineitem JOIN ck ON (l_orderkey * 7 + l_linenumber) % {N} = k)"
)


@query(
    f"WITH {FACTS} SELECT asset_id, count(*) AS total, count(*) FILTER (result = 'PASS') AS passed_checks, count(*) FILTER (result = 'FAIL') AS failed, count(*) FILTER (result = 'WARN') AS warnings, "
    "count(*) FILTER (result = 'SKIP') AS skipped, count(*) FILTER (result = 'FAIL' AND severity IN ('fatal', 'high')) = 0 AS passed FROM fa GROUP BY asset_id"
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.report(b.check_facts(spark, sf_dir))


@query(f"WITH {FACTS}, ev AS (SELECT DISTINCT asset_id, ck.id FROM fa, ck) SELECT asset_id, count(*) AS lacking FROM ev ANTI JOIN fa USING (asset_id, id) GROUP BY asset_id")
def densified_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = checks.densified(b.check_facts(spark, sf_dir))
    return full.filter("target IS NULL").groupBy("asset_id").agg(F.count(F.lit(1)).alias("lacking"))


RANK = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


@query(
    f"WITH {FACTS}, fl AS (SELECT * FROM fa WHERE result = 'FAIL'), tg AS (SELECT asset_id, target, bool_or(repair = 'regenerate') AS again, bool_or(id = 'cell_overflow' AND coalesce(contains(message, 'aspect ratio'), false)) AS futile, "
    f"arg_max(severity, {RANK}) FILTER (repair = 'regenerate') AS rs, arg_max(severity, {RANK}) FILTER (repair = 'local') AS ls, string_agg(DISTINCT id, ',' ORDER BY id) FILTER (repair = 'regenerate') AS rr, "
    "string_agg(DISTINCT id, ',' ORDER BY id) FILTER (repair = 'local') AS lr FROM fl WHERE repair <> 'none' GROUP BY ALL) "
    "SELECT asset_id, target, CASE WHEN futile THEN 'manual' WHEN again THEN 'regenerate_grid' ELSE 'reprocess' END AS action, CASE WHEN again THEN rs ELSE ls END AS severity, CASE WHEN again THEN rr ELSE lr END AS reasons FROM tg "
    "UNION ALL SELECT asset_id, target, 'manual', severity, id FROM fl WHERE repair = 'none' AND severity IN ('fatal', 'high')"
)
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.repair_plan(b.check_facts(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"WITH {FACTS} SELECT action, direction, GROUPING(direction)::INT AS whole_action, count(measured) AS n, min(measured) AS low, max(measured) AS high, round(avg(measured), 6) AS mean FROM fa GROUP BY GROUPING SETS ((action), (action, direction))"
)
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.calibration(b.check_facts(spark, sf_dir), "measured").withColumn("mean", F.round("mean", 6))
