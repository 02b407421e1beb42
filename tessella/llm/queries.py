"""The numbered queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import (
    centroid_clusters,
    chat_format,
    embedding_dedup,
    exact_dedup,
    filter_audit,
    language_id,
    minhash_dedup,
    packing,
    piece_model,
    pii_surrogates,
    source_mixing,
    token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with exact_dedup.DigestIndex(spark) as index:
        return index.dedup(read(spark, sf_dir, "documents"))


QUERIES["op4_exact_dedup"] = op4_exact_dedup
ORACLE_SQL["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY size DESC, doc_id)
"""


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(id AS BIGINT) AS turn, "
        "CASE WHEN id = 0 THEN 'user' ELSE 'assistant' END AS role, "
        "'<|im_end|><|im_start|>assistant ok' AS text FROM range(0, 2, 1, 1)"
    )
    return chat_format.digest_of_rendering(chat_format.render(turns.unionByName(probe)))


QUERIES["op3_chat_format"] = op3_chat_format
ORACLE_SQL["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, regexp_matches(text, '<\|\w+\|>') OR regexp_matches(text, '<\\+\|') AS hard,
         regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS esc,
         replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l') AS r
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(r) + length(CASE WHEN hard THEN esc ELSE text END) + 24)::BIGINT AS formatted_chars,
       count(*) FILTER (hard) AS n_escaped
FROM e GROUP BY conv_id
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op2_token_counts"] = op2_token_counts


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op8_best_fit_packing"] = op8_best_fit_packing


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES["op1_minhash_dedup"] = op1_minhash_dedup
ORACLE_SQL["op1_minhash_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w),
post AS MATERIALIZED (SELECT doc_id, len(sh) AS n, hash(unnest(sh)) AS s FROM sets),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM post a JOIN post b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(y, doc_id)) AS kept
FROM sets LEFT JOIN low ON x = doc_id
"""


def op6_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic"))


QUERIES["op6_toxicity_neighbours"] = op6_toxicity_neighbours


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES["op9_language_id"] = op9_language_id


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


QUERIES["op7_embedding_dedup"] = op7_embedding_dedup
ORACLE_SQL["op7_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM v LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(read(spark, sf_dir, "documents"))


QUERIES["op10_source_mixing"] = op10_source_mixing


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Surrogates are only as secret as their key: a job sets its own.
    return pii_surrogates.replace(read(spark, sf_dir, "documents"), key=spark.conf.get("tessella.pii.key", "op5"))


QUERIES["op5_pii_surrogates"] = op5_pii_surrogates


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES["op11_filter_audit"] = op11_filter_audit
#: Filter by filter, in every order, over the rows counted by what they fail.
ORACLE_SQL["op11_filter_audit"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
f AS (
  SELECT part, [w.letter FOR w IN [
           {'letter': 'A', 'fails': len(ws) < 200},
           {'letter': 'B', 'fails': 100 * len(list_distinct(ws)) < 50 * len(ws)},
           {'letter': 'C', 'fails': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text)},
           {'letter': 'D', 'fails': regexp_matches(text, '[#$%&*|]')},
           {'letter': 'E', 'fails': doc_id > min(doc_id) OVER (PARTITION BY text)}] IF w.fails] AS fails,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM t LEFT JOIN labels USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f GROUP BY part, fails),
o(filter_order) AS (
  SELECT '' UNION ALL SELECT filter_order || l FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(l) WHERE NOT contains(filter_order, l)),
s AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, len(list_intersect(fails, string_split(filter_order[1:step - 1], ''))) > 0 AS gone,
         list_contains(fails, filter_order[step]) AS here, fails, n, good, bad
  FROM g, o, range(1, 6) r(step) WHERE length(filter_order) = 5),
c AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = [letter]), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost,
         coalesce(sum(bad) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM c
"""


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_model.round_trip_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op12_piece_round_trip"] = op12_piece_round_trip


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(read(spark, sf_dir, "embeddings"))


def _clusters_sql(rounds: int) -> str:
    """Every round as two steps: all distances, then the floors of the means."""
    out = """
WITH e AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS m FROM e QUALIFY c < 40)"""
    for i in range(rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (
  SELECT vec_id, v, min({{'d': list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m), 'c': c}}) AS best
  FROM e, c{i} GROUP BY ALL)"""
        if i < rounds:
            out += f""",
s{i} AS (SELECT best.c AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{i}, range(1, 65) r(i) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c AS c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{i} GROUP BY c) n ON n.c = c{i}.c)"""
    return f"""{out}
SELECT vec_id, best.c::INT AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f ON f.c = best.c
"""


QUERIES["op13_centroid_clusters"] = op13_centroid_clusters
ORACLE_SQL["op13_centroid_clusters"] = _clusters_sql(5)
