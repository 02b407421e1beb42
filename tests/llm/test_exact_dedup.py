import hashlib

from tessella.llm import exact_dedup as e
from tessella.llm import store

ROWS = [(5, "a b"), (3, "ab"), (4, " ab\n"), (1, "x"), (2, "X"), (7, None), (6, ""), (8, " \t"), (None, "x"), (9, "9"), (9, "9")]


def test_first_batch(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS k", "3 AS keep_id")
    got = {(r["doc_id"], r["text_sha256"]): r for r in e.DigestIndex(spark, buckets=4).dedup(docs).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert [got[i, h("ab")]["keep_id"] for i in (3, 4, 5)] == [4, 4, 4] and got[4, h("ab")]["group_size"] == 3
    assert got[1, h("x")]["kept"] and not got[None, h("x")]["kept"] and got[2, h("X")]["kept"]
    assert got[7, h("")]["keep_id"] == 8 and got[9, h("9")]["group_size"] == 2


def test_later_batches_go_against_the_index(spark):
    index = e.DigestIndex(spark, buckets=4)
    schema = "doc_id long, text string"
    index.dedup(spark.createDataFrame([(1, "a"), (2, "b")], schema)).collect()
    got = {r["doc_id"]: r for r in index.dedup(spark.createDataFrame([(0, "a  "), (3, "c"), (4, "c")], schema)).collect()}
    assert (got[0]["keep_id"], got[0]["kept"], got[0]["group_size"]) == (1, False, 2)
    assert got[3]["kept"] and not got[4]["kept"] and index.read().count() == 3
    again = e.DigestIndex(spark, index.path, buckets=4)
    assert again.dedup(spark.createDataFrame([(9, "c")], schema)).collect()[0]["keep_id"] == 3
    assert again.dedup(spark.createDataFrame([], schema)).count() == 0 and again.read().count() == 3


def test_one_row_of_each_text_with_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "z") for i, t in ROWS], "doc_id long, text string, row_key string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = e.dedup_documents(spark, spark.read.parquet(str(tmp_path / "d")))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 2, 4, 8, 9]


def parted(spark, tmp_path, n=12):
    """A table of many files, and how to deal them out otherwise."""
    path = str(tmp_path / "parted")
    spark.range(600).selectExpr("id AS doc_id", "concat('text ', id % 200, repeat(' ', CAST(id % 7 AS INT))) AS text", "concat('s', id % 3) AS source").repartition(n).write.parquet(path)
    return spark.read.parquet(path)


def test_row_keys_hold_when_files_are_dealt_out_anew(spark, tmp_path):
    docs = parted(spark, tmp_path)
    keyed, key = store.with_row_key(docs)
    first = {r["doc_id"]: tuple(r[key]) for r in keyed.collect()}
    decided = store.persist(e.DigestIndex(spark).dedup(keyed, key), "decided")
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        again, key = store.with_row_key(spark.read.parquet(str(tmp_path / "parted")))
        assert {r["doc_id"]: tuple(r[key]) for r in again.collect()} == first and len(set(first.values())) == 600
        kept = store.keep_rows(again, key, decided.filter("kept"))
        assert sorted(r["text"].split()[1] for r in kept.collect()) == sorted(map(str, range(200)))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_a_batch_that_comes_again_keeps_its_rows(spark, tmp_path):
    docs = parted(spark, tmp_path, 2)
    with e.DigestIndex(spark, str(tmp_path / "index")) as index:
        one = e.dedup_documents(spark, docs, index, "monday").count()
        size = index.read().count()
        two = e.dedup_documents(spark, docs, index, "monday").count()
        assert one == two == size == index.read().count() == 200
        assert e.dedup_documents(spark, docs, index, "tuesday").count() == 0
    with e.DigestIndex(spark, str(tmp_path / "index")) as index:
        assert index.dedup(docs, batch="wednesday").filter("kept").count() == 0
        assert index.dedup(docs, batch="monday").filter("kept").count() == 200


def test_a_key_of_a_third_of_all_rows_and_very_long_texts(spark):
    rows = [(i, "same", None) for i in range(300)] + [(i, f"other {i}", None) for i in range(300, 900)] + [(900, "x" * 3_000_000, None), (901, "x" * 3_000_000 + "\n", None)]
    got = {r["doc_id"]: r for r in e.DigestIndex(spark).dedup(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()}
    assert all(got[i]["keep_id"] == 0 and got[i]["group_size"] == 300 for i in range(300))
    assert got[900]["keep_id"] == got[901]["keep_id"] == 901 and sum(r["kept"] for r in got.values()) == 602
