import random

import pytest

from tessella.llm import source_mixing as s


def test_rows_follow_the_weights(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), "x" * r.randint(0, 60)) for i in range(900)]
    rows += [(900, "a", "y" * 500), (None, "b", None), (7, "a", "again")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS slot", "2 AS row_key").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = s.mix(docs, {"a": 0.5, "b": 0.3, "c": 0.1, "": 0.1}, block=100).toPandas().sort_values(["slot", "place"])
    assert len(got) == len(rows) and not got.duplicated(["slot", "place"]).any()
    first = got[got.phase == 0]
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.1), ("", 0.1)):
        own = first[first.source == source]
        for slot in range(5, int(first.slot.max()), 7):
            # Blocks that began before the slot; in those that a long row covers, no row begins.
            blocks = own[own.slot < slot].block.max() + 1 if (own.slot < slot).any() else 0
            assert abs(blocks - share * slot) < 2 + 5 * (source == "a")
    mixed = s.mixed_documents(docs, {"a": 0.5, "b": 0.3, "c": 0.1, "": 0.1}, 3)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)


def test_empty_table_and_many_sources(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, source string, text string").write.parquet(str(tmp_path / "e"))
    assert s.mix(spark.read.parquet(str(tmp_path / "e"))).count() == 0
    spark.createDataFrame([(i, f"s{i % 9}", "text") for i in range(90)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "m"))
    assert s.mix(spark.read.parquet(str(tmp_path / "m")), block=8).select("slot", "place").distinct().count() == 90


def exact_deviation(blocks, weights):
    """Slots of all blocks, and the largest distance to the exact shares until the first source runs out."""
    table = s.plan(blocks, weights)
    order = [0] * sum(blocks)
    for i, (slots, _) in enumerate(table):
        assert list(slots) == sorted(set(map(int, slots)))
        for t in slots:
            order[t] = i
    assert sorted(int(t) for slots, _ in table for t in slots) == list(range(sum(blocks)))
    total = sum(map(s.Fraction, weights))
    until = int(min(n * total / s.Fraction(w) for n, w in zip(blocks, weights)))
    done, worst = [0] * len(blocks), 0
    for t, i in enumerate(order[:until], 1):
        done[i] += 1
        worst = max(worst, *(abs(done[j] - s.Fraction(weights[j]) * t / total) for j in range(len(blocks))))
    return order, worst


@pytest.mark.parametrize("seed", range(10))
def test_less_than_one_block_from_the_weights_asked_for(seed):
    r = random.Random(seed)
    weights = [r.random() ** 6 + 1e-5 for _ in range(r.randint(1, 25))]
    blocks = [r.randint(1, 1 + int(900 * w)) for w in weights]
    assert exact_deviation(blocks, weights)[1] < 1


def test_small_weights_are_not_rounded_up():
    order, worst = exact_deviation([2] * 150 + [9850], [0.0001] * 150 + [0.985])
    assert worst < 1 and sum(i < 150 for i in order[:1000]) <= 150 and sum(i < 150 for i in order[:9999]) in range(148, 153)


def test_every_source_has_its_own_weight(spark, tmp_path):
    rows = [(i, f"s{i % 260:03d}", "x" * 10) for i in range(260 * 12)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "d"))
    weights = {f"s{i:03d}": 1.0 + 2 * (i >= 200) for i in range(260)}
    got = s.mix(spark.read.parquet(str(tmp_path / "d")), weights, block=10).toPandas()
    assert sorted(got.slot) == list(range(len(rows)))
    # Shares are 1 / 380 and 3 / 380; in 760 slots 2 and 6 blocks, less than one off.
    n = got[got.slot < 760].groupby("source").size()
    assert all(abs(n[x] - 2 * w) < 1 for x, w in weights.items())


def test_a_weight_of_zero_comes_last():
    table = s.plan([3, 4, 2], [0.0, 0.75, 0.25])
    assert sorted(table[0][0]) == [6, 7, 8]
