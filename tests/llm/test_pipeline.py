import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import source_mixing, store


def test_stages_over_a_small_corpus(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(240):
        words = [word() for _ in range(r.randint(20, 80))]
        if i % 6 == 0:
            words[3:3] = ["vileword", "badnoun", "slurry"]
        docs.append((i, " ".join(words), "en", f"s{i % 5}", i))
        labels.append((i, int(i % 6 == 0)))
    clean = [d for d in docs if d[0] % 6]
    docs += [(1000, clean[0][1] + " ", "en", "s1", 1), (1001, clean[1][1].replace(" ", "  "), None, None, None), (1002, clean[2][1] + " more", "en", "s2", 1), (1003, None, "en", "s1", 0), (1004, "", "en", "s1", 0), (1005, clean[3][1], "en", "s1", 0), (1005, clean[3][1], "en", "s1", 0)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")

    now, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, path)
        assert name == "best_fit_packing" or out.columns == now.columns
        now = store.persist(out, name)
        kept[name] = sorted(x["doc_id"] for x in now.select("doc_id").collect())
    assert kept["toxicity"] == sorted(d[0] for d in docs if d[0] % 6 or d[0] > 999)
    # The longer copy stays; of equal ones the smaller id.
    first = set(kept["toxicity"]) - {clean[0][0], clean[1][0], 1004, 1005}
    assert kept["exact_dedup"] == sorted(first)
    assert kept["minhash_dedup"] == sorted(first - {1002}) == kept["source_mixing"]
    assert sorted(set(kept["best_fit_packing"])) == kept["minhash_dedup"]
    whole = corpus_pipeline.run(spark, path).collect()
    assert sorted(x["doc_id"] for x in whole) == kept["best_fit_packing"]


@pytest.mark.parametrize("written", [True, False])
def test_every_stretch_of_the_sequences_has_the_target_weights(spark, tmp_path, monkeypatch, written):
    """Sources in one lump each, by far unequal: after mixing and packing, each prefix of stretches has
    the tempered shares of every source, within a few blocks; and the files are as many as asked for."""
    monkeypatch.setattr(corpus_pipeline, "BLOCK", 400)
    r = random.Random(3)
    sizes = {"a": 900, "b": 300, "c": 300, "d": 100}
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, "".join(r.choices("abcdefgh ", k=r.randint(20, 180))), "en", source, 0))
            n += 1
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    mixed = corpus_pipeline.mixed(spark, docs, "")
    if written:
        mixed = store.persist(mixed, "mixed")
        assert mixed.select(F.input_file_name()).distinct().count() >= corpus_pipeline.STRETCHES - 1
    packed = {x["doc_id"]: x["sequence_id"] for x in corpus_pipeline.packed(spark, mixed, "").filter("piece = 0").collect()}
    assert len(packed) == len(rows)
    mass = {s: sum(len(x[1]) for x in rows if x[3] == s) for s in sizes}
    weight = {s: m**source_mixing.TEMPER for s, m in mass.items()}
    last = max(packed.values()) + 1
    for part in range(1, 9):  # While all sources last.
        have = {s: sum(len(x[1]) for x in rows if x[3] == s and packed[x[0]] < last * part / 16) for s in sizes}
        for s in sizes:
            assert abs(have[s] - weight[s] / sum(weight.values()) * sum(have.values())) < 0.03 * sum(mass.values()), (part, s, have)
