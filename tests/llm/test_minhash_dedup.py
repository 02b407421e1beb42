import random
import re

import numpy as np
import pytest

from tessella.llm import minhash_dedup as m


def sets_of(text):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """{doc_id: (size, component)} by comparing all."""
    found = {d: sets_of(t) for d, t in rows}
    comp = {d: d for d in found}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = found[a], found[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {d: (len(found[d]), root(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    rows, base = [], []
    for i in range(120):
        if base and r.random() < 0.6:
            words = list(r.choice(base))
            for _ in range(r.randint(0, max(1, len(words) // 20))):
                words[r.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(r.choice([1, 3, 5, 9, 40, 200, 400]))]
        base.append(words)
        rows.append((i * 3 - 20, r.choice([" ", "\t", "\n "]).join(words)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "Same HERE"), (904, "same\x0bhere")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS component_id", "3 AS key")
    got = {r["doc_id"]: r for r in m.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_long_text_in_spans(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(5000))
    whole = list(m.shingle_sets([text, "a b"]))
    monkeypatch.setattr(m, "SPAN", 1000)
    assert all(np.array_equal(x, y) for x, y in zip(whole, m.shingle_sets([text, "a b"]), strict=True))


def test_blocks_of_a_list_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 3)
    rows = corpus(5)
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_odd_rows(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None)], "doc_id long, text string")
    got = sorted(map(str, m.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(["Row(doc_id=1, component_id=1, kept=True)"] * 2 + ["Row(doc_id=None, component_id=None, kept=True)", "Row(doc_id=2, component_id=2, kept=True)"])


def test_one_doc_id_of_unlike_texts(spark, tmp_path):
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [(1, words("a")), (1, words("b")), (1, words("a")), (2, words("b") + " end"), (3, ""), (3, words("c")), (None, words("c")), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS first").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = m.dedup_documents(docs)
    assert got.columns == docs.columns
    want = [(1, words("a")), (1, words("b")), (3, ""), (3, words("c")), (None, words("c")), (4, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_a_hub_of_links(spark):
    from tessella.llm.components import connected_components

    edges = [(0, i) for i in range(1, 900)] + [(i, i + 1) for i in range(2000, 2050)] + [(5, 2050), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(900), *range(2000, 2051)]}
