import random

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from tessella.llm import packing, pretokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"ab'strevlmdé 12  \n\t .,-'“漢字́\u0085 \x1c١", "'s", "'re", " '", "<|endoftext|>", "don't"]


def texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_pieces_are_those_of_the_pattern():
    rows = texts(3000)
    for low, high, pieces in pretokens.split(rows):
        at = 0
        for i in range(low, high):
            got = [pieces.text(c) for c in pieces.codes[at : pieces.ends[i - low]]]
            at = pieces.ends[i - low]
            assert got == regex.findall(public_tokenizers.PATTERN, rows[i])


def test_long_texts_in_parts(monkeypatch):
    whole = ["word " * 400 + "x" * 50, None, "end it's"]
    want = token_counts.Merger(PATH).counts(whole)
    monkeypatch.setattr(pretokens, "CHUNK", 64)
    assert (token_counts.Merger(PATH).counts(whole) == want).all()


def test_counts_of_the_library(spark):
    rows = [*texts(500), None, "", "a" * 3000, "<|endoftext|>" * 3]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "5 AS n_bytes")
    got = token_counts.count_tokens(docs, PATH).toPandas().set_index("doc_id")
    library = Tokenizer.from_file(PATH)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in rows]
    assert got.n_tokens.sort_index().tolist() == want
    assert got.n_bytes.sort_index().tolist() == [len((t or "").encode()) for t in rows]
    assert (got.over_limit == (got.n_tokens > 1024)).all() and np.any(got.over_limit) == any(w > 1024 for w in want)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


def test_long_unbroken_pieces(monkeypatch):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = ["a" * 30000, "".join(r.choices(letters, k=50000)), "".join(r.choices("'!?.-", k=30000)) + "abc", " " * 30000 + "x", "".join(r.choices("éß語Ж", k=20000)), "12345" * 4000, "".join(r.choices("ab 's,.1\n\t", k=30000)), None]
    monkeypatch.setattr(pretokens, "CHUNK", 1000)
    library = Tokenizer.from_file(PATH)
    want = [library.encode(x or "", add_special_tokens=False).ids for x in rows]
    assert token_counts.Merger(PATH).counts(rows).tolist() == list(map(len, want))
    got = [np.zeros(0, "<u4")] * len(rows)
    for i, ids in packing.Encoder(PATH).encode(rows):
        got[i] = np.append(got[i], ids)
    assert [g.tolist() for g in got] == want
