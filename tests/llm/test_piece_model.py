import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tessella.llm import piece_model as pm

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts(n=4000, seed=5):
    r = random.Random(seed)
    pieces = [LIBRARY.id_to_piece(i) for i in range(259, 32000)]
    kinds = [
        lambda: "".join(r.choices(pieces, k=r.randint(0, 12))),
        lambda: "".join(r.choices("ab  erstinhonl▁\n\t.é语😀\x00<s>", k=r.randint(0, 40))),
        lambda: " " * r.randint(0, 70) + "".join(r.choice(["the", "ing", "er", " ", " " * r.randint(0, 40)]) for _ in range(r.randint(0, 9))),
        lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(0, 60))),
        lambda: "".join(chr(r.choice([r.randint(1, 0x52F), r.randint(0x4E00, 0x9FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(r.randint(0, 30))),
    ]
    return [r.choice(kinds)() for _ in range(n)] + ["", " ", "<s></s><unk><0x41>", "\x00"]


def test_ids_and_texts_of_the_library():
    model, rows = pm.PieceModel(PATH), texts()
    want = LIBRARY.encode(rows, num_threads=1)
    assert [np.frombuffer(b, "<i4").tolist() for b in model.encode(rows)] == want
    assert model.decode(pa.array(want, pa.list_(pa.int32()))).to_pylist() == LIBRARY.decode(want)


def test_any_ids_decode_as_the_library_does():
    r = random.Random(2)
    rows = [[r.randrange(32000) if r.random() < 0.4 else r.randrange(300) for _ in range(r.randint(0, 10))] for _ in range(3000)]
    assert pm.PieceModel(PATH).decode(pa.array(rows, pa.list_(pa.int32()))).to_pylist() == LIBRARY.decode(rows)
    with pytest.raises(ValueError, match="outside"):
        pm.PieceModel(PATH).decode(pa.array([[32000]], pa.list_(pa.int32())))


def test_each_prefix_has_the_last_token_of_its_own_encoding():
    model = pm.PieceModel(PATH)
    for word in ("▁internationalisation", "▁" * 37, "strengths", "▁aaaaabbbaaab", "▁x語語é"):
        last = model.last_tokens(word)
        for i in range(1, len(word) + 1):
            assert last[i] == model.merged(word[:i])[-1]


def test_forgetting_changes_nothing(monkeypatch):
    rows = texts(300)
    want = pm.PieceModel(PATH).encode(rows)
    monkeypatch.setattr(pm, "REMEMBERED", 5)
    monkeypatch.setattr(pm, "LONG_WORD", 3)
    assert pm.PieceModel(PATH).encode(rows) == want


def test_digests_of_rows(spark):
    r = random.Random(1)
    rows = [*texts(300), None, "word " * 40_000, "".join(r.choices("abcdefgh語", k=40_000)), " " * 20_000]
    data = [*enumerate(rows), (0, rows[0]), (None, "null id")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "5 AS ids", "6 AS n_tokens")
    got = sorted(map(str, pm.round_trip_digests(docs, PATH).collect()))

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for i, t in data:
        ids = LIBRARY.encode(t or "")
        want.append(str(pm_row(i, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))))
    assert got == sorted(want)
    assert pm.round_trip_digests(docs.limit(0), PATH).count() == 0


def test_words_end_where_no_piece_goes_on():
    """50 words with 50 marks after them: each word and each mark is worked on once."""
    model, worked_on = pm.PieceModel(PATH), []
    one = model.word_ids
    model.word_ids = lambda word: worked_on.append(word) or one(word)
    marks = [chr(0x4DC0 + i) for i in range(50)]
    rows = [" ".join(f"{word}{mark}" for word in (f"{a}l{b}m" for a in "abcdefghij" for b in "rstuv")) for mark in marks]
    assert [np.frombuffer(b, "<i4").tolist() for b in model.encode(rows)] == LIBRARY.encode(rows)
    assert len(worked_on) <= 150


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(pm, "CHUNK", 40)
    r = random.Random(8)
    rows = ["word " * 300, " " * 500, "".join(r.choices("abcdefgh", k=700)), "".join(r.choices("abcde \n語😀.", k=2000)), "", None, "x" * 70 + "\n" + "y" * 900 + " z", *texts(200, 9)]
    for uncut in (slice(0), slice(None, None, 3), slice(None)):
        model = pm.PieceModel(PATH)
        # Other pairs may have the numbers of pairs within pieces: words are not cut there.
        model.within[uncut] = True
        assert [np.frombuffer(b, "<i4").tolist() for b in model.encode(rows)] == [LIBRARY.encode(t or "") for t in rows]


def pm_row(*values):
    from pyspark.sql import Row

    return Row("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")(*values)
