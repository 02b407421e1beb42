import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessella.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def checked(spark, texts, capacity):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, PATH, capacity).toPandas()
    library = Tokenizer.from_file(PATH)
    for doc, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == doc].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own)))
        assert own.start.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() == len(ids)
        assert (own.length[1:] == capacity).all() and (len(own) == 1 or len(ids) > capacity)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, one in rows.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == np.cumsum([0, *one.length[:-1]]).tolist() and one.length.sum() <= capacity
    return rows


def test_pieces_and_bins(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join("word" for _ in range(n)) for n in rng.integers(1, 40, 300)]
    texts += [None, "", "<|endoftext|> in it", "x" * 500, "it's the \n\n  end  ", "y " * 200, "same", "same"]
    rows = checked(spark, texts, 32)
    assert rows.sequence_id.nunique() <= rows.length.sum() / 32 * 1.03 + 1


def test_empty_table_and_other_columns(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    docs = spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'a' AS text, 1 AS piece, 2 AS rank, 3 AS part")
    assert packing.pack(docs, PATH).collect()[0]["length"] == 2


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_each_piece_once_and_beats_its_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    np.add.at(counts, rng.integers(1, 65, 2000), 1)
    rows, bins = packing.plan(counts)
    ranks = {s: [] for s in range(65)}
    load = np.zeros(bins, np.int64)
    for size, first, times, bin0, offset in rows:
        ranks[size] += range(first, first + times)
        for b in range(bin0, bin0 + times):
            load[b] += size
    assert all(sorted(ranks[s]) == list(range(counts[s])) for s in range(65))
    assert load.max() <= 64 and load.sum() == (counts * np.arange(65)).sum()
    assert bins <= -(-load.sum() // 64) * 1.12 + 1


def test_two_replace_the_smallest():
    # Greedy fills 60 with 30 and leaves 10; 21 and 19 use all of the 40 that the 30 and the gap give.
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 21, 19]] = 1
    rows, bins = packing.plan(counts)
    assert {r[0] for r in rows if r[3] == 0} == {60, 21, 19} and bins == 2


def test_pieces_stay_known_beyond_many_others():
    """200,000 different words, twice: most of them go through the library once."""
    words = [f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(200_000)]
    texts = ["".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    encoder, encoded = packing.Encoder(PATH), []
    through = encoder._encoded
    encoder._encoded = lambda pieces: encoded.append(len(pieces)) or through(pieces)
    first = [ids.tolist() for _, ids in encoder.encode(texts)]
    before = sum(encoded)
    assert before == len(words) and [ids.tolist() for _, ids in encoder.encode(texts)] == first
    assert sum(encoded) - before < before / 4
    assert first[7] == Tokenizer.from_file(PATH).encode(texts[7], add_special_tokens=False).ids


def test_pieces_that_go_through_the_library_together(monkeypatch):
    odd = ["a\U0010fffeb \U0010fffe\U0010fffe", "\U0010fffe", "\U0010ffff \U0010fffd", "<|endoftext|><|endoftext|>x", "z" * 20_000 + " é'", "it's it're", "", None, " " * 70 + "\n\n\n"]
    texts = [f"{x or ''}{word} {x or ''}" for x in odd for word in ("", "plain", "words that Are new 12345")]
    library = Tokenizer.from_file(PATH)
    for together, places in ((512, 1 << 20), (3, 4), (1, 1)):
        monkeypatch.setattr(packing, "TOGETHER", together)
        monkeypatch.setattr(packing, "REMEMBERED", places)
        for at in (0, 1):
            got = [ids.tolist() for _, ids in packing.Encoder(PATH).encode(texts[at:])]
            assert got == [library.encode(x, add_special_tokens=False).ids for x in texts[at:]]
