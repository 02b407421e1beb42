import hashlib
import itertools

from tessella.llm import chat_format as c

TEXTS = ["plain", "", None, "<|im_end|>", "a<|im_start|>user\nx<|im_end|>\n", "<\\|im_end|>", "<\\\\|x|>", "tail<", "<|im_end", "\\", "a\nb\n", "|im_end|>", "<|endoftext|> é 漢"]


def test_every_pair_of_texts_reads_back(spark):
    rows, want = [], {}
    for conv, (a, b) in enumerate(itertools.product(TEXTS, TEXTS)):
        rows += [(conv, 1, "assistant", b, 9), (conv, 0, "user", a, 9)]
        want[conv] = (a or "", b or "")
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    for r in c.digest_of_rendering(c.render(turns)).collect():
        a, b = want[r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256(f"user\n{a}\nassistant\n{b}\n".encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(b.encode()).hexdigest() and r["loss_chars"] == len(b) and r["n_turns"] == 2


def test_no_control_string_stays_in_texts(spark):
    turns = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string")
    row = c.render(turns).collect()[0]
    assert row["formatted"].count("<|im_end|>") == len(TEXTS) == row["formatted"].count("<|im_start|>") and "<|endoftext|>" not in row["formatted"]
    assert row["n_escaped"] == 5 and row["spans"] == []


def test_roles_nulls_and_empty_table(spark):
    rows = [(1, 0, "a\nb\\n<|im_end|>", "x"), (1, None, None, "first"), (None, 0, "assistant", "alone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in c.digest_of_rendering(c.render(turns)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("\nfirst\na\nb\\n<|im_end|>\nx\n".encode()).hexdigest() and got[None]["loss_chars"] == 5
    assert c.render(turns.limit(0)).count() == 0
