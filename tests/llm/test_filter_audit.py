from collections import Counter
from itertools import permutations

from tessella.llm import filter_audit as fa

TEXTS = [
    "", None, "word " * 250, " ".join(f"w{i}" for i in range(250)), "ABC def", "x # y", "a" * 100 + "BB", "A\x0b\x1fb c",
    " ".join(f"W{i}$" for i in range(300)), "é" * 98 + "AB", "é" * 97 + "ABC", " ".join(f"u{i % 125}" for i in range(250)), " ".join(f"u{i % 124}" for i in range(250)),
]


def fails(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    out = ""
    out += "A" * (len(words) < 200)
    out += "B" * (100 * len(set(words)) < 50 * len(words))
    out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
    return out + "D" * any(c in text for c in "#$%&*|")


def plain(rows, good, bad):
    """Every order, filter after filter, over the rows themselves."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    facts = [(p or "", fails(t) + ("E" if i is not None and i > least[t or ""] else ""), i) for i, t, p in rows]
    out, total = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in facts}:
            left = [f for f in facts if f[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                own = [f for f in facts if f[0] == part and letter in f[1]]
                out[part, order, step] = [len(left), len(gone), len(own) - len(gone), sum(f[1] == letter for f in own), sum(f[2] in good for f in gone), sum(f[2] in bad for f in gone)]
                total[part, letter] += len(gone)
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_every_order_against_the_rows(spark):
    rows = [(i, t, ["x", "y", None, ""][i % 4]) for i, t in enumerate(TEXTS * 3)]
    # Repeated rows, a repeated id with another text, null ids, a hot text.
    rows += [rows[3], rows[3], (2, "other text", "x"), (None, TEXTS[3], "y"), (None, "A lone one", "y"), *((100 + i, "hot copy", "z") for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n", "2 AS part", "3 AS mask", "4 AS digest", "5 AS quality")
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 120, 3)] + [(4, None, None), (None, 1, 1), (0, 1, 0), (0, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "0 AS n")
    good, bad = ({m[0] for m in marks if m[k] == 1 and m[0] is not None} for k in (1, 2))
    got = sorted(map(tuple, fa.audit(docs, labels).collect()))
    assert got == plain(rows, good, bad)
    assert len(got) == 4 * 600 and sum(r[9] for r in got if r[1] == "ABCDE") == 120 * sum(bool(fails(t)) or i is not None and i > min(j for j, u, _ in rows if j is not None and (u or "") == (t or "")) for i, t, _ in rows)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(docs, labels).count() == 0
    one = fa.audit(spark.createDataFrame([(1, "x " * 500_000, "s")], docs.schema), labels)
    assert {tuple(r)[3:] for r in one.filter("filter_order = 'BACDE'").collect()} == {(0, 1, 0, 1, 0, 0, 120), (0, 0, 0, 0, 0, 0, 0)}


def test_other_numbers_of_filters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 2, 4, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in fa.orders(masks, "QR").collect()}
    assert got == {("QR", 1): (9, 2, 0, 0, 1, 1, 2), ("QR", 2): (5, 4, 2, 4, 0, 0, 10), ("RQ", 1): (5, 6, 0, 4, 1, 1, 10), ("RQ", 2): (5, 0, 2, 0, 0, 0, 2)}
