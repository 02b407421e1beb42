"""What each of several filters removes, alone and in every order, by a subset-zeta transform.

Every row has a mask of the filters that it fails.  Rows are counted by part and mask; summing the
counts over all masks within a set of bits (one pass for each bit) tells how many rows fail nothing
else, so also how many survive every subset of filters.  A step of an order removes the difference
between two neighbouring subsets, of all rows as of those with a label.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import persist

#: Characters between words.
BLANK = r"[\x20\x09-\x0D]+"
#: More filters than this have too many orders to list.
MOST = 7


def word_filters(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone, true where it fails: A few words, B few different
    words, C many capitals, D a special character."""
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals * 100 > F.length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def text_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit 0: filter A, ... bit 4: E), n, good, toxic: rows of ``docs`` (doc_id, text,
    source), and how many of them are labelled so, for each combination.

    E fails a row whose text a smaller doc_id has too, in any part.  Null texts are empty ones, a null
    source is the part ''.  Rows that repeat a doc_id each count and none fails E by the other; a
    null doc_id is neither smaller nor greater than another.  A row is good or toxic if any row of
    ``labels`` (doc_id, quality, toxic) says 1.  Copies of a text are counted together before they
    are shuffled, and no join is on the text alone, so large groups of copies never meet in a task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = reduce(Column.bitwiseOR, (F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(word_filters(F.col("text")).values())))
    facts = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("mask"))
    facts = persist(facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit_facts")
    first = facts.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    whole = facts.join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)))
    whole = whole.join(marks, "doc_id", "left")
    marked = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return whole.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("is_good").alias("good"), marked("is_toxic").alias("toxic"))


def survivors(masks: DataFrame, letters: str, measures: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """part and, for each measure of ``masks`` (part, mask, the measures), an array: at place s the sum
    over the rows that survive the filters whose bits are set in s."""
    every = (1 << len(letters)) - 1
    rows = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("of"))

    def listed(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(every)), lambda m: F.coalesce(F.element_at("of", m)[c], F.lit(0).cast("long")))

    def summed(c: str, bit: int) -> Column:
        """Masks with the bit also get what the same mask without it has."""
        return F.transform(c, lambda n, m: F.when(m.bitwiseAND(bit) != 0, n + F.get(c, m - bit)).otherwise(n))

    lists = rows.select("part", *(listed(c).alias(c) for c in measures))
    # One projection for each pass keeps the expressions small.
    for i in range(len(letters)):
        lists = lists.select("part", *(summed(c, 1 << i).alias(c) for c in measures))
    return lists.select("part", *(F.reverse(c).alias(c) for c in measures))


def orders(masks: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    ``masks``: part, mask, n, good, toxic, one row for each part and mask; bit i of a mask belongs to
    letter i.  Every part that occurs has a row for every order and step; no rows give none.  Ties do
    not occur: counts do not depend on the order of rows.
    """
    k = len(letters)
    if not 1 <= k <= MOST or len(set(letters)) < k:
        raise ValueError(f"1 to {MOST} different letters are handled")
    every = (1 << k) - 1
    left = survivors(masks, letters)
    listed = F.explode(F.split(F.lit(",".join(map("".join, permutations(letters)))), ",")).alias("filter_order")
    rows = left.select("*", listed).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda letter: f"shiftleft(1, instr('{letters}', {letter}) - 1)"
    rows = rows.withColumns({
        "own": F.expr(bit("substring(filter_order, step, 1)")),
        "done": F.expr(f"aggregate(sequence(1, {k}), 0, (s, i) -> s | if(i < step, {bit('substring(filter_order, i, 1)')}, 0))"),
    })
    lost = lambda c, before, own: F.get(F.col(c), before) - F.get(F.col(c), before.bitwiseOR(own))
    own, done, none, others = F.col("own"), F.col("done"), F.lit(0), F.lit(every).bitwiseXOR(F.col("own"))
    # Of all orders, so many have just these filters before this one.
    ways = F.array(*(F.lit(factorial(bin(s).count("1")) * factorial(max(0, k - 1 - bin(s).count("1")))) for s in range(every + 1)))
    shapley = F.aggregate(F.sequence(none, F.lit(every)), F.lit(0).cast("long"), lambda a, s: a + F.when(s.bitwiseAND(own) == 0, F.get(ways, s) * lost("n", s, own)).otherwise(0))
    return rows.select(
        "part", "filter_order", "step", F.get("n", done.bitwiseOR(own)).alias("kept"), lost("n", done, own).alias("removed"),
        (lost("n", none, own) - lost("n", done, own)).alias("redundant"), lost("n", others, own).alias("unique_fails"),
        lost("good", done, own).alias("good_lost"), lost("toxic", done, own).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of :func:`orders` for the five text filters over ``docs``."""
    return orders(text_masks(docs, labels))
