"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

Terms are all words of the examples, a bounded sample of labelled rows, and the words and beginnings
of words that mark toxic texts.  A term's weight is its inverse document frequency, counted over all documents (the
logarithm of the odds against having it); terms that do not tell toxic texts from others beyond
chance weigh a part of that, so that what a text is about does not drown what it is called.  How large
that part is, and whether repeated terms count by their logarithm or by their number, is taken from
a few fixed WEIGHTINGS by the loss of the examples' own scores, each judged without itself.  The
examples stand in an inverted index in blocks of like ones, each posting list with the largest
weight of each block.  A query adds these up to a bound for
every block, goes through the blocks of the highest bounds, and then through all that can still beat
the k-th best cosine found there, which gives the exact k nearest.  Their votes, weighted by
nearness against a prior, are calibrated on the sample, each example judged without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import batched, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow_groups import slices
from tessella.llm.minhash_dedup import MATCHES, shingle_sets, signature
from tessella.llm.store import persist

#: Labelled rows (those of smallest hash) that tell which terms mark toxic texts, and examples among
#: them, at most.
SAMPLE, EXAMPLES = 4000, 2000
#: Ways to weigh that a model chooses from: whether the occurrences of a term count by their logarithm,
#: and the weight of a term that marks nothing, against one that does.  The first suits long texts
#: with few marks, the second texts that tell by how often they have them.
WEIGHTINGS = ((True, 0.1), (False, 0.3))
#: Neighbours that vote, examples in a block of the index, blocks gone through first, and weight of
#: the prior.
NEAREST, BLOCK, FIRST, PRIOR = 15, 64, 4, 1.0
THRESHOLD = 0.7
#: Letters in the beginnings of words.
HEADS = (4, 5, 6)
_WORD = re.compile(r"\w+")
#: Texts longer than this are split into words one by one, so that the words need no room.
LONG = 1_000_000


def _split(text: str | None) -> Iterable[str]:
    low = (text or "").lower()
    return _WORD.findall(low) if len(low) < LONG else (m[0] for m in _WORD.finditer(low))


def words(text: str | None) -> Counter[str]:
    return Counter(_split(text))


def heads(word: str) -> list[str]:
    """The beginnings of a longer word, each with a star."""
    return [word[:n] + "*" for n in HEADS if len(word) > n]


class Vocabulary(NamedTuple):
    """The terms by number: whole words, and marking beginnings of words (without their star), which
    are looked for in words that begin as one of them does."""

    word: dict[str, int]
    head: dict[str, int]
    first: frozenset[str]

    @classmethod
    def of(cls, terms: list[str]) -> Vocabulary:
        head = {t[:-1]: i for i, t in enumerate(terms) if t[-1:] == "*"}
        return cls({t: i for i, t in enumerate(terms) if t[-1:] != "*"}, head, frozenset(h[: HEADS[0]] for h in head))

    def __len__(self) -> int:
        return len(self.word) + len(self.head)

    def _occurrences(self, text: str | None) -> np.ndarray:
        """The terms of a text, each as often as it occurs."""
        parts, number, head, first, size = [], self.word.get, self.head.get, self.first, HEADS[0]
        for own in batched(_split(text), 1 << 16):
            parts.append(np.fromiter(map(number, own, repeat(-1)), np.int64, len(own)))
            begun = [w for w in own if w[:size] in first] if first else []
            if begun:
                parts.append(np.array([head(w[:n], -1) for w in begun for n in HEADS if len(w) > n] or [-1], np.int64))
        every = np.concatenate([np.zeros(0, np.int64), *parts])
        return every[every >= 0]

    def found(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, in order, and how often each occurs."""
        which, often = np.unique(self._occurrences(text), return_counts=True)
        return which, often.astype(np.float64)

    def present(self, text: str | None) -> np.ndarray:
        """The terms of a text."""
        return np.unique(self._occurrences(text))


class Index(NamedTuple):
    """Posting lists of the examples' unit vectors.

    Term t has the entries from entry[t] to entry[t + 1], one for each block that has it: the block,
    the largest weight there, and where its postings (example, weight) begin.
    """

    factor: np.ndarray  # of each term
    entry: np.ndarray
    block: np.ndarray
    top: np.ndarray
    start: np.ndarray
    row: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    base: float
    damped: bool = True

    def vector(self, which: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (1 + np.log(often) if self.damped else often) * self.factor[which]
        some = weight > 0
        which, weight = which[some], weight[some]
        return which, weight / math.sqrt(weight @ weight) if len(weight) else weight

    def nearest(self, which: np.ndarray, weight: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, nearest first, ties by doc_id; without one of
        the examples if its number is given.  Examples that share no term are no neighbours."""
        e, often = _ranges(self.entry[which], self.entry[which + 1])
        q, block = np.repeat(weight, often), self.block.take(e)
        bound = np.bincount(block, q * self.top.take(e), minlength=-(-len(self.ids) // BLOCK))
        rows, cosines, done = np.zeros(0, np.int64), np.zeros(0), bound <= 0
        for more in range(2):
            now = ~done
            if more:
                now &= (bound >= cosines[-1] - 1e-9) if len(rows) == NEAREST else now
            elif len(bound) > FIRST:
                now[np.argsort(-bound, kind="stable")[FIRST:]] = False
            some = np.flatnonzero(now.take(block))
            own = e.take(some)
            at, n = _ranges(self.start.take(own), self.start.take(own + 1))
            cosine = np.round(np.bincount(self.row.take(at), np.repeat(q.take(some), n) * self.weight.take(at), minlength=len(self.ids)), 12)
            if without >= 0:
                cosine[without] = 0
            if len(rows) == NEAREST:
                cosine[cosine < cosines[-1]] = 0
            fresh = np.flatnonzero(cosine)
            rows, cosines = np.append(rows, fresh), np.append(cosines, cosine[fresh])
            order = np.lexsort((self.ids[rows], -cosines))[:NEAREST]
            rows, cosines = rows[order], cosines[order]
            done |= now
        return rows, cosines

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines / (0.1 + 1 - np.minimum(cosines, 1))
        return float((weight @ self.toxic[rows] + PRIOR * self.base) / (weight.sum() + PRIOR))


class Model(NamedTuple):
    """Everything that scoring needs; its size is bounded by the texts of EXAMPLES rows."""

    vocabulary: Vocabulary
    index: Index
    slope: float
    shift: float

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The score of a text, and the doc_ids of the examples that speak for it."""
        rows, cosines = self.index.nearest(*self.index.vector(*self.vocabulary.found(text))) if len(self.index.ids) else (np.zeros(0, np.int64), np.zeros(0))
        return _logistic(self.slope * _logit(self.index.vote(rows, cosines)) + self.shift), self.index.ids[rows].tolist()


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each low to its high, one after the other, and how many each has."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through (x, y), with a mild pull towards (1, 0)."""
    w = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (p - y) + 0.1 * (w - np.array([1.0, 0.0]))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _loss(curve: tuple[float, float], x: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of a logistic curve at (x, y)."""
    z = np.clip(curve[0] * x + curve[1], -40, 40)
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _distinct(sample: DataFrame) -> list[int]:
    """doc_ids of the sample without near copies, of which the first stays.

    A text that was copied many times would make each of its words look like a mark.  The sample is
    bounded by SAMPLE, so its signatures are compared here; texts without words are all kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                signs = [signature(x).tobytes() if len(x) else None for x in shingle_sets(batch.column("text").to_pylist())]
                yield pa.record_batch([batch.column("doc_id"), pa.array(signs, pa.binary())], ["doc_id", "sig"])

    rows = sample.select("doc_id", "text").mapInArrow(run, "doc_id long, sig binary").orderBy("doc_id").collect()
    kept, posted = [], {}
    for row in rows:
        if row["sig"] is None:
            kept.append(row["doc_id"])
            continue
        own = np.frombuffer(row["sig"], np.uint64)
        met = Counter(i for pair in enumerate(own.tolist()) for i in posted.get(pair, ()))
        if not met or max(met.values()) < MATCHES:
            for pair in enumerate(own.tolist()):
                posted.setdefault(pair, []).append(row["doc_id"])
            kept.append(row["doc_id"])
    return sorted(set(kept))


def _marking(sample: DataFrame, n1: int, n0: int) -> list[str]:
    """The words and beginnings of words that mark toxic texts.

    A term's likelihood ratio must exceed what chance alone gives the luckiest of all terms tried,
    2 ln(number of terms), so that a larger vocabulary lets no more terms through that mark nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set(words(text))
                seen[toxic].update(own.union(*map(heads, own)))
        terms = list(seen[0] | seen[1])
        yield pa.record_batch([pa.array(terms, pa.string()), *(pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "a", "b"])

    counted = sample.select("text", "toxic").mapInArrow(run, "term string, a long, b long")
    counted = persist(counted.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "term-counts")
    least = 2 * math.log(max(2, counted.count()))

    def part(seen: F.Column, total: F.Column, share: float) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / (total * share))).otherwise(0.0)

    both, n = F.col("a") + F.col("b"), n1 + n0
    ratio = 2 * (
        part(F.col("a"), both, n1 / n) + part(F.col("b"), both, n0 / n)
        + part(n1 - F.col("a"), n - both, n1 / n) + part(n0 - F.col("b"), n - both, n0 / n)
    )
    marks = counted.filter((F.col("a") * n > both * n1) & (F.round(ratio, 9) > least))
    return sorted(r["term"] for r in marks.select("term").collect())


def _words_of(examples: DataFrame) -> set[str]:
    """All words of the examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(set().union(*(words(t) for t in batch.column("text").to_pylist())), pa.string())], ["word"])

    return set(examples.select("text").mapInArrow(run, "word string").distinct().toArrow()["word"].to_pylist())


def _document_frequency(rows: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many documents there are.

    Each task counts in an array of the vocabulary's size; arrays are added up in 16 groups.
    """
    size = len(vocabulary) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total[vocabulary.present(text)] += 1
            total[-1] += batch.num_rows
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % 16]), pa.array([total.tobytes()])], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.record_batch([pa.array([total.tobytes()])], ["counts"])

    parts = rows.select("text").mapInArrow(count, "part long, counts binary").repartition(16, "part").select("counts")
    total = np.zeros(size, np.int64)
    for x in parts.mapInArrow(add, "counts binary").toArrow()["counts"]:  # 16 arrays
        total += np.frombuffer(x.as_buffer(), np.int64)
    return total[:-1], int(total[-1])


def _features(sample: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [vocabulary.found(text) for text in batch.column("text").to_pylist()]
            which, often = (pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.float64())))
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), which, often], ["doc_id", "toxic", "which", "often"])

    return sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, which array<long>, often array<double>")


def _indexed(examples: pa.Table, factor: np.ndarray, base: float, damped: bool = True) -> Index:
    """The index of examples (doc_id, toxic, which, often), like ones in the same blocks."""
    none = np.zeros(0, np.int64)
    index = Index(factor, np.zeros(len(factor) + 1, np.int64), none, np.zeros(0), np.zeros(1, np.int64), none, np.zeros(0), none, np.zeros(0), base, damped)
    ids, toxic = (examples[c].to_numpy() for c in ("doc_id", "toxic"))
    vectors = [index.vector(np.asarray(w.values), np.asarray(o.values)) for w, o in zip(examples["which"], examples["often"], strict=True)]
    often = np.bincount(np.concatenate([none, *(w for w, _ in vectors)]), minlength=len(factor))

    def like(i: int) -> tuple:
        """What puts examples of like terms together: the heaviest term and the most common one."""
        which, weight = vectors[i]
        if not len(which):
            return (-1, -1)
        return (int(which[weight.argmax()]) if weight.max() > 0.3 else -1, int(which[often[which].argmax()]))

    order = sorted(range(len(ids)), key=lambda i: (*like(i), int(ids[i])))
    ids, toxic, vectors = ids[order], toxic[order].astype(float), [vectors[i] for i in order]
    size = np.array([len(w) for w, _ in vectors], np.int64)
    term, row = np.concatenate([none, *(w for w, _ in vectors)]), np.repeat(np.arange(len(ids)), size)
    weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
    by = np.lexsort((row, term))
    term, row, weight = term[by], row[by], weight[by]
    block = row // BLOCK
    new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
    top = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
    entry = np.searchsorted(term[new], np.arange(len(factor) + 1))
    return index._replace(entry=entry, block=block[new], top=top, start=np.append(new, len(row)), row=row, weight=weight, ids=ids, toxic=toxic)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows that are not held out.

    ``docs``: doc_id, text.  ``labels``: doc_id, toxic (0 or 1); rows with a null in either are not
    used, and of several labels for a doc_id the largest counts.  Of several texts of a doc_id the
    longest is the example, and the last in order of equally long ones.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    labels = labels.agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    ids = rows.select("doc_id").join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    chosen = persist(ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "sample-ids")
    texts = F.max(F.struct(F.length("text").alias("size"), "text"))["text"].alias("text")
    sample = persist(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(texts).repartition(8, "doc_id"), "sample")  # at most SAMPLE ids
    kept = spark.createDataFrame([(i,) for i in _distinct(sample)], "doc_id long")
    sample = persist(sample.join(F.broadcast(kept), "doc_id"), "sample")
    n1, n0 = (sample.filter(F.col("toxic") == k).count() for k in (1, 0))
    base = (n1 + 0.5) / (n1 + n0 + 1)
    if not n1 + n0:
        return Model(Vocabulary.of([]), _indexed(pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int32()), "which": pa.array([], pa.list_(pa.int64())), "often": pa.array([], pa.list_(pa.float64()))}), np.zeros(0), base), 1.0, 0.0)
    marks = _marking(sample, n1, n0)
    examples = persist(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES).repartition(8, "doc_id"), "examples")
    marked = set(marks)
    terms = sorted(_words_of(examples) | marked)
    vocabulary = Vocabulary.of([t for t in terms if t[-1:] != "*"] + [t for t in terms if t[-1:] == "*"])
    terms = [*vocabulary.word, *(t + "*" for t in vocabulary.head)]
    frequency, n = _document_frequency(rows, vocabulary)
    # A term that more than half of all documents have says nothing and weighs nothing.
    rarity = np.maximum(0, np.log((n - frequency + 0.5) / (frequency + 0.5)))
    marking = np.array([t in marked for t in terms])
    features = _features(examples, vocabulary).toArrow()
    indexes = [_indexed(features, rarity * np.where(marking, 1.0, plain), base, damped) for damped, plain in WEIGHTINGS]
    held = spark.sparkContext.broadcast((vocabulary, indexes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, indexes = held.value
        places = [{doc: i for i, doc in enumerate(index.ids.tolist())} for index in indexes]
        for batch in slices(batches):
            votes: list[list[float]] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = vocabulary.found(text)
                votes.append([_logit(x.vote(*x.nearest(*x.vector(*found), without=place[doc]))) for x, place in zip(indexes, places, strict=True)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(votes, pa.list_(pa.float64()))], ["doc_id", "toxic", "votes"])

    votes = examples.select("doc_id", "text", "toxic").mapInArrow(judge, "doc_id long, toxic int, votes array<double>").orderBy("doc_id").toArrow()
    toxic = votes["toxic"].to_numpy().astype(float)
    each = np.array(votes["votes"].to_pylist())
    curves = [_platt(x, toxic) for x in each.T]
    best = int(np.argmin([round(_loss(curve, x, toxic), 9) for curve, x in zip(curves, each.T, strict=True)]))
    return Model(vocabulary, indexes[best], *curves[best])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row of ``docs`` (doc_id, text).

    Labels of rows whose crc32(doc_id) mod 3 is 1 are not learnt from.  evidence: doc_ids of the
    nearest labelled examples, nearest first, equally near ones by doc_id.  Texts that share no term
    with any example, null and empty ones among them, have no evidence and the score of the prior.
    Very long texts are read whole.  Rows that repeat and rows with a null doc_id (not held out) are
    each scored.  Without usable labels every score is 0.5.  An empty table gives no rows.  Other
    columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.score(text) for text in batch.column("text").to_pylist()]
            scores = np.array([f[0] for f in found])
            columns = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<long>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns.

    Null and empty texts and rows with a null doc_id are judged as in ``score``; repeated rows each
    stay or go; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([held.value.score(text)[0] < THRESHOLD for text in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
