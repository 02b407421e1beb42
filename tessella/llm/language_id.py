"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (with the edges of words) are counted in a fixed number of hashed
features.  The model is trained by follow-the-regularised-leader with elastic-net penalties on a
bounded sample for each language, in shards whose weights are averaged, and its temperature is then
set on sampled rows that were not trained on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import pretokens
from tessella.llm.arrow_groups import slices
from tessella.llm.store import persist

#: Hashed features, sampled rows for each language (those of smallest hash), shards and passes of
#: the training.  One sampled row in five sets the temperature.
FEATURES, SAMPLE, SHARDS, PASSES = 1 << 15, 1200, 4, 3
#: Follow-the-regularised-leader: rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
#: A model has this many languages at most; more are an error.
LANGUAGES = 512
#: Code points whose n-grams are counted at once.
SPAN = 1_000_000
UNKNOWN = "und"
_MUL = np.uint32(0x9E3779B1)


@functools.cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, 0 for what is no letter."""
    out = np.where(pretokens.classes() == pretokens.LETTER, np.arange(0x110000, dtype=np.uint32), np.uint32(0))
    for i in np.flatnonzero(out):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out.astype(np.uint32)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    x = (x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (x ^ (x >> np.uint32(15))) % np.uint32(FEATURES)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The features of the whole text, in order, and how often each occurs; None without letters."""
    found, total, seen = [], None, False
    text = text or ""
    for at in range(0, len(text), SPAN):
        # Two code points before and after the span: no n-gram is lost at its edges.
        low, part = min(at, 2), text[max(0, at - 2) : at + SPAN + 1]
        x = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        x = np.concatenate((np.zeros(3 - low, np.uint32), x, np.zeros(1 if at + SPAN >= len(text) else 0, np.uint32)))
        seen = seen or bool(x.any())
        # x[3:] are the span's own points: n-grams that end there, and with the edge after them.
        one, two, three = x[2:], x[1:-1], x[:-2]
        own = slice(1, None) if at + SPAN >= len(text) else slice(1, -1)
        a, b, c = one[own], two[own], three[own]
        pair, triple = (a > 0) | (b > 0), (b > 0) & ((a > 0) | (c > 0))
        found += [
            _hashed(a[a > 0] * _MUL + np.uint32(1)),
            _hashed((a[pair] * _MUL + b[pair]) * _MUL + np.uint32(2)),
            _hashed(((a[triple] * _MUL + b[triple]) * _MUL + c[triple]) * _MUL + np.uint32(3)),
        ]
        if len(text) > SPAN:
            # Of a long text only the sums are kept from span to span.
            more = np.bincount(np.concatenate(found), minlength=FEATURES)
            total, found = more if total is None else total + more, []
    if not seen:
        return None
    if total is None:
        return np.unique(np.concatenate(found), return_counts=True)
    which = np.flatnonzero(total)
    return which, total[which]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model(NamedTuple):
    """Bounded by FEATURES and LANGUAGES."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature, language; the last row is the bias
    temperature: float

    def logits(self, count: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        which, value = vector(*count, self.idf)
        return value @ self.weights[which] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        count = counts(text)
        if count is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(count) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def vector(which: np.ndarray, often: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value = (1 + np.log(often)) * idf[which]
    size = np.sqrt(value @ value)
    return which, value / size if size > 0 else value


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> np.ndarray:
    """Weights from rows of (features, values, language), seen PASSES times in their order."""
    z, n = np.zeros((FEATURES + 1, languages)), np.zeros((FEATURES + 1, languages))

    def weights(which: np.ndarray | slice) -> np.ndarray:
        pull = np.maximum(np.abs(z[which]) - L1, 0)
        return -np.sign(z[which]) * pull / ((BETA + np.sqrt(n[which])) / ALPHA + L2)

    for _ in range(PASSES):
        for features, values, language in rows:
            which, value = np.append(features, FEATURES), np.append(values, 1.0)
            w = weights(which)
            error = softmax(value @ w)
            error[language] -= 1
            g = value[:, None] * error
            sigma = (np.sqrt(n[which] + g * g) - np.sqrt(n[which])) / ALPHA
            z[which] += g - sigma * w
            n[which] += g * g
    return weights(slice(None))


def _document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each feature, over all rows; and the number of texts with letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if (count := counts(text)) is not None:
                    total[count[0]] += 1
                    total[-1] += 1
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    summed = rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    for row in summed.collect():  # FEATURES + 1 rows at most
        out[row["feature"]] = row["n"]
    return out[:-1], int(out[-1])


def sampled(rows: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages of ``rows`` (doc_id, text, lang), and of each the SAMPLE documents of smallest hash:
    doc_id, lang, place, text, shard, once each."""
    # Documents, not rows: one that repeats counts once, up to a hundredth or two, for which there is room below.
    many = persist(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.01).alias("rows")), "languages")
    languages = sorted(row["lang"] for row in many.limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # Those of smallest hash: all that can be among them are about twice as many, whatever a language's size.
    u = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    near = rows.select("doc_id", "lang", u.alias("u")).join(F.broadcast(many), "lang").filter(F.col("u") / float(1 << 63) * F.col("rows") < 2 * SAMPLE + 100)
    near = near.select("doc_id", "lang", "u").distinct()
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    ids = persist(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE), "sample-ids")
    # SAMPLE ids a language at most.
    sample = rows.join(F.broadcast(ids.select("doc_id", "lang", "place")), ["doc_id", "lang"])
    # One text of each document: its repeats meet in the tasks that read them.
    sample = sample.groupBy("doc_id", "lang", "place").agg(F.min("text").alias("text")).withColumn("shard", F.col("place") % (SHARDS * 5))
    return languages, persist(sample, "sample")


def fit(docs: DataFrame) -> Model:
    """A model from the texts and languages of rows that are not held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    frequency, n = _document_frequency(rows)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    languages, sample = sampled(rows)
    if not languages:
        return Model([], idf, np.zeros((FEATURES + 1, 0)), 1.0)
    number = {x: i for i, x in enumerate(languages)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in slices(batches):
            for doc, text, lang, shard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang", "shard")), strict=True):
                if (count := counts(text)) is not None:
                    shards.setdefault(shard % SHARDS, []).append((doc, *vector(*count, idf), number[lang]))
        for some in shards.values():
            some.sort(key=lambda r: (pretokens._mixed(np.array([r[0]], np.int64).view(np.uint64))[0], r[3]))
            w = train([r[1:] for r in some], len(languages))
            where = np.nonzero(w)
            columns = [pa.array(where[0]), pa.array(where[1]), pa.array(w[where] * len(some)), pa.array(np.full(len(where[0]), 0))]
            yield pa.record_batch(columns, ["feature", "language", "weight", "rows"])
            yield pa.record_batch([pa.array([-1]), pa.array([0]), pa.array([0.0]), pa.array([len(some)])], ["feature", "language", "weight", "rows"])

    # A range for each shard, so that each is trained in a task of its own.
    dealt = sample.filter(F.col("shard") >= SHARDS).withColumn("n", F.col("shard") % SHARDS).repartitionByRange(SHARDS, "n")
    trained = dealt.mapInArrow(learn, "feature long, language long, weight double, rows long")
    trained = trained.groupBy("feature", "language").agg(F.sum("weight").alias("weight"), F.sum("rows").alias("rows"))
    weights, total = np.zeros((FEATURES + 1, len(languages))), 0
    for row in trained.toArrow().to_pylist():  # FEATURES x LANGUAGES at most
        if row["feature"] < 0:
            total = row["rows"]
        else:
            weights[row["feature"], row["language"]] = row["weight"]
    model = Model(languages, idf, weights / max(1, total), 1.0)
    return model._replace(temperature=_temperature(sample, model, number))


def _temperature(sample: DataFrame, model: Model, number: dict[str, int]) -> float:
    """The temperature under which sampled rows that were not trained on are likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            logits, own = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if (count := counts(text)) is not None:
                    logits.append(model.logits(count).tolist())
                    own.append(number[lang])
            yield pa.record_batch([pa.array(logits, pa.list_(pa.float64())), pa.array(own, pa.int32())], ["logits", "own"])

    rows = sample.filter(F.col("shard") < SHARDS).mapInArrow(run, "logits array<double>, own int").collect()
    if not rows:
        return 1.0
    logits, own = np.array([r["logits"] for r in rows]), np.array([r["own"] for r in rows])
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(own)), own], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Rows whose crc32(doc_id) mod 4 is 2, and rows without a language or doc_id, are not learnt from.
    A document that repeats is learnt from once for each language, by its least text, so at most SAMPLE
    rows of a language are learnt from however often they come.  Very long texts are read whole, and
    equal hashes are told apart by doc_id.  Null texts and texts without a letter are ``und`` with
    score 0, as is every text if nothing can be learnt.  Repeated rows each give a row.  An empty
    table gives no rows.  Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [held.value.predict(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
