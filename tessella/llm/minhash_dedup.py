"""Near-duplicate documents by a signature-coordinate inverted join.

Every document has the MinHash signature of its five-word shingles.  Documents whose sets are equal
are one class.  Classes are posted under pairs of coordinate and value.  Two signatures of K
coordinates that agree in T of them agree in one of any K - T + 1, so a class is posted only under
its K - T + 1 rarest pairs (prefix); the rest, among them what common passages bring about, make no
lists and are looked up in the signatures of candidates (skip).  Collisions in lists are counted; a
pair that they leave undecided is looked up, and pairs with T agreements are confirmed on their whole
shingle sets.

A list is not expanded into its pairs.  First each member is held against the list's smallest one,
which makes as many candidates as there are postings and joins groups of copies into components.
Then only the lists that still hold several components are gone through, block by block, for pairs
across components: first signatures, which leaves clusters of candidates, then the whole sets of
each cluster.  A pair of blocks gives a forest that connects what its links connect, so the rows
that leave a task never grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrow_groups import forest, runs, slices
from tessella.llm.components import connected_components
from tessella.llm.store import keep_rows, looked_up, persist, with_row_key

#: Coordinates of a signature, and how many must agree.  At a similarity of 0.75, 48 agree on
#: average, and fewer than 32 with a probability of 3e-6.
COORDINATES, MATCHES = 64, 32
PREFIX = COORDINATES - MATCHES + 1
WORDS = 5
#: Counters of the table that tells rare pairs from common ones; its size does not depend on the
#: data, and any value in it gives the same links.
SLOT_BITS = 20
#: Members of a list or cluster in a block; two blocks are compared with each other at once.
BLOCK = 512
#: Bytes of shingle sets in a block.
BLOCK_BYTES = 1 << 23
#: Bytes of text whose words are hashed at once.
SPAN = 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20_240_601)
_LETTER = _random.integers(1, 1 << 63, 256, np.uint64)
_MUL = _random.integers(1, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _random.integers(0, 1 << 63, COORDINATES, np.uint64)
_AT = _random.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        _powers[:] = [np.cumprod(np.full(size, p, np.uint64)) for p in (_P, pow(_P, -1, 1 << 64))]
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of ``data``, and where they begin."""
    raw = np.frombuffer(data, np.uint8)
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    begin, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    return mixed((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(np.uint64)), begin


def _spans(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > 2 * SPAN:
        cut = next((i for i in range(at + SPAN, len(data)) if _BLANK[data[i]]), len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles; of its whole sequence of
    words if it has fewer than five; none without words."""
    data = [(t or "").encode() for t in texts]
    at = 0
    while at < len(data):
        if len(data[at]) > SPAN:
            yield _set(np.concatenate([word_hashes(x)[0] for x in _spans(data[at])]))
            at += 1
            continue
        to, size = at, 0
        while to < len(data) and size + len(data[to]) <= SPAN:
            size += len(data[to]) + 1
            to += 1
        words, begin = word_hashes(b" ".join(data[at:to]))
        starts = np.cumsum([0, *(len(x) + 1 for x in data[at:to])])
        edges = np.searchsorted(begin, starts)
        runs = _runs(words)
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield np.unique(runs[lo : hi - WORDS + 1]) if hi - lo >= WORDS else _set(words[lo:hi])
        at = to


def _runs(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += words[i : i + n] * _AT[i]
    return mixed(total)


def _set(words: np.ndarray) -> np.ndarray:
    if len(words) >= WORDS:
        return np.unique(_runs(words))
    if not len(words):
        return np.zeros(0, np.uint64)
    return mixed((words * _AT[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate's hash over the set."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[i : i + 1024, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in slices(batches):
            sizes, one, two, signs = [], [], [], []
            for found in shingle_sets(batch.column("text").to_pylist()):
                sizes.append(len(found))
                one.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(mixed(found ^ np.uint64(_P)).sum(dtype=np.uint64).view(np.int64)))
                signs.append(signature(found).tobytes() if len(found) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("k"), *columns], ["doc_id", "k", "n", "h1", "h2", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, COORDINATES)


def _keys(signs: np.ndarray) -> np.ndarray:
    """One number for each pair of coordinate and value."""
    return mixed(signs + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(_P))


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(classes: DataFrame) -> np.ndarray:
    """About how many classes have a pair: counts of 2 ** SLOT_BITS slots over all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                total += np.bincount(_slots(_keys(_matrix(batch.column("sig")))).ravel(), minlength=1 << SLOT_BITS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["slot", "n"])

    summed = classes.select("sig").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(1 << SLOT_BITS, np.int32)
    table = summed.toArrow()
    out[table["slot"].to_numpy()] = np.minimum(table["n"].to_numpy(), np.iinfo(np.int32).max)
    return out


def _postings(classes: DataFrame) -> DataFrame:
    """(key, id, n): each class under its PREFIX rarest pairs."""
    count = classes.sparkSession.sparkContext.broadcast(_frequencies(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                keys = _keys(_matrix(batch.column("sig")))
                order = np.lexsort((keys, count.value[_slots(keys)]), axis=1)[:, :PREFIX]
                posted = np.take_along_axis(keys, order, 1).view(np.int64).ravel()
                each = [np.repeat(batch.column(c).to_numpy(), PREFIX) for c in ("id", "n")]
                yield pa.record_batch([pa.array(posted), *map(pa.array, each)], ["key", "id", "n"])

    return classes.select("id", "n", "sig").mapInArrow(run, "key long, id long, n long")


def _alike_in_size(a: str, b: str) -> F.Column:
    """Whether two sets of these sizes can reach the similarity."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in MATCHES coordinates.

    ``pairs`` has their collisions in the lists that were merged.  Where these are MATCHES already,
    they decide; otherwise the coordinates that made no lists are looked up.
    """
    known = pairs.filter(F.col("collisions") >= MATCHES).select("a", "b")
    open_ = persist(pairs.filter(F.col("collisions") < MATCHES).select("a", "b"), "open")
    signs = classes.select("id", "sig")
    # One class may be the smallest of very many lists.
    often = open_.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"))
    of_a = persist(often.join(signs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a"), "signatures")
    both = looked_up(open_, of_a, ["a"], "pairs").join(signs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            enough = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).sum(axis=1) >= MATCHES
            yield batch.select(["a", "b"]).filter(pa.array(enough))

    return known.unionByName(both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long"))


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the sorted hashes of each text's shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches):
                sets = [x.tobytes() for x in shingle_sets(batch.column("text").to_pylist())]
                yield pa.record_batch([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have a similarity of 0.75 or more.

    The pairs of one a are dealt out over tasks, each with its text once.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    used = persist(texts.join(ends, "id", "left_semi"), "candidates")
    shares = persist(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("shares", F.ceil(F.col("n") / BLOCK).cast("int")), "shares")
    dealt = looked_up(pairs, shares, ["a"], "n").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    first = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(used.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = dealt.join(used.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(first, ["a", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, ("text_a", "text_b")):
                first = batch.column("text_a").to_pylist()
                # Rows come sorted by a: its set is made once for all its rows in a part.
                new = [i for i, x in enumerate(first) if not i or x != first[i - 1]]
                own = shingle_sets([first[i] for i in new])
                fresh, linked, mine = set(new), [], None
                for i, other in enumerate(shingle_sets(batch.column("text_b").to_pylist())):
                    if i in fresh:
                        mine = next(own)
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    linked.append(shared > 0 and 100 * shared >= 75 * (len(mine) + len(other) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, by: str, room: F.Column) -> DataFrame:
    """Rows dealt out so that any two of a group meet in one task, which holds two blocks at most.

    ``room``: what share of a block a row takes.  Adds own (the row's block) and x, y (the pair of
    blocks, x the lower).
    """
    size = members.groupBy(by).agg(F.ceil(F.sum(room)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("rows"))
    dealt = looked_up(members, persist(size, "blocks"), [by], "rows").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other", "blocks")


def _candidates(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs, one from each block, across components and alike in size and signature."""
    own, n, part, ids = (group[c].to_numpy() for c in ("own", "n", "component", "id"))
    signs = _matrix(group["sig"].combine_chunks())
    left, right = np.flatnonzero(own == group["x"][0].as_py()), np.flatnonzero(own == group["y"][0].as_py())
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(left), 64):
        i = left[at : at + 64]
        ok = (part[i][:, None] != part[right]) & (100 * np.minimum(n[i][:, None], n[right]) >= 75 * np.maximum(n[i][:, None], n[right]))
        ok &= ids[i][:, None] != ids[right]
        if group["x"][0].as_py() == group["y"][0].as_py():
            ok &= i[:, None] < right
        a, b = np.nonzero(ok)
        a, b = i[a], right[b]
        for k in range(0, len(a), 1 << 16):
            enough = (signs[a[k : k + (1 << 16)]] == signs[b[k : k + (1 << 16)]]).sum(axis=1) >= MATCHES
            found.append((a[k : k + (1 << 16)][enough], b[k : k + (1 << 16)][enough]))
    nothing = np.zeros(0, np.int64)
    return tuple(np.concatenate([nothing, *(f[k] for f in found)]) for k in (0, 1))


def _edges(group: pa.Table, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A forest that connects what the links a - b of a group connect."""
    ids = group["id"].to_numpy()
    low = forest(a, b, len(ids))
    some = np.flatnonzero(low != np.arange(len(ids)))
    return pa.record_batch([pa.array(ids[some]), pa.array(ids[low[some]])], ["a", "b"])


def _agreeing_across(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges that connect all classes with agreeing signatures in one list but different components.

    ``members``: key, id, n, component.
    """
    rows = _blocks(members, "key", F.lit(1 / BLOCK)).join(classes.select("id", "sig"), "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("key", "x", "y")):
            yield _edges(group, *_candidates(group))

    return rows.mapInArrow(run, "a long, b long")


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the sets a[i] and b[i] have in common."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    # Many pairs of few sets: products of incidence matrices, a span of shingles at a time.
    which, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    names, code, often = np.unique(which, return_inverse=True, return_counts=True)
    row, code = row[often[code] > 1], code[often[code] > 1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros(len(a), np.int64)
    for low in range(0, len(names), 4096):
        some = slice(*np.searchsorted(code, (low, low + 4096)))
        if some.stop > some.start:
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[some], code[some] - low] = 1
            both = m @ m.T
            out += both[a, b].astype(np.int64)
    return out


def _linked_across(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges that connect all classes in one cluster of candidates whose whole sets are similar.

    ``members``: cluster, id, component.  Sets are compared where they stand, block by block; only
    the forest of the links leaves the task.
    """
    sets = persist(_sets(texts.join(members.select("id"), "id", "left_semi")), "sets")
    room = F.greatest(F.lit(1 / BLOCK), F.col("n") * 8 / BLOCK_BYTES)
    rows = _blocks(persist(members.join(classes.select("id", "n", "sig"), "id"), "members"), "cluster", room).join(sets, "id")
    rows = rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for group in runs(batches, ("cluster", "x", "y")):
                a, b = _candidates(group)
                if len(a):
                    ends, place = np.unique(np.concatenate((a, b)), return_inverse=True)
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["shingles"].take(pa.array(ends))]
                    i, j = place[: len(a)], place[len(a) :]
                    size = np.array([len(x) for x in sets])
                    shared = _shared(sets, i, j)
                    ok = (shared > 0) & (100 * shared >= 75 * (size[i] + size[j] - shared))
                    a, b = a[ok], b[ok]
                yield _edges(group, a, b)

    return rows.mapInArrow(run, "a long, b long")


def _decided(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """(doc_id, k, n, first) of every row, the keyed rows, and the name of their key.

    first is the (doc_id, k) of the first row that links reach from the row's text; null for rows
    that link with nothing because they have no words or no doc_id.
    """
    keyed, key = with_row_key(docs)
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("k"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    signed = persist(rows.mapInArrow(_signatures, f"doc_id long, k {kind}, n long, h1 long, h2 long, sig binary"), "signatures")
    some = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # Copies have one set; a group of them is one row here, however large.
    classes = some.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("rows"))
    # Numbers of written rows do not change.
    classes = persist(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    posted = _postings(classes)
    lists = posted.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    lists = lists.select("key", F.col("c.id").alias("a"), F.col("c.n").alias("m"))
    members = persist(posted.join(lists, "key"), "postings")

    own = classes.select(F.col("first.k").alias("k"), "id")
    texts = rows.select("k", "text").join(own, "k").select("id", "text")
    # Count collisions with each list's smallest member.
    stars = members.filter((F.col("id") != F.col("a")) & _alike_in_size("n", "m"))
    stars = stars.groupBy("a", F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("collisions"))
    links = persist(_confirmed(persist(_agreeing(persist(stars, "collisions"), classes), "pairs"), texts), "links")
    joined = persist(connected_components(links), "components")

    known = members.select("key", "id", "n").join(joined.withColumnRenamed("node", "id"), "id", "left")
    known = persist(known.withColumn("component", F.coalesce("component", "id")), "members")
    apart = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    across = persist(_agreeing_across(persist(known.join(apart.select("key"), "key", "left_semi"), "apart"), classes), "candidates")
    final = joined
    if not across.isEmpty():
        clusters = connected_components(across).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        clusters = clusters.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = _linked_across(persist(clusters, "clusters"), classes, texts)
        ties = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        final = persist(connected_components(ties), "components")

    parts = persist(final.join(classes.select(F.col("id").alias("node"), "first"), "node"), "parts")
    least = persist(parts.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("nodes")), "least")
    least = looked_up(parts.select("node", "component"), least, ["component"], "nodes").select(F.col("node").alias("id"), "least")
    of_class = classes.select("n", "h1", "h2", "id", "first", "rows").join(least, "id", "left")
    of_class = persist(of_class.select("n", "h1", "h2", "rows", F.coalesce("least", "first").alias("first")), "decided")
    columns = ["doc_id", "k", "n", "first"]
    found = looked_up(some.drop("sig"), of_class, ["n", "h1", "h2"], "rows").select(*columns)
    nothing = F.lit(None).cast(found.schema["first"].dataType).alias("first")
    return found.unionByName(signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", "k", "n", nothing)), keyed, key


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Words are lower-cased in A-Z only and stand between white space.  Documents are linked at a
    Jaccard similarity of 0.75 or more of their whole sets of five-word shingles; a text of one to
    four words has its whole sequence as its one shingle.  component_id is the smallest doc_id that
    links reach, kept is whether the row has it.

    Null texts and texts without words have no shingles and are linked with nothing.  A row with a
    null doc_id is linked with nothing, has a null component_id and is kept.  Rows that repeat a
    doc_id and its text each give the same row; rows with one doc_id and different texts are each
    judged by their own text and linked only if the texts are alike.  Very long texts are compared
    whole.  An empty table gives no rows.  Other columns are not read.
    """
    component = F.coalesce("first.doc_id", "doc_id")
    return _decided(docs)[0].select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, with all its columns.

    Of rows that repeat a doc_id within a group, one stays; rows with one doc_id and unlike texts are
    of different groups.  Rows without words (null and empty texts) and rows with a null doc_id stay.
    An empty table gives no rows.
    """
    decided, keyed, key = _decided(docs)
    kept = decided.filter(F.col("first").isNull() | (F.col("k") == F.col("first.k")))
    return keep_rows(keyed, key, kept.select(F.col("k").alias(key)))
