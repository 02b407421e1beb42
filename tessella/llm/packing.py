"""Best-fit packing of tokenised documents into sequences: best two fit, over the whole corpus.

How many pieces of each length there are is all that the packing depends on, and lengths run from 1
to the capacity.  So the corpus is reduced to a histogram, the histogram is packed (best two fit,
with equal bins made in one step), and the resulting plan says for each length which ranks go to
which bins.  Pieces get their rank within their length from per-task counts and running offsets, and
find their bin by looking their rank up.  No group of pieces ever meets in a task, and the packing is
that of the whole corpus, not of shards.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer, pre_tokenizers

from tessella.llm import pretokens
from tessella.llm.arrow_groups import runs, slices
from tessella.llm.remembered import Remembered, strung
from tessella.llm.store import exclusive_offsets, persist

#: Text pieces whose ids a worker remembers (42 bytes each), and the most ids that one of them has.
REMEMBERED, WIDTH = 1 << 20, 8
#: Pieces of text that go through the library together, joined by a character that no text should hold.
TOGETHER, SEPARATOR = 512, "\U0010fffe"


class Encoder:
    """Ids of whole texts, each different pre-token going through the library once while it is remembered."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if len(special) > 1:
            raise ValueError("one special string at most is handled")
        self.special = special[0] if special else None
        self.seams = pretokens.Seams(path)
        # The same model, for pieces that are found already, with an id of its own between them.
        self.joined = Tokenizer.from_file(path)
        self.joined.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.joined.add_special_tokens([AddedToken(SEPARATOR, normalized=False)])
        self.between = self.joined.token_to_id(SEPARATOR)
        self.known = Remembered(REMEMBERED, WIDTH)

    def _together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some parts of pieces, one after the other, and how many each has."""
        text = SEPARATOR.join(parts)
        if text.count(SEPARATOR) == len(parts) - 1:
            (found,) = self.joined.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            between = ids == self.between
            return ids[~between], np.diff(np.flatnonzero(between), prepend=-1, append=len(ids)) - 1
        each = [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(parts, add_special_tokens=False)]
        return np.concatenate(each), np.array([len(x) for x in each])

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has; long ones are encoded between seams."""
        cut = [self.seams.cut(x) for x in pieces]
        parts = [x for some in cut for x in some]
        found = [self._together(parts[at : at + TOGETHER]) for at in range(0, len(parts), TOGETHER)]
        first = np.cumsum([0, *map(len, cut[:-1])])
        return np.concatenate([ids for ids, _ in found]), np.add.reduceat(np.concatenate([n for _, n in found]), first)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, ids), in order; a very long text comes in several parts."""
        for low, high, pieces in pretokens.split(texts, self.special):
            known = self.known.find(pieces.keys, lambda new, pieces=pieces: self._encoded([pieces.text(i) for i in new]))
            ids, upto = strung(*known, pieces.codes)
            at = 0
            for i, end in enumerate(upto[pieces.ends].tolist(), low):
                yield i, ids[at:end]
                at = end


@functools.cache
def encoder(path: str) -> Encoder:
    # Spark deals out the cores; the library's own threads would only hold memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def _documents(encode: Encoder, texts: list[str | None], end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """The ids of each text with the end id."""
    parts: list[np.ndarray] = []
    at = 0
    for i, ids in encode.encode(texts):
        if i != at:
            yield at, np.append(np.concatenate(parts), np.uint32(end_id)).astype("<u4")
            at, parts = i, []
        parts.append(ids)
    if parts:
        yield at, np.append(np.concatenate(parts), np.uint32(end_id)).astype("<u4")


def cut(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every document (stretch, doc_id, text): stretch, doc_id, piece, start, length,
    ids_crc32, and (part, rank): the task that made it and its place among the task's pieces of that
    stretch and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path), TaskContext.get().partitionId()
        seen: Counter[tuple[int, int]] = Counter()
        for batch in slices(batches):
            ids, stretch = batch.column("doc_id").to_pylist(), batch.column("stretch").to_pylist()
            rows: list[tuple] = []
            for i, tokens in _documents(encode, batch.column("text").to_pylist(), end_id):
                n = len(tokens)
                at, stop, piece = 0, n % capacity or min(n, capacity), 0
                while at < n:
                    kind = (stretch[i], stop - at)
                    rows.append((stretch[i], ids[i], piece, at, stop - at, zlib.crc32(tokens[at:stop].tobytes()), part, seen[kind]))
                    seen[kind] += 1
                    at, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("stretch", "doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(run, "stretch int, doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def plan(counts: np.ndarray) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best two fit on a histogram; counts[s]: how many pieces have length s, up to the capacity.

    Returns ([(length, first rank, how many, first bin, offset)], number of bins).  A bin is filled
    greedily, always with the longest piece that fits.  Then its shortest piece gives way to two
    unpacked pieces if two together use more of the gap it leaves; of all such pairs the two that
    leave least.  As many equal bins are made at once as the pieces allow.
    """
    capacity = len(counts) - 1
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    bins = 0
    while len(some := np.flatnonzero(left)):
        rest, room, filled = left.copy(), capacity, []
        while len(fits := some[: np.searchsorted(some, room, "right")]):
            fits = fits[rest[fits] > 0]
            if not len(fits):
                break
            size = int(fits[-1])
            take = int(min(rest[size], room // size))
            filled += [size] * take
            rest[size] -= take
            room -= take * size
        needed = left - rest
        if room and filled:
            smallest = filled[-1]
            pair = _two(rest, room + smallest)
            if sum(pair) > smallest:
                filled[-1:] = pair
                for size in pair:
                    needed[size] += 1
        hold = np.flatnonzero(needed)
        times = int((left[hold] // needed[hold]).min())
        at = 0
        for size in sorted(filled, reverse=True):
            out.append((size, int(used[size]), times, bins, at))
            used[size] += times
            left[size] -= times
            at += size
        bins += times
    return out, bins


def _two(rest: np.ndarray, room: int) -> tuple[int, ...]:
    """The two lengths of rest whose sum comes closest to room, at most room; () without any."""
    sizes = np.flatnonzero(rest[: room + 1])
    if not len(sizes):
        return ()
    place = np.searchsorted(sizes, room - sizes, "right") - 1
    # The partner is not longer than the first, and not the same piece.
    place = np.minimum(place, np.arange(len(sizes)))
    place = np.where((place == np.arange(len(sizes))) & (rest[sizes] < 2), place - 1, place)
    if not (place >= 0).any():
        return ()
    total = np.where(place >= 0, sizes + sizes[place], -1)
    best = int(np.argmax(total))
    return int(sizes[best]), int(sizes[place[best]])


def _plans(counts: DataFrame, capacity: int) -> np.ndarray:
    """Rows (stretch, length, first rank, how many, first bin, offset), sorted; bins are numbered over
    all stretches in their order.

    ``counts`` has a row for each stretch and length; each stretch is planned in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ("stretch",)):
            histogram = np.zeros(capacity + 1, np.int64)
            histogram[group["length"].to_numpy()] = group["n"].to_numpy()
            rows, bins = plan(histogram)
            stretch = group["stretch"][0].as_py()
            table = np.array([(stretch, *row, bins) for row in rows], np.int64)
            yield pa.record_batch([pa.array(c) for c in table.T], ["stretch", "length", "first", "times", "bin", "offset", "bins"])

    schema = ", ".join(f"{c} long" for c in ("stretch", "length", "first", "times", "bin", "offset", "bins"))
    found = counts.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(run, schema).toArrow()
    table = np.stack([found[c].to_numpy() for c in found.column_names], axis=1) if found.num_rows else np.zeros((0, 7), np.int64)
    table = table[np.lexsort((table[:, 2], table[:, 1], table[:, 0]))]
    stretches, where = np.unique(table[:, 0], return_index=True)
    before = np.cumsum(table[where, 6]) - table[where, 6]
    table[:, 4] += before[np.searchsorted(stretches, table[:, 0])]
    return table[:, :6]


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, stretch: Column | None = None) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are the end id alone.  Only documents
    of more than ``capacity`` tokens are cut; of their pieces all are full but the first, which may
    be shorter.  Repeated rows and rows with a null doc_id are each packed.  An empty table gives no
    rows.  Other columns are not read.  ``path`` is a tokenizer file that every executor can open.

    ``stretch`` gives each row the number of its stretch, for documents whose order matters: each
    stretch is packed by itself, and sequences are numbered in the order of stretches, so reading
    them by number follows the order of the documents from stretch to stretch.  There should be few:
    their plans, some rows for each length, are known to every task.  Without it the whole corpus is
    packed as one.
    """
    number = F.lit(0) if stretch is None else F.coalesce(stretch.cast("int"), F.lit(0))
    rows = docs.select(number.alias("stretch"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = persist(cut(rows, path, capacity, end_id), "pieces")
    dealt = persist(pieces.groupBy("stretch", "length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    # A plan has some rows for each length, whatever the corpus.
    order = _plans(dealt.groupBy("stretch", "length").agg(F.sum("n").alias("n")), capacity)
    kinds = order[:, 0] * (capacity + 1) + order[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("stretch").to_numpy() * np.int64(capacity + 1) + batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            bins, offset = np.empty(len(kind), np.int64), np.empty(len(kind), np.int64)
            by = np.argsort(kind, kind="stable")
            for mine in np.split(by, np.flatnonzero(np.diff(kind[by])) + 1):
                if len(mine):
                    own = order[slice(*np.searchsorted(kinds, [kind[mine[0]], kind[mine[0]] + 1]))]
                    row = own[np.searchsorted(own[:, 2], rank[mine], "right") - 1]
                    bins[mine], offset[mine] = row[:, 4] + rank[mine] - row[:, 2], row[:, 5]
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.record_batch([*keep.columns, pa.array(bins), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])

    by = ["stretch", "length", "part"]
    before = exclusive_offsets(dealt, ["stretch", "length"], "part", "n", "before").select(*by, "before")
    ranked = pieces.join(before, by).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("stretch", "doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
