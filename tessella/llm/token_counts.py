"""Token counts by byte-pair merging with a heap and a linked list.

Each different piece of text is merged once for each worker: its bytes stand in a doubly linked
list, the adjacent pairs with a rank in a heap; the pair of lowest rank, leftmost first, is popped
and merged until none is left.  A piece has as many tokens as it had bytes, less the merges.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import pretokens
from tessella.llm.arrow_groups import slices

#: Counts of pieces that a worker remembers; beyond it begins anew, which costs time only.
REMEMBERED = 300_000


class Merger:
    """Counts the tokens of pieces under the merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = pretokens.byte_letters()
        number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            new = number.setdefault(a + b, len(number))
            self.pairs[number[a], number[b]] = (rank, new)
        special = [x["content"] for x in spec["added_tokens"]]
        if len(special) > 1:
            raise ValueError("one special string at most is handled")
        self.special = special[0] if special else None
        self.seams = pretokens.Seams(path)
        self.known: dict[int, int] = {}

    def count(self, piece: str) -> int:
        """The number of tokens of a piece.  A long one is merged between seams that no merge crosses."""
        if piece == self.special:
            return 1
        return sum(map(self._merged, self.seams.cut(piece)))

    def _merged(self, piece: str) -> int:
        data = piece.encode()
        n = len(data)
        held = list if n < 1 << 12 else functools.partial(array, "q")
        pairs, symbol = self.pairs, held(iter(data))
        after, before = held(range(1, n + 1)), held(range(-1, n - 1))
        # One number for rank and place; the pair is read again when its turn comes.
        heap = [(found[0] << 40) | i for i in range(n - 1) if (found := pairs.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n or (found := pairs.get((symbol[i], symbol[j]))) is None or found[0] != top >> 40:
                continue
            merges += 1
            new = found[1]
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0] << 40) | i)
            if (h := before[i]) >= 0 and (found := pairs.get((symbol[h], new))):
                heapq.heappush(heap, (found[0] << 40) | h)
        return n - merges

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for low, high, pieces in pretokens.split(texts, self.special):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            known, each = self.known, []
            for i, key in enumerate(pieces.keys.tolist()):
                n = known.get(key)
                if n is None:
                    n = known[key] = self.count(pieces.text(i))
                each.append(n)
            total = np.zeros(len(pieces.codes) + 1, np.int64)
            np.cumsum(np.array(each, np.int64)[pieces.codes], out=total[1:])
            out[low:high] += np.diff(total[pieces.ends], prepend=0)
        return out


@functools.cache
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``path`` is a tokenizer file of byte-level BPE that every executor can open.  Null and empty
    texts have no bytes and no tokens.  Rows that repeat, or whose doc_id is null, each give a row.
    A special string inside a text is one token.  Very long texts are worked on in parts, and very long
    pieces between seams, without a change of result.  An empty table gives no rows.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merger(path)
        for batch in slices(batches):
            tokens = count.counts(batch.column("text").to_pylist())
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
