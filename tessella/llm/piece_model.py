"""Encoding and decoding under a SentencePiece model of merges, by a table over the prefixes of a text.

Under such a model every prefix of a text has one last token: the token that ends there, found by an
automaton over the vocabulary, and that stands next to the last token of the prefix before it.  Two
tokens may stand next to each other if merging their joined characters gives the two again.  The
table of last tokens is filled from left to right, and the ids are read from it from right to left.

Texts are cut into words between any two characters that no piece of the vocabulary holds next to each
other.  Words are numbered by their fingerprints, many texts at a time, and each is worked on once while
the worker remembers it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import pretokens
from tessella.llm.arrow_groups import slices
from tessella.llm.remembered import Remembered, strung

#: Fixed value of the file format: the character that stands for a space.
SPACE = "▁"
#: Words that a worker remembers (42 bytes each), and half as many pairs, which then begin anew: it costs time only.
REMEMBERED = 1 << 20
#: Words of more ids are not remembered.
LONG_WORD = 8
#: Code points that are worked on together.
CHUNK = 250_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and content of the fields of a protocol buffer message."""
    at = 0

    def whole() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = whole()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, whole()
        else:
            size = whole() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A model of merges with byte fallback whose text is taken as it is, as far as such a file says so.

    Normalisation other than by spaces, user-defined or unused pieces, and files without byte
    fallback are an error.
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        top = list(_fields(model.serialized_model_proto()))
        trainer = dict(_fields(next(v for f, v in top if f == 2)))
        normalizer = dict(_fields(next(v for f, v in top if f == 3)))
        kinds = [dict(_fields(v)).get(3, 1) for f, v in top if f == 1]
        # Kinds: 1 piece, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
        if trainer.get(3) != 2 or trainer.get(35) != 1 or {4, 5} & set(kinds):
            raise ValueError("only models of merges with byte fallback and plain pieces are handled")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("only models that keep a text's characters and spaces are handled")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        names = [model.id_to_piece(i) for i in range(len(kinds))]
        self.number = {names[i]: i for i, kind in enumerate(kinds) if kind == 1}
        ranks = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in self.number.values()}, reverse=True))}
        self.rank = {piece: ranks[model.get_score(i)] for piece, i in self.number.items()}
        self.byte = [names.index(f"<0x{b:02X}>") for b in range(256)]
        # Characters of pieces are symbols, be they pieces or not.
        self.alphabet = {c for piece in self.number for c in piece}
        self.outside = re.compile("([^" + re.escape("".join(sorted(self.alphabet))) + "])", re.DOTALL)
        # Of each token, whether it may stand after others.
        self.met: dict[str, dict[str, bool]] = {token: {} for token in {*self.number, *self.alphabet}}
        self.pairs = 0
        self.automaton = ahocorasick.Automaton()
        for token, met in self.met.items():
            self.automaton.add_word(token, (len(token), token, met))
        self.automaton.make_automaton()
        self.within = np.zeros(1 << 20, bool)
        for piece in self.number:
            self.within[self._pairs(pretokens.code_points(piece))] = True
        self.known = Remembered(REMEMBERED, LONG_WORD)
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte)}
        self.is_byte = np.isin(np.arange(len(names)), self.byte)
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        surface = [b"" if kind == 3 else unknown if kind == 2 else byte_of.get(i) or names[i].replace(SPACE, " ").encode() for i, kind in enumerate(kinds)]
        self.surface = pa.array(surface, pa.large_binary())
        self.control = np.array([kind == 3 for kind in kinds])
        self.spaced = np.array([kind == 1 and name.startswith(SPACE) for kind, name in zip(kinds, names, strict=True)])

    @staticmethod
    def _pairs(points: np.ndarray) -> np.ndarray:
        """A number below 2^20 for each two neighbours.  Others may have it too: then a word is not cut, which is as right."""
        return ((points[:-1] * np.uint32(0x9E3779B1)) ^ (points[1:] * np.uint32(0x85EBCA77))) >> np.uint32(12)

    def merged(self, text: str) -> list[str]:
        """A short text's symbols after all merges: best rank first, then leftmost."""
        symbols, rank, none = list(text), self.rank, len(self.rank)
        ranks = [rank.get(a + b, none) for a, b in pairwise(symbols)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank.get(symbols[i] + symbols[i + 1], none)
        return symbols

    def meet(self, before: str, token: str) -> bool:
        """Whether the tokens may stand next to each other (before: empty at the beginning)."""
        found = self.met[token].get(before)
        if found is None:
            if self.pairs > REMEMBERED // 2:
                for met in self.met.values():
                    met.clear()
                self.pairs = 0
            self.pairs += 1
            joined = before + token
            # Two that make a piece would have been merged.
            found = not (before and joined in self.rank) and self.merged(joined) == ([before, token] if before else [token])
            self.met[token][before] = found
        return found

    def last_tokens(self, word: str) -> list[str]:
        """The last token of each prefix of a word, shortest prefix first."""
        if not self.alphabet.issuperset(word):
            # A character of no piece stands for itself, and the words around it for themselves.
            parts = self.outside.split(word)
            return ["", *(t for part in parts if part for t in ([part] if self.outside.fullmatch(part) else self.last_tokens(part)[1:]))]
        last = [""] * (len(word) + 1)
        for upto, (size, token, met) in self.automaton.iter(word):
            if not last[upto + 1]:
                before = last[upto + 1 - size]
                fits = met.get(before)
                if fits or (fits is None and self.meet(before, token)):
                    last[upto + 1] = token
        if "" in last[1:]:
            raise ValueError(f"no last token for a prefix of {word[:40]!r}")
        return last

    def word_ids(self, word: str) -> list[int]:
        last, at, out = self.last_tokens(word), len(word), []
        while at:
            token = last[at]
            at -= len(token)
            number = self.number.get(token)
            out.extend([number] if number is not None else [self.byte[b] for b in reversed(token.encode())])
        return out[::-1]

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        found = [self.word_ids(word) for word in words]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _cut(self, text: str) -> Iterator[str]:
        """A text in parts of about CHUNK code points, cut only between words; a longer word is a part with what is before it."""
        at = 0
        while len(text) - at > 2 * CHUNK:
            stop, look = at + CHUNK, 1 << 10
            while True:
                cuts = np.flatnonzero(~self.within[self._pairs(pretokens.code_points(text[stop - 1 : stop + look]))])
                if len(cuts) or stop + look >= len(text):
                    break
                look *= 4
            stop = stop + int(cuts[0]) if len(cuts) else len(text)
            yield text[at:stop]
            at = stop
        if at < len(text):
            yield text[at:]

    def _chunk(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of each of some parts of texts."""
        joined = "".join(parts)
        points, upto = pretokens.code_points(joined), np.cumsum([len(x) for x in parts])
        start = np.ones(len(points), bool)
        start[1:] = ~self.within[self._pairs(points)]
        start[upto[:-1]] = True
        begin = np.flatnonzero(start)
        stop = np.append(begin[1:], len(points))
        codes, keys, where = pretokens.numbered(points, begin, stop)
        known = self.known.find(keys, lambda new: self._encoded([joined[begin[i] : stop[i]] for i in where[new]]))
        ids, before = strung(*known, codes)
        at = 0
        for end in before[np.searchsorted(begin, upto)].tolist():
            yield ids[at:end].tobytes()
            at = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers; null and empty texts have none."""
        rows: list[list[bytes]] = [[] for _ in texts]
        parts: list[str] = []
        owner: list[int] = []
        size = 0

        def work() -> None:
            nonlocal size
            for i, ids in zip(owner, self._chunk(parts) if parts else (), strict=True):
                rows[i].append(ids)
            parts.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in self._cut(self.prefix + text.replace(" ", SPACE)) if text else ():
                if size + len(part) > CHUNK:
                    work()
                if len(part) > 4 * CHUNK:
                    # Its code points need no arrays.
                    rows[i].append(np.array(self.word_ids(part), "<i4").tobytes())
                    continue
                parts.append(part)
                owner.append(i)
                size += len(part)
        work()
        return [b"".join(row) for row in rows]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each row of ids.  Bytes that are no UTF-8 become U+FFFD, each by itself."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.control)):
            raise ValueError("an id is outside the vocabulary")
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        rows = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), self.surface.take(pa.array(flat))), pa.scalar(b"", pa.large_binary()))
        # The space that encoding put before a text goes; controls before it have no text.
        first = np.zeros(len(size), bool)
        shown = np.flatnonzero(~self.control[flat])
        at = np.searchsorted(shown, ends - size)
        some = np.flatnonzero(at < len(shown))
        some = some[shown[at[some]] < ends[some]]
        first[some] = self.spaced[flat[shown[at[some]]]] & bool(self.prefix)
        out = []
        for i, (row, cut) in enumerate(zip(rows.to_pylist(), first.tolist(), strict=True)):
            data = row[1:] if cut else row
            try:
                out.append(data.decode())
            except UnicodeDecodeError:
                text = self._with_bad_bytes(flat[ends[i] - size[i] : ends[i]])
                out.append(text[1:] if cut else text)
        return pa.array(out, pa.string())

    def _with_bad_bytes(self, ids: np.ndarray) -> str:
        """Text of ids whose runs of bytes are not all UTF-8: each byte outside a whole character is one U+FFFD."""
        out, run = [], bytearray()
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i].as_py()
                continue
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("\ufffd")
                at += n
            run.clear()
            if i is not None:
                out.append(self.surface[i].as_py().decode())
        return "".join(out)


@functools.cache
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``docs`` (doc_id, text).

    ``path`` is a SentencePiece model that every executor can open; no begin or end ids are added, and
    special strings inside a text are ordinary text.  Null and empty texts have no ids.  Rows that
    repeat, or whose doc_id is null, each give a row.  Very long words take time and memory in
    proportion to their length.  An empty table gives no rows.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slices(batches):
            rows = model.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": ids})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that each row's ids stand for; no ids (or null) are the
    empty text, an id outside the vocabulary or a null one is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "text": model.decode(part.column("ids"))})

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``, encoded and decoded again."""
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(docs, path), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
