"""Vectorised pre-tokenisation for byte-level BPE vocabularies.

Splits many whole texts at once into the pieces that the vocabulary's pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

gives, and numbers equal pieces, so that each different piece of a chunk is encoded once.  A special
string inside a text is a piece of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points that are worked on together; a longer text is cut where a piece surely ends.
CHUNK = 250_000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Pieces(NamedTuple):
    """codes: the number of each piece in order; ends: how many pieces texts 0..i have together;
    keys: a 64-bit fingerprint of each numbered piece; texts: the numbered pieces, on demand."""

    codes: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    joined: str
    starts: np.ndarray
    stops: np.ndarray

    def text(self, i: int) -> str:
        return self.joined[self.starts[i] : self.stops[i]]


@functools.cache
def classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P, np.uint64)), np.cumprod(np.full(n, _P_INV, np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin; first: where texts begin, none of them empty."""
    kind = classes()[points]
    n = len(points)
    head = np.zeros(n, bool)
    head[first] = True
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    last[n - 1] = True
    space = kind == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == 32
    word_next = np.zeros(n, bool)
    word_next[:-1] = ~space[1:]
    start = np.where(space, (before != SPACE) | (word_next & ~last), (before != kind) & ~after_blank) | head
    # 's and the like: an apostrophe that begins a piece and has a letter after it.
    quote = np.flatnonzero((points == 39) & start & ~last)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], np.where(last[quote + 1], 0, padded[quote + 2])
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        stop = quote + size
        start[stop[stop < n]] = True
    return start


#: What ends a piece whatever comes after: a letter before anything else, a number likewise, and
#: anything before white space.
_END = r"\p{L}(?=[^\p{L}])|\p{N}(?=[^\p{N}])|\S(?=\s)"
_NEXT, _LAST = regex.compile(_END), regex.compile(f"(?r){_END}")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _cut(text: str) -> Iterator[str]:
    """A text in parts of about CHUNK code points, cut only where a piece surely ends.  A run without
    such a place is a part of its own, however long."""
    at = 0
    while len(text) - at > 2 * CHUNK:
        found = _NEXT.search(text, at + CHUNK - 1)
        stop = found.end() if found else len(text)
        if stop - at > 2 * CHUNK and (found := _LAST.search(text, at, at + CHUNK)):
            stop = found.end()
        yield text[at:stop]
        at = stop
    yield text[at:]


def split(texts: list[str | None], special: str | None = None) -> Iterator[tuple[int, int, Pieces]]:
    """Pieces of ``texts``, chunk after chunk: (number of the first text, of the one after the last,
    pieces).  A very long text comes in several chunks with the same number."""
    parts: list[str] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        some = [text or ""]
        if special and text and special in text:
            some = [x for x in regex.split(f"({regex.escape(special)})", text) if x]
        for whole in some:
            for part in _cut(whole):
                if parts and size + len(part) > CHUNK:
                    yield _chunk(parts, owner, special)
                    parts, owner, size = [], [], 0
                if len(part) > 4 * CHUNK:
                    yield _unbroken(part, i)
                    continue
                parts.append(part)
                owner.append(i)
                size += len(part)
    if parts:
        yield _chunk(parts, owner, special)


def _unbroken(part: str, i: int) -> tuple[int, int, Pieces]:
    """The pieces of a long run, found one by one, so that its code points need no arrays."""
    edges = np.array([0, *(m.end() for m in _PIECE.finditer(part))], np.int64)
    keys = [int.from_bytes(hashlib.blake2b(part[a:b].encode(), digest_size=8).digest(), "little") for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return i, i + 1, Pieces(np.arange(len(keys)), np.array([len(keys)], np.int64), np.array(keys, np.uint64), part, edges[:-1], edges[1:])


class Seams:
    """Pairs of bytes that no token of a byte-level vocabulary has within it: no merge crosses them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        self.within = np.zeros((256, 256), bool)
        for token in vocabulary:
            data = [letters[c] for c in token if c in letters]
            self.within[data[:-1], data[1:]] = True

    def cut(self, piece: str, size: int = 1 << 12) -> list[str]:
        """A long piece in parts of about ``size`` bytes whose tokens together are the piece's own."""
        if len(piece) <= 4 * size:
            return [piece]
        data = piece.encode()
        raw = np.frombuffer(data, np.uint8)
        seams = np.flatnonzero(~self.within[raw[:-1], raw[1:]] & ((raw[1:] & 0xC0) != 0x80)) + 1
        cuts, at = [0], 0
        while (k := int(np.searchsorted(seams, at + size))) < len(seams):
            at = int(seams[k])
            cuts.append(at)
        return [data[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def numbered(points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each piece ``points[begin:stop]``, fingerprint of each number, first place of each)."""
    up, down = _powers(max(4 * CHUNK, 1 << int(len(points)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=total[1:])
        keys = (total[stop] - total[begin]) * down[begin]
        keys = _mixed(keys + (stop - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    codes, distinct = pd.factorize(keys)
    where = np.empty(len(distinct), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, np.asarray(distinct), where


def _chunk(parts: list[str], owner: list[int], special: str | None) -> tuple[int, int, Pieces]:
    low, high = owner[0], owner[-1] + 1
    joined = "".join(parts)
    sizes = np.array([len(x) for x in parts], np.int64)
    upto = np.cumsum(sizes)
    full = sizes > 0
    first = (upto - sizes)[full]
    if not len(first):
        nil = np.zeros(0, np.int64)
        return low, high, Pieces(nil, np.zeros(high - low, np.int64), nil.astype(np.uint64), "", nil, nil)
    points = code_points(joined)
    start = _starts(points, first)
    if special:
        for k in [k for k, x in enumerate(parts) if x == special]:
            start[upto[k] - sizes[k] + 1 : upto[k]] = False
    begin = np.flatnonzero(start)
    stop = np.append(begin[1:], len(points))
    codes, keys, where = numbered(points, begin, stop)
    ends = np.zeros(high - low, np.int64)
    np.maximum.at(ends, np.array(owner) - low, np.searchsorted(begin, upto))
    return low, high, Pieces(codes, np.maximum.accumulate(ends), keys, joined, begin[where], stop[where])
