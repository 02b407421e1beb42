"""Ids that a worker remembers by fingerprint, looked up for many pieces of text at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Remembered:
    """The ids of pieces by their 64-bit fingerprints, in a table of fixed size.

    A fingerprint has one place in the table.  Of pieces that share a place the last one stays, and
    pieces of more than ``width`` ids have none; what is not there is encoded anew, so the size of
    the table costs time only.
    """

    def __init__(self, places: int, width: int) -> None:
        places = 1 << (places - 1).bit_length()
        self.mask = np.uint64(places - 1)
        self.keys = np.zeros(places, np.uint64)
        #: -1 for empty places.
        self.size = np.full(places, -1, np.int16)
        self.ids = np.zeros((places, width), "<u4")

    def find(self, keys: np.ndarray, encode: Callable[[list[int]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, size): the ids of the piece with fingerprint ``keys[i]``, all different, are
        ``pool[begin[i]:][:size[i]]``.

        ``encode`` is given the numbers i of pieces that are not known; it returns their ids, one
        after the other, and how many each has.
        """
        width = self.ids.shape[1]
        place = (keys & self.mask).astype(np.int64)
        new = np.flatnonzero((self.keys[place] != keys) | (self.size[place] < 0))
        pool, begin, size = self.ids[place].ravel(), np.arange(len(keys)) * width, self.size[place].astype(np.int64)
        if len(new):
            flat, count = encode(new.tolist())
            first = np.cumsum(count) - count
            begin[new], size[new] = len(pool) + first, count
            fits = np.flatnonzero(count <= width)
            fits = fits[np.unique(place[new[fits]], return_index=True)[1]]
            at = place[new[fits]]
            self.keys[at], self.size[at] = keys[new[fits]], count[fits]
            self.ids[at] = np.append(flat, np.zeros(width, "<u4"))[first[fits, None] + np.arange(width)]
            pool = np.concatenate([pool, flat])
        return pool, begin, size


def strung(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces ``codes`` one after the other, and how many there are before each and in all."""
    each = size[codes]
    upto = np.zeros(len(each) + 1, np.int64)
    np.cumsum(each, out=upto[1:])
    return pool[np.repeat(begin[codes] - upto[:-1], each) + np.arange(upto[-1])], upto
