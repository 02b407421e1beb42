"""Expressions over descriptions, names and messages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella import dims

HIDDEN = "***REDACTED***"
DIRECTIONS = ("down", "left", "right", "up")


def mentions(text: Column, word: str) -> Column:
    """Whether a text has a word: as a whole word in ASCII, anywhere in scripts without spaces."""
    low = F.lower(text)
    return low.rlike(rf"\b{re.escape(word)}\b") if word.isascii() else low.contains(word)


def hits(text: Column, words: list[str]) -> Column:
    """array<string>: the words that a text has, in their order."""
    return F.array_compact(F.array(*(F.when(mentions(text, w), F.lit(w)) for w in words)))


def key_color(text: Column) -> Column:
    """The first key colour that no word of the text rules out; null if all are."""
    whens = [(F.size(hits(text, words)) == 0, color) for color, words in dims.KEY_COLORS.items()]
    return F.coalesce(*(F.when(ok, color) for ok, color in whens))


def moving(text: Column) -> Column:
    """How a figure moves by its description, biped if nothing tells."""
    return F.coalesce(*(F.when(F.size(hits(text, words)) > 0, kind) for kind, words in dims.MOVING.items()), F.lit("biped"))


def asymmetric(text: Column) -> Column:
    """array<string>: things that break symmetry and that the text does not negate.

    A mention counts unless one of the negations stands within the twelve characters before it; all
    mentions are tried.
    """
    low = F.lower(text)

    def one(word: str) -> Column:
        # What comes before each mention: the parts between mentions, put together from the left.
        parts = F.split(low, re.escape(word), -1)
        before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), word))
        free = lambda p: ~reduce(lambda a, b: a | b, (F.substr(p, F.greatest(F.length(p) - 11, F.lit(1)), F.lit(12)).contains(n) for n in dims.NEGATIONS))
        return F.when(low.contains(word), F.when(F.exists(before, free), F.lit(word)))

    return F.array_compact(F.array(*map(one, dims.ASYMMETRIC)))


def redacted(text: Column) -> Column:
    """A text without keys and tokens."""
    return reduce(lambda t, x: F.regexp_replace(t, x[0], x[1] + HIDDEN), dims.REDACTIONS, text)


def without(text: Column, secrets: list[str]) -> Column:
    """A text without given secrets, the longest replaced first."""
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(HIDDEN)), sorted(secrets, key=lambda s: (-len(s), s)), text)


def action_of(key: Column) -> Column:
    """struct<action, direction> of a key like walk_left; a last part that is no direction stays."""
    tail = F.substring_index(key, "_", -1)
    ok = tail.isin(*DIRECTIONS) & key.contains("_")
    return F.struct(F.when(ok, F.substr(key, F.lit(1), F.length(key) - F.length(tail) - 1)).otherwise(key).alias("action"), F.when(ok, tail).alias("direction"))


def swapped(text: Column) -> Column:
    """A text with left and right exchanged."""
    out = text
    for a, b in (("left", "right"), ("Left", "Right"), ("LEFT", "RIGHT")):
        out = F.replace(F.replace(F.replace(out, F.lit(a), F.lit("\x00")), F.lit(b), F.lit(a)), F.lit("\x00"), F.lit(b))
    return out


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes; null if it leaves its folder."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(~p.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|^$"), p)


def job_id(asset: Column, kind: Column, action: Column, direction: Column) -> Column:
    return F.concat_ws(":", asset, kind, action, direction)
