"""Evaluation texts that appear, whole or in part, inside training text.

Pigeonhole matching on words: an item split into ``e + 1`` pieces that stands in a text with at most ``e``
edits has at least one piece unchanged there. Pieces are cut end to end, and short enough that every passage
of ``min_words`` words, with up to ``budget`` edits in it, holds a whole unchanged one too: six words for an
unchanged passage of twelve, so an item of 54 words has nine pieces and an error budget of eight. One Aho-Corasick pass over
a document finds all piece hits; each hit is verified with Myers' bit-parallel distance: of the passages of
``min_words`` words through the hit, which decides whether the document leaks the item (``budget`` edits at most),
and of the whole item against the words around the hit. The longest exact run through the hit is measured too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Items whose pieces one automaton holds. The items are read in portions of this size, each with its own pass
#: over the documents, so that what a worker holds is bounded for any number of items.
ITEMS_AT_ONCE = 50_000
LEAKS_TYPE = "array<struct<item_id:bigint,words:int,matched:int,distance:int,passage:int>>"


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """Least number of word edits between ``pattern`` and any part of ``text`` (Myers 1999, one bit a word)."""
    m = len(pattern)
    if not m:
        return 0
    places: dict[str, int] = {}
    for i, w in enumerate(pattern):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = places.get(w, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diag | plus) & full
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # the text may begin anywhere: no cost enters at the top
        down = down << 1 & full
        across = eq | minus
        plus, minus = down | ~(across | up) & full, up & across
        if score < best:
            best = score
    return best


def piece_length(min_words: int, budget: int) -> int:
    """Longest piece such that any ``min_words`` words with ``budget`` edits hold a whole unchanged one.

    Pieces lie end to end from the item's start. A passage holds at least ``(min_words - p + 1) // p`` whole
    pieces of length ``p``, and ``budget`` edits spoil at most as many.
    """
    p = 1
    while (min_words - (p + 1) + 1) // (p + 1) >= budget + 1:
        p += 1
    return p


class Matcher:
    """Finds passages of a portion of items in texts."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int, budget: int) -> None:
        import ahocorasick

        self.min_words, self.budget = min_words, budget
        self.items = [(i, words(t)) for i, t in items]
        p = self.piece = piece_length(min_words, budget)
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) >= min_words:
                for s in range(0, len(w) - p + 1, p):
                    at.setdefault(" " + " ".join(w[s : s + p]) + " ", []).append((k, s))
        self.machine = ahocorasick.Automaton()
        for piece, where in at.items():
            self.machine.add_word(piece, (len(piece), where))
        if at:
            self.machine.make_automaton()
        self.empty = not at

    def find(self, text: str | None) -> list[dict]:
        if self.empty or not text:
            return []
        doc = words(text)
        if len(doc) < self.min_words - self.budget:
            return []
        line = " " + " ".join(doc) + " "
        starts = list(accumulate((len(w) + 1 for w in doc), initial=1))  # where each word begins
        best: dict[int, tuple[int, int, int]] = {}
        done: set[tuple[int, int]] = set()
        for end, (size, where) in self.machine.iter(line):
            place = bisect_left(starts, end - size + 2)
            for k, s in where:
                item = self.items[k][1]
                n = len(item)
                run, d, near = best.get(k, (0, n, self.min_words))
                # a passage that is as it should be can't be bettered
                near = near and min(near, self.passage(item, doc, s, place))
                if (k, place - s) not in done:  # the rest is the same for all hits that lie alike
                    done.add((k, place - s))
                    slack = max(self.budget, n // 4)
                    low, high = max(0, place - s - slack), min(len(doc), place - s + n + slack)
                    run, d = max(run, longest_run(item, doc, place - s)), min(d, myers_distance(item, doc[low:high]))
                best[k] = (run, d, near)
        return [{"item_id": self.items[k][0], "words": len(self.items[k][1]), "matched": r, "distance": d, "passage": p} for k, (r, d, p) in sorted(best.items())]

    def passage(self, item: list[str], doc: list[str], s: int, place: int) -> int:
        """Least edits of a passage of ``min_words`` words of the item through the piece at ``s``, whose hit is at ``place``."""
        m, best = self.min_words, self.min_words
        for first in range(max(0, s + self.piece - m), min(s, len(item) - m) + 1):
            at = place - (s - first)
            best = min(best, myers_distance(item[first : first + m], doc[max(0, at - self.budget) : at + m + self.budget]))
            if not best:
                break
        return best


def longest_run(item: list[str], doc: list[str], shift: int) -> int:
    """Most consecutive words that agree when word ``i`` of the item lies at ``i + shift`` of the document."""
    best = run = 0
    for i in range(max(0, -shift), min(len(item), len(doc) - shift)):
        run = run + 1 if item[i] == doc[i + shift] else 0
        if run > best:
            best = run
    return best


def _portions(items: DataFrame, size: int) -> Iterator[list[tuple[int, str | None]]]:
    portion: list[tuple[int, str | None]] = []
    for r in items.toLocalIterator():
        portion.append((r[0], r[1]))
        if len(portion) == size:
            yield portion
            portion = []
    if portion:
        yield portion


_matchers: dict = {}
_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("words", pa.int32()), ("matched", pa.int32()), ("distance", pa.int32()), ("passage", pa.int32())]))


def _finder(sent: Broadcast, key: str, min_words: int, budget: int):  # noqa: ANN202
    """A function that finds the items of a portion in texts; a worker builds its automaton once."""

    def leaks(texts: pa.Array) -> pa.Array:
        if key not in _matchers:
            while len(_matchers) > 1:
                _matchers.pop(next(iter(_matchers)))
            _matchers[key] = Matcher(sent.value, min_words, budget)
        find = _matchers[key].find
        return pa.array([find(x) for x in texts.to_pylist()], _FOUND)

    return leaks


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", question: str = "question", min_words: int = 12, budget: int = 0, items_at_once: int = ITEMS_AT_ONCE
) -> DataFrame:
    """Each document and item that share an unchanged piece: ``doc_id, item_id, words, matched, distance, passage``.

    ``words`` is the item's length, ``matched`` the longest run of consecutive words in common through a hit,
    ``distance`` the least number of word edits between the whole item and any part of the text around a hit.
    ``passage`` is the least number of word edits of any passage of ``min_words`` words of the item through a hit.
    Complete for shared runs of ``min_words`` words and for passages of that length with up to ``budget``
    edits. Null, empty and short texts and items (under ``min_words`` words) match nothing; repeated items
    and documents are each reported under their own id; no documents or no items give an empty result. The
    documents are read once for every ``items_at_once`` items and never shuffled.
    """
    import uuid

    parts = []
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    for portion in _portions(items.select(item_id, question), items_at_once):
        sent, key = docs.sparkSession.sparkContext.broadcast(portion), uuid.uuid4().hex

        parts.append(chosen.select("doc_id", F.arrow_udf(_finder(sent, key, min_words, budget), LEAKS_TYPE)("_text").alias("l")).select("doc_id", F.inline("l")))
    if not parts:
        return chosen.select("doc_id").limit(0).selectExpr("doc_id", "cast(null as bigint) item_id", "cast(null as int) words", "cast(null as int) matched", "cast(null as int) distance", "cast(null as int) passage")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leaked(docs: DataFrame, items: DataFrame, min_words: int = 12, budget: int = 0, **names: str) -> DataFrame:
    """``doc_id, item_id`` where a passage of ``min_words`` words of the item stands in the text with at most
    ``budget`` edits; without any, these are ``min_words`` or more consecutive words in common."""
    return find_leaks(docs, items, min_words=min_words, budget=budget, **names).where(F.col("passage") <= budget).select("doc_id", "item_id")
