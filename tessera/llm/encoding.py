"""Encoding of the whole corpus with a public byte-level BPE vocabulary, and streaming decoding.

The merges are compiled into a finite-state transducer over bytes. Its recogniser is the trie of all tokens,
entered anew at every byte, and determinised only as far as the corpus needs it: a state is the set of tokens
under way, named by the longest one, so there are never more states than places in the trie, however large
the corpus is. Two tokens may follow each other exactly if encoding their joined bytes gives these two tokens
again, and a sequence whose neighbours all may is the encoding of its bytes. So of the tokens that end at a
byte exactly one fits the one before it; a token is final as soon as no token under way begins before its
end, which bounds the lookahead by the longest token.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern by which the vocabulary's texts are split before merging, with blanks written out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern for texts of ASCII only.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
#: Pairs of tokens and pieces a worker keeps; beyond that it starts anew, so that its memory is bounded.
KEPT_PAIRS, KEPT_PIECES, LONGEST_KEPT_PIECE = 500_000, 300_000, 64
#: Bytes of a piece from which it is encoded as a stream.
LONG_PIECE = 2_048


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 of the token, blank, id, by line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Lazily determinised transducer from the bytes of one piece to token ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.up: list[tuple[int, int]] = [(0, 0)]
        self.depth: list[int] = [0]
        for t, i in ranks.items():
            at = 0
            for c in t:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                    self.up.append((at, c))
                    self.depth.append(self.depth[at] + 1)
                at = nxt
            self.token[at] = i
        self.shorter: list[int] = [-1] * len(self.child)
        self.shorter[0] = 0
        self.moves: list[dict[int, int] | None] = [None] * len(self.child)
        self.ends: list[tuple | None] = [None] * len(self.child)
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """Ids by merging the pair of lowest id again and again, of ids under ``below``: what the vocabulary
        defines. Quadratic, for the bytes of single tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, t: int) -> tuple[int, int]:
        """The two tokens of which the merges make ``t``; ``t`` itself twice if it is a byte."""
        got = self.halves.get(t)
        if got is None:
            parts = self.merged(self.bytes_of[t], t)
            got = self.halves[t] = (parts[0], parts[1]) if len(parts) == 2 else (t, t)
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether ``b`` may come right after ``a`` (-1: the start of a piece).

        Undoes the merges of both sides at their border, last one first: they may unless two parts that
        meet there would have been merged before the merge that hid them.
        """
        got = self.pairs.get((a, b))
        if got is not None:
            return got
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        if a < 0:
            got = self.merged(self.bytes_of[b]) == [b]
        else:
            left, right, limit, got = a, b, 1 << 60, True
            while True:
                both = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
                if both is not None and both < limit:
                    got = False
                    break
                lefts, rights = self._halves(left), self._halves(right)
                can_left, can_right = lefts[1] != left, rights[0] != right
                if can_left and (left > right or not can_right):
                    limit, left = left, lefts[1]
                elif can_right:
                    # of equal ids the left one was merged first, so here the border pair still wins a tie
                    limit, right = right + 1, rights[0]
                else:
                    break
        self.pairs[(a, b)] = got
        return got

    def _shorter(self, at: int) -> int:
        """The longest place in the trie that is a proper end of ``at``."""
        got = self.shorter[at]
        if got < 0:
            above, c = self.up[at]
            got = self.shorter[at] = self._move(self._shorter(above), c) if above else 0
        return got

    def _move(self, state: int, byte: int) -> int:
        known = self.moves[state]
        if known is None:
            known = self.moves[state] = {}
        got = known.get(byte)
        if got is None:
            got = self.child[state].get(byte)
            if got is None:
                got = self._move(self._shorter(state), byte) if state else 0
            known[byte] = got
        return got

    def _ends(self, state: int) -> tuple:
        """Tokens that end in ``state`` with their lengths, the longest first."""
        got, at = [], state
        while at:
            if (t := self.token[at]) >= 0:
                got.append((t, len(self.bytes_of[t])))
            at = self._shorter(at)
        self.ends[state] = out = tuple(got)
        return out

    def stream(self, data: Iterable[int], every: int = 1_024) -> Iterator[int]:
        """Ids of one piece of any length, as soon as they are final: what is held is ``every`` bytes and the longest
        token. No token under way begins before its state's depth, so whatever follows goes through one of the
        places from there on; the ids before the last place that all their ways have in common are final."""
        last, size, state = [-1], [0], 0
        for c in data:
            state = self._move(state, c)
            last.append(-2)
            size.append(0)
            i = len(last) - 1
            for t, n in self.ends[state] or self._ends(state):
                if n <= i and last[i - n] != -2 and self.may_follow(last[i - n], t):
                    last[i], size[i] = t, n
                    break
            if i >= every:
                open_ = {j for j in range(max(0, i - self.depth[state]), i + 1) if last[j] != -2}
                while len(open_) > 1:
                    j = max(open_)
                    open_.discard(j)
                    open_.add(j - size[j])
                at = open_.pop()
                if at:
                    yield from self._back(last, size, at)
                    last, size = last[at:], size[at:]
                    size[0] = 0
        yield from self._back(last, size, len(last) - 1)

    @staticmethod
    def _back(last: list[int], size: list[int], i: int) -> list[int]:
        out = []
        while i:
            if not size[i]:
                raise ValueError("the vocabulary lacks a byte")
            out.append(last[i])
            i -= size[i]
        out.reverse()
        return out

    def encode(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if len(data) > LONG_PIECE:
            return tuple(self.stream(data))
        last, size, state = [-1], [0], 0
        moves, ends, pairs = self.moves, self.ends, self.pairs
        for i, c in enumerate(data, 1):
            known = moves[state]
            nxt = known.get(c) if known else None
            state = self._move(state, c) if nxt is None else nxt
            for t, n in ends[state] or self._ends(state):
                before = last[i - n]
                if before == -2:
                    continue
                fits = pairs.get((before, t))
                if self.may_follow(before, t) if fits is None else fits:
                    last.append(t)
                    size.append(n)
                    break
            else:  # no token ends within this character's bytes
                last.append(-2)
                size.append(0)
        return tuple(self._back(last, size, len(data)))


class Encoder:
    """Ids of whole texts. Null and empty texts have no ids: both give an empty list."""

    def __init__(self, path: str) -> None:
        self.machine = Transducer(read_ranks(path))
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.any, self.ascii = regex.compile(PIECES).findall, re.compile(ASCII_PIECES).findall

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.pieces
        # the separators 1c-1f are blanks for neither pattern, so ASCII texts need no exception
        for w in self.ascii(text) if text.isascii() else self.any(text):
            t = known.get(w)
            if t is None:
                t = self.machine.encode(w.encode())
                if len(w) <= LONGEST_KEPT_PIECE:
                    if len(known) >= KEPT_PIECES:
                        known.clear()
                    known[w] = t
            out += t
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def encode_corpus(docs: DataFrame, text: str = "text", path: str | None = None, out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the ids of ``text`` as ``array<int>``; null and empty texts get an empty array.

    One narrow stage: no shuffle, each text is read once and whole. ``path`` names a rank file that all
    executors can read.
    """
    path = path or default_vocabulary()

    def ids(texts: pa.Array) -> pa.Array:
        enc = encoder(path).encode
        return pa.array([enc(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, F.arrow_udf(ids, "array<int>")(F.col(text)))


class Utf8Stream:
    """Incremental UTF-8 decoder: feed bytes in any portions, get the characters that are finished.

    The state is the number of continuation bytes still due, the allowed range of the next one and the bits
    so far. A byte that cannot go on gives U+FFFD once for the part before it and is then read anew.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.bits = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode()
        out = []
        for c in data:
            if self.due:
                if self.low <= c <= self.high:
                    self.bits = self.bits << 6 | c & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.bits))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if c < 0x80:
                out.append(chr(c))
            elif 0xC2 <= c <= 0xDF:
                self.due, self.bits = 1, c & 0x1F
            elif 0xE0 <= c <= 0xEF:
                self.due, self.bits = 2, c & 0x0F
                self.low, self.high = (0xA0 if c == 0xE0 else 0x80), (0x9F if c == 0xED else 0xBF)
            elif 0xF0 <= c <= 0xF4:
                self.due, self.bits = 3, c & 0x07
                self.low, self.high = (0x90 if c == 0xF0 else 0x80), (0x8F if c == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.due else ""
        self.__init__()
        return out


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes]) -> Iterator[str]:
    """Characters of ``ids`` as soon as they are complete; a token may end within a character, unknown ids are U+FFFD."""
    machine = Utf8Stream()
    for i in ids:
        if s := machine.feed(bytes_of.get(i, b"\xff")):
            yield s
    if s := machine.end():
        yield s


def decode_corpus(docs: DataFrame, ids: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids``; null gives null, an empty array the empty text, unknown ids U+FFFD."""
    path = path or default_vocabulary()

    def texts(lists: pa.Array) -> pa.Array:
        of = encoder(path).machine.bytes_of

        def one(x: list[int] | None) -> str | None:
            if x is None:
                return None
            return "".join(decode_stream(x, of))

        return pa.array([one(x) for x in lists.to_pylist()], pa.string())

    return docs.withColumn(out, F.arrow_udf(texts, "string")(F.col(ids)))

