"""Prompts whose answer is broken: empty, a copy of the prompt, a refusal, in another language, or cut off.

The models are fitted on the whole table in one pass, as counts that are summed before their shuffle:

* character 3-gram naive Bayes of the languages named in the table's own language column. Prompt and answer
  get a posterior for each sentence; the pair is defective if the language that most of the answer's letters
  are in differs from the prompt's and the prompt doesn't ask for it.
* the likelihood that a text ends after given last n-grams. The n-grams are of word shapes (word, capitalised
  word, number, each mark by itself, line break, start of text), so their number is bounded; whole short
  answers that recur count as n-grams of their own. A text that stops where texts hardly ever stop, or inside
  a code block or a JSON value, is truncated.
* log odds of words and pairs of words to stand in answers that only decline rather than in others
  (:class:`Refusals`). The only thing given is grammar: what a speaker calls themself and how a language negates.
  Answers of one sentence that has both start the model; it is then fitted again on what it finds, so that it
  learns the vocabulary of declining, and what else is said along with it, from the table. Words of the prompt say nothing.
* short answers that stand under prompts of all languages alike answer none of them: they stand in for nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ANSWER_ROLES, USER_ROLES, WORD, latest

GRAM_BITS = 16
#: Share of the labelled rows that a language of the model has at least.
LANGUAGE_SHARE = 0.005
#: A sentence counts for a language if its log odds against the next one are at least this.
SURE = 2.5
#: Words an answer needs to be judged by its language.
LEAST_WORDS = 4
#: Characters below which a prompt counts as a follow-up in the language of its conversation.
SHORT_PROMPT = 30
#: Chance of an end below which a text is cut off; occurrences an n-gram needs, and their share of all places.
END_CHANCE, LEAST_SEEN, SEEN_SHARE, LONGEST_SHAPE = 0.03, 20, 1e-7, 4
#: Words of a short answer, how often one recurs at least, and as what share of all answers.
SHORT_WORDS, SHORT_SEEN, SHORT_SHARE = 4, 5, 1e-5
#: A short answer stands in for nothing if it is seen under other languages than the commonest one about as often
#: as any answer is: expected occurrences there at least, and the largest G statistic for each degree of freedom.
STAND_IN_SEEN, STAND_IN_G = 4.0, 4.0
#: Buckets of words and of pairs of words; rounds of the refusal model; mean log odds of a sentence that declines and
#: of one that goes along; what a word counts that no refusal has; occurrences of a word that counts; what is added
#: to the log odds, of declining since at first most refusals are yet to be found, and of going along since an answer
#: that declines somewhere may say other things too.
WORD_BITS, REFUSAL_ROUNDS, DECLINES, GOES_ALONG, FOREIGN, REFUSAL_SEEN, EARLY, BESIDE = 18, 4, 0.5, 0.0, -2.0, 2, 4.0, 1.5

# What stands for no answer.
NOTHING = {"n/a", "na", "none", "null", "nan", "nil", "todo", "tbd", "blank", "empty", "no output", "no answer", "no response", "no content", "undefined", "missing", "placeholder"}
# Openings that only announce an answer or a quotation of the prompt.
HEADING = r"(?:response|answer|output|assistant|instruction|input|question|user|prompt|antwort|ausgabe|frage|réponse|sortie|question|respuesta|salida|pregunta)"
ANNOUNCED = re.compile(r"^(?:#+\s*)?(?:" + HEADING + r"|you asked|the question was|die frage war|du hast gefragt|la question(?: était)?|vous avez demandé|la pregunta(?: era)?|preguntaste)\s*:\s*", re.I)
ONLY_HEADING = re.compile(r"^(?:#+[^\n]*|\**" + HEADING + r"\**\s*:\s*\**)$", re.I)
# Grammar of four languages, by which a speaker speaks of themself or excuses themself, and negates.
SELF = frozenset("i i'm i'd i'll i've me my ich mir mich mein meine meiner je j'ai me m'est moi mon ma yo mi puedo debo tengo prefiero quiero voy estoy sorry apologies désolé désolée siento leid".split())
NEGATION = frozenset("not no cannot can't won't don't isn't wouldn't nor without unable never nothing nicht nichts kein keine ohne ne n'est n'ai n'y pas rien sans nada sin".split())
# Prompts that ask for a translation or for their own words.
ASKS_LANGUAGE = re.compile(
    r"\b(?:translat\w*|übersetz\w*|übertrag\w*|tradui\w*|traduc\w*|traduzca\w*)\b|\b(?:in(?:to)?|auf|ins|en|au|al|vers l[ea']) ?(?:the )?(?:english|german|french|spanish|englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b",
    re.I,
)
ASKS_COPY = re.compile(r"\b(?:repeat (?:the|this|these|my|after)|copy (?:the|this)|quote (?:the|this)|verbatim|word for word|without any change|wiederhol\w*|wortwörtlich|wörtlich|abschreib\w*|répète\w*|répétez|recopi\w*|mot pour mot|repite\w*|repita\w*|copia (?:el|la|este|esta)|palabra por palabra)\b", re.I)

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
TOKEN = re.compile(r"```|[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\n|[^\w\s]|_")
INVISIBLE = re.compile(r"[\s​‌‍⁠﻿­‎‏]+")


# ---- language ---------------------------------------------------------------------------------------------


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams of lower-cased texts one after another, and where each text's begin."""
    data = [b" " + t.lower().encode() + b" " for t in texts]
    ends = np.cumsum([0, *[len(d) for d in data]])
    b = np.frombuffer(b"".join(data) + b"  ", np.uint8).astype(np.uint32)
    codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (codes >> np.uint32(32 - GRAM_BITS)).astype(np.int64), ends


class Languages:
    """Naive Bayes over hashed 3-grams: ``score`` gives the log likelihoods of texts in each language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names, self.counts = names, counts
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts or not self.names:
            return np.zeros((len(texts), len(self.names)), np.float32)
        codes, ends = gram_codes(texts)
        return np.stack([np.add.reduceat(row[codes], ends[:-1]) for row in self.logs], 1)

    def of(self, texts: list[str | None]) -> list[tuple[int, float]]:
        """For each text the language most of its letters are in and that share; -1 if no sentence is sure."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            if t:
                for s in SENTENCE.split(FENCE.sub("\n", t)):
                    if len(s) > 3:
                        parts.append(s)
                        owner.append(i)
        out = [(-1, 0.0)] * len(texts)
        if not parts or len(self.names) < 2:
            return out
        ll = self.score(parts)
        two = np.partition(ll, -2, axis=1)[:, -2:]
        sure = two[:, 1] - two[:, 0] >= SURE
        best = ll.argmax(1)
        weight = np.zeros((len(texts), len(self.names)))
        letters = np.array([len(p) for p in parts])
        np.add.at(weight, (np.array(owner)[sure], best[sure]), letters[sure])
        total = weight.sum(1)
        for i in np.flatnonzero(total):
            k = int(weight[i].argmax())
            out[i] = (k, float(weight[i, k] / total[i]))
        return out


def language_names(labels: DataFrame) -> tuple[list[str], set[str]]:
    """The languages of the model, and labels that name a language too rare for it: labels (column ``language``) are
    taken without regard to case and blanks around; what is no code of two or three letters is none."""
    rows = labels.select(F.lower(F.trim("language")).alias("language")).where(F.col("language").rlike("^[a-z]{2,3}$")).groupBy("language").count()
    got = {r["language"]: r["count"] for r in rows.collect()}  # a row a code
    names = sorted(k for k, n in got.items() if n >= LANGUAGE_SHARE * sum(got.values()))
    return names, got.keys() - set(names)


# ---- words and shapes -------------------------------------------------------------------------------------

PLAIN, CAPITAL, NUMBER, CODE, LINE, START = 1, 2, 3, 4, 5, 6


class Marks:
    """Shape (16 bits) and word hash (0: no word) of tokens; kept for the tokens of a worker, up to a number."""

    def __init__(self, most: int = 300_000) -> None:
        self.kept: dict[str, tuple[int, int]] = {}
        self.most = most

    def of(self, text: str) -> list[tuple[int, int]]:
        kept, out = self.kept, []
        for t in TOKEN.findall(text):
            got = kept.get(t)
            if got is None:
                if len(kept) >= self.most:
                    kept.clear()
                got = kept[t] = self._mark(t)
            out.append(got)
        return out

    @staticmethod
    def _mark(t: str) -> tuple[int, int]:
        c = t[0]
        if c.isalpha():
            return (PLAIN if t.islower() else CAPITAL), word_hash(t.lower().replace("’", "'"))
        if c.isdigit():
            return NUMBER, 0
        if t == "```":
            return CODE, 0
        return (LINE, 0) if t == "\n" else (8 + ord(c) * 40503 % 65521, 0)


def word_hash(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w) >> 1 | 1


_marks = Marks()


def shape_codes(marks: list[tuple[int, int]]) -> np.ndarray:
    """Of each place of a text, from its start on, the last four shapes as one number."""
    x = np.array([START, *[m[0] for m in marks]], np.uint64)
    out = x.copy()
    for k in range(1, LONGEST_SHAPE):
        out[k:] |= x[:-k] << np.uint64(16 * k)
    return out.view(np.int64)


def pair_buckets(words: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words, which lie behind those of single words."""
    mixed = words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << WORD_BITS)


def word_buckets(words: np.ndarray) -> np.ndarray:
    return (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def _short(text: str) -> str | None:
    w = WORD.findall(text.lower())
    return " ".join(w) if 0 < len(w) <= SHORT_WORDS else None


class Ends:
    """Chance that a text ends after its last n-grams."""

    def __init__(self, grams: dict[int, tuple[int, int]], short: set[int]) -> None:
        self.grams, self.short = grams, short

    def chance(self, text: str) -> float:
        s = _short(text)
        if s and word_hash(s) in self.short:
            return 1.0
        # the end is enough: the start counts only where it is among the last marks
        last = _marks.of(text if len(text) <= 500 else text[-500:])
        code = int(shape_codes(last)[-1]) if len(text) <= 500 or len(last) > LONGEST_SHAPE else 0
        for k in range(LONGEST_SHAPE, 0, -1):
            part = code & (1 << 16 * k) - 1
            seen, ended = self.grams.get(part - (1 << 64) if part >> 63 else part, (0, 0))
            if seen >= LEAST_SEEN or (k == 1 and seen):
                return ended / seen
        return 1.0


# ---- refusals ---------------------------------------------------------------------------------------------


def said_words(sentence: str, of_prompt: frozenset[str] | set[str]) -> list[str]:
    """Words of a sentence; those of the prompt but for short and grammatical ones are all ``_``."""
    words = [t.lower().replace("’", "'") for t in TOKEN.findall(sentence) if t[0].isalpha()]
    return ["_" if len(w) > 3 and w in of_prompt and w not in SELF and w not in NEGATION else w for w in words]


def prompt_words(prompt: str | None) -> set[str]:
    return {t.lower().replace("’", "'") for t in TOKEN.findall(prompt) if t[0].isalpha()} if prompt else set()


_hashes: dict[str, int] = {}


def refusal_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words that say something, and of the pairs of such words that stand side by side."""
    if len(_hashes) > 200_000:
        _hashes.clear()
    h = np.array([_hashes.get(w) or _hashes.setdefault(w, word_hash(w)) for w in words], np.uint64)
    own = np.array([w != "_" for w in words], bool)
    return word_buckets(h[own]), pair_buckets(h)[own[:-1] & own[1:]] if len(h) > 1 else np.zeros(0, np.int64)


class Refusals:
    """Whether an answer only declines: every sentence declines or goes along with that, and one declines.

    ``declines``, ``along``: log odds by bucket; a sentence's score is their mean, with ``FOREIGN`` for
    words that no refusal has. No answer is too long: reading ends at the first sentence that says something.
    """

    def __init__(self, declines: np.ndarray, along: np.ndarray) -> None:
        self.declines, self.along = declines, along

    def scores(self, sentence: str, of_prompt: set[str]) -> tuple[float, float]:
        words = said_words(sentence, of_prompt)
        one, two = refusal_buckets(words)
        if not len(one):
            return FOREIGN, FOREIGN
        d, a = (float(x[one].sum() + x[two].sum()) / len(one) for x in (self.declines, self.along))
        return (d if len(words) > 1 else FOREIGN), a

    def judge(self, prompt: str | None, answer: str) -> tuple[bool, bool]:
        """Whether the answer only declines, and whether a sentence of it declines at all."""
        text = answer.strip()
        if not speaks_of_self(text):
            return False, False
        of_prompt, only, some = prompt_words(prompt), True, False
        for s in SENTENCE.split(text):
            if not WORD.search(s):
                continue
            d, a = self.scores(s, of_prompt)
            some |= d >= DECLINES
            if max(d, a) < GOES_ALONG:
                only = False
                break
        return only and some, some


def speaks_of_self(text: str) -> bool:
    return _SELF_TOKEN.search(text) is not None


_SELF_TOKEN = re.compile(r"\b(?:" + "|".join(re.escape(w).replace("'", "['’]") for w in sorted(SELF, key=len, reverse=True)) + r")\b(?!-)", re.I)


def log_odds(found: np.ndarray, everywhere: np.ndarray, more: float) -> np.ndarray:
    """Log odds of each bucket to stand in what was found rather than elsewhere; words no refusal has count ``FOREIGN``, pairs nothing."""
    half = 1 << WORD_BITS
    out = np.empty(2 * half, np.float32)
    for part, absent in ((slice(0, half), FOREIGN), (slice(half, 2 * half), 0.0)):
        c, rest = found[part], np.maximum(everywhere[part] - found[part], 0)
        odds = np.log(c + 0.5) - np.log(rest + 0.5) + more
        out[part] = np.where(c >= REFUSAL_SEEN, np.clip(odds, -4.0, 4.0), absent)
    return out


def _table(pairs: DataFrame, count, kind: str = "bigint") -> np.ndarray:  # noqa: ANN001
    """Sums of tables that ``count`` makes of the batches of a task; added up on the executors, by pieces."""
    pieces = 16

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.array_split(count(batches), pieces)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["piece", "sums"])

    return _pieces(pairs.mapInArrow(cut, f"piece int, sums array<{kind}>"))


def _pieces(tables: DataFrame) -> np.ndarray:
    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [f["piece"].iloc[0]], "sums": [np.sum(np.stack(f["sums"].to_list()), axis=0)]})

    got = tables.groupBy("piece").applyInPandas(add, "piece int, sums array<bigint>").toArrow().to_pylist()
    return np.concatenate([r["sums"] for r in sorted(got, key=lambda r: r["piece"])]) if got else np.zeros(0, np.int64)


def fit_refusals(pairs: DataFrame, everywhere: np.ndarray) -> Refusals:
    """From ``prompt, answer`` rows and the words of all answers (``everywhere``). Each round is one pass over the
    answers in which a speaker speaks of themself."""
    size = 2 << WORD_BITS
    spoken = pairs.select("prompt", "answer").where(F.col("answer").rlike("(?iu)" + _SELF_TOKEN.pattern)).persist(StorageLevel.MEMORY_AND_DISK)
    model: Refusals | None = None
    for _ in range(REFUSAL_ROUNDS):
        held = pairs.sparkSession.sparkContext.broadcast(model and (model.declines, model.along))

        def count(batches: Iterator[pa.RecordBatch], held=held) -> np.ndarray:
            found, along = np.zeros(size, np.int64), np.zeros(size, np.int64)
            known = held.value and Refusals(*held.value)
            for b in batches:
                for p, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    parts = [s for s in SENTENCE.split(a.strip()) if WORD.search(s)]
                    only = some = len(parts) == 1 and _may_decline(parts[0])
                    if known is not None and not only:
                        only, some = known.judge(p, a)
                    if some:
                        of_prompt = prompt_words(p)
                        for s in parts:
                            words = said_words(s, of_prompt)
                            if len(words) < 3:
                                continue
                            at = np.concatenate(refusal_buckets(words))
                            np.add.at(along, at, 1)
                            if only:
                                np.add.at(found, at, 1)
            return np.concatenate([found, along])

        got = _table(spoken, count)
        if not len(got):
            got = np.zeros(2 * size, np.int64)
        model = Refusals(log_odds(got[:size], everywhere, EARLY), log_odds(got[size:], everywhere, BESIDE))
        held.unpersist()
    spoken.unpersist()
    return model


def _may_decline(sentence: str) -> bool:
    words = set(said_words(sentence, frozenset()))
    return len(words) > 2 and speaks_of_self(sentence) and bool(words & NEGATION)


# ---- one pass for all models ------------------------------------------------------------------------------


class Models:
    def __init__(self, languages: Languages, rare: set[str], ends: Ends, refusals: Refusals, nothing: set[int]) -> None:
        self.languages, self.rare, self.ends, self.refusals, self.nothing = languages, rare, ends, refusals, nothing


COUNTS = "kind int, code long, other long, n long, ended long, sums array<bigint>"


def fit(pairs: DataFrame) -> Models:
    """All models, from all rows of ``pairs``."""
    names, rare = language_names(pairs)
    place = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(names), 1 << GRAM_BITS), np.int64)
        words = np.zeros(2 << WORD_BITS, np.int64)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        short: Counter = Counter()
        for b in batches:
            labels, prompts, answers = (b.column(i).to_pylist() for i in range(3))
            by: dict[int, list[str]] = {}
            places, lasts, hashes = [], [], []
            for l, p, a in zip(labels, prompts, answers):  # noqa: E741
                i = place.get(l.strip().lower()) if l else None
                if i is not None:
                    by.setdefault(i, []).append(f"{p or ''}\n{a or ''}")
                t = a.strip() if a else ""
                if not t:
                    continue
                m = _marks.of(t)
                codes = shape_codes(m)
                places.append(codes)
                lasts.append(codes[-1])
                hashes += [x[1] for x in m if x[1]]
                hashes.append(0)
                if len(t) < 400 and (w := _short(t)) is not None:
                    short[word_hash(w), -1 if i is None else i] += 1
            for i, texts in by.items():
                grams[i] += np.bincount(gram_codes(texts)[0], minlength=1 << GRAM_BITS)
            if places:
                seen.append(np.unique(np.concatenate(places), return_counts=True))
                ended.append(np.unique(np.array(lasts, np.int64), return_counts=True))
                h = np.array(hashes, np.uint64)
                words += np.bincount(np.concatenate([word_buckets(h[h > 0]), pair_buckets(h)]), minlength=len(words))

        def rows(kind: int, code: list, other: list, n: list, last: list, sums: list) -> pa.RecordBatch:
            k = len(code)
            return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array(code, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64()), pa.array(last, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["kind", "code", "other", "n", "ended", "sums"])

        for parts, first in ((seen, True), (ended, False)):
            if parts:
                code, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                none = np.zeros(len(code), np.int64)
                yield rows(0, code, none, n if first else none, none if first else n, [None] * len(code))
        if short:
            yield rows(1, [k[0] for k in short], [k[1] for k in short], list(short.values()), [0] * len(short), [None] * len(short))
        for kind, table in ((2, words), *[(3 + i, g) for i, g in enumerate(grams)]):
            pieces = np.array_split(table, 16)
            yield rows(kind, list(range(16)), [0] * 16, [0] * 16, [0] * 16, pieces)

    counted = pairs.select("language", "prompt", "answer").mapInArrow(count, COUNTS).persist(StorageLevel.MEMORY_AND_DISK)
    # shapes: n-grams of four of all tasks, then those within them
    whole = counted.where("kind = 0").groupBy("code").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    at = F.explode(F.array(*[F.col("code").bitwiseAND(F.lit((1 << 16 * k) - 1 if k < 4 else -1)) for k in range(1, LONGEST_SHAPE + 1)])).alias("code")
    # a text's first places have fewer than four shapes: their longest n-gram counts once
    inner = whole.select(F.col("code").alias("_c"), "n", "ended", at).distinct().groupBy("code").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    total = whole.agg(F.sum("n")).first()[0] or 0
    kept = inner.where(F.col("n") >= max(LEAST_SEEN, SEEN_SHARE * total)).toArrow().to_pydict()  # 1 / SEEN_SHARE n-grams of a length at most
    grams = {c: (n, e) for c, n, e in zip(kept["code"], kept["n"], kept["ended"])}
    texts = whole.agg(F.sum("ended")).first()[0] or 0
    often = counted.where("kind = 1").groupBy("code", "other").agg(F.sum("n").alias("n")).groupBy("code").agg(F.sum("n").alias("n"), F.collect_list(F.struct("other", "n")).alias("by"))
    often = often.where(F.col("n") >= max(SHORT_SEEN, SHORT_SHARE * texts)).toArrow().to_pylist()  # 1 / SHORT_SHARE texts at most
    tables = {}
    for kind in range(2, 3 + len(names)):
        tables[kind] = _pieces(counted.where(F.col("kind") == kind).select(F.col("code").cast("int").alias("piece"), "sums"))
    counted.unpersist()
    zero = np.zeros(2 << WORD_BITS, np.int64)
    languages = Languages(names, np.stack([tables[3 + i] for i in range(len(names))]).astype(float) if names else np.zeros((0, 1 << GRAM_BITS)))
    of_language = language_shares(pairs, names)
    nothing = {r["code"] for r in often if stands_in({x["other"]: x["n"] for x in r["by"]}, of_language)}
    ends = Ends(grams, {r["code"] for r in often} - nothing)
    return Models(languages, rare, ends, fit_refusals(pairs, tables[2] if len(tables[2]) else zero), nothing)


def language_shares(pairs: DataFrame, names: list[str]) -> np.ndarray:
    rows = pairs.where(F.col("answer").isNotNull()).groupBy(F.lower(F.trim("language")).alias("l")).count().collect()  # a row a label
    got = {r["l"]: r["count"] for r in rows}
    n = np.array([got.get(x, 0) for x in names], float)
    return n / max(n.sum(), 1)


def stands_in(seen: dict[int, int], shares: np.ndarray) -> bool:
    """Whether a text is seen under each language as often as any answer is (G test), with enough under others than
    the commonest language to tell."""
    n = np.array([seen.get(i, 0) for i in range(len(shares))], float)
    total = n.sum()
    if len(shares) < 2 or total * (1 - shares.max(initial=0)) < STAND_IN_SEEN:
        return False
    some = n > 0
    g = 2 * float((n[some] * np.log(n[some] / (total * np.maximum(shares[some], 1e-9)))).sum())
    return g <= STAND_IN_G * (len(shares) - 1)


# ---- defects ----------------------------------------------------------------------------------------------


def is_empty(answer: str | None, nothing: set[int] | None = None) -> bool:
    """``nothing``: hashes of the short texts that stand in for nothing in this table."""
    if answer is None:
        return True
    t = INVISIBLE.sub(" ", answer).strip()
    if not WORD.search(t):
        return True
    if ONLY_HEADING.match(t):
        return True
    if t.lower().strip(" .<>[](){}*_-\"'`") in NOTHING:
        return True
    return bool(nothing) and len(t) < 400 and (w := _short(t)) is not None and not w.isdigit() and word_hash(w) in nothing


def is_copy(prompt: str | None, answer: str) -> bool:
    """Whether the answer has hardly a word that isn't the prompt's, and most of the prompt's words, once or several
    times over."""
    if not prompt:
        return False
    p = WORD.findall(prompt.lower())
    if not p:
        return False
    text = answer.strip()
    for _ in range(2):
        text = ANNOUNCED.sub("", text.lstrip(" >\"'“«*"), count=1)
    text = text.lower()
    known, run = set(p), 0
    for k, m in enumerate(WORD.finditer(text)):  # most answers end here, after a few words
        run = 0 if m[0] in known else run + 1
        if run > 4 or k > 200:
            break
    if run > 4:
        return False
    a = WORD.findall(text)
    if not a or 2 * len(a) < len(p):
        return False
    times = max(1, round(len(a) / len(p)))
    if times > 1:  # written several times over, a prompt keeps its order
        pairs = set(zip(p, p[1:]))
        if 2 * sum(x in pairs for x in zip(a, a[1:])) < len(a):
            return False
    wide = -(-len(a) // times)  # words of one time over
    longest = run = common = 0
    for at in range(0, len(a), wide):
        left, had = Counter(p), common
        for w in a[at : at + wide]:
            if left[w] > 0:
                left[w] -= 1
                common += 1
                run = 0
            else:
                run += 1
                longest = max(longest, run)
        if common - had < 0.75 * len(a[at : at + wide]):
            return False
    return longest <= 4 and common >= 0.6 * times * len(p) and (common >= 3 or a == p)


def is_prose(answer: str) -> bool:
    """Whether an answer has enough words outside of code and data to be in a language: names are in none."""
    t = FENCE.sub("\n", answer).strip()
    return t[:1] not in "{[" and len(WORD.findall(t)) >= LEAST_WORDS


def is_truncated(answer: str, ends: Ends) -> bool:
    t = answer.strip().rstrip("​﻿")
    if t.count("```") % 2:
        return True
    if t[:1] in "{[" and not t.endswith("```") and re.match(r"[\[{]\s*[\"{\[\]}\d-]", t):
        try:
            json.loads(t)
            return False
        except ValueError:
            return True
        except RecursionError:
            return False
    bare = re.sub(r"\s*(?:…|\.{3,})$", "", t)
    if bare != t and bare and bare[-1] not in ".!?":
        return True
    return ends.chance(bare or t) < END_CHANCE


def judge(prompts: list[str | None], answers: list[str | None], contexts: list[str | None], labels: list[str | None], models: Models) -> list[str | None]:
    """The defect of each pair or None; at most one, in the order empty, copy, refusal, language, truncated.

    A prompt that has a context (a follow-up of a few words) is in the language of the context. Rows labelled with
    a language too rare for the model are not judged by language.
    """
    out: list[str | None] = [None] * len(prompts)
    open_ = []
    for i, (p, a) in enumerate(zip(prompts, answers)):
        if is_empty(a, models.nothing):
            out[i] = "empty"
        elif is_copy(p, a) and not ASKS_COPY.search(p):
            out[i] = "copy"
        elif models.refusals.judge(p, a)[0]:
            out[i] = "refusal"
        else:
            open_.append(i)
    languages, ends = models.languages, models.ends
    lp = languages.of([contexts[i] or prompts[i] for i in open_])
    la = languages.of([answers[i] for i in open_])
    for i, (x, _), (y, share) in zip(open_, lp, la):
        known = not labels[i] or labels[i].strip().lower() not in models.rare
        if known and x >= 0 and y >= 0 and x != y and share > 0.5 and is_prose(answers[i]) and not ASKS_LANGUAGE.search(prompts[i]):
            out[i] = "language"
        elif is_truncated(answers[i], ends):
            out[i] = "truncated"
    return out


def exchanges(messages: Column) -> Column:
    """Array of ``turn_idx, prompt, answer, context``: each user turn with the answer right after it.

    ``context``: all user turns of the conversation, where the turn itself is shorter than ``SHORT_PROMPT``.
    """
    users = F.filter(messages, lambda m: m["role"].isin(*USER_ROLES))
    context = F.array_join(F.transform(users, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    last = F.greatest(F.size(messages) - 2, F.lit(-1))
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    at = F.filter(at, lambda i: F.get(messages, i)["role"].isin(*USER_ROLES) & F.get(messages, i + 1)["role"].isin(*ANSWER_ROLES))
    return F.transform(at, lambda i: F.struct(i.alias("turn_idx"), F.get(messages, i)["content"].alias("prompt"), F.get(messages, i + 1)["content"].alias("answer"), F.when(F.length(F.get(messages, i)["content"]) < SHORT_PROMPT, context).alias("context")))


def pairs_of(instructions: DataFrame, conversations: DataFrame) -> DataFrame:
    """``data_id, turn_idx, prompt, answer, context, language`` of both forms, of each sample's latest row."""
    i = latest(instructions, "ingested_at", "instruction", "output", "language").where(F.trim(F.regexp_replace(F.coalesce("instruction", F.lit("")), r"\s+", " ")) != "")
    i = i.select("data_id", F.lit(0).alias("turn_idx"), F.col("instruction").alias("prompt"), F.col("output").alias("answer"), F.lit(None).cast("string").alias("context"), "language")
    c = latest(conversations, "ingested_at", "messages", "language").where(F.col("messages").isNotNull())
    c = c.select("data_id", "language", F.inline(exchanges(F.col("messages")))).select("data_id", "turn_idx", "prompt", "answer", "context", "language")
    return i.unionByName(c)


_kept: dict[str, Models] = {}


def _models(key: str, held: Broadcast) -> Models:
    """The models of a run, built once in a worker process."""
    if key not in _kept:
        _kept.clear()
        names, counts, rare, grams, short, declines, along, nothing = held.value
        _kept[key] = Models(Languages(names, counts), rare, Ends(grams, short), Refusals(declines, along), nothing)
    return _kept[key]


def find_defects(pairs: DataFrame) -> DataFrame:
    """``data_id, turn_idx, defect`` of the defective rows of ``pairs`` (see :func:`pairs_of`).

    A null answer is ``empty``; a null or blank prompt can be neither copied nor in a language. Prompts too
    short to tell their language never give ``language``. An empty table gives none. Repeated rows are judged
    each. All models are fitted on ``pairs`` itself, all rows.
    """
    import uuid

    pairs = pairs.persist(StorageLevel.MEMORY_AND_DISK)
    m = fit(pairs)
    held = pairs.sparkSession.sparkContext.broadcast((m.languages.names, m.languages.counts, m.rare, m.ends.grams, m.ends.short, m.refusals.declines, m.refusals.along, m.nothing))
    key = uuid.uuid4().hex

    def defects(prompts: pa.Array, answers: pa.Array, contexts: pa.Array, labels: pa.Array) -> pa.Array:
        models = _models(key, held)
        lists, out = [x.to_pylist() for x in (prompts, answers, contexts, labels)], []
        for s in range(0, len(prompts), 1000):
            out += judge(*[x[s : s + 1000] for x in lists], models)
        return pa.array(out, pa.string())

    return pairs.withColumn("defect", F.arrow_udf(defects, "string")("prompt", "answer", "context", "language")).where("defect is not null").select("data_id", "turn_idx", "defect")
