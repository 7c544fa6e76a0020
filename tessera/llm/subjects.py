"""Subject areas of documents by a distributed latent Dirichlet topic model.

No term of any subject is given to the fit. Topics start from how often terms occur in different sentences of
the same stretch of text: what terms share there is what the text is about, while the wording of single sentences
and names drop out. From that start the model is fitted on every document by expectation maximisation with
Dirichlet priors: each round a task takes its documents through the E-step against the broadcast topics and
returns one table of expected counts (topics by vocabulary), and these tables are added up by topic, so what a
round moves is bounded by the model, not by the documents.

There are more topics than subjects. After the fit each topic is inspected: its top terms are looked up in the
documents that raters labelled (and in the descriptions of the subjects), and the topic is mapped to the subject
that these terms point to, or to none where they point to no subject clearly.

A document is then read sentence by sentence: words that are typical of one subject's topics are attributed by
their topics and by the document's topic proportions, so a single borrowed word follows its document. The
document's proportion of a subject is the mean over its sentences, and a subject is assigned from that.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of the documents a term of the vocabulary is in at least and at most, and documents it needs in any case.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 1e-3, 0.12, 4
TOPICS, ALPHA, ETA = 96, 0.1, 0.02
#: Terms whose occurrence together starts the topics (the most frequent ones; all others come in by the rounds over
#: the documents), sentences of one stretch of text, rounds over the pairs of terms and over the documents.
START_TERMS, STRETCH, START_ROUNDS, ROUNDS, INNER = 2_000, 40, 60, 2, 3
#: Top terms by which a topic is inspected, the part of their weight that has to point to the subject, and how
#: much more that has to be than for any other subject.
TOP_TERMS, POINTING, CLEARER = 40, 0.3, 1.3
#: Labelled documents looked at when topics are mapped, at most: chosen by the hash of their id.
LABELLED = 20_000
#: Share of a term's occurrences that one subject must have for the term to speak for it, and the part of a
#: sentence that rounding may take from a document's proportion.
TYPICAL, ROUNDING = 0.6, 0.1
INNER_READ = 6
#: Documents that a task holds at once.
AT_ONCE = 500

TERM = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|\n+")
CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
LEAST_TERMS = 3


def sentences(text: str | None) -> list[list[str]]:
    """Terms of each sentence; code blocks and lines of fewer than ``LEAST_TERMS`` terms are no sentences."""
    if not text:
        return []
    t = CODE.sub("\n", text) if "```" in text else text
    t = t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower()
    got = [TERM.findall(s) for s in SENTENCE.split(t)]
    return [s for s in got if len(s) >= LEAST_TERMS]


class Topics:
    """``phi``: topics by vocabulary; ``mass``: words of each topic; ``subject_of``: the subject (or None) of each topic."""

    def __init__(self, vocabulary: list[str], phi: np.ndarray, mass: np.ndarray, subject_of: list[str | None]) -> None:
        self.vocabulary, self.phi, self.mass, self.subject_of = vocabulary, phi, mass, subject_of

    def share(self) -> np.ndarray:
        return self.phi * self.mass[:, None]

    def lift(self) -> np.ndarray:
        """How much a term makes up of a topic times how much the topic makes up of the term."""
        share = self.share()
        return self.phi * (share / np.maximum(share.sum(0, keepdims=True), 1e-12))

    def top_terms(self, n: int = 30) -> list[list[str]]:
        return [[self.vocabulary[i] for i in np.argsort(-row, kind="stable")[:n]] for row in self.lift()]


def e_step(phi: np.ndarray, doc: np.ndarray, term: np.ndarray, n: np.ndarray, docs: int, rounds: int = INNER_READ) -> tuple[np.ndarray, np.ndarray]:
    """Topic proportions of each document, and each entry's attribution to topics."""
    k = phi.shape[0]
    like = phi.T[term]
    theta = np.full((docs, k), 1.0 / k, phi.dtype)
    q = like
    n = n.astype(phi.dtype, copy=False)
    starts = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, int)
    for i in range(rounds):
        own = theta[doc]
        norm = np.maximum(np.einsum("ij,ij->i", like, own), 1e-30)
        if i == rounds - 1:
            q = like * own / norm[:, None]
        new = np.full((docs, k), ALPHA, phi.dtype)
        if len(starts):
            new[doc[starts]] += theta[doc[starts]] * np.add.reduceat(like * (n / norm)[:, None], starts, axis=0)
        theta = new / new.sum(1, keepdims=True)
    return theta, q


# ---- documents as numbers ---------------------------------------------------------------------------------


def _said(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, terms, sizes``: the terms of a document one after another, and how many each sentence has."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat: list[str] = []
            ends, sizes, size_ends = [0], [], [0]
            for t in b.column(1).to_pylist():
                for s in sentences(t):
                    flat += s
                    sizes.append(len(s))
                ends.append(len(flat))
                size_ends.append(len(sizes))
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v, k)) for e, v, k in ((ends, flat, pa.string()), (size_ends, sizes, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["doc_id", "terms", "sizes"])

    kind = dict(docs.dtypes)[doc_id]
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull())
    return chosen.mapInArrow(take, f"doc_id {kind}, terms array<string>, sizes array<int>")


def _document_counts(said: DataFrame) -> DataFrame:
    """``term, n``: the documents each term is in; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = b.column("terms")
            coded = terms.flatten().cast(pa.string()).dictionary_encode()
            k = len(coded.dictionary)
            owner = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            once = np.unique(owner * max(1, k) + coded.indices.to_numpy(zero_copy_only=False))
            n = np.bincount(once % max(1, k), minlength=k)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n[:k], pa.int64())], ["term", "n"])

    return said.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _numbered(said: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id, term, sentence, sentences``: the terms that are in the vocabulary, by their number, the sentence
    each stands in, and how many sentences there are in all."""
    sent = said.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(said.dtypes)["doc_id"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for b in batches:
            terms, sizes = b.column("terms"), b.column("sizes")
            at = pc.index_in(terms.flatten().cast(pa.string()), known)
            keep = pc.is_valid(at)
            owner = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
            many = pc.list_value_length(sizes).to_numpy(zero_copy_only=False)
            flat = sizes.flatten().to_numpy(zero_copy_only=False)
            within = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
            sentence = np.repeat(within, flat).astype(np.int32)
            mask = keep.to_numpy(zero_copy_only=False).astype(bool)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[mask], minlength=len(b)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (at.filter(keep).cast(pa.int32()), pa.array(sentence[mask], pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists, pa.array(many, pa.int32())], ["doc_id", "term", "sentence", "sentences"])

    return said.mapInArrow(number, f"doc_id {kind}, term array<int>, sentence array<int>, sentences int")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of portions of ``AT_ONCE`` documents: their number, and of each entry the document, term and sentence; with
    the sentences of each document."""
    for whole in batches:
        for s in range(0, len(whole), AT_ONCE):
            b = whole.slice(s, AT_ONCE)
            size = pc.list_value_length(b.column("term")).to_numpy(zero_copy_only=False)
            flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term", "sentence")]
            yield len(b), np.repeat(np.arange(len(b)), size), *flat, b.column("sentences").to_numpy(zero_copy_only=False)


# ---- fit --------------------------------------------------------------------------------------------------


def _outer(x: np.ndarray, group: np.ndarray, v: int) -> np.ndarray:
    """Codes of all ordered pairs of entries of the same group; groups lie together."""
    if not len(x):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(starts, len(x)))
    own = np.repeat(size, size)
    at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return np.repeat(x, own).astype(np.int64) * v + x[np.repeat(np.repeat(starts, size), own) + at]


def together(data: DataFrame, places: np.ndarray, v: int, pieces: int = 16) -> np.ndarray:
    """How often two terms stand in different sentences of one stretch, for the ``v`` terms that have a place
    (``places``: of each term of the vocabulary, -1 for none). Tables of tasks are added up by pieces."""
    sc = data.sparkSession.sparkContext
    held = sc.broadcast(places)
    rows = -(-v // pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(rows * pieces * v, np.int64)
        for _, doc, term, sentence, many in _parts(batches):
            x = held.value[term]
            doc, sentence, x = doc[x >= 0], sentence[x >= 0].astype(np.int64), x[x >= 0]
            wide = int(many.max(initial=0)) + 1
            stretch, single = doc * wide + sentence // STRETCH, doc * wide + sentence
            for group, sign in ((stretch, 1), (single, -1)):
                for s in range(0, len(x), 20_000):
                    # portions end where a group does
                    low, high = (np.searchsorted(group, group[i]) if i < len(x) else len(x) for i in (s, s + 20_000))
                    if high > low:
                        sums[: v * v] += sign * np.bincount(_outer(x[low:high], group[low:high], v), minlength=v * v)
        out = sums.reshape(pieces, rows * v)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(list(out), pa.list_(pa.int64()))], ["piece", "sums"])

    got = _added_up(data.mapInArrow(count, "piece int, sums array<bigint>"), "piece", "bigint")
    table = np.zeros((pieces, rows * v), np.int64)
    for p, s in got:
        table[p] = s
    return table.reshape(-1)[: v * v].reshape(v, v).astype(np.float64)


def _added_up(tables: DataFrame, key: str, kind: str) -> list[tuple[int, np.ndarray]]:
    """Arrays added up by ``key``, on the executors: the driver gets one array a key."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [f[key].iloc[0]], "sums": [np.sum(np.stack(f["sums"].to_list()), axis=0)]})

    return [(r[key], np.asarray(r["sums"])) for r in tables.groupBy(key).applyInPandas(add, f"{key} int, sums array<{kind}>").toArrow().to_pylist()]


def start_topics(pairs: np.ndarray, k: int, rounds: int = START_ROUNDS, seed: int = 3) -> np.ndarray:
    """Topics from a table of terms by terms, each row of which is read as one document.

    What is above the count that frequent terms have by chance counts. The first topics are rows far from each other.
    """
    total = pairs.sum()
    own = pairs.sum(1)
    w = np.where(pairs >= 3, np.maximum(pairs - np.outer(own, own) / max(total, 1.0), 0), 0).astype(np.float32)
    v = len(w)
    phi = np.full((k, v), 1.0 / max(v, 1), np.float32)
    mass = w.sum(1)
    if not v or mass.sum() <= 0:
        return phi
    rng = np.random.default_rng(seed)
    x = w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-9)
    chosen = [int(np.argmax(mass))]
    far = 1 - x @ x[chosen[0]]
    for _ in range(k - 1):
        p = np.maximum(far, 0).astype(np.float64) ** 2 * (mass > 0)
        chosen.append(int(rng.choice(v, p=p / p.sum())) if p.sum() > 0 else int(rng.integers(v)))
        far = np.minimum(far, 1 - x @ x[chosen[-1]])
    phi = w[chosen] + 0.02 * w.mean(0) + 1e-3
    phi /= phi.sum(1, keepdims=True)
    theta = np.full((v, k), 1.0 / k, np.float32)
    for _ in range(rounds):
        q = w / np.maximum(theta @ phi, 1e-12)
        new = theta * (q @ phi.T) + 0.05
        phi = phi * (theta.T @ q) + 0.01
        theta = (new / new.sum(1, keepdims=True)).astype(np.float32)
        phi = (phi / phi.sum(1, keepdims=True)).astype(np.float32)
    return phi


def _fit(data: DataFrame, vocabulary: list[str], frequency: dict[str, int], topics: int) -> Topics:
    v = len(vocabulary)
    if not v:
        return Topics([], np.zeros((topics, 0)), np.zeros(topics), [None] * topics)
    often = sorted(range(v), key=lambda i: (-frequency[vocabulary[i]], vocabulary[i]))[:START_TERMS]
    places = np.full(v, -1, np.int64)
    places[sorted(often)] = np.arange(len(often))
    first = start_topics(together(data, places, len(often)), topics)
    phi = np.full((topics, v), 1.0 / v)
    phi[:, sorted(often)] += first * len(often)
    phi /= phi.sum(1, keepdims=True)
    sc = data.sparkSession.sparkContext
    mass = np.ones(topics)
    for _ in range(ROUNDS):
        held = sc.broadcast(phi.astype(np.float32))

        def expected(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            p = held.value
            k, m = p.shape
            sums = np.zeros((m, k))
            for n, doc, term, _, _ in _parts(batches):
                if len(term):
                    code, count = np.unique(doc * m + term, return_counts=True)
                    own = code % m
                    _, q = e_step(p, code // m, own, count, n, INNER)
                    order = np.argsort(own, kind="stable")
                    starts = np.flatnonzero(np.diff(own[order], prepend=-1))
                    sums[own[order][starts]] += np.add.reduceat((q * count[:, None].astype(q.dtype))[order], starts, axis=0)
            out = sums.T
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], ["topic", "sums"])

        sums = np.zeros((topics, v))
        for t, s in _added_up(data.mapInArrow(expected, "topic int, sums array<double>"), "topic", "double"):
            sums[t] = s
        phi, mass = sums + ETA, sums.sum(1)
        phi /= phi.sum(1, keepdims=True)
        held.unpersist()
    return Topics(vocabulary, phi, mass, [None] * topics)


class Corpus:
    """Documents taken apart once: vocabulary, fit, mapping and reading all work on the numbered terms."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        said = _said(docs, doc_id, text).persist(StorageLevel.MEMORY_AND_DISK)
        n = said.where(F.size("sizes") > 0).count()
        got = _document_counts(said).where(F.col("n").between(max(LEAST_DOCS, LEAST_SHARE * n), MOST_SHARE * n))
        self.frequency = {r["term"]: r["n"] for r in got.toArrow().to_pylist()}  # a document's terms over LEAST_SHARE at most
        self.vocabulary = sorted(self.frequency)
        data = _numbered(said, self.vocabulary)
        least = docs.sparkSession.sparkContext.defaultParallelism
        # a table of few files: what follows shall still be shared out among all cores
        self.data = (data.repartition(least) if said.rdd.getNumPartitions() < least else data).persist(StorageLevel.MEMORY_AND_DISK)
        self.data.count()
        said.unpersist()

    def fit(self, topics: int = TOPICS) -> Topics:
        return _fit(self.data, self.vocabulary, self.frequency, topics)


def map_topics(topics: Topics, data: DataFrame, labels: DataFrame | None, subjects: dict[str, str | None]) -> list[str | None]:
    """The subject of each topic, None where its top terms point to no subject clearly.

    A term points to a subject by the share of the labelled documents with the term that have the subject; the
    words of a subject's name and description count as one more labelled document of it. ``labels``: ``doc_id, subject``, subjects
    without regard to case and blanks around, repeated rows once, unknown subjects none. At most ``LABELLED``
    documents are looked at.
    """
    names, v = sorted(subjects), len(topics.vocabulary)
    if not names or not v:
        return [None] * len(topics.phi)
    index = {w: i for i, w in enumerate(topics.vocabulary)}
    with_, of, prior, docs = np.zeros(v), np.zeros((len(names), v)), np.zeros(len(names)), 0
    if labels is not None:
        own = labels.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("subject")).alias("subject"))
        by = own.groupBy("doc_id").agg(F.collect_set("subject").alias("own")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
        said = data.join(F.broadcast(by), "doc_id").select("own", F.array_distinct("term").alias("term")).persist(StorageLevel.MEMORY_AND_DISK)
        for r in said.select(F.explode("term").alias("term")).groupBy("term").count().toArrow().to_pylist():
            with_[r["term"]] = r["count"]
        place = {s.strip().lower(): i for i, s in enumerate(names)}
        for r in said.select("term", F.explode("own").alias("s")).select("s", F.explode("term").alias("term")).groupBy("s", "term").count().toArrow().to_pylist():
            if r["s"] in place:
                of[place[r["s"]], r["term"]] = r["count"]
        docs = said.count()
        for r in said.select(F.explode("own").alias("s")).groupBy("s").count().collect():
            if r["s"] in place:
                prior[place[r["s"]]] = r["count"]
        said.unpersist()
    for i, s in enumerate(names):
        for w in {w for w in TERM.findall(f"{s} {subjects[s] or ''}".lower()) if w in index}:
            with_[index[w]] += 1
            of[i, index[w]] += 1
    points = (of + (prior / max(docs, 1))[:, None]) / (with_ + 1)
    out: list[str | None] = []
    for row in topics.lift():
        top = np.argsort(-row, kind="stable")[:TOP_TERMS]
        weight = row[top] * (with_[top] > 0)
        score = (points[:, top] * weight).sum(1) / max(weight.sum(), 1e-12)
        best, *rest = np.argsort(-score, kind="stable")
        clear = score[best] >= POINTING and all(score[best] >= CLEARER * score[i] for i in rest[:1])
        out.append(names[best] if clear else None)
    return out


# ---- reading ----------------------------------------------------------------------------------------------


class Reader:
    """Reads documents against mapped topics."""

    def __init__(self, topics: Topics, share: float) -> None:
        self.share = share
        self.names = names = sorted({s for s in topics.subject_of if s})
        # topics of one subject are one; topics without subject count together as the last column
        groups = np.array([names.index(s) if s else len(names) for s in topics.subject_of], dtype=int)
        by = np.zeros((len(names) + 1, topics.phi.shape[1]))
        np.add.at(by, groups, topics.share())
        self.like = by / np.maximum(by.sum(0, keepdims=True), 1e-30)
        self.typical = by.max(0, initial=0) >= TYPICAL * by.sum(0)

    def proportions(self, n: int, doc: np.ndarray, term: np.ndarray, sentence: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Of each document and subject the mean over the document's sentences."""
        out = np.zeros((n, len(self.names) + 1))
        keep = self.typical[term] if len(term) else np.zeros(0, bool)
        doc, term, sentence = doc[keep], term[keep], sentence[keep].astype(np.int64)
        if len(term):
            _, q = e_step(self.like, doc, term, np.ones(len(term)), n)
            # within a sentence the words are attributed together
            starts = np.flatnonzero(np.diff(doc * (int(many.max()) + 1) + sentence, prepend=-1))
            mass = np.add.reduceat(q, starts, axis=0)
            np.add.at(out, doc[starts], mass / mass.sum(1, keepdims=True))
        return out[:, :-1] / np.maximum(many, 1)[:, None]

    def subjects(self, *document: np.ndarray) -> list[list[str]]:
        p, many = self.proportions(*document), document[-1]
        enough = (p >= self.share - ROUNDING / np.maximum(many, 1)[:, None]) & (p > 0)
        return [[self.names[j] for j in np.flatnonzero(row)] for row in enough]


_readers: dict[str, Reader] = {}


def read_subjects(data: DataFrame, topics: Topics, share: float) -> DataFrame:
    import uuid

    held, key = data.sparkSession.sparkContext.broadcast((topics.phi.astype(np.float32), topics.mass, topics.subject_of)), uuid.uuid4().hex
    kind = dict(data.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _readers:
            _readers.clear()
            p, m, s = held.value
            _readers[key] = Reader(Topics([], p.astype(float), m, s), share)
        for whole in batches:
            got = [x for part in _parts(iter([whole])) for x in _readers[key].subjects(*part)]
            size = [len(x) for x in got]
            at = pa.array(np.repeat(np.arange(len(got)), size).astype(np.int64))
            yield pa.RecordBatch.from_arrays([whole.column("doc_id").take(at), pa.array([s for x in got for s in x], pa.string())], ["doc_id", "subject"])

    return data.mapInArrow(read, f"doc_id {kind}, subject string")


def assign_subjects(docs: DataFrame, subjects: dict[str, str | None], labels: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", share: float = 0.25, topics: int = TOPICS) -> DataFrame:
    """``doc_id, subject``: one row for each subject that at least ``share`` of the document's sentences are about.

    ``subjects``: names and descriptions; ``labels``: ``doc_id, subject`` of some of the documents (see
    :func:`map_topics`), without which only topics with words of a description have a subject. Null, empty and
    blank texts, and texts without a sentence, have no subject. Repeated documents are each assigned under
    their own id. An empty table, and one of so few documents that no term is in enough of them, gives no rows. The
    model is fitted on all documents and every document is read, whole.
    """
    corpus = Corpus(docs, doc_id, text)
    fitted = corpus.fit(topics)
    fitted.subject_of = map_topics(fitted, corpus.data, labels, subjects)
    return read_subjects(corpus.data, fitted, share)


def composition(assigned: DataFrame, docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``subject, documents, share`` of the corpus; a document of several subjects counts for each, documents
    without one under ``none``."""
    total = docs.count()
    got = docs.select(F.col(doc_id).alias("doc_id")).join(assigned, "doc_id", "left").groupBy(F.coalesce("subject", F.lit("none")).alias("subject")).agg(F.count(F.lit(1)).alias("documents"))
    return got.withColumn("share", F.col("documents") / F.lit(max(1, total)))
