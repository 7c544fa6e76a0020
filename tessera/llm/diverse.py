"""A varied subset by a cluster-feature tree, and the look-alike prompts it has to hold back.

A cluster feature is (records, sum of their vectors, sum of their squared lengths); features add up, so the
trees of partitions merge. Each partition builds a tree of bounded size (when it is full, it starts anew from
its own leaf entries, the closest of them added up), a fixed number of tasks merges these trees, and what is left,
bounded whatever the table's size, is agglomerated by Ward linkage into cells. Each record goes to its
nearest cells; inside a cell, which holds a bounded number of records, the same tree and the same linkage are
built again from all of its records, cut at the number of groups the cell is due, and the record nearest each
group's centre is taken.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BITS, bucket_counts, with_tokens

DIM = 256
BRANCHING = 24
#: Leaf entries of one partition's tree, tasks that merge the trees of partitions, records aimed at in a cell,
#: cells at most.
LEAVES, MERGERS, CELL, MOST_CELLS = 256, 8, 1_000, 2_048
#: Records of one block of a cell: a cell that holds more, such as a large group of look-alikes, is cut.
BLOCK = 8_000
#: 64-bit words of the bitmap by which pairs are held off (a power of two); records of up to so many words are first compared by half of the bits.
LONGS, SHORT = 8, 110
#: Records on either side of one comparison of bitmaps; records of a key that are paired off together with other keys.
TALL, WIDE, FEW = 64, 1_024, 48
#: Records of one bucket of keys that one task holds, and keys that a record is reckoned to have.
HELD, KEYS = 300_000, 31
#: Records a cell, and in all at least, on which the cells of look-alikes are fitted.
FIT, FIT_LEAST = 50, 5_000
#: Words that make up less than this share of all words have no weight in a vector: names and numbers.
RARE_SHARE = 1.5e-5
#: Trees of partitions that one task merges at once.
FAN = 32


def vectors(flat: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Unit vectors of token lists: each token adds its weight, with the sign its hash has, in the place its
    hash has. Lists without weight give the zero vector."""
    n = np.diff(starts)
    rec = np.repeat(np.arange(len(n)), n)
    w = weight[(flat & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)]
    mixed = (flat ^ (flat >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    place = (mixed >> np.uint64(56)).astype(np.int64)
    sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    out = np.bincount(rec * DIM + place, weights=w * sign, minlength=len(n) * DIM).reshape(len(n), DIM)
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def weights(counts: np.ndarray) -> np.ndarray:
    """Weight of each bucket of tokens: 1, or 0 for a smaller share of all than RARE_SHARE.

    All frequent words weigh alike: look-alikes share the plain words of their sentences as well as the rarer
    ones, and weights by rarity would rest on few words and scatter a group over more cells.
    """
    return (counts >= RARE_SHARE * counts.sum()).astype(np.float32)


class _Node:
    __slots__ = ("n", "ls", "ss", "kids", "used")

    def __init__(self, leaf: bool) -> None:
        self.n, self.ls, self.ss = np.zeros(BRANCHING + 1), np.zeros((BRANCHING + 1, DIM), np.float32), np.zeros(BRANCHING + 1)
        self.kids: list[_Node] | None = None if leaf else []
        self.used = 0

    def put(self, n: float, ls: np.ndarray, ss: float, kid: _Node | None = None) -> None:
        i = self.used
        self.n[i], self.ls[i], self.ss[i] = n, ls, ss
        if self.kids is not None:
            self.kids.append(kid)
        self.used += 1


class CFTree:
    """Cluster-feature tree with at most ``leaves`` leaf entries (none: no bound)."""

    def __init__(self, leaves: int | None = LEAVES, threshold: float = 0.0) -> None:
        self.most, self.threshold, self.root, self.entries_used = leaves, threshold, _Node(True), 0

    def add(self, n: float, ls: np.ndarray, ss: float) -> None:
        parts = self._add(self.root, n, ls, ss)
        if parts:
            self.root = top = _Node(False)
            for p in parts:
                top.put(p.n[: p.used].sum(), p.ls[: p.used].sum(0), p.ss[: p.used].sum(), p)
        if self.most and self.entries_used > self.most:
            self._rebuild()

    def _add(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> list[_Node] | None:
        u = node.used
        if u:
            c = node.ls[:u] / node.n[:u, None]
            d = c - ls / n
            i = int(np.argmin((d * d).sum(1)))
        if node.kids is None:
            if u:
                m, s, q = node.n[i] + n, node.ls[i] + ls, node.ss[i] + ss
                if max(0.0, q / m - float(s @ s) / (m * m)) <= self.threshold**2 + 1e-9:
                    node.n[i], node.ls[i], node.ss[i] = m, s, q
                    return None
            node.put(n, ls, ss)
            self.entries_used += 1
        else:
            parts = self._add(node.kids[i], n, ls, ss)
            if not parts:
                node.n[i] += n
                node.ls[i] += ls
                node.ss[i] += ss
                return None
            a, b = parts
            node.kids[i] = a
            node.n[i], node.ls[i], node.ss[i] = a.n[: a.used].sum(), a.ls[: a.used].sum(0), a.ss[: a.used].sum()
            node.put(b.n[: b.used].sum(), b.ls[: b.used].sum(0), b.ss[: b.used].sum(), b)
        return self._split(node) if node.used > BRANCHING else None

    def _split(self, node: _Node) -> list[_Node]:
        u = node.used
        c = node.ls[:u] / node.n[:u, None]
        d = ((c[:, None] - c[None]) ** 2).sum(2)
        a, b = np.unravel_index(int(np.argmax(d)), d.shape)
        to_b = d[:, b] < d[:, a]
        to_b[a], to_b[b] = False, True
        out = []
        for side in (False, True):
            new = _Node(node.kids is None)
            for i in np.flatnonzero(to_b == side):
                new.put(node.n[i], node.ls[i], node.ss[i], node.kids[i] if node.kids is not None else None)
            out.append(new)
        return out

    def _rebuild(self) -> None:
        """A new tree of half as many leaf entries: those that Ward linkage joins at the least cost are added up.

        A wider threshold alone would not do: in many dimensions nearly all entries are about equally far
        apart, and a threshold that joins some of them soon joins all.
        """
        n, ls, ss = self.entries()
        group = cut(ward(n, ls / n[:, None]), len(n), max(1, self.most // 2))
        k = int(group.max()) + 1
        total = np.zeros((k, DIM), np.float32)
        np.add.at(total, group, ls)
        n, ss = np.bincount(group, weights=n, minlength=k), np.bincount(group, weights=ss, minlength=k)
        self.root, self.entries_used = _Node(True), 0
        for i in range(k):
            self.add(n[i], total[i], ss[i])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out, todo = [], [self.root]
        while todo:
            x = todo.pop()
            if x.kids is None:
                out.append((x.n[: x.used], x.ls[: x.used], x.ss[: x.used]))
            else:
                todo += x.kids
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])


def ward(n: np.ndarray, centre: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges of weighted points by Ward linkage, in order of their cost (nearest-neighbour chains).

    Merge ``k`` joins two nodes into node ``len(n) + k``; each cost is the growth of the sum of squares.
    """
    m = len(n)
    if m < 2:
        return []
    w, c = n.astype(np.float64).copy(), centre.astype(np.float64).copy()
    alive, name = np.ones(m, bool), np.arange(m)
    sq = (c * c).sum(1)
    merges, chain, fresh, cost = [], [], m, np.zeros(2 * m)
    while fresh < 2 * m - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        x = chain[-1]
        d = np.maximum(sq + sq[x] - 2 * (c @ c[x]), 0) * (w * w[x] / (w + w[x]))
        d[~alive] = np.inf
        d[x] = np.inf
        y = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[y]:
            y = chain[-2]
            chain = chain[:-2]
            # rounding must not make a merge cheaper than those it is made of
            cost[fresh] = max(float(d[y]), cost[name[x]], cost[name[y]])
            merges.append((int(name[x]), int(name[y]), float(cost[fresh]), fresh))
            c[x] = (c[x] * w[x] + c[y] * w[y]) / (w[x] + w[y])
            w[x] += w[y]
            sq[x] = (c[x] * c[x]).sum()
            alive[y] = False
            name[x] = fresh
            fresh += 1
        else:
            chain.append(y)
    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], merges[i][3]))
    rename = {merges[i][3]: m + k for k, i in enumerate(order)}
    return [(rename.get(merges[i][0], merges[i][0]), rename.get(merges[i][1], merges[i][1]), merges[i][2]) for i in order]


def cut(merges: list[tuple[int, int, float]], m: int, k: int) -> np.ndarray:
    """Group (from 0) of each of ``m`` points when the cheapest merges are done until ``k`` groups are left."""
    above = np.arange(2 * m)
    for i, (a, b, _) in enumerate(merges[: max(0, m - k)]):
        above[a] = above[b] = m + i
    for i in range(2 * m - 1, -1, -1):
        above[i] = above[above[i]]
    return np.unique(above[:m], return_inverse=True)[1]


ENTRY = "part long, n double, ls array<float>, ss double"


def _frame(part: int, tree: CFTree) -> pd.DataFrame:
    n, ls, ss = tree.entries()
    return pd.DataFrame({"part": part, "n": n, "ls": list(ls), "ss": ss})


def _lists(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum(column.map(len).to_numpy(dtype=np.int64))]) if len(column) else np.zeros(1, np.int64)
    # an empty list alone would make the whole array one of floats, which can't hold the tokens
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in column]) if len(column) else np.zeros(0, np.int64)
    return flat.view(np.uint64), starts


class Cells:
    """Centres of the cells that the merged trees of all records are cut into."""

    def __init__(self, tokens: DataFrame, cell: int = CELL, leaves: int = LEAVES, counts: np.ndarray | None = None, rows: int | None = None) -> None:
        """``tokens``: rows with ``id`` and ``toks``. Two passes: token frequencies, then the trees. Where ``tokens``
        are a sample, ``counts`` and ``rows`` are those of the whole."""
        counts = bucket_counts(tokens) if counts is None else counts
        spark = tokens.sparkSession
        self.weight = spark.sparkContext.broadcast(weights(counts))
        weight = self.weight

        def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree, part = CFTree(leaves), 0
            for f in frames:
                v = vectors(*_lists(f["toks"]), weight.value)
                for i, x in enumerate(v):
                    if not part:
                        part = zlib.crc32(f["toks"].iloc[i].tobytes()) + 1
                    tree.add(1.0, x, float(x @ x))
            if tree.root.used:
                yield _frame(part, tree)

        def merge(f: pd.DataFrame) -> pd.DataFrame:
            tree = CFTree(leaves)
            f = f.iloc[np.lexsort((f["ls"].map(lambda x: x[0]), f["ss"], f["n"]))]  # the result doesn't depend on the order of arrival
            for n, ls, ss in zip(f["n"], f["ls"], f["ss"]):
                tree.add(n, np.asarray(ls, np.float32), ss)
            return _frame(int(f["part"].iloc[0]), tree)

        trees = tokens.sortWithinPartitions("id").select("toks").mapInPandas(grow, ENTRY)
        left = tokens.rdd.getNumPartitions()
        while True:  # merged in levels: no task gets more than about FAN trees
            left = max(MERGERS, -(-left // FAN))
            trees = trees.withColumn("part", F.pmod("part", F.lit(left))).groupBy("part").applyInPandas(merge, ENTRY)
            if left == MERGERS:
                break
        got = trees.toPandas()  # MERGERS trees of ``leaves`` entries at most
        got = got.sort_values(["n", "ss"], kind="stable")
        self.rows = rows or (int(round(got["n"].sum())) if len(got) else 0)
        if not len(got):
            self.centres = np.zeros((1, DIM), np.float32)
            return
        n, ls = got["n"].to_numpy(), np.stack(got["ls"].to_list())
        k = min(len(n), MOST_CELLS, max(1, math.ceil(self.rows / cell)))
        group = cut(ward(n, ls / n[:, None]), len(n), k)
        total = np.zeros((group.max() + 1, DIM))
        np.add.at(total, group, ls)
        self.centres = (total / np.bincount(group, weights=n)[:, None]).astype(np.float32)

    def route(self, tokens: DataFrame, probes: int) -> DataFrame:
        """``tokens`` with ``cells``, the nearest cells of each record, nearest first."""
        centres, weight = tokens.sparkSession.sparkContext.broadcast(self.centres), self.weight

        def near(toks: pd.Series) -> pd.Series:
            v, c = vectors(*_lists(toks), weight.value), centres.value
            d = (c * c).sum(1) - 2 * (v @ c.T)
            k = min(probes, len(c))
            some = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(v), 1))
            order = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
            return pd.Series(list(order.astype(np.int32)))

        return tokens.withColumn("cells", F.pandas_udf(near, "array<int>")("toks"))


def _bitmaps(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``LONGS`` words a record in which each token flips one bit: two records differ in at least as many tokens as bits."""
    bit = _mixed(flat) >> np.uint64(65 - (64 * LONGS).bit_length())
    flips = np.left_shift(np.uint64(1), bit & np.uint64(63))
    word = bit >> np.uint64(6)
    out = np.zeros((LONGS, len(starts) - 1), np.uint64)
    some = np.diff(starts) > 0
    if some.any():
        for i in range(LONGS):
            out[i, some] = np.bitwise_xor.reduceat(np.where(word == i, flips, np.uint64(0)), starts[:-1][some])
    return out


def _mixed(flat: np.ndarray) -> np.ndarray:
    return (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)


def _tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    starts = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False).view(np.uint64)[starts[0] : starts[-1]], starts - starts[0]


class _Near:
    """Which records of a group, sorted by their size, can have the similarity ``t``: all that have it, and few more."""

    def __init__(self, n: np.ndarray, m: np.ndarray, t: Fraction) -> None:
        self.n, self.m = n, m
        self.half = m[: LONGS // 2] ^ m[LONGS // 2 :]  # bitmaps of half as many bits
        both = np.arange(2 * int(n.max(initial=0)) + 1)
        self.limit = both - 2 * -(-both * t.numerator // (t.numerator + t.denominator))
        # for a whole range of sizes at once: the limit goes up and down by one as sizes grow
        self.low = np.clip(np.maximum.accumulate(self.limit), 0, 255).astype(np.uint8)

    def within(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of positions, those whose whole bitmaps allow the similarity."""
        differ = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in self.m)
        return differ <= self.limit[self.n[x] + self.n[y]]

    def meet(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of each of ``x``, a few records of about the same size, with each of ``y``."""
        top = self.n[x].max()
        marks = self.half if top <= SHORT else self.m
        xs, ys, own = [], [], marks[:, x][:, :, None]
        for s in range(0, len(y), WIDE):
            part = y[s : s + WIDE]
            differ = np.zeros((len(x), len(part)), np.uint8)
            for w, v in zip(own, marks[:, part]):
                differ += np.bitwise_count(w ^ v)  # 256 differences become 0: one more to look at
            hit = np.flatnonzero((differ <= self.low[top + self.n[part]][None]).ravel())  # in one dimension this is the faster
            if len(hit):
                i, j = x[hit // len(part)], part[hit % len(part)]
                ok = self.within(i, j)
                xs.append(i[ok])
                ys.append(j[ok])
        if not xs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(xs), np.concatenate(ys)


def _settled(flat: np.ndarray, starts: np.ndarray, t: Fraction, others: int) -> np.ndarray:
    """Which records of a group have at least ``others`` others in it of the similarity: exact, nearest first until there are enough."""
    size = np.diff(starts)
    order = np.argsort(size, kind="stable")
    n, m = size[order], _bitmaps(flat, starts)[:, order]
    near, out = _Near(n, m, t), np.zeros(len(n), bool)
    for s in range(0, len(n), TALL):
        x = np.arange(s, min(s + TALL, len(n)))
        lo, hi = np.searchsorted(n, -(-n[x[0]] * t.numerator // t.denominator)), np.searchsorted(n, n[x[-1]] * t.denominator // t.numerator, "right")
        a, b = near.meet(x, np.arange(lo, hi))
        a, b = a[a != b], b[a != b]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        for i, from_, to in zip(x, np.searchsorted(a, x), np.searchsorted(a, x, "right")):
            if to - from_ < others:
                continue
            c = b[from_:to]
            c = c[np.argsort(sum(np.bitwise_count(w[i] ^ w[c]).astype(np.int64) for w in m), kind="stable")]
            own, found, at, step = np.sort(flat[starts[order[i]] : starts[order[i] + 1]]), 0, 0, others + others // 2
            while found < others and found + len(c) - at >= others:
                part = c[at : at + step]
                met = [flat[starts[j] : starts[j + 1]] for j in order[part]]
                ends = np.cumsum([len(v) for v in met])
                met = np.concatenate(met)
                hit = own[np.minimum(np.searchsorted(own, met), len(own) - 1)] == met
                o = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], ends[:-1]]))
                found += int(np.count_nonzero(o * t.denominator >= (n[i] + n[part] - o) * t.numerator))
                at, step = at + step, 2 * step
            out[order[i]] = found >= others
    return out


def look_alikes(df: DataFrame, id_col: str, text: str = "text", min_words: int = 40, similarity: float = 0.5, others: int = 10, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Ids of records for which at least ``others`` other records have the similarity (multiset Jaccard).

    Each record first asks in its nearest cell, or in its block (by hash) of a cell of more than ``block`` records;
    the similarity is exact, and members of a group of look-alikes are mostly settled there, however large it is.
    Records that have not found enough by then are compared exactly with all others (:func:`_exact`), so the cells
    leave none out, and their centres are fitted on a sample. Records of fewer than
    ``min_words`` words, null and empty texts are no one's neighbour; rows without an id are left out. An empty table gives none.
    """
    t = Fraction(similarity).limit_denominator(1_000)
    least = max(min_words, 1)
    tokens = with_tokens(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text), text).where(F.col("n") >= least).select("id", "toks").persist(StorageLevel.MEMORY_AND_DISK)
    counts, rows = bucket_counts(tokens), tokens.count()
    share = min(1.0, max(FIT_LEAST, FIT * min(MOST_CELLS, rows / cell)) / max(rows, 1))
    sample = tokens.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else tokens
    cells = Cells(sample, cell, counts=counts, rows=rows)
    nearest = lambda of: cells.route(of, 1).withColumn("cell", F.element_at("cells", 1))
    sizes = {r["cell"]: r["count"] / share for r in nearest(sample).groupBy("cell").count().collect()} if rows > block else {}  # at most MOST_CELLS rows
    blocks = [math.ceil(sizes.get(i, 1) / block) for i in range(max(sizes, default=0) + 1)]
    routed = nearest(tokens).withColumn("block", F.pmod(F.xxhash64("id"), F.coalesce(F.get(F.lit(blocks), F.col("cell")), F.lit(1))).cast("int"))

    def ask(f: pa.Table) -> pa.Table:
        lists = _column(f, "toks")
        enough = _settled(*_tokens(lists), t, others)
        return pa.table({"id": _column(f, "id"), "toks": lists, "asks": pa.array(~enough)})

    kind = dict(df.dtypes)[id_col]
    judged = routed.groupBy("cell", "block").applyInArrow(ask, f"id {kind}, toks array<bigint>, asks boolean").withColumn("rid", F.xxhash64("id")).persist(StorageLevel.MEMORY_AND_DISK)
    return judged.where("not asks").select("id").unionByName(_exact(judged, counts, rows, t, least, others)).withColumnRenamed("id", id_col)


def _exact(judged: DataFrame, counts: np.ndarray, rows: int, t: Fraction, least: int, others: int, held: int = HELD) -> DataFrame:
    """``id`` of the records that ask and have at least ``others`` others, whatever their cells.

    ``judged``: ``id, rid, toks, asks``. Let a shared token be the first that two records share, rare ones first: from it on, the record with
    ``r`` tokens left shares at most ``r``, so the other one has at most ``r (1 + t) / t`` less its own size. Each record
    goes once to each bucket of keys that it has such tokens of, with these bounds and its bitmap, and meets there the
    others with the key whose bounds and sizes fit; pairs that bitmaps allow are candidates, and only records with
    enough of them are verified. Buckets of more than ``held`` records are cut in blocks, and pairs of blocks meet.
    """
    spark = judged.sparkSession
    # a record has about a half of its tokens as keys; with more buckets each record would be sent more often
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * KEYS // held))
    sent = spark.sparkContext.broadcast(counts)

    def keys(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Record, bucket, key and bound of all keys, by record and bucket."""
        flat, starts = _tokens(b.column("toks"))
        n = np.diff(starts)
        rec = np.repeat(np.arange(len(n)), n)
        mixed = _mixed(flat)
        order = np.lexsort((mixed, sent.value[(flat & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)], rec))
        left = np.repeat(starts[1:], n) - np.arange(len(flat))
        size = np.repeat(n, n)
        bound = left * (t.numerator + t.denominator) // t.numerator - size
        chosen = bound >= np.maximum(least, -(-size * t.numerator // t.denominator))
        key = (mixed[order][chosen] >> np.uint64(20)).astype(np.uint32)
        rec, bound, bucket = rec[chosen], bound[chosen], (key % np.uint32(buckets)).astype(np.int64)
        by = np.lexsort((bucket, rec))
        return rec[by], bucket[by], key[by].view(np.int32), bound[by].astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            rec, bucket, _, _ = keys(b)
            total += np.bincount(np.unique(rec * buckets + bucket) % buckets, minlength=buckets)
        yield pa.record_batch({"bucket": pa.array(np.arange(buckets, dtype=np.int32)), "rows": pa.array(total)})

    cuts = np.ones(buckets, np.int64)
    if rows > held:
        for r in judged.select("toks").mapInArrow(count, "bucket int, rows long").groupBy("bucket").agg(F.sum("rows").alias("rows")).collect():
            cuts[r["bucket"]] = max(1, -(-r["rows"] // held))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, starts = _tokens(b.column("toks"))
            m, n = np.ascontiguousarray(_bitmaps(flat, starts).T), np.diff(starts).astype(np.int32)
            rid, asks = b.column("rid").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            rec, bucket, key, bound = keys(b)
            if not len(rec):
                continue
            first = np.flatnonzero(np.concatenate([[True], (rec[1:] != rec[:-1]) | (bucket[1:] != bucket[:-1])]))
            ends = 2 * np.concatenate([first, [len(rec)]])
            listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.stack([key, bound], 1).reshape(-1)))
            r, k = rec[first], bucket[first]
            own = (rid[r].view(np.uint64) >> np.uint64(7)).astype(np.int64) % cuts[k]
            again = np.repeat(np.arange(len(r)), cuts[k])
            other = np.arange(len(again)) - np.repeat(np.cumsum(cuts[k]) - cuts[k], cuts[k])
            for s in range(0, len(again), 50_000):
                at, o = again[s : s + 50_000], other[s : s + 50_000]
                marks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * LONGS), len(at), [None, pa.py_buffer(m[r[at]].tobytes())]).cast(pa.binary())
                ints = {"bucket": k[at], "lo": np.minimum(own[at], o), "hi": np.maximum(own[at], o), "own": own[at], "n": n[r[at]]}
                yield pa.record_batch({**{c: pa.array(v.astype(np.int32)) for c, v in ints.items()}, "rid": pa.array(rid[r[at]]), "asks": pa.array(asks[r[at]]), "m": marks, "keys": listed.take(pa.array(at))})

    packed = judged.select("rid", "toks", "asks").mapInArrow(pack, "bucket int, lo int, hi int, own int, n int, rid long, asks boolean, m binary, keys array<int>")
    pairs = packed.groupBy("bucket", "lo", "hi").applyInArrow(lambda f: _candidates(f, t), "x long, y long").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    enough = pairs.groupBy("x").count().where(F.col("count") >= others).select("x")
    x = judged.where("asks").select(F.col("rid").alias("x"), F.col("id").alias("x_id"), F.col("toks").alias("xt"))
    y = judged.select(F.col("rid").alias("y"), F.col("id").alias("y_id"), F.col("toks").alias("yt"))
    got = pairs.join(enough, "x").join(x, "x").join(y, "y").where("x_id <> y_id")
    o = F.size(F.array_intersect("xt", "yt"))
    similar = o * F.lit(t.denominator) >= (F.size("xt") + F.size("yt") - o) * F.lit(t.numerator)
    return got.where(similar).groupBy("x_id").count().where(F.col("count") >= others).select(F.col("x_id").alias("id"))


def _candidates(f: pa.Table, t: Fraction) -> pa.Table:
    """Pairs of one bucket, from each record that asks, once each."""
    n = _column(f, "n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, rid, own = n[order].astype(np.int64), _column(f, "rid").to_numpy()[order], _column(f, "own").to_numpy()[order]
    asks = _column(f, "asks").to_numpy(zero_copy_only=False)[order]
    marks, listed = _column(f, "m"), _column(f, "keys")
    base = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset]
    m = np.frombuffer(marks.buffers()[2], np.uint64, LONGS * len(n), int(base)).reshape(-1, LONGS)[order].T.copy()
    starts = listed.offsets.to_numpy().astype(np.int64)
    both = listed.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]].reshape(-1, 2)
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    row = np.repeat(rank, np.diff(starts) // 2)
    by = np.lexsort((row, both[:, 0]))
    row, key, bound = row[by], both[by, 0], both[by, 1].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [len(key)]]))
    cross, near, seen = f.column("lo")[0].as_py() != f.column("hi")[0].as_py(), _Near(n, m, t), _Pairs(len(n))

    def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of places in ``row``, those that may count here."""
        x, y = row[i], row[j]
        ok = (bound[i] >= n[y]) & (bound[j] >= n[x]) & (asks[x] | asks[y])
        return ok & (own[x] != own[y]) if cross else ok

    small = np.repeat((length <= FEW) & (length > 1), length)
    later = np.where(small, np.repeat(first + length, length) - 1 - np.arange(len(key)), 0)
    at = np.flatnonzero(later)
    part = np.cumsum(later[at]) // 1_000_000
    for s, e in zip(*(lambda p: (p, np.append(p[1:], len(at))))(np.flatnonzero(np.diff(part, prepend=-1)))):
        many = later[at[s:e]]
        i = np.repeat(at[s:e], many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        ok = fits(i, j)
        x, y = row[i[ok]], row[j[ok]]
        ok = near.within(x, y)
        seen.add(x[ok], y[ok])
    for a, k in zip(first[length > FEW], length[length > FEW]):
        rows, most = row[a : a + k], bound[a : a + k]
        size, asking = n[rows], asks[rows]
        last = np.searchsorted(size, most, "right")
        reach = last > np.arange(k) + 1
        for left, right in ((asking, None), (~asking, asking)):
            lefts = np.flatnonzero(left & reach)
            for s in range(0, len(lefts), TALL):
                q = lefts[s : s + TALL]
                to = int(last[q].max())
                ok = most[q[0] + 1 : to] >= size[q[0]]
                if right is not None:
                    ok &= right[q[0] + 1 : to]
                c = q[0] + 1 + np.flatnonzero(ok)
                x, y = near.meet(rows[q], rows[c])
                if len(x):
                    i, j = a + np.searchsorted(rows, x), a + np.searchsorted(rows, y)
                    ok = (i < j) & fits(i, j)
                    seen.add(x[ok], y[ok])
    x, y = seen.all()
    one, two = asks[x], asks[y]
    return pa.table({"x": pa.array(np.concatenate([rid[x[one]], rid[y[two]]])), "y": pa.array(np.concatenate([rid[y[one]], rid[x[two]]]))})


class _Pairs:
    """Distinct pairs of positions."""

    def __init__(self, n: int) -> None:
        self.n, self.parts, self.held = max(n, 1), [], 0

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            self.parts.append(x * self.n + y)
            self.held += len(x)
            if self.held > 4_000_000:
                self.parts = [np.unique(np.concatenate(self.parts))]
                self.held = 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        got = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int64)
        return got // self.n, got % self.n


def select_varied(df: DataFrame, sizes: dict[str, int], scores: dict[str, Column] | None = None, id_col: str = "data_id", text: str = "text", cell: int = CELL, slack: float = 0.1, block: int = BLOCK) -> DataFrame:
    """``spec, id, group, group_rows``: for each spec of ``sizes`` a subset of that many records.

    Cells get a share of the groups in proportion to the square root of their records, so a large group of
    similar records gets few places; inside a cell Ward linkage over the tree's leaf entries is cut at that
    number of groups and the record nearest each centre is taken. Of records whose distance is within
    ``slack`` of the nearest the one with the best ``scores[spec]`` is taken (a Column over ``df``; null is
    worst), ties by id. A subset is never larger than the pool, and short of its size only where the pool has
    fewer records. Texts without any words lie in one group. Rows without an id are
    left out, ids are taken as unique.
    """
    specs = [s for s, k in sorted(sizes.items()) if k and k > 0]
    kind = dict(df.dtypes)[id_col]
    shape = f"spec string, {id_col} {kind}, `group` string, group_rows long"
    if not specs:
        return df.sparkSession.createDataFrame([], shape)
    score = F.array(*[F.coalesce((scores or {}).get(s, F.lit(0.0)).cast("double"), F.lit(float("-inf"))) for s in specs])
    tokens = with_tokens(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text, score.alias("scores")), text).select("id", "toks", "scores").persist(StorageLevel.MEMORY_AND_DISK)
    cells = Cells(tokens, cell)
    routed = cells.route(tokens, 1).withColumn("cell", F.element_at("cells", 1)).drop("cells").persist(StorageLevel.MEMORY_AND_DISK)
    count = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    blocks = {c: -(-n // block) for c, n in count.items()}
    listed = [blocks.get(i, 1) for i in range(max(blocks, default=0) + 1)]
    routed = routed.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(F.lit(listed), F.col("cell") + 1)).cast("int"))
    part = {(r["cell"], r["block"]): r["count"] for r in routed.groupBy("cell", "block").count().collect()}
    due = {s: shares(part, count, sizes[s]) for s in specs}
    weight = cells.weight

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        key = (int(f["cell"].iloc[0]), int(f["block"].iloc[0]))
        f = f.sort_values("id", kind="stable").reset_index(drop=True)
        v = vectors(*_lists(f["toks"]), weight.value)
        tree = CFTree(None)
        for x in v:
            tree.add(1.0, x, float(x @ x))
        n, ls, _ = tree.entries()
        c = ls / n[:, None]
        leaf = np.argmin((c * c).sum(1)[None] - 2 * (v @ c.T), axis=1)
        merges = ward(n, c)
        out = []
        for i, s in enumerate(specs):
            k = due[s].get(key, 0)
            if not k:
                continue
            taken = np.zeros(len(f), bool)
            group = cut(merges, len(n), min(k, len(n)))[leaf]
            best = f["scores"].map(lambda x: x[i]).to_numpy()  # noqa: B023
            for g in range(group.max() + 1):
                own = np.flatnonzero(group == g)
                if not len(own):
                    continue
                d = np.sqrt(np.maximum(((v[own] - v[own].mean(0)) ** 2).sum(1), 0))
                near = own[d <= d.min() * (1 + slack) + 1e-9]
                j = near[np.lexsort((near, -best[near]))[0]]
                taken[j] = True
                out.append((s, f["id"].iloc[j], f"{key[0]}.{key[1]}.{g}", len(own)))
            left = np.flatnonzero(~taken)
            for j in left[np.lexsort((left, -best[left]))][: k - int(taken.sum())]:  # equal records share a leaf entry
                out.append((s, f["id"].iloc[j], f"{key[0]}.{key[1]}.{group[j]}", int((group == group[j]).sum())))
        return pd.DataFrame(out, columns=["spec", id_col, "group", "group_rows"])

    return routed.groupBy("cell", "block").applyInPandas(choose, shape)


def shares(part: dict, count: dict, k: int) -> dict:
    """How many groups each block of a cell is due: by the square root of the cell's records, shared evenly
    among its blocks, never more than the block holds, ``k`` in all if the pool has as many."""
    k = min(k, sum(part.values()))
    want = {b: math.sqrt(count[b[0]]) * n / count[b[0]] for b, n in part.items()}
    got = dict.fromkeys(part, 0)
    left = k
    while left > 0:
        open_ = [b for b in sorted(part) if got[b] < part[b]]
        total = sum(want[b] for b in open_)
        exact = {b: left * want[b] / total for b in open_}
        step = {b: min(int(exact[b]), part[b] - got[b]) for b in open_}
        if not any(step.values()):
            for b in sorted(open_, key=lambda b: (-exact[b], b))[:left]:
                got[b] += 1
            left = k - sum(got.values())
            continue
        for b, n in step.items():
            got[b] += n
        left = k - sum(got.values())
    return {b: n for b, n in got.items() if n}
