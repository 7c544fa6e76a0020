"""Groups of records that share most of their words.

Similarity is words in common divided by words in either, as multisets. Records with the same words form one
class and only its representative is compared. Representatives meet in tiles: a tile holds records that share
one of their rarest tokens and whose sizes lie in the same band or its neighbour. Each record carries its size
and a bitmap in which every token flips one of 128 bits; two bitmaps differ in no more bits than two records
differ in tokens, so the count of different bits bounds the overlap from above and nearly all pairs of a tile
end there. Only the rest fetches the token arrays for the exact intersection.

Prefix rule: records of ``n`` tokens with similarity ``t`` or more share one of the ``n - ceil(t n) + 1`` tokens
that come first in any common order; with rare tokens first, tiles are small. A tile too large for one task is
cut in blocks, and each pair of blocks is a tile of its own.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKET_BITS, bucket_counts, durable, with_tokens

#: Ratio of the sizes in one band; records in one block of a tile; keys sent to all executors at most.
BAND, BLOCK, HOT_KEYS_SENT = 2.0, 2_000, 50_000
#: Added to the size of a record where it can only be the larger one of a pair; no record has as many words.
LARGER_ONLY = 1 << 30
#: Exact copies of one text up to this number are written as all their pairs; of more copies each is paired with
#: the first of them, and only that one has the links to other texts.
EXPANDED_CLASS = 64


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    return n - (n * t.numerator + t.denominator - 1) // t.denominator + 1


def _signer(counts: np.ndarray, t: Fraction, longs: int = 2):
    """Bitmaps (of 64 bits times ``longs``, a power of two: ``m1`` and so on) and prefixes of token arrays, for whole batches at once."""
    names = [f"m{i + 1}" for i in range(longs)]

    def sign(lists: pa.Array) -> pa.Array:
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        starts = lists.offsets.to_numpy().astype(np.int64)
        toks = lists.values.to_numpy().view(np.uint64)
        base, toks = starts[0], toks[starts[0] : starts[-1]]
        starts = starts - base
        n = np.diff(starts)
        rec = np.repeat(np.arange(len(n)), n)
        mixed = (toks ^ (toks >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        bit = mixed >> np.uint64(59 - longs.bit_length())
        flips = np.left_shift(np.uint64(1), bit & np.uint64(63))
        m = []
        for half in range(longs):
            x = np.where((bit >> np.uint64(6)) == half, flips, np.uint64(0))
            out = np.zeros(len(n), np.uint64)
            some = n > 0
            if some.any():
                out[some] = np.bitwise_xor.reduceat(x, starts[:-1][some])
            m.append(pa.array(out.view(np.int64)))
        rarity = counts[(toks & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)]
        order = np.lexsort((mixed, rarity, rec))
        keep = prefix_length(n, t)
        place = np.arange(len(toks)) - np.repeat(starts[:-1], n)
        chosen = place < np.repeat(keep, n)
        keys = (mixed[order][chosen] >> np.uint64(20)).astype(np.uint32).view(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, keep, 0))]).astype(np.int32)
        return pa.StructArray.from_arrays([*m, pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], [*names, "prefix"])

    return F.arrow_udf(sign, f"struct<{','.join(f'{m}:bigint' for m in names)},prefix:array<int>>")


def candidate_pairs(classes: DataFrame, t: Fraction, block: int = BLOCK) -> DataFrame:
    """Pairs ``x, y`` of class hashes whose bitmaps allow the similarity, with their sizes, each pair once.

    ``classes``: ``a, n, m1, m2, prefix``. A record lies in the tile of each of its prefix keys and of its size
    band, and in that of the next band if a record there can still be similar; pairs are made with the smaller
    record in the larger one's band; as the smaller one a record of ``n`` tokens needs only its first
    ``n - ceil(2 t / (1 + t) n) + 1`` keys. Both sides of the join are the same rows, so they are shuffled once. Keys
    with more than ``block`` records are cut in blocks, and each pair of blocks is a tile.
    """
    rows = classes.select("a", "n", "m1", "m2", F.posexplode("prefix").alias("nth", "key"))
    ratio = float(1 / t)
    as_smaller = F.col("n") - F.ceil(2 * F.col("n") * t.numerator / F.lit(t.numerator + t.denominator) - 1e-9)
    rows = rows.withColumn("role", F.when(F.col("nth") <= as_smaller, 0).otherwise(LARGER_ONLY)).drop("nth")
    band = lambda n: F.floor(F.log(n) / math.log(BAND) + 1e-9).cast("int")
    rows = rows.withColumn("band", band(F.col("n"))).withColumn("reach", F.when(F.col("role") == 0, band(F.col("n") * ratio)).otherwise(F.col("band")))

    def in_bands(df: DataFrame, *keep: str) -> DataFrame:
        df = df.select("key", "a", "m1", "m2", "n", "band", "role", F.explode(F.sequence("band", "reach")).alias("tile_band"), *keep)
        # negative: the record is a guest in a band above its own, where it is only the smaller one of a pair
        return df.withColumn("size", F.when(F.col("tile_band") == F.col("band"), F.col("n")).otherwise(-F.col("n"))).withColumn("size", F.col("size") + F.col("role")).drop("n", "band", "role")

    hot = rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")).persist(StorageLevel.MEMORY_AND_DISK)
    few = hot.limit(HOT_KEYS_SENT + 1).count()
    met = _met(in_bands(rows if not few else rows.join(_sized(hot, few), "key", "left_anti")).withColumn("tile", F.hash("key", "tile_band")), None, t)
    if few:
        cut = in_bands(rows.join(_sized(hot, few), "key"), "blocks").withColumn("own", F.pmod("a", F.col("blocks")).cast("int"))
        many = F.sequence(F.lit(0), F.col("blocks") - 1)
        left = cut.withColumn("other", F.explode(many)).withColumn("tile", F.hash("key", "tile_band", "own", "other"))
        right = cut.withColumn("other", F.explode(many)).withColumn("tile", F.hash("key", "tile_band", "other", "own"))
        met = met.unionByName(_met(left, right, t))
    return met.groupBy("x", "y").agg(F.first("x_n").alias("x_n"), F.first("y_n").alias("y_n"))


def _sized(hot: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(hot) if rows <= HOT_KEYS_SENT else hot


def _met(left: DataFrame, right: DataFrame | None, t: Fraction) -> DataFrame:
    """Pairs of records that meet in a tile and pass the bounds of size and bitmap."""
    cols = ("tile", "a", "size", "m1", "m2")
    n = left.sparkSession.conf.get("spark.sql.shuffle.partitions")
    left = left.select(*cols).repartition(int(n), "tile")
    if right is None:
        # kept with their partitioning, so that both sides of the join read the one shuffle
        left = right = left.persist(StorageLevel.MEMORY_AND_DISK)
    else:
        right = right.select(*cols).repartition(int(n), "tile")
    l = left.select(*[F.col(c).alias("x_" + c) for c in cols])  # noqa: E741
    r = right.select(*[F.col(c).alias("y_" + c) for c in cols])
    small = F.abs("y_size")
    large = F.when(F.col("x_size") >= LARGER_ONLY, F.col("x_size") - LARGER_ONLY).otherwise(F.col("x_size"))
    both = large + small
    # an overlap of o gives the similarity o / (both - o), so it must be at least t / (1 + t) of both
    need = F.ceil(both * F.lit(t.numerator) / F.lit(t.numerator + t.denominator) - 1e-9)
    differ = F.bit_count(F.col("x_m1").bitwiseXOR(F.col("y_m1"))) + F.bit_count(F.col("x_m2").bitwiseXOR(F.col("y_m2")))
    larger = (large > small) | ((large == small) & (F.col("x_a") < F.col("y_a")))
    fits = (small * F.lit(t.denominator).cast("bigint") >= large * F.lit(t.numerator).cast("bigint")) & (differ <= both - 2 * need)
    met = l.join(r, (F.col("x_tile") == F.col("y_tile")) & larger & fits)
    return met.select(F.col("x_a").alias("x"), F.col("y_a").alias("y"), large.alias("x_n"), small.alias("y_n"))


class NearDuplicates:
    """Classes, membership and exact links of ``df`` (``id``, ``text``).

    * ``members``: every record of a class of several with the class representative ``rep`` (the smallest id of
      the class), and among the exact copies of its text the first (``copy_of``) and how many there are (``copies``).
    * ``links``: pairs of representatives ``x < y`` of similarity ``t`` or more, with the similarity.

    Records with fewer than ``min_words`` words, null and empty texts take part in neither. Rows without
    an id are left out, ids are taken as unique. An empty table gives empty results. ``t`` is taken as an exact fraction: 4/5 includes 0.8.
    """

    def __init__(self, df: DataFrame, id_col: str, text: str = "text", t: Fraction = Fraction(4, 5), min_words: int = 20, block: int = BLOCK) -> None:
        self.t = t
        given = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(3), text).alias("h2"), text)
        toks = with_tokens(given, text).where(F.col("n") >= min_words)
        # partitioned by id once: the joins that fetch both records of a pair move the pairs only
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.tokens = toks.repartition(n, "id").persist(StorageLevel.MEMORY_AND_DISK)
        counts = bucket_counts(self.tokens)
        sign = _signer(counts, t)
        signed = self.tokens.select("id", "n", "a", "b", sign("toks").alias("s")).select("id", "n", "a", "b", "s.*")
        by = signed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("m1").alias("m1"), F.first("m2").alias("m2"), F.first("prefix").alias("prefix"))
        self.classes = by.persist(StorageLevel.MEMORY_AND_DISK)
        held = self.tokens.select("id", "a", "b", "h1", "h2").join(self.classes.where("size > 1").select("a", "b", "rep", "size"), ["a", "b"])
        texts = held.groupBy("rep", "h1", "h2").agg(F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("copies"))
        self.members = held.join(texts, ["rep", "h1", "h2"]).select("id", "rep", "size", "copy_of", "copies")
        self.links = self._links(block)

    def _links(self, block: int) -> DataFrame:
        pairs = candidate_pairs(self.classes, self.t, block)
        # classes that share one 64-bit hash would all be tried here; the intersection below is exact
        rep = self.classes.select("a", "rep", "n")
        for c in ("x", "y"):
            pairs = pairs.join(rep, (F.col(c) == F.col("a")) & (F.col(f"{c}_n") == F.col("n"))).drop(c, "a", "n").withColumnRenamed("rep", c)
        of = self.tokens.select("id", "toks")
        got = pairs.join(of.withColumnRenamed("toks", "xt"), F.col("x") == F.col("id")).drop("id")
        got = got.join(of.withColumnRenamed("toks", "yt"), F.col("y") == F.col("id")).drop("id")
        o = F.size(F.array_intersect("xt", "yt"))
        got = got.withColumn("o", o).where(F.col("o") * F.lit(self.t.denominator) >= (F.col("x_n") + F.col("y_n") - F.col("o")) * F.lit(self.t.numerator))
        return got.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("o") / (F.col("x_n") + F.col("y_n") - F.col("o"))).alias("similarity"))

    def pairs(self, expanded: int = EXPANDED_CLASS) -> DataFrame:
        """Pairs of record ids ``id_a < id_b``.

        Complete but for texts of which there are more than ``expanded`` exact copies, which may be a good part of
        the table: these are written as membership, the first copy with each other one, and only the first has
        links to other texts. ``copies`` gives the membership, from which every pair left out follows.
        """
        full = self.members.where((F.col("copies") <= expanded) | (F.col("id") == F.col("copy_of"))).select("id", "rep")
        within = full.alias("p").join(full.alias("q"), (F.col("p.rep") == F.col("q.rep")) & (F.col("p.id") < F.col("q.id"))).select(F.col("p.id").alias("id_a"), F.col("q.id").alias("id_b"))
        star = self.copies(expanded).where("id <> copy_of").select(F.col("copy_of").alias("id_a"), F.col("id").alias("id_b"))
        links = self.links.select("x", "y")
        for c in ("x", "y"):
            links = links.join(full.select(F.col("id").alias("m"), F.col("rep").alias(c)), c, "left").withColumn(c, F.coalesce("m", c)).drop("m")
        across = links.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return across.unionByName(within).unionByName(star)

    def copies(self, expanded: int = EXPANDED_CLASS) -> DataFrame:
        """``id, copy_of, copies`` of the records that :meth:`pairs` writes as membership."""
        return self.members.where(F.col("copies") > expanded).select("id", "copy_of", "copies")

    def groups(self, rounds: int = 30) -> DataFrame:
        """One row for each record that has a near duplicate: ``id``, the ``group`` (smallest id reachable
        over links) and ``links``, how many other classes its own is linked with.

        Components by smallest label and pointer jumping (:func:`components`).
        """
        ends = self.links.select(F.col("x").alias("u"), F.col("y").alias("v"))
        degree = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.count(F.lit(1)).alias("links"))
        label = components(ends, rounds)
        by_rep = self.members.select("id", "rep").unionByName(label.join(self.members.select(F.col("id").alias("node")), "node", "left_anti").select(F.col("node").alias("id"), F.col("node").alias("rep")))
        got = by_rep.join(label.select(F.col("node").alias("rep"), "root"), "rep", "left").join(degree.withColumnRenamed("u", "rep"), "rep", "left")
        return got.select("id", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """``node, root`` of undirected ``edges`` (``u, v``): the smallest node of each component.

    Every node takes the smallest label among its neighbours and itself, then the label of its label
    (pointer jumping), until nothing changes: a number of rounds that grows with the logarithm of the longest
    chain. Raises if ``rounds`` don't suffice rather than return a partial result.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).persist(StorageLevel.MEMORY_AND_DISK)
    label = durable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(rounds):
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("m"))
        new = label.join(near, F.col("node") == F.col("u")).select("node", F.least("root", "m").alias("mid"), F.col("root").alias("old"))
        jump = label.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = durable(new.join(jump, "mid", "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("root"), "old"))
        if new.where(F.col("root") != F.col("old")).limit(1).count() == 0:
            return new.select("node", "root")
        label = new.select("node", "root")
    raise RuntimeError(f"components need more than {rounds} rounds")
