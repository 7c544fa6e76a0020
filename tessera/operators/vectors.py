"""Nearest neighbours, greedy diversity and clusters over embedding vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import quantiles
from tessera.operators.filters import first_in_groups

#: Vectors in one block: two blocks and their products fit a task many times over.
BLOCK = 2_048


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the shared folder ``spark.checkpoint.dir``; in local mode without that
    setting in a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one that ``spark.checkpoint.dir`` names; in local mode without that setting one of
    this machine."""
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="tessera-shared-")
    return f"{folder}/{uuid.uuid4().hex}"


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_list()).astype(np.float64)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def block_pairs(df: DataFrame, id_col: str, vector: str, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Rows laid out by pairs of blocks: ``i, j, id, vec, side`` (0: asks, 1: is searched).

    All vectors (or ``queries``) are compared with all, so the product itself is quadratic; what a task holds
    is two blocks. With ``queries`` only those ask.
    """
    n = max(1, math.ceil(df.count() / block))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vec")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    asks = rows
    if queries is not None:
        m = max(1, math.ceil(queries.count() / block))
        asks = queries.select(F.col(id_col).alias("id"), F.col(vector).alias("vec")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(m)).cast("int"))
    else:
        m = n
    left = asks.select(F.col("b").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), "id", "vec", F.lit(0).alias("side"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), F.col("b").alias("j"), "id", "vec", F.lit(1).alias("side"))
    return left.unionByName(right)


def nearest(df: DataFrame, id_col: str, vector: str, k: int = 1, queries: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest others of each vector by cosine distance: ``id, other, distance, rank``; exact.

    Of equally near ones the smaller id comes first. A block pair keeps ``k`` rows a query, which one more
    aggregate merges.
    """
    kind = dict(df.dtypes)[id_col]
    parts = block_pairs(df, id_col, vector, queries, block).groupBy("i", "j").applyInPandas(_best_of(k), f"id {kind}, other {kind}, distance double")
    return _merged(parts, id_col, k)


def _best_of(k: int):  # noqa: ANN202
    """The ``k`` nearest rows (side 1) of each asking row (side 0) of a frame."""

    def best(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["side"] == 0], f[f["side"] == 1].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"id": f["id"][:0], "other": f["id"][:0], "distance": np.zeros(0)})
        out = []
        for s in range(0, len(a), BLOCK):
            part = a.iloc[s : s + BLOCK]
            d = np.round(1 - _unit(part["vec"]) @ _unit(b["vec"]).T, 12)
            ids, others = part["id"].to_numpy(), b["id"].to_numpy()
            d[ids[:, None] == others[None, :]] = np.inf
            m = min(k, len(others))
            at = np.argsort(d, axis=1, kind="stable")[:, :m]
            dist = np.take_along_axis(d, at, 1)
            keep = np.isfinite(dist)
            out.append(pd.DataFrame({"id": np.repeat(ids, m).reshape(-1, m)[keep], "other": others[at][keep], "distance": dist[keep]}))
        return pd.concat(out)

    return best


def _merged(parts: DataFrame, id_col: str, k: int) -> DataFrame:
    """Of the neighbours found in parts the ``k`` nearest of each query: what is merged is ``k`` rows a part."""
    got = parts.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "other"))), 1, k).alias("b"))
    got = got.select("id", F.posexplode("b").alias("p", "s"))
    return got.select(F.col("id").alias(id_col), F.col("s.other").alias("other"), F.col("s.distance").alias("distance"), (F.col("p") + 1).alias("rank"))


class CellIndex:
    """An index of vectors by their nearest of a set of centres.

    The centres are fitted on at most ``sample`` rows, chosen by hash; every row is indexed. A query is compared
    exactly with the rows of its ``probes`` nearest cells only, so a neighbour in another cell can be missed:
    the recall against :func:`nearest` is measured in the tests.
    """

    def __init__(self, df: DataFrame, id_col: str, vector: str, cells: int, sample: int = 20_000, seed: int = 42) -> None:
        self.id_col, self.vector, self.kind = id_col, vector, dict(df.dtypes)[id_col]
        n = df.count()
        some = df if n <= sample else df.where(F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(1_000_000 * sample / n))
        m = _unit(some.orderBy(id_col).select(vector).toPandas()[vector]) if n else np.zeros((1, 1))
        cells = max(1, min(cells, len(m)))
        label = lloyd(m, cells, seed)
        self.centres = np.stack([m[label == j].mean(0) for j in np.unique(label)])
        self.held = df.sparkSession.sparkContext.broadcast(self.centres)
        self.rows = self._placed(df)

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.select(F.col(self.id_col).alias("id"), F.col(self.vector).alias("vec")).withColumn("cell", F.element_at(self._cells("vec", 1), 1))

    def add(self, df: DataFrame) -> CellIndex:
        """Further rows, in the cells there are."""
        self.rows = self.rows.unionByName(self._placed(df))
        return self

    def empty(self) -> CellIndex:
        """No rows, the same cells."""
        self.rows = self.rows.limit(0)
        return self

    def count(self) -> int:
        return self.rows.count()

    def save(self, path: str) -> None:
        """Rows by cell and the centres as tables, so that a search reads the folders of its cells."""
        spark = self.rows.sparkSession
        self.rows.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(self.centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str, vector: str) -> CellIndex:
        self = cls.__new__(cls)
        self.id_col, self.vector = id_col, vector
        self.rows = spark.read.parquet(f"{path}/rows").select("id", "vec", F.col("cell").cast("int").alias("cell"))
        self.kind = dict(self.rows.dtypes)["id"]
        self.centres = np.stack([np.array(r["centre"]) for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])  # one row a cell
        self.held = spark.sparkContext.broadcast(self.centres)
        return self

    def _cells(self, vector: str, probes: int) -> Column:
        held = self.held

        def near(v: pd.Series) -> pd.Series:
            c = held.value
            d = (c * c).sum(1) - 2 * _unit(v) @ c.T
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)))

        return F.pandas_udf(near, "array<int>")(vector)

    def search(self, queries: DataFrame, k: int, probes: int, block: int = BLOCK) -> DataFrame:
        """``id, other, distance, rank``: the ``k`` nearest others of each query among its cells.

        A cell with more than ``block`` rows is searched in blocks, each by a task of its own.
        """
        sizes = {r["cell"]: -(-r["count"] // block) for r in self.rows.groupBy("cell").count().collect()}  # one row a cell
        blocks = F.element_at(F.lit([sizes.get(i, 1) for i in range(len(self.centres))]), F.col("cell") + 1)
        rows = self.rows.select("cell", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("b"), "id", "vec", F.lit(1).alias("side"))
        asks = queries.select(F.col(self.id_col).alias("id"), F.col(self.vector).alias("vec"))
        asks = asks.withColumn("cell", F.explode(self._cells("vec", probes)))
        asks = asks.select("cell", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("b"), "id", "vec", F.lit(0).alias("side"))
        parts = asks.unionByName(rows).groupBy("cell", "b").applyInPandas(_best_of(k), f"id {self.kind}, other {self.kind}, distance double")
        return _merged(parts, self.id_col, k)


def text_nearest_distance(df: DataFrame, id_col: str, vector: str, text: str) -> DataFrame:
    """Distance to the nearest vector that isn't the text's own: the second nearest if the nearest has the same text."""
    two = nearest(df, id_col, vector, 2)
    t = df.select(F.col(id_col).alias("_i"), F.col(text).alias("_t"))
    got = two.join(t.withColumnRenamed("_t", "own"), F.col(id_col) == F.col("_i")).drop("_i").join(t, F.col("other") == F.col("_i")).drop("_i")
    same = F.col("own") == F.col("_t")
    best = F.min_by("distance", F.struct(F.when((F.col("rank") == 1) & same, 1).otherwise(0), "rank"))
    return got.groupBy(id_col).agg(best.alias("distance"))


def near_pairs(df: DataFrame, id_col: str, vector: str, threshold: float, strict: bool, block: int = BLOCK) -> DataFrame:
    """``a, b`` with distance at most (``strict``: under) the threshold, each ordered pair once."""
    kind = dict(df.dtypes)[id_col]

    def close(f: pd.DataFrame) -> pd.DataFrame:
        a, b = f[f["side"] == 0], f[f["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": f["id"][:0], "b": f["id"][:0]})
        d = np.round(1 - _unit(a["vec"]) @ _unit(b["vec"]).T, 12)
        ids, others = a["id"].to_numpy(), b["id"].to_numpy()
        hit = (d < threshold) if strict else (d <= threshold)
        hit &= ids[:, None] != others[None, :]
        x, y = np.nonzero(hit)
        return pd.DataFrame({"a": ids[x], "b": others[y]})

    return block_pairs(df, id_col, vector, None, block).groupBy("i", "j").applyInPandas(close, f"a {kind}, b {kind}")


def greedy_diverse(df: DataFrame, id_col: str, vector: str, rank: str, threshold: float = 0.1, strict: bool = False, rounds: int = 60) -> DataFrame:
    """Rows that a scan in the order of ``rank`` would accept: each unless an accepted row is too near.

    Too near is a distance of at most ``threshold`` (``strict``: under it). The result of the scan is the first
    maximal independent set of the graph of near rows; it is found by rounds in which every row without an open
    better neighbour is accepted and its neighbours are rejected. Each round is written to the checkpoint
    folder. Raises if ``rounds`` don't suffice.
    """
    pairs = near_pairs(df, id_col, vector, threshold, strict)
    r = df.select(F.col(id_col).alias("id"), F.col(rank).alias("r"))
    edges = pairs.join(r.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    edges = checkpointed(edges.where(F.col("ra") < F.col("rb")).select("a", "b"))  # a is better than b
    state = checkpointed(r.select("id", F.lit(0).alias("s")))  # 0 open, 1 accepted, 2 rejected
    for _ in range(rounds):
        open_ = state.where("s = 0").select("id")
        blocked = edges.join(open_.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        accepted = open_.join(blocked, "id", "left_anti")
        rejected = edges.join(accepted.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        new = state.join(accepted.withColumn("_a", F.lit(1)), "id", "left").join(rejected.withColumn("_x", F.lit(1)), "id", "left")
        state = checkpointed(new.select("id", F.when(F.col("s") != 0, F.col("s")).when(F.col("_a") == 1, 1).when(F.col("_x") == 1, 2).otherwise(0).alias("s")))
        if not state.where("s = 0").limit(1).count():
            return df.join(state.where("s = 1").select(F.col("id").alias(id_col)), id_col, "left_semi")
    raise RuntimeError(f"greedy selection needs more than {rounds} rounds")


def greedy_select(df: DataFrame, n: int, id_col: str, vector: str, rank: str, threshold: float = 0.1, by: str = "accepted") -> DataFrame:
    """``by="accepted"``: the first ``n`` accepted rows; ``"scanned"``: the accepted ones of the first ``n + 1``."""
    pool = df.orderBy(rank).limit(n + 1) if by == "scanned" else df
    got = greedy_diverse(pool, id_col, vector, rank, threshold)
    return got if by == "scanned" else got.orderBy(rank).limit(n)


# ---- clusters ---------------------------------------------------------------------------------------------


def to_vector(df: DataFrame, column: str, out: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(F.transform(F.col(column), lambda x: x.cast("double"))))


def reduced(df: DataFrame, column: str, variance: float = 0.99, out: str = "reduced") -> DataFrame:
    """``column`` on the leading principal components that explain the share of variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    feats = to_vector(df, column)
    d = len(df.select(column).first()[0])
    model = PCA(k=d, inputCol="features", outputCol="_pca").fit(feats)
    share = np.cumsum(model.explainedVariance.toArray())
    k = int(min(d, np.searchsorted(share, variance - 1e-12) + 1))
    return model.transform(feats).withColumn(out, F.slice(vector_to_array("_pca"), 1, k)).drop("features", "_pca")


def clustered(df: DataFrame, column: str, k: int, seed: int = 42, coarse: int = 300, max_iter: int = 30, id_col: str = "vec_id", cell: int = 20_000) -> DataFrame:
    """``cluster`` of each row by k-means with ``k`` centres.

    Up to ``coarse`` centres are fitted at once. More are shared out: coarse cells first, then each cell gets
    centres in proportion to its rows and is clustered in a task of its own, split by hash where it holds more
    than ``cell`` rows.
    """
    from pyspark.ml.clustering import KMeans

    n = df.count()
    feats = to_vector(df, column)
    if k <= coarse or n <= k:
        return KMeans(k=max(2, min(k, n)), seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(feats).transform(feats).drop("features") if n > 1 else df.withColumn("cluster", F.lit(0))
    first = KMeans(k=coarse, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="_c").fit(feats).transform(feats).drop("features").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["_c"]: r["count"] for r in first.groupBy("_c").count().collect()}  # at most ``coarse`` rows
    blocks = {c: math.ceil(m / cell) for c, m in sizes.items()}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for p in blocks.items() for x in p]), F.col("_c"))
    first = first.withColumn("_b", F.pmod(F.xxhash64(id_col), n_blocks).cast("int"))
    extra = df.drop("cluster").columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*extra).schema) + ", cluster bigint"

    def fine(f: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(f[column].to_list()).astype(np.float64)
        want = max(1, min(len(m), round(k * len(m) / n)))
        label = lloyd(m, want, seed)
        base = (int(f["_c"].iloc[0]) << 40) + (int(f["_b"].iloc[0]) << 24)
        return f[extra].assign(cluster=base + label)

    return first.groupBy("_c", "_b").applyInPandas(fine, shape)


def lloyd(m: np.ndarray, k: int, seed: int, rounds: int = 20) -> np.ndarray:
    """k-means of a matrix, starting from rows drawn by distance."""
    rng = np.random.default_rng(seed)
    centres = [m[rng.integers(len(m))]]
    d = ((m - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        p = d / d.sum() if d.sum() > 0 else None
        centres.append(m[rng.choice(len(m), p=p)])
        d = np.minimum(d, ((m - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    label = np.zeros(len(m), int)
    for _ in range(rounds):
        new = np.argmin((c * c).sum(1)[None] - 2 * m @ c.T, axis=1)
        if (new == label).all() and _:
            break
        label = new
        for j in np.unique(label):
            c[j] = m[label == j].mean(0)
    return label


def cluster_select(df: DataFrame, n: int | dict[str, int], cluster: str = "cluster", order: list[Column] | None = None, id_col: str = "data_id", percentile: float = 0.0, strategy: str | None = None, preference: str = "overall_preference", group: str | None = None, seed: int = 42, accuracy: int | None = None) -> DataFrame:
    """The best row of each cluster if it is above the percentile of all preferences (by more than rounding), then the best of the rest
    until there are ``n``; all rows if there are fewer than ``n``.

    ``n`` may be a number for each value of ``group``; groups are then selected from separately, in one plan,
    and other groups go. With the strategy ``random`` a seeded random row of each cluster is taken, whatever
    its preference. Where clusters outnumber ``n``, the best of their rows are taken.
    """
    from tessera.operators.sampling import by_preference, shuffled

    order = order or by_preference(None, id_col, preference)
    quotas = {k: v for k, v in n.items() if v > 0} if isinstance(n, dict) else {"": n} if n > 0 else {}
    if not quotas:
        return df.limit(0)
    key = F.col(group) if group else F.lit("")
    rows = df.withColumn("_g", key).where(F.col("_g").isin(*quotas))
    stats = quantiles(rows, {"_q": F.col(preference)}, [int(percentile * 100) / 100], "_g", accuracy).select("_g", F.get("_q", 0).alias("_t"))
    ids = F.struct(*shuffled(seed, id_col))
    best = rows.groupBy("_g", cluster).agg(*([F.min_by(id_col, ids).alias("_i"), F.lit(None).alias("_p")] if strategy == "random" else [F.max_by(id_col, F.struct(F.col(preference).isNotNull(), F.col(preference), *_descending(df, id_col))).alias("_i"), F.max(preference).alias("_p")]))
    reps = best.join(stats, "_g").where(F.lit(strategy == "random") | (F.round("_p", 12) > F.round("_t", 12))).select(F.col("_i").alias(id_col), F.lit(1).alias("_rep"))
    rows = rows.join(reps, id_col, "left").withColumn("_rep", F.coalesce("_rep", F.lit(0)))
    return first_in_groups(rows, "_g", quotas, [F.col("_rep").desc(), *order]).select(*df.columns)


def _descending(df: DataFrame, id_col: str) -> list[Column]:
    """Columns whose maximum is the least id: negated numbers, or texts with every character turned round."""
    if dict(df.dtypes)[id_col] in ("int", "bigint", "smallint", "tinyint"):
        return [-F.col(id_col)]
    turned = F.transform(F.split(F.col(id_col), ""), lambda c: 1_114_111 - F.ascii(c))
    return [F.concat(turned, F.array(F.lit(1_114_112)))]


def cluster_quality(df: DataFrame, column: str, cluster: str = "cluster") -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz index and the centroid silhouette of clusters, as one row.

    Computed from cluster sums: counts, centroids and mean distances; centroids are compared with each other,
    rows only with centroids.
    """
    dims = F.posexplode(F.col(column)).alias("d", "x")
    long = df.select(cluster, dims)
    sums = long.groupBy(cluster, "d").agg(F.avg("x").alias("m"))
    cents = sums.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("c"))
    whole = long.groupBy("d").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("g"))
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = df.join(cents, cluster).groupBy(cluster).agg(F.avg(F.sqrt(sq(F.col(column), F.col("c")))).alias("s"), F.sum(sq(F.col(column), F.col("c"))).alias("w"), F.count(F.lit(1)).alias("n"))
    stat = near.join(cents, cluster).crossJoin(F.broadcast(whole)).withColumn("b", F.col("n") * sq(F.col("c"), F.col("g"))).persist(StorageLevel.MEMORY_AND_DISK)
    k = stat.count()
    db = _worst_ratios(stat.select(F.col(cluster).alias("id"), "s", "c"), k).agg(F.avg("r").alias("davies_bouldin"))
    ch = stat.agg((F.sum("b") / (k - 1) / (F.sum("w") / (F.sum("n") - k))).alias("calinski_harabasz"))
    return db.crossJoin(ch)  # one row each


def _worst_ratios(stat: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Of each cluster the largest (scatter + scatter) over distance to another: clusters meet by pairs of blocks."""
    n = max(1, math.ceil(k / block))
    rows = stat.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = rows.select(F.col("b").alias("i"), every.alias("j"), "id", "s", "c", F.lit(0).alias("side")).unionByName(rows.select(every.alias("i"), F.col("b").alias("j"), "id", "s", "c", F.lit(1).alias("side")))

    def worst(f: pd.DataFrame) -> pd.DataFrame:
        a, o = f[f["side"] == 0], f[f["side"] == 1]
        if not len(a) or not len(o):
            return pd.DataFrame({"id": f["id"][:0], "r": np.zeros(0)})
        x, y = np.stack(a["c"].to_list()), np.stack(o["c"].to_list())
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (a["s"].to_numpy()[:, None] + o["s"].to_numpy()[None]) / d
        r[a["id"].to_numpy()[:, None] == o["id"].to_numpy()[None]] = -np.inf
        best = r.max(1)
        keep = best > -np.inf
        return pd.DataFrame({"id": a["id"].to_numpy()[keep], "r": best[keep]})

    return sides.groupBy("i", "j").applyInPandas(worst, f"id {dict(stat.dtypes)['id']}, r double").groupBy("id").agg(F.max("r").alias("r"))
