"""A sample whose category shares follow target proportions, with a minimum for small categories.

Records are counted by the cells that their margins form; the cell weights are raked (iterative proportional
fitting) until every margin has its target; each record draws an exponential key divided by its cell's weight,
and the records with the smallest keys are taken for each label. What the minimums need is given to small
labels first and taken from the others. Keys are cut off by a histogram, so no label is ever sorted as a whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import norm_label

#: Steps of the key histogram for each doubling of the key.
STEPS = 256


def rake(counts: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Weights of cells (an array with one axis a margin) so that the weighted counts have the target margins.

    A target with no records to meet it is left out and the rest of its margin scaled up; cells without
    records weigh 0. Margins that contradict each other end at the last round's compromise, the first margin
    exact.
    """
    fitted = counts.astype(float).copy()
    for _ in range(rounds):
        change = 0.0
        for axis in reversed(range(counts.ndim)):
            other = tuple(a for a in range(counts.ndim) if a != axis)
            have = fitted.sum(other)
            want = np.where(have > 0, targets[axis], 0.0)
            if want.sum() <= 0:
                continue
            want = want / want.sum()
            ratio = np.where(have > 0, want / np.maximum(have, 1e-300), 0.0)
            shape = [1] * counts.ndim
            shape[axis] = -1
            new = fitted * ratio.reshape(shape)
            change = max(change, float(np.abs(new - fitted).max(initial=0.0)))
            fitted = new
        if change < tol:
            break
    return np.where(counts > 0, fitted / np.maximum(counts, 1), 0.0)


def quotas(size: int, shares: dict[str, float], minimums: dict[str, int], available: dict[str, int]) -> dict[str, int]:
    """Records to take of each label.

    Minimums come first, then shares of ``size`` (scaled to sum 1; largest remainders), never more than there
    are; what a label lacks goes to the others in proportion. The sum is ``size`` unless minimums need more or
    too few records exist.
    """
    labels = sorted(shares)
    total = sum(max(0.0, shares[x]) for x in labels)
    low = {x: min(available.get(x, 0), max(0, minimums.get(x, 0))) for x in labels}
    got = dict(low)
    goal = min(max(size, sum(low.values())), sum(available.get(x, 0) for x in labels))
    if total <= 0:
        return got
    fixed: dict[str, int] = {}
    while True:
        open_ = [x for x in labels if x not in fixed]
        left = goal - sum(fixed.values())
        weight = sum(max(0.0, shares[x]) for x in open_)
        if not open_ or left <= 0 or weight <= 0:
            for x in open_:
                fixed[x] = low[x]
            break
        want = {x: left * max(0.0, shares[x]) / weight for x in open_}
        over = {x: available.get(x, 0) for x in open_ if want[x] > available.get(x, 0)}
        under = {x: low[x] for x in open_ if want[x] < low[x]}
        too_much = sum(want[x] - over[x] for x in over)
        too_little = sum(under[x] - want[x] for x in under)
        if over and too_much >= too_little:
            fixed |= over
        elif under:
            fixed |= under
        else:
            whole = {x: int(math.floor(want[x] + 1e-9)) for x in open_}
            rest = left - sum(whole.values())
            for x in sorted(open_, key=lambda x: (-(want[x] - whole[x]), x)):
                if rest > 0 and whole[x] < available.get(x, 0):
                    whole[x] += 1
                    rest -= 1
            fixed |= whole
            break
    return fixed


def sample_proportional(records: DataFrame, targets: DataFrame, sizes: DataFrame, id_col: str = "data_id", label: str = "setfit_label", margins: tuple[str, ...] = (), seed: int = 23) -> tuple[DataFrame, DataFrame]:
    """The sample ``spec_name, id, setfit_label`` and the report
    ``spec_name, margin, setfit_label, wanted, available, taken, gap`` (of other margins the value in place of the label).

    ``targets``: ``spec_name, setfit_label, proportion, min_rows``; ``sizes``: ``spec_name, sample_size``. Labels
    are equal if they are so without regard to case, blanks around and ``_``, ``-`` or blanks between words;
    rows of one spec with equal labels are added up. ``margins`` are further columns of few values, each of
    which keeps the shares it has in the pool. Null labels and labels no spec names are not sampled; null
    proportions and minimums count as 0, specs without a size give an empty sample. Ids are taken as unique.
    The report has a row for each row of ``targets`` (``margin`` is the label's column, the label as written): ``wanted``
    is the larger of proportion times size and minimum; and a row for each value of the other margins, whose
    ``wanted`` is its share in the pool. ``taken`` is counted from the sample itself, ``gap`` is what that is short of.
    """
    spark = records.sparkSession
    written = targets.select("spec_name", F.col(label).alias("written"), norm_label(F.col(label)).alias("label"), "proportion", "min_rows").where("written is not null").collect()  # the targets: a small table
    pool = records.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), norm_label(F.col(label)).alias("label"), *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"m{i}") for i, m in enumerate(margins)])
    spec = targets.where(F.col(label).isNotNull()).groupBy("spec_name", norm_label(F.col(label)).alias("label")).agg(F.sum(F.coalesce("proportion", F.lit(0.0))).alias("proportion"), F.sum(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))
    spec = spec.join(sizes.groupBy("spec_name").agg(F.max("sample_size").alias("sample_size")), "spec_name", "left").collect()
    named = sorted({r["label"] for r in spec})
    pool = pool.where(F.col("label").isin(named)).persist(StorageLevel.MEMORY_AND_DISK)
    cells = pool.groupBy("label", *[f"m{i}" for i in range(len(margins))]).count().collect()  # one row a cell of the margins
    available = {x: 0 for x in named}
    for r in cells:
        available[r["label"]] += r["count"]
    by_spec: dict[str, list] = {}
    for r in spec:
        by_spec.setdefault(r["spec_name"], []).append(r)
    axes = [named, *[sorted({r[f"m{i}"] for r in cells}) for i in range(len(margins))]]
    counts = np.zeros([len(a) for a in axes])
    for r in cells:
        counts[tuple(a.index(r[c]) for a, c in zip(axes, ["label", *[f"m{i}" for i in range(len(margins))]]))] = r["count"]
    weights, report = [], []
    for name, rows in sorted(by_spec.items()):
        size = rows[0]["sample_size"] or 0
        take = quotas(size, {r["label"]: r["proportion"] for r in rows}, {r["label"]: r["min_rows"] for r in rows}, available) if size > 0 else {}
        if take and counts.size:
            goal = np.array([float(take.get(x, 0)) for x in named])
            pooled = [counts.sum(tuple(a for a in range(counts.ndim) if a != i)) for i in range(1, counts.ndim)]
            w = rake(counts, [goal / max(goal.sum(), 1), *[p / max(p.sum(), 1) for p in pooled]])
            for at in np.argwhere(w > 0):
                weights.append((name, named[at[0]], *[axes[i][at[i]] for i in range(1, len(axes))], float(w[tuple(at)]), take.get(named[at[0]], 0)))
        for r in written:
            if r["spec_name"] == name:
                wanted = float(max((r["proportion"] or 0.0) * size, r["min_rows"] or 0))
                report.append((name, label, r["written"], r["label"], wanted, available[r["label"]]))
        if take:
            for i, m in enumerate(margins):
                have = counts.sum(tuple(x for x in range(counts.ndim) if x != i + 1))
                report += [(name, m, v, v, float(sum(take.values()) * n / max(have.sum(), 1)), int(n)) for v, n in zip(axes[i + 1], have)]
    ms = [f"m{i}" for i in range(len(margins))]
    shape = ", ".join(["spec_name string", "label string", *[f"{m} string" for m in ms], "w double", "quota int"])
    rated = spark.createDataFrame(weights, shape)
    drawn = pool.join(rated, ["label", *ms])
    u = (F.pmod(F.xxhash64(F.lit(seed), "spec_name", "id"), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    key = -F.log(u) / F.col("w")
    drawn = drawn.withColumn("key", key).withColumn("step", F.floor(F.log2("key") * STEPS).cast("int"))
    hist = drawn.groupBy("spec_name", "label", "step").agg(F.count(F.lit(1)).alias("n"), F.first("quota").alias("quota"))
    so_far = F.sum("n").over(Window.partitionBy("spec_name", "label").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    edge = hist.withColumn("before", F.coalesce(so_far, F.lit(0))).where("before < quota").withColumn("left", F.col("quota") - F.col("before")).select("spec_name", "label", "step", "n", "left")
    kept = drawn.join(edge, ["spec_name", "label", "step"])
    sure = kept.where("n <= left").select("spec_name", "id", "label", *ms)
    rank = F.row_number().over(Window.partitionBy("spec_name", "label", "step").orderBy("key", "id"))
    part = kept.where("n > left").withColumn("_r", rank).where(F.col("_r") <= F.col("left")).select("spec_name", "id", "label", *ms)
    chosen = sure.unionByName(part)
    sample = chosen.select("spec_name", F.col("id").alias(id_col), F.col("label").alias("setfit_label"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("margin"), F.col(c).alias("value")) for n, c in ((label, "label"), *zip(margins, ms))]))
    taken = chosen.select("spec_name", each.alias("e")).groupBy("spec_name", "e.margin", "e.value").agg(F.count(F.lit(1)).alias("taken"))
    wanted = spark.createDataFrame(report, "spec_name string, margin string, setfit_label string, value string, wanted double, available long")
    got = wanted.join(taken, ["spec_name", "margin", "value"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    return sample, got.select("spec_name", "margin", "setfit_label", "wanted", "available", "taken", F.greatest(F.col("wanted") - F.col("taken"), F.lit(0.0)).alias("gap"))


def short_labels(report: DataFrame, label: str = "setfit_label") -> DataFrame:
    """``spec_name, setfit_label`` of the report's rows in which the sample is short of a label and too few records exist."""
    short = (F.col("margin") == label) & (F.col("gap") > 1e-9) & (F.col("available") < F.col("wanted") - F.lit(1e-9))
    return report.where(short).select("spec_name", "setfit_label").distinct()
