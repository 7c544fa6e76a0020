"""Predicates on samples, labels, lengths, languages and budgets."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The task labels, in their order, and what each label's samples are scored by.
CATEGORIES = ("Math", "Coding", "Generation", "Reasoning", "Brainstorming", "Factual QA", "Extraction")
ROUTES = {
    "quality": ("Extraction", "Factual QA", "Reasoning"),
    "if_quality": ("Generation", "Brainstorming"),
    "code_quality": ("Coding",),
    "process_reward": ("Math",),
}
GENERAL_METRICS = ("quality", "complexity", "difficulty_v2", "reward", "edu_score")
MAX_SEQUENCE = 4096
#: Parts of a group that are ranked apart first.
SPLITS = 64


def without_augmented(df: DataFrame, source: str = "problem_source") -> DataFrame:
    return df.where(~F.contains(F.col(source), F.lit("augmented")))


def of_task(df: DataFrame, task: str, column: str = "task") -> DataFrame:
    return df.where(F.col(column) == task)


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)


def with_ids(df: DataFrame, ids: DataFrame, key: str = "data_id") -> DataFrame:
    """Rows whose key is in a list; each once however often the list names it."""
    return df.join(ids.select(key), key, "left_semi")


def of_subset(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(F.col(column) == name)


def in_languages(df: DataFrame, languages: list[str], identify: Callable[[Column], Column] | None = None, text: Column | None = None) -> DataFrame:
    """Rows in one of the languages: by their ``language`` if they have one, else by ``identify`` of their text
    (line breaks as blanks)."""
    lang = F.lower(F.col("language")) if "language" in df.columns else F.lit(None).cast("string")
    if identify is not None and text is not None:
        lang = F.coalesce(lang, identify(F.translate(text, "\n", " ")))
    return df.where(lang.isin([x.lower() for x in languages]))


def routed(label: Column, scorer: str) -> Column:
    """Whether samples of a label go to a scorer; scorers without a route take all."""
    return label.isin(*ROUTES[scorer]) if scorer in ROUTES else F.lit(True)


def relevant(label: Column, metric: str) -> Column:
    """Whether a metric says something about samples of a label."""
    extra = {"Generation": ("if_quality",), "Brainstorming": ("if_quality",), "Math": ("process_reward",), "Coding": ("code_quality", "code_edu")}
    out = None
    for name, own in extra.items():
        ok = F.lit(metric in GENERAL_METRICS or metric in own)
        out = F.when(label == name, ok) if out is None else out.when(label == name, ok)
    return out.otherwise(True)


def within_length(df: DataFrame, most: int = MAX_SEQUENCE) -> DataFrame:
    """Rows whose prompt and answer fit together; all, if the lengths aren't known."""
    if not {"inst_length", "resp_length"} <= set(df.columns):
        return df
    return df.where(F.col("inst_length") + F.col("resp_length") <= most)


def within_budget(df: DataFrame, order: list[Column], sample_size: int | None = None, token_size: int | None = None, tokens: Column | None = None, group: list[str] | None = None) -> DataFrame:
    """Rows of an ordered scan as long as the rows (or else the tokens) before them are under the budget.

    With ``group`` each group has a scan and a budget of its own. See :func:`prefix_sum` for the running sum.
    """
    if sample_size is not None and not group:
        return df.orderBy(*order).limit(sample_size)
    if sample_size is None and token_size is None:
        return df
    n = F.lit(1) if sample_size is not None else tokens
    budget = sample_size if sample_size is not None else token_size
    return prefix_sum(df, order, n, "_s", group).where(F.col("_s") < budget).drop("_s")


def prefix_sum(df: DataFrame, order: list[Column], n: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """``out``: the sum of ``n`` over all rows before (of the same group), in a total order, without gathering
    the table or a group in one task.

    Rows are range-partitioned and sorted, the sums of partitions (and groups in them) added up, and running
    sums taken inside of each.
    """
    by = [F.col(g) for g in group or []]
    names = [f"_g{i}" for i in range(len(by))]
    parts = df.orderBy(*by, *order).withColumn("_m", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    parts = parts.withColumn("_p", F.shiftrightunsigned("_m", 33)).withColumn("_n", F.coalesce(n, F.lit(0)))
    totals = parts.groupBy("_p", *[c.alias(x) for c, x in zip(by, names)]).agg(F.sum("_n").alias("_t"))
    earlier = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t").withColumnRenamed("_p", "_q")
    same = F.col("_p") == F.col("_q")
    for c, x in zip(by, names):
        same = same & c.eqNullSafe(F.col(x))
    inside = Window.partitionBy("_p", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    got = parts.join(before, same).withColumn(out, F.col("_b") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return got.drop("_m", "_p", "_q", "_n", "_b", *names)


def first_in_groups(df: DataFrame, group: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """Of each group the first rows of an order, as many as its quota, with their place ``_r``; other groups go.

    Rows are ranked twice: within a group and one of ``SPLITS`` parts of it, of which no more than the quota go on,
    then within the group, so that a group with a third of all rows is sorted by many tasks.
    """
    if not quotas or max(quotas.values()) <= 0:
        return df.withColumn("_r", F.lit(0)).limit(0)
    quota = F.element_at(F.create_map(*[F.lit(x) for k, v in quotas.items() for x in (k, v)]), F.col(group))
    parts = Window.partitionBy(group, "_part").orderBy(*order)
    rows = df.where(F.col(group).isin(*quotas)).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SPLITS)))
    rows = rows.withColumn("_r", F.row_number().over(parts)).where(F.col("_r") <= quota).drop("_part")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= quota)


def within_label_limits(df: DataFrame, limits: dict[str, float], sample_size: int, order: list[Column], label: str = "setfit_label") -> DataFrame:
    """The first rows of each label, as many as its limit (a share of the size, rounded up); other labels go."""
    return first_in_groups(df, label, {k: math.ceil(v * sample_size) for k, v in limits.items()}, order).drop("_r")
