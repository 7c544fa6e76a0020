"""Declarative selection specs and the plan they compile to."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters, joins, preference, reshape, sampling, vectors


@dataclass(frozen=True)
class SourceSpec:
    name: str
    data_path: str = ""
    type: str | None = None
    multi_turn: bool | None = None
    language: str | None = None
    sample_size: int | None = None
    token_size: int | None = None
    oversampling: float | None = None
    sample_scored: bool = True
    setfit_limits: dict[str, float] = field(default_factory=dict)
    filter_key: str | None = None
    subset_name: str | None = None
    min_distance: float | None = None
    language_filter: list[str] | None = None
    allow_x_lang_duplicates: bool = True
    subsets: dict[str, dict] | None = None


@dataclass(frozen=True)
class SelectionSpec:
    name: str
    scoring_strategy: str | None = None
    sample_size: int | None = None
    clustering: str | None = None
    threshold_percentile_clustering: float = 0.0
    final_setfit_proportions: dict[str, float] = field(default_factory=dict)
    ordering_strategy: str = "shuffle"
    min_distance: float = 0.1
    type_dataset: str | None = None
    default_embedding_model: str | None = None
    custom_embedder: dict[str, str] = field(default_factory=dict)
    data: tuple[SourceSpec, ...] = ()


def _taken(cls: type, d: dict[str, Any]) -> dict[str, Any]:
    known = {f.name for f in fields(cls)}
    return {k: v for k, v in d.items() if k in known and v is not None}


def _limits(v: Any) -> dict[str, float]:
    """Limits come as one map or as a list of maps."""
    if isinstance(v, dict):
        return dict(v)
    return {k: x for m in v or [] for k, x in m.items()}


def source_specs(d: dict[str, Any]) -> list[SourceSpec]:
    """One spec, or one for each of its subsets, whose keys win over those of the source."""
    subsets = d.get("subsets")
    base = {k: v for k, v in d.items() if k != "subsets"}
    variants = [base] if not subsets else [{**base, "subset_name": n, **(s or {})} for n, s in (subsets.items() if isinstance(subsets, dict) else [(n, {}) for n in subsets])]
    out = []
    for v in variants:
        t = _taken(SourceSpec, v)
        if "setfit_limits" in t:
            t["setfit_limits"] = _limits(t["setfit_limits"])
        out.append(SourceSpec(**t))
    return out


def parse_spec(text: str | dict) -> SelectionSpec:
    """From YAML text, a path to it, or its parsed form: one top-level name with its settings."""
    if isinstance(text, str):
        import yaml

        text = yaml.safe_load(Path(text).read_text(encoding="utf-8") if "\n" not in text and Path(text).exists() else text)
    if not isinstance(text, dict) or not text:
        raise ValueError("a spec has one top-level name")
    name, d = list(text.items())[-1]
    data = tuple(s for x in d.get("data") or [] for s in source_specs(x))
    return SelectionSpec(name=name, data=data, **{k: v for k, v in _taken(SelectionSpec, d).items() if k not in ("name", "data")})


def specs_of_table(config: DataFrame, proportions: DataFrame | None = None) -> list[SelectionSpec]:
    """Specs from a table with a row for each spec and source; repeated rows count once."""
    rows = config.distinct().orderBy("spec_name", "name").collect()  # the specs themselves: a small table
    props: dict[str, dict[str, float]] = {}
    if proportions is not None:
        for r in proportions.collect():
            props.setdefault(r["spec_name"], {})[r["setfit_label"]] = r["proportion"]
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["spec_name"], []).append(r)
    out = []
    for name, rs in by.items():
        data = [SourceSpec(**_taken(SourceSpec, {k: v for k, v in r.asDict().items() if k not in ("spec_name", "scoring_strategy", "sample_size")})) for r in rs]
        out.append(SelectionSpec(name=name, scoring_strategy=rs[0]["scoring_strategy"], sample_size=rs[0]["sample_size"], final_setfit_proportions=props.get(name, {}), data=tuple(data)))
    return out


class Selection:
    """A spec over a pool of samples with their metrics: ``data_id, origin, messages`` and metric columns.

    Every step is a DataFrame; nothing runs before the result is read, but for the counts that oversampling,
    clustering and greedy diversity need. ``accuracy``: quantiles from bounded sketches instead of exact ones, for
    pools of billions of rows. ``cluster_column`` names given clusters; without it embeddings are
    clustered.
    """

    def __init__(self, spec: SelectionSpec, pool: DataFrame, vector: str | dict[str | None, str] | None = None, cluster_column: str | None = None, label: str = "setfit_label", seed: int | None = 42, accuracy: int | None = None) -> None:
        preference.weights_of(spec.scoring_strategy)
        self.spec, self.pool, self.vector, self.cluster_column, self.label, self.seed, self.accuracy = spec, pool, vector, cluster_column, label, seed, accuracy

    def vector_of(self, category: str | None = None) -> str:
        """The column with the vectors of a category's embedding model (of the default model: of all others).

        ``vector`` is that column for all, or a map from the names of models to columns.
        """
        if isinstance(self.vector, str):
            return self.vector
        model = self.spec.custom_embedder.get(category or "all", self.spec.default_embedding_model)
        if model not in self.vector:
            raise ValueError(f"no vectors of the embedding model {model!r}")
        return self.vector[model]

    def order(self) -> list[Column]:
        if self.spec.scoring_strategy == "random":
            return sampling.shuffled((self.spec.sample_size or 0) // 1000)
        return sampling.by_preference(self.seed)

    def source(self, s: SourceSpec, fit: DataFrame, taken: DataFrame | None = None) -> DataFrame:
        """One source: its rows scored, repeated, filtered and cut to its own budget.

        Rows that are too near a better one, or whose counterpart in another language was taken, by this source
        or an earlier one (``taken``), go first, so that they use up neither a label's limit nor the budget.
        """
        df = self.pool.where(F.col("origin") == s.name)
        df = reshape.with_defaults(df, s.name, s.language)
        df = preference.with_preference(df, self.spec.scoring_strategy, s.sample_scored, fit, label=self.label)
        if s.filter_key:
            df = filters.of_subset(df, s.filter_key, s.subset_name)
        order = self.order()
        if s.oversampling is not None and s.oversampling != 1:
            df = sampling.oversampled(df, s.oversampling, order)
            order = [*order, F.col("copy")]
        if s.language_filter:
            df = filters.in_languages(df, s.language_filter)
        if self.spec.scoring_strategy == "deita" and s.min_distance is not None and self.vector:
            ranked = filters.prefix_sum(df, order, F.lit(1), "_rank")
            df = vectors.greedy_diverse(ranked, "data_id", self.vector_of(), "_rank", s.min_distance, strict=True).drop("_rank")
        if not s.allow_x_lang_duplicates:
            df = sampling.cross_lingual_first(df, order, taken)
        if s.setfit_limits and s.sample_size:
            df = filters.within_label_limits(df, s.setfit_limits, s.sample_size, order, self.label)
        if s.sample_size is not None or s.token_size is not None:
            df = filters.within_budget(df, order, s.sample_size, s.token_size, F.col("inst_length") + F.col("resp_length"))
        return df

    def scored(self) -> DataFrame:
        """All sources of the spec together."""
        from tessera.operators.aggregates import robust_fit

        names = [s.name for s in self.spec.data]
        mine = self.pool.where(F.col("origin").isin(names)) if names else self.pool
        have = [m for m in preference.ROBUST_METRICS if m in self.pool.columns]
        fit = robust_fit(mine, have, self.label, self.accuracy) if have else mine.sparkSession.range(1).drop("id")
        for m in preference.ROBUST_METRICS:
            if m not in have:
                fit = fit.withColumn(f"{m}_center", F.lit(0.0)).withColumn(f"{m}_scale", F.lit(1.0))
        if not names:
            return preference.with_preference(mine, self.spec.scoring_strategy, True, fit, label=self.label)
        if all(replace(s, name="", data_path="", type=None, multi_turn=None, language=None) == SourceSpec(name="") for s in self.spec.data):
            # no source has settings of its own: one plan for all of them, scaled by source
            return preference.with_preference(mine, self.spec.scoring_strategy, True, fit, label=self.label)
        parts: list[DataFrame] = []
        for s in self.spec.data:
            taken = joins.union_all(*parts).select(sampling.plain_key().alias("_k")).distinct() if parts and not s.allow_x_lang_duplicates else None
            parts.append(self.source(s, fit, taken))
        return joins.union_all(*parts)

    def sampled(self) -> DataFrame:
        """The selected rows, not yet in their final order."""
        df, spec, n = self.scored(), self.spec, self.spec.sample_size
        if n is None:
            return df
        df = filters.within_length(df)
        order = self.order()
        if spec.clustering:
            if spec.clustering not in ("categories", "all"):
                raise ValueError("clustering is categories or all")
            if spec.clustering == "all":
                return self.clustered(df, n)
            return self.clustered(df, {c: int(spec.final_setfit_proportions.get(c, 0.0) * n) for c in filters.CATEGORIES})
        if spec.scoring_strategy and "embedding" in spec.scoring_strategy and self.vector:
            ranked = filters.prefix_sum(df, order, F.lit(1), "_rank")
            return vectors.greedy_select(ranked, n, "data_id", self.vector_of(), "_rank", spec.min_distance).drop("_rank")
        if spec.final_setfit_proportions:
            return sampling.stratified_top_k(df, spec.final_setfit_proportions, n, order, self.label)
        return sampling.top_k(df, n, order)

    def clustered(self, df: DataFrame, n: int | dict[str, int]) -> DataFrame:
        column, group = self.cluster_column, self.label if isinstance(n, dict) else None
        if column is None:
            if not self.vector:
                raise ValueError("clustering needs embeddings or given clusters")
            column = "cluster"
            parts = [(None, n)] if isinstance(n, int) else [(c, k) for c, k in n.items() if k > 0]
            of = [vectors.clustered(vectors.reduced(df if c is None else df.where(F.col(self.label) == c), self.vector_of(c)), "reduced", k, id_col="data_id") for c, k in parts]
            df = joins.union_all(*of) if of else df.withColumn(column, F.lit(0)).limit(0)
        return vectors.cluster_select(df, n, column, self.order(), "data_id", self.spec.threshold_percentile_clustering, self.spec.scoring_strategy, group=group, accuracy=self.accuracy)

    def result(self) -> DataFrame:
        return sampling.finished(self.sampled(), self.spec.ordering_strategy, label=self.label)
