"""Runs a selection spec from its files: sources and metric columns in, the selected samples and their metrics out.

``python -m tessera.plans.runner --config spec.yaml --input_dir DATA --output_dir OUT``
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregates, joins, reshape, sampling
from tessera.plans.spec import Selection, SelectionSpec, SourceSpec, parse_spec
from tessera.sources import readers, writers


class ChatHooks:
    """Supervised samples: chat form where a source has single turns; compared by their first answer."""

    def preprocess(self, df: DataFrame, source: SourceSpec) -> DataFrame:
        return reshape.to_chat_for_selection(df, source.multi_turn)

    def prompt(self, df: DataFrame) -> Column:
        return reshape.first_answer(F.col("messages"))

    def postprocess(self, df: DataFrame) -> DataFrame:
        return df


class ChosenHooks(ChatHooks):
    """Preference samples with a chosen and a rejected conversation; compared by their user turns."""

    def preprocess(self, df: DataFrame, source: SourceSpec) -> DataFrame:
        return df

    def prompt(self, df: DataFrame) -> Column:
        return reshape.preference_prompt(df, "dpo")


class PairHooks(ChosenHooks):
    """A good and a bad example on neighbouring rows are one sample while it is selected."""

    def preprocess(self, df: DataFrame, source: SourceSpec) -> DataFrame:
        packed = reshape.pack_pairs(readers.positions(df) if "position" not in df.columns else df)
        return packed.withColumn("position", (F.col("position") / 2).cast("bigint"))  # metrics have a line a pair

    def prompt(self, df: DataFrame) -> Column:
        return reshape.preference_prompt(df, "kto")

    def postprocess(self, df: DataFrame) -> DataFrame:
        """Both rows again, the good one first; an order of the pairs stays theirs."""
        return reshape.unpack_pairs(df.withColumn("position", F.lit(0))).drop("position")


HOOKS: dict[str | None, type[ChatHooks]] = {None: ChatHooks, "sft": ChatHooks, "kto": PairHooks, "dpo": ChosenHooks}


def hooks_of(kind: str | None) -> ChatHooks:
    if kind not in HOOKS:
        raise ValueError(f"unknown type of dataset {kind!r}; known are sft, kto and dpo")
    return HOOKS[kind]()


@dataclass
class Run:
    """``root`` stands for ``DATA_PATH`` in the spec; ``metrics`` is the folder of metric columns (default: ``root``).

    ``preprocess``: by the name of a source, a function of its rows. ``schemas``: by name, the schema of its file.
    """

    spark: SparkSession
    spec: SelectionSpec
    root: str
    metrics: str | None = None
    preprocess: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    seed: int | None = 42

    def path(self, s: SourceSpec) -> str:
        return readers.resolve_path(s.data_path, self.root)

    def source(self, s: SourceSpec) -> DataFrame:
        """A source in the form in which it is selected from, with its metrics, ``origin`` and ``language``."""
        df = readers.read_source(self.spark, self.path(s), self.schemas.get(s.name))
        if s.name in self.preprocess:
            df = df.transform(self.preprocess[s.name])
        df = hooks_of(self.spec.type_dataset).preprocess(df, s)
        df = readers.read_metrics(self.spark, self.metrics or self.root, s.name, df)
        return reshape.with_defaults(df, s.name, s.language)

    def pool(self) -> DataFrame:
        """All sources; each file once, however many subsets the spec makes of it."""
        readers.check_presence(self.spark, sorted({self.path(s) for s in self.spec.data}))
        return joins.union_all(*[self.source(s) for s in {s.name: s for s in self.spec.data}.values()])

    def selection(self, **options) -> Selection:  # noqa: ANN003
        return Selection(self.spec, self.pool(), seed=self.seed, **options)

    def result(self, **options) -> DataFrame:  # noqa: ANN003
        hooks = hooks_of(self.spec.type_dataset)
        chosen = self.selection(**options).sampled()
        if "messages" not in chosen.columns:
            chosen = chosen.orderBy(*sampling.ordering(self.spec.ordering_strategy))
            return hooks.postprocess(chosen)
        return hooks.postprocess(sampling.finished(chosen, self.spec.ordering_strategy))

    def write(self, out: str, **options) -> None:  # noqa: ANN003
        """The selected samples as JSON lines, their metrics as tables, and how many came from where."""
        got = self.result(**options)
        metrics = [m for m in (*readers.METRIC_FOLDERS.values(), "overall_preference") if m in got.columns]
        writers.write_jsonl(got.drop(*metrics), f"{out}/{self.spec.name}")
        if "data_id" in got.columns:
            writers.write_metrics(got, f"{out}/metrics", metrics)
        writers.write_table(aggregates.composition(got, "origin"), f"{out}/composition", by=None)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True)
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    p.add_argument("--metrics_dir")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    Run(spark, parse_spec(a.config), a.input_dir, a.metrics_dir).write(a.output_dir)


if __name__ == "__main__":
    main()
