"""Sources: JSON lines, metric columns, registries, templates, and checks that they are there."""

from __future__ import annotations

import fnmatch
import logging
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scores import strict_number
from tessera.operators.reshape import numbered

log = logging.getLogger(__name__)

CONVERSATIONS = "data_id string, messages array<struct<role:string,content:string>>, origin string, language string"
INSTRUCTIONS = "data_id string, instruction string, input string, output string, origin string, language string"
#: Folders of metric columns and the columns they become.
METRIC_FOLDERS = {
    "complexity_scores": "complexity",
    "quality_scores": "quality",
    "categories_v2": "setfit_label",
    "tokens_scores/instructions": "inst_length",
    "tokens_scores/responses": "resp_length",
    "tokens_scores/last_responses": "last_resp_length",
    "code_quality_scores": "code_quality",
    "if_quality_scores": "if_quality",
    "process_reward_modelling_scores": "process_reward",
    "difficulty_v2_scores": "difficulty_v2",
}


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """One record a line under a fixed schema; fields the file lacks are null, others are left out."""
    return spark.read.schema(schema).json(path)


def resolve_path(path: str, root: str) -> str:
    return path.replace("DATA_PATH", root)


def read_source(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, ORC, CSV with a header or JSON lines, by the path's ending; a folder is Parquet."""
    ending = Path(path.rstrip("/")).suffix.lower()
    if ending in (".json", ".jsonl"):
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    if ending == ".csv":
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        return (reader.schema(schema) if schema else reader).csv(path)
    if ending == ".orc":
        return spark.read.orc(path)
    return spark.read.parquet(path)


def union_subsets(subsets: dict[str, DataFrame]) -> DataFrame:
    """Subsets of one source in one table, each row with its ``subset``."""
    if not subsets:
        raise ValueError("a source without subsets")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("subset", F.lit(n)) for n, d in subsets.items()])


def positions(df: DataFrame, out: str = "position") -> DataFrame:
    """Rows numbered from 0 in the order of their files."""
    return numbered(df, out)


def read_metric_column(spark: SparkSession, path: str, name: str, text: bool = False) -> DataFrame:
    """``position, name`` of a file with one value a line; ``None`` and ``NaN`` are null."""
    rows = positions(spark.read.text(path))
    value = F.trim("value")
    return rows.select("position", (F.when(~value.isin("None", "NaN", ""), value) if text else strict_number(value)).alias(name))


def attach_positional(samples: DataFrame, columns: Iterable[DataFrame]) -> DataFrame:
    """Metric columns by position, for files without ids: they are brought together by one aggregate and joined
    once. Lines beyond either end have no partner and drop out or stay null. Samples that have a ``position``
    keep it for that."""
    out = samples if "position" in samples.columns else positions(samples)
    parts = list(columns)
    if parts:
        names = [(c.columns[1], c.dtypes[1][1]) for c in parts]
        wide = reduce(DataFrame.unionByName, [c.select("position", *[(F.col(n) if n in c.columns else F.lit(None).cast(k)).alias(n) for n, k in names]) for c in parts])
        wide = wide.groupBy("position").agg(*[F.max(n).alias(n) for n, _ in names])
        out = out.join(wide, "position", "left")
    return out.drop("position")


def read_metrics(spark: SparkSession, root: str, dataset: str, samples: DataFrame) -> DataFrame:
    """``samples`` with every metric found under ``root``; missing ones are logged and left out."""
    found = []
    for folder, name in METRIC_FOLDERS.items():
        label = name == "setfit_label"
        path = f"{root}/{folder}/{dataset}{'_aggr' if label else ''}.csv"
        if exists(spark, path):
            found.append(read_metric_column(spark, path, name, text=label))
        else:
            log.warning("no %s for %s", name, dataset)
    return attach_positional(samples, found)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or any match of a pattern) exists on its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def check_presence(spark: SparkSession, paths: Iterable[str]) -> None:
    """Fails before anything is read if a data path is missing."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("data paths do not exist: " + ", ".join(missing))


def result_exists(spark: SparkSession, folder: str, name: str, repeat: bool = False) -> bool:
    """Whether a result is there already and need not be made again."""
    return not repeat and exists(spark, f"{folder}/{name}*")


Loader = Callable[[SparkSession], DataFrame]


class Registry:
    """Datasets by name, each with a title and a loader; a wildcard name stands for all files of a prefix."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, Loader]] = {}
        self._patterns: dict[str, Callable[[str], Loader]] = {}

    def register(self, name: str, title: str, loader: Loader) -> None:
        self._known[name] = (title, loader)

    def register_pattern(self, pattern: str, loader_of: Callable[[str], Loader]) -> None:
        self._patterns[pattern] = loader_of

    def names(self) -> list[str]:
        return sorted(self._known)

    def title(self, name: str) -> str:
        return self._known[name][0] if name in self._known else name

    def loader(self, name: str) -> Loader:
        if name in self._known:
            return self._known[name][1]
        for pattern, loader_of in self._patterns.items():
            if fnmatch.fnmatchcase(name, pattern):
                return loader_of(name)
        raise ValueError(f"unknown dataset {name!r}; known are {', '.join(self.names())}")

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        return self.loader(name)(spark)

    def create_views(self, spark: SparkSession) -> None:
        """Every registered dataset as a temporary view, for SQL."""
        for name, (_, loader) in self._known.items():
            loader(spark).createOrReplaceTempView(name)


# Places that the prompt templates of model scorers have.
TEMPLATES = {
    "classify_instruction": ("instruction",),
    "classify_instruction_fewshot": ("instruction",),
    "classify_instruction_peft": ("instruction",),
    "code_revision": ("instruction", "output"),
    "if_quality_constraint": ("instruction",),
    "if_quality_question": ("output", "questions"),
    "if_quality_analyze": ("instruction", "output"),
}


def read_template(folder: str, name: str) -> str:
    """A prompt template, whose places :func:`tessera.functions.text.fill` fills."""
    if name not in TEMPLATES:
        raise ValueError(f"unknown template {name!r}")
    return (Path(folder) / f"{name}_template.txt").read_text(encoding="utf-8")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """``messages``, or ``prompt`` and ``completion``, of a training file; fails if it has neither."""
    df = read_source(spark, path)
    if "messages" in df.columns:
        return df.select("messages")
    if {"prompt", "completion"} <= set(df.columns):
        return df.select("prompt", "completion")
    raise ValueError("a training file needs messages, or prompt and completion")
