"""Scorers: the protocol, the registry, adapters for models, and scorers made of columns only."""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions.code import code_score, first_json
from tessera.functions.scores import softmax_expectation, step_reward
from tessera.functions.text import fill, split_steps, truncated, word_count
from tessera.operators.aggregates import majority_label, mean_of_all, mean_of_answered, token_lengths
from tessera.operators.filters import ROUTES
from tessera.operators.joins import scatter_scores

log = logging.getLogger(__name__)

KEYS = ["data_id", "exchange_idx"]
#: Fixed value: the mark that ends a step in what a reward model reads.
STEP_MARK = "<extra_0>"


class Scorer(ABC):
    """Scores exchanges (``data_id, exchange_idx, instruction, response``, with ``label`` where it is routed)."""

    name: str
    routes: tuple[str, ...] | None = None

    @abstractmethod
    def score_rows(self, rows: DataFrame) -> DataFrame:
        """``data_id, exchange_idx, score`` of routed exchanges."""

    def score(self, exchanges: DataFrame) -> DataFrame:
        """All exchanges with ``score``: only routed ones are scored, before anything expensive; others get null.

        Without labels every exchange is scored.
        """
        rows = exchanges
        if self.routes and "label" in exchanges.columns:
            rows = exchanges.where(F.col("label").isin(*self.routes))
        return scatter_scores(exchanges, self.score_rows(rows), KEYS, "score")

    def per_sample(self, exchanges: DataFrame) -> DataFrame:
        return mean_of_answered(self.score(exchanges), "score", self.name)


class ColumnScorer(Scorer):
    """A scorer that is a column expression: it stays in generated code."""

    def __init__(self, name: str, expression: Callable[[], Column], routes: tuple[str, ...] | None = None, skip_empty: bool = True, all_rows: bool = False) -> None:
        self.name, self.expression, self.routes, self.skip_empty, self.all_rows = name, expression, routes, skip_empty, all_rows

    def score_rows(self, rows: DataFrame) -> DataFrame:
        return rows.select(*KEYS, self.expression().alias("score"))

    def score(self, exchanges: DataFrame) -> DataFrame:
        """No join is needed: the expression is null where the exchange isn't routed."""
        s = self.expression()
        if self.routes and "label" in exchanges.columns:
            s = F.when(F.col("label").isin(*self.routes), s)
        return exchanges.withColumn("score", s)

    def per_sample(self, exchanges: DataFrame) -> DataFrame:
        scored = self.score(exchanges)
        return mean_of_all(scored, "score", self.name) if self.all_rows else mean_of_answered(scored, "score", self.name, self.skip_empty)


Batch = Callable[[pd.DataFrame], pd.Series]


class ModelScorer(Scorer):
    """A model behind an Arrow iterator: loaded once a task, called with batches of bounded size.

    ``load`` returns a function from a frame of ``instruction, response`` to scores; a batch that fails gives
    ``on_failure`` for its rows.
    """

    def __init__(self, name: str, load: Callable[[], Batch], routes: tuple[str, ...] | None = None, batch: int = 512, on_failure: float | None = None) -> None:
        self.name, self.load, self.routes, self.batch, self.on_failure = name, load, routes, batch, on_failure

    def score_rows(self, rows: DataFrame) -> DataFrame:
        load, size, failed, name = self.load, self.batch, self.on_failure, self.name

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for f in frames:
                for s in range(0, len(f), size):
                    part = f.iloc[s : s + size]
                    model = model or load()
                    try:
                        out = pd.Series(model(part[["instruction", "response"]])).to_numpy(dtype=float)
                    except Exception:  # noqa: BLE001 a failed batch must not end the job
                        log.exception("%s failed for a batch of %d rows", name, len(part))
                        out = [failed] * len(part)
                    yield pd.DataFrame({"data_id": part["data_id"].to_numpy(), "exchange_idx": part["exchange_idx"].to_numpy(), "score": out})

        kinds = dict(rows.dtypes)
        return rows.select(*KEYS, "instruction", "response").mapInPandas(run, f"data_id {kinds['data_id']}, exchange_idx {kinds['exchange_idx']}, score double")


def generate(rows: DataFrame, prompt: Column, load: Callable[[], Callable[[list[str]], list[Any]]], out: str = "completion", returns: str = "string", batch: int = 512) -> DataFrame:
    """``rows`` with a model's answer to ``prompt``: text, or ``map<int,double>`` of log probabilities of the
    first token. A failed batch gives nulls. The model is loaded once a worker process."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            got: list[Any] = []
            for k in range(0, len(s), batch):
                part = s.iloc[k : k + batch].tolist()
                try:
                    got += list(model(part))
                except Exception:  # noqa: BLE001
                    log.exception("no answers for a batch of %d prompts", len(part))
                    got += [None] * len(part)
            yield pd.Series(got, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(run, returns)(prompt))


def quality_from_logprobs(logprobs: str = "logprobs") -> ColumnScorer:
    return ColumnScorer("quality", lambda: softmax_expectation(F.col(logprobs)), ROUTES["quality"])


def complexity_from_logprobs(logprobs: str = "logprobs") -> ColumnScorer:
    return ColumnScorer("complexity", lambda: softmax_expectation(F.col(logprobs)), None, all_rows=True)


def difficulty_from_logit(logit: str = "logit") -> ColumnScorer:
    return ColumnScorer("difficulty_v2", lambda: F.col(logit))


def process_reward_from_steps(rewards: str = "rewards", how: str = "min") -> ColumnScorer:
    """Exchanges without a response count too."""
    return ColumnScorer("process_reward", lambda: step_reward(F.col(rewards), how), ROUTES["process_reward"], skip_empty=False)


def code_quality_from_review(review: str = "review") -> ColumnScorer:
    return ColumnScorer("code_quality", lambda: code_score(F.col(review))["score"], ROUTES["code_quality"])


def steps(rows: DataFrame, sep: str = "\n\n") -> DataFrame:
    return rows.withColumn("steps", split_steps(F.col("response"), sep))


def evaluated(rows: DataFrame, constraints: str = "constraints", compat: bool = False) -> DataFrame:
    """``rows`` with each constraint's outcome: ``outcomes``, an array of ``type, expr, followed`` in which null
    means that rules can't tell."""
    one = lambda c: F.struct(c["type"].alias("type"), c["expr"].alias("expr"), rules.evaluate(c["type"], c["expr"], F.col("instruction"), F.col("response"), compat).alias("followed"))
    return rows.withColumn("outcomes", F.transform(F.col(constraints), one))


def instruction_following(rows: DataFrame, constraints: str = "constraints", answers: str | None = None, fallback: str | None = None, compat: bool = False) -> DataFrame:
    """``rows`` with ``unchecked`` (constraints for a model), ``followed`` (outcomes of all that were checked, those
    of rules first) and ``score``.

    ``answers``: ``map<string,boolean>`` by the number of the unchecked constraint; numbers it lacks count as
    not checked. ``fallback``: a model's mark out of ten for rows without any checked constraint.
    """
    out = evaluated(rows, constraints, compat)
    out = out.withColumn("unchecked", F.transform(F.filter("outcomes", lambda o: o["followed"].isNull()), lambda o: F.struct(o["type"].alias("type"), o["expr"].alias("expr"))))
    ruled = F.filter(F.transform(F.col("outcomes"), lambda o: o["followed"]), lambda x: x.isNotNull())
    asked = F.filter(F.transform(F.col("unchecked"), lambda c, i: F.try_element_at(F.col(answers), (i + 1).cast("string"))), lambda x: x.isNotNull()) if answers else F.array().cast("array<boolean>")
    out = out.withColumn("followed", F.concat(ruled, asked))
    return out.withColumn("score", rules.instruction_score(F.col("followed"), F.col(fallback) if fallback else None)).drop("outcomes")


def token_counter(exchanges: DataFrame, count: Callable[[Column], Column] = word_count) -> DataFrame:
    return token_lengths(exchanges, count(F.col("instruction")), count(F.col("response")))


def classify(exchanges: DataFrame, predict: Callable[[Column], Column]) -> DataFrame:
    """``data_id, setfit_label``: the majority of the labels of a sample's user messages."""
    return majority_label(exchanges.select("data_id", "exchange_idx", predict(F.col("instruction")).alias("label")))


def classify_by_prompt(rows: DataFrame, template: str, load: Callable[[], Callable[[list[str]], list[Any]]], examples: dict[str, str] | None = None, text: str = "instruction", out: str = "category") -> DataFrame:
    """``rows`` with the category that a model answers to a zero-shot or (with ``examples``, by category) few-shot
    prompt: the ``answer`` of the first JSON object of its completion (``{answer, explanation}``), ``""`` where there is
    none. ``template`` has a place ``{input}``, and ``{examples}`` for a line with each category and its example."""
    shown = "\n".join(f'{i}. {c}\n   e.g., "{e}"' for i, (c, e) in enumerate((examples or {}).items(), 1))
    got = generate(rows, fill(template, input=F.col(text), examples=F.lit(shown)), load, "_completion")
    answer = F.from_json(first_json(F.col("_completion")), "answer string, explanation string")
    return got.withColumn(out, F.coalesce(answer["answer"], F.lit(""))).withColumn("explanation", answer["explanation"]).drop("_completion")


def difficulty_prompt(template: str, category: Column, instruction: Column, render: Callable[[Column], Column], budget: int = 1024) -> Column:
    """What a difficulty model reads: a system turn that names the category, then the instruction, rendered by a chat
    template; of its words (the stand-in for tokens) the last ``budget``."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    text = render(F.array(turn("system", fill(template, category=category)), turn("user", instruction)))
    return F.array_join(truncated(F.split(text, " "), budget, "left"), " ")


def joined_steps(rows: DataFrame, sep: str = "\n\n", out: str = "marked_response") -> DataFrame:
    """``rows`` with what a reward model reads as the answer: the steps of the response, the mark after each."""
    return steps(rows, sep).withColumn(out, F.concat(F.array_join("steps", STEP_MARK), F.lit(STEP_MARK)))


class InstructionScorer(Scorer):
    """Instruction following as a scorer: ``constraints`` and, if they are known, ``answers`` and ``fallback`` of a model."""

    name, routes = "if_quality", ROUTES["if_quality"]

    def __init__(self, constraints: str = "constraints", answers: str | None = None, fallback: str | None = None, compat: bool = False) -> None:
        self.options = (constraints, answers, fallback, compat)

    def score_rows(self, rows: DataFrame) -> DataFrame:
        return instruction_following(rows, *self.options).select(*KEYS, "score")


class Analysis:
    """An analysis that isn't one score an exchange: ``per_sample`` is a function of the exchanges."""

    def __init__(self, name: str, run: Callable[[DataFrame], DataFrame]) -> None:
        self.name, self.per_sample = name, run


def embedding_distances(id_col: str = "data_id", vector: str = "embedding", text: str = "instruction") -> Analysis:
    """Distance of each row to the nearest vector that isn't its own text's."""
    from tessera.operators.vectors import text_nearest_distance

    return Analysis("embedding_distance", lambda df: text_nearest_distance(df, id_col, vector, text))


def stats_of(group: str = "origin") -> Analysis:
    """Samples, user messages and mean turns of each source, from exchanges with their source."""

    def run(df: DataFrame) -> DataFrame:
        n = df.groupBy("data_id", group).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("user_messages"), F.avg("n").alias("avg_turns"))

    return Analysis("dataset_stats", run)


class Scorers:
    """Scorers by the name of their analysis."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[..., Scorer | Analysis]] = {}

    def register(self, name: str, make: Callable[..., Scorer | Analysis]) -> None:
        self._made[name] = make

    def names(self) -> list[str]:
        return sorted(self._made)

    def get(self, name: str, **options: Any) -> Scorer | Analysis:
        if name not in self._made:
            raise ValueError(f"unknown analysis {name!r}; known are {', '.join(sorted(self._made))}")
        return self._made[name](**options)


def default_scorers() -> Scorers:
    """Every analysis by its name."""
    s = Scorers()
    s.register("quality", quality_from_logprobs)
    s.register("complexity", complexity_from_logprobs)
    s.register("difficulty_v2", difficulty_from_logit)
    s.register("process_reward_modelling", process_reward_from_steps)
    s.register("code_quality", code_quality_from_review)
    s.register("if_quality", InstructionScorer)
    s.register("tokens", lambda count=word_count: Analysis("tokens", lambda df: token_counter(df, count)))
    s.register("categories_v2", lambda predict: Analysis("categories_v2", lambda df: classify(df, predict)))
    s.register("embedding_distance", embedding_distances)
    s.register("dataset_stats", stats_of)
    return s
