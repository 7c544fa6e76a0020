"""Queries of the core over the tables of a directory, and the SQL that says the same.

Where the tables hold no model output, a fixed stand-in is computed from the rows (said at each query); the
operators are the same as for real scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import code, rules, scores, text
from tessera.operators import aggregates, filters, joins, preference, reshape, sampling, scorers, vectors
from tessera.operators.filters import CATEGORIES
from tessera.plans.runner import Run
from tessera.plans.spec import Selection, SelectionSpec, SourceSpec, parse_spec
from tessera.sources import readers, writers

METRICS = ("quality", "complexity", "difficulty_v2", "if_quality", "process_reward", "code_quality")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Latest row of each conversation in canonical form."""
    c = table(spark, d, "conversations").select("data_id", "messages", "origin", "language", "ingested_at")
    return reshape.canonical_conversations(reshape.latest(c).where(F.col("messages").isNotNull()))


def instructions(spark: SparkSession, d: str) -> DataFrame:
    return reshape.latest(table(spark, d, "instructions").select("data_id", "instruction", "input", "output", "origin", "language", "ingested_at"))


def analysis(spark: SparkSession, d: str) -> DataFrame:
    return reshape.latest(table(spark, d, "analysis").drop("overall_preference"), "scored_at")


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Latest label of each sample, spelled as the fixed labels are; others are null."""
    c = reshape.latest(table(spark, d, "categories"), "classified_at")
    plain = F.trim(F.regexp_replace(F.lower("setfit_label"), r"[\s_-]+", " "))
    known = F.coalesce(*[F.when(plain == x.lower(), x) for x in CATEGORIES])
    return c.withColumn("setfit_label", known)


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Samples with scores and labels, without their texts; a null origin is left out."""
    a = analysis(spark, d).where(F.col("origin").isNotNull())
    return joins.attach_metrics(a, labels(spark, d), "setfit_label")


def all_exchanges(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges of conversations; ``label``: a fixed stand-in, the label at the prompt's length modulo 7."""
    e = reshape.exchanges(conversations(spark, d), "origin")
    lab = F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (F.length("instruction") % 7 + 1).cast("int"))
    return e.withColumn("label", lab)


# ---- reshaping --------------------------------------------------------------------------------------------


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    return reshape.exchanges(conversations(spark, d))


def exchange_counts(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("data_id", reshape.exchange_count(F.col("messages")).alias("num_exchanges"))


def ingest_chat(spark: SparkSession, d: str) -> DataFrame:
    c = reshape.to_chat(reshape.ingest_instructions(instructions(spark, d).where("instruction is not null")))
    m = F.col("messages")
    return c.select("data_id", F.size(m).alias("turns"), F.get(m, 0)["role"].alias("first_role"), F.get(m, 0)["content"].alias("prompt"), F.get(m, 1)["content"].alias("answer"))


def joined_prompts(spark: SparkSession, d: str) -> DataFrame:
    return instructions(spark, d).select("data_id", text.join_for_analysis(F.col("instruction"), F.col("input")).alias("prompt"))


def selection_chat(spark: SparkSession, d: str) -> DataFrame:
    c = reshape.to_chat_for_selection(instructions(spark, d).where("instruction is not null"))
    return c.select("data_id", F.get("messages", 0)["content"].alias("prompt"), F.get("messages", 1)["content"].alias("answer"))


def normal_roles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("data_id is not null")
    roles = F.transform(reshape.normalise_messages(F.col("messages")), lambda m: m["role"])
    return c.select("data_id", F.explode(roles).alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("turns"))


def renamed(spark: SparkSession, d: str) -> DataFrame:
    raw = instructions(spark, d).select("data_id", F.col("instruction").alias("problem"), F.col("output").alias("solution"))
    return reshape.rename(raw, instruction="problem", output="solution")


def default_columns(spark: SparkSession, d: str) -> DataFrame:
    c = reshape.with_defaults(conversations(spark, d), "unknown", "EN")
    return c.groupBy("origin", F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("n"))


def ids_without_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "instructions").select("data_id").distinct().select("data_id", reshape.id_without_language(F.col("data_id")).alias("plain_id"))


def assigned_ids(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "eval_items").select("item_id", "benchmark")
    return reshape.assign_ids(s, "eval_items", ["item_id"]).select("item_id", "data_id")


def first_answers(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("data_id", reshape.first_answer(F.col("messages")).alias("text"))


def empty_system_dropped(spark: SparkSession, d: str) -> DataFrame:
    m = reshape.drop_empty_system(F.col("messages"))
    return conversations(spark, d).select("data_id", F.size(m).alias("turns"), F.get(m, 0)["role"].alias("first_role"))


def _kto(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in pairs: of each conversation its first turn with its answer, and with none."""
    c = conversations(spark, d).select("data_id", F.slice("messages", 1, 1).alias("prompt"))
    c = filters.prefix_sum(c, [F.col("data_id")], F.lit(1), "i")
    both = F.array(F.struct((F.col("i") * 2).cast("bigint").alias("position"), F.lit(True).alias("label")), F.struct((F.col("i") * 2 + 1).cast("bigint").alias("position"), F.lit(False).alias("label")))
    return c.select("data_id", "prompt", F.inline(both)).select("position", "data_id", "prompt", "label")


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = reshape.pack_pairs(_kto(spark, d))
    return p.select("position", "data_id", "label", F.col("negative_example.label").alias("negative_label"), reshape.preference_prompt(p, "kto").alias("prompt"))


def preference_unpacked(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unpack_pairs(reshape.pack_pairs(_kto(spark, d))).select("position", "data_id", "label")


def chosen_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).withColumnRenamed("messages", "chosen")
    return c.select("data_id", reshape.preference_prompt(c, "dpo").alias("prompt"))


def prompt_completion(spark: SparkSession, d: str) -> DataFrame:
    c = reshape.prompt_completion(conversations(spark, d))
    return c.select("data_id", F.size("prompt").alias("prompt_turns"), F.get("completion", 0)["role"].alias("role"), F.get("completion", 0)["content"].alias("completion"))


def chatml_rendered(spark: SparkSession, d: str) -> DataFrame:
    return conversations(spark, d).select("data_id", reshape.chatml(F.col("messages")).alias("text"))


def instruct_rendered(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).where(reshape.alternates(F.col("messages")))
    return c.select("data_id", reshape.instruct_template(F.col("messages")).alias("text"))


def all_response_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of every response, also of those of one line, which are parted in sentences."""
    e = scorers.steps(reshape.exchanges(conversations(spark, d)))
    return e.select("data_id", "exchange_idx", F.size("steps").alias("n_steps"), F.get("steps", 0).alias("first_step"))


def response_steps(spark: SparkSession, d: str) -> DataFrame:
    e = scorers.steps(reshape.exchanges(conversations(spark, d)).where(F.contains("response", F.lit("\n"))))
    return e.select("data_id", "exchange_idx", F.size("steps").alias("n_steps"), F.get("steps", 0).alias("first_step"))


def cleaned_code(spark: SparkSession, d: str) -> DataFrame:
    e = reshape.exchanges(conversations(spark, d)).where(F.contains("response", F.lit("```")))
    return e.select("data_id", "exchange_idx", text.clean_code(F.col("response")).alias("code"))


def truncated_responses(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.col("response"), " ")
    e = reshape.exchanges(conversations(spark, d))
    return e.select("data_id", "exchange_idx", F.array_join(text.truncated(w, 5), " ").alias("head"), F.array_join(text.truncated(w, 5, "left"), " ").alias("tail"))


# ---- lengths, labels, statistics ----------------------------------------------------------------------------


def token_lengths(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.token_lengths(reshape.exchanges(conversations(spark, d)))


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.corpus_tokens(token_lengths(spark, d))


def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.dataset_stats(conversations(spark, d).where("origin is not null"), reshape.exchange_count(F.col("messages")))


def majority_labels(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.majority_label(all_exchanges(spark, d))


def composition_by_origin(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.composition(analysis(spark, d), "origin")


def composition_by_label(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.composition(labels(spark, d), "setfit_label")


def composition_by_language(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.composition(instructions(spark, d).withColumn("language", F.lower("language")), "language")


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.histogram(pool(spark, d), "complexity", 40, "setfit_label")


def preference_stats(spark: SparkSession, d: str) -> DataFrame:
    p = preference.with_preference(pool(spark, d), "quality")
    return aggregates.mean_and_median(p, "overall_preference")


def sampled_totals(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sampled_totals(filters.within_length(pool(spark, d), 150))


# ---- scorers ------------------------------------------------------------------------------------------------


def _standin() -> Column:
    """A fixed stand-in for a score: the response's length modulo 13 over 13."""
    return F.length("response") % 13 / F.lit(13.0)


def mean_complexity(spark: SparkSession, d: str) -> DataFrame:
    return scorers.ColumnScorer("complexity", _standin, None, all_rows=True).per_sample(all_exchanges(spark, d))


def mean_quality(spark: SparkSession, d: str) -> DataFrame:
    return scorers.ColumnScorer("quality", _standin, filters.ROUTES["quality"]).per_sample(all_exchanges(spark, d))


def mean_difficulty(spark: SparkSession, d: str) -> DataFrame:
    return scorers.ColumnScorer("difficulty_v2", _standin).per_sample(all_exchanges(spark, d))


def mean_process_reward(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in rewards: the lengths of the response's steps."""
    e = scorers.steps(all_exchanges(spark, d)).withColumn("rewards", F.transform("steps", lambda s: F.length(s).cast("double")))
    return scorers.process_reward_from_steps().per_sample(e)


def routed_scores(spark: SparkSession, d: str) -> DataFrame:
    e = scorers.ColumnScorer("if_quality", _standin, filters.ROUTES["if_quality"]).score(all_exchanges(spark, d))
    return e.select("data_id", "exchange_idx", "label", "score")


def softmax_marks(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in log probabilities: the first five numbers of an embedding times ten; the sixth mark is missing."""
    m = F.map_from_arrays(F.array(*[F.lit(i) for i in scores.MARK_IDS[:5]]), F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 10))
    return table(spark, d, "embeddings").select("vec_id", F.round(scores.softmax_expectation(m), 6).alias("mark"))


def step_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in logits: pairs of neighbouring numbers of an embedding, every second one marked."""
    e = F.col("embedding")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.array(F.get(e, i).cast("double"), F.get(e, i + 1).cast("double")))
    mask = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: i % 2 == 0)
    p = scores.step_probabilities(pairs, mask)
    return table(spark, d, "embeddings").select("vec_id", F.size(p).alias("steps"), F.round(scores.step_reward(p), 6).alias("least"), F.round(scores.step_reward(p, "mean"), 6).alias("mean"))


def _constraints() -> Column:
    """Fixed constraints put to every exchange."""
    rows = [
        ("length", "at least 20 words"), ("length", "less than 3 sentences"), ("length", "2-4 paragraphs"), ("keyword_included", "the; a"), ("keyword_avoided", "but; record"),
        ("keyword_frequency", "use the word needs 1 times"), ("keyword_frequency", "letter e at least 12 times"), ("punctuation", "do not use commas"), ("letter_case", "all in lowercase"),
        ("choose_output", "Yes; No"), ("start_and_ending", "start; Any goalkeeper worth"), ("start_and_ending", "ending; ."), ("start_and_ending", "wrap in double quotes"), ("repeat_prompt", "repeat the request"), ("language", "in English"),
    ]
    return F.array(*[F.struct(F.lit(t).alias("type"), F.lit(e).alias("expr")) for t, e in rows])


def constraint_outcomes(spark: SparkSession, d: str) -> DataFrame:
    e = scorers.evaluated(reshape.exchanges(conversations(spark, d)).withColumn("constraints", _constraints()))
    o = e.select("data_id", "exchange_idx", F.posexplode("outcomes").alias("nth", "o"))
    return o.select("data_id", "exchange_idx", "nth", F.col("o.followed").alias("followed"))


def instruction_scores(spark: SparkSession, d: str) -> DataFrame:
    e = scorers.instruction_following(reshape.exchanges(conversations(spark, d)).withColumn("constraints", _constraints()))
    return e.select("data_id", "exchange_idx", F.size("unchecked").alias("unchecked"), F.size("followed").alias("checked"), F.round("score", 6).alias("score"))


def rule_checks(spark: SparkSession, d: str) -> DataFrame:
    """Numbers the rules are built on, of every response."""
    r = F.col("response")
    e = reshape.exchanges(conversations(spark, d))
    return e.select("data_id", "exchange_idx", text.occurrences(r, F.lit(" ")).alias("blanks"), rules.sentence_count(r).alias("sentences"), rules.paragraph_count(r).alias("paragraphs"), rules.is_lower(r).alias("lower"), rules.is_upper(r).alias("upper"), rules.negated(r).alias("negated"), rules.relation(r).alias("relation"))


def cleaned_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in answers of a model: a JSON object around the prompt's opening."""
    i = instructions(spark, d).where("instruction is not null")
    head = F.regexp_replace(F.substring("instruction", 1, 20), r'["\\\n\t{}]', "")
    made = F.concat(F.lit('Sure: {"answer": {"use '), head, F.lit('": "keyword_included", "'), head, F.lit('": "length", "no": "length", "in two parts": "style", "say \'kind \' and \\"warm\\" words": "keyword_avoided", "A": "choose_output", "B or C": "choose_output"}} done'))
    i = i.withColumn("json", code.first_json(made))
    parsed = F.from_json("json", "answer map<string,string>")["answer"]
    c = rules.postprocess_constraints(rules.clean_constraints(parsed))
    return i.select("data_id", F.size(c).alias("n"), F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit("="), x["expr"])), " | ").alias("constraints"), F.array_join(rules.questions(c), " | ").alias("questions"))


def whole_constraints(spark: SparkSession, d: str) -> DataFrame:
    """As cleaned_constraints, of answers that hold the whole instruction, escaped as JSON."""
    i = instructions(spark, d).where("instruction is not null")
    fixed = {"no": "length", "in two parts": "style", "say 'kind ' and \"warm\" words": "keyword_avoided", "A": "choose_output", "B or C": "choose_output"}
    of = F.map_from_arrays(F.array(F.concat(F.lit("use "), "instruction"), F.concat(F.lit("not "), "instruction"), *[F.lit(k) for k in fixed]), F.array(F.lit("keyword_included"), F.lit("length"), *[F.lit(v) for v in fixed.values()]))
    i = i.withColumn("json", code.first_json(F.concat(F.lit("Sure: "), F.to_json(F.struct(of.alias("answer"))), F.lit(" done"))))
    parsed = F.from_json("json", "answer map<string,string>")["answer"]
    c = rules.postprocess_constraints(rules.clean_constraints(parsed))
    given = F.element_at(F.map_keys(parsed), 1)
    return i.select("data_id", given.alias("first_key"), F.size(c).alias("n"), F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit("="), x["expr"])), " | ").alias("constraints"), F.array_join(rules.questions(c), " | ").alias("questions"))


def code_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in reviews: the code of a response, revised by dropping its last line; every third verdict is wrong."""
    e = reshape.exchanges(conversations(spark, d)).where(F.contains("response", F.lit("```")))
    old = F.regexp_extract("response", r"(?s)(```.*?)(?:```|$)", 1)
    new = F.regexp_replace(old, r"\n[^\n]*\n?$", "")
    verdict = F.when(F.length("response") % 3 == 0, "wrong").otherwise("correct")
    answer = F.to_json(F.struct(F.lit("ok").alias("review"), verdict.alias("final_verdict"), old.alias("code_original"), new.alias("code_revision")))
    s = code.code_score(answer)
    return e.select("data_id", "exchange_idx", F.round(s["score"], 6).alias("score"), s["edit_similarity"].alias("distance"), s["functional_correctness"].alias("correct"))


# ---- filters, joins, unions ----------------------------------------------------------------------------------


def filtered_sources(spark: SparkSession, d: str) -> DataFrame:
    i = filters.without_augmented(instructions(spark, d).withColumn("problem_source", F.coalesce("origin", F.lit("augmented_x"))))
    return filters.of_task(i.withColumn("task", F.col("origin")), "cinder_instruct").select("data_id", "origin")


def first_by_id(spark: SparkSession, d: str) -> DataFrame:
    return filters.first_rows(instructions(spark, d).select("data_id", "origin"), 250, F.col("data_id"))


def in_languages(spark: SparkSession, d: str) -> DataFrame:
    return filters.in_languages(instructions(spark, d), ["DE", "fr"]).select("data_id", F.lower("language").alias("language"))


def of_subset(spark: SparkSession, d: str) -> DataFrame:
    return filters.of_subset(pool(spark, d), "setfit_label", "Math").select("data_id", "origin")


def within_length(spark: SparkSession, d: str) -> DataFrame:
    return filters.within_length(pool(spark, d), 120).select("data_id", (F.col("inst_length") + F.col("resp_length")).alias("tokens"))


def relevant_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d)
    return p.groupBy("setfit_label").agg(*[F.sum(filters.relevant(F.col("setfit_label"), m).cast("int")).alias(f"n_{m}") for m in METRICS])


def metrics_attached(spark: SparkSession, d: str) -> DataFrame:
    c = joins.attach_metrics(conversations(spark, d).select("data_id"), analysis(spark, d), "quality", "inst_length")
    return c.select("data_id", F.nanvl("quality", F.lit(None)).alias("quality"), "inst_length")


def metric_tables_attached(spark: SparkSession, d: str) -> DataFrame:
    a = analysis(spark, d)
    t = {m: a.select("data_id", m) for m in ("complexity", "inst_length", "resp_length")}
    return joins.attach_metric_tables(instructions(spark, d).select("data_id"), t)


def labels_attached(spark: SparkSession, d: str) -> DataFrame:
    e = all_exchanges(spark, d)
    got = joins.attach_labels(e.select("data_id", "exchange_idx"), e.select("data_id", "exchange_idx", "label"), labels(spark, d))
    return got.select("data_id", "exchange_idx", "message_label", "sample_label")


def semi_joined(spark: SparkSession, d: str) -> DataFrame:
    return filters.with_ids(analysis(spark, d), conversations(spark, d)).select("data_id", "origin")


def back_filled(spark: SparkSession, d: str) -> DataFrame:
    return joins.not_in(analysis(spark, d), instructions(spark, d)).select("data_id", "origin")


def united(spark: SparkSession, d: str) -> DataFrame:
    u = joins.union_all(conversations(spark, d).select("data_id", "origin"), instructions(spark, d).select("data_id", "language"))
    return u.groupBy("origin", F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("n"))


# ---- normalisation and preference ----------------------------------------------------------------------------


def robust_fit(spark: SparkSession, d: str) -> DataFrame:
    f = aggregates.robust_fit(pool(spark, d), list(preference.ROBUST_METRICS))
    return f.select(*[F.round(c, 6).alias(c) for c in f.columns])


def min_max_by_origin(spark: SparkSession, d: str) -> DataFrame:
    p = aggregates.min_max_scaled(pool(spark, d), ["complexity"])
    return p.select("data_id", F.round("complexity", 6).alias("complexity"))


def _preference(strategy: str):  # noqa: ANN202
    def query(spark: SparkSession, d: str) -> DataFrame:
        p = preference.with_preference(pool(spark, d), strategy)
        return p.select("data_id", F.round("overall_preference", 6).alias("overall_preference"))

    return query


def percentile_thresholds(spark: SparkSession, d: str) -> DataFrame:
    t = aggregates.percentile_threshold(pool(spark, d).where("setfit_label is not null"), "complexity", 0.29, "setfit_label")
    return t.select("setfit_label", F.round("threshold", 6).alias("threshold"))


# ---- selection --------------------------------------------------------------------------------------------


def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, list[Column]]:
    """The pool by response length, ties by id."""
    return pool(spark, d), [F.col("resp_length").desc(), F.col("data_id")]


def top_longest(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return sampling.top_k(p, 100, o).select("data_id", "resp_length")


def stratified_top(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return sampling.stratified_top_k(p, {"Math": 0.25, "Coding": 0.25, "Generation": 0.25, "Reasoning": 0.1, "Brainstorming": 0.1, "Factual QA": 0.025, "Extraction": 0.025}, 200, o).select("data_id", "setfit_label")


def label_limited(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return filters.within_label_limits(p, {"Math": 0.3, "Coding": 0.125, "Extraction": 0.01}, 300, o).select("data_id", "setfit_label")


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return filters.within_budget(p, o, token_size=20_000, tokens=F.col("inst_length") + F.col("resp_length")).select("data_id", "resp_length")


def token_budget_by_origin(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return filters.within_budget(p, o, token_size=1_500, tokens=F.col("inst_length") + F.col("resp_length"), group=["origin"]).select("origin", "data_id")


def oversampled(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return sampling.oversampled(p, 1.5, o).select("data_id", "copy")


def cross_lingual_first(spark: SparkSession, d: str) -> DataFrame:
    p, o = _ranked(spark, d)
    return sampling.cross_lingual_first(p, o).select("data_id")


def curriculum(spark: SparkSession, d: str) -> DataFrame:
    p = analysis(spark, d).where("difficulty_v2 is not null and not isnan(difficulty_v2)")
    return filters.prefix_sum(p.select("data_id", "difficulty_v2"), sampling.ordering("difficulty"), F.lit(1), "place").select("data_id", F.col("place").cast("bigint").alias("place"))


def whole_curriculum(spark: SparkSession, d: str) -> DataFrame:
    """All samples, easy ones first, those without a difficulty (null or NaN) last."""
    p = analysis(spark, d).withColumn("difficulty_v2", F.when(~F.isnan("difficulty_v2"), F.col("difficulty_v2")))
    return filters.prefix_sum(p.select("data_id", "difficulty_v2"), sampling.ordering("difficulty"), F.lit(1), "place").select("data_id", F.col("place").cast("bigint").alias("place"))


def by_category(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d).where(F.col("setfit_label").isin(*CATEGORIES)).select("data_id", "setfit_label", "inst_length", "resp_length")
    return filters.prefix_sum(p, sampling.ordering("length_category"), F.lit(1), "place").select("data_id", "setfit_label", F.col("place").cast("bigint").alias("place"))


def random_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_random(pool(spark, d).select("data_id", "origin"), 250)


def preference_order(spark: SparkSession, d: str) -> DataFrame:
    p = preference.with_preference(pool(spark, d), "deita")
    return sampling.top_k(p, 300, sampling.by_preference(42)).select("data_id", F.round("overall_preference", 6).alias("overall_preference"))


def train_test(spark: SparkSession, d: str) -> DataFrame:
    return sampling.train_test_split(pool(spark, d).select("data_id"))


def random_members(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_member(pool(spark, d).select("data_id", "origin"), "origin", 7)


# ---- vectors ------------------------------------------------------------------------------------------------


def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = vectors.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 2)
    return n.select("vec_id", "rank", F.round("distance", 5).alias("distance"))


def nearest_of_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks among all."""
    e = table(spark, d, "embeddings")
    n = vectors.nearest(e, "vec_id", "embedding", 10, e.where("vec_id % 50 = 0"))
    return n.select("vec_id", "rank", F.round("distance", 5).alias("distance"))


def nearest_indexed(spark: SparkSession, d: str) -> DataFrame:
    """As ``nearest_of_queries``, by an index of 16 cells of which each query looks into 12 (recall: 0.9 or more)."""
    e = table(spark, d, "embeddings")
    n = vectors.CellIndex(e, "vec_id", "embedding", 16).search(e.where("vec_id % 50 = 0"), 10, 12)
    return n.select("vec_id", "rank", F.round("distance", 5).alias("distance"))


def text_distances(spark: SparkSession, d: str) -> DataFrame:
    """``label`` stands in for the text: the nearest neighbour with the same one gives way to the second."""
    t = vectors.text_nearest_distance(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return t.select("vec_id", F.round("distance", 5).alias("distance"))


def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = scores.l2_normalised(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(scores.norm(v), 6).alias("norm"), F.round(F.get(v, 0), 5).alias("first"))


def near_vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.55, False).where("a < b")


def greedy_diverse(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("rank", F.col("vec_id"))
    return vectors.greedy_diverse(e, "vec_id", "embedding", "rank", 0.7).select("vec_id")


def greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("rank", F.col("vec_id"))
    return vectors.greedy_select(e, 100, "vec_id", "embedding", "rank", 0.7).select("vec_id")


def greedy_scanned(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("rank", F.col("vec_id"))
    return vectors.greedy_select(e, 100, "vec_id", "embedding", "rank", 0.7, by="scanned").select("vec_id")


def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    """``label`` is the given cluster, the first number of the embedding the preference."""
    e = table(spark, d, "embeddings").withColumn("overall_preference", F.get("embedding", 0).cast("double"))
    return vectors.cluster_select(e, 60, "label", None, "vec_id", 0.29).select("vec_id", "label")


def kmeans_select(spark: SparkSession, d: str) -> DataFrame:
    e = vectors.reduced(table(spark, d, "embeddings"), "embedding").withColumn("overall_preference", F.get("embedding", 0).cast("double"))
    return vectors.cluster_select(vectors.clustered(e, "reduced", 40), 40, "cluster", None, "vec_id").select("vec_id", "cluster")


def pca_dimensions(spark: SparkSession, d: str) -> DataFrame:
    r = vectors.reduced(table(spark, d, "embeddings"), "embedding")
    return r.groupBy(F.size("reduced").alias("dimensions")).agg(F.count(F.lit(1)).alias("rows"))


def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    q = vectors.cluster_quality(table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), "embedding", "label")
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


# ---- whole specs ----------------------------------------------------------------------------------------------


def _spec_pool(spark: SparkSession, d: str) -> DataFrame:
    c = conversations(spark, d).select("data_id", "messages")
    i = reshape.to_chat_for_selection(instructions(spark, d).where("instruction is not null").select("data_id", "instruction", "input", "output"))
    return pool(spark, d).join(joins.union_all(c, i.select("data_id", "messages")), "data_id")


def _spec(**settings):  # noqa: ANN003, ANN202
    return SelectionSpec(name="q", **settings)


PROPORTIONS = {"Math": 0.25, "Coding": 0.25, "Generation": 0.25, "Reasoning": 0.1, "Brainstorming": 0.1, "Factual QA": 0.025, "Extraction": 0.025}


def select_spec(spark: SparkSession, d: str) -> DataFrame:
    """Longest answers of two sources in their category shares, short ones first."""
    spec = _spec(scoring_strategy="longest", sample_size=120, final_setfit_proportions=PROPORTIONS, ordering_strategy="length", data=(SourceSpec("harbor_chat_mix"), SourceSpec("cinder_instruct")))
    r = Selection(spec, _spec_pool(spark, d), seed=None).result()
    return r.select("data_id", "origin", "setfit_label", "overall_preference", F.size("messages").alias("turns"))


def select_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Sources with budgets, limits and repetition of their own."""
    data = (SourceSpec("harbor_chat_mix", sample_size=60, setfit_limits={"Math": 0.2, "Coding": 0.5}), SourceSpec("tidal_reasoning", token_size=1_000), SourceSpec("moss_summaries", oversampling=1.5))
    r = Selection(_spec(scoring_strategy="longest", data=data), _spec_pool(spark, d), seed=None).sampled()
    return r.select("data_id", "origin")


def select_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Representatives of given clusters in each category; ``inst_length`` modulo 17 stands in for the cluster."""
    p = _spec_pool(spark, d).withColumn("cluster", F.col("inst_length") % 17)
    spec = _spec(scoring_strategy="combination_v5", sample_size=100, clustering="categories", threshold_percentile_clustering=0.2, final_setfit_proportions=PROPORTIONS, ordering_strategy="category")
    return Selection(spec, p, cluster_column="cluster").result().select("data_id", "setfit_label")


# ---- sources and sinks: files written from the tables and read again ------------------------------------------


def _folder(spark: SparkSession) -> str:
    return vectors.shared_folder(spark)


def _written(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder with the instructions as JSON lines in the order of their ids, and metric columns by position."""
    at = _folder(spark)
    i = instructions(spark, d).select("data_id", "instruction", "input", "output", "origin", "language")
    i.orderBy("data_id").write.json(f"{at}/all.jsonl")
    a = i.select("data_id").join(analysis(spark, d), "data_id", "left").join(labels(spark, d).select("data_id", "setfit_label"), "data_id", "left")
    writers.write_metric_lines(a, f"{at}/quality_scores/all.csv", "quality", ["data_id"])
    writers.write_metric_lines(a, f"{at}/tokens_scores/responses/all.csv", "resp_length", ["data_id"])
    writers.write_metric_lines(a, f"{at}/categories_v2/all_aggr.csv", "setfit_label", ["data_id"])
    return at, i


def jsonl_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    writers.write_jsonl(conversations(spark, d).select("data_id", "messages", "origin", "language"), f"{at}/c.jsonl")
    path = readers.resolve_path("DATA_PATH/c.jsonl", at)
    readers.check_presence(spark, [path])
    c = readers.read_jsonl(spark, path, readers.CONVERSATIONS)
    return c.select("data_id", F.size("messages").alias("turns"), "origin", F.get("messages", 0)["content"].alias("first"))


def metric_columns_read(spark: SparkSession, d: str) -> DataFrame:
    """Metric columns without ids, attached by position; the ones that aren't there are left out."""
    at, _ = _written(spark, d)
    i = readers.read_jsonl(spark, f"{at}/all.jsonl", readers.INSTRUCTIONS)
    return readers.read_metrics(spark, at, "all", i).select("data_id", "quality", "resp_length", "setfit_label")


def metric_tables_written(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    writers.write_metrics(analysis(spark, d), at, ["complexity", "inst_length"])
    t = {m: readers.read_source(spark, f"{at}/{m}") for m in ("complexity", "inst_length")}
    return joins.attach_metric_tables(instructions(spark, d).select("data_id"), t)


def sidecar_written(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    e = scorers.evaluated(reshape.exchanges(conversations(spark, d)).where("exchange_idx = 0").withColumn("constraints", _constraints()))
    writers.write_sidecar(e, at, ["outcomes"])
    got = readers.read_jsonl(spark, at, "data_id string, outcomes array<struct<type:string,expr:string,followed:boolean>>")
    return got.select("data_id", F.posexplode("outcomes").alias("nth", "o")).select("data_id", "nth", F.col("o.followed").alias("followed"))


def sources_by_ending(spark: SparkSession, d: str) -> DataFrame:
    """One table as JSON lines, CSV, ORC and Parquet."""
    at, parts = _folder(spark), []
    e = table(spark, d, "eval_items").select("item_id", "benchmark", F.regexp_replace("question", r"[\r\n]+", " ").alias("question"))
    for ending in ("jsonl", "csv", "orc", "parquet"):
        w, path = e.write, f"{at}/e.{ending}"
        {"jsonl": w.json, "csv": w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv, "orc": w.orc, "parquet": w.parquet}[ending](path)
        parts.append(readers.read_source(spark, path).select(F.col("item_id").cast("bigint").alias("item_id"), "benchmark", "question", F.lit(ending).alias("ending")))
    return joins.union_all(*parts)


def subsets_united(spark: SparkSession, d: str) -> DataFrame:
    i = instructions(spark, d)
    u = readers.union_subsets({x: i.where(F.lower("language") == x).select("data_id") for x in ("en", "de", "fr")})
    return u.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


def _registry(d: str) -> readers.Registry:
    r = readers.Registry()
    r.register("conversations", "Conversations", lambda s: conversations(s, d))
    r.register_pattern("raw_*", lambda name: lambda s: table(s, d, name[4:]))
    return r


def registered(spark: SparkSession, d: str) -> DataFrame:
    """Datasets by name: a registered one as a view for SQL, one by its wildcard."""
    r = _registry(d)
    r.create_views(spark)
    a = spark.sql("select 'conversations' as name, count(*) as n from conversations")
    return a.unionByName(r.load(spark, "raw_eval_items").agg(F.lit("raw_eval_items").alias("name"), F.count(F.lit(1)).alias("n")))


def results_cached(spark: SparkSession, d: str) -> DataFrame:
    """Whether a result is there before and after it is written, and when it is asked for again."""
    at = _folder(spark)
    before = readers.result_exists(spark, at, "origins")
    writers.write_table(aggregates.composition(analysis(spark, d), "origin"), f"{at}/origins.parquet", by=None)
    said = [("before", before), ("after", readers.result_exists(spark, at, "origins")), ("repeat", readers.result_exists(spark, at, "origins", repeat=True))]
    n = readers.read_source(spark, f"{at}/origins.parquet").agg(F.sum("n").alias("rows"))
    return spark.createDataFrame(said, "when string, found boolean").join(n)


TEMPLATE = "Given the categories:\n{examples}\nAnswer in JSON, e.g. {{\"answer\": \"Math\", \"explanation\": \"...\"}}\n### Task ###\n{input}"


def templates_filled(spark: SparkSession, d: str) -> DataFrame:
    return instructions(spark, d).select("data_id", text.fill("Task: {input}\n{{as JSON}} for {who}", input=F.col("instruction"), who=F.col("origin")).alias("prompt"))


def training_read(spark: SparkSession, d: str) -> DataFrame:
    """A training file with messages, and one with prompt and completion."""
    at = _folder(spark)
    c = conversations(spark, d)
    writers.write_jsonl(c.select("data_id", "messages"), f"{at}/m.jsonl")
    writers.write_jsonl(reshape.prompt_completion(c).select("data_id", "prompt", "completion"), f"{at}/p.jsonl")
    m, p = readers.read_training(spark, f"{at}/m.jsonl"), readers.read_training(spark, f"{at}/p.jsonl")
    turns = m.agg(F.sum(F.size("messages")).alias("turns")), p.agg(F.sum(F.size("prompt") + F.size("completion")).alias("turns"))
    return joins.union_all(*[t.withColumn("file", F.lit(n)) for n, t in zip(("messages", "pairs"), turns)])


def canonical_columns(spark: SparkSession, d: str) -> DataFrame:
    c = reshape.canonical(conversations(spark, d))
    return c.select("data_id", F.size("messages").alias("turns"))


def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written as text, missing ones as None and NaN as NaN, some that are no number."""
    t = F.when(F.col("resp_length") % 11 == 0, "n/a").when(F.isnan("complexity"), "NaN").otherwise(F.coalesce(F.col("complexity").cast("string"), F.lit("None")))
    return analysis(spark, d).select("data_id", scores.strict_number(t).alias("complexity"))


def subset_specs(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the config table as a spec with subsets, whose settings win."""
    names = [r["name"] for r in table(spark, d, "dataset_config").where("name is not null").select("name").distinct().orderBy("name").collect()]  # a row a source
    made = {"x": {"sample_size": 9, "data": [{"name": n, "language": "en", "sample_size": 5, "subsets": {"a": None, "b": {"language": "de", "sample_size": len(n)}}} for n in names]}}
    return spark.createDataFrame([(s.name, s.subset_name, s.language, s.sample_size) for s in parse_spec(made).data], "name string, subset string, language string, sample_size int")


# ---- scorers by name, prompts of models ------------------------------------------------------------------------


def _stand_in_model():  # noqa: ANN202
    """A fixed stand-in for a model: JSON with a category by the prompt's length; every seventh answer has none."""
    return lambda prompts: ["no idea {" if len(p) % 7 == 6 else f'Sure. {{"answer": "{CATEGORIES[len(p) % 7]}", "explanation": "{len(p)}"}} done' for p in prompts]


def generated(spark: SparkSession, d: str) -> DataFrame:
    i = instructions(spark, d).where("instruction is not null")
    return scorers.generate(i, F.col("instruction"), lambda: lambda prompts: [f"{len(p)}|{p}" for p in prompts]).select("data_id", "completion")


def generated_logprobs(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in model that gives mark 1 and mark 2 a log probability each, or nothing."""
    load = lambda: lambda prompts: [{29896: 0.0, 29906: float(len(p) % 5)} if len(p) % 3 else None for p in prompts]
    i = instructions(spark, d).where("instruction is not null")
    g = scorers.generate(i, F.col("instruction"), load, "logprobs", "map<int,double>")
    return g.select("data_id", F.round(scores.softmax_expectation(F.col("logprobs")), 6).alias("mark"))


def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """A chat model reads the rendered conversation and says how long it is."""
    c = conversations(spark, d).where("size(messages) > 0")
    return scorers.generate(c, reshape.chatml(F.col("messages"), True), lambda: lambda prompts: [str(len(p)) for p in prompts], "answer").select("data_id", "answer")


def classified_messages(spark: SparkSession, d: str) -> DataFrame:
    """The label of a stand-in classifier (by the prompt's length) for each message, and their majority."""
    label = lambda c: F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (F.length(c) % 7 + 1).cast("int"))
    return scorers.default_scorers().get("categories_v2", predict=label).per_sample(reshape.exchanges(conversations(spark, d)))


def classified_by_prompt(spark: SparkSession, d: str) -> DataFrame:
    i = instructions(spark, d).where("instruction is not null")
    got = scorers.classify_by_prompt(i, TEMPLATE, _stand_in_model, {"Math": "2 + 2", "Coding": "def f"})
    return got.select("data_id", "category", "explanation")


def difficulty_prompts(spark: SparkSession, d: str) -> DataFrame:
    i = instructions(spark, d).where("instruction is not null")
    p = scorers.difficulty_prompt("Rate tasks of {category}.", F.lit("all"), F.col("instruction"), reshape.chatml, 12)
    return i.select("data_id", p.alias("prompt"))


def marked_steps(spark: SparkSession, d: str) -> DataFrame:
    e = scorers.joined_steps(reshape.exchanges(conversations(spark, d)))
    return e.select("data_id", "exchange_idx", "marked_response")


def analyses_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Every analysis that is asked for by name, over the same exchanges, as one table of means."""
    e = scorers.steps(all_exchanges(spark, d)).withColumn("constraints", _constraints())
    # stand-ins for what models say: the response's length in a log probability, a logit and rewards
    e = e.withColumn("logprobs", F.map_from_arrays(F.array(F.lit(29896)), F.array((F.length("response") % 5).cast("double")))).withColumn("logit", _standin()).withColumn("rewards", F.array(_standin()))
    known, parts = scorers.default_scorers(), []
    for name, col in (("quality", "quality"), ("complexity", "complexity"), ("difficulty_v2", "difficulty_v2"), ("process_reward_modelling", "process_reward"), ("if_quality", "if_quality"), ("tokens", "resp_length")):
        s = known.get(name).per_sample(e)
        parts.append(s.agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(col), 4).alias("mean")).withColumn("analysis", F.lit(name)))
    stats = known.get("dataset_stats").per_sample(e.where("origin is not null"))
    return joins.union_all(*parts, stats.agg(F.sum("samples").alias("samples"), F.round(F.avg("avg_turns"), 4).alias("mean")).withColumn("analysis", F.lit("dataset_stats")))


# ---- constraints and code in SQL's reach ------------------------------------------------------------------------


def constraints_kept(spark: SparkSession, d: str) -> DataFrame:
    """The instruction with a type by its length, its first word, and expressions that go: which are kept."""
    i = instructions(spark, d).where("instruction is not null")
    kind = F.element_at(F.array(*[F.lit(t) for t in (*rules.TYPES, "style")]), (F.length("instruction") % 14 + 1).cast("int"))
    first = F.concat(F.lit("word "), F.regexp_extract("instruction", r"[A-Za-z]+", 0))
    said = F.map_from_arrays(F.array(F.concat(F.lit("word "), "instruction"), F.concat(F.lit("see "), first), F.lit("no"), F.lit("yes"), F.lit("")), F.array(kind, F.lit("length"), F.lit("length"), F.lit("language"), F.lit("length")))
    c = rules.clean_constraints(said)
    return i.select("data_id", F.size(c).alias("n"), F.array_join(F.transform(c, lambda x: F.concat(x["type"], F.lit("="), x["expr"])), " | ").alias("kept"))


def first_objects(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("instruction", r"[{}]", "")
    made = F.concat(F.lit("well } "), F.lit('{"a": {"b": "'), plain, F.lit('"}, "c": {}} and {more}'))
    i = instructions(spark, d).where("instruction is not null")
    return i.select("data_id", code.first_json(made).alias("object"), code.first_json(F.concat(F.lit("{"), plain)).alias("open"))


def constraints_processed(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.regexp_replace("instruction", "[\"'`]", ""), " ")
    first, head = F.get(w, 0), F.array_join(F.slice(w, 1, 3), " ")
    one = lambda t, e: F.struct(F.lit(t).alias("type"), e.alias("expr"))
    c = F.array(one("keyword_included", F.concat(F.lit('use "'), first, F.lit('" well'))), one("choose_output", F.lit("A")), one("start_and_ending", F.concat(F.lit('Start with "'), head, F.lit('"'))), one("choose_output", F.lit("B or C")), one("keyword_avoided", F.lit("none named")), one("length", F.lit("in two parts")))
    p = rules.postprocess_constraints(c)
    return instructions(spark, d).where("instruction is not null").select("data_id", F.array_join(F.transform(p, lambda x: F.concat(x["type"], F.lit("="), x["expr"])), " | ").alias("constraints"), F.array_join(rules.questions(p), " | ").alias("questions"))


# ---- orders, selections, index ----------------------------------------------------------------------------------


def shuffled_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each sample in the final shuffle."""
    p = analysis(spark, d).select("data_id")
    return filters.prefix_sum(p, sampling.ordering("shuffle"), F.lit(1), "place").select("data_id", F.col("place").cast("bigint").alias("place"))


def index_of_all_cells(spark: SparkSession, d: str) -> DataFrame:
    """An index fitted on half of the rows, to which the rest is added, written, read and asked in all of its cells."""
    e = table(spark, d, "embeddings")
    made = vectors.CellIndex(e.where("vec_id % 2 = 0"), "vec_id", "embedding", 16).add(e.where("vec_id % 2 <> 0"))
    at = _folder(spark)
    made.save(at)
    n = vectors.CellIndex.load(spark, at, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), 10, 16)
    return n.select("vec_id", "rank", F.round("distance", 5).alias("distance"))


def select_languages_once(spark: SparkSession, d: str) -> DataFrame:
    """Two sources of which no sample may come in two languages, neither within a source nor across."""
    data = (SourceSpec("harbor_chat_mix", sample_size=80, allow_x_lang_duplicates=False), SourceSpec("cinder_instruct", sample_size=80, allow_x_lang_duplicates=False, setfit_limits={"Math": 0.1, "Coding": 0.2, "Generation": 0.3}))
    return Selection(_spec(scoring_strategy="longest", data=data), _spec_pool(spark, d), seed=None).sampled().select("data_id", "origin")


def select_from_files(spark: SparkSession, d: str) -> DataFrame:
    """A spec run from its files: the longest answers of the instructions, by metric columns without ids."""
    at, _ = _written(spark, d)
    a = instructions(spark, d).select("data_id").join(analysis(spark, d), "data_id", "left")
    writers.write_metric_lines(a, f"{at}/tokens_scores/last_responses/all.csv", "last_resp_length", ["data_id"])
    spec = parse_spec({"run": {"scoring_strategy": "longest", "sample_size": 50, "data": [{"name": "all", "data_path": "DATA_PATH/all.jsonl", "multi_turn": False, "language": "EN"}]}})
    run = Run(spark, spec, at, schemas={"all": "data_id string, instruction string, input string, output string, language string"}, preprocess={"all": lambda df: df.where("instruction is not null or data_id is not null")}, seed=None)
    got = run.result()
    return got.select("data_id", "origin", F.get("messages", 1)["content"].alias("answer"), F.col("last_resp_length").cast("bigint").alias("last_resp_length"))


def pairs_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Preference pairs on neighbouring rows of a file, selected as pairs and written as rows again."""
    at = _folder(spark)
    c = conversations(spark, d).select("data_id", F.slice("messages", 1, 1).alias("prompt")).orderBy("data_id")
    writers.write_jsonl(c.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("label")), f"{at}/k.jsonl")
    spec = parse_spec({"run": {"type_dataset": "kto", "scoring_strategy": "random", "data": [{"name": "k", "data_path": "DATA_PATH/k.jsonl"}]}})
    got = Run(spark, spec, at, schemas={"k": "data_id string, prompt array<struct<role:string,content:string>>, label boolean"}).result()
    return got.select("data_id", "label")


CORE = (
    "exchanges exchange_counts ingest_chat joined_prompts selection_chat normal_roles renamed default_columns ids_without_language assigned_ids first_answers empty_system_dropped "
    "preference_pairs preference_unpacked chosen_prompts prompt_completion chatml_rendered instruct_rendered response_steps all_response_steps cleaned_code truncated_responses "
    "token_lengths corpus_tokens dataset_stats majority_labels composition_by_origin composition_by_label composition_by_language score_histogram preference_stats sampled_totals "
    "mean_complexity mean_quality mean_difficulty mean_process_reward routed_scores softmax_marks step_probabilities constraint_outcomes instruction_scores rule_checks cleaned_constraints whole_constraints code_reviews "
    "filtered_sources first_by_id in_languages of_subset within_length relevant_metrics metrics_attached metric_tables_attached labels_attached semi_joined back_filled united "
    "robust_fit min_max_by_origin percentile_thresholds top_longest stratified_top label_limited token_budget token_budget_by_origin oversampled cross_lingual_first curriculum whole_curriculum by_category "
    "random_sample preference_order train_test random_members nearest_neighbours nearest_of_queries nearest_indexed text_distances normalised_vectors near_vector_pairs greedy_diverse greedy_budget greedy_scanned "
    "cluster_representatives kmeans_select pca_dimensions cluster_quality select_spec select_budgeted select_clustered "
    "jsonl_written_and_read metric_columns_read metric_tables_written sidecar_written sources_by_ending subsets_united registered results_cached templates_filled training_read canonical_columns strict_numbers subset_specs "
    "generated generated_logprobs chat_answers classified_messages classified_by_prompt difficulty_prompts marked_steps analyses_by_name constraints_kept first_objects constraints_processed "
    "shuffled_order index_of_all_cells select_languages_once select_from_files pairs_from_files"
).split()
STRATEGIES = ("default", "random", "random_x", "longest", "deita", "difficulty", "difficulty_v2", "quality", "dedicated_quality", "combination_v5", "complexity")


def queries() -> dict:
    got = {n: globals()[n] for n in CORE}
    return got | {f"preference_{s}": _preference(s) for s in STRATEGIES}


def oracle_sql() -> dict[str, str]:
    from tessera.plans.oracle import oracle_sql as sql

    return sql()
