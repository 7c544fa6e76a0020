"""Queries of this subpackage over the tables of a directory; each reads its whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import defects, diverse, encoding, leakage, mixing, neardup, proportions, ranking, subjects
from .common import all_prompts, conversation_prompts, latest, table


def _size():  # noqa: ANN202
    return F.coalesce(F.col("inst_length"), F.lit(0)) + F.coalesce(F.col("resp_length"), F.lit(0))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = latest(table(spark, d, "analysis"), "scored_at", "origin", "inst_length", "resp_length")
    return a, mixing.source_tokens(a, "origin", _size())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, s = _sources(spark, d)
    return mixing.short_sources(table(spark, d, "dataset_config"), s)


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    _, s = _sources(spark, d)
    got = mixing.rates(table(spark, d, "dataset_config"), s)
    return got.select("spec_name", "name", "tokens", F.round("rate", 6).alias("rate"), F.round("target_share", 6).alias("target_share"), F.round("expected_share", 6).alias("expected_share"))


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    a, s = _sources(spark, d)
    return mixing.mix(a, mixing.rates(table(spark, d, "dataset_config"), s), "data_id", "origin", _size()).withColumnRenamed("id", "data_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    a, s = _sources(spark, d)
    rated = mixing.rates(table(spark, d, "dataset_config"), s)
    got = mixing.shares(mixing.repeated(mixing.mix(a, rated, "data_id", "origin", _size())), rated)
    return got.withColumn("rate", F.round("rate", 6)).withColumn("target_share", F.round("target_share", 6)).withColumn("actual_share", F.round("actual_share", 6))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: a row for each copy."""
    a, s = _sources(spark, d)
    mixed = mixing.mix(a, mixing.rates(table(spark, d, "dataset_config"), s), "data_id", "origin", _size())
    return mixing.repeated(mixed).withColumnRenamed("id", "data_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(all_prompts(spark, d), "data_id", t=Fraction(4, 5), min_words=20).pairs()


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    """Membership of the texts whose exact copies p2_found doesn't pair with each other."""
    return neardup.NearDuplicates(all_prompts(spark, d), "data_id", t=Fraction(4, 5), min_words=20).copies().withColumnRenamed("id", "data_id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(all_prompts(spark, d), "data_id", t=Fraction(4, 5), min_words=20).groups().withColumnRenamed("id", "data_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return diverse.look_alikes(conversation_prompts(spark, d), "data_id", min_words=40, similarity=0.5, others=10)


def p3_select(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "dataset_config").groupBy("spec_name").agg(F.max("sample_size").alias("n"), F.max("scoring_strategy").alias("s")).collect()
    a = latest(table(spark, d, "analysis"), "scored_at", "quality", "complexity", "difficulty_v2", "last_resp_length")
    pool = conversation_prompts(spark, d).join(a, "data_id", "left")
    clean = {s: ranking.cleaned(s) for s in ("quality", "complexity", "difficulty_v2")}

    def score(strategy: str | None):  # noqa: ANN202
        s = strategy or "default"
        if s.startswith("random"):
            return F.pmod(F.xxhash64(F.lit(5), "data_id"), F.lit(1 << 20)).cast("double")
        if s.startswith("longest"):
            return F.col("last_resp_length").cast("double")
        if s.startswith("deita"):
            return clean["quality"] * clean["complexity"]
        if s.startswith("difficulty"):
            return clean["difficulty_v2"]
        if s.startswith("complexity"):
            return clean["complexity"]
        if s.startswith(("quality", "dedicated_quality")):
            return clean["quality"]
        return clean["quality"] * clean["difficulty_v2"]

    sizes = {r["spec_name"]: r["n"] for r in specs if r["spec_name"] is not None}
    scores = {r["spec_name"]: score(r["s"]) for r in specs if r["spec_name"] is not None}
    return diverse.select_varied(pool, sizes, scores).withColumnRenamed("spec", "spec_name")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.find_defects(defects.pairs_of(table(spark, d, "instructions"), table(spark, d, "conversations")))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "categories"), "classified_at", "setfit_label", "n_messages")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dataset_config").select("spec_name", "sample_size")


def _proportional(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pool = _labels(spark, d).withColumn("turns", F.when(F.col("n_messages") > 1, "several").otherwise("one"))
    return proportions.sample_proportional(pool, table(spark, d, "category_targets"), _sizes(spark, d), margins=("turns",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return proportions.short_labels(_proportional(spark, d)[1])


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _proportional(spark, d)[0]


def p5_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _proportional(spark, d)[1]


def p6_rank(spark: SparkSession, d: str) -> DataFrame:
    a = latest(table(spark, d, "analysis"), "scored_at", "origin", *ranking.WEIGHTS)
    return ranking.ranked(ranking.fuse_scores(a))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    got = encoding.decode_corpus(encoding.encode_corpus(table(spark, d, "documents").select("doc_id", "text")))
    return got.select("doc_id", F.size("ids").alias("n_ids"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12)


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), min_words=12)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    named = {r["subject"]: r["description"] for r in table(spark, d, "subjects").where("subject is not null").collect()}  # the fixed list of subjects
    return subjects.assign_subjects(table(spark, d, "documents"), named, table(spark, d, "subject_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d)


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


NAMES = ("p1_found", "p1_rates", "p1_mix", "p1_copies", "p1_shares", "p2_found", "p2_copies", "p2_groups", "p3_found", "p3_select", "p4_found", "p5_found", "p5_sample", "p5_gaps", "p6_rank", "p7_ids", "p7_decoded", "p8_found", "p8_leaks", "p9_found", "p9_composition")


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


_LATEST = "(SELECT * FROM {t} WHERE data_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY {ts} DESC) = 1)"
_SOURCE = "replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '-', '_')"
_LABEL = "trim(regexp_replace(lower({c}), '[\\s_-]+', ' ', 'g'))"
_TOKENS = f"SELECT {_SOURCE.format(c='origin')} AS source, sum(coalesce(inst_length, 0) + coalesce(resp_length, 0)) AS tokens FROM {_LATEST.format(t='analysis', ts='scored_at')} GROUP BY 1"
_RATED = f"""src AS ({_TOKENS}),
r AS (SELECT c.spec_name, c.name, c.token_size, coalesce(s.tokens, 0) AS tokens, greatest(coalesce(c.oversampling, 1.0), 0.0) AS cap, CAST(coalesce(c.token_size, 0) AS DOUBLE) AS wanted
      FROM (SELECT DISTINCT spec_name, name, token_size, oversampling FROM dataset_config) c LEFT JOIN src s ON s.source = {_SOURCE.format(c='c.name')})"""
_MIXED = f"""{_RATED}, q AS (SELECT *, CASE WHEN tokens > 0 THEN least(cap, wanted / tokens) ELSE 0.0 END AS rate FROM r),
a AS (SELECT data_id, {_SOURCE.format(c='origin')} AS source, CAST(coalesce(coalesce(inst_length, 0) + coalesce(resp_length, 0), 0) AS BIGINT) AS size FROM {_LATEST.format(t='analysis', ts='scored_at')} WHERE origin IS NOT NULL),
m AS (SELECT q.spec_name, q.name, a.data_id, a.size, CAST(floor(rate) + CASE WHEN ('0x' || substr(md5(concat_ws('|', '17', q.spec_name, q.name, q.token_size, a.data_id)), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END AS INTEGER) AS copies
  FROM q JOIN a ON a.source = {_SOURCE.format(c='q.name')} WHERE rate > 0)"""


def _fused() -> str:
    """The ranking of whole tables; exact medians stand for the sketches, which are exact for groups of up to ``ACCURACY`` rows."""
    w = ranking.WEIGHTS
    bad = ", ".join(str(x) for x in ranking.SENTINELS)
    clean = ", ".join(f"CASE WHEN isnan({s}) OR isinf({s}) OR {s} IN ({bad}) THEN NULL ELSE {s} END AS {s}" for s in w)
    mid = ", ".join(f"quantile_disc({s}, 0.5) AS m_{s}" for s in w)
    off = ", ".join(f"quantile_disc(abs({s} - m_{s}), 0.5) AS d_{s}, avg(abs({s} - m_{s})) AS a_{s}" for s in w)
    logs, total = [], []
    for s, x in w.items():
        scale = f"CASE WHEN d_{s} > 0 THEN {ranking.NORMAL} * d_{s} WHEN a_{s} > 0 THEN 1.2533 * least(a_{s}, 1e6) END"
        z = f"{'' if x > 0 else '-'}(({s} - m_{s}) / ({scale}))"
        b = f"greatest(least(CASE WHEN ({scale}) IS NULL THEN 0.5 ELSE 1 / (1 + exp(-least(greatest({z}, -30.0), 30.0))) END, {1 - ranking.FLOOR}), {ranking.FLOOR})"
        logs.append(f"CASE WHEN {s} IS NULL THEN 0.0 ELSE {abs(x)} * ln({b}) END")
        total.append(f"CASE WHEN {s} IS NULL THEN 0.0 ELSE {abs(x)} END")
    return f"""x AS (SELECT data_id, coalesce(origin, '') AS g, {clean} FROM {_LATEST.format(t='analysis', ts='scored_at')}), mid AS (SELECT g, {mid} FROM x GROUP BY 1),
off AS (SELECT g, {off} FROM x JOIN mid USING (g) GROUP BY 1), l AS (SELECT data_id, {' + '.join(logs)} AS l, {' + '.join(total)} AS t FROM x JOIN mid USING (g) JOIN off USING (g)),
fused AS (SELECT data_id, CASE WHEN t > 0 THEN round(exp(l / t), {ranking.DIGITS}) END AS p FROM l)"""


_FUSED = _fused()
_PROMPT_WORDS = """p AS (SELECT data_id, instruction AS text FROM (SELECT * FROM instructions WHERE data_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY ingested_at DESC) = 1)
  UNION ALL SELECT data_id, array_to_string(list_transform(list_filter(messages, lambda m: m.role IN ('user', 'human')), lambda m: coalesce(m.content, '')), ' ')
  FROM (SELECT * FROM conversations WHERE data_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY ingested_at DESC) = 1)),
w AS (SELECT data_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM p),
c AS (SELECT data_id, word, count(*) AS k FROM w GROUP BY ALL),
n AS (SELECT data_id, sum(k) AS n FROM c GROUP BY 1 HAVING sum(k) >= 20),
f AS (SELECT c.*, n.n, count(*) OVER (PARTITION BY word) AS df FROM c JOIN n USING (data_id)),
t AS (SELECT *, sum(k) OVER (PARTITION BY data_id ORDER BY df, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
cand AS (SELECT DISTINCT a.data_id AS id_a, b.data_id AS id_b, a.n AS na, b.n AS nb FROM t a JOIN t b ON a.word = b.word AND a.data_id < b.data_id
  WHERE coalesce(a.before, 0) <= 0.2 * a.n + 1 AND coalesce(b.before, 0) <= 0.2 * b.n + 1 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
o AS (SELECT d.id_a, d.id_b, d.na, d.nb, sum(least(x.k, y.k)) AS o FROM cand d JOIN f x ON x.data_id = d.id_a JOIN f y ON y.data_id = d.id_b AND y.word = x.word GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_RATED} SELECT DISTINCT spec_name, name FROM r WHERE token_size > tokens * cap",
        "p1_rates": f"""WITH {_RATED}, q AS (SELECT *, CASE WHEN tokens > 0 THEN least(cap, wanted / tokens) ELSE 0.0 END AS rate FROM r)
SELECT spec_name, name, CAST(tokens AS BIGINT) AS tokens, round(rate, 6) AS rate,
  round(coalesce(wanted / nullif(sum(wanted) OVER (PARTITION BY spec_name), 0), 0), 6) AS target_share,
  round(coalesce(rate * tokens / nullif(sum(rate * tokens) OVER (PARTITION BY spec_name), 0), 0), 6) AS expected_share FROM q""",
        "p1_mix": f"WITH {_MIXED} SELECT spec_name, name, data_id, size, copies FROM m WHERE copies > 0",
        "p1_copies": f"WITH {_MIXED} SELECT spec_name, name, data_id, size, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM m WHERE copies > 0",
        "p1_shares": f"""WITH {_MIXED}, u AS (SELECT spec_name, name, sum(CASE WHEN copies > 0 THEN 1 ELSE 0 END) AS n, sum(size * copies) AS t FROM m GROUP BY 1, 2), y AS (SELECT spec_name, sum(t) AS t FROM u GROUP BY 1)
SELECT q.spec_name, q.name, wanted, round(coalesce(wanted / nullif(sum(wanted) OVER (PARTITION BY q.spec_name), 0), 0), 6) AS target_share, round(rate, 6) AS rate, CAST(coalesce(u.n, 0) AS BIGINT) AS used_records, CAST(coalesce(u.t, 0) AS BIGINT) AS used_tokens,
  round(coalesce(coalesce(u.t, 0) / nullif(y.t, 0), 0), 6) AS actual_share FROM q LEFT JOIN u ON u.spec_name IS NOT DISTINCT FROM q.spec_name AND u.name IS NOT DISTINCT FROM q.name LEFT JOIN y ON y.spec_name = q.spec_name""",
        "p6_rank": f"WITH {_FUSED} SELECT data_id, p AS overall_preference, row_number() OVER (ORDER BY p DESC NULLS LAST, data_id) AS rank FROM fused",
        "p2_found": f"WITH {_PROMPT_WORDS} SELECT id_a, id_b FROM o WHERE 5 * o >= 4 * (na + nb - o)",
        "p5_found": f"""WITH have AS (SELECT {_LABEL.format(c='setfit_label')} AS l, count(*) AS n FROM {_LATEST.format(t='categories', ts='classified_at')} WHERE setfit_label IS NOT NULL GROUP BY 1),
size AS (SELECT spec_name, max(sample_size) AS s FROM dataset_config GROUP BY 1)
SELECT DISTINCT t.spec_name, t.setfit_label FROM category_targets t LEFT JOIN have ON have.l = {_LABEL.format(c='t.setfit_label')} LEFT JOIN size USING (spec_name)
WHERE coalesce(have.n, 0) < greatest(coalesce(t.proportion, 0) * coalesce(size.s, 0), coalesce(t.min_rows, 0)) - 1e-9""",
        "p8_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE question IS NOT NULL),
ds AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
es AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM ds JOIN es USING (g)""",
    }


