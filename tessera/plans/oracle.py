"""The core queries in SQL (DuckDB), over views named as the tables."""

from __future__ import annotations

from tessera.operators.filters import CATEGORIES, ROUTES
from tessera.plans.queries import PROPORTIONS

CATS = ", ".join(f"'{c}'" for c in CATEGORIES)
WS = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR {strip(c)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(c)}, '{WS}+')) END)"


def newest(t: str, ts: str) -> str:
    return f"(SELECT * FROM {t} WHERE data_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY {ts} DESC) = 1)"


ROLE = "replace(replace(m.role, 'human', 'user'), 'gpt', 'assistant')"
CONV = f"conv AS (SELECT data_id, origin, language, list_transform(messages, lambda m: {{'role': {ROLE}, 'content': m.content}}) AS messages FROM {newest('conversations', 'ingested_at')} WHERE messages IS NOT NULL)"
INST = f"inst AS (SELECT * FROM {newest('instructions', 'ingested_at')})"
PLAIN = r"trim(regexp_replace(lower(setfit_label), '[\s_-]+', ' ', 'g'))"
CASES = " ".join(f"WHEN '{c.lower()}' THEN '{c}'" for c in CATEGORIES)
LABELS = f"labels AS (SELECT data_id, n_messages, CASE {PLAIN} {CASES} END AS setfit_label FROM {newest('categories', 'classified_at')})"
ANALYSIS = f"ana AS (SELECT * FROM {newest('analysis', 'scored_at')})"
POOL = f"{ANALYSIS}, {LABELS}, pool AS (SELECT ana.*, labels.setfit_label FROM ana LEFT JOIN labels USING (data_id) WHERE ana.origin IS NOT NULL)"
EXCH = f"""{CONV},
turns AS (SELECT data_id, origin, messages, len(messages) AS n, list_position(list_transform(messages, lambda m: m.role), 'user') AS s FROM conv),
hits AS (SELECT data_id, origin, messages, unnest(range(s, n + 1, 2)) AS i FROM turns WHERE n >= 2 AND s IS NOT NULL AND s > 0),
ex AS (SELECT data_id, origin, CAST(row_number() OVER (PARTITION BY data_id ORDER BY i) - 1 AS INTEGER) AS exchange_idx, coalesce(messages[i].content, '') AS instruction,
  CASE WHEN messages[i + 1].role = 'assistant' THEN coalesce(messages[i + 1].content, '') ELSE '' END AS response FROM hits WHERE messages[i].role = 'user')"""
LAB = f"([{CATS}])[length(instruction) % 7 + 1]"
STEPS = rf"""CASE WHEN contains(response, E'\n\n') THEN string_split(regexp_replace(response, ':{WS}+', E':\n', 'g'), E'\n\n') WHEN contains(response, E'\n') THEN
  list_filter(regexp_split_to_array(response, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]'), lambda x, i: x <> '' OR i < len(regexp_split_to_array(response, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{{2028}}\x{{2029}}]')))
  ELSE list_filter(string_split(regexp_replace(response, '([.!?])["'')\]]*[ \t]+(["''(\[]*[\p{{Lu}}\p{{N}}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip('x')} <> '') END"""
QUOTE = "coalesce(quantile_cont({x}, {q}), NULL)"


def clean(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


EXTRA = {"Generation": ("if_quality",), "Brainstorming": ("if_quality",), "Math": ("process_reward",), "Coding": ("code_quality",)}


def relevant(m: str) -> str:
    general = m in ("quality", "complexity", "difficulty_v2")
    no = [c for c, own in EXTRA.items() if not general and m not in own]
    return "TRUE" if not no else f"(setfit_label IS NULL OR setfit_label NOT IN ({', '.join(repr(c) for c in no)}))"


ROBUST = ("quality", "complexity", "if_quality", "process_reward", "code_quality")
FIT = "fit AS (SELECT " + ", ".join(f"quantile_cont(x_{m}, 0.5) AS {m}_center, quantile_cont(x_{m}, 0.99) - quantile_cont(x_{m}, 0.01) AS {m}_scale" for m in ROBUST) + " FROM (SELECT " + ", ".join(f"CASE WHEN {relevant(m)} THEN coalesce({clean(m)}, 0.0) END AS x_{m}" for m in ROBUST) + " FROM pool))"
DEDICATED = "CASE WHEN setfit_label IN ('Generation', 'Brainstorming') THEN if_quality WHEN setfit_label = 'Math' THEN process_reward WHEN setfit_label = 'Coding' THEN code_quality ELSE quality END"


def preference(strategy: str) -> str:
    """Relation ``pref`` with ``overall_preference`` not rounded."""
    quality = DEDICATED if "dedicated" in strategy or "combination" in strategy else "quality"
    scaled = ", ".join(f"({clean(m)} - {m}_center) / CASE WHEN {m}_scale = 0 THEN 1 ELSE {m}_scale END AS {m}" for m in ROBUST)
    mm = lambda m: f"CASE WHEN max({m}) OVER w = min({m}) OVER w THEN CASE WHEN {m} IS NULL THEN NULL ELSE 0.0 END ELSE ({m} - min({m}) OVER w) / (max({m}) OVER w - min({m}) OVER w) END AS {m}"
    how = {"default": "quality * difficulty_v2", "random": "1.0", "random_x": "0.0", "difficulty": "difficulty_v2", "longest": "CAST(last_resp_length AS DOUBLE)", "deita": "quality * complexity", "difficulty_v2": "difficulty_v2", "quality": "quality", "dedicated_quality": "quality", "combination_v5": "quality * difficulty_v2", "complexity": "complexity"}[strategy]
    return f"""{POOL}, {FIT}, r AS (SELECT data_id, origin, setfit_label, inst_length, resp_length, last_resp_length, {clean('difficulty_v2')} AS difficulty_v2, {scaled} FROM pool, fit),
q AS (SELECT * REPLACE ({quality} AS quality) FROM r),
mm AS (SELECT data_id, origin, setfit_label, inst_length, resp_length, last_resp_length, {mm('quality')}, {mm('complexity')}, {mm('difficulty_v2')} FROM q WINDOW w AS (PARTITION BY origin)),
pref AS (SELECT *, {how} AS overall_preference FROM mm)"""


BY_LENGTH = "ORDER BY resp_length DESC, data_id"
RELATIONS = (("+", ">"), ("or more", ">="), ("at least", ">="), ("more than", ">"), ("longer than", ">"), ("less than", "<"), ("fewer than", "<"), ("at most", "<="), ("or less", "<="), ("around", "="), ("-word", "="), ("up to", "<="), (" to", "--"), ("-", "--"))
NEGATED = "(contains(response, 'n''t ') OR contains(response, 'not ') OR contains(response, 'no ') OR contains(response, 'without'))"


def count_of(part: str, c: str = "response") -> str:
    return f"CAST((length({c}) - length(replace({c}, '{part}', ''))) / {len(part)} AS BIGINT)"


LOWER = r"(regexp_matches(response, '\p{Ll}') AND NOT regexp_matches(response, '[\p{Lu}\p{Lt}]'))"
UPPER = r"(regexp_matches(response, '\p{Lu}') AND NOT regexp_matches(response, '[\p{Ll}\p{Lt}]'))"
BLANKS = count_of(" ")
SENTENCES = f"len(list_filter(regexp_split_to_array(response, '[.?!]'), lambda x: {strip('x')} <> ''))"
PARAGRAPHS = rf"len(list_filter(string_split(response, E'\n\n'), lambda x: {strip('x')} <> ''))"
OUTCOMES = [
    f"CASE WHEN {BLANKS} > 15 THEN TRUE END",
    f"CASE WHEN {SENTENCES} < 3 THEN TRUE END",
    f"CASE WHEN {PARAGRAPHS} BETWEEN 2 AND 4 THEN TRUE END",
    "contains(response, 'the') AND contains(response, 'a')",
    "NOT (contains(response, 'but') OR contains(response, 'record'))",
    f"{count_of('needs')} + {count_of('Needs')} = 1",
    f"{count_of('e')} >= 12",
    "NOT contains(response, ',')",
    LOWER,
    "CAST(contains(response, 'Yes') AS INT) + CAST(contains(response, 'No') AS INT) = 1",
    "starts_with(response, 'Any goalkeeper worth')",
    "suffix(response, '.')",
    "prefix(response, '\"') AND suffix(response, '\"')",
    f"len(list_filter(regexp_split_to_array(instruction, '[.?!]'), lambda x: {strip('x')} <> '' AND contains(response, x))) > 0",
    "CAST(NULL AS BOOLEAN)",
]
OUT = f"out AS (SELECT data_id, exchange_idx, [{', '.join(OUTCOMES)}] AS o FROM ex)"
STANDIN = "(length(response) % 13) / 13.0"
UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
DIST = f"near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS bl, a.label AS al, 1 - list_cosine_similarity({UNIT.replace('embedding', 'a.embedding')}, {UNIT.replace('embedding', 'b.embedding')}) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
GREEDY = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), {DIST},
bad AS MATERIALIZED (SELECT va.r AS better, vb.r AS worse FROM near JOIN v va ON va.vec_id = near.a JOIN v vb ON vb.vec_id = near.b WHERE va.r < vb.r AND round(near.d, 12) <= 0.7),
lists AS MATERIALIZED (SELECT v.r, v.vec_id, coalesce(list(bad.better) FILTER (WHERE bad.better IS NOT NULL), []) AS better FROM v LEFT JOIN bad ON bad.worse = v.r GROUP BY v.r, v.vec_id),
scan AS (SELECT 0 AS r, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT scan.r + 1, CASE WHEN len(list_intersect(scan.kept, l.better)) = 0 THEN list_append(scan.kept, l.r) ELSE scan.kept END FROM scan JOIN lists l ON l.r = scan.r + 1 WHERE scan.r < {{limit}})
"""


def oracle_sql() -> dict[str, str]:  # noqa: C901
    o: dict[str, str] = {}
    o["exchanges"] = f"WITH {EXCH} SELECT data_id, exchange_idx, instruction, response FROM ex"
    o["exchange_counts"] = f"WITH {EXCH} SELECT conv.data_id, CAST(count(ex.data_id) AS INTEGER) AS num_exchanges FROM conv LEFT JOIN ex USING (data_id) GROUP BY 1"
    joined = strip("coalesce(instruction, '') || E'\\n' || coalesce(input, '')")
    o["ingest_chat"] = f"WITH {INST} SELECT data_id, 2 AS turns, 'user' AS first_role, {joined} AS prompt, output AS answer FROM inst WHERE instruction IS NOT NULL"
    o["joined_prompts"] = f"WITH {INST} SELECT data_id, CASE WHEN coalesce(instruction, '') <> '' AND coalesce(input, '') <> '' THEN instruction || E'\\n\\n' || input ELSE coalesce(instruction, '') || coalesce(input, '') END AS prompt FROM inst"
    o["selection_chat"] = f"WITH {INST} SELECT data_id, instruction || E'\\n\\n' || coalesce(input, '') AS prompt, output AS answer FROM inst WHERE instruction IS NOT NULL"
    o["normal_roles"] = f"SELECT {ROLE} AS role, count(*) AS turns FROM (SELECT unnest(messages) AS m FROM conversations WHERE data_id IS NOT NULL) GROUP BY 1"
    o["renamed"] = f"WITH {INST} SELECT data_id, instruction, output FROM inst"
    o["default_columns"] = f"WITH {CONV} SELECT coalesce(origin, 'unknown') AS origin, lower(coalesce(language, 'en')) AS language, count(*) AS n FROM conv GROUP BY 1, 2"
    o["ids_without_language"] = "SELECT DISTINCT data_id, CASE WHEN data_id IS NULL THEN NULL ELSE array_to_string(list_concat(string_split(data_id, '_')[1:2], string_split(data_id, '_')[4:]), '_') END AS plain_id FROM instructions"
    o["assigned_ids"] = "SELECT item_id, 'eval-items_v1_en_' || (row_number() OVER (ORDER BY item_id) - 1) AS data_id FROM eval_items"
    o["first_answers"] = f"WITH {CONV} SELECT data_id, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS text FROM conv"
    empty = "messages[1].role = 'system' AND messages[1].content = ''"
    o["empty_system_dropped"] = f"WITH {CONV} SELECT data_id, CAST(CASE WHEN {empty} THEN len(messages) - 1 ELSE len(messages) END AS INTEGER) AS turns, CASE WHEN {empty} THEN messages[2].role ELSE messages[1].role END AS first_role FROM conv"
    kto = f"WITH {CONV}, k AS (SELECT data_id, messages, row_number() OVER (ORDER BY data_id) - 1 AS i FROM conv)"
    o["preference_pairs"] = f"{kto} SELECT 2 * i AS position, data_id, TRUE AS label, FALSE AS negative_label, {strip('messages[1].content')} AS prompt FROM k"
    o["preference_unpacked"] = f"{kto} SELECT 2 * i AS position, data_id, TRUE AS label FROM k UNION ALL SELECT 2 * i + 1, data_id, FALSE FROM k"
    users = "array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: coalesce(m.content, '')), ' ')"
    o["chosen_prompts"] = f"WITH {CONV} SELECT data_id, coalesce({strip(users)}, '') AS prompt FROM conv"
    o["prompt_completion"] = f"WITH {CONV} SELECT data_id, CAST(greatest(len(messages) - 1, 0) AS INTEGER) AS prompt_turns, messages[-1].role AS role, messages[-1].content AS completion FROM conv"
    o["chatml_rendered"] = f"WITH {CONV} SELECT data_id, coalesce(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || E'\\n' || coalesce(m.content, '') || E'<|im_end|>\\n'), ''), '') AS text FROM conv"
    sysd = "CASE WHEN messages[1].role = 'system' THEN '<<SYS>>' || E'\\n' || messages[1].content || E'\\n<</SYS>>\\n\\n' ELSE '' END"
    one = "CASE WHEN i % 2 = 1 THEN '<s>[INST] ' || " + strip("(CASE WHEN i = 1 THEN said ELSE '' END) || coalesce(m.content, '')") + " || ' [/INST]' ELSE ' ' || " + strip("coalesce(m.content, '')") + " || ' </s>' END"
    o["instruct_rendered"] = f"""WITH {CONV}, p AS (SELECT data_id, {sysd} AS said, CASE WHEN messages[1].role = 'system' THEN messages[2:] ELSE messages END AS rest FROM conv),
g AS (SELECT * FROM p WHERE len(list_filter(rest, lambda m, i: m.role <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0)
SELECT data_id, coalesce(array_to_string(list_transform(rest, lambda m, i: {one}), ''), '') AS text FROM g"""
    o["response_steps"] = f"WITH {EXCH}, s AS (SELECT data_id, exchange_idx, {STEPS} AS steps FROM ex WHERE contains(response, E'\\n')) SELECT data_id, exchange_idx, CAST(len(steps) AS INTEGER) AS n_steps, steps[1] AS first_step FROM s"
    code = "replace(response, '\\n', E'\\n')"
    for mark in ("```cpp", "```python", "```java", "```c++", "```json", "```xml", "```"):
        code = f"replace({code}, '{mark}', '')"
    o["cleaned_code"] = f"WITH {EXCH} SELECT data_id, exchange_idx, {code} AS code FROM ex WHERE contains(response, '```')"
    o["truncated_responses"] = f"WITH {EXCH} SELECT data_id, exchange_idx, array_to_string(string_split(response, ' ')[1:5], ' ') AS head, array_to_string(string_split(response, ' ')[-5:], ' ') AS tail FROM ex"

    lens = f"{EXCH}, l AS (SELECT data_id, exchange_idx, {words('instruction')} AS i, {words('response')} AS r FROM ex), tl AS (SELECT data_id, CAST(sum(i) AS BIGINT) AS inst_length, CAST(sum(r) AS BIGINT) AS resp_length, CAST(coalesce(arg_max(r, exchange_idx) FILTER (WHERE r > 0), 0) AS INTEGER) AS last_resp_length FROM l GROUP BY 1)"
    o["token_lengths"] = f"WITH {lens} SELECT * FROM tl"
    o["corpus_tokens"] = f"WITH {lens} SELECT CAST(coalesce(sum(inst_length + resp_length), 0) AS BIGINT) AS tokens FROM tl"
    o["dataset_stats"] = f"WITH {EXCH}, c AS (SELECT conv.data_id, conv.origin, count(ex.data_id) AS t FROM conv LEFT JOIN ex USING (data_id) WHERE conv.origin IS NOT NULL GROUP BY 1, 2) SELECT origin, count(*) AS samples, CAST(sum(t) AS BIGINT) AS user_messages, avg(t) AS avg_turns FROM c GROUP BY 1"
    o["majority_labels"] = f"WITH {EXCH}, n AS (SELECT data_id, {LAB} AS label, count(*) AS k, min(exchange_idx) AS f FROM ex GROUP BY 1, 2) SELECT data_id, label AS setfit_label FROM n QUALIFY row_number() OVER (PARTITION BY data_id ORDER BY k DESC, f) = 1"
    o["composition_by_origin"] = f"WITH {ANALYSIS} SELECT origin, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM ana GROUP BY 1"
    o["composition_by_label"] = f"WITH {LABELS} SELECT setfit_label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM labels GROUP BY 1"
    o["composition_by_language"] = f"WITH {INST} SELECT lower(language) AS language, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM inst GROUP BY 1"
    o["score_histogram"] = f"WITH {POOL}, x AS (SELECT complexity AS x, setfit_label FROM pool WHERE complexity IS NOT NULL AND NOT isnan(complexity)), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x) SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / 40)), 39) END AS INTEGER) AS bin, setfit_label, count(*) AS n FROM x, e GROUP BY 1, 2"
    o["preference_stats"] = f"WITH {preference('quality')} SELECT avg(overall_preference) AS mean, quantile_cont(overall_preference, 0.5) AS median FROM pref"
    o["sampled_totals"] = f"WITH {POOL} SELECT origin, count(*) AS samples, CAST(sum(inst_length + resp_length) AS BIGINT) AS tokens FROM pool WHERE inst_length + resp_length <= 150 GROUP BY 1"

    route = lambda s: ", ".join(f"'{x}'" for x in ROUTES[s])
    o["mean_complexity"] = f"WITH {EXCH} SELECT data_id, avg({STANDIN}) AS complexity FROM ex GROUP BY 1"
    o["mean_quality"] = f"WITH {EXCH} SELECT data_id, coalesce(avg({STANDIN}) FILTER (WHERE response <> '' AND {LAB} IN ({route('quality')})), 0.0) AS quality FROM ex GROUP BY 1"
    o["mean_difficulty"] = f"WITH {EXCH} SELECT data_id, coalesce(avg({STANDIN}) FILTER (WHERE response <> ''), 0.0) AS difficulty_v2 FROM ex GROUP BY 1"
    o["routed_scores"] = f"WITH {EXCH} SELECT data_id, exchange_idx, {LAB} AS label, CASE WHEN {LAB} IN ({route('if_quality')}) THEN {STANDIN} END AS score FROM ex"
    e = [f"exp(10 * CAST(embedding[{i}] AS DOUBLE))" for i in range(1, 6)] + ["exp(-20.0)"]
    o["softmax_marks"] = f"SELECT vec_id, round(({' + '.join(f'{k} * {x}' for k, x in enumerate(e, 1))}) / ({' + '.join(e)}), 6) AS mark FROM embeddings"
    p = [f"1 / (1 + exp(CAST(embedding[{i + 1}] AS DOUBLE) - CAST(embedding[{i + 2}] AS DOUBLE)))" for i in (0, 2, 4, 6)]
    o["step_probabilities"] = f"SELECT vec_id, 4 AS steps, round(least({', '.join(p)}), 6) AS least, round(({' + '.join(p)}) / 4, 6) AS mean FROM embeddings"
    o["constraint_outcomes"] = f"WITH {EXCH}, {OUT} SELECT data_id, exchange_idx, CAST(unnest(range(0, {len(OUTCOMES)})) AS INTEGER) AS nth, unnest(o) AS followed FROM out"
    o["instruction_scores"] = f"""WITH {EXCH}, {OUT}, s AS (SELECT data_id, exchange_idx, len(list_filter(o, lambda x: x IS NULL)) AS u, len(list_filter(o, lambda x: x IS NOT NULL)) AS n, len(list_filter(o, lambda x: coalesce(x, FALSE))) AS y FROM out)
SELECT data_id, exchange_idx, CAST(u AS INTEGER) AS unchecked, CAST(n AS INTEGER) AS checked, round(CASE WHEN n = 0 THEN 0.5 WHEN y > 0 AND y < 10 THEN y / n * y ELSE y / n END, 6) AS score FROM s"""
    rel = "CASE " + " ".join(f"WHEN contains(response, '{a}') THEN '{b}'" for a, b in RELATIONS) + " ELSE '=' END"
    o["rule_checks"] = f"WITH {EXCH} SELECT data_id, exchange_idx, CAST({BLANKS} AS INTEGER) AS blanks, CAST({SENTENCES} AS INTEGER) AS sentences, CAST({PARAGRAPHS} AS INTEGER) AS paragraphs, {LOWER} AS lower, {UPPER} AS upper, {NEGATED} AS negated, {rel} AS relation FROM ex"

    o["filtered_sources"] = f"WITH {INST} SELECT data_id, origin FROM inst WHERE origin = 'cinder_instruct'"
    o["first_by_id"] = f"WITH {INST} SELECT data_id, origin FROM inst ORDER BY data_id LIMIT 250"
    o["in_languages"] = f"WITH {INST} SELECT data_id, lower(language) AS language FROM inst WHERE lower(language) IN ('de', 'fr')"
    o["of_subset"] = f"WITH {POOL} SELECT data_id, origin FROM pool WHERE setfit_label = 'Math'"
    o["within_length"] = f"WITH {POOL} SELECT data_id, inst_length + resp_length AS tokens FROM pool WHERE inst_length + resp_length <= 120"
    o["relevant_metrics"] = f"WITH {POOL} SELECT setfit_label, " + ", ".join(f"CAST(sum(CAST({relevant(m)} AS INT)) AS BIGINT) AS n_{m}" for m in ("quality", "complexity", "difficulty_v2", "if_quality", "process_reward", "code_quality")) + " FROM pool GROUP BY 1"
    o["metrics_attached"] = f"WITH {CONV}, {ANALYSIS} SELECT conv.data_id, {clean('quality')} AS quality, inst_length FROM conv LEFT JOIN ana USING (data_id)"
    o["metric_tables_attached"] = f"WITH {INST}, {ANALYSIS} SELECT inst.data_id, CASE WHEN isnan(complexity) THEN NULL ELSE complexity END AS complexity, CAST(inst_length AS DOUBLE) AS inst_length, CAST(resp_length AS DOUBLE) AS resp_length FROM inst LEFT JOIN ana USING (data_id)"
    o["labels_attached"] = f"WITH {EXCH}, {LABELS} SELECT data_id, exchange_idx, {LAB} AS message_label, setfit_label AS sample_label FROM ex LEFT JOIN labels USING (data_id)"
    o["semi_joined"] = f"WITH {CONV}, {ANALYSIS} SELECT data_id, ana.origin FROM ana WHERE data_id IN (SELECT data_id FROM conv)"
    o["back_filled"] = f"WITH {INST}, {ANALYSIS} SELECT data_id, origin FROM ana WHERE data_id NOT IN (SELECT data_id FROM inst)"
    o["united"] = f"WITH {CONV}, {INST} SELECT origin, lower(language) AS language, count(*) AS n FROM (SELECT origin, CAST(NULL AS VARCHAR) AS language FROM conv UNION ALL SELECT NULL, language FROM inst) GROUP BY 1, 2"

    cols = [f"{m}_{x}" for m in ROBUST for x in ("center", "scale")]
    o["robust_fit"] = f"WITH {POOL}, {FIT} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in cols)} FROM fit"
    x = clean("complexity")
    o["min_max_by_origin"] = f"WITH {POOL}, c AS (SELECT data_id, origin, complexity AS raw, {x} AS x FROM pool) SELECT data_id, round(CASE WHEN raw IS NULL THEN NULL WHEN max(x) OVER w = min(x) OVER w THEN 0.0 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS complexity FROM c WINDOW w AS (PARTITION BY origin)"
    for s in ("default", "random", "random_x", "longest", "deita", "difficulty", "difficulty_v2", "quality", "dedicated_quality", "combination_v5", "complexity"):
        o[f"preference_{s}"] = f"WITH {preference(s)} SELECT data_id, round(overall_preference, 6) AS overall_preference FROM pref"
    o["percentile_thresholds"] = f"WITH {POOL} SELECT setfit_label, round(quantile_cont(complexity, 0.28), 6) AS threshold FROM pool WHERE setfit_label IS NOT NULL GROUP BY 1"

    o["top_longest"] = f"WITH {POOL} SELECT data_id, resp_length FROM pool {BY_LENGTH} LIMIT 100"

    def strat(n: int, p: dict[str, float], rel: str, order: str) -> str:
        case = lambda f: "CASE setfit_label " + " ".join(f"WHEN '{k}' THEN {f(i, v)}" for i, (k, v) in enumerate(p.items())) + " END"
        import math

        return f"SELECT * FROM (SELECT *, {case(lambda i, v: i)} AS pos, row_number() OVER (PARTITION BY setfit_label {order}) AS rn FROM {rel} WHERE setfit_label IN ({', '.join(repr(k) for k in p)}) QUALIFY rn <= {case(lambda i, v: math.ceil(v * n))}) ORDER BY pos, rn LIMIT {n}"

    o["stratified_top"] = f"WITH {POOL}, s AS ({strat(200, PROPORTIONS, 'pool', BY_LENGTH)}) SELECT data_id, setfit_label FROM s"
    o["label_limited"] = f"WITH {POOL} SELECT data_id, setfit_label FROM pool WHERE setfit_label IN ('Math', 'Coding', 'Extraction') QUALIFY row_number() OVER (PARTITION BY setfit_label {BY_LENGTH}) <= CASE setfit_label WHEN 'Math' THEN 90 WHEN 'Coding' THEN 38 ELSE 3 END"
    before = f"coalesce(sum(inst_length + resp_length) OVER ({{part}} {BY_LENGTH} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    o["token_budget"] = f"WITH {POOL} SELECT data_id, resp_length FROM pool QUALIFY {before.format(part='')} < 20000"
    o["token_budget_by_origin"] = f"WITH {POOL} SELECT origin, data_id FROM pool QUALIFY {before.format(part='PARTITION BY origin')} < 1500"
    o["oversampled"] = f"WITH {POOL}, t AS (SELECT data_id, row_number() OVER ({BY_LENGTH}) AS r, count(*) OVER () AS n FROM pool) SELECT data_id, 1 AS copy FROM t UNION ALL SELECT data_id, 2 FROM t WHERE r <= floor(n * 0.5)"
    o["cross_lingual_first"] = f"WITH {POOL} SELECT data_id FROM pool QUALIFY row_number() OVER (PARTITION BY array_to_string(list_concat(string_split(data_id, '_')[1:2], string_split(data_id, '_')[4:]), '_') {BY_LENGTH}) = 1"
    o["curriculum"] = f"WITH {ANALYSIS} SELECT data_id, row_number() OVER (ORDER BY difficulty_v2, data_id) - 1 AS place FROM ana WHERE difficulty_v2 IS NOT NULL AND NOT isnan(difficulty_v2)"
    o["by_category"] = f"WITH {POOL} SELECT data_id, setfit_label, row_number() OVER (ORDER BY list_position([{CATS}], setfit_label), inst_length + resp_length, data_id) - 1 AS place FROM pool WHERE setfit_label IS NOT NULL"

    o["nearest_neighbours"] = f"WITH {DIST}, r AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 12), b) AS rank FROM near) SELECT a AS vec_id, CAST(rank AS INTEGER) AS rank, round(d, 5) AS distance FROM r WHERE rank <= 2"
    o["nearest_of_queries"] = f"WITH {DIST}, r AS (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 12), b) AS rank FROM near WHERE a % 50 = 0) SELECT a AS vec_id, CAST(rank AS INTEGER) AS rank, round(d, 5) AS distance FROM r WHERE rank <= 10"
    o["text_distances"] = f"WITH {DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 12), b) AS rank FROM near QUALIFY rank <= 2) SELECT a AS vec_id, round(arg_min(d, CASE WHEN rank = 1 AND al = bl THEN 10 ELSE rank END), 5) AS distance FROM r GROUP BY 1"
    o["normalised_vectors"] = f"SELECT vec_id, 1.0 AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform({UNIT}, lambda x: x * x))), 5) AS first FROM embeddings"
    o["near_vector_pairs"] = f"WITH {DIST} SELECT a, b FROM near WHERE a < b AND round(d, 12) <= 0.55"
    # the scan, one step a row: small tables only
    o["greedy_diverse"] = GREEDY.format(limit="(SELECT count(*) FROM v)") + ", done AS (SELECT kept FROM scan ORDER BY r DESC LIMIT 1) SELECT v.vec_id FROM v, done WHERE list_contains(done.kept, v.r)"
    o["greedy_budget"] = GREEDY.format(limit="(SELECT count(*) FROM v)") + ", done AS (SELECT kept FROM scan ORDER BY r DESC LIMIT 1) SELECT v.vec_id FROM v, done WHERE list_contains(done.kept, v.r) ORDER BY v.r LIMIT 100"
    o["greedy_scanned"] = GREEDY.format(limit="least(101, (SELECT count(*) FROM v))") + ", done AS (SELECT kept FROM scan ORDER BY r DESC LIMIT 1) SELECT v.vec_id FROM v, done WHERE list_contains(done.kept, v.r)"
    o["cluster_representatives"] = """WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS p FROM embeddings), t AS (SELECT quantile_cont(p, 0.28) AS t FROM e),
b AS (SELECT vec_id, label, p FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY p DESC, vec_id) = 1), r AS (SELECT vec_id, label FROM b, t WHERE p > t),
f AS (SELECT vec_id, label FROM e WHERE vec_id NOT IN (SELECT vec_id FROM r) ORDER BY p DESC, vec_id LIMIT (SELECT 60 - count(*) FROM r)) SELECT * FROM r UNION ALL SELECT * FROM f"""

    two = "('harbor_chat_mix', 'cinder_instruct')"
    inst_turns = f"WITH {CONV.replace('conv AS', 'conv0 AS')}, {INST}"
    has = "texts AS (SELECT data_id, len(messages) AS turns, CASE WHEN messages[1].role = 'system' AND messages[1].content = '' THEN 1 ELSE 0 END AS e FROM conv0 UNION ALL SELECT data_id, 2, 0 FROM inst WHERE instruction IS NOT NULL)"
    base = f"{inst_turns}, {has}, {preference('longest')}, mine AS (SELECT pref.*, turns - e AS turns FROM pref JOIN texts USING (data_id) WHERE origin IN {two} AND inst_length + resp_length <= 4096)"
    o["select_spec"] = f"{base}, s AS ({strat(120, PROPORTIONS, 'mine', 'ORDER BY overall_preference DESC NULLS LAST, data_id')}) SELECT data_id, origin, setfit_label, overall_preference, CAST(turns AS INTEGER) AS turns FROM s"

    # ---- orders by md5
    by = lambda seed, c="data_id": f"md5('{seed}|' || {c}), {c}"
    o["random_sample"] = f"WITH {POOL} SELECT data_id, origin FROM pool ORDER BY {by(0)} LIMIT 250"
    o["preference_order"] = f"WITH {preference('deita')} SELECT data_id, round(overall_preference, 6) AS overall_preference FROM pref ORDER BY round(overall_preference, 12) DESC NULLS LAST, {by(42)} LIMIT 300"
    o["train_test"] = f"WITH {POOL} SELECT data_id, CASE WHEN ('0x' || substr(md5('42|' || data_id), 1, 8))::BIGINT / 4294967296.0 < 0.03 THEN 'test' ELSE 'train' END AS split FROM pool"
    o["random_members"] = f"WITH {POOL} SELECT data_id, origin FROM pool QUALIFY row_number() OVER (PARTITION BY origin ORDER BY {by(7)}) = 1"
    o["shuffled_order"] = f"WITH {ANALYSIS} SELECT data_id, row_number() OVER (ORDER BY {by(1234)}) - 1 AS place FROM ana"
    o["whole_curriculum"] = f"WITH {ANALYSIS} SELECT data_id, row_number() OVER (ORDER BY {clean('difficulty_v2')} NULLS LAST, data_id) - 1 AS place FROM ana"
    o["all_response_steps"] = f"WITH {EXCH}, s AS (SELECT data_id, exchange_idx, {STEPS} AS steps FROM ex) SELECT data_id, exchange_idx, CAST(len(steps) AS INTEGER) AS n_steps, steps[1] AS first_step FROM s"
    o["mean_process_reward"] = f"WITH {EXCH}, s AS (SELECT data_id, CASE WHEN {LAB} = 'Math' THEN list_min(list_transform({STEPS}, lambda x: CAST(length(x) AS DOUBLE))) END AS r FROM ex) SELECT data_id, coalesce(avg(r), 0.0) AS process_reward FROM s GROUP BY 1"
    o["cluster_quality"] = f"""WITH l AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS d, unnest({UNIT}) AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM l GROUP BY 1, 2), g AS (SELECT d, avg(x) AS g FROM l GROUP BY 1),
w AS (SELECT vec_id, label, sum((x - m) * (x - m)) AS q FROM l JOIN m USING (label, d) GROUP BY 1, 2), s AS (SELECT label, avg(sqrt(q)) AS s, sum(q) AS w, count(*) AS n FROM w GROUP BY 1),
b AS (SELECT label, sum((m - g) * (m - g)) AS b FROM m JOIN g USING (d) GROUP BY 1), r AS (SELECT i.label, max((si.s + sj.s) / dist) AS r FROM (SELECT a.label, c.label AS other, sqrt(sum((a.m - c.m) * (a.m - c.m))) AS dist FROM m a JOIN m c ON a.d = c.d AND a.label <> c.label GROUP BY 1, 2) i JOIN s si ON si.label = i.label JOIN s sj ON sj.label = i.other GROUP BY 1)
SELECT (SELECT round(avg(r), 4) FROM r) AS davies_bouldin, round(sum(n * b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 4) AS calinski_harabasz FROM s JOIN b USING (label)"""
    fence = "regexp_extract(response, '(?s)(```.*?)(?:```|\\z)', 1)"
    cut = strip(code.replace("response", "src"))
    o["code_reviews"] = f"""WITH {EXCH}, f AS (SELECT data_id, exchange_idx, length(response) % 3 <> 0 AS ok, {fence} AS src FROM ex WHERE contains(response, '```')),
n AS (SELECT data_id, exchange_idx, ok, {cut} AS a, {cut.replace('src', "regexp_replace(src, E'\\n[^\\n]*\\n?$', '')")} AS b FROM f),
c AS (SELECT data_id, exchange_idx, ok, CASE WHEN a = '' THEN 0 ELSE len(string_split(a, E'\n')) END AS na, CASE WHEN b = '' THEN 0 ELSE len(string_split(b, E'\n')) END AS nb FROM n)
SELECT data_id, exchange_idx, round(CASE WHEN na = 0 THEN 1.0 WHEN ok AND na > 3 AND nb = 0 THEN 1.0 WHEN ok THEN nb / na ELSE nb / na * 0.5 END, 6) AS score, CAST(CASE WHEN na = 0 OR (ok AND na > 3 AND nb = 0) THEN 0 ELSE na - nb END AS DOUBLE) AS distance, na = 0 OR (ok AND na > 3 AND nb = 0) OR ok AS correct FROM c"""
    # ---- sources and sinks
    o["jsonl_written_and_read"] = f"WITH {CONV} SELECT data_id, CAST(len(messages) AS INTEGER) AS turns, origin, messages[1].content AS first FROM conv"
    o["metric_columns_read"] = f"WITH {INST}, {ANALYSIS}, {LABELS} SELECT inst.data_id, {clean('quality')} AS quality, CAST(resp_length AS DOUBLE) AS resp_length, setfit_label FROM inst LEFT JOIN ana USING (data_id) LEFT JOIN labels USING (data_id)"
    o["metric_tables_written"] = f"WITH {INST}, {ANALYSIS} SELECT inst.data_id, {clean('complexity')} AS complexity, CAST(inst_length AS DOUBLE) AS inst_length FROM inst LEFT JOIN ana USING (data_id)"
    o["sidecar_written"] = f"WITH {EXCH}, {OUT} SELECT data_id, CAST(unnest(range(0, {len(OUTCOMES)})) AS INTEGER) AS nth, unnest(o) AS followed FROM out WHERE exchange_idx = 0"
    o["sources_by_ending"] = "SELECT item_id, benchmark, regexp_replace(question, '[\\r\\n]+', ' ', 'g') AS question, ending FROM eval_items, (SELECT unnest(['jsonl', 'csv', 'orc', 'parquet']) AS ending)"
    o["subsets_united"] = f"WITH {INST} SELECT lower(language) AS subset, count(*) AS n FROM inst WHERE lower(language) IN ('en', 'de', 'fr') GROUP BY 1"
    o["registered"] = f"WITH {CONV} SELECT 'conversations' AS name, count(*) AS n FROM conv UNION ALL SELECT 'raw_eval_items', count(*) FROM eval_items"
    o["results_cached"] = f"WITH {ANALYSIS} SELECT w AS \"when\", w = 'after' AS found, (SELECT count(*) FROM ana) AS rows FROM (SELECT unnest(['before', 'after', 'repeat']) AS w)"
    o["templates_filled"] = f"WITH {INST} SELECT data_id, 'Task: ' || coalesce(instruction, '') || E'\\n{{as JSON}} for ' || coalesce(origin, '') AS prompt FROM inst"
    o["training_read"] = f"WITH {CONV} SELECT f AS file, (SELECT CAST(sum(len(messages)) AS BIGINT) FROM conv) AS turns FROM (SELECT unnest(['messages', 'pairs']) AS f)"
    o["canonical_columns"] = f"WITH {CONV} SELECT data_id, CAST(len(messages) AS INTEGER) AS turns FROM conv"
    o["strict_numbers"] = f"WITH {ANALYSIS} SELECT data_id, CASE WHEN resp_length % 11 = 0 OR isnan(complexity) THEN NULL ELSE complexity END AS complexity FROM ana"
    o["subset_specs"] = "SELECT name, s AS subset, CASE s WHEN 'a' THEN 'en' ELSE 'de' END AS language, CAST(CASE s WHEN 'a' THEN 5 ELSE length(name) END AS INTEGER) AS sample_size FROM (SELECT DISTINCT name FROM dataset_config WHERE name IS NOT NULL), (SELECT unnest(['a', 'b']) AS s)"
    # ---- scorers by name, prompts of models
    o["generated"] = f"WITH {INST} SELECT data_id, length(instruction) || '|' || instruction AS completion FROM inst WHERE instruction IS NOT NULL"
    e2 = "exp(length(instruction) % 5)"
    o["generated_logprobs"] = f"WITH {INST} SELECT data_id, round(CASE WHEN length(instruction) % 3 = 0 THEN 3.0 ELSE (1 + 2 * {e2} + 18 * exp(-20.0)) / (1 + {e2} + 4 * exp(-20.0)) END, 6) AS mark FROM inst WHERE instruction IS NOT NULL"
    o["chat_answers"] = f"WITH {CONV} SELECT data_id, CAST(length(array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || E'\\n' || coalesce(m.content, '') || E'<|im_end|>\\n'), '') || E'<|im_start|>assistant\\n') AS VARCHAR) AS answer FROM conv WHERE len(messages) > 0"
    o["classified_messages"] = o["majority_labels"]
    from tessera.plans.queries import TEMPLATE

    said = TEMPLATE.replace("{examples}", '1. Math\n   e.g., "2 + 2"\n2. Coding\n   e.g., "def f"').replace("{{", "{").replace("}}", "}").replace("{input}", "")
    n = f"(length(instruction) + {len(said)})"
    o["classified_by_prompt"] = f"WITH {INST} SELECT data_id, CASE WHEN {n} % 7 = 6 THEN '' ELSE ([{CATS}])[{n} % 7 + 1] END AS category, CASE WHEN {n} % 7 = 6 THEN NULL ELSE CAST({n} AS VARCHAR) END AS explanation FROM inst WHERE instruction IS NOT NULL"
    o["difficulty_prompts"] = f"WITH {INST} SELECT data_id, array_to_string(string_split(E'<|im_start|>system\\nRate tasks of all.<|im_end|>\\n<|im_start|>user\\n' || instruction || E'<|im_end|>\\n', ' ')[-12:], ' ') AS prompt FROM inst WHERE instruction IS NOT NULL"
    o["marked_steps"] = f"WITH {EXCH} SELECT data_id, exchange_idx, array_to_string({STEPS}, '<extra_0>') || '<extra_0>' AS marked_response FROM ex"
    mark = "(1.0 * exp(length(response) % 5) + 20 * exp(-20.0)) / (exp(length(response) % 5) + 5 * exp(-20.0))"
    per = lambda v: f"SELECT data_id, {v} AS v FROM z GROUP BY 1"
    heard = f"SELECT count(*) AS samples, round(avg(v), 4) AS mean"
    o["analyses_by_name"] = f"""WITH {EXCH}, {OUT}, z AS (SELECT ex.*, {LAB} AS lab, {STANDIN} AS st, {mark} AS mk, {words('response')} AS wc, o FROM ex JOIN out USING (data_id, exchange_idx)),
q AS ({per(f"coalesce(avg(mk) FILTER (WHERE response <> '' AND lab IN ({route('quality')})), 0.0)")}), c AS ({per('avg(mk)')}), df AS ({per("coalesce(avg(st) FILTER (WHERE response <> ''), 0.0)")}), p AS ({per("coalesce(avg(st) FILTER (WHERE lab = 'Math'), 0.0)")}),
i0 AS (SELECT data_id, response, lab, len(list_filter(o, lambda x: x IS NOT NULL)) AS n, len(list_filter(o, lambda x: coalesce(x, FALSE))) AS y FROM z), i AS (SELECT data_id, coalesce(avg(CASE WHEN n = 0 THEN 0.5 WHEN y > 0 AND y < 10 THEN y / n * y ELSE y / n END) FILTER (WHERE response <> '' AND lab IN ({route('if_quality')})), 0.0) AS v FROM i0 GROUP BY 1),
t AS ({per('sum(wc)')}), d0 AS (SELECT data_id, origin, count(*) AS n FROM z WHERE origin IS NOT NULL GROUP BY 1, 2), d AS (SELECT origin, count(*) AS s, avg(n) AS a FROM d0 GROUP BY 1)
{heard}, 'quality' AS analysis FROM q UNION ALL {heard}, 'complexity' FROM c UNION ALL {heard}, 'difficulty_v2' FROM df UNION ALL {heard}, 'process_reward_modelling' FROM p UNION ALL {heard}, 'if_quality' FROM i UNION ALL {heard}, 'tokens' FROM t UNION ALL SELECT CAST(sum(s) AS BIGINT), round(avg(a), 4), 'dataset_stats' FROM d"""
    # ---- constraints
    from tessera.functions.rules import TYPES

    kind = "([" + ", ".join(f"'{t}'" for t in (*TYPES, "style")) + "])[length(instruction) % 14 + 1]"
    see = "'see word ' || regexp_extract(instruction, '[A-Za-z]+', 0)"
    o["constraints_kept"] = f"""WITH {INST}, k AS (SELECT data_id, list_filter([CASE WHEN {kind} <> 'style' AND NOT contains({see}, 'word ' || instruction) THEN {kind} || '=word ' || instruction END, CASE WHEN {kind} = 'style' OR NOT contains('word ' || instruction, {see}) THEN 'length=' || {see} END], lambda x: x IS NOT NULL) AS l FROM inst WHERE instruction IS NOT NULL)
SELECT data_id, CAST(len(l) AS INTEGER) AS n, coalesce(array_to_string(l, ' | '), '') AS kept FROM k"""
    o["first_objects"] = f"""WITH {INST} SELECT data_id, '{{"a": {{"b": "' || regexp_replace(instruction, '[{{}}]', '', 'g') || '"}}, "c": {{}}}}' AS object, CAST(NULL AS VARCHAR) AS open FROM inst WHERE instruction IS NOT NULL"""
    parts = "string_split(regexp_replace(instruction, '[\"''`]', '', 'g'), ' ')"
    ask = "Does the following text (after ''ASSISTANT:'') "
    o["constraints_processed"] = f"""WITH {INST}, w AS (SELECT data_id, {parts} AS w FROM inst WHERE instruction IS NOT NULL),
c AS (SELECT data_id, list_filter([CASE WHEN w[1] <> '' THEN struct_pack(t := 'keyword_included', e := w[1]) END, CASE WHEN len(w) >= 3 THEN struct_pack(t := 'start_and_ending', e := 'start; ' || array_to_string(w[1:3], ' ')) END, struct_pack(t := 'length', e := 'in two parts'), struct_pack(t := 'choose_output', e := 'A; B or C')], lambda x: x IS NOT NULL) AS c FROM w)
SELECT data_id, array_to_string(list_transform(c, lambda x: x.t || '=' || x.e), ' | ') AS constraints,
  array_to_string(list_transform(c, lambda x, i: i || '. ' || x.t || ': {ask}' || CASE WHEN x.t = 'choose_output' THEN 'contain one of the following phrase: ' || x.e || '?' ELSE 'follow the ' || replace(x.t, '_', ' ') || ' constraint of ' || chr(39) || x.e || chr(39) || '?' END), ' | ') AS questions FROM c"""
    # ---- index and whole specs
    o["index_of_all_cells"] = o["nearest_of_queries"]
    mine = f"{inst_turns}, {has}, {preference('longest')}, mine AS (SELECT pref.*, row_number() OVER (PARTITION BY origin ORDER BY overall_preference DESC NULLS LAST, data_id) AS rk, array_to_string(list_concat(string_split(data_id, '_')[1:2], string_split(data_id, '_')[4:]), '_') AS k FROM pref JOIN texts USING (data_id))"
    first = "ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    o["select_budgeted"] = f"""{mine}, h AS (SELECT * FROM mine WHERE origin = 'harbor_chat_mix' AND setfit_label IN ('Math', 'Coding') QUALIFY row_number() OVER (PARTITION BY setfit_label ORDER BY rk) <= CASE setfit_label WHEN 'Math' THEN 12 ELSE 30 END),
t AS (SELECT data_id, origin FROM mine WHERE origin = 'tidal_reasoning' QUALIFY coalesce(sum(inst_length + resp_length) OVER ({first}), 0) < 1000), m AS (SELECT data_id, origin, rk, count(*) OVER () AS n FROM mine WHERE origin = 'moss_summaries')
(SELECT data_id, origin FROM h ORDER BY rk LIMIT 60) UNION ALL SELECT data_id, origin FROM t UNION ALL SELECT data_id, origin FROM m UNION ALL SELECT data_id, origin FROM m WHERE rk <= floor(n * 0.5)"""
    o["select_languages_once"] = f"""{mine}, a AS (SELECT data_id, origin, k FROM (SELECT * FROM mine WHERE origin = 'harbor_chat_mix' QUALIFY row_number() OVER (PARTITION BY k ORDER BY rk) = 1) ORDER BY rk LIMIT 80),
b AS (SELECT * FROM mine WHERE origin = 'cinder_instruct' AND k NOT IN (SELECT k FROM a) QUALIFY row_number() OVER (PARTITION BY k ORDER BY rk) = 1),
l AS (SELECT * FROM b WHERE setfit_label IN ('Math', 'Coding', 'Generation') QUALIFY row_number() OVER (PARTITION BY setfit_label ORDER BY rk) <= CASE setfit_label WHEN 'Math' THEN 8 WHEN 'Coding' THEN 16 ELSE 24 END)
SELECT data_id, origin FROM a UNION ALL (SELECT data_id, origin FROM l ORDER BY rk LIMIT 80)"""
    quota = "CASE setfit_label " + " ".join(f"WHEN '{c}' THEN {int(p * 100)}" for c, p in PROPORTIONS.items()) + " END"
    with_text = preference("combination_v5").replace("WHERE ana.origin IS NOT NULL", "WHERE ana.origin IS NOT NULL AND data_id IN (SELECT data_id FROM texts)")
    o["select_clustered"] = f"""{inst_turns}, {has}, {with_text}, p AS (SELECT data_id, setfit_label, round(overall_preference, 12) AS x, inst_length % 17 AS cl FROM pref JOIN texts USING (data_id) WHERE inst_length + resp_length <= 4096 AND setfit_label IS NOT NULL),
t AS (SELECT setfit_label, quantile_cont(x, 0.2) AS t FROM p GROUP BY 1), b AS (SELECT data_id, setfit_label, x FROM p QUALIFY row_number() OVER (PARTITION BY setfit_label, cl ORDER BY x DESC NULLS LAST, data_id) = 1), reps AS (SELECT data_id FROM b JOIN t USING (setfit_label) WHERE x > round(t, 12))
SELECT data_id, setfit_label FROM p QUALIFY row_number() OVER (PARTITION BY setfit_label ORDER BY CASE WHEN data_id IN (SELECT data_id FROM reps) THEN 0 ELSE 1 END, x DESC NULLS LAST, {by(42)}) <= {quota}"""
    o["select_from_files"] = f"WITH {INST}, {ANALYSIS} SELECT inst.data_id, 'all' AS origin, output AS answer, last_resp_length FROM inst LEFT JOIN ana USING (data_id) WHERE inst_length + resp_length <= 4096 ORDER BY last_resp_length DESC NULLS LAST, data_id LIMIT 50"
    o["pairs_from_files"] = f"{kto} SELECT data_id, TRUE AS label FROM k UNION ALL SELECT data_id, FALSE FROM k"
    return o
