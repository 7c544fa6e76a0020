"""Reshaping of samples: canonical conversation form, exchanges, prompt texts, preference pairs, templates.

A sample is ``data_id, messages array<struct<role,content>>`` plus any other columns, which every operator
here passes on.
"""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import join_at_ingest, strip

MESSAGES = "array<struct<role:string,content:string>>"


def rename(df: DataFrame, **old: str | None) -> DataFrame:
    """Canonical column names from others: ``rename(df, instruction="problem", output="solution")``."""
    return df.withColumnsRenamed({v: k for k, v in old.items() if v and v != k})


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def to_chat(df: DataFrame, instruction: str = "instruction", output: str = "output") -> DataFrame:
    """One user and one assistant turn instead of the two columns."""
    return df.withColumn("messages", F.array(message("user", F.col(instruction)), message("assistant", F.col(output)))).drop(instruction, output)


def ingest_instructions(df: DataFrame, instruction: str = "instruction", input_: str | None = "input") -> DataFrame:
    """The instruction with its input below it, stripped; the input column goes."""
    if not input_ or input_ not in df.columns:
        return df.withColumn(instruction, strip(F.col(instruction)))
    return df.withColumn(instruction, join_at_ingest(F.col(instruction), F.col(input_))).drop(input_)


def to_chat_for_selection(df: DataFrame, multi_turn: bool | None = False) -> DataFrame:
    """Chat form when a source isn't marked as having several turns; instruction and input parted by an empty line."""
    if multi_turn or "messages" in df.columns:
        return df
    text = F.concat(F.coalesce("instruction", F.lit("")), F.lit("\n\n"), F.coalesce("input", F.lit(""))) if "input" in df.columns else F.col("instruction")
    out = df.withColumn("messages", F.array(message("user", text), message("assistant", F.col("output"))))
    return out.drop("instruction", "output", "input")


def normal_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("human"), F.lit("user")), F.lit("gpt"), F.lit("assistant"))


def normalise_messages(c: Column, role: str = "role", content: str = "content") -> Column:
    """Turns with canonical keys and roles; other fields of a turn go."""
    return F.transform(c, lambda m: message(normal_role(m[role]), m[content]))


def canonical_conversations(df: DataFrame, messages: str = "messages", role: str = "role", content: str = "content") -> DataFrame:
    """``messages`` in canonical form, whatever their column and keys were called."""
    out = df.withColumn("messages", normalise_messages(F.col(messages), role, content))
    return out if messages == "messages" else out.drop(messages)


def latest(df: DataFrame, ts: str = "ingested_at", key: str = "data_id") -> DataFrame:
    """The newest row of each id, by an aggregate that is partial before its shuffle; null ids are left out,
    equal times are settled by the hash of the row."""
    cols = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    order = F.struct(F.col(ts), F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    got = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, order).alias("_row"))
    return got.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in cols]).select(*df.columns)


#: Steps of a plan that leave the rows of a scan where they were read.
BY_ROW = ("Project", "Filter", "Generate", "SubqueryAlias")


def _of_files(df: DataFrame) -> DataFrame | None:
    """``df`` with the file ``_f`` of each row and the start ``_s`` of its block, if it is one scan taken row by row."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in BY_ROW:
        plan = plan.child()
    if plan.nodeName() != "LogicalRelation":
        return None
    try:
        of = df.metadataColumn("_metadata")
        return df.select("*", of["file_path"].alias("_f"), of["file_block_start"].alias("_s"))
    except AnalysisException:  # a relation without files
        return None


def _natural(path: str) -> tuple[list, str]:
    """Names in order, the numbers in them as numbers: files are written with growing ones."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split("([0-9]+)", path))], path


def numbered(df: DataFrame, out: str) -> DataFrame:
    """``out``: the place of each row from 0, in the order that the rows have. No row leaves the engine.

    Rows of files are in the order of these by name and of the lines in them. A scan deals the blocks of files out
    by their size, so that its partitions are in no order: one row a block is collected. A block that another cut of
    the files makes later fails. Other rows are in the order of their partitions, of which one row each is collected;
    rows that were sorted must be persisted, since a sort that runs again may cut them differently.
    """
    m = F.monotonically_increasing_id()
    part = F.shiftrightunsigned("_m", 33)
    if (rows := _of_files(df)) is not None:
        rows = rows.withColumn("_m", m).withColumn("_q", part)
        blocks = rows.groupBy("_f", "_s", "_q").agg(F.min("_m").alias("first"), F.max("_m").alias("last"), F.count(F.lit(1)).alias("n")).collect()
        before, at = 0, []
        for r in sorted(blocks, key=lambda r: (_natural(r["_f"]), r["_s"])):
            if r["last"] - r["first"] + 1 != r["n"]:
                raise ValueError(f"{r['_f']} is read twice: its rows have no order")
            at.append((r["_f"], r["_s"], r["_q"], before - r["first"]))
            before += r["n"]
        known = df.sparkSession.createDataFrame(at, "_f string, _s bigint, _q bigint, _b bigint")
        offset = F.coalesce("_b", F.raise_error(F.lit("files are cut in other blocks than when they were counted; set spark.sql.files.minPartitionNum")).cast("bigint"))
        return rows.join(F.broadcast(known), ["_f", "_s", "_q"], "left").withColumn(out, offset + F.col("_m")).drop("_f", "_s", "_q", "_b", "_m")
    rows = df.withColumn("_m", m)
    sizes = {r["_q"]: r["count"] for r in rows.groupBy(part.alias("_q")).count().collect()}
    before, at = 0, []
    for q in range(max(sizes, default=-1) + 1):
        at.append(before)
        before += sizes.get(q, 0)
    offset = F.element_at(F.lit(at or [0]).cast("array<bigint>"), (part + 1).cast("int"))
    return rows.withColumn(out, offset + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")


def assign_ids(df: DataFrame, dataset: str, order: list[str] | None = None, version: str = "1", language: str = "en") -> DataFrame:
    """``{dataset}_v{version}_{language}_{i}``; an id that is there already stays.

    ``i`` is the row's position: in the order of the columns ``order`` (total: ties are broken by the hash of
    the row), else in the order of the input files. Positions come from partition sizes, not from one sorted
    task.
    """
    src = df.orderBy(*order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])) if order else df
    rows = numbered(src.persist(StorageLevel.MEMORY_AND_DISK) if order else src, "_i")
    made = F.concat(F.lit(f"{dataset.replace('_', '-')}_v{version}_{language}_"), F.col("_i").cast("string"))
    have = F.col("data_id") if "data_id" in df.columns else F.lit(None)
    return rows.withColumn("data_id", F.coalesce(have, made)).drop("_i")


def canonical(df: DataFrame) -> DataFrame:
    return df.select("messages", "data_id")


def with_defaults(df: DataFrame, origin: str, language: str | None = None) -> DataFrame:
    """``origin`` and, if given, ``language`` in lower case, only where the column or value is missing."""
    for name, value in (("origin", origin), ("language", language.lower() if language else None)):
        if value is not None:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df


def id_without_language(data_id: Column) -> Column:
    """The id without its third part; null stays null."""
    parts = F.split(data_id, "_")
    return F.when(data_id.isNotNull(), F.concat_ws("_", F.concat(F.slice(parts, F.lit(1), F.lit(2)), F.slice(parts, F.lit(4), F.greatest(F.size(parts), F.lit(1))))))


def exchange_array(messages: Column) -> Column:
    """Exchanges of a conversation as ``array<struct<turn_idx,instruction,response>>``.

    From the first user turn every second turn is looked at: if it is a user's it makes an exchange, with the
    next turn as response if that is an assistant's, else with an empty one. Conversations of fewer than two
    turns or without a user turn have none. Null contents count as empty.
    """
    start = F.array_position(F.transform(messages, lambda m: m["role"]), "user") - 1
    idx = F.sequence(F.lit(0), F.greatest(F.size(messages) - 1, F.lit(0)))
    text = lambda i: F.coalesce(F.get(messages, i)["content"], F.lit(""))
    hits = F.filter(idx, lambda i: (i >= start) & ((i - start) % 2 == 0) & (F.get(messages, i)["role"] == "user"))
    made = F.transform(hits, lambda i: F.struct(i.alias("turn_idx"), text(i).alias("instruction"), F.when(F.get(messages, i + 1)["role"] == "assistant", text(i + 1)).otherwise("").alias("response")))
    none = F.array().cast("array<struct<turn_idx:int,instruction:string,response:string>>")
    return F.when((F.size(messages) >= 2) & (start >= 0), made).otherwise(none)


def exchanges(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each exchange: ``data_id, *keep, exchange_idx, instruction, response``."""
    e = df.select("data_id", *keep, F.posexplode(exchange_array(F.col("messages"))).alias("exchange_idx", "_e"))
    return e.select("data_id", *keep, "exchange_idx", F.col("_e.instruction").alias("instruction"), F.col("_e.response").alias("response"))


def exchange_count(messages: Column) -> Column:
    return F.size(exchange_array(messages))


def first_answer(messages: Column) -> Column:
    """Content of the first assistant turn, null without one: the text by which samples are compared."""
    return F.get(F.filter(messages, lambda m: m["role"] == "assistant"), 0)["content"]


def preference_prompt(df: DataFrame, kind: str) -> Column:
    """``kto``: the first prompt turn; ``dpo``: all user turns of the chosen conversation; stripped."""
    if kind == "kto":
        return strip(F.get(F.col("prompt"), 0)["content"])
    users = F.filter(F.col("chosen"), lambda m: m["role"] == "user")
    return strip(F.array_join(F.transform(users, lambda m: F.coalesce(m["content"], F.lit(""))), " "))


def drop_empty_system(messages: Column) -> Column:
    first = F.get(messages, 0)
    empty = (first["role"] == "system") & (first["content"] == "")
    return F.when(empty, F.slice(messages, F.lit(2), F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)


def pack_pairs(df: DataFrame, position: str = "position") -> DataFrame:
    """Rows 2i and 2i + 1 as one row with ``negative_example``; fails unless they are a true and a false one."""
    cols = [c for c in df.columns if c != position]
    row = F.struct(*cols)
    pair = df.withColumn("_p", F.floor(F.col(position) / 2).cast("bigint")).withColumn("_o", F.col(position) % 2)
    got = pair.groupBy("_p").agg(F.max_by(row, F.when(F.col("_o") == 0, 1)).alias("a"), F.max_by(row, F.when(F.col("_o") == 1, 1)).alias("b"), F.count(F.lit(1)).alias("n"))
    good = (F.col("n") == 2) & F.col("a.label") & ~F.col("b.label")
    got = got.select("_p", F.when(F.coalesce(good, F.lit(False)), F.col("a")).otherwise(F.raise_error(F.lit("a positive and a negative example must alternate"))).alias("a"), "b")
    return got.select((F.col("_p") * 2).alias(position), *[F.col(f"a.{c}").alias(c) for c in cols], F.col("b").alias("negative_example"))


def unpack_pairs(df: DataFrame, position: str = "position") -> DataFrame:
    """Rows 2i and 2i + 1 again; columns that a pair got since it was packed are those of both."""
    cols = [c for c in df.columns if c not in (position, "negative_example")]
    own = set(df.schema["negative_example"].dataType.names)
    both = F.array(F.struct(F.lit(0).alias("_o"), F.struct(*cols).alias("_r")), F.struct(F.lit(1).alias("_o"), F.struct(*[(F.col(f"negative_example.{c}") if c in own else F.col(c)).alias(c) for c in cols]).alias("_r")))
    got = df.select(position, F.inline(both))
    return got.select((F.col(position) + F.col("_o")).alias(position), *[F.col(f"_r.{c}").alias(c) for c in cols])


def prompt_completion(df: DataFrame, messages: str = "messages") -> DataFrame:
    """All turns but the last as ``prompt``, the last as ``completion``."""
    m, n = F.col(messages), F.size(F.col(messages))
    got = df.withColumn("prompt", F.slice(m, F.lit(1), F.greatest(n - 1, F.lit(0)))).withColumn("completion", F.slice(m, F.greatest(n, F.lit(1)), F.lit(1)))
    return got.drop(messages)


def chatml(messages: Column, generation_prompt: bool = False) -> Column:
    """Each turn between its markers, roles as they are."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n" if generation_prompt else ""))


def instruct_template(messages: Column, bos: str = "<s>", eos: str = "</s>") -> Column:
    """Bracketed instructions; fails unless user and assistant turns alternate, after a leading system turn,
    which goes into the first instruction."""
    system = F.get(messages, 0)["role"] == "system"
    said = F.when(system, F.concat(F.lit("<<SYS>>\n"), F.get(messages, 0)["content"], F.lit("\n<</SYS>>\n\n"))).otherwise("")
    rest = F.when(system, F.slice(messages, F.lit(2), F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)
    good = F.forall(F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)

    def one(m: Column, i: Column) -> Column:
        text = strip(F.concat(F.when(i == 0, said).otherwise(""), F.coalesce(m["content"], F.lit(""))))
        return F.when(i % 2 == 0, F.concat(F.lit(f"{bos}[INST] "), text, F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), text, F.lit(f" {eos}")))

    return F.when(good, F.array_join(F.transform(rest, one), "")).otherwise(F.raise_error(F.lit("user and assistant turns must alternate")))


def alternates(messages: Column) -> Column:
    """Whether :func:`instruct_template` takes a conversation."""
    system = F.get(messages, 0)["role"] == "system"
    rest = F.when(system, F.slice(messages, F.lit(2), F.greatest(F.size(messages), F.lit(1)))).otherwise(messages)
    return F.forall(F.transform(rest, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: x)
