"""Text and row conventions that the operators of this subpackage share.

* A sample is one ``data_id``; of several rows only the latest counts, rows with a null id never do.
* Words are maximal runs of letters or digits in lower case.
* The tokens of a text are its words made distinct: the second ``the`` is another token than the first.
  So the overlap of two multisets of words is the intersection of two sets of tokens.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
USER_ROLES = ("user", "human")
ANSWER_ROLES = ("assistant", "gpt")
#: Distinct words whose hash a worker keeps, so that its memory doesn't follow the corpus.
KEPT_HASHES = 200_000
STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

TOKENS_TYPE = "struct<n:int,a:bigint,b:bigint,toks:array<bigint>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def norm_label(c: Column) -> Column:
    """Label without regard to case, surrounding blanks and what parts its words (blanks, ``_`` or ``-``)."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\s _-]+", " "))


def norm_source(c: Column) -> Column:
    """Source name without regard to case and surrounding blanks, ``-`` read as ``_``."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), "-", "_")


def latest(df: DataFrame, ts: str, *cols: str) -> DataFrame:
    """The latest row of each ``data_id``, of the columns named.

    Rows with a null id are left out; a null timestamp is older than any other. Of rows with the same
    timestamp the one with the largest hash of its columns is taken, so the result doesn't depend on the
    order of rows. The aggregate is partial before the shuffle: repeated deliveries of one id never meet
    in one task as rows.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    order = F.struct(F.col(f"`{ts}`"), F.xxhash64(*[F.col(f"`{c}`") for c in cols]))
    got = df.where(F.col("data_id").isNotNull()).groupBy("data_id").agg(F.max_by(row, order).alias("_row"))
    return got.select("data_id", *[F.col(f"_row.`{c}`").alias(c) for c in cols])


def prompt_of(messages: str = "messages") -> Column:
    """Content of all user turns in order, joined by one space; null and absent turns count as nothing."""
    users = F.filter(F.col(messages), lambda m: m["role"].isin(*USER_ROLES))
    return F.array_join(F.transform(users, lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("data_id", prompt_of().alias("text"), "ingested_at")
    return latest(c, "ingested_at", "text")


def all_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("data_id", prompt_of().alias("text"), "ingested_at")
    i = table(spark, sf_dir, "instructions").select("data_id", F.col("instruction").alias("text"), "ingested_at")
    return latest(c.unionByName(i), "ingested_at", "text")


class Hasher:
    """64-bit hashes of words; the second occurrence of a word in a text gets another one."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def tokens(self, text: str | None) -> list[int]:
        kept, out, seen = self.kept, [], {}
        for w in WORD.findall(text.lower()) if text else ():
            h = kept.get(w)
            if h is None:
                if len(kept) >= KEPT_HASHES:
                    kept.clear()
                h = kept[w] = xxhash.xxh3_64_intdigest(w)
            k = seen.get(h, 0)
            seen[h] = k + 1
            out.append((h + k * STEP) & MASK if k else h)
        return out


_hasher = Hasher()


def token_struct(texts: pa.Array) -> pa.Array:
    """Number of tokens, two hashes of the set of tokens that don't depend on order, and the tokens sorted."""
    n, a, b, flat, ends = [], [], [], [], [0]
    for t in texts.to_pylist():
        toks = np.array(_hasher.tokens(t), dtype=np.uint64)
        toks.sort()
        mixed = (toks ^ (toks >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        n.append(len(toks))
        a.append(mixed.sum(dtype=np.uint64))
        b.append(((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64))
        flat.append(toks)
        ends.append(ends[-1] + len(toks))
    values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))
    as_long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), as_long(a), as_long(b), lists], ["n", "a", "b", "toks"])


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``n``, ``a``, ``b`` and ``toks`` (see :func:`token_struct`)."""
    f = F.arrow_udf(token_struct, TOKENS_TYPE)
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, f(F.col(text)).alias("_t")).select(*rest, "_t.*")


#: Buckets in which the frequency of tokens is kept: the table has this size however large the corpus is.
BUCKET_BITS = 18


def bucket_counts(tokens: DataFrame) -> np.ndarray:
    """How many tokens of the whole corpus fall in each of 2^BUCKET_BITS buckets of token hashes.

    A summary of fixed size (1 MB): rare tokens get the small count of a bucket of rare tokens, frequent
    ones never less than their own frequency. Counted before the shuffle in each partition.
    """
    size = 1 << BUCKET_BITS
    b = tokens.select(F.explode("toks").alias("t")).select(F.col("t").bitwiseAND(F.lit(size - 1)).cast("int").alias("bucket"))
    got = b.groupBy("bucket").count().select("bucket", F.col("count").cast("long")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got["bucket"].to_numpy()] = got["count"].to_numpy()
    return out


def durable(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the shared checkpoint folder; a folder of its own only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()
