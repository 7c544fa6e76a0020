"""Mixing sources so that each contributes a target share of the total size.

Tokens are summed per source, each source gets a repetition rate (wanted over available, at most its cap), and
each record is emitted floor(rate) times plus once more if a hash of its id, seeded, falls under the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import norm_source


def source_tokens(records: DataFrame, source: str, size: Column) -> DataFrame:
    """``source, records, tokens``; sources are compared without regard to case, blanks around and ``-``/``_``.

    Null sizes count as 0, null sources form no source. Summed before the shuffle, so a source with most of
    the rows is no more work for one task than any other.
    """
    return records.where(F.col(source).isNotNull()).groupBy(norm_source(F.col(source)).alias("source")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.coalesce(size, F.lit(0)).cast("bigint")).alias("tokens"))


def rates(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each distinct row of ``specs`` (``spec_name, name, token_size, oversampling``).

    Adds ``source``, ``tokens`` available (0 for unknown sources), ``cap`` (null means 1, negative 0), ``rate``,
    ``target_share`` of the spec and ``expected_share`` of what the rates will give. No target (null) means
    no records. A cap with a fraction is an average: with 1.5 half of the records may be used twice.
    """
    s = specs.select("spec_name", "name", "token_size", "oversampling").distinct().withColumn("source", norm_source(F.col("name")))
    got = s.join(sources.select("source", F.col("tokens").alias("_t")), "source", "left").withColumn("tokens", F.coalesce("_t", F.lit(0)).cast("bigint")).drop("_t")
    got = got.withColumn("cap", F.greatest(F.coalesce("oversampling", F.lit(1.0)), F.lit(0.0))).withColumn("wanted", F.greatest(F.coalesce("token_size", F.lit(0)), F.lit(0)).cast("double"))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("cap"), F.col("wanted") / F.col("tokens"))).otherwise(F.lit(0.0))
    got = got.withColumn("rate", rate)
    w = Window.partitionBy("spec_name")  # specs and sources: a small table
    got = got.withColumn("_w", F.sum("wanted").over(w)).withColumn("_r", F.sum(F.col("rate") * F.col("tokens")).over(w))
    share = lambda x, of: F.when(F.col(of) > 0, x / F.col(of)).otherwise(F.lit(0.0))
    got = got.withColumn("target_share", share(F.col("wanted"), "_w")).withColumn("expected_share", share(F.col("rate") * F.col("tokens"), "_r"))
    return got.drop("_w", "_r")


def mix(records: DataFrame, rated: DataFrame, id_col: str, source: str, size: Column, seed: int = 17) -> DataFrame:
    """``spec_name, name, id, size, copies`` of each record that is used at least once; no row is repeated.

    The random part depends on seed, spec, name, size wanted and id only: the same for any partitioning and engine.
    Two rows of one spec draw independently, also where they name the same source. :func:`repeated` writes the copies out.
    """
    r = records.where(F.col(source).isNotNull()).select(F.col(id_col).alias("id"), norm_source(F.col(source)).alias("source"), F.coalesce(size, F.lit(0)).cast("bigint").alias("size"))
    got = r.join(rated.where("rate > 0").select("spec_name", "name", "source", "rate", "token_size"), "source")
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), "spec_name", "name", F.col("token_size").cast("string"), F.col("id").cast("string")))
    u = F.conv(F.substring(drawn, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    whole = F.floor("rate")
    got = got.withColumn("copies", (whole + F.when(u < F.col("rate") - whole, 1).otherwise(0)).cast("int"))
    return got.where("copies > 0").select("spec_name", "name", "id", "size", "copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each copy, with its number ``copy`` from 1."""
    return mixed.select("spec_name", "name", "id", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def shares(copies: DataFrame, rated: DataFrame) -> DataFrame:
    """``spec_name, name, wanted, target_share, rate, used_records, used_tokens, actual_share`` of each source, counted
    from the copies that were written (:func:`repeated`)."""
    used = copies.groupBy("spec_name", "name").agg(F.sum((F.col("copy") == 1).cast("bigint")).alias("used_records"), F.sum("size").alias("used_tokens"))
    total = used.groupBy("spec_name").agg(F.sum("used_tokens").alias("_t"))
    got = rated.select("spec_name", "name", "wanted", "target_share", "rate").join(used, ["spec_name", "name"], "left").join(total, "spec_name", "left")
    got = got.withColumn("used_records", F.coalesce("used_records", F.lit(0))).withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    return got.withColumn("actual_share", F.when(F.col("_t") > 0, F.col("used_tokens") / F.col("_t")).otherwise(F.lit(0.0))).drop("_t")


def short_sources(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """``spec_name, name`` of distinct rows that want more than their source has, used as often as it may."""
    return rates(specs, sources).where(F.col("token_size") > F.col("tokens") * F.col("cap")).select("spec_name", "name").distinct()
