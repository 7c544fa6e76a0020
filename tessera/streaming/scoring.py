"""The stateless part of scoring over a stream: exchanges, token lengths and rule checks of arriving samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators.reshape import canonical_conversations, exchange_array

SCHEMA = "data_id string, messages array<struct<role:string,content:string>>, origin string, language string, ingested_at timestamp"


def read_stream(spark: SparkSession, path: str, schema: str = SCHEMA, max_files: int = 64) -> DataFrame:
    """Samples as their files arrive, at most ``max_files`` in one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def scored_samples(samples: DataFrame) -> DataFrame:
    """One row a sample with its exchanges and token lengths; no state, so no watermark is needed."""
    e = exchange_array(F.col("messages"))
    total = lambda field: F.aggregate(F.transform(e, lambda x: word_count(x[field])), F.lit(0), lambda a, n: a + n)
    df = canonical_conversations(samples.where("data_id is not null"))
    return df.select("data_id", "origin", "ingested_at", F.size(e).alias("n_exchanges"), total("instruction").alias("inst_length"), total("response").alias("resp_length"))


def deduplicated(samples: DataFrame, delay: str = "60 days") -> DataFrame:
    """Deliveries of an id within the delay once; state older than that is dropped."""
    return samples.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["data_id"])


def write_stream(df: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """Appends to Parquet, each batch once, and ends when there is nothing left."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
