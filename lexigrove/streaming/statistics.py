"""Incremental document frequencies: increments arrive, sums stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def increments(docs: DataFrame) -> DataFrame:
    """(value, df) of a batch of documents; a column ``sign`` of -1 withdraws them."""
    sign = F.col("sign") if "sign" in docs.columns else F.lit(1)
    return docs.select(F.explode(F.array_distinct(T.lower_words(F.col("text")))).alias("value"), sign.alias("sign")).groupBy("value").agg(F.sum("sign").cast("long").alias("df"))


def merge_stream(docs: DataFrame, spark: SparkSession, path: str, checkpoint: str):
    """A streaming query that folds documents into the statistics table at ``path``.

    Every batch writes its increments under its own number, so a repeated batch overwrites
    what it wrote; ``totals`` sums them."""

    def write(batch: DataFrame, number: int) -> None:
        increments(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("value").agg(F.sum("df").alias("df")).filter("df <> 0")
