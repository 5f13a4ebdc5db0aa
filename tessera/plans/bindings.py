"""The driver's tables seen as the engine's records: prompts, candidates, grids, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: id, scenario, user."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), (F.col("conv_id") % 5).alias("scenario"), F.col("text").alias("user"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with a finish reason."""
    return table(spark, sf_dir, "conversations").withColumn("finish_reason", F.when((F.col("conv_id") + F.col("turn")) % 10 == 0, "length").otherwise("stop"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a finish reason, and their place in the pair grid."""
    d = table(spark, sf_dir, "documents")
    return d.withColumns({"finish_reason": F.when(F.col("doc_id") % 10 == 0, "length").otherwise("stop"), "pair": F.floor(F.col("doc_id") / 2), "side": F.col("doc_id") % 2})


def drawn(name: str, key: Column, below: int) -> Column:
    """A number from 0 that stands for a reviewer's: the first four hex digits of md5 of name and key, modulo ``below``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(name + ":"), key.cast("string"))), 1, 4), 16, 10).cast("long") % below


def drawn_sql(name: str, key: str, below: int) -> str:
    return f"(('0x' || substr(md5('{name}:' || ({key})), 1, 4))::BIGINT % {below})"
