"""Labelled rows for training: a bounded sample of the rows that aren't held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.text import documents, held_out, ship


def training_rows(spark: SparkSession, folder: str, label: str, rows: int) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents outside the held-out fifth.

    The sample is the rows with the smallest hash of the key, so it is the same in every run. It is
    bounded by `rows`, which makes it safe to broadcast. Rows without a 0/1 label are left out; a
    document labelled twice counts once, with its larger label.
    """
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).cast("int").alias("label"))
    ship(spark)
    chosen = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return (
        documents(spark, folder)
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
    )
