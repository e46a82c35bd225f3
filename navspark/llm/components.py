"""Connected components of a table of edges by alternating star steps, without collecting any edge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.session import shared_folder


class Scratch:
    """A folder of its own below the shared one, for tables that cut a plan in two.

    A table stays until `drop`, which a caller may use once everything that reads it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, shared_folder(spark)
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(kept)] = kept, path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Deletes a table of `keep` that nothing reads any more."""
        _, path = self.paths.pop(id(kept))
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (the smallest node of it) for every node of the edges (columns u and v)."""
    edges = scratch.keep(edges.where("u <> v").select("u", "v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # Large star: larger neighbours of a node move to the smallest node around it.
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours move to the smallest of them.
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionAll(least.select("u", F.col("m").alias("v")))
        before, edges = edges, scratch.keep(small.where("u <> v").distinct(), "edges")
        scratch.drop(before)
        after = _state(edges)
        if after == state:
            break
        state = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct()
