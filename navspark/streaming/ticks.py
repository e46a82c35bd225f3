"""The price tick series as a table by day, appended by a stream and read by day."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from navspark.operators.latest import daily_close
from navspark.streaming.tables import listen


#: The folder that readers find while no tick has come.
NO_DAY = "1970-01-01"


class TickTable:
    """Ticks as Parquet below a shared folder, a folder for each day of the price.

    A micro-batch adds files to the days it has ticks of, late ones included; run again it replaces
    them. Reading some days opens their folders only. A busy day is as many files as its ticks need.
    """

    def __init__(self, path: str):
        self.path = path

    def append(self, ticks: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        if batch_id == 0:
            ticks.limit(0).write.mode("overwrite").parquet(f"{self.path}/day={NO_DAY}/batch=-1")
        (
            ticks.withColumn("day", F.to_date("date"))
            .hint("rebalance", "day")
            .withColumn("batch", F.lit(batch_id).cast("bigint"))
            .write.partitionBy("day", "batch")
            .mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .parquet(self.path)
        )

    def start(self, ticks: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        return listen(ticks, self.append, checkpoint, "append", every)

    def ticks(self, spark: SparkSession, days: Sequence[date] | None = None) -> DataFrame:
        """All ticks, or those of some days, with ``day``; only folders of these days are listed."""
        path = self.path
        if days is not None:
            path += "/day={" + ",".join([NO_DAY, *(str(day) for day in days)]) + "}"
        rows = spark.read.option("basePath", self.path).parquet(path)
        return rows.filter("batch >= 0").drop("batch")

    def closes(self, spark: SparkSession, days: Sequence[date] | None = None) -> DataFrame:
        """Last tick of each instrument and day."""
        return daily_close(self.ticks(spark, days).drop("day"))
