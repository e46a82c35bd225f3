"""Price-triggered valuation of a stream: each micro-batch is a piece of the replayed log.

Holdings, orders and instruments are latest-value tables below a shared folder. The ticks of a
micro-batch meet the rows known at each tick, out of the tables as they were before the batch and
the batch's own messages, with the plan of the batch replay; then the messages go into the tables.
There is no row-wise code and no state held in a task: how an instrument is spread over tasks
follows from its counts.

Known means arrived: rows are ordered by the time of their record and the offset, whatever time
their text gives, so the result does not depend on where micro-batches are cut. A position without
a quantity replaces the one before it and is valued as nothing. A micro-batch that is run again
replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from navspark.operators.latest import STATE_KEYS
from navspark.operators.replay import replay
from navspark.schemas import LIVE_HOURS
from navspark.sources.decode import ARRIVED_AT, read_dataset
from navspark.streaming.tables import BUCKETS, LatestTable, PlacedTable, listen, packed, remove

STATE = ("holding", "order", "instrument")


def at_once(step: Callable[[str], Any], names: Sequence[str]) -> dict[str, Any]:
    """Independent Spark jobs of a few datasets side by side."""
    with ThreadPoolExecutor(len(names)) as pool:
        return dict(zip(names, pool.map(step, names), strict=True))


class Revaluation:
    """Tables, valued rows and progress of one stream, below ``folder``.

    The tables lie in buckets by instrument, all the same ones, so a micro-batch reads the buckets
    of the instruments that ticked in it and adds to those that its positions are in; its cost
    follows its size and not that of the state. Its messages are parsed once, into files.

    With ``expire`` a row of a table counts only until its time-to-live has passed, measured from
    the newest record of the micro-batch, and leaves the table when its bucket is folded.
    """

    def __init__(
        self,
        folder: str,
        mode: str = "raw",
        expire: bool = False,
        fold_every: int = 20,
        buckets: int = BUCKETS,
    ):
        self.folder = folder
        self.mode = mode
        self.expire = expire

        def kept(name: str, table: type, *keys: object, **options: object):
            lives = (ARRIVED_AT, LIVE_HOURS[name]) if expire else None
            return table(
                f"{folder}/state/{name}", *keys, [ARRIVED_AT, "sequence"], fold_every,
                buckets=buckets, lives=lives, **options,
            )

        place = ["instrumentId"]
        self.tables = {
            "holding": kept("holding", LatestTable, STATE_KEYS["holding"], place=place),
            "order": kept("order", PlacedTable, "orderId", "instrumentId"),
            "instrument": kept("instrument", LatestTable, STATE_KEYS["instrument"], place=place),
        }

    def _parsed(self, batch: DataFrame, batch_id: int) -> dict[str, DataFrame]:
        """The good records of each dataset, parsed once for all that follows."""
        spark = batch.sparkSession

        def parsed(name: str) -> DataFrame:
            path = f"{self.folder}/news/batch={batch_id}/{name}"
            packed(read_dataset(batch, name, arrival=True).write).mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        return at_once(parsed, (*STATE, "price"))

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: value the ticks of a micro-batch of topic records."""
        news = self._parsed(batch, batch_id)
        newest = None
        if self.expire:
            newest = F.lit(batch.agg(F.max("timestamp").cast("timestamp_ntz")).first()[0])
        prices = news["price"]
        buckets = self.tables["instrument"].buckets_of(prices)
        if buckets or batch_id == 0:
            ticked = prices.select("instrumentId").distinct()
            known = []
            for name in STATE:
                rows = news[name]
                if batch_id:
                    before = self.tables[name].before(rows, batch_id, buckets, newest)
                    before = before.join(ticked, "instrumentId", "left_semi")
                    rows = before.unionByName(rows)
                known.append(rows)
            valued = replay(*known, prices, self.mode, arrival=ARRIVED_AT)
            (
                packed(valued.withColumn("batch", F.lit(batch_id).cast("bigint")).write)
                .partitionBy("batch")
                .mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .parquet(f"{self.folder}/valued")
            )
        at_once(lambda name: self.tables[name].upsert(news[name], batch_id, newest), STATE)
        # A batch that is run again parses its messages again.
        remove(batch.sparkSession, f"{self.folder}/news/batch={batch_id}")

    def start(self, log: DataFrame, every: str | None = None) -> StreamingQuery:
        """Run on a stream of topic records; without ``every`` to the end of what is there."""
        return listen(log, self.advance, f"{self.folder}/checkpoint", "append", every)

    def valued(self, spark: SparkSession) -> DataFrame:
        """All valued rows so far, one per tick and live position."""
        return spark.read.option("basePath", f"{self.folder}/valued").parquet(f"{self.folder}/valued").drop("batch")
