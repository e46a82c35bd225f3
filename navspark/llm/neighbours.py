"""Rows in one global order without a global sort task: range buckets with their border rows.

Every row goes to the bucket of its key; each bucket also gets a copy of the last row before it and
of the first row after it, so a task sees the neighbours of every row it owns. The borders come from
a bounded sample of the keys, the bucket count from the bytes of text; neither changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.text import ship

#: Bytes of text that a bucket holds on average, as long as there are no more than MOST_BUCKETS; beyond,
#: buckets grow. A task streams its bucket row by row, so a larger one takes longer but no more memory.
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 2048
#: Keys from which the borders are chosen, for each bucket.
KEYS_PER_BUCKET = 64
BUCKET, PLACE, KEY = "__bucket", "__place", "__key"


def in_order(frame: DataFrame, key: Column, text: str, *more: str, around: bool = False) -> DataFrame:
    """`frame` plus bucket, place and key, sorted in each partition by bucket, place, key and `more`.

    Place 0 marks a row of the bucket, -1 and 1 a copy from before and after it; a key isn't null.
    Rows of equal keys share a bucket. With `around`, the first bucket follows the last.
    """
    ship(frame.sparkSession)
    keyed = frame.withColumn(KEY, key)
    size = keyed.agg(F.sum(F.octet_length(F.col(text))).alias("n"), F.count("*").alias("rows")).first()
    buckets = min(MOST_BUCKETS, max(1, -(-(size.n or 0) // BUCKET_BYTES)))
    borders: list = []
    if buckets > 1:
        # About KEYS_PER_BUCKET keys for each bucket, the same in every run.
        chosen = F.pmod(F.xxhash64(KEY), F.lit(max(1, size.rows))) < buckets * KEYS_PER_BUCKET
        sample = keyed.select(KEY).where(chosen).distinct().collect()
        keys = sorted((r[0] for r in sample), key=lambda k: k.encode() if isinstance(k, str) else k)
        step = len(keys) / buckets
        borders = sorted({keys[int(i * step)] for i in range(1, buckets)}) if keys else []
    bucket = F.lit(0)
    if borders:
        listed = F.array(*[F.lit(b) for b in borders])
        bucket = F.size(F.filter(listed, lambda b: b <= F.col(KEY)))
    keyed = keyed.withColumn(BUCKET, bucket)
    ends = keyed.groupBy(BUCKET).agg(F.min(KEY).alias("low"), F.max(KEY).alias("high")).collect()  # a row per bucket
    ends.sort(key=lambda r: r[BUCKET])
    where = [F.struct(F.col(BUCKET).alias(BUCKET), F.lit(0).alias(PLACE))]
    copies = []
    for i, row in enumerate(ends):
        after, before = ends[(i + 1) % len(ends)], ends[i - 1]
        if i + 1 < len(ends) or around:
            copies.append((after["low"], row[BUCKET], 1))
        if i or around:
            copies.append((before["high"], row[BUCKET], -1))
    found = F.array(*where)
    if copies:
        sent = F.array(
            *[F.struct(F.lit(k).alias(KEY), F.lit(b).cast("int").alias(BUCKET), F.lit(p).alias(PLACE)) for k, b, p in copies]
        )
        extra = F.transform(
            F.filter(sent, lambda c: c[KEY] == F.col(KEY)),
            lambda c: F.struct(c[BUCKET].alias(BUCKET), c[PLACE].alias(PLACE)),
        )
        # Only the few keys at the borders are looked up in the list.
        border = F.col(KEY).isin(*sorted({c[0] for c in copies}))
        found = F.when(border, F.concat(found, extra)).otherwise(found)
    spread = keyed.withColumn("__to", F.explode(found)).drop(BUCKET).select("*", "__to.*").drop("__to")
    return spread.repartition(max(1, len(ends)), BUCKET).sortWithinPartitions(BUCKET, PLACE, KEY, *more)
