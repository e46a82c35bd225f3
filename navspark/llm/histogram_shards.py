"""Sharding by histogram sort: shards of nearly equal bytes that are ranges of one global order.

Rows are ordered by three 64-bit values: a hash of the text, a hash of the key, and a number of the row.
The first is uniform but for copies, the second parts the copies of one text, the third rows that are
equal in both; so a border can be put before any row, and equal texts stand side by side.

The keys, sizes and checksums are written once, without the texts. Then borders are found by counting:
each round sends candidate keys (probes) to all tasks, every task adds the bytes and rows it has between
neighbouring probes, and the sums, one row per probe, come back to the driver, with the least and the largest
key of each gap. The driver narrows each border to the gap around it and spreads new probes in there. A border is settled when some
probe is within the tolerance of its aim, or at the nearest row edge. Probes lie on edges of texts first,
then of keys, then of rows: copies of a text stay in one shard unless no edge of theirs is near enough.

Shards may be cut into ranges, all found in the same rounds, so that no task sorts more than a
bounded number of bytes of documents. Counting also gives the rows before each border, so after one exchange by range a
row's slot is the rows of its shard before the range plus its place in the range.

Null and empty texts have the size of an empty text. Rows that are there twice are both kept. Ties can't
occur. A document larger than a shard's share leaves neighbouring shards smaller or empty. An empty
table gives no rows. Extra columns are left out by `assigned` and kept by `write`.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navspark.llm.components import Scratch
from navspark.llm.text import ship

SHARDS = 40
#: Bytes that count for a row besides its text.
ROW_BYTES = 16
#: Share of the mean shard by which a border may miss its aim, unless one row is more.
TOLERANCE = 0.01
#: Share of a range by which a border inside a shard may miss.
INNER_TOLERANCE = 0.25
#: Bytes of documents in a range; a task sorts the keys of one range.
RANGE_BYTES = 256 << 20
#: Probes per border that isn't settled, in a round; the first round has FIRST for each border.
PROBES, FIRST = 16, 4

_LEVELS, _BITS = 3, 64
_WHOLE = 1 << (_LEVELS * _BITS)
_KEYS = ("__text", "__row", "__copy")
_LEAST, _MOST = ("a0", "a1", "a2"), ("b0", "b1", "b2")


def keyed(frame: DataFrame, key: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Sizes, checksums and sort keys; the frame's own columns only if they are to be kept."""
    doc, whole = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    added = {
        "size": F.octet_length(whole).cast("long") + ROW_BYTES, "text_crc32": F.crc32(whole.cast("binary")),
        _KEYS[0]: F.xxhash64(whole), _KEYS[1]: F.xxhash64(doc), _KEYS[2]: F.xxhash64(F.monotonically_increasing_id()),
    }
    if keep:
        row = F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("row")
        return frame.select(row, *[c.alias(n) for n, c in added.items()])
    return frame.select(doc.alias("doc_id"), *[c.alias(n) for n, c in added.items()])


def _parts(probes: list[int]) -> np.ndarray:
    """Probes as rows of three unsigned values."""
    out = np.empty((len(probes), _LEVELS), np.uint64)
    for i, p in enumerate(probes):
        for k in range(_LEVELS):
            out[i, k] = (p >> ((_LEVELS - 1 - k) * _BITS)) & ((1 << _BITS) - 1)
    return out


def passed(columns: list[np.ndarray], probes: np.ndarray) -> np.ndarray:
    """For each row the number of probes at or before its key. probes: ascending, one row each."""
    first = probes[:, 0]
    out = np.searchsorted(first, columns[0], "left")
    right = np.searchsorted(first, columns[0], "right")
    if probes.shape[1] == 1:
        return right
    open_ = np.flatnonzero(out < right)
    values, back = np.unique(columns[0][open_], return_inverse=True)
    order = np.argsort(back, kind="stable")
    bounds = np.searchsorted(back[order], np.arange(len(values) + 1))
    for k in range(len(values)):
        own = open_[order[bounds[k] : bounds[k + 1]]]
        a, b = out[own[0]], right[own[0]]
        out[own] = a + passed([c[own] for c in columns[1:]], probes[a:b, 1:])
    return out


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sort keys as unsigned values of the same order."""
    flip = np.uint64(1 << 63)
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).view(np.uint64) ^ flip for c in _KEYS]


def _number(key) -> int:
    """The key as one integer."""
    out = 0
    for part in key:
        out = (out << _BITS) | (int(part) + (1 << (_BITS - 1)))
    return out


@dataclass(frozen=True, order=True)
class Edge:
    """A key, the exact bytes and rows before it, and the least and largest key of the rows up to the next edge."""

    key: int
    bytes: int
    rows: int
    least: int
    most: int


def counted(rows: DataFrame, probes: list[int]) -> list[Edge]:
    """An edge for each probe; a row per task and gap between probes reaches the sum."""
    shared = rows.sparkSession.sparkContext.broadcast(_parts(probes))
    names = ["gap", "size", "n", *_LEAST, *_MOST]

    def count(batches):
        borders = shared.value
        for batch in batches:
            if batch.num_rows:
                keys = _columns(batch)
                gap = passed(keys, borders)
                order = np.lexsort((*keys[::-1], gap))
                gap = gap[order]
                opens = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
                ends = np.append(opens[1:], len(gap))
                size = np.add.reduceat(batch.column(batch.schema.get_field_index("size")).to_numpy()[order], opens)
                ranges = [batch.column(batch.schema.get_field_index(c)).take(pa.array(order[at])) for at in (opens, ends - 1) for c in _KEYS]
                yield pa.RecordBatch.from_arrays([pa.array(gap[opens]), pa.array(size), pa.array(ends - opens), *ranges], names=names)

    gaps = rows.mapInArrow(count, ", ".join(f"{n} long" for n in names))
    sums = gaps.groupBy("gap").agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.min(F.struct(*_LEAST)).alias("least"), F.max(F.struct(*_MOST)).alias("most")
    ).collect()  # a row per probe
    shared.unpersist()
    found = {r.gap: r for r in sums}
    edges, before, n = [], 0, 0
    for i in range(len(probes) + 1):
        r = found.get(i)
        if i:
            key = probes[i - 1]
            edges.append(Edge(key, before, n, _number(r.least) if r else key, _number(r.most) if r else key))
        before, n = before + (r["size"] if r else 0), n + (r["n"] if r else 0)
    return edges


def _grain(low: int, high: int) -> int:
    """The coarsest edges that lie between two keys: of texts, of keys, or of rows."""
    for level in range(_LEVELS):
        grain = 1 << ((_LEVELS - 1 - level) * _BITS)
        if (high - 1) // grain > low // grain:
            return grain
    return 1


def _spread(low: int, high: int, n: int) -> list[int]:
    """At most n keys between low and high, evenly, on the coarsest edges there are."""
    grain = _grain(low, high)
    first, last = low // grain + 1, (high - 1) // grain
    count = min(n, last - first + 1)
    return sorted({(first + (last - first + 1) * (2 * i + 1) // (2 * count)) * grain for i in range(count)}) if count > 0 else []


class Borders:
    """Keys between neighbouring ranges, with the bytes and rows before each."""

    def __init__(self, rows: DataFrame, shards: int, tolerance: float, range_bytes: int):
        total = rows.agg(F.sum("size"), F.count("*")).first()
        self.bytes, self.rows = total[0] or 0, total[1]
        self.shards = shards
        self.per_shard = max(1, -(-self.bytes // (shards * range_bytes)))
        ranges = shards * self.per_shard
        aims = [self.bytes * i // ranges for i in range(1, ranges)]
        near = [self.bytes / shards * tolerance if i % self.per_shard == 0 else self.bytes / ranges * INNER_TOLERANCE for i in range(1, ranges)]
        #: Every edge counted so far.
        self.seen = {0: Edge(0, 0, 0, 0, _WHOLE - 1), _WHOLE: Edge(_WHOLE, self.bytes, self.rows, _WHOLE, _WHOLE)}
        self.rounds = 0
        probes = [0, *_spread(0, _WHOLE, FIRST * ranges)] if self.rows and aims else []
        while probes:
            self.rounds += 1
            self.seen.update((e.key, e) for e in counted(rows, probes))
            self._sort()
            more: set[int] = set()
            for aim, most in zip(aims, near):
                more.update(self._open(aim, most))
            probes = sorted(more)
        self._sort()
        chosen = [self._best(aim) for aim in aims]
        self.keys = [e.key for e in chosen]
        self.rows_before = [e.rows for e in chosen]

    def _sort(self) -> None:
        self.edges = sorted(self.seen.values())
        self.before = [e.bytes for e in self.edges]

    def _around(self, aim: int) -> tuple[Edge, Edge]:
        """The last edge with at most `aim` bytes before it, and the next one."""
        at = bisect_right(self.before, aim) - 1
        return self.edges[at], self.edges[min(at + 1, len(self.edges) - 1)]

    def _best(self, aim: int) -> Edge:
        """The nearest edge; of those with equal counts the first."""
        low, high = self._around(aim)
        best = low if aim - low.bytes <= high.bytes - aim else high
        return self.edges[bisect_left(self.before, best.bytes)]

    def _open(self, aim: int, most: float) -> list[int]:
        """New probes for an aim that has no edge near enough, with the edges around them."""
        low, high = self._around(aim)
        if min(aim - low.bytes, high.bytes - aim) <= most or high.rows - low.rows <= 1:
            return []
        inner = _spread(low.least, low.most + 1, PROBES)
        return [low.key, *inner, high.key] if inner else []


def _placed(rows: DataFrame, borders: Borders) -> DataFrame:
    """The rows with their shard, range, and the rows of the shard before the range."""
    counts = [0, *borders.rows_before]
    shard = np.arange(len(counts)) // borders.per_shard
    offset = np.array(counts, np.int64) - np.array(counts, np.int64)[shard * borders.per_shard]
    shared = rows.sparkSession.sparkContext.broadcast((_parts(borders.keys), shard.astype(np.int32), offset))
    names = rows.columns

    def place(batches):
        keys, shard, offset = shared.value
        for batch in batches:
            at = passed(_columns(batch), keys) if len(keys) else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard[at]), pa.array(at.astype(np.int32)), pa.array(offset[at])],
                names=[*names, "shard", "__range", "__before"],
            )

    new = T.StructType.fromDDL("shard int, __range int, __before long")
    return rows.mapInArrow(place, T.StructType(rows.schema.fields + new.fields))


def _slotted(rows: DataFrame, borders: Borders) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*_KEYS))
    return _placed(rows, borders).withColumn("slot", F.col("__before") + place - 1)


def assigned(
    frame: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (from 0), slot (its place in the shard, from 0)."""
    ship(frame.sparkSession)
    rows = Scratch(frame.sparkSession).keep(keyed(frame, key, text), "keys")
    borders = Borders(rows, shards, tolerance, range_bytes)
    return _slotted(rows, borders).select("doc_id", "size", "text_crc32", "shard", "slot")


def write(
    frame: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES,
    key: str = "doc_id", text: str = "text",
) -> None:
    """Writes the rows with their columns as Parquet, a folder `shard=N` for each shard; a column `shard` is replaced."""
    ship(frame.sparkSession)
    rows = Scratch(frame.sparkSession).keep(keyed(frame, key, text, keep=True), "rows")
    borders = Borders(rows, shards, tolerance, range_bytes)
    placed = _slotted(rows, borders).sortWithinPartitions("__range", "slot")
    own = [F.col(f"row.`{c}`") for c in frame.columns if c.lower() != "shard"]
    placed.select(*own, "shard").write.partitionBy("shard").parquet(path)


def digests(frame: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards and slots with the law they follow; no shard is meant to grow."""
    return assigned(frame, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
