"""Shared helpers: Arrow text columns as byte arrays, words, hashes, and pass-through mapping.

A word is a maximal run of bytes other than space and 0x09-0x0D. All of these are ASCII, so words are
found on UTF-8 bytes; no character is ever cut.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step holds; a longer document is a step of its own.
STEP_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _byte_table() -> np.ndarray:
    """One odd-looking 64-bit value for each byte, the same in every process."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n at least; kept and doubled when too short."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            both.append(p)
        have = _POWERS[base] = (both[0], both[1])
    return have


def rolling(values: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hash of each run of `width` consecutive 64-bit values; empty if there are fewer."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(n + 1, base)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * up[:n], out=sums[1:])
    return mixed((sums[width:] - sums[: n + 1 - width]) * down[: n + 1 - width])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset in them (one more than rows). Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (one more than rows)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[first] = inside[first]
    closes[:-1] &= ~inside[1:]
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


BYTE_VALUES = _byte_table()


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have at most `limit` bytes together, a longer row alone."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Returns memory that Arrow and the C library hold but don't use to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` for a task's batches; a worker that waits for its next task holds no memory of the last one."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that it needn't be installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def append(
    frame: DataFrame,
    text: str,
    fields: dict[str, str],
    compute: Callable[[pa.RecordBatch], dict],
    limit: int = STEP_BYTES,
) -> DataFrame:
    """`frame` with the columns that `compute` makes of each slice; a column of such a name is replaced."""
    ship(frame.sparkSession)
    new = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields.items()))
    taken = {name.lower() for name in fields}
    kept = [c for c in frame.columns if c.lower() not in taken]
    schema = T.StructType([frame.schema[c] for c in kept] + new.fields)
    names = kept + list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text, limit):
                made = compute(part)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                columns += [x if isinstance(x, pa.Array) else pa.array(x) for x in (made[c] for c in fields)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = frame.select(*[F.col(f"`{c}`") for c in frame.columns])
    return source.mapInArrow(frugal(run), schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def identified(frame: DataFrame, key: str = "doc_id", text: str = "text", *carried: str) -> DataFrame:
    """Only the key and the text, under the names doc_id and text, and carried columns; a null text is empty."""
    ship(frame.sparkSession)
    return frame.select(
        F.col(f"`{key}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        *carried,
    )


def held_out(key: str = "doc_id"):
    """Rows kept for testing: crc32 of the key as text is a multiple of five."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
