"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by bit overlap.

Every window of 64 bytes has a quantised entropy; its rank is the rarity of that value among all
windows of the whole corpus. In each run of 64 neighbouring windows the leftmost of the lowest rank
gets a point, and windows with enough points are the features of the text. Their hashes set five bits
each in a filter of 2,048 bits; a filter takes 160 features, then the next one starts. A text with
windows but none popular enough has its single rarest one; a short text has all its small windows
instead; the empty text has the empty fingerprint.

The likeness of two fingerprints takes each filter of the one with fewer filters to its best match in
the other: common bits beyond those expected by chance, as a share of the largest possible number
beyond chance. Two empty fingerprints are alike (1), an empty one and another aren't (0).

Rows are compared in the order of their keys; rows of one key lie in the order of their texts. A very long
text is a step of its own, an empty table gives no rows, and other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.neighbours import BUCKET, PLACE, in_order
from navspark.llm.text import BYTE_VALUES, STEP_BYTES, documents, identified, mixed, powers, rolling, steps, texts_of

WINDOW = 64
LEVELS = 1001
#: Windows that compete for a point, and the points that make a feature.
RIVALS, POINTS = 64, 16
#: A text below this many bytes has too few windows to choose from: all its small windows are features.
SHORT, SHORT_WINDOW = 320, 12
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5

_GAP = np.full(WINDOW - 1, 255, np.uint8)  # no byte of UTF-8
_ONE = 1 << 20
_GAIN = np.array([0] + [round(_ONE * (c + 1) * np.log2(c + 1)) for c in range(WINDOW)], np.int64)
_GAIN = np.diff(_GAIN)  # of the c-th more occurrence, c from 0
_CHUNK = 1 << 15


def spaced(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array with gaps between them, and where each starts and ends."""
    sizes = np.array([len(t) for t in texts], np.int64)
    gap = _GAP.tobytes()
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    starts = len(gap) + np.append(0, np.cumsum(sizes + len(gap)))[:-1]
    return data, starts, starts + sizes


def levels(data: np.ndarray) -> np.ndarray:
    """Quantised entropy of the window that starts at each byte; only those inside a text count."""
    n = len(data)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    padded = np.concatenate([_GAP, data, _GAP])
    w = WINDOW - 1
    same = np.empty(_CHUNK, bool)
    for at in range(0, n, _CHUNK):
        to = min(at + _CHUNK, n)
        own = padded[at + w : to + w]
        a, b = ahead[at:to], behind[at:to]
        hit = same[: to - at]
        one = hit.view(np.uint8)
        for d in range(1, WINDOW):
            np.equal(own, padded[at + w + d : to + w + d], out=hit)
            np.add(a, one, out=a)
            np.equal(own, padded[at + w - d : to + w - d], out=hit)
            np.add(b, one, out=b)
    gap = data == _GAP[0]  # gaps are no symbols; the first of a kind gains nothing
    ahead[gap] = behind[gap] = 0
    gained = np.append(0, np.cumsum(_GAIN[np.minimum(behind, w)]))
    lost = np.append(0, np.cumsum(_GAIN[np.minimum(ahead, w)]))
    last = np.minimum(np.arange(n) + WINDOW, n)
    total = gained[last] - lost[:n]
    out = (LEVELS - 1) - total * (LEVELS - 1) // (WINDOW * 6 * _ONE)
    return np.clip(out, 0, LEVELS - 1)


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where whole windows start."""
    edge = np.zeros(n + 1, np.int8)
    long = ends - starts >= WINDOW
    edge[starts[long]] += 1
    edge[ends[long] - WINDOW + 1] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def histogram(frame: DataFrame) -> np.ndarray:
    """Windows of the whole corpus by level."""

    def count(batches):
        found = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for part in steps(batch, "text"):
                raw, offs = texts_of(part.column(1))
                raw = raw.tobytes()
                data, starts, ends = spaced([raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())])
                found += np.bincount(levels(data)[_inside(len(data), starts, ends)], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(found)], names=["level", "n"])

    counts = identified(frame).mapInArrow(count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(LEVELS, np.int64)
    for row in counts.collect():  # a row per level
        out[row.level] = row.n
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: the rarest first; windows of one repeated byte last."""
    out = np.empty(LEVELS, np.int64)
    out[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    out[0] = LEVELS
    return out


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of `width`, by block minima from both ends."""
    n = len(keys) - width + 1
    size = -(-len(keys) // width) * width
    blocks = np.full(size, np.iinfo(np.int64).max)
    blocks[: len(keys)] = keys
    blocks = blocks.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, one row of 64-bit words each."""
    data, starts, ends = spaced(texts)
    inside = _inside(len(data), starts, ends)
    at = np.flatnonzero(inside)
    which = np.searchsorted(starts, at, "right") - 1
    key = (rank[levels(data)[at]] << 40) | np.arange(len(at))
    points = np.zeros(len(at), np.int64)
    if len(at) >= RIVALS:
        least = _least(key, RIVALS) & ((1 << 40) - 1)
        whole = which[: len(least)] == which[RIVALS - 1 :]
        points = np.bincount(least[whole], minlength=len(at))
    chosen = points >= POINTS
    # A text without a popular window has its rarest one.
    lone = np.ones(len(texts), bool)
    lone[which[chosen]] = False
    first = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else np.empty(0, np.int64)
    if len(first):
        rarest = np.minimum.reduceat(key, first) & ((1 << 40) - 1)
        chosen[rarest[lone[which[first]]]] = True
    at, which = at[chosen], which[chosen]
    up, down = powers(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum(BYTE_VALUES[data] * up[: len(data)]))
    hashes = mixed((sums[at + WINDOW] - sums[at]) * down[at])
    bounds = np.searchsorted(which, np.arange(len(texts) + 1))
    out = []
    for k, text in enumerate(texts):
        own = hashes[bounds[k] : bounds[k + 1]]
        if len(text) < SHORT:
            own = _short(text)
        _, place = np.unique(own, return_index=True)
        out.append(_filters(own[np.sort(place)]))
    return out


def _short(text: bytes) -> np.ndarray:
    """Hashes of all small windows, or of the whole text if it has none."""
    if not text:
        return np.empty(0, np.uint64)
    return rolling(BYTE_VALUES[np.frombuffer(text, np.uint8)], min(SHORT_WINDOW, len(text)))


def _filters(hashes: np.ndarray) -> np.ndarray:
    """Each distinct feature sets its bits in the filter of its turn."""
    turn = np.arange(len(hashes)) // FILTER_FEATURES
    bits = np.zeros((-(-len(hashes) // FILTER_FEATURES), FILTER_BITS), np.uint8)
    for i in range(HASHES):
        bits[turn, ((hashes >> np.uint64(11 * i)) % np.uint64(FILTER_BITS)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1).view(np.uint64) if len(bits) else np.empty((0, FILTER_BITS // 64), np.uint64)


def written(filters: np.ndarray) -> str:
    return ":".join(base64.b64encode(f.tobytes()).decode() for f in filters)


def read(fingerprint: str) -> np.ndarray:
    parts = [np.frombuffer(base64.b64decode(p), np.uint64) for p in fingerprint.split(":") if p]
    return np.array(parts, np.uint64).reshape(len(parts), FILTER_BITS // 64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two fingerprints, from 0 to 1 and the same in either order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return (_likeness(a, b) + _likeness(b, a)) / 2
    return _likeness(a, b)


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    ones_a, ones_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a))
    for i in range(len(a)):
        both = np.bitwise_count(b & a[i]).sum(1, dtype=np.int64)
        chance = ones_a[i] * ones_b / FILTER_BITS
        most = np.minimum(ones_a[i], ones_b)
        best[i] = np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max()
    return float(best.mean())


def edited(text: str, other: str) -> str:
    """The text with its last half replaced by the beginning of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


FIELDS = (
    "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def against_next(frame: DataFrame, rank: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and their likeness to it and to the next document.

    The next document is the one with the next smaller key, after the smallest the largest; of equal
    keys the smaller text is first. A null key is below all others.
    """
    source = identified(frame, key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    place = F.coalesce(-F.col("doc_id").cast("decimal(38,0)"), F.lit("99999999999999999999").cast("decimal(38,0)"))
    ordered = in_order(source, place, "text", "text", around=True).where(F.col(PLACE) >= 0)
    shared = frame.sparkSession.sparkContext.broadcast(rank)
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            c = [batch.column(batch.schema.get_field_index(n)) for n in (BUCKET, PLACE, "doc_id", "text")]
            for part in zip(*(x.to_pylist() for x in c)):
                yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in chain(rows(batches), [None]):
            if row is not None:
                held.append(row)
                size += len(row[3])
            if held and (row is None or size >= STEP_BYTES):
                yield made(held)
                held = held[-1:]
                size = len(held[0][3])

    def made(held: list[tuple]) -> pa.RecordBatch:
        pairs = [(i, i + 1) for i in range(len(held) - 1) if held[i][1] == 0 and held[i + 1][0] == held[i][0]]
        new = [edited(held[i][3], held[j][3]).encode() for i, j in pairs]
        prints = fingerprints([h[3].encode() for h in held] + new, shared.value)
        out = []
        for n, (i, j) in enumerate(pairs):
            other = prints[len(held) + n]
            out.append((
                held[i][2], len(held[i][3]), hashlib.sha256(new[n]).hexdigest(), written(prints[i]), written(other),
                likeness(prints[i], other), likeness(prints[i], prints[j]),
            ))
        columns = list(zip(*out)) or [[]] * len(names)
        types = [id_type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(source.schema["doc_id"].dataType)
    return ordered.select(BUCKET, PLACE, "doc_id", "text").mapInArrow(run, FIELDS.format(kind=kind))


def compared(spark: SparkSession, folder: str) -> DataFrame:
    frame = documents(spark, folder)
    return against_next(frame, ranks(histogram(frame)))
