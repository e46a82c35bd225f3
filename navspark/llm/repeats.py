"""Windows of a fixed length that occur twice anywhere, found without shuffling every window.

Documents lie in chunks. Each window belongs to its anchor, the gram in it with the smallest hash
(the leftmost of equals); equal windows have equal anchors at equal places. Neighbouring windows of
one anchor form its span. Three rounds follow, each over the same chunks:

A. Each chunk sends the hash of every distinct span and of every distinct anchor gram. A span that
   occurs twice is repeated as a whole. A gram in one span only proves all its windows unique.
B. Left are spans that are unique but share their gram with another span. Their windows are compared
   one by one, with those of one copy of each repeated span that has the same gram.
C. Each chunk marks its repeated windows.

A chunk sends a value once however often it has it, so a value costs at most one entry per chunk, and
values are dealt by their hash: no frequent text meets in one task. Answers go back by chunk. No task
holds more than a chunk, or the entries of one bucket; a document larger than a chunk is one alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.text import identified, mixed, powers

#: Spans of one gram, counted by chunk, from which its windows are dealt one by one by their hash.
CROWD = 64
#: Kinds of entries and answers.
SPAN, SPAN_FIRST, GRAM, GRAM_CROWDED, WINDOW, CONTEXT = range(6)
ENTRY = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])
ENTRY_DDL = "bucket long, chunk long, kind int, data binary"
_MANY = np.uint64(0)
_LOW = np.uint64((1 << 24) - 1)


def least_gram(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (its upper 40 bits, then the place) in each run of `width` grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    size = -(-len(grams) // width) * width
    keys = np.full(size, np.iinfo(np.uint64).max)
    np.bitwise_and(grams, ~_LOW, out=keys[: len(grams)])
    keys[: len(grams)] |= np.arange(len(grams), dtype=np.uint64) & _LOW
    blocks = keys.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n]
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    low = (np.minimum(up, down) & _LOW).astype(np.int64)
    at = np.arange(n)
    return at + ((low - at) & int(_LOW))


@dataclass
class Spans:
    """Spans of a chunk: first and last window start, anchor, hash of the gram and of the span."""

    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    gram: np.ndarray
    span: np.ndarray
    sums: np.ndarray
    window: int

    @classmethod
    def of(cls, symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Spans:
        """`symbols` are 64-bit values, `bounds` where each document starts and the last one ends."""
        n = len(symbols)
        up, down = powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(symbols * up[:n], out=sums[1:])
        none = np.empty(0, np.int64)
        if n < window:
            return cls(none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums, window)
        hashes = mixed((sums[gram:] - sums[: n + 1 - gram]) * down[: n + 1 - gram])
        owner = least_gram(hashes, window - gram + 1)
        edge = np.zeros(n + 2, np.int32)
        long = np.diff(bounds) >= window
        np.add.at(edge, bounds[:-1][long], 1)
        np.add.at(edge, bounds[1:][long] - window + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[: len(owner)]) > 0)
        own = owner[starts]
        new = np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))[: len(starts)]
        # A document starts a new span: no anchor is in two documents.
        opens = np.flatnonzero(new)
        first, last = starts[opens], starts[np.append(opens[1:], len(starts)) - 1] if len(opens) else none
        anchor = own[opens]
        to = last + window
        place = mixed(((anchor - first) << 32 | (to - first)).astype(np.uint64))
        span = mixed((sums[to] - sums[first]) * down[first] + place)
        return cls(first, last, anchor, mixed(hashes[anchor]), np.maximum(span, np.uint64(1)), sums, window)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window of the given spans."""
        count = self.last[which] - self.first[which] + 1
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[which], count)
        down = powers(len(self.sums))[1]
        return starts, mixed((self.sums[starts + self.window] - self.sums[starts]) * down[starts])


def _dealt(values: np.ndarray, kind: int, chunk: int, buckets: int, width: int = 1) -> list[tuple]:
    """Entries of one kind, by bucket; `values` has `width` columns and the first decides."""
    if not len(values):
        return []
    lead = values if width == 1 else values[:, 0]
    bucket = (lead % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, values = bucket[order], values[order]
    opens = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(opens[1:], len(bucket))
    return [(int(bucket[a]), chunk, kind, values[a:b].tobytes()) for a, b in zip(opens.tolist(), ends.tolist())]


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, ENTRY.types)], schema=ENTRY)


def entries(table: pa.Table, kind: int) -> tuple[np.ndarray, list[bytes]]:
    """Chunk of each entry of a kind, and its data."""
    rows = [(c, d) for c, k, d in zip(table["chunk"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()) if k == kind]
    return np.array([c for c, _ in rows], np.int64), [d for _, d in rows]


def values_of(table: pa.Table, kind: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All values of a kind and the chunk that each comes from."""
    chunks, data = entries(table, kind)
    flat = np.frombuffer(b"".join(data), np.uint64)
    owner = np.repeat(chunks, [len(d) // (8 * width) for d in data])
    return (flat.reshape(-1, width) if width > 1 else flat), owner


def answers(values: np.ndarray, chunks: np.ndarray, kind: int) -> list[tuple]:
    """Values for each chunk, as entries whose bucket isn't used."""
    order = np.argsort(chunks, kind="stable")
    values, chunks = values[order], chunks[order]
    opens = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])) if len(chunks) else np.empty(0, np.int64)
    ends = np.append(opens[1:], len(chunks))
    return [(0, int(chunks[a]), kind, values[a:b].tobytes()) for a, b in zip(opens.tolist(), ends.tolist())]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the group of each place in that order (by the last key), and group sizes."""
    order = np.lexsort(keys)
    lead = keys[-1][order]
    group = np.cumsum(np.append(True, lead[1:] != lead[:-1])[: len(lead)]) - 1
    return order, group, np.bincount(group) if len(group) else np.empty(0, np.int64)


def shared_values(table: pa.Table, kind: int) -> list[tuple]:
    """Answers for the values that two chunks or more have."""
    values, chunk = values_of(table, kind)
    order, group, size = _groups(chunk, values)
    keep = size[group] > 1 if len(group) else np.empty(0, bool)
    return answers(values[order][keep], chunk[order][keep], kind)


def compare_spans(table: pa.Table) -> pa.Table:
    """Round A in one bucket: repeated spans, and grams with several spans."""
    out = []
    values, chunk = values_of(table, SPAN)
    order, group, size = _groups(chunk, values)
    if len(order):
        values, chunk = values[order], chunk[order]
        opens = np.append(True, group[1:] != group[:-1])
        more = size[group] > 1
        out += answers(values[more & opens], chunk[more & opens], SPAN_FIRST)
        out += answers(values[more & ~opens], chunk[more & ~opens], SPAN)
    pairs, chunk = values_of(table, GRAM, 2)
    if len(pairs):
        order, group, size = _groups(pairs[:, 1], pairs[:, 0])
        gram, span, chunk = pairs[order, 0], pairs[order, 1], chunk[order]
        differs = np.append(False, (span[1:] != span[:-1]) & (group[1:] == group[:-1])) | (span == _MANY)
        several = np.bincount(group, differs) > 0
        kinds = np.bincount(group, differs) + 1
        ask = several[group] & (size[group] > 1)
        crowd = ask & (kinds[group] > CROWD)
        out += answers(gram[crowd], chunk[crowd], GRAM_CROWDED)
        out += answers(gram[ask & ~crowd], chunk[ask & ~crowd], GRAM)
    return _table(out)


@dataclass
class Verdict:
    """What a chunk knows of its spans after round A."""

    solid: np.ndarray  # the whole span occurs twice
    single: np.ndarray  # unique, but its gram has other spans
    shown: np.ndarray  # one of the spans to compare, each distinct span once over all chunks
    crowded: np.ndarray  # of those, the ones whose windows go one by one


def judge(spans: Spans, table: pa.Table) -> Verdict:
    has = lambda x, kind: np.isin(x, np.unique(values_of(table, kind)[0]))
    _, place, back, count = np.unique(spans.span, return_index=True, return_inverse=True, return_counts=True)
    elsewhere_first, elsewhere = has(spans.span, SPAN_FIRST), has(spans.span, SPAN)
    solid = (count[back] > 1) | elsewhere_first | elsewhere if len(back) else np.empty(0, bool)
    # Several spans of the gram in this chunk, or in others.
    one = np.zeros(len(spans.span), bool)
    one[place] = True
    _, gram_back = np.unique(spans.gram, return_inverse=True)
    kinds = np.bincount(gram_back, one)[gram_back] if len(gram_back) else np.empty(0)
    crowded = has(spans.gram, GRAM_CROWDED)
    several = (kinds > 1) | crowded | has(spans.gram, GRAM)
    return Verdict(solid, several & ~solid, several & one & ~elsewhere, crowded)


class Repeats:
    """Repeated windows of `window` symbols.

    `symbols` gives a chunk's symbols and document bounds from its texts. `contexts`, if given,
    compares the windows of spans that aren't crowded: it makes entries from a chunk's spans, and
    answers from a bucket's entries; without it all windows are compared by their hash.
    """

    def __init__(self, window: int, gram: int, chunk_bytes: int, symbols: Callable, contexts=None):
        self.window, self.gram, self.chunk_bytes, self.symbols, self.contexts = window, gram, chunk_bytes, symbols, contexts

    def spans(self, table: pa.Table) -> tuple[Spans, tuple]:
        symbols, bounds, rest = self.symbols(table["text"].combine_chunks())
        return Spans.of(symbols, bounds, self.window, self.gram), (bounds, rest)

    def first_entries(self, table: pa.Table, buckets: int) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        spans, _ = self.spans(table)
        rows = _dealt(np.unique(spans.span), SPAN, chunk, buckets)
        order, group, _ = _groups(spans.span, spans.gram)
        if len(order):
            gram, span = spans.gram[order], spans.span[order]
            opens = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            last = np.append(opens[1:], len(order)) - 1
            several = span[opens] != span[last]
            pairs = np.stack([gram[opens], np.where(several, _MANY, span[opens])], 1)
            rows += _dealt(pairs, GRAM, chunk, buckets, 2)
        return _table(rows)

    def second_entries(self, table: pa.Table, known: pa.Table, buckets: int) -> pa.Table:
        if not len(table):
            return _table([])
        chunk = table["chunk"][0].as_py()
        spans, (_, rest) = self.spans(table)
        verdict = judge(spans, known)
        by_hash = verdict.shown & verdict.crowded if self.contexts else verdict.shown
        rows = _dealt(np.unique(spans.windows(np.flatnonzero(by_hash))[1]), WINDOW, chunk, buckets)
        if self.contexts:
            rows += self.contexts.entries(spans, np.flatnonzero(verdict.shown & ~verdict.crowded), rest, chunk, buckets)
        return _table(rows)

    def compare_windows(self, table: pa.Table) -> pa.Table:
        rows = shared_values(table, WINDOW)
        if self.contexts:
            rows += self.contexts.compare(table)
        return _table(rows)

    def covered(self, table: pa.Table, known: pa.Table) -> tuple[np.ndarray, tuple]:
        """Which symbols of the chunk a repeated window covers; bounds and what `symbols` gave besides."""
        spans, (bounds, rest) = self.spans(table)
        verdict = judge(spans, known)
        edge = np.zeros(bounds[-1] + 1, np.int32)
        np.add.at(edge, spans.first[verdict.solid], 1)
        np.add.at(edge, spans.last[verdict.solid] + self.window, -1)
        by_hash = verdict.single & verdict.crowded if self.contexts else verdict.single
        starts, hashes = spans.windows(np.flatnonzero(by_hash))
        shown = verdict.shown & verdict.crowded if self.contexts else verdict.shown
        own, count = np.unique(spans.windows(np.flatnonzero(shown))[1], return_counts=True)
        there = np.unique(np.append(values_of(known, WINDOW)[0], own[count > 1]))
        hit = starts[np.isin(hashes, there)]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + self.window, -1)
        if self.contexts:
            low, high = self.contexts.repeated(spans, verdict.single & ~verdict.crowded, known)
            np.add.at(edge, low, 1)
            np.add.at(edge, high + self.window, -1)
        return np.cumsum(edge[:-1]) > 0, (bounds, rest)

    def apply(self, frame: DataFrame, result: Callable, fields: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """`result(ids, covered, bounds, rest)` gives the columns of `fields` for the documents of a chunk."""
        source = identified(frame, key, text)
        size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks = max(1, -(-size // self.chunk_bytes))
        dealt = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
        by_chunk = lambda df: df.groupBy("chunk")

        def first(table: pa.Table) -> pa.Table:
            return self.first_entries(table, chunks)

        def second(docs: pa.Table, known: pa.Table) -> pa.Table:
            return self.second_entries(docs, known, chunks)

        def third(docs: pa.Table, known: pa.Table) -> pa.Table:
            covered, (bounds, rest) = self.covered(docs, known)
            columns = result(docs["doc_id"].combine_chunks(), covered, bounds, rest)
            return pa.table(columns, names=[f.split()[0] for f in fields.format(kind="").split(", ")])

        sent = by_chunk(dealt).applyInArrow(first, ENTRY_DDL)
        known = sent.groupBy("bucket").applyInArrow(compare_spans, ENTRY_DDL)
        windows = by_chunk(dealt).cogroup(by_chunk(known)).applyInArrow(second, ENTRY_DDL)
        compared = windows.groupBy("bucket").applyInArrow(lambda t: self.compare_windows(t), ENTRY_DDL)
        kind = source.schema["doc_id"].dataType.simpleString()
        return by_chunk(dealt).cogroup(by_chunk(known.unionAll(compared))).applyInArrow(third, fields.format(kind=kind))
