"""Byte-level deduplication by sorting suffixes in blocks with a difference cover.

A byte goes if a 200-byte string that covers it starts anywhere else too, in the same document or
another, overlaps included; strings are judged on the input and never cross documents. The rounds of
`repeats` leave the spans whose strings have to be compared. Each bucket gets the bytes of its spans
as one block and sorts the suffixes that start a 200-byte string:

- Every byte position gets a name for its next 32 bytes, ordered as those are.
- Positions whose place modulo 32 is in a difference cover get a rank among themselves by doubling
  those names, deep enough for the whole string.
- The suffixes are sorted one bucket of names at a time. Suffixes with one name are ordered by the
  cover rank at the first shift that takes both of them to positions of the cover: such a shift below
  32 exists for any two. So a bucket needs no memory beyond its suffixes and the ranks.

Neighbours in that order with a common prefix of 200 bytes are repeated strings.

Null and empty texts have no bytes; texts below 200 bytes lose nothing.

A row that is there twice, under one key or two, loses in both what the copies share. Equal strings tie
and count as repeated. A very long text is a step of its own. A null key is a key like any other, an empty
table gives no rows, other columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navspark.llm.repeats import CONTEXT, Repeats, Spans, answers, entries, values_of
from navspark.llm.text import BYTE_VALUES, texts_of

LENGTH = 200
#: Bytes of the gram by which strings are dealt.
GRAM = 40
CHUNK_BYTES = 3 << 20
PERIOD = 32
#: Suffixes that are sorted at once, unless more have one name.
BUCKET_SUFFIXES = 1 << 18


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences give every residue, found greedily."""
    cover, missing = [0, 1], set(range(period)) - {0, 1, period - 1}
    while missing:
        best = max((c for c in range(period) if c not in cover), key=lambda c: (_gain(c, cover, missing, period), -c))
        cover.append(best)
        missing -= {(a - b) % period for a in cover for b in cover}
    return sorted(cover)


def _gain(c: int, cover: list[int], missing: set[int], period: int) -> int:
    return len(missing & ({(c - x) % period for x in cover} | {(x - c) % period for x in cover}))


COVER = difference_cover(PERIOD)
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Smallest shift that takes both residues into the cover.
SHIFT = np.array(
    [[next(d for d in range(PERIOD) if IN_COVER[(a + d) % PERIOD] and IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)]
)


class Block:
    """Bytes of one bucket, with what sorting its suffixes needs; position 0 has residue 0."""

    def __init__(self, data: np.ndarray, length: int):
        self.n, self.length = len(data), length
        x = np.concatenate([data, np.zeros(length + 2 * PERIOD, np.uint8)]).astype(np.uint64)
        for shift in (1, 2, 4):
            x = (x[:-shift] << np.uint64(8 * shift)) | x[shift:]
        self.eight = x
        self.name: np.ndarray | None = None

    def names(self, at: np.ndarray) -> np.ndarray:
        """Dense ranks of the next 32 bytes of the given positions."""
        columns = [self.eight[at + 8 * k] for k in range(PERIOD // 8)]
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(at), bool)
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(new)
        return out

    def prepare(self, starts: np.ndarray) -> None:
        """Names of the suffixes, and ranks of all cover positions, deep enough for a string."""
        cover = np.flatnonzero(IN_COVER[np.arange(self.n) % PERIOD])
        wanted = np.union1d(cover, starts)
        name = self.names(wanted)
        self.name = name[np.searchsorted(wanted, starts)]
        rank = np.full(self.n + self.length + 2 * PERIOD, -1, np.int64)
        rank[cover] = name[np.searchsorted(wanted, cover)]
        depth = PERIOD
        while depth < self.length:
            ahead = np.minimum(cover + depth, len(rank) - 1)
            pair = (rank[cover] + 1) * (self.n + 2) + rank[ahead] + 1
            rank[cover] = np.unique(pair, return_inverse=True)[1]
            depth *= 2
        self.rank = rank

    def _ordered(self, group: np.ndarray) -> np.ndarray:
        """Suffixes of one name in order."""
        residues = group % PERIOD
        if (residues == residues[0]).all():
            return group[np.argsort(self.rank[group + SHIFT[residues[0], residues[0]]], kind="stable")]
        rank = self.rank

        def compare(a: int, b: int) -> int:
            d = SHIFT[a % PERIOD, b % PERIOD]
            return int(rank[a + d]) - int(rank[b + d])

        return np.array(sorted(group.tolist(), key=cmp_to_key(compare)), np.int64)

    def _tied(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings at a and b are equal."""
        out, left = np.zeros(len(a), bool), np.arange(len(a))
        steps = list(range(0, self.length - 7, 8)) + ([self.length - 8] if self.length % 8 else [])
        for k in steps:
            left = left[self.eight[a[left] + k] == self.eight[b[left] + k]]
        out[left] = True
        return out

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """Which of the strings at `starts` (ascending, whole inside the block's texts) occur twice."""
        if not len(starts):
            return np.empty(0, bool)
        self.prepare(starts)
        by_name = np.argsort(self.name, kind="stable")
        opens = np.flatnonzero(np.append(True, np.diff(self.name[by_name]) != 0))
        ends = np.append(opens[1:], len(by_name))
        out = np.zeros(len(starts), bool)
        at = 0
        while at < len(opens):
            # One bucket of suffixes: whole names, so many as fit.
            to = max(at + 1, int(np.searchsorted(ends, opens[at] + BUCKET_SUFFIXES, "right")))
            index = by_name[opens[at] : ends[to - 1]]
            order = self._bucket(starts[index], self.name[index])
            place = index[order]
            tied = self._tied(starts[place[:-1]], starts[place[1:]])
            out[place[:-1][tied]] = True
            out[place[1:][tied]] = True
            at = to
        return out

    def _bucket(self, starts: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Order of a bucket's suffixes; names come ascending."""
        residue = starts % PERIOD
        own = self.rank[starts + SHIFT[residue, residue]]
        order = np.lexsort((own, name))
        opens = np.flatnonzero(np.append(True, np.diff(name) != 0))
        # Only names at several residues need the cover's shift for each pair.
        low, high = np.minimum.reduceat(residue, opens), np.maximum.reduceat(residue, opens)
        ends = np.append(opens[1:], len(name))
        for g in np.flatnonzero(low != high).tolist():
            a, b = opens[g], ends[g]
            sort = self._ordered(starts[a:b])
            order[a:b] = a + np.searchsorted(starts[a:b], sort)
        return order


class Contexts:
    """Spans with their bytes, compared in blocks."""

    def __init__(self, length: int):
        self.length = length

    def entries(self, spans: Spans, which: np.ndarray, data: np.ndarray, chunk: int, buckets: int) -> list[tuple]:
        bucket = (spans.gram[which] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        which, bucket = which[order], bucket[order]
        opens = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(which) else []
        out = []
        for a, b in zip(opens, np.append(opens[1:], len(which))) if len(which) else []:
            own = which[a:b]
            first, size = spans.first[own], spans.last[own] - spans.first[own] + self.length
            head = np.stack([spans.span[own], (size << 32 | spans.anchor[own] - first).astype(np.uint64)], 1)
            body = b"".join([data[s : s + n].tobytes() for s, n in zip(first.tolist(), size.tolist())])
            count = np.array([len(own)], np.uint64).tobytes()
            out.append((int(bucket[a]), chunk, CONTEXT, count + head.tobytes() + body))
        return out

    def compare(self, table: pa.Table) -> list[tuple]:
        chunks, blobs = entries(table, CONTEXT)
        if not len(blobs):
            return []
        heads, bodies, owner = [], [], []
        for chunk, blob in zip(chunks.tolist(), blobs):
            n = int(np.frombuffer(blob, np.uint64, 1)[0])
            heads.append(np.frombuffer(blob, np.uint64, 2 * n, 8).reshape(n, 2))
            bodies.append(np.frombuffer(blob, np.uint8, offset=8 + 16 * n))
            owner.append(np.full(n, chunk))
        head, owner = np.concatenate(heads), np.concatenate(owner)
        size = (head[:, 1] >> np.uint64(32)).astype(np.int64)
        anchor = (head[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Anchors stand at multiples of the period, so equal strings mostly stand at equal residues.
        lead = -anchor % PERIOD
        room = -(-(lead + size + 1) // PERIOD) * PERIOD
        begin = np.cumsum(room) - room + lead
        block = np.full(int(room.sum()), 255, np.uint8)
        flat = np.concatenate(bodies)
        from_ = np.cumsum(size) - size
        block[np.arange(len(flat)) + np.repeat(begin - from_, size)] = flat
        count = size - self.length + 1
        starts = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        which = np.repeat(np.arange(len(size)), count)
        hit = Block(block, self.length).repeated(starts)
        starts, which = starts[hit], which[hit]
        if not len(starts):
            return []
        opens = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1] + 1) | (which[1:] != which[:-1])))
        last = np.append(opens[1:], len(starts)) - 1
        own = which[opens]
        runs = ((starts[opens] - begin[own]) << 32 | (starts[last] - begin[own])).astype(np.uint64)
        return answers(np.stack([head[own, 0], runs], 1), owner[own], CONTEXT)

    def repeated(self, spans: Spans, mask: np.ndarray, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of each run of repeated strings in the spans of the mask."""
        pairs, _ = values_of(known, CONTEXT, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        which = np.flatnonzero(mask)
        a = np.searchsorted(pairs[:, 0], spans.span[which], "left")
        b = np.searchsorted(pairs[:, 0], spans.span[which], "right")
        count = b - a
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
        first = np.repeat(spans.first[which], count)
        run = pairs[row, 1]
        return first + (run >> np.uint64(32)).astype(np.int64), first + (run & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _symbols(column: pa.Array):
    data, offs = texts_of(column)
    return BYTE_VALUES[data], offs, data


def _result(ids, covered, bounds, data):
    removed, spans, digests = [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        gone = covered[a:b]
        removed.append(int(gone.sum()))
        spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        digests.append(hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest())
    counts = [pa.array(x, pa.int64()) for x in (np.diff(bounds), removed, spans)]
    return [ids, *counts, pa.array(digests, pa.string())]


FIELDS = "doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(frame: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, bytes, removed bytes, maximal removed runs, digest of the bytes left."""
    finder = Repeats(length, min(GRAM, length), CHUNK_BYTES, _symbols, Contexts(length))
    return finder.apply(frame, _result, FIELDS, key, text)
