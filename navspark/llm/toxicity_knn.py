"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled rows. Terms are words and word beginnings, in lower
case and without punctuation; of those the sample has, the ones kept are associated with the label
(log-likelihood ratio). Their document frequencies are counted over all documents. The examples' postings lie
in blocks of consecutive examples, each with the largest weight in it. A text's bound for a block is
the sum of those maxima times its own weights; blocks are scored in full, best bounds first, and the
rest only where their bound reaches the k-th best similarity so far, so the result is the exact k
nearest. Ties go to the earlier example.

Votes weigh 1/(distance + SOFT) and are pulled to the base rate by PULL votes. A text without any
kept term (also an empty or null one) gets the base rate of the examples that have none either.

Each row is scored by itself, repeated ones and those with a null key too; an empty table gives no rows,
and without labels every text gets one score. A very long text is a slice of its own. A column with the
name of a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.labelled import training_rows
from navspark.llm.text import (
    BYTE_VALUES, LOWER, append, documents, held_out, identified, mixed, powers, steps, texts_of, words_of,
)

#: At most so many labelled rows become examples, and so many terms are kept.
EXAMPLES = 5000
TERMS = 512
#: Kept terms are in so many examples at least.
LEAST_EXAMPLES = 3
MARGIN = 6.0
BEGINNINGS = (4, 5, 6)
BLOCK = 64
NEIGHBOURS = 15
SEED_BLOCKS = 2
#: Texts that are scored at once, and postings that they have together (or one text alone).
LOT_TEXTS, LOT_POSTINGS = 128, 400_000
SOFT, PULL = 0.1, 1.0

_WORD = LOWER.copy()
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and row of each term, repeats included, and the number of rows."""
    data, offs = texts_of(column)
    rows = len(offs) - 1
    data = _WORD[data]
    starts, ends, first = words_of(data, offs)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), rows
    up, down = powers(len(data) + 1)
    sums = np.append(np.uint64(0), np.cumsum(BYTE_VALUES[data] * up[: len(data)]))
    row = np.repeat(np.arange(rows), np.diff(first))
    values, owners = [mixed((sums[ends] - sums[starts]) * down[starts])], [row]
    for n in BEGINNINGS:
        long = ends - starts > n
        at = starts[long]
        values.append(mixed((sums[at + n] - sums[at]) * down[at] + np.uint64(n)))
        owners.append(row[long])
    return np.concatenate(values), np.concatenate(owners), rows


def term_counts(column: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index in the sorted `known` and count of each kept term, by row and term."""
    values, row, _ = terms_of(column)
    if not len(known) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    hit = known[at] == values
    pair, count = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
    return pair // len(known), pair % len(known), count


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each comes from."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[owner], owner


@dataclass
class Index:
    """Postings by term, then block; `pair_*` describe one block of a term's postings each."""

    known: np.ndarray
    idf: np.ndarray
    doc_id: np.ndarray
    label: np.ndarray
    term_first: np.ndarray
    pair_block: np.ndarray
    pair_first: np.ndarray
    pair_max: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    none_rate: float
    rate: float

    def vectors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and weight of each text's unit vector."""
        row, term, count = term_counts(column, self.known)
        weight = (1 + np.log(np.maximum(count, 1))) * self.idf[term]
        return row, term, weight / np.sqrt(np.bincount(row, weight**2, len(column)))[row]

    def nearest(self, column: pa.Array, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, example and similarity of the k nearest examples with a similarity above zero."""
        row, term, weight = self.vectors(column)
        postings = np.diff(self.pair_first[self.term_first])[term] if len(term) else np.empty(0, np.int64)
        opens = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
        ends = np.append(opens[1:], len(row))
        work = np.append(0, np.cumsum(postings))
        found, at = [], 0
        while at < len(opens):
            # Texts whose postings, all together, stay bounded.
            to = int(np.searchsorted(work[ends], work[opens[at]] + LOT_POSTINGS, "right"))
            to = min(max(to, at + 1), at + LOT_TEXTS)
            part = slice(opens[at], ends[to - 1])
            rows, local = np.unique(row[part], return_inverse=True)
            r, example, sims = self._nearest(local, term[part], weight[part], len(rows), k)
            found.append((rows[r], example, sims))
            at = to
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _nearest(self, row, term, weight, rows, k):
        blocks = (len(self.doc_id) + BLOCK - 1) // BLOCK
        pair, of = _spread(self.term_first[term], np.diff(self.term_first)[term])
        cell = row[of] * blocks + self.pair_block[pair]
        bound = np.bincount(cell, weight[of] * self.pair_max[pair], rows * blocks).reshape(rows, blocks)
        seeds = min(SEED_BLOCKS, blocks)
        chosen = np.zeros((rows, blocks), bool)
        np.put_along_axis(chosen, np.argpartition(-bound, seeds - 1, axis=1)[:, :seeds], True, axis=1)
        first = self._scored(row, weight, pair, of, cell, chosen, rows)
        kth = np.zeros(rows)
        r, _, s = self._best(*first, k)
        last = np.flatnonzero(np.append(r[1:] != r[:-1], True)) if len(r) else np.empty(0, np.int64)
        kth[r[last]] = np.where(np.bincount(r, minlength=rows)[r[last]] == k, s[last], 0)
        rest = ~chosen & (bound > 0) & (bound >= kth[:, None] - 1e-9)
        more = self._scored(row, weight, pair, of, cell, rest, rows)
        return self._best(*(np.concatenate(x) for x in zip(first, more)), k)

    def _scored(self, row, weight, pair, of, cell, chosen, rows):
        """Row, example and similarity of the examples in the chosen blocks that share a term."""
        use = chosen.ravel()[cell]
        pair, of = pair[use], of[use]
        at, owner = _spread(self.pair_first[pair], np.diff(self.pair_first)[pair])
        size = len(self.doc_id)
        key = row[of][owner] * size + self.example[at]
        sims = np.bincount(key, weight[of][owner] * self.weight[at], rows * size)
        hit = np.flatnonzero(sims > 0)
        return hit // size, hit % size, sims[hit]

    @staticmethod
    def _best(row, example, sims, k):
        order = np.lexsort((example, -sims, row))
        row, example, sims = row[order], example[order], sims[order]
        opens = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
        place = np.arange(len(row)) - np.repeat(opens, np.diff(np.append(opens, len(row))))
        keep = place < k
        return row[keep], example[keep], sims[keep]

    def votes(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]]]:
        """Score of each text, and the ids of the examples that voted, nearest first."""
        row, example, sims = self.nearest(column)
        weight = 1 / (np.clip(1 - sims, 0, 1) + SOFT)
        rows = len(column)
        total = np.bincount(row, weight, rows)
        positive = np.bincount(row, weight * self.label[example], rows)
        score = np.where(total > 0, (positive + PULL * self.rate) / (total + PULL), self.none_rate)
        bounds = np.searchsorted(row, np.arange(rows + 1)).tolist()
        ids = self.doc_id[example].tolist()
        return score, [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def build(known, idf, doc_id, label, row, term, count, rate) -> Index:
    """The index of examples given by row, term and count."""
    n = len(doc_id)
    weight = (1 + np.log(np.maximum(count, 1))) * idf[term] if len(term) else np.empty(0)
    weight = weight / np.sqrt(np.bincount(row, weight**2, n))[row] if len(row) else weight
    order = np.lexsort((row, term))
    row, term, weight = row[order], term[order], weight[order]
    block = row // BLOCK
    new = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)]
    opens = np.flatnonzero(new)
    bare = np.ones(n, bool)
    bare[row] = False
    return Index(
        known, idf, doc_id, label.astype(float),
        np.searchsorted(term[opens], np.arange(len(known) + 1)),
        block[opens], np.append(opens, len(term)),
        np.maximum.reduceat(weight, opens) if len(opens) else np.empty(0),
        row, weight, float((label[bare].sum() + rate) / (bare.sum() + 1)), rate,
    )


def choose_terms(value: np.ndarray, row: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Sorted hashes of the terms most associated with the label; rows must be distinct per term."""
    terms, back = np.unique(value, return_inverse=True)
    n, n1 = len(label), label.sum()
    if not len(terms) or not 0 < n1 < n:
        return np.empty(0, np.uint64)
    have = np.bincount(back, minlength=len(terms)).astype(float)
    pos = np.bincount(back, label[row].astype(float), len(terms))
    cells = zip((pos, have - pos, n1 - pos, n - have - n1 + pos), _expected(have, n1, n))
    gain = 2 * sum(o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)) for o, e in cells)
    tried = max(int((have >= LEAST_EXAMPLES).sum()), 2)
    order = np.lexsort((terms, -gain))[:TERMS]
    # Among so many terms tried, chance alone hardly reaches this value.
    return np.sort(terms[order[gain[order] >= 2 * np.log(tried) + MARGIN]])


def _expected(have: np.ndarray, n1: float, n: int) -> tuple[np.ndarray, ...]:
    """Expected counts of the four cells with and without the term and the label."""
    return have * n1 / n, have * (n - n1) / n, (n - have) * n1 / n, (n - have) * (n - n1) / n


def document_frequencies(frame: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and in how many each kept term occurs."""
    shared = frame.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        found, rows = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for part in steps(batch, "text"):
                _, term, _ = term_counts(part.column(1), shared.value)
                found += np.bincount(term, minlength=len(found))
                rows += part.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(found))), pa.array(np.append(rows, found))], names=["term", "n"]
        )

    counts = identified(frame).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by_term = {r.term: r.n for r in counts.collect()}  # one row per kept term
    return by_term.get(-1, 0), np.array([by_term.get(i, 0) for i in range(len(known))], float)


def fit(spark: SparkSession, folder: str, label: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The terms of the sample are made on the executors; the driver receives those of the bounded sample."""

    def prepare(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                values, row, rows = terms_of(part.column(1))
                order = np.lexsort((values, row))
                values, row = values[order], row[order]
                new = np.append(True, (values[1:] != values[:-1]) | (row[1:] != row[:-1]))[: len(values)]
                at = np.flatnonzero(new)
                first = np.searchsorted(row[at], np.arange(rows + 1))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        lists(pa.array(values[at].view(np.int64))),
                        lists(pa.array(np.diff(np.append(at, len(values))).astype(np.int32))),
                    ],
                    names=["doc_id", "label", "terms", "counts"],
                )

    sample = training_rows(spark, folder, label, examples).mapInArrow(
        prepare, "doc_id long, label int, terms array<long>, counts array<int>"
    )
    found = sample.toArrow().sort_by("doc_id")
    doc_id, y = found["doc_id"].to_numpy(), found["label"].to_numpy()
    lengths = [len(t) for t in found["terms"]]
    row = np.repeat(np.arange(len(doc_id)), np.array(lengths, np.int64))
    flat = lambda name, kind: np.asarray(found[name].combine_chunks().flatten() if len(doc_id) else [], kind)
    value, count = flat("terms", np.int64).view(np.uint64), flat("counts", np.int64)
    known = choose_terms(value, row, y)
    n, df = document_frequencies(documents(spark, folder), known)
    idf = np.log((n + 1) / (df + 1)) + 1
    at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
    hit = known[at] == value if len(known) else np.zeros(len(value), bool)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    return build(known, idf, doc_id, y, row[hit], at[hit], count[hit], rate)


def score(frame: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """`frame` with toxicity_score and toxicity_evidence (ids of the examples that voted)."""
    shared = frame.sparkSession.sparkContext.broadcast(index)

    def compute(batch: pa.RecordBatch) -> dict:
        scores, ids = shared.value.votes(batch.column(batch.schema.get_field_index(text)))
        return {"toxicity_score": pa.array(scores), "toxicity_evidence": pa.array(ids, pa.list_(pa.int64()))}

    return append(frame, text, {"toxicity_score": "double", "toxicity_evidence": "array<long>"}, compute)


def judged(frame: DataFrame, index: Index) -> DataFrame:
    """Per document: held_out, score, predicted, evidence."""
    s = F.col("toxicity_score")
    return score(identified(frame), index).select(
        "doc_id", held_out().alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity_evidence").alias("evidence"),
    )
