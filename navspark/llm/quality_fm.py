"""Quality classifier: a factorisation machine on hashed words, structure statistics and length.

The inputs of a text are its words, hashed into a fixed number of buckets, each with weight
1/sqrt(number of words), and a vector of statistics about its form. The machine adds a bias, a
weight per input and, for each pair of inputs, the product of their low-rank vectors; the sum over
all pairs comes in linear time from the identity  2 * sum_{i<j} <v_i, v_j> x_i x_j =
|sum v_i x_i|^2 - sum |v_i x_i|^2.  It is fitted on a bounded sample of labelled rows and applied to
every whole text, slice by slice. An empty text has no words and zero statistics and gets the score
that the bias and those give. Null texts count as empty.

Each row is scored by itself, repeated ones and those with a null key too; an empty table gives no rows.
A document labelled twice counts once, without any labels the score is a half. A very long text is a slice
of its own. A column with the name of the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.labelled import training_rows
from navspark.llm.text import LOWER, append, frugal, held_out, identified, rolling, steps, texts_of, word_hashes, words_of

#: At most so many labelled rows are used for fitting.
FIT_ROWS = 6000
BUCKETS = 1 << 14
RANK = 8
EPOCHS = 12
#: Documents below this score are rejected.
ACCEPT = 0.3

_KINDS = ("upper", "lower", "digit", "space", "line", "bar", "mark", "stop", "symbol", "other")
_CLASS = np.full(256, _KINDS.index("symbol"), np.uint8)
_CLASS[128:] = _KINDS.index("other")
for _name, _chars in (
    ("upper", range(65, 91)),
    ("lower", range(97, 123)),
    ("digit", range(48, 58)),
    ("space", (9, 11, 12, 13, 32)),
    ("line", (10,)),
    ("bar", b"|"),
    ("mark", b"!?"),
    ("stop", b".,;:"),
):
    _CLASS[list(_chars)] = _KINDS.index(_name)

STATISTICS = (*_KINDS, "log_bytes", "log_words", "mean_word", "distinct_words", "distinct_trigrams", "same_as_last")
PAIR_INPUTS = len(STATISTICS)


def _distinct(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many distinct values each row has; `row` is ascending."""
    if not len(values):
        return np.zeros(rows)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1]))
    return np.bincount(r[new], minlength=rows).astype(float)


def inputs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, number of words before each row, and the statistics of each row."""
    data, offs = texts_of(column)
    rows = len(offs) - 1
    n_bytes = np.diff(offs).astype(float)
    row_of = np.repeat(np.arange(rows), np.diff(offs))
    kinds = np.bincount(row_of * len(_KINDS) + _CLASS[data], minlength=rows * len(_KINDS)).reshape(rows, -1)
    starts, ends, first = words_of(data, offs)
    words = np.diff(first)
    hashes = word_hashes(LOWER[data], starts, ends)
    word_row = np.repeat(np.arange(rows), words)
    some, many = np.maximum(words, 1), np.maximum(words - 2, 1)
    three = rolling(hashes, 3)
    within = word_row[2:] == word_row[:-2] if len(word_row) > 2 else np.empty(0, bool)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1]))[: len(hashes)]
    length = np.bincount(word_row, weights=(ends - starts).astype(float), minlength=rows)
    table = np.column_stack(
        [
            kinds / np.maximum(n_bytes, 1)[:, None],
            np.log1p(n_bytes) / 10,
            np.log1p(words) / 10,
            np.minimum(length / some, 50) / 10,
            _distinct(hashes, word_row, rows) / some,
            _distinct(three[within], word_row[: len(three)][within], rows) / many,
            np.bincount(word_row[again], minlength=rows) / some,
        ]
    )
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), first, table


@dataclass
class Machine:
    """Parameters; the statistics come after the word buckets."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, buckets: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
        """Score before the logistic function, and the parts that its gradient needs."""
        words = np.diff(first)
        each = 1 / np.sqrt(np.maximum(words, 1))
        x = np.clip((table - self.mean) / self.scale, -6, 6)
        own_w, own_v = self.weight[BUCKETS:], self.factor[BUCKETS:]
        linear = self.bias + x @ own_w
        total, squares = x @ own_v, (x**2) @ (own_v**2)
        full = words > 0
        if full.any():
            at = first[:-1][full]
            v = self.factor[buckets]
            linear[full] += np.add.reduceat(self.weight[buckets], at) * each[full]
            total[full] += np.add.reduceat(v, at, axis=0) * each[full, None]
            squares[full] += np.add.reduceat(v * v, at, axis=0) * each[full, None] ** 2
        return linear + 0.5 * (total**2 - squares).sum(1), total, x, each

    def scores(self, column: pa.Array) -> np.ndarray:
        raw = self.raw(*inputs(column))[0]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_machine(parts: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad steps over small batches. Each part: buckets, statistics, label."""
    rng = np.random.default_rng(seed)
    table = np.array([p[1] for p in parts]).reshape(-1, len(STATISTICS))
    label = np.array([p[2] for p in parts], float)
    mean = table.mean(0) if len(parts) else np.zeros(len(STATISTICS))
    scale = np.maximum(table.std(0), 1e-3) if len(parts) else np.ones(len(STATISTICS))
    size = BUCKETS + len(STATISTICS)
    rate = (label.sum() + 1) / (len(label) + 2)
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)), mean, scale)
    sum_w, sum_v, sum_b = np.full(size, 1e-4), np.full((size, RANK), 1e-4), 1e-4
    step, decay = 0.08, 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(parts))
        for lot in np.array_split(order, max(1, len(order) // 64)) if len(order) else []:
            buckets = np.concatenate([parts[i][0] for i in lot])
            first = np.append(0, np.cumsum([len(parts[i][0]) for i in lot]))
            raw, total, x, each = m.raw(buckets, first, table[lot])
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[lot]) / len(lot)
            row = np.repeat(np.arange(len(lot)), np.diff(first))
            g = (error * each)[row]
            grad_w = np.append(np.bincount(buckets, g, BUCKETS), x.T @ error)
            pull = np.bincount(buckets, error[row] * each[row] ** 2, BUCKETS)
            grad_v = np.empty_like(m.factor)
            for f in range(RANK):
                grad_v[:BUCKETS, f] = np.bincount(buckets, g * total[row, f], BUCKETS)
            grad_v[:BUCKETS] -= pull[:, None] * m.factor[:BUCKETS]
            grad_v[BUCKETS:] = x.T @ (error[:, None] * total) - ((x**2).T @ error)[:, None] * m.factor[BUCKETS:]
            grad_w += decay * m.weight
            grad_v += decay * m.factor
            sum_w += grad_w**2
            sum_v += grad_v**2
            sum_b += error.sum() ** 2
            m.weight -= step * grad_w / np.sqrt(sum_w)
            m.factor -= 0.25 * step * grad_v / np.sqrt(sum_v)
            m.bias -= step * error.sum() / np.sqrt(sum_b)
    m.factor = m.factor.astype(np.float32)
    m.weight = m.weight.astype(np.float32)
    return m


def fit(spark: SparkSession, folder: str, label: str = "quality", rows: int = FIT_ROWS) -> Machine:
    """The inputs are made on the executors; the driver receives those of the bounded sample."""

    def prepare(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                buckets, first, table = inputs(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets.astype(np.int16), pa.int16()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), lists, pa.array(table.tolist(), pa.list_(pa.float64()))],
                    names=["doc_id", "label", "buckets", "statistics"],
                )

    sample = training_rows(spark, folder, label, rows).mapInArrow(
        frugal(prepare), "doc_id long, label int, buckets array<short>, statistics array<double>"
    )
    found = sample.toArrow().sort_by("doc_id")
    parts = [
        (np.asarray(b.values, np.int64) % BUCKETS, np.asarray(s.values), y)
        for b, s, y in zip(found["buckets"].combine_chunks() if found.num_rows else [], found["statistics"], found["label"].to_pylist())
    ]
    return fit_machine(parts)


def score(frame: DataFrame, machine: Machine, text: str = "text", name: str = "quality_score") -> DataFrame:
    """`frame` with the score of each text."""
    shared = frame.sparkSession.sparkContext.broadcast(machine)

    def compute(batch: pa.RecordBatch) -> dict:
        return {name: pa.array(shared.value.scores(batch.column(batch.schema.get_field_index(text))), pa.float64())}

    return append(frame, text, {name: "double"}, compute)


def judged(frame: DataFrame, machine: Machine) -> DataFrame:
    """Per document: held_out, score, predicted."""
    scored = score(identified(frame), machine, name="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(frame: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows whose text isn't rejected, with their own columns only."""
    return score(frame, machine, text, "__score").where(F.col("__score") >= ACCEPT).drop("__score")
