"""Benchmark decontamination: every passage of every text is a BM25 query against the test items.

The items make an inverted index with impacts per posting; items lie in blocks, and each term keeps
its largest impact overall and per block. A passage is given up when the sum of its terms' largest
impacts stays below the lowest threshold (an item's threshold is a share of the best score that a run
of a passage's length in its own text would get), a block when the sum of its block maxima stays below
the lowest threshold in it;
all items of the blocks left are scored in full, and all above their threshold go to verification.
There the words around the passage must hold a given share of the item's word n-grams, for its
question (all sentences but the last) and its answer (the last sentence; of a single sentence, the
last third of its words).

Passages overlap by half and cover the whole text. Words are runs of letters and digits in lower
case. Any run of a passage's length lies in two neighbouring passages, so one of them gets half its
score: a copied item is found whatever its length. Null or empty texts and items match nothing; equal
items are found each.

Items are indexed in shards of a bounded size, in Spark tasks; document frequencies, number and mean
length are those of all items, so matches don't depend on the shards. A shard at a time comes to the
driver to be broadcast; beyond one shard the documents are scanned once for each.

Repeated rows are found each, under any key, a null one too; an empty table gives no rows. A very long
text is a step of its own. In `clean` all other columns stay as they are.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm.components import Scratch
from navspark.llm.text import LOWER, append, documents, identified, rolling, ship, steps, texts_of, word_hashes, words_of

PASSAGE, STRIDE = 64, 32
K1, B = 1.2, 0.75
#: Share of the best score in an item's own text that a passage must reach; at most a half.
SHARE = 0.3
BLOCK = 16
GRAM = 3
#: Shares of the question's and the answer's n-grams that must be there.
QUESTION, ANSWER = 0.5, 0.5
#: Bytes of item text in one broadcast index.
SHARD_BYTES = 8 << 20
#: Postings that are scored at a time.
LOT = 1 << 20

_WORD = LOWER.copy()
_WORD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and the number of words before each."""
    return _hashed(pa.array(texts, pa.string()))


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = texts_of(column)
    data = _WORD[data]
    starts, ends, first = words_of(data, offs)
    return word_hashes(data, starts, ends), first


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in _SENTENCE.split(text.strip()) if p.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


def grams(words: np.ndarray, size: int) -> np.ndarray:
    return rolling(words, min(size, max(len(words), 1)))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(starts)), lengths)
    return np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[owner], owner


def _cells(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of a table that are summed up, and each key's place in them: all if they are few, else those that occur."""
    return (np.arange(most), key) if most <= LOT else np.unique(key, return_inverse=True)


@dataclass
class Index:
    terms: np.ndarray
    term_max: np.ndarray
    term_first: np.ndarray
    pair_block: np.ndarray
    pair_max: np.ndarray
    pair_first: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    item_id: np.ndarray
    threshold: np.ndarray
    block_threshold: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]

    def retrieve(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, first word, item and score of every passage and item above the item's threshold."""
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if not len(self.item) or not len(words):
            return none
        counts = np.diff(first)
        passages = np.where(counts > 0, np.maximum(1, -(-(counts - PASSAGE) // STRIDE) + 1), 0)
        before = np.append(0, np.cumsum(passages))
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[at] == words)
        term, row = at[place], np.searchsorted(first, place, "right") - 1
        offset = place - first[row]
        # A word belongs to the passage that starts at its stride and to the one before.
        step = offset // STRIDE
        keys = []
        for back in range(-(-PASSAGE // STRIDE)):
            p = step - back
            ok = (p >= 0) & (p < passages[row]) & (offset < p * STRIDE + PASSAGE)
            keys.append((before[row[ok]] + p[ok]) * len(self.terms) + term[ok])
        key = np.unique(np.concatenate(keys))
        passage, term = key // len(self.terms), key % len(self.terms)
        bound = np.bincount(passage, self.term_max[term], before[-1])
        left = bound[passage] >= self.threshold.min()
        passage, term = passage[left], term[left]
        if not len(passage):
            return none
        found = [self._lot(passage[x:y], term[x:y]) for x, y in self._lots(passage, term)]
        passage, item, score = (np.concatenate(x) for x in zip(*found))
        row = np.searchsorted(before, passage, "right") - 1
        return row, first[row] + (passage - before[row]) * STRIDE, item, score

    def _lots(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of whole passages whose terms have at most LOT postings together, or one passage."""
        sizes = np.cumsum(self.pair_first[self.term_first[term + 1]] - self.pair_first[self.term_first[term]])
        starts = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
        ends = np.append(starts[1:], len(passage))
        at = 0
        while at < len(starts):
            before = sizes[starts[at] - 1] if starts[at] else 0
            to = max(at + 1, int(np.searchsorted(sizes[ends - 1], before + LOT, "right")))
            yield int(starts[at]), int(ends[to - 1])
            at = to

    def _lot(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score above the item's threshold; tables hold what occurs, not all there could be."""
        blocks, items = len(self.block_threshold), len(self.item_id)
        seen, place = np.unique(passage, return_inverse=True)
        pair, of = _spread(self.term_first[term], np.diff(self.term_first)[term])
        cell, back = _cells(place[of] * blocks + self.pair_block[pair], len(seen) * blocks)
        bound = np.bincount(back, self.pair_max[pair], len(cell))
        use = (bound >= self.block_threshold[cell % blocks])[back]
        pair, back = pair[use], back[use]
        post, owner = _spread(self.pair_first[pair], np.diff(self.pair_first)[pair])
        key, back = _cells((cell // blocks)[back][owner] * items + self.item[post], len(seen) * items)
        score = np.bincount(back, self.impact[post], len(key))
        hit = score >= self.threshold[key % items]
        return seen[key[hit] // items], key[hit] % items, score[hit]

    def verified(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """Row, item, score, question and answer overlap, first word of the best passage of each match."""
        best: dict[tuple[int, int], tuple] = {}
        seen: dict[tuple[int, int, int, int], tuple[float, float]] = {}
        for row, start, item, score in zip(*(x.tolist() for x in self.retrieve(words, first))):
            question, answer = self.parts[item]
            reach = len(question) + len(answer) + 2 * GRAM
            low, high = max(first[row], start - reach), min(first[row + 1], start + PASSAGE + reach)
            if (row, item, low, high) not in seen:
                there = {n: rolling(words[low:high], n) for n in {_size(question), _size(answer)} if n}
                seen[row, item, low, high] = _share(question, there), _share(answer, there)
            q, a = seen[row, item, low, high]
            if q >= QUESTION and a >= ANSWER and (row, item) not in best or (row, item) in best and score > best[row, item][2]:
                best[row, item] = (row, item, score, q, a, int(start - first[row]))
        return [best[k] for k in sorted(best)]


def _size(words: np.ndarray) -> int:
    return min(GRAM, len(words))


def _share(words: np.ndarray, there: dict[int, np.ndarray]) -> float:
    """Share of the n-grams that are there; a part without words is there."""
    n = _size(words)
    return float(np.isin(np.unique(rolling(words, n)), there[n]).mean()) if n else 1.0


def best_run(terms: np.ndarray, impact: np.ndarray, size: int = PASSAGE) -> float:
    """The largest sum of impacts of the distinct terms in `size` of these words in a row."""
    at = np.arange(len(terms))
    order = np.argsort(terms, kind="stable")
    same = terms[order][1:] == terms[order][:-1]
    before = np.full(len(terms), -1)
    before[order[1:][same]] = order[:-1][same]
    # A word counts in the runs that begin after its last occurrence and reach it.
    change = np.bincount(np.maximum(before, np.maximum(at - size, -1)) + 1, impact, len(terms) + 1)
    change -= np.bincount(at + 1, impact, len(terms) + 1)
    return float(np.cumsum(change)[: max(len(terms) - size, 0) + 1].max())


@dataclass
class Statistics:
    """Items with words, their mean number of words, and the number of them that hold each term (ascending)."""

    count: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def build(items: list[tuple[int, str]], of_all: Statistics | None = None) -> Index:
    """The index of (item_id, text); items without words are left out. Statistics are its own if none are given."""
    words, first = hashed([t for _, t in items])
    kept = [i for i in range(len(items)) if first[i] < first[i + 1]]
    # Items with like thresholds share a block.
    length = {i: int(first[i + 1] - first[i]) for i in kept}
    kept.sort(key=lambda i: (length[i], items[i][0]))
    mean = of_all.mean if of_all else sum(length.values()) / max(len(kept), 1)
    terms, flat = np.unique(words, return_inverse=True)
    rows = [np.unique(flat[first[i] : first[i + 1]], return_inverse=True, return_counts=True) for i in kept]
    term = np.concatenate([t for t, _, _ in rows]) if rows else np.empty(0, np.int64)
    tf = np.concatenate([c for _, _, c in rows]).astype(float) if rows else np.empty(0)
    distinct = np.array([len(t) for t, _, _ in rows], np.int64)
    item = np.repeat(np.arange(len(rows)), distinct)
    size = np.array([length[i] for i in kept], float)
    df = of_all.df[np.searchsorted(of_all.terms, terms)] if of_all else np.bincount(term, minlength=len(terms))
    idf = np.log(1 + ((of_all.count if of_all else len(kept)) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(mean, 1)))
    own = np.bincount(item, impact, len(kept))
    long = np.flatnonzero(size > PASSAGE)
    for k, before in zip(long.tolist(), (np.cumsum(distinct) - distinct)[long].tolist()):
        place = rows[k][1]
        own[k] = best_run(place, impact[before + place])
    threshold = SHARE * own
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    block = item // BLOCK
    opens = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
    term_max = np.zeros(len(terms))
    np.maximum.at(term_max, term, impact)
    parts = [tuple(_words(p) for p in question_and_answer(items[i][1])) for i in kept]
    return Index(
        terms, term_max, np.searchsorted(term[opens], np.arange(len(terms) + 1)), block[opens],
        np.maximum.reduceat(impact, opens) if len(opens) else np.empty(0), np.append(opens, len(term)), item, impact,
        np.array([items[i][0] for i in kept], np.int64), threshold,
        np.array([threshold[k : k + BLOCK].min() for k in range(0, len(kept), BLOCK)]), parts,
    )


def _words(text: str) -> np.ndarray:
    return hashed([text])[0]


class Shards(Sequence):
    """Indexes in a folder, one read at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.names = [r.shard for r in self._table().select("shard").distinct().orderBy("shard").collect()]

    def _table(self) -> DataFrame:
        return self.spark.read.schema("data binary, shard long").parquet(self.path)

    def __len__(self) -> int:
        return max(1, len(self.names))

    def __getitem__(self, k: int) -> Index:
        if not self.names and k == 0:
            return build([])
        return pickle.loads(self._table().where(F.col("shard") == self.names[k]).first().data)


def shards(items: DataFrame) -> Shards:
    """Indexes of the items, each of about a bounded size, with the statistics of all items."""
    spark = items.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    rows = items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    counted = append(rows, "text", {"words": "long"}, lambda part: {"words": np.diff(_hashed(part.column(1))[1])})
    total = counted.agg(F.sum(F.octet_length("text")), F.sum("words"), F.sum((F.col("words") > 0).cast("long"))).first()
    size, words, count = (x or 0 for x in total)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-size // SHARD_BYTES)))))

    def terms(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                found, first = _hashed(part.column(1))
                shard = part.column(2).to_numpy()
                owner = np.repeat(np.arange(len(shard)), np.diff(first))
                once = np.unique(np.stack([owner, found.view(np.int64)], 1), axis=0)
                pair, n = np.unique(np.stack([shard[once[:, 0]], once[:, 1]], 1), axis=0, return_counts=True)
                columns = [np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "term", "n"])

    spread = rows.mapInArrow(terms, "shard long, term long, n long").groupBy("term")
    df = spread.agg(F.sum("n").alias("df"), F.collect_set("shard").alias("shards"))
    df = df.select(F.explode("shards").alias("shard"), "term", "df")
    mean = words / max(count, 1)

    def index(own: pa.Table, known: pa.Table) -> pa.Table:
        lot = sorted(zip(own["item_id"].to_pylist(), own["text"].to_pylist()))
        term = known["term"].to_numpy().view(np.uint64)
        order = np.argsort(term)
        made = build(lot, Statistics(count, mean, term[order], known["df"].to_numpy()[order]))
        return pa.table({"data": pa.array([pickle.dumps(made)], pa.binary()), "shard": own["shard"][:1]})

    made = rows.groupBy("shard").cogroup(df.groupBy("shard")).applyInArrow(index, "data binary, shard long")
    path = f"{scratch.folder}/items-{uuid.uuid4().hex[:8]}"
    made.write.partitionBy("shard").parquet(path)
    return Shards(spark, path)


FIELDS = "doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def matches(frame: DataFrame, indexes: Sequence[Index], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item found in it, with the best passage."""
    source = identified(frame, key, text)
    return reduce(DataFrame.unionAll, [_matches(source, index) for index in indexes])


def _matches(source: DataFrame, index: Index) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(index)

    def search(batches):
        index = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                found = index.verified(*_hashed(part.column(1)))
                ids = part.column(0)
                columns = list(zip(*found)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(columns[0], pa.int64())),
                        pa.array(index.item_id[np.array(columns[1], np.int64)], pa.int64()),
                        *(pa.array(columns[k], pa.float64()) for k in (2, 3, 4)),
                        pa.array(columns[5], pa.int64()),
                    ],
                    names=[f.split()[0] for f in FIELDS.split(", ")],
                )

    return source.mapInArrow(search, FIELDS.format(kind=source.schema["doc_id"].dataType.simpleString()))


def find(spark: SparkSession, folder: str) -> DataFrame:
    return matches(documents(spark, folder), shards(spark.read.parquet(f"{folder}/benchmark.parquet")))


def clean(frame: DataFrame, indexes: Sequence[Index], text: str = "text") -> DataFrame:
    """The rows whose text matches no item, with their own columns only."""
    for index in indexes:
        shared = frame.sparkSession.sparkContext.broadcast(index)

        def compute(batch: pa.RecordBatch, shared=shared) -> dict:
            found = shared.value.verified(*_hashed(batch.column(batch.schema.get_field_index(text))))
            bad = np.zeros(batch.num_rows, bool)
            bad[[f[0] for f in found]] = True
            return {"__leak": pa.array(bad)}

        frame = append(frame, text, {"__leak": "boolean"}, compute).where(~F.col("__leak")).drop("__leak")
    return frame
