"""Ranked lexical search: accumulator-limited term-at-a-time scoring, rarest term first.

A statistics pass counts documents, terms and document frequencies over the whole table. Then every
task works through its documents in blocks. A block gets an inverted list for each term that some
query holds, and the list's largest contribution. A query takes its terms rarest first. While a document
without an accumulator could still reach the query's kth best score, each posting makes or raises an
accumulator. As soon as the bounds of the terms that are left stay below the kth score, no more are made:
the survivors, those that can still reach it, get the rest of their terms by lookup and end exact. The
kth score is the larger of that of the task's earlier blocks and that of the block's partial scores, so
later blocks mostly meet queries whose bounds are below it from the start.

A block hands on at most k documents a query, and only such as reach the kth score of the blocks before.
They are ranked in two steps, by query and task group and then by query, so no task gathers a query's
candidates of the whole corpus.

Scores are 64-bit integers and compared exactly; equal scores rank by ascending key, null keys last, so
results don't depend on blocks or tasks. Null, empty and term-free texts hold no terms: such documents are
never found, such queries find nothing. Repeated rows are documents of their own, also under one key.
Queries of equal text are searched once and each gets all ranks; a query row that is there twice, or two
texts under one id, are ranked each for itself. A very long document is a block alone. An empty table
of either side gives no rows. Other columns are not read.

Distinct query texts go to the tasks in shards of a bounded size, one scan of the documents for each.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from navspark.llm.text import LOWER, identified, ship, steps, texts_of, words_of

TOP = 10
#: Weights of term frequency and document length; the length counts in hundredths.
K_TENTHS, LENGTH_SHARE = 8, 75
#: Bytes of query text that one scan of the documents serves.
SHARD_BYTES = 8 << 20
#: Bytes of text in a block of documents.
BLOCK_BYTES = 1 << 20
#: Groups of tasks in which candidates are ranked before they are ranked for good.
TASK_GROUPS = 64

_TERM = LOWER.copy()
_TERM[[c for c in range(128) if not chr(c).isalnum()]] = 32


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows as binary values, and the number of terms before each row (one more than rows)."""
    data, offs = texts_of(column)
    data = _TERM[data]
    starts, ends, first = words_of(data, offs)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    inner = np.ascontiguousarray(data[data != 32])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(inner)]), first


@dataclass
class Lists:
    """Postings of the query terms in a block, by term and then document: document, frequency; where each term begins."""

    doc: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    lengths: np.ndarray


def lists_of(column: pa.Array, vocabulary: pa.Array) -> Lists:
    terms, first = terms_of(column)
    rows = len(first) - 1
    at = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    hit = np.flatnonzero(at >= 0)
    row = np.searchsorted(first, hit, "right") - 1
    key, tf = np.unique(at[hit] * max(rows, 1) + row, return_counts=True)
    term = key // max(rows, 1)
    return Lists(key - term * rows, tf.astype(np.int64), np.searchsorted(term, np.arange(len(vocabulary) + 1)), np.diff(first))


@dataclass
class Corpus:
    """Documents with a term, their terms with repeats, and the documents that hold each term of the vocabulary."""

    documents: int
    terms: int
    df: np.ndarray


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Queries:
    """Terms of each query, rarest first, with weight times frequency in the query, flat."""

    term: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    top: int
    kth: np.ndarray = field(init=False)
    best: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.restart()

    def restart(self) -> None:
        """Forgets the scores of earlier blocks."""
        n = len(self.first) - 1
        self.kth = np.ones(n, np.int64)
        self.best = [np.empty(0, np.int64)] * n

    def search(self, lists: Lists, corpus: Corpus, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document and score of the block's candidates. rank: place of each document's key in key order."""
        none = (np.empty(0, np.int64),) * 3
        if not len(lists.doc) or not len(self.term):
            return none
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * lists.lengths * corpus.documents // corpus.terms
        gain = 1_000_000_000 * lists.tf // (1000 * lists.tf + K_TENTHS * m[lists.doc])
        sizes = np.diff(lists.first)
        most = np.zeros(len(sizes), np.int64)
        held = np.flatnonzero(sizes)
        most[held] = np.maximum.reduceat(gain, lists.first[held])
        # Bounds of a query's terms from each one on.
        bound = self.weight * most[self.term]
        sums = np.append(0, np.cumsum(bound))
        left = sums[self.first[1:]][np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))] - sums[:-1]
        full = sums[self.first[1:]] - sums[self.first[:-1]]
        posting = (np.repeat(np.arange(len(sizes)), sizes) * len(lists.lengths)) + lists.doc
        found = []
        score = np.zeros(len(lists.lengths), np.int64)
        for q in np.flatnonzero(full >= self.kth).tolist():
            a, b = int(self.first[q]), int(self.first[q + 1])
            here = a + np.flatnonzero(bound[a:b])
            docs, scores = self._query(q, here, left, lists, gain, posting, score)
            if len(docs):
                docs, scores = self._best(q, docs, scores, rank)
                found.append((np.full(len(docs), q), docs, scores))
        if not found:
            return none
        return tuple(np.concatenate(x) for x in zip(*found))

    def _query(self, q, here, left, lists, gain, posting, score) -> tuple[np.ndarray, np.ndarray]:
        """Documents with an accumulator that can be among the best, and their exact scores."""
        kth = int(self.kth[q])
        for at, k in enumerate(here.tolist()):
            if left[k] < kth:
                break
            t = self.term[k]
            lo, hi = lists.first[t], lists.first[t + 1]
            score[lists.doc[lo:hi]] += self.weight[k] * gain[lo:hi]
            if len(score) > self.top:
                kth = max(kth, int(np.partition(score, len(score) - self.top)[len(score) - self.top]))
        else:
            at = len(here)
        rest = here[at:]
        after = int(left[rest[0]]) if len(rest) else 0
        docs = np.flatnonzero((score > 0) & (score + after >= kth))
        scores = score[docs]
        score[:] = 0
        if len(rest) and len(docs):
            terms = self.term[rest]
            asked = (terms[None, :] * len(lists.lengths) + docs[:, None]).ravel()
            place = np.minimum(np.searchsorted(posting, asked), len(posting) - 1)
            more = np.where(posting[place] == asked, gain[place], 0).reshape(len(docs), -1)
            scores = scores + (more * self.weight[rest]).sum(1)
        keep = scores >= self.kth[q]
        return docs[keep], scores[keep]

    def _best(self, q, docs, scores, rank) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank[docs], -scores))[: self.top]
        docs, scores = docs[order], scores[order]
        kept = np.sort(np.append(self.best[q], scores))[-self.top :]
        self.best[q] = kept
        if len(kept) == self.top:
            self.kth[q] = kept[0]
        return docs, scores


def prepared(texts: list[str], vocabulary: pa.Array, corpus: Corpus, top: int) -> Queries:
    terms, first = terms_of(pa.array(texts, pa.string()))
    at = pc.index_in(terms, value_set=vocabulary).to_numpy()
    weights = [weight(corpus.documents, int(n)) for n in corpus.df]
    term, value, bounds = [], [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        # A term that no document holds scores nothing.
        own = sorted(((int(corpus.df[t]), int(t), n) for t, n in Counter(at[a:b].tolist()).items() if corpus.df[int(t)]))
        term += [t for _, t, _ in own]
        value += [weights[t] * n for _, t, n in own]
        bounds.append(len(term))
    return Queries(np.array(term, np.int64), np.array(value, np.int64), np.array(bounds, np.int64), top)


def statistics(source: DataFrame, vocabulary: pa.Array) -> Corpus:
    """Counts over all documents; one row per task and term reaches the sum."""
    shared = source.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        words = shared.value
        n = np.zeros(len(words) + 2, np.int64)
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                lists = lists_of(part.column(1), words)
                n[:-2] += np.diff(lists.first)
                n[-2] += np.count_nonzero(lists.lengths)
                n[-1] += lists.lengths.sum()
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["term", "n"])

    rows = source.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per query term
    n = np.zeros(len(vocabulary) + 2, np.int64)
    for r in rows:
        n[r.term] = r.n
    shared.unpersist()
    return Corpus(int(n[-2]), int(n[-1]), n[:-2])


def _candidates(source: DataFrame, texts: list[tuple[str, str]], top: int) -> DataFrame:
    """query (its digest), doc_id, score and task group of what the blocks hand on."""
    spark = source.sparkSession
    vocabulary = pc.unique(terms_of(pa.array([t for _, t in texts], pa.string()))[0])
    corpus = statistics(source, vocabulary)
    queries = prepared([t for _, t in texts], vocabulary, corpus, top)
    shared = spark.sparkContext.broadcast((vocabulary, corpus, queries, pa.array([d for d, _ in texts], pa.string())))
    names = ["query", "doc_id", "score", "tasks"]

    def search(batches):
        words, corpus, queries, digests = shared.value
        queries.restart()
        group = TaskContext.get().partitionId() % TASK_GROUPS
        for batch in batches:
            for part in steps(batch, "text", BLOCK_BYTES):
                ids = part.column(0)
                rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
                q, doc, score = queries.search(lists_of(part.column(1), words), corpus, rank)
                columns = [digests.take(pa.array(q)), ids.take(pa.array(doc)), pa.array(score), pa.array(np.full(len(q), group, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(search, f"query string, doc_id {kind}, score long, tasks int")


def search(
    frame: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's `top` best documents with a score above 0."""
    spark = frame.sparkSession
    ship(spark)
    source = identified(frame, key, text)
    asked = items.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    asked = asked.where("text <> ''").withColumn("query", F.sha2("text", 256))
    distinct = asked.groupBy("query").agg(F.first("text").alias("text"))
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    found = None
    for k in range(shards):
        lot = distinct.where(F.pmod(F.xxhash64("query"), F.lit(shards)) == k)
        texts = sorted((r.query, r.text) for r in lot.collect())  # about SHARD_BYTES
        part = _candidates(source, texts, top)
        found = part if found is None else found.unionAll(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    near = Window.partitionBy("query", "tasks").orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
    return asked.select("item_id", "query").join(ranked, "query").select("item_id", "rank", "doc_id", "score")
