"""Ranked lexical search against a plain version of the score."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from navspark.llm import lexical_search as ls

from . import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(cases.A_TO_Z))


def plain(docs, items, top=10):
    found = [(k, Counter(terms(t))) for k, t in docs]
    n = sum(1 for _, c in found if c)
    total = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in found:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * times * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, times in Counter(terms(text)).items() if c[t]
            )
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scored)[:top], start=1)]
    return sorted(out, key=str)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [
    (1, "a row that is there twice"), (2, None), (3, ""), (4, " ,;. "), (5, "漢字 END end é"), (6, "absent nowhere"),
    (7, cases.words(70, 1)), (8, "one ONE two"), (8, "line"), (9, "one ONE two"), (None, "call one"), (10, cases.words(300, 2)),
]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(4), spark.createDataFrame(items, "item_id long, text string, rank int, score int")


@pytest.mark.parametrize("block", [200, ls.BLOCK_BYTES])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(ls, "BLOCK_BYTES", block)
    docs = [(r[0], r[1]) for r in cases.documents()]
    docs += [(None, "one two"), (None, "one two three"), *((1000 + i, f"{cases.words(6, i % 7)} one line end") for i in range(60))]
    left, right = frames(spark, [(*d, 0) for d in docs], [(*i, 0, 0) for i in ITEMS])
    assert rows(ls.search(left, right)) == plain(docs, ITEMS)
    assert rows(ls.search(left, right, top=2)) == plain(docs, ITEMS, 2)


def test_search_in_shards(spark, monkeypatch):
    monkeypatch.setattr(ls, "SHARD_BYTES", 100)
    docs = [(r[0], r[1]) for r in cases.documents()]
    left, right = frames(spark, [(*d, 0) for d in docs], [(*i, 0, 0) for i in ITEMS])
    assert rows(ls.search(left, right)) == plain(docs, ITEMS)


def test_search_of_nothing(spark):
    docs = [(1, "one"), (2, None)]
    left, right = frames(spark, [(*d, 0) for d in docs], [(1, "one", 0, 0)])
    assert rows(ls.search(left.limit(0), right)) == []
    assert rows(ls.search(left, right.limit(0))) == []
    assert rows(ls.search(left.where("text IS NULL"), right)) == []


def test_accumulators_end_and_survivors_stay_exact(monkeypatch):
    """After good blocks, a block of poor documents makes no accumulators, and a mixed one keeps exact scores."""
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(30)]
    good = [" ".join(["rare", "odd", *rng.choice(common, 8)]) for _ in range(20)]
    poor = [" ".join(rng.choice(common, 10)) for _ in range(200)]
    mixed = poor[:100] + ["rare odd " + " ".join(common)] * 3
    text = "rare odd " + " ".join(common[:10])
    docs = list(enumerate(good + poor + mixed))
    vocabulary = ls.terms_of(pa.array([text]))[0].unique()
    whole = ls.lists_of(pa.array([t for _, t in docs]), vocabulary)
    corpus = ls.Corpus(len(docs), int(whole.lengths.sum()), np.diff(whole.first))
    queries = ls.prepared([text], vocabulary, corpus, 10)
    made = []
    inner = ls.Queries._query
    monkeypatch.setattr(ls.Queries, "_query", lambda self, q, *a: (r := inner(self, q, *a), made.append(len(r[0])))[0])
    found, at = [], 0
    for block in (good, poor, mixed):
        lists = ls.lists_of(pa.array(block), vocabulary)
        _, doc, score = queries.search(lists, corpus, np.arange(len(block)))
        found += [(-s, at + d) for d, s in zip(doc.tolist(), score.tolist())]
        at += len(block)
    assert [(1, r, k, -s) for r, (s, k) in enumerate(sorted(found)[:10], start=1)] == sorted(plain(docs, [(1, text)]), key=lambda r: r[1])
    assert sum(made) < 40  # of 323 documents, all of which hold a term of the query
