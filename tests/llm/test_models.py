"""Trained and searching operators: held-out accuracy, exact search, planted cases, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from navspark.llm import decontaminate, ngram_join, pii, quality_fm, sentencepiece_codec, toxicity_knn
from navspark.llm.queries import QUERIES

from . import cases

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(5)


def test_quality_on_held_out_rows(spark, docs):
    machine = quality_fm.fit(spark, LARGER)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    scored = quality_fm.judged(spark.read.parquet(f"{LARGER}/documents.parquet"), machine).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert len(scored) == 1000 and np.mean([p == y for p, y in held]) > 0.95
    out = quality_fm.judged(docs, machine).collect()
    assert len(out) == len(cases.documents()) and all(0 <= r.score <= 1 for r in out)
    assert quality_fm.accepted(docs, machine).columns == docs.columns
    assert quality_fm.accepted(docs.limit(0), machine).collect() == []


def test_pair_sum_equals_the_sum_over_all_pairs():
    texts = pa.array([cases.words(30, 3), "", None, "one"])
    buckets, first, table = quality_fm.inputs(texts)
    rng = np.random.default_rng(1)
    size = quality_fm.BUCKETS + len(quality_fm.STATISTICS)
    n = len(quality_fm.STATISTICS)
    m = quality_fm.Machine(0.1, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros(n), np.ones(n))
    raw = m.raw(buckets, first, table)[0]
    for r in range(len(texts)):
        own = buckets[first[r] : first[r + 1]]
        x = np.append(np.full(len(own), 1 / np.sqrt(max(len(own), 1))), np.clip(table[r], -6, 6))
        at = np.append(own, quality_fm.BUCKETS + np.arange(n))
        v = m.factor[at] * x[:, None]
        pairs = sum(v[i] @ v[j] for i in range(len(x)) for j in range(i))
        assert np.isclose(raw[r], 0.1 + m.weight[at] @ x + pairs)


def test_machine_without_rows():
    machine = quality_fm.fit_machine([])
    assert np.allclose(machine.scores(pa.array(["a b", None])), 0.5, atol=0.05)


def test_toxicity_on_held_out_rows(spark, docs):
    index = toxicity_knn.fit(spark, LARGER)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    scored = toxicity_knn.judged(spark.read.parquet(f"{LARGER}/documents.parquet"), index).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.93
    assert {e for r in scored for e in r.evidence} <= {k for k in labels if not any(r.held_out for r in scored if r.doc_id == k)}
    out = {r.doc_id: r for r in toxicity_knn.judged(docs, index).collect()}
    assert out[31].predicted == 1 and out[10].score == out[11].score < 0.5


def test_nearest_examples_are_exact():
    rng = random.Random(5)
    vocabulary = [f"w{i}x" for i in range(40)]
    examples = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(300)]
    known = np.unique(toxicity_knn.terms_of(pa.array([" ".join(vocabulary)]))[0])
    idf = np.linspace(1, 3, len(known))
    row, term, count = toxicity_knn.term_counts(pa.array(examples), known)
    label = np.random.default_rng(1).integers(0, 2, 300)
    index = toxicity_knn.build(known, idf, np.arange(300), label, row, term, count, 0.1)
    queries = [" ".join(rng.choices([*vocabulary, "zz"], k=rng.randint(0, 9))) for _ in range(200)] + ["", None]

    def dense(texts):
        r, t, c = toxicity_knn.term_counts(pa.array(texts), known)
        out = np.zeros((len(texts), len(known)))
        out[r, t] = (1 + np.log(c)) * idf[t]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    sims = dense(queries) @ dense(examples).T
    row, _, found = index.nearest(pa.array(queries))
    for i in range(len(queries)):
        want = np.sort(sims[i][sims[i] > 1e-12])[::-1][: toxicity_knn.NEIGHBOURS]
        assert np.allclose(want, found[row == i])


def items(spark, data):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]


def test_benchmark_items_are_found(spark, data):
    tests = items(spark, data)
    index = decontaminate.build([*tests, (900, ""), (901, "...")])
    rng = random.Random(3)
    texts = [f"{cases.words(rng.randint(0, 150), i)} {t} {cases.words(rng.randint(0, 150), -i)}" for i, t in tests]
    clean = [cases.words(200, 1000 + i) for i in range(50)]
    edge = [(5000, None), (5001, ""), (5002, "x" * 100_000), (5003, "a a a " * 5000)]
    frame = spark.createDataFrame([*zip([i for i, _ in tests], texts), *enumerate(clean, 3000), *edge], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, [index]).collect()}
    assert {(i, i) for i, _ in tests} <= found and all(d < 1000 for d, _ in found)
    kept = {r.doc_id for r in decontaminate.clean(frame.withColumn("score", frame.doc_id), [index]).collect()}
    assert kept == {r.doc_id for r in frame.collect()} - {d for d, _ in found}
    assert decontaminate.matches(frame, [decontaminate.build([])]).collect() == []


def test_retrieval_is_exact(spark, data):
    """Every passage and item above the threshold, as a plain BM25 finds them."""
    tests = items(spark, data)
    index = decontaminate.build(tests)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()] + [tests[0][1] * 3]
    words, first = decontaminate.hashed(texts)
    got = {(r, s - first[r], i): round(x, 6) for r, s, i, x in zip(*(a.tolist() for a in index.retrieve(words, first)))}
    impact = {}
    for t in range(len(index.terms)):
        for p in range(index.term_first[t], index.term_first[t + 1]):
            for q in range(index.pair_first[p], index.pair_first[p + 1]):
                impact.setdefault(int(index.terms[t]), {})[int(index.item[q])] = index.impact[q]
    want = {}
    for r in range(len(texts)):
        own = words[first[r] : first[r + 1]].tolist()
        start = 0
        while start == 0 and own or start < len(own) and start + decontaminate.PASSAGE - decontaminate.STRIDE < len(own):
            score = {}
            for t in set(own[start : start + decontaminate.PASSAGE]):
                for i, x in impact.get(t, {}).items():
                    score[i] = score.get(i, 0) + x
            want |= {(r, start, i): round(x, 6) for i, x in score.items() if x >= index.threshold[i]}
            start += decontaminate.STRIDE
    assert got == want


def test_items_in_shards(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    tests = spark.read.parquet(f"{data}/benchmark.parquet")
    one = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(frame, decontaminate.shards(tests)).collect())
    kept, decontaminate.SHARD_BYTES = decontaminate.SHARD_BYTES, 2000
    try:
        indexes = decontaminate.shards(tests)
        many = {(r.doc_id, r.item_id) for r in decontaminate.matches(frame, indexes).collect()}
    finally:
        decontaminate.SHARD_BYTES = kept
    texts = {r.doc_id: r.text for r in frame.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items(spark, data) if t and x in t}
    assert len(indexes) > 1 and whole <= set(one) and whole <= many


def test_long_items_are_found(spark):
    """Copied word for word at any offset, items of any length are found, in one shard and in many."""
    rng = random.Random(8)
    vocabulary = cases.words(4000, 9).split()
    draw = lambda n: " ".join(vocabulary[int(len(vocabulary) * rng.random() ** 3)] for _ in range(n))
    sizes = [1, 30, 64, 65, 100, 200, 250, 300, 400, 800, 2000] * 3
    tests = [(i, f"{draw(n)}. {draw(12)}") for i, n in enumerate(sizes)]
    texts = [(i, f"{draw(rng.randint(0, 150))} {t} {draw(rng.randint(0, 150))}") for i, t in tests]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([*tests, (500, ""), (None, "no"), (501, None)], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.matches(frame, decontaminate.shards(table)).collect()))
    assert {(i, i) for i, _ in tests} <= {(d, i) for d, i, *_ in one}
    kept, decontaminate.SHARD_BYTES = decontaminate.SHARD_BYTES, 9000
    try:
        indexes = decontaminate.shards(table)
        many = sorted(map(tuple, decontaminate.matches(frame, indexes).collect()))
    finally:
        decontaminate.SHARD_BYTES = kept
    assert len(indexes) > 2 and many == one
    assert len(decontaminate.shards(table.limit(0))) == 1
    words = decontaminate.hashed([tests[9][1]])[0].tolist()
    impact = {w: rng.random() for w in words}
    runs = [sum(impact[w] for w in set(words[k : k + 64])) for k in range(len(words) - 63)]
    assert np.isclose(decontaminate.best_run(np.array(words), np.array([impact[w] for w in words])), max(runs))


def test_queries_give_one_row_per_document(spark, data):
    count = spark.read.parquet(f"{data}/documents.parquet").count()
    for name in ("op1_toxicity", "op5_substring_dedup", "op8_quality", "op10_pii"):
        out = QUERIES[name](spark, data)
        assert out.count() == count and "doc_id" in out.columns


def test_pipeline_equals_its_plain_version(spark, data):
    """Each stage on the whole input of the one before; every decision takes effect."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    machine = quality_fm.fit(spark, data)
    start = docs.collect()
    scores = machine.scores(pa.array([r.text for r in start]))
    rows = [r for r, s in zip(start, scores) if s >= quality_fm.ACCEPT]
    root = cases.components([(r.doc_id, cases.shingles(r.text, 5)) for r in rows], 8, 10)
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    index = decontaminate.shards(spark.read.parquet(f"{data}/benchmark.parquet"))[0]
    leaks = {f[0] for f in index.verified(*decontaminate.hashed([r.text for r in rows]))}
    rows = [r for i, r in enumerate(rows) if i not in leaks]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.read_model(corpus_pipeline.tokenizer_path()))
    want = []
    for r in rows:
        text = pii.masked(r.text)
        ids = codec.ids(text)
        want.append((r.doc_id, text, r.lang, r.source, len(text), ids, len(ids), cases.sha(codec.decode(ids))))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect())
    assert got == sorted(want) and 0 < len(got) < len(start)


def test_near_duplicates_of_the_pipeline(spark, data):
    """Five words and 0.8 by brute force, on the table and on pairs between both contracts."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    for k, n in enumerate((12, 30, 60, 100, 200, 400)):
        base = [f"w{k}x{i}" for i in range(n)]
        for j, cut in enumerate(range(max(1, n // 16), n // 3, max(1, n // 20))):
            docs += [(10**6 + 1000 * k + 2 * j + s, f"p{k}{j} " * 3 + " ".join(f"j{j}{w}" for w in base[: n - s * cut])) for s in (0, 1)]
    sets = {}
    for key, text in docs:
        w = cases.WORD.findall((text or "").translate(cases.A_TO_Z))
        sets[key] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}
    order = sorted(sets)
    by_shingle = {}
    for k in order:
        for x in sets[k]:
            by_shingle.setdefault(x, []).append(k)
    for a, b in {(a, b) for own in by_shingle.values() for a in own for b in own if a < b}:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            low, high = sorted((up[a], up[b]))
            up = {k: low if r == high else r for k, r in up.items()}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, data).collect()}
    assert got == {k for k in order if up[k] == k}
    assert got != {r.doc_id for r in ngram_join.one_of_each(frame).collect()}


def test_stages_keep_the_columns(spark, data, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (docs, docs.limit(0)):
            out = stage(spark, frame, data)
            assert out.columns == frame.columns and out.count() <= frame.count(), name
    assert ngram_join.one_of_each(docs.limit(0)).collect() == []


def test_null_keys(spark, data):
    frame = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, "a b c d e f")], "doc_id long, text string")
    for name, operate in (
        ("pii", pii.find),
        ("join", ngram_join.linked_components),
        ("one", ngram_join.one_of_each),
    ):
        assert operate(frame).count() == 3, name


def test_scores_in_small_lots_and_sparse_tables(data, monkeypatch):
    """However postings are dealt to lots, and whether a table is laid out whole, the same matches come out."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{data}/benchmark.parquet")
    index = decontaminate.build(list(zip(table["item_id"].to_pylist(), table["text"].to_pylist())))
    texts = [t or "" for t in pq.read_table(f"{data}/documents.parquet")["text"].to_pylist()]
    words = decontaminate.hashed(texts)
    want = [x.tolist() for x in index.retrieve(*words)]
    for lot in (1, 500):
        monkeypatch.setattr(decontaminate, "LOT", lot)
        assert [x.tolist() if i < 3 else x.round(9).tolist() for i, x in enumerate(index.retrieve(*words))] == [
            *want[:3], [round(s, 9) for s in want[3]]
        ]
    assert len(want[0]) > 0


def test_decontamination_follows_the_key(spark):
    passage = "what is the capital of the far country of borduria and who built it. it is called szohod"
    frame = spark.createDataFrame([("a", passage), (None, passage), ("b", "nothing")], "doc_id string, text string")
    index = decontaminate.build([(1, passage)])
    assert sorted(str(r.doc_id) for r in decontaminate.matches(frame, [index]).collect()) == ["None", "a"]
