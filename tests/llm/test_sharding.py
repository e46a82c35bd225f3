"""Sharding by histogram sort: whole rows, exact slots, one order, borders as near as rows allow."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from navspark.llm import histogram_shards as hs

from . import cases


def sized(rows):
    return sorted((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)


def check(frame, rows, shards, tolerance=hs.TOLERANCE, **more):
    got = hs.assigned(frame, shards, tolerance, **more).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sized(rows)
    assert {r.shard for r in got} <= set(range(shards))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r["size"]))
    for own in slots.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    # Each border is within the tolerance of its aim, or at the nearest edge of a row.
    sizes = [sum(z for _, z in slots[k]) for k in range(shards)]
    total, before = sum(sizes), 0
    order = np.cumsum([0, *(z for k in range(shards) for _, z in sorted(slots[k]))])
    for k in range(1, shards):
        before += sizes[k - 1]
        aim = total * k // shards
        off = abs(before - aim)
        assert off <= max(total / shards * tolerance, np.abs(order - aim).min())
    return got


@pytest.fixture(scope="module")
def wild():
    return [(r[0], r[1]) for r in cases.documents()]


def test_wild_rows(spark, wild):
    frame = spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(5)
    check(frame, wild, 7)
    check(frame, wild, 40)
    assert hs.digests(frame).columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_one_text_and_one_row_hold_a_third_each(spark):
    rng = random.Random(2)
    rows = [(i, "the same text " * 5) for i in range(600)]
    rows += [(9999, "one row many times")] * 900
    rows += [(1000 + i, cases.words(rng.randint(0, 60), i)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = check(frame, rows, 12)
    assert check(frame, rows, 12, range_bytes=500)
    # Copies stand side by side: those of one text lie in neighbouring shards only.
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(max(s) - min(s) == len(s) - 1 for s in where.values())
    spread = Counter(len(s) for s in where.values())
    assert spread[1] >= len(where) - 11


def test_one_exact_order(spark, data):
    """With ranges inside shards, slots follow the same order as without."""
    frame = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    one = {(r.doc_id): (r.shard, r.slot) for r in check(frame, rows, 5)}
    two = {(r.doc_id): (r.shard, r.slot) for r in check(frame, rows, 5, range_bytes=2000)}
    assert one == two


def test_any_key_and_no_rows(spark):
    rows = [(None, "a"), ("x", None), ("x", None), ("y", "")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = hs.assigned(frame, 3).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter([(None, 17), ("x", 16), ("x", 16), ("y", 16)])
    assert hs.assigned(frame.limit(0), 3).collect() == []
    assert {(r.shard, r.slot) for r in hs.assigned(frame.where("text = 'a'"), 1).collect()} == {(0, 0)}


def test_written_shards(spark, wild, tmp_path):
    frame = spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(5)
    hs.write(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*frame.columns, "shard"}
    assert Counter(tuple(r) for r in back.select(*[f"`{c}`" for c in frame.columns]).collect()) == Counter(tuple(r) for r in frame.collect())
    sizes = {r[0]: r[1] for r in back.groupBy("shard").count().collect()}
    assert sizes == Counter(r.shard for r in hs.assigned(frame, 4).collect())


def test_probes_passed():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(3)]
    probes = sorted({tuple(int(x) for x in rng.integers(0, 4, 3)) for _ in range(20)})
    number = [(a << 128) | (b << 64) | c for a, b, c in probes]
    want = [sum(p <= row for p in probes) for row in zip(*(c.tolist() for c in columns))]
    assert hs.passed(columns, hs._parts(number)).tolist() == want
