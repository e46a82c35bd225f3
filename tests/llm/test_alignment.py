"""Alignment of two tokenizers against a plain version that walks the bytes."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from navspark.llm import token_alignment as ta

from . import cases

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    return ta.read_file(BYTE), ta.read_file(PIECE)


def byte_of():
    """The usual table of byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table, extra = {}, 0
    for b in range(256):
        if b in plain:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return table


def tokens(texts):
    """Per text the (id, bytes) of both tokenizers, by the libraries."""
    a, b, table = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE), byte_of()
    a.encode_special_tokens = True
    for text in texts:
        if not text:
            yield [], []
            continue
        one = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(table[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        same = b"".join(x for _, x in left) == want == b"".join(x for _, x in right)
        yield (left, right) if same else ([], [])


def groups_of(left, right):
    ends = []
    for side in (left, right):
        at, own = 0, []
        for _, raw in side:
            at += len(raw)
            own.append(at)
        ends.append(own)
    common = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in common]
    for side, own, k in ((left, ends[0], 0), (right, ends[1], 1)):
        for (i, _), e in zip(side, own):
            out[next(n for n, c in enumerate(common) if c >= e)][k].append(i)
    return out


def plain(rows):
    found = [(k, *ab, groups_of(*ab)) for (k, _), ab in zip(rows, tokens([t for _, t in rows]))]
    links = [Counter(p for x, y in groups for i in x for p in ((i, j) for j in y)) for *_, groups in found]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (k, a, b, groups), own in zip(found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            k, len(a), len(b), len(groups), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in own.items()), cases.sha(text) if text else "",
        ))
    return sorted(out), count, best


WILD = ["Ünïcödé ﬁ ​ x", "<|endoftext|> <s> <unk> <0x0A>", "a\0b", "▁ marks ▁", "  two  spaces  ", "\t\n\r\n", "😀👩‍👩‍👧 漢字かな交じり文", "x" * 700, " ", "don't we'll 1234567"]


@pytest.fixture(scope="module")
def docs():
    kept = [(r[0], r[1] if r[1] is None else r[1][:3000]) for r in cases.documents()]
    return kept + [(500 + i, t) for i, t in enumerate(WILD)]


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, groups_sha256 string, block int, at int")


@pytest.mark.parametrize("block, lot", [(2000, 7), (ta.BLOCK_BYTES, ta.LOT)])
def test_digests_and_counts(spark, docs, files, monkeypatch, block, lot):
    monkeypatch.setattr(ta, "BLOCK_BYTES", block)
    monkeypatch.setattr(ta, "LOT", lot)
    frame = frame_of(spark, docs).repartition(3)
    want, count, best = plain(docs)
    assert sorted(tuple(r) for r in ta.digests(frame, *files).collect()) == want
    if block == 2000:
        found = ta.Alignment(frame, (ta.ByteTokens, files[0]), (ta.PieceTokens, files[1])).link_counts().collect()
        assert {(r.a, r.b): (r.n, r.best) for r in found} == {p: (n, n == best[p[0]]) for p, n in count.items()}


def test_given_documents(spark, data, files):
    frame = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text[:2000]) for r in frame.collect()]
    assert sorted(tuple(r) for r in ta.digests(frame_of(spark, rows), *files).collect()) == plain(rows)[0]


def test_groups_of_rows(spark, docs, files):
    frame = frame_of(spark, docs).repartition(3)
    found = ta.groups(frame, (ta.ByteTokens, files[0]), (ta.PieceTokens, files[1]))
    assert found.columns[: len(frame.columns)] == frame.columns
    want = {k: groups_of(*ab) for (k, _), ab in zip(docs, tokens([t for _, t in docs])) if k != 99}
    for r in found.collect():
        groups = [([], []) for _ in range(max([-1, *r.a_groups]) + 1)]
        for k, (ids, own) in enumerate(((r.a_ids, r.a_groups), (r.b_ids, r.b_groups))):
            for i, g in zip(ids, own):
                groups[g][k].append(i)
        if r.doc_id != 99:
            assert groups == want[r.doc_id]


def test_no_rows_and_other_keys(spark, files):
    frame = spark.createDataFrame([(None, "a text"), ("k", None)], "doc_id string, text string")
    assert ta.digests(frame.limit(0), *files).collect() == []
    got = {r.doc_id: tuple(r)[1:] for r in ta.digests(frame, *files).collect()}
    assert got["k"] == (0, 0, 0, 0, 0, 0, "") and got[None][0] == 2
    assert [tuple(r) for r in ta.digests(frame.where("text IS NULL"), *files).collect()] == [("k", 0, 0, 0, 0, 0, 0, "")]


def test_pointers_jump_to_the_end_of_a_long_group():
    """One group of interleaved tokens over the whole range ends in one terminal."""
    rng = random.Random(4)
    for n in (1, 2, 50, 3001):
        odd, even = list(range(1, 2 * n, 2)), list(range(2, 2 * n, 2))
        a, b = ta.terminals(np.array([*odd, 2 * n]), np.array([*even, 2 * n]))
        assert set(a.tolist()) | set(b.tolist()) == {len(even)}
    ends = [sorted({*rng.sample(range(1, 400), 150), 400}) for _ in range(2)]
    a, b = ta.terminals(*(np.array(e) for e in ends))
    common = sorted(set(ends[0]) & set(ends[1]))
    for own, last in zip(ends, (a, b)):
        assert [ends[1][t] for t in last.tolist()] == [next(c for c in common if c >= e) for e in own]


def test_byte_tokens_equal_the_library(files):
    fast, exact = ta.ByteTokens(files[0]), Tokenizer.from_file(BYTE)
    exact.encode_special_tokens = True
    assert fast.fast is not None
    rng = random.Random(9)
    texts = ["".join(rng.choices(" \n\ta1'é漢😀 　s.t<|", k=80)) for _ in range(400)]
    texts += ["".join(chr(c) for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(1, 0x20000, 64)]
    for text in texts:
        assert fast.encode([text])[0] == exact.encode(" " + text, add_special_tokens=False).ids
    fast.fast = None
    assert fast.encode(texts[:5]) == [exact.encode(" " + t, add_special_tokens=False).ids for t in texts[:5]]
