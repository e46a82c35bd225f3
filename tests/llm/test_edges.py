"""Empty tables, null and repeated keys, and extra columns, for every operator on rows."""

from __future__ import annotations

import public_tokenizers
import pytest

import corpus_pipeline
from navspark.llm import (
    decontaminate, histogram_shards, ngram_join, pii, quality_fm, sentencepiece_codec, suffix_dedup, token_alignment, toxicity_knn,
    window_dedup,
)

from . import cases

PIECE = public_tokenizers.path("piece_bpe_32k.model")
TEXT = "what is the capital of the far country of borduria and who built it. it is called szohod"


@pytest.fixture(scope="module")
def operators(spark, data):
    model = sentencepiece_codec.read_model(PIECE)
    files = token_alignment.read_file(public_tokenizers.path("byte_bpe_50k.json")), token_alignment.read_file(PIECE)
    machine, index = quality_fm.fit(spark, data), toxicity_knn.fit(spark, data)
    return {
        "op1": lambda f: toxicity_knn.judged(f, index), "op2": ngram_join.linked_components, "op5": window_dedup.deduplicate,
        "op7": lambda f: sentencepiece_codec.encoding_digests(f, model), "op8": lambda f: quality_fm.judged(f, machine),
        "op9": suffix_dedup.deduplicate, "op10": pii.find, "op12": lambda f: token_alignment.digests(f, *files),
        "op13": histogram_shards.digests,
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op7", "op8", "op9", "op10", "op12", "op13"])
def test_rows_of_any_kind(spark, operators, name):
    """One row comes out for each that goes in, whatever its key; an empty table gives none."""
    rows = [(None, TEXT), (5, TEXT), (5, "unlike"), (5, TEXT), (6, None), (None, ""), (7, "x " * 5000)]
    frame = spark.createDataFrame([(*r, 0.1, 1, "set", 2) for r in rows], "doc_id long, text string, score double, n_words int, `set` string, size int")
    found = operators[name](frame)
    keys = sorted(str(r.doc_id) for r in found.collect())
    assert keys == sorted(str(k) for k, _ in rows)
    assert operators[name](frame.limit(0)).collect() == []
    assert operators[name](frame.where("text IS NULL")).count() == 1


def test_stages_of_the_pipeline_on_no_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), data)
        assert out.collect() == [], name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_last_stage_replaces_columns_of_its_names(spark, data):
    rows = spark.createDataFrame([(1, "a text", 9, "old", 3)], "doc_id long, text string, n_tokens int, decoded string, decoded_sha256 int")
    out = corpus_pipeline.STAGES[-1][1](spark, rows, data)
    assert sorted(out.columns) == ["decoded", "decoded_sha256", "doc_id", "ids", "n_tokens", "text"]
    row = out.first()
    assert row.decoded == "old" and row.n_tokens == len(row.ids) and row.decoded_sha256 == cases.sha("a text")
