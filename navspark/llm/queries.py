"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from navspark.llm import decontaminate, histogram_shards, html_text, lexical_search, ngram_join, oracles, pii, quality_fm, rare_digest, sentencepiece_codec, suffix_dedup, token_alignment, toxicity_knn, window_dedup
from navspark.llm.text import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_sentencepiece")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    model = sentencepiece_codec.read_model(tokenizer_path())
    return sentencepiece_codec.encoding_digests(documents(spark, folder), model)


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(documents(spark, folder))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_knn.judged(documents(spark, folder), toxicity_knn.fit(spark, folder))


@query("op8_quality")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return quality_fm.judged(documents(spark, folder), quality_fm.fit(spark, folder))


@query("op4_decontaminate")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find(spark, folder)


@query("op3_html_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.pages_text(spark, folder)


@query("op6_fingerprint")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return rare_digest.compared(spark, folder)


@query("op5_substring_dedup", oracles.SUBSTRING_DEDUP)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return window_dedup.deduplicate(documents(spark, folder))


@query("op9_suffix_dedup", oracles.SUFFIX_DEDUP)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.deduplicate(documents(spark, folder))


@query("op2_ngram_join", oracles.NGRAM_JOIN)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked_components(documents(spark, folder))


@query("op11_lexical_search", oracles.LEXICAL_SEARCH)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op13_sharding")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return histogram_shards.digests(documents(spark, folder))


@query("op12_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    read = token_alignment.read_file
    return token_alignment.digests(documents(spark, folder), read(tokenizer_path("byte_bpe_50k.json")), read(tokenizer_path()))
