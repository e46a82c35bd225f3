"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again.

Every stage works on all rows that the one before kept. Quality, near duplicates and benchmark leaks
remove documents, personal data are masked in the texts, and the last stage adds the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navspark.llm import decontaminate, ngram_join, pii, quality_fm, sentencepiece_codec
from navspark.llm.components import Scratch
from navspark.llm.queries import tokenizer_path

#: Words of a shingle, and the similarity as a fraction, from which documents are near duplicates.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, (8, 10)


#: Rows of an Arrow batch while the pipeline runs: a batch is held by both the executor and its Python worker.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _bounded(spark)
    return quality_fm.accepted(docs, quality_fm.fit(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word similarity of 0.8 or more the one with the smallest id stays."""
    _bounded(spark)
    return ngram_join.one_of_each(docs, shingle=NEAR_SHINGLE, similarity=NEAR_SIMILARITY)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item's question and answer go."""
    _bounded(spark)
    return decontaminate.clean(docs, decontaminate.shards(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; n_chars follows the new text."""
    _bounded(spark)
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their number, and a digest of the text decoded from them; columns of such names are replaced."""
    _bounded(spark)
    made = {"ids", "n_tokens", "decoded_sha256"}
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    decoded = "__decoded"
    encoded = sentencepiece_codec.encode_ids(rows, sentencepiece_codec.read_model(tokenizer_path()), decoded=decoded)
    columns = [F.col(f"`{c}`") for c in encoded.columns if c != decoded]
    return encoded.select(*columns, F.size("ids").cast("long").alias("n_tokens"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("personal data", personal_data),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Trained models and a tokenizer can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
