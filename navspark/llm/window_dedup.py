"""Substring deduplication by Rabin-Karp hashes of every window of 35 words, counted in Spark.

Words are kept as they are. A word goes if a window that covers it occurs elsewhere too, in the same
document or another; all windows are judged on the input. Repeated windows that touch or overlap
make one removal interval. Texts with fewer words than a window lose nothing; null texts are empty.

A row that is there twice repeats all its windows, under one key or two, and loses them in both; each
row is judged by itself, so no tie arises. A very long text is a step of its own. A null key is a key
like any other, an empty table gives no rows, other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from navspark.llm.repeats import Repeats
from navspark.llm.text import texts_of, word_hashes, words_of

WINDOW = 35
#: Words of the gram by which windows are dealt.
GRAM = 8
CHUNK_BYTES = 6 << 20


def _symbols(column: pa.Array):
    data, offs = texts_of(column)
    starts, ends, first = words_of(data, offs)
    return word_hashes(data, starts, ends), first, (data, starts, ends)


def _result(ids, covered, bounds, rest):
    data, starts, ends = rest
    raw = data.tobytes()
    removed, digests = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        gone = covered[a:b]
        kept = a + np.flatnonzero(~gone)
        removed.append(int(gone.sum()))
        words = [raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())]
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return [ids, pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]


FIELDS = "doc_id {kind}, n_words long, n_removed long, kept_sha256 string"


def deduplicate(frame: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, words, removed words, digest of the kept words joined by spaces."""
    return Repeats(window, min(GRAM, window), CHUNK_BYTES, _symbols).apply(frame, _result, FIELDS, key, text)


def _kept_text(ids, covered, bounds, rest):
    data, starts, ends = rest
    raw = data.tobytes()
    texts = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        kept = a + np.flatnonzero(~covered[a:b])
        texts.append(b" ".join(raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist())).decode())
    return [ids, pa.array(texts, pa.string())]


def kept_texts(frame: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key and the kept words joined by spaces."""
    return Repeats(window, min(GRAM, window), CHUNK_BYTES, _symbols).apply(
        frame, _kept_text, "doc_id {kind}, text string", key, text
    )
