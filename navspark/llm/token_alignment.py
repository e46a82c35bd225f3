"""Alignment of two tokenizers' tokens by pointer jumping, and how often the corpus links their ids.

A text is cut by both tokenizers; each token covers a range of the bytes of a space and the text. Every token
points to the farthest-right token that it overlaps: one of the other tokenizer that holds its last byte, or
itself if none reaches further. Doubling all pointers at once (each takes its successor's successor) ends
after a logarithmic number of rounds with every token at the last token of its component. Components are the
groups between byte offsets where tokens of both end; the last token labels them.

Two ids are linked in a document if tokens of both stand in one group. Groups are counted, not paired: a
group holds each distinct id once with its number, so p and q equal tokens cost one pair, and very large
groups are paired in lots of bounded size. The documents of a task are gathered in blocks; a block has a
list of its distinct pairs with the number of documents that hold each, and its documents point into that
list. The lists alone are summed over the corpus, joined with the sums, and brought back to their block.

Null and empty texts, and texts whose tokens don't spell the space and the text (such as texts with U+2581),
have no tokens, zeros and an empty digest. Special tokens' names inside texts are plain text. Repeated rows
count as documents each. A very long text is a step of its own. An empty table gives no rows. Other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navspark.llm.components import Scratch
from navspark.llm.text import append, identified, ship, steps

#: A tokenizer file above this size isn't sent to the executors.
FILE_LIMIT = 64 << 20
#: Bytes of text in a block, and pairs that are made at a time.
BLOCK_BYTES, LOT = 8 << 20, 1 << 20
#: The pattern by which byte-level tokenizers of this family cut a text before merging (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE file of the tokenizers library."""

    def __init__(self, file: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(file)
        letters = _byte_letters()
        vocabulary = spec["model"]["vocab"]
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if i not in special}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.pieces[i] = token
        self.exact = Tokenizer.from_str(file.decode())
        self.exact.encode_special_tokens = True
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"]
        # Ids in the order of the merges mean that the least id is the merge to make first.
        ordered = [vocabulary[a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
        plain = pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and spec["normalizer"] is None
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered and plain else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.fast is not None and len(text) < 1 << 20:
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """A model file of the sentencepiece library."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Side:
    """A tokenizer with the bytes of its ids laid flat, and its ids as text with each separator."""

    def __init__(self, tokens):
        self.tokens = tokens
        self.length = np.array([len(p) for p in tokens.pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens.pieces), np.uint8)
        self.size = len(tokens.pieces)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these ids, one after another."""
        n = self.length[ids]
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.start[ids] - (np.cumsum(n) - n), n)]


_SIDES: dict[bytes, Side] = {}


def side_of(kind: type, file: bytes) -> Side:
    """One for each file and worker process."""
    key = kind.__name__.encode() + hashlib.sha256(file).digest()
    if key not in _SIDES:
        _SIDES[key] = Side(kind(file))
    return _SIDES[key]


def read_file(path: str) -> bytes:
    """A tokenizer file, read by the driver; it has a bounded size and is sent to the executors."""
    with open(path, "rb") as f:
        file = f.read(FILE_LIMIT + 1)
    if len(file) > FILE_LIMIT:
        raise ValueError(f"a tokenizer file of over {FILE_LIMIT} bytes is too large")
    return file


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the token of B that ends its group. Ends are ascending, the last ones equal."""
    n = len(ends_b)
    to_a = np.searchsorted(ends_a, ends_b, "left")
    further = ends_a[to_a] > ends_b if n else np.empty(0, bool)
    successor = np.concatenate([np.where(further, n + to_a, np.arange(n)), np.searchsorted(ends_b, ends_a, "left")])
    while True:
        twice = successor[successor]
        if np.array_equal(twice, successor):
            return successor[n:], successor[:n]
        successor = twice


@dataclass
class Aligned:
    """Tokens of a step's texts: ids and group of each, and the first token and group of each text (one more than texts)."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    first_group: np.ndarray


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(r) for r in rows], np.int64)
    out = np.empty(int(counts.sum()), np.int64)
    at = 0
    for r in rows:
        out[at : at + len(r)] = r
        at += len(r)
    return out, np.append(0, np.cumsum(counts))


def _differing(side: Side, ids: np.ndarray, first: np.ndarray, want: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts whose tokens don't spell their bytes."""
    ends = np.append(0, np.cumsum(side.length[ids]))[first]
    bad = np.diff(ends) != np.diff(offs)
    for k in np.flatnonzero(~bad) if bad.any() else []:
        bad[k] = not np.array_equal(side.spelled(ids[first[k] : first[k + 1]]), want[offs[k] : offs[k + 1]])
    if not bad.any():
        wrong = np.flatnonzero(side.spelled(ids) != want)
        bad[np.searchsorted(offs, wrong, "right") - 1] = True
    return bad


def align(texts: list[str], a: Side, b: Side) -> Aligned:
    texts = ["" if t is None else t for t in texts]
    raw = [(" " + t).encode() if t else b"" for t in texts]
    used = [k for k, t in enumerate(texts) if t]
    ids = [[[] for _ in texts], [[] for _ in texts]]
    for out, side in zip(ids, (a, b)):
        for k, row in zip(used, side.tokens.encode([texts[k] for k in used])):
            out[k] = row
    offs = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    want = np.frombuffer(b"".join(raw), np.uint8)
    flat = [_flat(x) for x in ids]
    bad = _differing(a, *flat[0], want, offs) | _differing(b, *flat[1], want, offs)
    if bad.any():
        for k in np.flatnonzero(bad).tolist():
            ids[0][k] = ids[1][k] = []
        flat = [_flat(x) for x in ids]
    (id_a, first_a), (id_b, first_b) = flat
    last_a, last_b = terminals(np.cumsum(a.length[id_a]), np.cumsum(b.length[id_b]))
    ending = np.flatnonzero(last_b == np.arange(len(last_b)))
    return Aligned(
        id_a, id_b, np.searchsorted(ending, last_a), np.searchsorted(ending, last_b), first_a, first_b,
        np.searchsorted(ending, first_b),
    )


_NUMBERS = np.empty(0, object)


def _numbers(size: int) -> np.ndarray:
    """Each id below `size` as text before a comma, a bar and a semicolon; kept, and made anew when too short."""
    global _NUMBERS
    if len(_NUMBERS) < 3 * size:
        _NUMBERS = np.array([f"{i}{c}" for i in range(max(size, 1 << 16)) for c in ",|;"], object)
    return _NUMBERS


def written(found: Aligned) -> list[str]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
    groups = int(found.first_group[-1])
    n_a, n_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
    before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    place_a = np.arange(len(found.a)) + before_b[found.group_a]
    place_b = np.arange(len(found.b)) + (before_a + n_a)[found.group_b]
    ids = np.empty(len(found.a) + len(found.b), np.int64)
    after = np.zeros(len(ids), np.int64)
    ids[place_a], ids[place_b] = found.a, found.b
    ends = (before_a + n_a + before_b)[:groups]
    after[ends - 1] = 1
    after[ends + n_b - 1] = 2
    parts = _numbers(int(ids.max()) + 1 if len(ids) else 0)[ids * 3 + after].tolist()
    bounds = (found.first_a + found.first_b).tolist()
    return ["".join(parts[x:y])[:-1] for x, y in zip(bounds[:-1], bounds[1:])]


def _distinct(group: np.ndarray, ids: np.ndarray, size: int, groups: int) -> tuple[np.ndarray, ...]:
    """Group, id and number of each distinct id of a group, in order, and the first of each group."""
    key, n = np.unique(group * size + ids, return_counts=True)
    own = key // size
    return own, key - own * size, n, np.searchsorted(own, np.arange(groups + 1))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    opens = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
    return key[opens], np.add.reduceat(n, opens) if len(key) else n


def linked(found: Aligned, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair (id of A times size_b plus id of B) and links of each distinct pair of a text, in order."""
    groups, pairs = int(found.first_group[-1]), size_a * size_b
    own, a, n_a, _ = _distinct(found.group_a, found.a, size_a, groups)
    _, b, n_b, first = _distinct(found.group_b, found.b, size_b, groups)
    text = np.searchsorted(found.first_group, own, "right") - 1
    partners = np.diff(first)[own]
    ends = np.cumsum(partners)
    keys, counts, at = [], [], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOT, "right")))
        n = partners[at:to]
        with_b = np.arange(int(n.sum())) + np.repeat(first[own[at:to]] - (np.cumsum(n) - n), n)
        key = np.repeat(text[at:to] * pairs + a[at:to] * size_b, n) + b[with_b]
        part = _summed(key, np.repeat(n_a[at:to], n) * n_b[with_b])
        keys.append(part[0])
        counts.append(part[1])
        at = to
    if not keys:
        return (np.empty(0, np.int64),) * 3
    key, n = _summed(np.concatenate(keys), np.concatenate(counts)) if len(keys) > 1 else (keys[0], counts[0])
    return key // pairs, key % pairs, n


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, links array<long>"
_LISTS = "pairs array<long>, documents array<long>"


class _Block:
    """Documents of a task until their texts reach a block's bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.number = schema, 0
        self._clear()

    def _clear(self) -> None:
        self.keys, self.columns, self.pairs, self.links, self.counts, self.bytes = [], [], [], [], [], 0

    def add(self, keys: pa.Array, found: Aligned, a: Side, b: Side, size: int) -> None:
        groups = int(found.first_group[-1])
        own = np.bincount(found.group_a, minlength=groups) * np.bincount(found.group_b, minlength=groups)
        sums = np.append(0, np.cumsum(own))[found.first_group]
        texts = written(found)
        n = [np.diff(x) for x in (found.first_a, found.first_b, found.first_group, sums)]
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
        text, pair, links = linked(found, a.size, b.size)
        self.keys.append(keys)
        self.columns.append([*(pa.array(x) for x in n), pa.array(digests, pa.string())])
        self.pairs.append(pair)
        self.links.append(links)
        self.counts.append(np.bincount(text, minlength=len(texts)))
        self.bytes += size

    def rows(self):
        """The documents, with places in the block's list of pairs, and a row with that list."""
        if not self.keys:
            return
        block = (TaskContext.get().partitionId() << 32) + self.number
        pairs, at, documents = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        links, counts = np.concatenate(self.links), np.concatenate(self.counts)
        ends = np.append(0, np.cumsum(counts))
        row = 0
        for keys, columns in zip(self.keys, self.columns):
            a, b = row, row + len(keys)
            offsets = pa.array(ends[a : b + 1] - ends[a], pa.int32())
            lo, hi = ends[a], ends[b]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[lo:hi], k)) for x, k in ((at, pa.int32()), (links, pa.int64()))]
            yield self._batch(len(keys), block, [keys, *columns, *lists, None, None])
            row = b
        own = [pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs, documents)]
        yield self._batch(1, block, [None] * (len(self.schema) - 3) + own)
        self.number += 1
        self._clear()

    def _batch(self, n: int, block: int, columns: list) -> pa.RecordBatch:
        filled = [pa.nulls(n, f.type) if c is None else c.cast(f.type) for c, f in zip(columns, list(self.schema)[1:])]
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *filled], schema=self.schema)


class Alignment:
    """The documents of a table aligned once, in blocks below the shared folder."""

    def __init__(self, frame: DataFrame, a: tuple[type, bytes], b: tuple[type, bytes], key: str = "doc_id", text: str = "text"):
        from pyspark.sql.pandas.types import to_arrow_schema

        spark = frame.sparkSession
        ship(spark)
        self.scratch = Scratch(spark)
        self.size_b = side_of(*b).size
        source = identified(frame, key, text)
        doc = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(_DOC).fields])
        fields = [*T.StructType.fromDDL("block long").fields, *doc.fields, *T.StructType.fromDDL(_LISTS).fields]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        arrow = to_arrow_schema(schema)
        shared = spark.sparkContext.broadcast((a, b))

        def run(batches):
            (kind_a, file_a), (kind_b, file_b) = shared.value
            side_a, side_b = side_of(kind_a, file_a), side_of(kind_b, file_b)
            block = _Block(arrow)
            for batch in batches:
                for part in steps(batch, "text"):
                    found = align(part.column(1).to_pylist(), side_a, side_b)
                    block.add(part.column(0), found, side_a, side_b, part.column(1).nbytes)
                    if block.bytes >= BLOCK_BYTES:
                        yield from block.rows()
            yield from block.rows()

        self.rows = self.scratch.keep(source.mapInArrow(run, schema), "aligned")
        lists = self.rows.where("pairs IS NOT NULL")
        self.pairs = lists.select("block", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "of")).select("block", "at", "of.*")

    def link_counts(self) -> DataFrame:
        """a, b, n (documents that hold the pair linked), best (no pair of a has more)."""
        counts = self.pairs.groupBy("pairs").agg(F.sum("documents").alias("n"))
        counts = counts.select(F.expr(f"pairs div {self.size_b}").alias("a"), (F.col("pairs") % self.size_b).alias("b"), "n")
        most = counts.groupBy("a").agg(F.max("n").alias("most"))
        return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """Per document: tokens of both, groups, links, links of best pairs, sum of the links' counts, digest of the groups."""
        counts = self.link_counts().select((F.col("a") * self.size_b + F.col("b")).alias("pairs"), "n", "best")
        known = self.pairs.join(self.scratch.keep(counts, "counts"), "pairs").select(F.col("block").alias("of"), "at", "n", "best")
        docs = self.rows.where("pairs IS NULL").drop("pairs", "documents")
        kept = [f for f in docs.schema.fields if f.name not in ("block", "at", "links")]
        schema = T.StructType([*kept, *T.StructType.fromDDL("n_best long, count_sum long").fields])

        def score(docs: pa.Table, known: pa.Table) -> pa.Table:
            n, best = np.zeros(known.num_rows, np.int64), np.zeros(known.num_rows, np.int64)
            at = known["at"].to_numpy()
            n[at], best[at] = known["n"].to_numpy(), known["best"].to_numpy()
            lists, links = docs["at"].combine_chunks(), docs["links"].combine_chunks()
            place, links = lists.flatten().to_numpy(), links.flatten().to_numpy()
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy().astype(np.int64)))
            sums = [np.append(0, np.cumsum(links * x[place])) for x in (best, n)]
            columns = [docs[f.name] for f in kept] + [pa.array(np.diff(s[ends])) for s in sums]
            return pa.table(columns, names=schema.names)

        return docs.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(score, schema)


def digests(frame: DataFrame, byte_file: bytes, piece_file: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = Alignment(frame, (ByteTokens, byte_file), (PieceTokens, piece_file), key, text).documents()
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def groups(frame: DataFrame, a: tuple[type, bytes], b: tuple[type, bytes], text: str = "text") -> DataFrame:
    """`frame` with the ids of both tokenizers and the group of each token, from 0 in each text."""
    shared = frame.sparkSession.sparkContext.broadcast((a, b))

    def compute(batch: pa.RecordBatch) -> dict:
        (kind_a, file_a), (kind_b, file_b) = shared.value
        found = align(batch.column(batch.schema.get_field_index(text)).to_pylist(), side_of(kind_a, file_a), side_of(kind_b, file_b))

        def lists(values, first):
            return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32()))

        own = [g - np.repeat(found.first_group[:-1], np.diff(f)) for g, f in ((found.group_a, found.first_a), (found.group_b, found.first_b))]
        return {
            "a_ids": lists(found.a, found.first_a), "b_ids": lists(found.b, found.first_b),
            "a_groups": lists(own[0], found.first_a), "b_groups": lists(own[1], found.first_b),
        }

    return append(frame, text, {c: "array<int>" for c in ("a_ids", "b_ids", "a_groups", "b_groups")}, compute)
