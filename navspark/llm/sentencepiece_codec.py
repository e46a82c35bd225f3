"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

All new distinct words of a batch are laid into one flat array of symbols. In a round every word
looks up the smallest rank among its adjacent pairs, merges all pairs of that rank from the left
without overlap, and closes the gaps; words in which no pair can merge leave. A merge may create a
pair that must come before the remaining merges of the same round; such a word takes only its
leftmost merge in that round, which is exactly the order of the one-at-a-time algorithm.

A word here is a run of spaces with what follows it. Pieces hold spaces only at their start, so no
merge crosses words. Neither does one cross two characters that stand side by side in no piece:
words are cut there too, which bounds the work on very long words.

Null and empty texts have no ids and decode to the empty text. The decoded text is the text, except
that U+2581 comes back as a space, as with the library.

Each row is encoded by itself, repeated ones and those with a null key too. A very long text is a step of
its own. Of pairs of one rank the leftmost merges first. An empty table gives no rows; a column with
the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.text import append, identified

MARK = "▁"
#: A vocabulary file above this size isn't sent to the executors.
MODEL_LIMIT = 64 << 20
#: Distinct words that a worker keeps encoded; beyond it starts anew.
KEPT_WORDS = 150_000
_NEVER = np.int64(1 << 40)
_SHIFT = np.int64(1 << 21)


class Codec:
    """Tables of one model file; small, and the same on every executor."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        if len(model) > MODEL_LIMIT:
            raise ValueError(f"a model file of {len(model)} bytes is too large")
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only byte-pair models that leave the text unchanged are supported")
        if not (norm.add_dummy_prefix and norm.escape_whitespaces and train.byte_fallback):
            raise ValueError("only models with a leading space and byte fallback are supported")
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in spec.pieces) or any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("models with own symbols or inner spaces are not supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.size = len(self.pieces)
        order = {s: r for r, s in enumerate(sorted({spec.pieces[i].score for i in normal.values()}, reverse=True))}
        self.rank = np.array([order.get(p.score, 0) for p in spec.pieces], np.int64)
        self.single = {ord(p): i for p, i in normal.items() if len(p) == 1}
        pairs, beside = {}, set()
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = self._symbol(piece[:k], normal), self._symbol(piece[k:], normal)
                beside.add((ord(piece[k - 1]) << 21) | ord(piece[k]))
                if a is not None and b is not None:
                    pairs[a * int(_SHIFT) + b] = i
        self._index(pairs)
        self.text_of = [p.replace(MARK, " ") for p in self.pieces]
        self.number = [str(i) for i in range(self.size)]
        self.beside = np.array(sorted(beside), np.int64)
        self.known: dict[str, tuple[int, str, str]] = {}

    def _symbol(self, part: str, normal: dict[str, int]) -> int | None:
        if part in normal:
            return normal[part]
        return self.size + ord(part) if len(part) == 1 else None

    def _index(self, pairs: dict[int, int]) -> None:
        """A hash table of the pairs with linear probing; -1 marks an empty slot."""
        bits = max(10, len(pairs).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.merged = np.zeros(1 << bits, np.int64)
        slots = self._slots(np.array(list(pairs), np.int64)).tolist()
        for (key, piece), at in zip(pairs.items(), slots):
            while self.keys[at] != -1:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.merged[at] = key, piece

    def _slots(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each adjacent pair; _NEVER at the end of a word and where none exists."""
        pair = sym[:-1] * _SHIFT + sym[1:]
        at = self._slots(pair)
        found = self.keys[at]
        open_ = np.flatnonzero((found != pair) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            found[open_] = now = self.keys[at[open_]]
            open_ = open_[(now != pair[open_]) & (now != -1)]
        hit = (found == pair) & (seg[:-1] == seg[1:])
        piece = self.merged[at]
        return np.append(np.where(hit, self.rank[piece], _NEVER), _NEVER), np.append(piece, 0)

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of each run of neighbouring candidates the first, third, fifth and so on."""
        index = np.arange(len(hit))
        opens = hit.copy()
        opens[1:] &= ~hit[:-1]
        since = index - np.maximum.accumulate(np.where(opens, index, 0))
        return hit & (since % 2 == 0)

    def _merged(self, sym, seg, piece, chosen):
        out = np.where(chosen, piece, sym)
        keep = np.ones(len(sym), bool)
        keep[1:] = ~chosen[:-1]
        return out[keep], seg[keep], chosen[keep]

    def merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words. seg is ascending."""
        done_sym, done_seg = [], []
        while len(sym):
            rank, piece = self._ranks(sym, seg)
            opens = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            least = np.minimum.reduceat(rank, opens)
            lengths = np.diff(np.append(opens, len(sym)))
            least = np.repeat(least, lengths)
            over = least == _NEVER
            if over.any():
                done_sym.append(sym[over])
                done_seg.append(seg[over])
                go = ~over
                sym, seg, rank, piece, least = sym[go], seg[go], rank[go], piece[go], least[go]
                if not len(sym):
                    break
            chosen = self._leftmost(rank == least)
            new_sym, new_seg, made = self._merged(sym, seg, piece, chosen)
            keep = np.ones(len(sym), bool)
            keep[1:] = ~chosen[:-1]
            bound = least[keep]
            new_rank, _ = self._ranks(new_sym, new_seg)
            beside = made.copy()
            beside[:-1] |= made[1:]
            early = beside & (new_rank <= bound)
            # A merged symbol also meets its right neighbour before that one merges.
            at = np.flatnonzero(chosen[:-2] & (seg[2:] == seg[:-2]))
            right, _ = self._ranks(
                np.stack([piece[at], sym[at + 2]], 1).ravel(), np.repeat(np.arange(len(at)), 2)
            )
            soon = right[: 2 * len(at) : 2] <= least[at]
            if early.any() or soon.any():
                bad = np.isin(seg, np.unique(np.append(new_seg[early], seg[at[soon]])))
                first = chosen & bad
                where = np.flatnonzero(first)
                _, head = np.unique(seg[where], return_index=True)
                only = np.zeros(len(sym), bool)
                only[where[head]] = True
                chosen = np.where(bad, only, chosen)
                new_sym, new_seg, _ = self._merged(sym, seg, piece, chosen)
            sym, seg = new_sym, new_seg
        if not done_sym:
            return sym, seg
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], seg[order]

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words; a word is given without its first space."""
        flat = np.frombuffer("".join(MARK + w.replace(" ", MARK) for w in words).encode("utf-32-le"), np.uint32)
        points = flat.astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        chars, back = np.unique(points, return_inverse=True)
        sym = np.array([self.single.get(c, self.size + c) for c in chars.tolist()], np.int64)[back]
        cut = np.ones(len(points), bool)
        near = (points[:-1] << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.beside, near), len(self.beside) - 1)
        cut[1:] = (word[1:] != word[:-1]) | (self.beside[at] != near)
        seg = np.cumsum(cut) - 1
        word_of = word[cut]
        sym, seg = self.merge(sym, seg)
        owner = word_of[seg]
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        final = sym.tolist()
        foreign = set(owner[sym >= self.size].tolist())
        known, number, plain = self.known, self.number.__getitem__, self.text_of.__getitem__
        for k, w in enumerate(words):
            ids = final[bounds[k] : bounds[k + 1]]
            if k in foreign:
                ids = [j for i in ids for j in ([i] if i < self.size else self._fallback(i))]
                known[w] = (len(ids), ",".join(map(number, ids)), self._plain(ids))
            else:
                known[w] = (len(ids), ",".join(map(number, ids)), "".join(map(plain, ids)))

    def _fallback(self, symbol: int) -> list[int]:
        return [self.bytes[b] for b in chr(symbol - self.size).encode()]

    def _plain(self, ids: list[int]) -> str:
        """The text of ids, the leading space included."""
        out = bytearray()
        for i in ids:
            out += bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(MARK, " ").encode()
        return out.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; the space that encoding put before it is removed."""
        return self._plain(ids).removeprefix(" ")

    def encoded(self, text: str) -> list[tuple[int, str, str]]:
        """For each word of the text: number of ids, ids as text, decoded text."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            words = [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
        else:
            words = text.split(" ")
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > KEPT_WORDS:
                known.clear()
            self.learn([w for w in dict.fromkeys(words) if w not in known])
            return [known[w] for w in words]

    def ids(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encoded(text) for i in ids.split(",")]

    def prepare(self, texts: list[str]) -> None:
        """Learns the new words of many texts in one go."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = set()
        for text in texts:
            text = text.replace(MARK, " ")
            if "  " in text or text[:1] == " ":
                new.update(w[1:] for w in re.findall(" +[^ ]*", " " + text))
            elif text:
                new.update(text.split(" "))
        new -= self.known.keys()
        if new:
            self.learn(list(new))


_CODECS: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec for each model and worker process."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def read_model(path: str) -> bytes:
    """The model file, read by the driver; it has a bounded size and is sent to the executors."""
    with open(path, "rb") as f:
        model = f.read(MODEL_LIMIT + 1)
    Codec(model)
    return model


def encode_ids(frame: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`frame` with the ids of each text (array of int) and the text decoded from them."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict:
        codec = codec_of(shared.value)
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        codec.prepare(texts)
        words = [codec.encoded(t) for t in texts]
        ends = np.cumsum([0, *(sum([n for n, _, _ in w]) for w in words)])
        flat = np.fromstring(",".join([s for w in words for _, s, _ in w]), np.int32, sep=",") if ends[-1] else []
        return {
            ids: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
            decoded: pa.array(["".join([d for _, _, d in w])[1:] for w in words], pa.string()),
        }

    return append(frame, text, {ids: "array<int>", decoded: "string"}, compute)


def encoding_digests(frame: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids joined by commas, and of the decoded text."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> dict:
        codec = codec_of(shared.value)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        codec.prepare(texts)
        counts, ids, plain = [], [], []
        for t in texts:
            words = codec.encoded(t)
            if words:
                n, s, d = zip(*words)
                counts.append(sum(n))
                ids.append(hashlib.sha256(",".join(s).encode()).hexdigest())
                plain.append(hashlib.sha256("".join(d)[1:].encode()).hexdigest())
            else:
                counts.append(0)
                ids.append(hashlib.sha256(b"").hexdigest())
                plain.append(hashlib.sha256(b"").hexdigest())
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids), "decoded_sha256": pa.array(plain)}

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return append(identified(frame, key, text), "text", fields, compute).select(F.col("doc_id"), *fields)
