"""Personal data: plain identifiers, and disguised ones found on a normalised text.

Plain ones (the base) are the leftmost non-overlapping matches of one pattern per kind, on the text
as it is. For disguised ones a chain of transducers rewrites the text: look-alike letters and digits
become ASCII, invisible characters go, at/dot disguises become @ and a full stop, and spelled digits
become digits where enough digits, spelled or written, stand together. Each transducer carries, for every character that it emits, the span of
source characters it came from; the same detectors run on the result, and what they find is mapped
back. A found span is added if it overlaps no base span of its kind.

Spans are code points of the source, the end exclusive. Null and empty texts have none. Runs of
digits of any length are handled without converting them to numbers.

Each row is read by itself, repeated ones and those with a null key too; an empty table gives no rows.
Of matches that tie for a start the longest counts, as the patterns are greedy. Other columns stay as
they are in `redact` and aren't read in `find`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.text import LOWER, append, identified, texts_of, word_hashes, words_of

KINDS = ("email", "ip", "card", "phone")

# The patterns and limits of the kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)

# Letters of other scripts that look like ASCII ones, and invisible characters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ո": "n",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
INVISIBLE = "​‌‍⁠﻿­"

# Names of the digits by language.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
#: In a run with fewer digits than this, spelled and written ones together, names stay words; an IP address has four.
RUN_DIGITS = 4

_GLYPHS = dict(LOOK_ALIKES)
_GLYPHS.update({chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)})  # full-width forms
for _zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _GLYPHS.update({chr(_zero + d): str(d) for d in range(10)})
_GLYPHS.update({c: "" for c in INVISIBLE})
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]+")
_DIGIT = {w: str(d) for names in DIGIT_NAMES.values() for d, w in enumerate(names.split())}
#: Either case of each letter, and none of the letters that fold to them.
_NAME = "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in sorted(_DIGIT, key=len, reverse=True)) + ")"
#: Names and written digits with the separators that identifiers have between them.
_PART = rf"(?:{_NAME}|[0-9]++)\b"
_RUN = re.compile(rf"\b{_PART}(?:[\s,().-]++{_PART})*+")
_PARTS = re.compile(rf"\b(?:(?P<name>{_NAME})|[0-9]++)\b")
_JOINED = re.compile(r"[\s,-]+")
_LABEL = "[A-Za-z0-9-]+"
_SIGN = re.compile(r"(?i)(?:(?<!\s)\s+)?[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]\s*")
_BARE = re.compile(rf"(?<=[A-Za-z0-9])\s+(?i:at)\s+(?={_LABEL}(?:\s*\.\s*|\s+(?i:dot)\s+){_LABEL})")
_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s+(?i:dot)\s+(?={_LABEL})")
#: White space in lower-case UTF-8; all other white space begins with a byte of _LEADS.
_GAP = rb"(?:[\s\x1c-\x1f]|\xe1\x9a\x80)"
#: What _SIGN, _DOT and _BARE need, taking one character only, so that no match hides the next text's.
_SIGN_HINT = re.compile(
    rb"[\[({<](?=G*(?:at|dot|@|\.))|G(?=dotG)|G(?=atG+[a-z0-9-]+(?:G*\.|G+dot))".replace(b"G", _GAP)
)
#: Letters and digits of ASCII in lower case; all else is space.
_PLAIN = np.array([c if chr(c).isalnum() and c < 128 else 32 for c in LOWER.tolist()], np.uint8)
#: Lead bytes of the characters in _GLYPHS.
_LEADS = np.zeros(256, bool)
_LEADS[[c.encode()[0] for c in _GLYPHS]] = True


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, @ and domain; each @ has one possible match, so none is tried twice."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        if domain := DOMAIN.match(text, at + 1):
            start = at
            while start > free and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
                start -= 1
            if start < at:
                found.append((start, domain.end()))
                free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    low, high = CARD_DIGITS
    return [
        m.span()
        for m in CARD.finditer(text)
        if m.end() - m.start() >= low and low <= len(d := _digits(m[0])) <= high and luhn(d)
    ]


def phones(text: str) -> list[tuple[int, int]]:
    low, high = PHONE_DIGITS
    return [m.span() for m in PHONE.finditer(text) if low <= len(_digits(m[0])) <= high]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}
_HINT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers by kind, then start."""
    digits = _HINT.search(text) is not None
    return [
        (kind, a, b)
        for kind in KINDS
        if kind == "email" or digits
        for a, b in DETECTORS[kind](text)
    ]


class Rewritten:
    """A text with the span of source characters behind each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.begin = np.arange(len(text))
        self.end = self.begin + 1

    def rewrite(self, pattern: re.Pattern, replace) -> None:
        """Replaces each match; all characters of a replacement come from the whole match."""
        self.edit((*m.span(), replace(m[0])) for m in pattern.finditer(self.text))

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replaces the characters from a to b, for each (a, b, new) in order."""
        out, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            begin += [self.begin[at:a], np.full(len(new), self.begin[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            at = b
        if out:
            self.text = "".join(out) + self.text[at:]
            self.begin = np.concatenate(begin + [self.begin[at:]])
            self.end = np.concatenate(end + [self.end[at:]])

    def translate(self, pattern: re.Pattern, table: dict[str, str]) -> None:
        """Replaces or drops single characters."""
        if pattern.search(self.text):
            new = [table.get(c, c) for c in self.text]
            keep = np.array([n != "" for n in new], bool)
            self.text, self.begin, self.end = "".join(new), self.begin[keep], self.end[keep]


def _sign(match: str) -> str:
    return "@" if "at" in match.lower() or "@" in match else "."


def spelled(text: str) -> Iterator[tuple[int, int, str]]:
    """Edits that make digits of the names in runs of enough digits; names in a row lose what is between them."""
    for run in _RUN.finditer(text):
        parts = list(_PARTS.finditer(text, *run.span()))
        if not any(p["name"] for p in parts) or sum(1 if p["name"] else len(p[0]) for p in parts) < RUN_DIGITS:
            continue
        last = None
        for p in parts:
            if p["name"]:
                if last is not None and _JOINED.fullmatch(text, last, p.start()):
                    yield last, p.start(), ""
                yield *p.span(), _DIGIT[p[0].lower()]
            last = p.end() if p["name"] else None


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text whether a transducer may have something to do; never false where one has."""
    out = np.zeros(len(offs) - 1, bool)
    row = lambda at: np.searchsorted(offs, at, "right") - 1
    out[row(np.flatnonzero(_LEADS[data]))] = True
    out[row(np.array([m.start() for m in _SIGN_HINT.finditer(LOWER[data].tobytes())], np.int64))] = True
    plain = _PLAIN[data]
    starts, ends, first = words_of(plain, offs)
    named = np.isin(word_hashes(plain, starts, ends), _name_hashes())
    digits = lambda at: (plain[at] >= 48) & (plain[at] <= 57)
    part = named | digits(starts) & digits(ends - 1)
    # Runs of names and numbers in one text.
    opens = part.copy()
    opens[1:] &= ~part[:-1]
    heads = first[:-1][first[:-1] < first[1:]]
    opens[heads] = part[heads]
    run = np.cumsum(opens)[part]
    size = np.bincount(run, np.where(named, 1, ends - starts)[part], minlength=1)
    enough = (size >= RUN_DIGITS) & (np.bincount(run, named[part], minlength=1) > 0)
    out[np.searchsorted(first, np.flatnonzero(part)[enough[run]], "right") - 1] = True
    return out


def _name_hashes() -> np.ndarray:
    """Hashes of the names, and of the parts of those with a letter outside ASCII."""
    data = _PLAIN[np.frombuffer(" ".join(_DIGIT).encode(), np.uint8)]
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    return np.unique(word_hashes(data, starts, ends))


def _signed(text: str) -> Rewritten:
    """The text after all transducers but the last."""
    out = Rewritten(text)
    out.translate(_GLYPH, _GLYPHS)
    out.rewrite(_SIGN, _sign)
    out.rewrite(_BARE, lambda _: "@")
    out.rewrite(_DOT, lambda _: ".")
    return out


def normalised(text: str) -> Rewritten:
    """The text after all transducers."""
    out = _signed(text)
    out.edit(spelled(out.text))
    return out


def _traced(out: Rewritten) -> list[tuple[str, int, int]]:
    return [(kind, int(out.begin[a]), int(out.end[b - 1])) for kind, a, b in base_spans(out.text)]


def _apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]], inside: bool = False) -> list[tuple[str, int, int]]:
    """The spans that overlap none taken of their kind, or with `inside` that lie in none; taken ones by kind in order."""
    out = []
    own = {kind: ([a for k, a, _ in taken if k == kind], [b for k, _, b in taken if k == kind]) for kind in KINDS}
    for kind, a, b in spans:
        starts, ends = own[kind]
        at = bisect_left(ends, b if inside else a + 1)
        if at == len(ends) or (starts[at] > a if inside else starts[at] >= b):
            out.append((kind, a, b))
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Disguised identifiers that overlap no base span of their kind.

    Names beside an identifier may spoil it once they are digits, so it is also looked for before that.
    """
    out = _signed(text)
    found = _traced(out) if out.text != text else []
    if edits := list(spelled(out.text)):
        out.edit(edits)
        more = _traced(out)
        found = _apart(found, more, inside=True)
        found += _apart(more, found)
    return _apart(found, base)


def all_spans(text: str, suspect: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and added ones together, by kind and start."""
    base = base_spans(text)
    added = added_spans(text, base) if suspect else []
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base


def masked(text: str, suspect: bool = True) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one."""
    spans = sorted((a, b, kind) for kind, a, b in all_spans(text, suspect)[1])
    out, at = [], 0
    for k, (a, b, kind) in enumerate(spans):
        if k and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:] if spans else text


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(frame: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: base counts by kind, digest of the base spans, all spans, number of added ones."""

    def compute(batch: pa.RecordBatch) -> dict:
        doubt = suspects(*texts_of(batch.column(1))).tolist()
        both = [all_spans(*x) for x in zip(batch.column(1).to_pylist(), doubt)]
        counts = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in KINDS}
        return counts | {
            "base_sha256": pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both]),
            "spans": pa.array([_joined(spans) for _, spans in both]),
            "n_added": pa.array([len(spans) - len(base) for base, spans in both], pa.int64()),
        }

    fields = {f"n_{k}": "long" for k in KINDS} | {"base_sha256": "string", "spans": "string", "n_added": "long"}
    return append(identified(frame, key, text), "text", fields, compute).select(F.col("doc_id"), *fields)


def redact(frame: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """`frame` with its texts masked and their lengths renewed; null texts stay null, other columns as they are."""
    order = frame.columns

    def compute(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index("__source"))
        doubt = suspects(*texts_of(column)).tolist()
        texts = [None if t is None else masked(t, d) for t, d in zip(column.to_pylist(), doubt)]
        made = {text: pa.array(texts, pa.string())}
        if length in order:
            made[length] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return made

    fields = {text: "string"} | ({length: "long"} if length in order else {})
    return append(frame.withColumn("__source", F.col(text)), "__source", fields, compute).select(*order)
