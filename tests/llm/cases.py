"""Documents with everything unpleasant in them, and plain versions of what the operators compute."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, chunk int, bucket string, "
    "`set` string, n string, sig int, label string, spans int, `odd name` int"
)


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aeinrst", k=rng.randint(1, 6))) for _ in range(n))


def documents() -> list[tuple]:
    passage = words(70, 1)
    base = words(120, 2)
    changed = base.split()
    changed[60] = "other"
    texts = [
        None, "", " \n\t ", "one", "ONE", "one two", "x" * 30_000, "é" * 500, "ab " * 400, "ab " * 400,
        passage, f"Before it. {passage} And after.", f"{words(40, 3)}\n{passage}", base, " ".join(changed), base.upper(),
        words(15_000, 4), "mail jo@a.example.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (212) 555-0100",
        "mail jo (at) a [dot] example dot org", "漢字 かな 😀 ▁   end", "\r\nline\r\nline\r\n", "IDIOT!! " * 9,
    ]
    rows = [(i, t) for i, t in enumerate(texts, start=10)]
    rows += [(99, "a row that is there twice, word for word"), (99, "a row that is there twice, word for word")]
    rows += [(5, passage + " end"), (-7, "negative " + base), (2**60, words(50, 5))]
    return [(i, t, None, "s", None, 0.5, 1, "b", None, "n", 3, "l", 4, 5) for i, t in rows]


def window_removal(items: list[tuple], size: int) -> dict:
    """Per (id, position): units covered by a run of `size` units that starts anywhere else too."""
    count = Counter()
    for _, units in items:
        for i in range(len(units) - size + 1):
            count[units[i : i + size]] += 1
    out = []
    for key, units in items:
        gone = [False] * len(units)
        for i in range(len(units) - size + 1):
            if count[units[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out.append((key, units, gone))
    return out


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def shingles(text: str | None, size: int = 4) -> frozenset:
    w = WORD.findall((text or "").translate(A_TO_Z))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(sets: list[tuple], numerator: int = 85, denominator: int = 100) -> dict:
    """Smallest key that links reach, for (key, set) pairs."""
    up = {k: k for k, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and denominator * len(x & y) >= numerator * len(x | y):
                low, high = sorted((root(a), root(b)))
                up[high] = low
    return {k: root(k) for k in up}
