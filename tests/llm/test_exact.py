"""The operators with one right answer, against plain versions of them."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from navspark.llm import html_text, ngram_join, pii, rare_digest, repeats, sentencepiece_codec, suffix_dedup, window_dedup
from navspark.llm.components import Scratch
from navspark.llm.components import components as spark_components

from . import cases


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def model():
    return sentencepiece_codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def check_words(frame, size=35):
    want = []
    items = [(k, tuple(cases.WORD.findall(t or ""))) for k, t in pairs(frame)]
    for key, units, gone in cases.window_removal(items, size):
        kept = " ".join(u for u, g in zip(units, gone) if not g)
        want.append((key, len(units), sum(gone), cases.sha(kept)))
    assert rows(window_dedup.deduplicate(frame, size)) == sorted(want)


def check_bytes(frame, size=200):
    want = []
    items = [(k, (t or "").encode()) for k, t in pairs(frame)]
    for key, units, gone in cases.window_removal(items, size):
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(u for u, g in zip(units, gone) if not g)
        want.append((key, len(units), sum(gone), runs, cases.sha(kept)))
    assert rows(suffix_dedup.deduplicate(frame, size)) == sorted(want)


def test_word_windows(docs, small):
    check_words(docs)
    check_words(docs, 3)
    check_words(small)


def test_word_windows_of_a_crowded_passage(spark):
    """One line in many documents with different surroundings, over several chunks."""
    line = cases.words(50, 7)
    frame = spark.createDataFrame([(i, f"{cases.words(20, i)} {line} {cases.words(20, -i)}") for i in range(300)], "doc_id long, text string")
    for finder, check in ((window_dedup, check_words), (suffix_dedup, check_bytes)):
        kept, finder.CHUNK_BYTES = finder.CHUNK_BYTES, 2000
        crowd, repeats.CROWD = repeats.CROWD, 8
        try:
            check(frame)
        finally:
            finder.CHUNK_BYTES, repeats.CROWD = kept, crowd


def test_byte_strings(docs, small):
    check_bytes(docs)
    check_bytes(docs, 20)
    check_bytes(small)


def test_suffix_order_with_a_difference_cover():
    for p in (8, 32):
        cover = suffix_dedup.difference_cover(p)
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    data[1000:1600] = data[3000:3600]
    data[4000:4500] = 97
    block = suffix_dedup.Block(data, 200)
    starts = np.arange(len(data) - 200)
    raw = data.tobytes()
    text = [raw[i : i + 200] for i in starts]
    seen = {}
    for t in text:
        seen[t] = seen.get(t, 0) + 1
    assert block.repeated(starts).tolist() == [seen[t] > 1 for t in text]
    by_name = np.argsort(block.name, kind="stable")
    order = by_name[block._bucket(starts[by_name], block.name[by_name])]
    assert [text[i] for i in order] == sorted(text)


def test_jaccard_components(docs, small, spark):
    for frame in (docs, small):
        sets = [(k, cases.shingles(t)) for k, t in pairs(frame)]
        root = cases.components(list(dict(sets).items()))
        want = sorted((k, len(s), root[k]) for k, s in sets)
        assert rows(ngram_join.linked_components(frame)) == want


def test_jaccard_at_the_threshold(spark):
    """Sets of all small sizes with one to four members changed, and larger ones near 0.85."""
    texts, rng = [], random.Random(2)
    for n in [*range(1, 34), 80, 120, 200]:
        base = [f"w{n}x{i}" for i in range(n + 3)]
        texts.append(" ".join(base))
        for drop in (1, 2, 3, 4, n // 12 + 1, n // 7 + 1):
            texts += [" ".join(base[drop:]), " ".join(base[: len(base) - drop]), " ".join(base + [f"y{i}" for i in range(drop)])]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    heavy, ngram_join.HEAVY = ngram_join.HEAVY, 3
    try:
        sets = [(k, cases.shingles(t)) for k, t in enumerate(texts)]
        root = cases.components(sets)
        assert rows(ngram_join.linked_components(frame)) == sorted((k, len(s), root[k]) for k, s in sets)
    finally:
        ngram_join.HEAVY = heavy


def test_lists_in_pieces(spark, monkeypatch):
    """Dissimilar texts that share a passage, similar ones of different clusters, lists longer than a piece."""
    monkeypatch.setattr(ngram_join, "PIECE", 5)
    monkeypatch.setattr(ngram_join, "LISTED", 300)
    monkeypatch.setattr(ngram_join, "LOT", 50)
    monkeypatch.setattr(ngram_join, "HEAVY", 10)
    monkeypatch.setattr(ngram_join, "VOTES", 9)  # no clusters: all links must show on lists
    rng, passage = random.Random(8), cases.words(40, 11)
    texts = [f"{cases.words(25, i)} {passage} {cases.words(rng.randint(5, 60), 1000 + i)}" for i in range(60)]
    for i in range(0, 60, 4):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [(k, cases.shingles(t)) for k, t in enumerate(texts)]
    root = cases.components(sets)
    assert len(set(root.values())) < len(texts)
    assert rows(ngram_join.linked_components(frame)) == sorted((k, len(s), root[k]) for k, s in sets)


@pytest.mark.parametrize("shingle, a, b", [(4, 85, 100), (5, 8, 10)])  # of op2, and of the pipeline
def test_lists_make_no_pairs_of_sets_that_cannot_link(spark, monkeypatch, shingle, a, b):
    """Many texts a little too unlike each other to link: their pairs stay in the task that scans their lists."""
    monkeypatch.setattr(ngram_join, "VOTES", 9)
    scanned, made = ngram_join._scanned, []

    def counted(*given):
        found = scanned(*given)
        made.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "_scanned", counted)
    rng, texts = random.Random(3), []
    for i in range(100):
        w = cases.words(300, 31).split()
        for k in rng.sample(range(300), 9):
            w[k] = f"other{i}"
        texts.append(" ".join(w))
    texts.append(texts[0].replace("other0", "another0", 1))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [(k, cases.shingles(t, shingle)) for k, t in enumerate(texts)]
    root = cases.components(sets, a, b)
    assert rows(ngram_join.linked_components(frame, shingle=shingle, similarity=(a, b))) == sorted((k, len(s), root[k]) for k, s in sets)
    linked = sum(b * len(x & y) >= a * len(x | y) for i, (_, x) in enumerate(sets) for _, y in sets[:i])
    assert linked > 0 and made[0] < 500


def test_bit_maps_differ_in_no_more_places_than_their_sets():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[: 2 * n], n, replace=False)) for n in (0, 1, 3, 60, 64, 65, 100, 128, 129, 300, 1000, 1030, 2500, 3000)]
    size = np.array([len(s) for s in sets])
    maps = ngram_join._BitMaps(ngram_join.bit_maps(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size))
    x, y = (v.ravel() for v in np.indices((len(sets), len(sets))))
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y)])
    found = maps.apart(x, y)
    assert (found <= real).all() and (found % 2 == real % 2).all() and (found[x == y] == 0).all()
    assert found[(size[x] == 60) & (size[y] == 100)] > 0


def test_spared_lists_leave_one_in_common():
    """For all sizes that can link, a link has more lists in common than either side leaves out."""
    for t in (ngram_join.Threshold(), ngram_join.Threshold(8, 10, 5)):
        for n in range(1, 700):
            for m in t.sizes(n):
                common = min(int(t.prefix(n)) - n, int(t.prefix(m)) - m) + t.overlap(n, m)
                assert common > ngram_join.EXTRA[0] * max(n - 2, m - 2, 0) // ngram_join.EXTRA[1]


def test_one_of_each_knows_rows_by_key_and_text(spark):
    a, b = cases.words(80, 21), cases.words(80, 22)
    frame = spark.createDataFrame([(1, a), (5, a), (5, b), (9, cases.words(80, 23)), (None, a), (7, None), (8, "")], "doc_id long, text string")
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (5, b), (9, cases.words(80, 23)), (None, a), (7, None), (8, "")], key=str)


def test_border_follows_the_cost():
    t = ngram_join.Threshold()
    assert t.border({500: 1000}) == 0
    assert t.border({8: 1000, 500: 10}) >= 8


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 201), (7, 7)]
    found = spark_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark))
    want = [(i, 100) for i in range(100, 161)] + [(200, 200), (201, 200)]
    assert rows(found) == want


def test_sentencepiece_equals_the_library(docs, small, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for frame in (docs, small.limit(60)):
        want = []
        for key, text in pairs(frame):
            ids = library.encode(text or "")
            want.append((key, len(ids), cases.sha(",".join(map(str, ids))), cases.sha(library.decode(ids))))
        assert rows(sentencepiece_codec.encoding_digests(frame, model)) == sorted(want)


def test_sentencepiece_on_random_text(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec, rng = sentencepiece_codec.Codec(model), random.Random(5)
    parts = ["a", "the", "  ", "\n", "é", "漢", "😀", "\r", " ", "▁", "\x00", "ing", "{", "er", "=", "0", "<0x0A>", "<s>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 333, "ab" * 500, "=" * 100, "x" + " " * 40 + "y"]
    codec.prepare(texts)
    for t in texts:
        assert codec.ids(t) == library.encode(t)
        assert codec.decode(codec.ids(t)) == library.decode(library.encode(t))


def plain_pii(text):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    out = [("email", *m.span()) for m in email.finditer(text)]
    for m in pii.IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in pii.CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        odd = sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])
        if 16 <= len(d) <= 19 and odd % 10 == 0:
            out.append(("card", *m.span()))
    for m in pii.PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_personal_data(docs, small):
    for frame in (docs, small):
        got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.find(frame).collect()}
        want = set()
        for key, text in pairs(frame):
            spans = plain_pii(text or "")
            counts = [sum(s[0] == k for s in spans) for k in pii.KINDS]
            want.add((key, cases.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), *counts))
        assert got == want


@pytest.mark.parametrize(
    "text, found",
    [
        ("mail jo (at) a [dot] example dot org now", [("email", 5, 36)]),
        ("write to jo.hn at example dot org please", [("email", 9, 33)]),
        ("call +four nine one two three four five six seven eight nine", [("phone", 5, 60)]),
        ("аdmin@ехample.com", [("email", 0, 17)]),
        ("10.0.0.1 and １０.０.０.２", [("ip", 0, 8), ("ip", 13, 21)]),
        ("we met at noon, dot", []),
        ("zero one two", []),
        ("a@b.de", [("email", 0, 6)]),
        ("1" * 5000 + ".1.1.1", []),
    ],
)
def test_disguised_personal_data(text, found):
    assert pii.all_spans(text)[1] == found
    suspect = pii.suspects(*pii.texts_of(pa.array([text])))[0]
    assert suspect or pii.all_spans(text)[0] == found


@pytest.mark.parametrize("text", ["write to jo.hn at example.org please", "Write to jo.hn\tAT\x1fex-ample.org, please"])
def test_at_before_a_written_dot(spark, text):
    spans, masked = [("email", 9, text.index("org") + 3)], text[:9] + "[EMAIL]" + text[text.index("org") + 3 :]
    frame = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert pii.all_spans(text)[1] == spans
    assert rows(pii.find(frame).select("doc_id", "spans"))[0] == (1, f"email:{spans[0][1]}:{spans[0][2]}")
    assert rows(pii.redact(frame).select("doc_id", "text"))[:2] == [(1, masked), (2, "nothing here")]


def test_no_rewritten_text_is_skipped():
    """Texts of what the transducers look for, in batches: each that one of them changes is suspected."""
    rng = random.Random(6)
    parts = [" ", " ", " ", "\n", "\t", "\x1c", "\u1680", "\u00a0", "  ", "at", "AT", "dot", "Dot", "(", ")", "[", "]", "<", ">", "@", "."]
    parts += [",", "-", "_", "'", "é", "×", "ſ", "ı", "K", "a", "jo", "example", "org", "12", "7", "x1", "а", "１", "漢"]
    parts += [*pii._DIGIT, *(n.upper() for n in pii._DIGIT), *(n.title() for n in pii._DIGIT)]
    names = [*pii._DIGIT, *(n.upper() for n in pii._DIGIT)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)]
    texts += [" ".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)]
    for _ in range(10_000):
        run = "".join(rng.choice(names + ["12"] * 4) + rng.choice([" ", " ", " ", "-", ", ", "\n", " dot ", "\u1680"]) for _ in range(rng.randint(1, 12)))
        texts.append(rng.choice(["", "(", "×", "'", "a "]) + run + rng.choice(["", ")", "×", " b"]))
    changed = np.array([pii.normalised(t).text != t for t in texts])
    suspect = pii.suspects(*pii.texts_of(pa.array(texts)))
    assert [t for t, c, s in zip(texts, changed, suspect) if c and not s] == []
    assert changed.sum() > 5000 and not suspect.all()
    assert not pii.suspects(*pii.texts_of(pa.array(["", None, "plain words", "at home", "one two"]))).any()


@pytest.mark.parametrize(
    "text, found",
    [
        ("host 192 dot 168 dot 1 dot 20", [("ip", 5, 29)]),
        ("host 192 dot 168 dot 1 dot 20, jo@a.org", [("email", 31, 39), ("ip", 5, 29)]),
        ("at one two seven dot zero dot zero dot one now", [("ip", 3, 42)]),
        ("one two seven.0 dot zero.1", [("ip", 0, 26)]),
        ("card four one one one 1111 1111 1111 now", [("card", 5, 36)]),
        ("card 4111 one one one one 1111-one-one-one-one", [("card", 5, 46)]),
        ("call +1 (two one two) five five five 0100", [("phone", 5, 41)]),
        ("call +four nine one two three four five six seven 89, 2021 left", [("phone", 5, 52)]),
        ("in 2019 one of two or three, four, five", []),
        ("the dot product, chapter 3 dot 4", []),
        ("uno 10.0.0.1 dos", [("ip", 4, 12)]),
        ("４111 1111 1111 1111 one of us", [("card", 0, 19)]),
        ("in two ４111 1111 1111 1111", [("card", 7, 26)]),
        ("five six seven eight at example dot org", [("email", 0, 39)]),
        ("one " * 3000 + "x", []),
        ("1 " * 3000 + "x", []),
    ],
)
def test_spelled_parts(text, found):
    assert pii.all_spans(text)[1] == found
    suspect = pii.suspects(*pii.texts_of(pa.array(["one", text, "two"])))
    assert suspect[1] or pii.normalised(text).text == text


def test_masking_keeps_other_columns(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[27].text == "mail [EMAIL] or [IP], card [CARD], call [PHONE]"
    assert got[27].n_chars == len(got[27].text) and got[10].text is None and got[10].n_chars is None


def test_fingerprints(docs, small):
    rank = rare_digest.ranks(rare_digest.histogram(small))
    for frame in (docs.where("doc_id <> 99"), small, docs.where("doc_id = 13"), docs.limit(0)):
        got = {r.doc_id: r for r in rare_digest.against_next(frame, rank).collect()}
        order = sorted(((k, t or "") for k, t in pairs(frame)), reverse=True)
        assert len(got) == len(order)
        prints = {}
        for i, (key, text) in enumerate(order):
            other = order[(i + 1) % len(order)][1]
            half = len(text) // 2
            new = text[: len(text) - half] + other[:half]
            r = got[key]
            assert (r.n_chars, r.edited_sha256) == (len(text), cases.sha(new))
            assert prints.setdefault(text, r.fingerprint) == r.fingerprint
            assert prints.setdefault(new, r.edited_fingerprint) == r.edited_fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert (r.fingerprint == "") == (text == "")


def test_fingerprints_in_several_buckets(small):
    from navspark.llm import neighbours

    rank = rare_digest.ranks(rare_digest.histogram(small))
    whole = rows(rare_digest.against_next(small, rank))
    kept, neighbours.BUCKET_BYTES = neighbours.BUCKET_BYTES, 20_000
    try:
        assert rows(rare_digest.against_next(small, rank)) == whole
    finally:
        neighbours.BUCKET_BYTES = kept


def test_entropy_levels():
    import math
    from collections import Counter

    texts = [b"the quick brown fox jumps over the lazy dog again and again, until it is tired" * 2, b"x" * 70, b"", b"short"]
    data, starts, ends = rare_digest.spaced(texts)
    level = rare_digest.levels(data)
    for a, b in zip(starts, ends):
        for i in range(a, b - 63):
            c = Counter(data[i : i + 64].tolist()).values()
            assert abs(level[i] + sum(v / 64 * math.log2(v / 64) for v in c) * 1000 / 6) <= 1.01
    fp = rare_digest.fingerprints(texts, rare_digest.ranks(np.bincount(level, minlength=1001)))
    assert rare_digest.likeness(fp[0], fp[0]) == 1 and rare_digest.likeness(fp[2], fp[2]) == 1
    assert rare_digest.likeness(fp[0], fp[2]) == 0 and rare_digest.likeness(fp[0], fp[3]) == rare_digest.likeness(fp[3], fp[0])


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "12")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = html_text.common(a, b)
        rest = iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in sorted(found))


PAGE = """<html><head><title>t &amp; u</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="cookie notice">Cookies?</div><article><h1>Head&nbsp;line</h1><p>One <b>bold</b>word &lt;x&gt; &am<p>Two
<br>lines<script>var t="</p>"</script><div class="ad">Buy</div><!-- hidden --><form><input>Name</form></article>
<section id="comments"><p>First!</p></section><aside>Side</aside><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    shared = "<body><div>Same menu</div><p>{}</p><div>Same end</div>"
    pages = [
        (1, "http://a.org/x/1", PAGE, "c"),
        (2, "http://b.org/x/1", shared.format("only one"), "c"),
        (3, "http://b.org/x/2", shared.format("only two"), "c"),
        (4, "http://c.org/x/2", shared.format("alone"), "c"),
        (5, None, None, None),
        (6, "", "", "c"),
        (7, "http://d.org/", "<p>plain & <i>un</i>closed <div class=ad>x<article>in <article>side", "c"),
        (8, "http://e.org/", "<nav>" + "deep " * 20000, "c"),
        *((k, f"http://f.org/y/{k}", shared.format("copied"), "c") for k in (20, 21, 22)),
        (23, "http://f.org/y/9", shared.format("unlike"), "c"),
        (24, "http://g.org/z", shared.format("lone copy"), "c"),
        (24, "http://g.org/z", shared.format("lone copy"), "c"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(frame).collect()}
    assert got[1][0] == "Head line One boldword <x> &am Two lines"
    assert [got[i][0] for i in (2, 3, 4, 5, 6, 8)] == ["only one", "only two", "Same menu alone Same end", "", "", ""]
    assert got[7][0] == "in side"
    assert [got[i][0] for i in (20, 21, 22, 23)] == ["copied", "copied", "copied", "unlike"]
    assert got[24][0] == "Same menu lone copy Same end"
    assert all(n == len(t) for t, n in got.values())
    assert html_text.extract(frame.limit(0)).collect() == []


def test_differences_tell_which_declared_element_is_the_article(spark):
    """A teaser and a path that all pages share go; quoted passages, shorter versions and lone pages stay whole."""
    shape = "<body><main><p>Home<p>News</p><article><h1>{}</h1><p>{}</article><article class=card><p>Latest story</article></main>"
    same = "One passage that several articles of the host quote."
    pages = [(k, f"http://a.org/x/{k}", shape.format(f"Head {k}", f"{same} <p>Text of {k}.")) for k in range(4)]
    pages += [(9, "http://b.org/", shape.format("Alone", same))]
    long = "A first paragraph. <p>A second one that is much longer than the teaser."
    pages += [(10, "http://c.org/1", shape.format("Version", long)), (11, "http://c.org/2", shape.format("Version", long + "<p>More."))]
    inner = "<article><p>Outer {0}<article><p>Quoted</article></article>"
    pages += [(k, f"http://d.org/{k}", inner.format(k)) for k in (20, 21)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert [got[k] for k in range(4)] == [f"Head {k} {same} Text of {k}." for k in range(4)]
    assert got[9] == f"Home News Alone {same} Latest story"
    assert got[10] == "Version " + long.replace("<p>", "") and got[11] == "Version " + long.replace("<p>", "") + " More."
    assert [got[k] for k in (20, 21)] == ["Outer 20 Quoted", "Outer 21 Quoted"]


def test_html_of_any_shape_is_read_in_linear_time():
    import time

    for unit in ("<a ", '<a ">"', "<a '", "<title>", "<!--", "<script>", "<", "<p class='"):
        start = time.process_time()
        html_text.lines_of(unit * 200_000)
        assert time.process_time() - start < 10, unit


def test_alignment_of_many_lines():
    a = [str(i) for i in range(6000)]
    assert sorted(html_text.common(a, a[::2] + ["new"] * 3000)) == list(range(0, 6000, 2))
    assert html_text.common(a, a) == set(range(6000)) and html_text.common(a, []) == set()


def test_pages_of_the_tables(spark, data):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in html_text.pages_text(spark, data).collect():
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|br|h1)>", inner)]
        assert r.text == " ".join(p for p in parts if p)
