"""Spelling variants, line-first cleaning and phrase mining against brute force, and on odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import cleaning, collocation, langid, spelling

TEXT = "doc_id long, text string"


# --- spelling ----------------------------------------------------------------------------------


def _lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _variants(docs, min_chars=6, min_count=5, ratio=5, every=199):
    """Every pair of words compared."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", _lower(text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}
    form = {}
    out = {}
    for w in n:
        near = [x for x in n if _near(w, x)]
        best = min(near, key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [form[w], None, n[w], len(near), n[form[w]] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def _found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_against_all_pairs(frame):
    rng = random.Random(5)
    stems = ["Garden", "mother", "évident", "straße", "brother", "aabbcc", "wxyzwx"]
    docs = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(40)):
            w = list(rng.choice(stems))
            if rng.random() < 0.3:
                at, do = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (do > 0)] = [] if do == 1 else [rng.choice("abcdeéxz")]
            words.append("".join(w))
        docs.append((i if i % 9 else None, " ".join(words) + ("," if i % 2 else "\n")))
    got = _found(spelling.spelling_variants(frame(docs, TEXT), every=17))
    assert got == _variants(docs, every=17)
    assert any(v[0] for v in got.values()) and any(v[3] > 3 for v in got.values())


def test_chains_lead_to_one_root(frame):
    # each word is one letter from the next and five times rarer: the first's root is five steps away
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg"]
    docs = [(i, " ".join([w] * (5 * 5**i))) for i, w in enumerate(words)]
    got = _found(spelling.spelling_variants(frame(docs, TEXT), every=10**9))
    assert got == _variants(docs, every=10**9)
    assert {v[1] for v in got.values()} == {"akjihg"}


def test_long_words_and_pairs_share_one_key(frame, spark):
    rng = random.Random(1)
    long = ["".join(rng.choice("ab") for _ in range(n)) for n in (127, 128, 129, 300)]
    words = [x for w in long for x in (w, w[:50] + w[51:], w[:50] + "c" + w[50:], w[:50] + "d" + w[51:])] + ["a" * 20_000, "a" * 19_999]
    words = list(dict.fromkeys(words))
    docs = [(i, " ".join([w] * 5)) for i, w in enumerate(words)]
    got = _found(spelling.spelling_variants(frame(docs, TEXT), every=10**9))
    want = {w: sum(_near(w, x) for x in words) for w in words if len(w) < 1000} | {"a" * 20_000: 1, "a" * 19_999: 1}
    assert {w: v[3] for w, v in got.items()} == want
    letters = ["".join(rng.choice("ab") for _ in range(n)) for n in (6, 7) for _ in range(60)]
    table = spark.createDataFrame([(i, w, 5) for i, w in enumerate(dict.fromkeys(letters))], "id long, word string, n long")
    pairs = [(r["a"], r["b"]) for r in spelling.near_pairs(table).collect()]
    known = sorted(set(letters))
    assert len(pairs) == len(set(pairs)) == sum(_near(a, b) for i, a in enumerate(known) for b in known[:i])


def test_spelling_of_odd_tables(odd, empty, frame, monkeypatch):
    got = _found(spelling.spelling_variants(odd, min_chars=3, min_count=2, every=10**9))
    assert got["word"][2] == 30_000 and got["the"][2] == 12 and "é" not in got
    assert spelling.spelling_variants(empty).count() == 0
    ties = frame([(1, "gardens " * 50 + "gardena " * 50 + "garden " * 5)], TEXT)
    assert _found(spelling.spelling_variants(ties, every=10**9))["garden"][:2] == ("gardena", "gardena")
    monkeypatch.setattr(spelling, "SLICE", 7)
    counted = Counter()
    for word, n in spelling.varied("1", "abc def abc, abcdefghi abc", 10**9):
        counted[word] += n
    assert counted == {"abc": 3, "def": 1, "abcdefghi": 1}
    assert "".join(spelling._slices("abcdefghij klm nopqrstuvw xyz")) == "abcdefghij klm nopqrstuvw xyz"


# --- cleaning ----------------------------------------------------------------------------------


PROSE = "The garden was full of light that morning and nobody spoke for a long while, since there was nothing left to say about it."


def _base(text):
    """The base counts, word by word."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_counts_against_brute_force(frame):
    rng = random.Random(11)
    docs = []
    for i in range(300):
        vocabulary = ["a", "b", "c", "Ä", "#x", "y|", "\x0b", "the", "The"][: rng.randrange(2, 9)]
        docs.append((i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "\t", "  ", "\r\n", "\x0c"]) for _ in range(rng.randrange(120)))))
    got = {r["doc_id"]: r for r in cleaning.judged(frame(docs, TEXT)).collect()}
    for doc, text in docs:
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(text)


@pytest.mark.parametrize(
    ("line", "defect"),
    [
        (PROSE, None),
        ("Of.", None),
        ('He said "go."', None),
        ("Home | News | Sport | Weather | More", "symbols"),
        ("Home › News › Sport › Weather", "navigation"),
        ("word*** word%%% other&&& more$$$", "symbols"),
        ("Read More about this story on our pages today.", "boilerplate"),
        ("Copyright 2020, ALL RIGHTS RESERVED.", "boilerplate"),
        ("Contact", "punctuation"),
        ("a line that stops in the middle of", "punctuation"),
        (PROSE + " And then the last sentence breaks off in the", None),
    ],
)
def test_line_rules(line, defect):
    assert cleaning.line_defect(line.encode()) == defect


def test_documents_are_judged_by_what_lines_lose(frame):
    clean = PROSE + " " + " ".join(f"Then word{i} met another{i} at noon{i}." for i in range(20))
    menu = "Home | News | Sport | Weather | More | Contact | Imprint | Search"
    docs = [(1, clean), (2, f"{menu}\n{clean}\n{menu} {menu}"), (3, "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(20))), (4, "short."), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in cleaning.judged(frame(docs, TEXT)).collect()}
    assert {k for k, r in got.items() if r["kept"]} == {1, 2} and not got[3]["base_failed"] and got[4]["base_failed"]
    assert got[2]["clean_text"] == clean and got[2]["n_failed_lines"] == 2 and got[1]["clean_text"] == clean
    kept = cleaning.cleaned(frame([(*d, "x") for d in docs], TEXT + ", kept string"))
    assert kept.columns == ["doc_id", "text", "kept"] and sorted((r["doc_id"], r["text"], r["kept"]) for r in kept.collect()) == [(1, clean, "x"), (2, clean, "x")]


def test_cleaning_of_odd_tables(odd, empty, frame):
    out = cleaning.judged(odd.withColumnRenamed("n", "n_words").withColumnRenamed("key", "Kept"))
    assert out.columns[: len(odd.columns)] == [{"n": "n_words", "key": "Kept"}.get(c, c) for c in odd.columns]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count() and rows[7]["_n_words"] == 30_000 and rows[7]["n_repeat_words"] == 30_000 and not rows[7]["_kept"]
    assert rows[1]["base_failed"] and rows[1]["word_chars"] == 0 and rows[8]["word_chars"] == 1
    assert cleaning.judged(empty).count() == 0 and cleaning.cleaned(empty).count() == 0
    unlike = "".join(f"w{i} " for i in range(200_000))
    assert cleaning.repeated_words(unlike.encode().split()) == 0 and cleaning.repeated_words((unlike * 2).encode().split()) == 400_000


# --- phrases -----------------------------------------------------------------------------------


DOCS = "doc_id long, lang string, text string"


def _phrases(docs, least=10, share=50, top=2000, longest=3):
    """Every phrase counted by list."""
    count, total = defaultdict(Counter), Counter()
    for _, lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", _lower(text or "")):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            if any(100 * b >= share * a for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def _mined(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "x1", "house", "red", "a-b", "'s", "Ä", "\xa0", "zz\x00y"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "; ", "\x0b", "\r\n"]
    return [(i, rng.choice(["en", "en", None, "de"]), "".join(rng.choice(words[: rng.randrange(3, 13)]) + rng.choice(marks) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("longest", [3, 4])
def test_phrases_against_lists(frame, longest):
    docs = _corpus(2) + [(1000 + i, "en", "the red house of the red house") for i in range(12)]
    got = _mined(collocation.collocations(frame(docs, DOCS), longest=longest))
    assert got == _phrases(docs, longest=longest) and len(got) > 20


def test_top_and_share(frame):
    docs = _corpus(3)
    assert _mined(collocation.collocations(frame(docs, DOCS), least=5, share=90, top=7)) == _phrases(docs, least=5, share=90, top=7)


def test_bitmaps_extend_within_pieces():
    text = ("a b a b, b a " * 40 + "a. a a a").encode()
    maps = collocation.Bitmaps(collocation._packed(0, {"en": [text], "de": [b"a b"]}).to_pylist()[0])
    counts = Counter()
    for own in maps.ranges():
        a, b, n, _ = collocation._grouped(*maps.extended(*own), len(maps.words))
        for x, y, k in zip(a, b, n, strict=True):
            counts[maps.langs[maps.lang_of[x]], maps.words[x], maps.words[y]] += int(k)
    want = Counter()
    for lang, t in (("en", text), ("de", b"a b")):
        for piece in re.split(b"[.,]", t):
            w = piece.split()
            want.update((lang, x, y) for x, y in zip(w, w[1:], strict=False))
    assert counts == want
    assert maps.mask.dtype == np.uint16 and np.bitwise_count(maps.mask).sum() == len(re.findall(rb"\w", text)) + 2


def test_ranges_follow_words(monkeypatch):
    monkeypatch.setattr(collocation, "MEETINGS", 50)
    row = collocation._packed(0, {"en": [b"a b c d e f g " * 200, b"x y"]}).to_pylist()[0]
    maps = collocation.Bitmaps(row)
    parts = list(maps.ranges())
    assert len(parts) > 3 and np.array_equal(np.concatenate([p[0] for p in parts]), maps.word)
    assert all(a[0][-1] < b[0][0] for a, b in zip(parts, parts[1:], strict=False))
    assert list(collocation.Bitmaps(collocation._packed(0, {"en": [b" . "]}).to_pylist()[0]).ranges()) == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocation, "SHARD_BYTES", 10)
    raw = "aa bb cc. dd ee ff gg hh ii jj, kk".encode()
    assert list(collocation._parts(raw)) == [b"aa bb cc. dd ee ff gg hh ii jj,", b" kk"] and b"".join(collocation._parts(raw * 9)) == raw * 9


def test_unlike_pairs_of_one_hash_are_told_apart():
    # all pairs of one hash: the first pass lets them all through, the second counts each phrase by itself
    row = collocation._packed(0, {"en": [b"a b c. a b. c a. b c"]}).to_pylist()[0]
    run = collocation._counted(3)
    old = collocation._pair_hash
    collocation._pair_hash = lambda h, a, b: np.zeros(len(a), np.int64)
    try:
        left = pa.Table.from_pylist([row])
        got = {(r["phrase"]): r["n"] for r in run(left, pa.table({"shard": pa.array([0], pa.int64()), "h": pa.array([0], pa.int64())})).to_pylist()}
    finally:
        collocation._pair_hash = old
    assert got == {"a": 3, "b": 3, "c": 3, None: 9, "a b": 2, "b c": 2, "c a": 1, "a b c": 1}


def test_phrases_of_odd_tables(odd, empty):
    got = _mined(collocation.collocations(odd))
    assert {g[0] for g in got} == {"en"} and got[0][2] == "word word word" and got[0][3] == 29_998
    assert collocation.collocations(empty).count() == 0


# --- language mixtures: the search over sets against all sets -----------------------------------


def _best_set(like, cost):
    """(objective, set, proportions) of the best of all sets of languages, each by many rounds of EM."""
    n, langs = like.shape
    best = None
    for bits in range(1, 1 << langs):
        own = [i for i in range(langs) if bits >> i & 1]
        share = np.full(len(own), 1 / len(own))
        for _ in range(400):
            joint = like[:, own] * share
            share = (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0) / n
        value = np.log((like[:, own] * share).sum(axis=1)).sum() - cost * (len(own) - 1)
        if best is None or value > best[0] + 1e-9:
            best = (value, tuple(own), dict(zip(own, share, strict=True)))
    return best


def test_language_sets_against_all_sets():
    rng = np.random.default_rng(8)
    langs, right, near, several = 4, 0, 0, 0
    texts = []
    for _ in range(150):
        kinds = rng.choice(langs, size=rng.integers(1, 4), replace=False)
        words = int(rng.integers(3, 250))
        ll = rng.normal(-30, 3, (words, langs))
        ll[np.arange(words), rng.choice(kinds, words)] += rng.uniform(2, 9)
        texts.append(ll)
    bounds = np.cumsum([0, *[len(t) for t in texts]])
    chosen = langid._mixtures(np.concatenate(texts), np.ones(bounds[-1]), bounds[:-1], 12, 2.0)
    for ll, share in zip(texts, chosen, strict=True):
        like = np.exp(ll - ll.max(axis=1, keepdims=True))
        cost = 2.0 * np.log(len(ll) + 1.0)
        value, own, best = _best_set(like, cost)
        got = tuple(np.flatnonzero(share))
        right += max(best, key=best.get) == share.argmax()
        mine = np.log((like * share).sum(axis=1)).sum() - cost * (len(got) - 1)
        near += mine >= value - 1.0
        several += len(own) > 1
    assert several > 30 and right >= 147 and near >= 145, (right, near, several)
