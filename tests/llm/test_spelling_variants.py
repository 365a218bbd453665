import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lontar.llm.spelling_variants import _MULTIPLIER, mixed, near_words, neighbourhood, op11_spelling_variants, spelling_variants
from tests.llm.cases import awkward, frame, table

LETTERS = "abzéÿ"


def neighbours(word, alphabet):
    """All words one edit away, as a list: a repeated one would show."""
    made = {word[:i] + word[i + 1 :] for i in range(len(word))}
    made |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    made |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return sorted(made - {word})


def brute(rows, least=6, occurrences=5, ratio=5, damage=0):
    counts = Counter()
    for i, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    voc = {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}
    alphabet = set("".join(voc))
    form, near = {}, {}
    for w, n in voc.items():
        found = [x for x in neighbours(w, alphabet) if x in voc]
        near[w] = len(found)
        best = min(found, key=lambda x: (-voc[x], x), default=None)
        form[w] = best if best and voc[best] >= ratio * n else None
    out = []
    for w, n in voc.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], voc[form[w]] if form[w] else None))
    return Counter(out)


def polynomial(word):
    total = 0
    for i, c in enumerate(word.encode("latin-1")):
        total = (total + c * pow(_MULTIPLIER, i, 1 << 64)) % (1 << 64)
    return int(mixed(np.array([total], np.uint64), len(word))[0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(LETTERS, min_size=4, max_size=4), min_size=1, max_size=4))
def test_neighbourhood_is_whole_and_each_word_comes_once(words):
    alphabet = np.frombuffer(LETTERS.encode("latin-1"), np.uint8)
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), 4)
    longer, made = {"delete": 3, "replace": 4, "insert": 5}, [[] for _ in words]
    for kind, _, hashes, new in neighbourhood(4, codes, alphabet):
        for row, (x, m) in enumerate(zip(hashes, new, strict=True)):
            made[row] += mixed(x[m], longer[kind]).tolist()
    for word, found in zip(words, made, strict=True):
        assert sorted(found) == sorted(polynomial(x) for x in neighbours(word, LETTERS))


def test_awkward(spark):
    rows = awkward() + [(100 + i, "Straße straßen Éclair éclair eclàir eclair eclairs× ÷÷÷÷÷÷ İstanbul", None, None, 0, None, None, None, 0) for i in range(7)]
    plain = [(r[0], r[1]) for r in rows]
    for damage in (0, 3):
        assert Counter(map(tuple, spelling_variants(frame(spark, rows), damage=damage).collect())) == brute(plain, damage=damage)
    assert Counter(map(tuple, spelling_variants(frame(spark, rows), least=1, occurrences=1, ratio=2, damage=5).collect())) == brute(plain, 1, 1, 2, 5)


def test_forms_lead_to_the_last(spark):
    """Counts 1, 5, 25, 125: each word's form is the next, the first word's root the last; of equal counts the smaller wins."""
    texts = ["abcdef"] + ["abcdeg"] * 5 + ["abcdgg"] * 25 + ["abcggg"] * 125 + ["abcddf", "bbcdef"]
    rows = [(i, t, None, None, 0, None, None, None, 0) for i, t in enumerate(texts)]
    found = {r.word: r for r in spelling_variants(frame(spark, rows), occurrences=1).collect()}
    assert (found["abcdef"].form, found["abcdef"].root, found["abcdef"].n_near) == ("abcdeg", "abcggg", 3)
    assert (found["abcggg"].form, found["abcggg"].root, found["abcddf"].form, found["bbcdef"].n_near) == (None, "abcggg", None, 1)


def test_long_words(spark):
    word = "ab" * 2500
    rows = [(i, w, None, None, 0, None, None, None, 0) for i, w in enumerate([word, word[:-1], word[:1200] + "c" + word[1201:], "b" + word])]
    found = {len(r.word): r.n_near for r in spelling_variants(frame(spark, rows), occurrences=1).collect() if r.word != word}
    assert found == {4999: 1, 5000: 1, 5001: 1}


def test_empty(spark):
    assert spelling_variants(frame(spark, [])).collect() == []
    assert spelling_variants(frame(spark, [(1, "short", None, None, 0, None, None, None, 0)])).collect() == []


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr("lontar.llm.spelling_variants.FILTER_BITS", (15, 15))
    words = sorted({f"w{i:b}".replace("0", "o").replace("1", "i") for i in range(3000)})
    found = {tuple(r) for r in near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {(w, c) for c, w in found} == {(w, x) for w in words for x in neighbours(w, "wio") if x in set(words)}


def test_table(spark, tables):
    assert Counter(map(tuple, op11_spelling_variants(spark, tables).collect())) == brute([(r["doc_id"], r["text"]) for r in table(tables, "documents")], damage=199)
