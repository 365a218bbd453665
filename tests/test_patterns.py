import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lontar.operators import datasets as D
from lontar.operators import spans as P
from lontar.operators.patterns import Terms, term_spans


def by_patterns(text, terms):
    """What one regular expression a term finds."""
    out = set()
    for i, term in enumerate(terms):
        if words := term.split():
            out |= {(i, *m.span()) for m in re.finditer(rf"(?<!\w){r'\s+'.join(map(re.escape, words))}(?!\w)", text, re.IGNORECASE)}
    return out


HAND = [
    ("harga  barang naik, HARGA\n\tBarang turun; harga_barang", ["harga barang", "harga"]), ("harga_x xharga harga- (harga)", ["harga"]), ("a b a b a b a", ["a b a", "b a"]),
    ("c++ dan C++!", ["c++", "dan c++"]), ("Straße STRASSE straße", ["straße"]), ("İstanbul istanbul ıstanbul ſaya", ["istanbul", "saya"]), ("", ["x"]), ("x", ["", " "]),
    ("saham publik saham publik saham  publik", ["saham publik", "Saham  Publik"]), ("éa naïvé anak-anak", ["a", "naïve", "anak", "anak-anak"]),
]


@pytest.mark.parametrize(("text", "terms"), HAND)
def test_as_by_patterns(text, terms):
    assert sorted(Terms(terms).find(text)) == sorted(by_patterns(text, terms))


@settings(max_examples=300, deadline=None)
@given(st.text("abAB _-\n1é", max_size=40), st.lists(st.text("ab é_", max_size=6), max_size=5, unique=True))
def test_as_by_patterns_of_anything(text, terms):
    kept = [t for i, t in enumerate(terms) if " ".join(t.split()).lower() not in {" ".join(u.split()).lower() for u in terms[:i]}]
    assert sorted(Terms(kept).find(text)) == sorted(by_patterns(text, kept))


def test_many_terms(spark):
    """30,000 terms cost a text what a few do, and all are found."""
    terms = [f"kata{i} {i % 7}x" for i in range(30_000)] + ["harga barang"]
    texts = [(k, " ".join(f"KATA{(k * 997 + j) % 40_000}  {(k * 997 + j) % 40_000 % 7}X, harga" for j in range(300))) for k in range(40)] + [(99, None)]
    found = term_spans(spark.createDataFrame(texts, "doc_idx long, text string"), terms).collect()
    wanted = sum((k * 997 + j) % 40_000 < 30_000 for k in range(40) for j in range(300))
    assert len(found) == wanted and all(" ".join(r.surface.lower().split()) == r.aspect for r in found)
    text = " ".join(t for _, t in texts[:10])
    few, many = Terms(terms[:30]), Terms(terms)
    taken = {}
    for name, known in (("few", few), ("many", many)):
        began = time.perf_counter()
        known.find(text)
        taken[name] = time.perf_counter() - began
    assert taken["many"] < 20 * taken["few"]


def test_vocabulary(spark):
    texts = ["anak-anak a b-c Bagus bagus éabc x2 anak-2 ab--cd ef-", "ABC d'e fg_h -ij", None]
    rows = D.lowercase_vocabulary(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_idx long, text string")).collect()
    wanted = {m.group() for t in texts if t for m in re.finditer(r"\b[a-z][a-z\-]+\b", t)}
    assert {r.term for r in rows} == wanted and "anak-anak" in wanted and "b-c" in wanted


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[1], s[2])):
        if not any(k[0] < s[1] and s[0] < k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6), st.sampled_from("ab")), max_size=40))
def test_choice_as_by_a_loop(spark, made):
    spans = [(a, a + n, x) for a, n, x in made]
    frame = spark.createDataFrame([(1, a, b, x) for a, b, x in spans], "doc_idx long, start int, end int, aspect string")
    assert sorted((r.start, r.end, r.aspect) for r in P.resolve_overlaps(frame).collect()) == greedy(spans)


def test_choice_among_many_spans(spark):
    """64,000 spans of one document: time in proportion, as a sweep over disjoint pieces tells."""
    rng = np.random.default_rng(2)
    starts, sizes = rng.integers(0, 400_000, 64_000), rng.integers(1, 12, 64_000)
    frame = spark.createDataFrame([(1, int(a), int(a + n), "x") for a, n in zip(starts, sizes, strict=True)], "doc_idx long, start int, end int, aspect string").persist()
    frame.count()
    began = time.perf_counter()
    found = sorted((r.start, r.end) for r in P.resolve_overlaps(frame).collect())
    assert time.perf_counter() - began < 20
    taken = np.zeros(400_100, bool)
    for n, a in sorted(zip(-sizes, starts, strict=True)):
        if not taken[a] and not taken[a - n - 1]:
            taken[a : a - n] = True
    assert sum(b - a for a, b in found) == taken.sum() and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_stem_windows_of_many_aspects(spark):
    """10,000 aspects: windows of stems meet them by hash; the same as a loop over words."""
    from lontar.functions.stem import stem

    roots = frozenset({"layan", "harga", "barang", "kirim"})
    d = spark.createDataFrame([(0, "pelayanannya bagus, harganya barangnya murah"), (1, "harga barang kirim harga barang"), (2, None)], "doc_idx long, text string")
    aspects = [f"kata{i} lain{i}" for i in range(10_000)] + ["layanan", "harga barang", "harga barang kirim", "barang"]
    found = sorted((r.doc_idx, r.aspect, r.surface) for r in P.stem_spans(d, aspects, roots=roots).collect())
    wanted = []
    for i, text in ((0, "pelayanannya bagus, harganya barangnya murah"), (1, "harga barang kirim harga barang")):
        words = [(m.start(), m.end(), stem(m[0].lower(), roots)) for m in re.finditer(r"\w+", text)]
        for a in aspects[-4:]:
            stems = [stem(p, roots) for p in a.split()]
            for k in range(len(words) - len(stems) + 1):
                if [w[2] for w in words[k : k + len(stems)]] == stems:
                    wanted.append((i, a, text[words[k][0] : words[k + len(stems) - 1][1]]))
    assert found == sorted(wanted) and len(found) > 5
