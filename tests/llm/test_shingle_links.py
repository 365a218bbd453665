from collections import defaultdict
from itertools import combinations

import corpus_pipeline as C
import numpy as np
from lontar.llm.common import materialize
from lontar.llm.shingle_links import parity
from tests.llm.cases import SCHEMA
from tests.llm.test_simhash_dedup import slow_fingerprint


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(s, t):
    return bool(s and t) and 5 * len(s & t) >= 4 * len(s | t)


def groups_of(rows):
    """Sets of ids of each component over all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    sets, prints, parent = [shingle_set(t) for t in texts], [slow_fingerprint(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4 or alike(sets[i], sets[j]):
            parent[find(i)] = find(j)
    found, at = defaultdict(set), {t: i for i, t in enumerate(texts)}
    for d, t in rows:
        found[find(at[t or ""])].add(d)
    return list(found.values())


def survivors(rows):
    return {min((d for d in g if d is not None), default=None) for g in groups_of(rows)}


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 3, 40, 700, 5000):
        a = np.unique(rng.integers(-(2**63), 2**63, n))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 9], rng.integers(-(2**63), 2**63, n // 5)]))
        x, y = parity(a), parity(b)
        w = min(len(x), len(y))
        x, y = (v if len(v) == w else v[:w] ^ v[w:] for v in (x, y))
        differ = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and differ >= 0.5 * len(np.setxor1d(a, b))


def test_near_copies_beyond_four_bits_go(spark):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [f"kata{x}" for x in rng.integers(0, 5000, 60 + 17 * family)]
        for copy in range(6):  # one to several changed words: similarities on both sides of 0.8
            text = list(base)
            for at in rng.integers(0, len(text), copy * len(text) // 90):
                text[at] = f"lain{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame([(i, t, "id", "s", 1, "x", None, "y", 7) for i, t in rows], SCHEMA)
    want = survivors(rows)
    assert 12 < len(want) < len(rows)
    assert {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()} == want


def test_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    good = materialize(C.lines(spark, materialize(C.quality(spark, docs, ""), "q"), ""), "l")
    want = survivors([(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()])
    assert {r.doc_id for r in C.near_duplicates(spark, good, "").collect()} == want
