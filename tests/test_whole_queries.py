"""Queries that SQL can't express, over whole tables, against plain loops."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lontar.functions.stem import stem
from lontar.lexicons import ROOTS, VERBAL_PREFIXES
from lontar.plans import registry
from lontar.plans.common import ASPECTS
from tests.test_density import brute_tree


@pytest.fixture(scope="module")
def texts(tables):
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{tables}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def literal(text, names):
    low = text.lower()
    return [(n, m.start(), m.start() + len(n)) for n in names for m in re.finditer(rf"(?<![^\W_])(?={re.escape(n)}(?![^\W_]))", low)]


def by_stems(text, names, roots):
    words, found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text)], []
    known = {w: stem(w, roots) for w in {w for _, _, w in words}}
    for name in names:
        parts = re.findall(r"\w+", name)
        stems = [stem(p, roots) for p in parts]
        for k in range(len(words) - len(parts) + 1):
            window = words[k : k + len(parts)]
            verbal = any(w.startswith(p) and not part.startswith(p) for (_, _, w), part in zip(window, parts, strict=True) for p in VERBAL_PREFIXES)
            if not verbal and [known[w] for _, _, w in window] == stems:
                found.append((name, window[0][0], window[-1][1]))
    return found


def occurrences(text, names, roots):
    by_word = literal(text, names)
    have = {n for n, _, _ in by_word}
    return by_word + [s for s in by_stems(text, [n for n in names if n not in have], roots)]


def test_rule_based_aspects(spark, tables, texts):
    wanted = Counter(n for _, t in texts for n, _, _ in occurrences(t, ASPECTS, ROOTS))
    found = registry.queries()["rule_based_aspects"](spark, tables).collect()
    assert {r.aspect: r["count"] for r in found} == dict(wanted)
    assert all(r["count"] == r.lexical_matches and r.semantic_matches == 0 for r in found)
    assert [r["rank"] for r in sorted(found, key=lambda r: -r["count"])] == list(range(1, len(found) + 1)) or len(set(wanted.values())) < len(wanted)


def test_lexicon_annotation(spark, tables, texts):
    wanted = set()
    for i, t in texts:
        spans = occurrences(t, ["reason", "heit"], frozenset({"reason", "heit"})) + literal(t, ["the"])
        kept = []
        for n, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[1], s[2], s[0])):
            if not any(x < b and a < y for _, x, y in kept):
                kept.append((n, a, b))
        wanted |= {(i, *s) for s in kept}
    found = [(r.doc_idx, r.aspect, r.start, r.end) for r in registry.queries()["lexicon_annotation"](spark, tables).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_reachability_tree(spark, tables):
    rows = pq.read_table(f"{tables}/embeddings.parquet").to_pylist()
    first = {}
    for r in sorted(rows, key=lambda r: r["vec_id"]):
        first.setdefault(tuple(r["embedding"]), [r["vec_id"], 0])[1] += 1
    points, (ids, weights) = np.array(list(first), dtype=float), zip(*first.values(), strict=True)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = [sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:6] for i in range(len(ids))]
    core = []
    for i, others in enumerate(near):
        held, at = weights[i] - 1, 0.0
        for j in others:
            if held >= 2:
                break
            held, at = held + weights[j], d[i, j]
        core.append(at)
    edges = {(max(d[i, j], core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j])) for i, others in enumerate(near) for j in others}
    tree = brute_tree(edges)
    found = registry.queries()["reachability_tree"](spark, tables).collect()
    assert len(found) == len(tree) and np.isclose(sum(r.reach for r in found), sum(w for w, _, _ in tree), atol=1e-3)
    assert registry.queries()["neighbour_recall"](spark, tables).first().recall == 1.0
