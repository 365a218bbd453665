from collections import Counter, defaultdict

import pytest

from lontar.llm.source_mixing import mix_sources, op6_source_mixing
from tests.llm.cases import awkward, frame


def targets(sizes):
    """Weights 1, 2, 3 by source in order, null last; at most 3 times the size; the excess goes on by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, todo, out = sum(sizes.values()), set(order), {}
    while todo:
        total = sum(weight[s] for s in todo)
        full = {s for s in todo if left * weight[s] / total >= 3 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in todo}
        for s in full:
            out[s] = 3 * sizes[s]
        left -= sum(3 * sizes[s] for s in full)
        todo -= full
    return out


def check(rows):
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for s, size, source_size, t, n in rows:
        sizes[s] += size
        taken[s] += n
        target[s] = t
        most[s] = max(most[s], size)
        assert n in (0, size, 2 * size, 3 * size)
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 3 * most[s] + 1e-6


def test_awkward(spark):
    rows = awkward()
    found = mix_sources(frame(spark, rows))
    got = found.select("_row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    check(got)
    assert Counter(found.select("_row.doc_id", "taken").collect()) == Counter(mix_sources(frame(spark, rows, 1)).select("_row.doc_id", "taken").collect())


def test_hot_source_and_ties(spark):
    rows = [(i, "w " * (i % 5 + 1), None, "hot" if i % 3 else f"s{i % 7}", 0, None, None, None, None) for i in range(900)]
    check(mix_sources(frame(spark, rows)).select("_row.source", "size", "source_size", "target", "taken").collect())


def test_empty(spark):
    assert mix_sources(frame(spark, [])).collect() == []


def test_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "source")
    check(op6_source_mixing(spark, tables).join(docs, "doc_id").select("source", "size", "source_size", "target", "taken").collect())
