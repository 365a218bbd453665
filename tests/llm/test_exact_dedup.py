import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lontar.llm.exact_dedup import exact_dedup, op1_exact_dedup, owner_start, rice_decode, rice_encode
from tests.llm.cases import awkward, frame, table


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep, sha, seen = max((i for i in ids if i is not None), default=None), hashlib.sha256(t.encode()).hexdigest(), set()
        for i in ids:
            out.append((i, keep, len(ids), i == keep and i not in seen, sha))
            seen.add(i)
    return Counter(out)


def test_awkward(spark):
    rows = awkward()
    found = exact_dedup(frame(spark, rows)).collect()
    assert Counter(map(tuple, found)) == brute([(r[0], r[1]) for r in rows])


def test_empty(spark):
    assert exact_dedup(frame(spark, [])).collect() == []


def test_hot_group_over_many_owners(spark):
    rows = [(i, "Same text" if i % 3 else f"text {i // 4}", None, None, 0, None, None, None, None) for i in range(600)]
    assert Counter(map(tuple, exact_dedup(frame(spark, rows, 7), owners=5).collect())) == brute([(r[0], r[1]) for r in rows])


def test_unsuspected_rows_are_not_shuffled(spark):
    """Of 4,000 different texts and 40 copies only what the filter hits meets an exchange."""
    rows = [(i, f"text {i}" if i < 4000 else "copy", None, None, 0, None, None, None, None) for i in range(4040)]
    found = exact_dedup(frame(spark, rows, 6))
    assert Counter(map(tuple, found.collect())) == brute([(r[0], r[1]) for r in rows])

    def walk(node):
        yield node
        if "QueryStage" in node.nodeName():
            yield from walk(node.plan())
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    plan = found._jdf.queryExecution().executedPlan()
    stages = [n for n in walk(plan.executedPlan() if "Adaptive" in plan.nodeName() else plan) if n.nodeName().startswith("ShuffleQueryStage")]
    most = max(int(str(n.getRuntimeStatistics().rowCount().get())) for n in stages)
    assert stages and most < 200


def test_table(spark, tables):
    assert Counter(map(tuple, op1_exact_dedup(spark, tables).collect())) == brute([(r["doc_id"], r["text"]) for r in table(tables, "documents")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200, unique=True))
def test_golomb_code_round_trip(values):
    x = np.sort(np.array(values, np.uint64))
    gaps = np.diff(x, prepend=np.uint64(0))
    k, unary, rest = rice_encode(gaps)
    assert (np.cumsum(rice_decode(len(x), k, unary, rest), dtype=np.uint64) == x).all()


def test_owner_ranges():
    for owners in (1, 3, 8, 211):
        for owner in range(owners):
            start = owner_start(owner, owners)
            assert (start >> 32) * owners >> 32 == owner
            assert owner == 0 or ((start - 1) >> 32) * owners >> 32 == owner - 1
