import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lontar.llm.exact_search import MOST, Postings, exact_search, op12_exact_search
from tests.llm.cases import table

KIND = "vec_id long, embedding array<double>, row string, q string, weights long, rank string"


def brute(rows, k=5):
    """rows: (vec_id, components)."""
    kept = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-MOST, min(MOST, math.floor(256 * x))) for x in v]))
    out = Counter()
    for a, (query, w) in enumerate(kept):
        if query is None or query % 50:
            continue
        found = sorted(((-sum(x * y for x, y in zip(w, v, strict=False)), i is None, i or 0) for b, (i, v) in enumerate(kept) if a != b))[:k]
        out.update((query, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(found, 1))
    return out


def search(spark, rows, parts=5, **more):
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c") for r in rows], KIND).repartition(parts)
    return Counter(map(tuple, exact_search(docs, **more).collect()))


def test_awkward(spark):
    rows = [
        (0, [1.0, -0.5, 0.003]), (50, [1.0, -0.5, 0.003]), (50, [1.0, -0.5, 0.003]), (100, []), (150, None), (200, [float("nan"), 1.0]), (-50, [float("inf")]), (250, [1.0, None]),
        (None, [2.0, 2.0, 2.0]), (None, [1e30, -1e30, 0.5]), (1, [0.5]), (2, [0.001, 0.001]), (3, [-0.001]), (4, [2.0, 0.0, 0.0, 9.0]), (300, [1e12, -3e20, 1.0, 1.0]), (7, [1e12, 1e12, 1e12, 1e12]),
        (5, [1.0, -0.5, 0.003]), (6, [1.0, -0.5, 0.003]), (2**53 + 1, [0.5, 0.25]), (-(50 * 2**40), [-3.0, 1.0]),
    ]
    assert search(spark, rows) == brute(rows)
    assert search(spark, rows, k=50) == brute(rows, 50)


def test_few_and_none(spark):
    assert search(spark, [(0, [1.0])], 1) == Counter()
    assert search(spark, [(0, [1.0]), (3, [-1.0])], 1) == brute([(0, [1.0]), (3, [-1.0])])
    empty = spark.createDataFrame([], KIND)
    assert exact_search(empty).collect() == [] and exact_search(empty).columns == ["query_id", "rank", "vec_id", "score"]
    assert search(spark, [(1, [1.0]), (2, [1.0])], 1) == Counter()  # no queries


def test_blocks_and_a_common_vector(spark):
    """Several blocks of queries and of candidates; a third of the rows are one vector, so ties cross the blocks."""
    made = np.random.default_rng(3).normal(0, 0.3, (9000, 6))
    made[made > 0.4] = 0.0  # lists that are not full
    made[::3] = [0.5, 0.5, 0.0, 0.5, 0.25, 0.5]
    w = np.floor(256 * made).astype(np.int64)
    expected = Counter()
    for q in range(0, 9000, 50):
        scores = w @ w[q]
        order = [i for i in np.lexsort((np.arange(9000), -scores)) if i != q][:5]
        expected.update((q, r, int(i), int(scores[i])) for r, i in enumerate(order, 1))
    frame = spark.createDataFrame(list(enumerate(made.tolist())), "vec_id long, embedding array<double>").repartition(6)
    found = exact_search(frame)
    assert Counter(map(tuple, found.collect())) == expected


def test_postings_skip_zero_weights():
    lists = Postings(np.arange(3), np.array([5, 6, 7]), np.zeros(3, bool), np.array([2, 2, 1]), np.array([4, 0, 0, 3, 2])).lists
    assert {t: (None if p is None else p.tolist(), w.tolist()) for t, (p, w) in lists.items()} == {0: ([0, 2], [4, 2]), 1: ([1], [3])}


def test_other_vectors(spark):
    docs = spark.createDataFrame([(10, [1.0, 2.0]), (20, [3.0, 1.0]), (3, [0.5, 0.5])], "k long, v array<float>")
    found = exact_search(docs, k=1, every=10, scale=2, id_col="k", vector_col="v").orderBy("query_id").collect()
    assert [tuple(r) for r in found] == [(10, 1, 20, 20), (20, 1, 10, 20)]


def test_table(spark, tables):
    assert Counter(map(tuple, op12_exact_search(spark, tables).collect())) == brute([(r["vec_id"], r["embedding"]) for r in table(tables, "embeddings")])


def test_one_list_a_query_row(spark):
    docs = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), (F.col("id") % 7).cast("double")).alias("embedding"))
    assert {r["count"] for r in exact_search(docs.union(docs)).groupBy("query_id").count().collect()} == {10}
