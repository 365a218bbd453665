"""How often steps pass over the corpus, and what they shuffle."""

import random

import numpy as np

from lontar.operators import layout, products
from lontar.operators import quality as M
from lontar.operators import topics as K
from lontar.operators import word_vectors as W
from lontar.operators.layout import fuzzy_edges
from lontar.operators.neighbours import neighbours


def corpus(spark, n=40):
    rng = random.Random(7)
    return spark.createDataFrame([(i, [rng.choice("abcdefgh") * 2 for _ in range(rng.randint(0, 60))]) for i in range(n)], "doc_idx long, tokens array<string>")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_all_sizes_are_counted_in_one_pass(spark):
    docs = corpus(spark)
    topics = spark.createDataFrame([(0, ["aa", "bb", "cc"]), (1, ["dd", "aa"])], "topic_id int, words array<string>")
    counted = {(r.size, r.term1, r.term2): r.n for r in M.topic_windows(topics, docs, sizes=(10, 3)).collect()}
    texts = [r.tokens for r in docs.collect()]
    for size in (10, 3):
        windows = [set(t[i : i + size]) for t in texts if t for i in range(max(1, len(t) - size + 1))]
        assert counted[size, None, None] == len(windows)
        for a, b in [("aa", "aa"), ("aa", "bb"), ("bb", "cc"), ("aa", "dd")]:
            assert counted[size, a, b] == sum({a, b} <= w for w in windows)
    assert ("bb", "dd") not in {k[1:] for k in counted}
    pairs = spark.createDataFrame([("aa", "bb")], "term1 string, term2 string")
    assert "collect_list" not in plan(M.window_counts(docs, "tokens", 5, pairs))  # places of words are not shuffled


def test_texts_meet_their_topic_and_not_each_word(spark):
    docs, given = corpus(spark), spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_idx long, topic_id int")
    shown = plan(K.class_counts(docs, given))
    assert shown.index("Generate explode(tokens") < max(shown.rfind("SortMergeJoin"), shown.rfind("BroadcastHashJoin"))


def test_pairs_are_counted_before_they_are_shuffled(spark, monkeypatch):
    docs = corpus(spark)
    shown = plan(W.near_pairs(docs, window=3, min_count=1))
    assert "Generate" not in shown and shown.count("Exchange hashpartitioning") == 1
    whole = sorted(W.near_pairs(docs, window=3, min_count=1).collect())
    monkeypatch.setattr(W, "WHOLE_BYTES", -1)
    assert sorted(W.near_pairs(docs, window=3, min_count=1).collect()) == whole and whole


def test_a_step_of_a_layout_shuffles_nothing(spark, monkeypatch):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(10 * i, [rng.gauss(6 * (i % 3), 1), rng.gauss(0, 1)]) for i in range(90)] + [(5, [99.0, 99.0])], "node long, v array<double>")
    edges = fuzzy_edges(neighbours(nodes.filter("node <> 5"), 8))
    far = {r.node: r.v for r in _with(monkeypatch, 0, lambda: layout.spectral_layout(nodes, edges, 3).collect())}
    monkeypatch.setattr(layout, "_step", None)  # the joins
    near = {r.node: r.v for r in layout.spectral_layout(nodes, edges, 3).collect()}
    assert near[5] == far[5] == [0.0, 0.0, 0.0]
    apart = lambda at: [[sum((x - y) ** 2 for x, y in zip(at[a], at[b])) for a in sorted(at)] for b in sorted(at)]  # noqa: E731 - signs are open
    assert np.allclose(apart(near), apart(far), rtol=1e-5, atol=1e-6)


def test_products_of_vectors_shuffle_nothing(spark, monkeypatch):
    entries = W.positive_pmi(W.near_pairs(corpus(spark), window=2, min_count=1)).persist()
    _, far = _with(monkeypatch, 0, lambda: W.singular_vectors(entries, 4))
    monkeypatch.setattr(W, "_apply", None)  # the joins
    _, near = W.singular_vectors(entries, 4)
    assert np.allclose(near, far, rtol=1e-6)


def _with(monkeypatch, limit, run):
    with monkeypatch.context() as m:
        m.setattr(products, "WHOLE_BYTES", limit)
        return run()


def test_components_come_from_one_pass_of_products(spark):
    """The projected rows' components, held to numpy's over all rows; no row of COLUMNS numbers leaves a task."""
    docs = corpus(spark, 60)
    hashed, dense = K._projection(docs, "tokens", 42)
    rows = hashed.select("doc_idx", "_h").toArrow().sort_by("doc_idx")
    x = np.concatenate(list(dense(rows.column(1).combine_chunks())))
    onto = np.linalg.svd(np.cov(x.T))[0][:, :3]
    want = x @ onto
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
    made = K.features(docs, size=3)
    got = np.array([r.features.toArray() for r in made.orderBy("doc_idx").collect()])
    assert np.allclose(np.abs((got * want).sum(0)), (want * want).sum(0), atol=1e-6) and "_tfidf" not in plan(made)


def test_columns_go_to_the_tasks_some_at_a_time(spark, monkeypatch):
    """coordinates over 128 MB were joined with the graph in each step."""
    rng = np.random.default_rng(5)
    table, block = rng.normal(size=(12, 12)), rng.normal(size=(12, 5))
    links = spark.createDataFrame([(i, j, float(table[i, j])) for i in range(12) for j in range(12)], "i int, j int, s double")
    sent, real = [], products.times
    monkeypatch.setattr(products, "times", lambda links, block: (sent.append(block.shape[1]), real(links, block))[1])
    monkeypatch.setattr(products, "WHOLE_BYTES", 12 * 8 * 2)
    assert np.allclose(products.times(links, block), table @ block) and sent == [5, 2, 2, 1]
    nodes = spark.createDataFrame([(i, [rng.normal(), rng.normal()]) for i in range(40)], "node long, v array<double>")
    edges = fuzzy_edges(neighbours(nodes, 8)).persist()
    monkeypatch.setattr(products, "WHOLE_BYTES", 40 * 8 * 2)
    monkeypatch.setattr(layout, "_step", None)  # the joins
    few = {r.node: r.v for r in layout.spectral_layout(nodes, edges, 3).collect()}
    monkeypatch.setattr(products, "WHOLE_BYTES", 1 << 27)
    whole = {r.node: r.v for r in layout.spectral_layout(nodes, edges, 3).collect()}
    assert few.keys() == whole.keys() and all(np.allclose(few[n], whole[n], atol=1e-6) for n in whole)
