import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lontar.config import TopicConfig
from lontar.operators import association as Q
from lontar.operators import quality as M
from lontar.operators import topics as K


def assigned(spark, topics):
    return spark.createDataFrame(list(enumerate(topics)), "doc_idx long, topic_id int")


def tokens(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_idx long, tokens array<string>")


def test_pmi(spark):
    topics = assigned(spark, [0, 0, 1, 1, 0, 1])
    aspects = spark.createDataFrame(list(enumerate([["harga", "pelayanan"], ["harga", " harga "], ["pelayanan"], ["harga"], ["harga"], ["pelayanan", " "]])), "doc_idx long, aspects array<string>")
    rows = {(r.aspect, r.topic_id): r for r in Q.pmi(aspects, topics, 2).collect()}
    assert rows["harga", 0].pmi == pytest.approx(math.log2((3 / 6) / ((4 / 6) * (3 / 6))), abs=1e-4) and rows["harga", 0].co_occurrence == 3
    top = Q.analyze(aspects, topics, 3, 2)["top"].orderBy("rank").collect()
    assert [(r.aspect, r.topic_id) for r in top] == [("harga", 0), ("pelayanan", 1)]
    wide = {r.aspect: r for r in Q.heatmap(aspects, topics, 3, 2).collect()}
    assert wide["harga"].topic_2 == 0.0 and wide["harga"].topic_0 == 0.585 and set(wide) == {"harga", "pelayanan"}
    assert Q.pmi(aspects, topics, 5).count() == 0
    with pytest.raises(ValueError, match="one of the frames"):
        Q.analyze(aspects, assigned(spark, [0, 1]), 2)


def test_outliers_are_no_topic(spark):
    aspects = spark.createDataFrame([(0, ["a"]), (1, ["a"]), (2, ["a"])], "doc_idx long, aspects array<string>")
    assert {r.topic_id for r in Q.pmi(aspects, assigned(spark, [-1, 0, 0]), 1).collect()} == {0}


def test_windows(spark):
    made = M.windows(tokens(spark, [["a", "b", "c", "d"], [], ["x"]]), "tokens", 2)
    assert sorted((r.doc_idx, r.window, r.terms) for r in made.collect()) == [(0, 0, ["a", "b"]), (0, 1, ["b", "c"]), (0, 2, ["c", "d"]), (2, 0, ["x"])]
    assert M.count_windows(tokens(spark, [["a", "b", "c", "d"], [], ["x"]]), "tokens", 2).first().n == 4
    assert M.count_windows(tokens(spark, [["a", "b", "c", "d"], []]), "tokens", 0).first().n == 1


def test_coherence(spark):
    topic = spark.createDataFrame([(0, ["a", "b"])], "topic_id int, words array<string>")
    together = tokens(spark, [["a", "b"]] * 20)
    assert M.npmi_coherence(topic, together, size=0).first().c_npmi == pytest.approx(1.0)
    apart = tokens(spark, [["a", "x"]] * 10 + [["b", "y"]] * 10)
    assert M.npmi_coherence(topic, apart, size=0).first().c_npmi < -0.9
    assert M.cv_coherence(topic, together).first().c_v == pytest.approx(1.0)
    assert M.cv_coherence(topic, apart).first().c_v < M.cv_coherence(topic, together).first().c_v
    single = spark.createDataFrame([(0, ["a"])], "topic_id int, words array<string>")
    assert M.npmi_coherence(single, together).first().c_npmi == 0.0 and M.cv_coherence(single, together).first().c_v == 0.0


def test_coherence_agrees_with_a_loop(spark):
    docs = [["a", "b", "c", "a", "d"], ["b", "d"], ["c", "c", "a"], ["d", "e", "a", "b", "c", "e"]]
    words, size = ["a", "b", "d", "zz"], 3
    wins = [set(d[i : i + size]) for d in docs for i in range(max(1, len(d) - size + 1))]
    p = lambda *ws: sum(all(w in x for w in ws) for x in wins) / len(wins)

    def npmi(x, y):
        if x == y:
            return 1.0
        if not p(x) or not p(y):
            return 0.0
        j = p(x, y)
        return 1.0 if j >= 1 - 1e-12 else math.log((j + 1e-12) / (p(x) * p(y))) / -math.log(j + 1e-12)

    topic = spark.createDataFrame([(0, words)], "topic_id int, words array<string>")
    pairs = [npmi(x, y) for x, y in combinations(words, 2)]
    assert M.npmi_coherence(topic, tokens(spark, docs), size=size).first().c_npmi == pytest.approx(sum(pairs) / len(pairs))
    rows = [[npmi(x, y) for y in words] for x in words]
    total = [sum(c) for c in zip(*rows, strict=True)]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cos = [sum(x * y for x, y in zip(r, total, strict=True)) / (norm(r) * norm(total)) for r in rows]
    assert M.cv_coherence(topic, tokens(spark, docs), size=size).first().c_v == pytest.approx(sum(cos) / len(cos))


def test_diversity_and_outliers(spark):
    t = lambda ws: spark.createDataFrame(list(enumerate(ws)), "topic_id int, words array<string>")
    assert M.diversity(t([["a", "b"], ["c", "d"]])).first().diversity == 1.0
    assert M.diversity(t([["a", "b"], ["a", "b"]])).first().diversity == 0.5
    assert M.diversity(t([])).first().diversity == 0.0
    assert M.outlier_rate(assigned(spark, [0, 1, -1, -1])).first().outlier_rate == 0.5


def test_frequency_topics(spark):
    words = [f"kata{i:02d}" for i in range(15)]
    docs = tokens(spark, [words[:5] * 3, words[5:10] * 2, words[10:], ["zzzlangka"], []])
    topics, doc_topics = K.frequency_topics(docs)
    assert {r.doc_idx: r.topic_id for r in doc_topics.collect()} == {0: 0, 1: 1, 2: 2, 3: -1, 4: -1}
    rows = topics.orderBy("topic_id").collect()
    assert rows[0].words == words[:5] and [r["size"] for r in rows] == [1, 1, 1] and rows[0].proportion == 0.2
    none = K.frequency_topics(tokens(spark, [[], []]))
    assert none[0].count() == 0 and {r.topic_id for r in none[1].collect()} == {-1}


def test_degenerate_and_k(spark):
    row = K.degenerate(assigned(spark, [0] * 6 + [1] * 2 + [2] * 2)).first()
    assert (row.clusters, row.largest_share, row.degenerate) == (3, 0.6, True)
    assert K.degenerate(assigned(spark, [0, 0, 1, 1, 2, 2, -1])).first().degenerate is False
    assert K.degenerate(assigned(spark, [0, 0, 1, 1])).first().degenerate is True
    assert K.select_k(3, None) == 3
    assert K.select_k(7, lambda k: {7: (0.2, 0.3), 6: (0.8, 0.9), 5: (0.4, 0.5), 4: (0.3, 0.6)}[k]) == 4
    assert K.select_k(5, lambda k: {5: (0.3, 0.6), 4: (0.3, 0.6)}[k]) == 5 and K.select_k(5, lambda k: {5: (0.3, 0.6), 4: (0.95, 0.9)}[k]) == 5
    assert K.select_k(6, lambda k: (0.9, 1.0)) == 6
    assert [K.auto_k(n) for n in (2, 50, 10_000)] == [2, 5, 20] and K.lda_k(10, 5, 100) == 4 and K.kmeans_k(0, 200) == 10


def test_labels(spark):
    topics = spark.createDataFrame([(0, ["a", "b", " ", "c"]), (1, ["x", "y"])], "topic_id int, words array<string>")
    vocabulary = spark.createDataFrame([("b", 9), ("c", 9)], "term string, n long")
    assert {r.topic_id: r.words for r in K.filter_label_words(topics, vocabulary).collect()} == {0: ["b", "c"], 1: ["x", "y"]}
    assert {r.topic_id: r.words for r in K.filter_label_words(topics, None, 2).collect()} == {0: ["a", "b"], 1: ["x", "y"]}
    d = spark.createDataFrame([(0, "para pejabat korupsi"), (1, "pejabat itu kaya"), (2, "pejabat lagi menjabat")], "doc_idx long, text string")
    stems = spark.createDataFrame([("pejabat", "jabat"), ("menjabat", "jabat"), ("kaya", "kaya")], "token string, stem string")
    found = K.surface_map(d, spark.createDataFrame([("jabat",)], "word string"), stems)
    assert [(r.stem, r.surface) for r in found.collect()] == [("jabat", "pejabat")]
    shown = K.readable(spark.createDataFrame([(0, ["jabat", "uang"])], "topic_id int, words array<string>"), found).first()
    assert shown.words == ["pejabat", "uang"] and shown.words_stemmed == ["jabat", "uang"]
    assert K.label_vocabulary(d, min_freq=5) is None and K.label_vocabulary(d, min_freq=1) is None


def test_word_frequencies(spark):
    docs = tokens(spark, [["Uang", "uang", "ab", "tidak"], ["pajak", "uang", "pajak"]])
    assert [(r.word, r.frequency) for r in K.word_frequencies(docs).orderBy("rank").collect()] == [("uang", 3), ("pajak", 2)]


def test_class_tfidf_and_outliers(spark):
    docs = tokens(spark, [["uang", "pajak", "uang"], ["laut", "ikan"], ["uang", "pajak"], ["laut"], ["qqq"]])
    given = assigned(spark, [0, 1, -1, -1, -1])
    weights = {(r.topic_id, r.term): r.weight for r in K.class_tfidf(docs, given.filter("topic_id >= 0")).collect()}
    assert weights[0, "uang"] == pytest.approx(math.sqrt(2 / 3) * math.log(1 + 2.5 / 2))
    assert {r.doc_idx: r.topic_id for r in K.pull_outliers(docs, given).collect()} == {0: 0, 1: 1, 2: 0, 3: 1, 4: -1}
    assert {r.topic_id: r.words[0] for r in K.top_terms(K.class_tfidf(docs, given.filter("topic_id >= 0"))).collect()} == {0: "pajak", 1: "ikan"}


def test_renumbering(spark):
    topics = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (2, ["c"])], "topic_id int, words array<string>")
    new, moved = K.renumber(topics, assigned(spark, [2, 2, 1, -1]))
    assert [(r.topic_id, r.words, r["size"]) for r in new.orderBy("topic_id").collect()] == [(0, ["c"], 2), (1, ["b"], 1), (2, ["a"], 0)]
    assert {r.doc_idx: r.topic_id for r in moved.collect()} == {0: 0, 1: 0, 2: 1, 3: -1}


def test_mmr(spark):
    rows = [(0, "a", 1.0, [1.0, 0.0]), (0, "a2", 0.99, [1.0, 0.0]), (0, "b", 0.8, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "topic_id int, term string, relevance double, vector array<double>")
    assert K.mmr(df, 2, 0.3).first().words == ["a", "b"]


def test_analyze(spark):
    themes = ["pajak anggaran uang negara", "laut ikan nelayan kapal", "guru sekolah murid buku"]
    texts = [themes[i % 3] + f" {themes[i % 3].split()[i % 4]}" for i in range(60)] + ["", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")
    for method in ("kmeans", "lda"):
        found = K.analyze(d, num_topics=3, config=TopicConfig(), method=method, iterations=3)
        doc_topics = {r.doc_idx: r.topic_id for r in found["document_topics"].collect()}
        assert len(doc_topics) == 62 and doc_topics[60] == doc_topics[61] == -1
        assert sum(r["size"] for r in found["topics"].collect()) == sum(t >= 0 for t in doc_topics.values())
        assert "topik" in found["summary"].first().summary
    assert {len({doc_topics[i] for i in range(k, 60, 3)}) for k in range(3)} <= {1, 2}
    few = K.analyze(spark.createDataFrame([(0, "pajak uang"), (1, "")], "doc_idx long, text string"))
    assert few["topics"].first().method == "frequency-based" and few["document_topics"].filter("doc_idx = 1").first().topic_id == -1


def test_registered_lda_runs_all_iterations(spark, tables, monkeypatch):
    from lontar.plans import topic_queries

    seen = []
    monkeypatch.setattr(topic_queries.K, "LDA", lambda **kw: seen.append(kw["maxIter"]) or (_ for _ in ()).throw(RuntimeError("seen")))
    with pytest.raises(RuntimeError, match="seen"):
        topic_queries.lda_topics(spark, tables)
    assert seen == [20]


def test_words_beyond_the_most_frequent_count_for_clusters(spark):
    # 2,100 words of three documents each come before those of two, which the last documents are made of
    rows = [(i, [f"a{(i * 35 + k) % 2100}" for k in range(105)]) for i in range(60)] + [(60 + i, [f"rare{i // 2}x{k}" for k in range(4)]) for i in range(10)]
    found = K.features(spark.createDataFrame(rows, "doc_idx long, tokens array<string>"), size=70).collect()
    assert all(r.features.norm(2) > 0.5 for r in found if r.doc_idx >= 60)


def six_topics(spark):
    """Topics 0-2 share words pairwise with 3-5, so merging to three makes pairs."""
    docs, topics = [], []
    for i in range(60):
        t = i % 6
        docs.append([f"tema{t % 3}a", f"tema{t % 3}b", f"tema{t % 3}c", f"khas{t}"])
        topics.append(t)
    return tokens(spark, docs), assigned(spark, topics)


def test_merging_and_choosing(spark):
    docs, given = six_topics(spark)
    order = K.merge_order(K.class_counts(docs, given))
    assert sorted(order) == [1, 2, 3, 4, 5, 6] and order[6] == {t: t for t in range(6)} and order[3] == {0: 0, 3: 0, 1: 1, 4: 1, 2: 2, 5: 2}
    moved = {r.doc_idx: r.topic_id for r in K.merged(given.union(assigned(spark, [-1]).withColumn("doc_idx", F.lit(99).cast("long"))), order[3]).collect()}
    assert moved[3] == 0 and moved[4] == 1 and moved[99] == -1
    rows = {r.k: r for r in K.sweep_k(docs, given, [3, 4, 5, 6]).collect()}
    assert sorted(rows) == [3, 4, 5, 6] and rows[3].largest_share == pytest.approx(1 / 3, abs=1e-4) and rows[3].outlier_rate == 0 and rows[3].diversity == 1.0
    for k in (3,):  # as if the clustering had been k all along
        alone = K.top_terms(K.class_tfidf(docs, K.merged(given, order[k])))
        assert rows[k].c_v == pytest.approx(M.cv_coherence(alone, docs).first().c_v, abs=1e-4) and rows[k].c_npmi == pytest.approx(M.npmi_coherence(alone, docs).first().c_npmi, abs=1e-4)
    assert {r.topic_id for r in K.choose_topics(docs, given, 3).collect()} == {0, 1, 2} and K.choose_topics(docs, given, 9) is given
    auto = {r.topic_id for r in K.choose_topics(docs, given, 0).collect()}
    assert len(auto) == max((4, 5, 6), key=lambda k: (rows[k].c_v, k))


def test_outliers_are_the_farthest(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense([float(i % 2) * 10 + (i % 5) / 100, 0.0])) for i in range(100)] + [(100, Vectors.dense([14.0, 3.0]))]
    got = {r.doc_idx: r.topic_id for r in K.cluster(spark.createDataFrame(rows, ["doc_idx", "features"]), 2, outlier_share=0.02).collect()}
    assert got[100] == -1 and sum(t == -1 for t in got.values()) <= 3 and len(got) == 101


def test_labels_are_readable(spark):
    themes = ["pelayanan pejabat membayar pajak", "nelayan ikan laut kapal", "guru sekolah murid buku"]
    d = spark.createDataFrame([(i, f"{themes[i % 3]} {themes[i % 3].split()[i % 4]}") for i in range(60)], "doc_idx long, text string")
    found = K.analyze(d, num_topics=0)
    for r in found["topics"].collect():
        assert len(r.words) == len(r.words_stemmed)
    pairs = {s: w for r in found["topics"].collect() for s, w in zip(r.words_stemmed, r.words, strict=True)}
    assert pairs.get("jabat", "pejabat") == "pejabat" and pairs.get("bayar", "membayar") == "membayar" and ("jabat" in pairs or "bayar" in pairs)
    assert {"pejabat", "membayar"} & {r.word for r in found["word_frequencies"].collect()}


def test_pair_counts_are_those_of_windows(spark):
    docs = tokens(spark, [["a", "b", "x", "a", "y", "b", "b"], ["x"] * 30 + ["a"] + ["x"] * 5 + ["b"], ["a"], []])
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("a", "zz")], "term1 string, term2 string")
    vocabulary = spark.createDataFrame([("a",), ("b",)], "term string")
    for size in (1, 2, 3, 10, 0):
        want = {(r.term1, r.term2): r.n for r in M.cooccurrence(M.windows(docs, "tokens", size, vocabulary)).collect()}
        assert {(r.term1, r.term2): r.n for r in M.window_counts(docs, "tokens", size, pairs).collect()} == want


def test_lda_reads_counts_from_as_many_parts_as_cores(spark, monkeypatch):
    """Each part sends sums as long as the vocabulary in each iteration, and texts are not counted anew."""
    seen, real = [], K.LDA.fit
    monkeypatch.setattr(K.LDA, "fit", lambda self, df, *a: (seen.append((df.rdd.getNumPartitions(), df.inputFiles())), real(self, df, *a))[1])
    docs = spark.createDataFrame([(i, ["satu", "dua"] if i % 2 else ["tiga", "empat"]) for i in range(60)], "doc_idx long, tokens array<string>").repartition(12)
    topics, assigned = K.lda_topics(docs, num_topics=2, iterations=2)
    assert topics.count() == 2 and assigned.count() == 60
    assert seen[0][0] <= spark.sparkContext.defaultParallelism < 12 and seen[0][1]


def test_lda_is_that_of_a_loop_over_texts(spark):
    """the vocabulary and several tables as long as it were at the driver as objects; sums now meet by word in tasks."""
    from lontar.operators import lda

    rng = np.random.default_rng(3)
    texts = [[f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 6, 20)] for i in range(58)] + [[], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, tokens array<string>")
    names = sorted({w for t in texts for w in t or []})
    x = np.array([[(t or []).count(w) for w in names] for t in texts], float)
    given = rng.gamma(100, 0.01, (len(names), 2))
    corpus = lda.numbered(docs, "tokens", "doc_idx", pa.array(names))
    weights, alpha = lda.LDA(k=2, maxIter=6).fit(corpus, given.copy(), 60)
    w, a, eta = given.copy(), np.full(2, 0.5), 0.5
    psi = lambda v: np.array([[float(lda.digamma(np.array(c))) for c in r] for r in np.atleast_2d(v)])
    for step in range(1, 7):
        beta, stats, logs = np.exp(psi(w) - psi(w.sum(0))), np.zeros_like(w), np.zeros(2)
        for row in x[:58]:
            gamma = np.ones(2)
            for _ in range(lda.STEPS):
                theta = np.exp(psi(gamma)[0] - psi([[gamma.sum()]])[0])
                share = row / (beta @ theta)
                gamma, before = theta * (beta.T @ share) + a, gamma
                if np.abs(gamma - before).mean() < lda.SETTLED:
                    break
            logs += psi(gamma)[0] - psi([[gamma.sum()]])[0]
            share = row / (beta @ np.exp(psi(gamma)[0] - psi([[gamma.sum()]])[0]))
            stats += np.outer(share, np.exp(psi(gamma)[0] - psi([[gamma.sum()]])[0]))
        rate = (lda.OFFSET + step) ** -lda.POWER
        w = (1 - rate) * w + rate * (stats * beta * 60 / 58 + eta)
        slope = 58 * (psi([[a.sum()]])[0] - psi(a)[0] + logs / 58)
        c, q = 58 * lda.trigamma(a.sum()), -58 * lda.trigamma(a)
        a = a + rate * -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    assert np.allclose(weights, w, rtol=1e-4) and np.allclose(alpha, a, rtol=1e-4)
    topics, assigned = K.lda_topics(docs, num_topics=2)
    found = {r.doc_idx: r.topic_id for r in assigned.collect()}
    assert len(found) == 60 and len({found[i] for i in range(0, 58, 2)}) == 1 and {found[i] for i in range(58)} == {0, 1}
    assert {r.words[0][0] for r in topics.collect()} == {"a", "b"}


def test_digamma_and_trigamma():
    from lontar.operators import lda

    x = np.array([0.01, 0.5, 1.0, 7.3, 1e5])
    assert np.allclose(lda.digamma(x + 1) - lda.digamma(x), 1 / x, rtol=1e-9) and np.allclose(lda.trigamma(x) - lda.trigamma(x + 1), 1 / x**2, rtol=1e-9)
    assert np.isclose(lda.digamma(np.array(1.0)), -0.5772156649015329) and np.isclose(lda.trigamma(np.array(1.0)), np.pi**2 / 6)


def test_first_places_need_no_sort_of_all_words(spark):
    """the first place of each word was a struct, so that all words of the corpus were sorted, twice."""
    rows = [(7, ["bbb", "aaa", "ccc"]), (-3, ["ddd", "ccc", "ddd"]), (2**62, ["eee", "aaa"]), (None, ["eee"]), (5, None)]
    docs = spark.createDataFrame(rows, "doc_idx long, tokens array<string>")
    made = K.word_frequencies(docs, stopwords=frozenset())
    assert "SortAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r.word for r in made.orderBy("rank").collect()] == ["eee", "ddd", "ccc", "aaa", "bbb"]
    named = docs.withColumn("doc_idx", F.col("doc_idx").cast("string"))
    assert {r.word for r in K.word_frequencies(named, stopwords=frozenset()).collect()} == {"aaa", "bbb", "ccc", "ddd", "eee"}
