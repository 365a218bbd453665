from itertools import product

import numpy as np

from lontar.operators import crf
from lontar.operators import evaluate as E

WIDTH = 2


def chain(seed=0, features=12):
    rng = np.random.default_rng(seed)
    return crf.Chain.empty(features).moved(rng.normal(size=features * 3 + 12))


def score(model, feats, path):
    emit = sum(model.emit[i, y] for f, y in zip(feats.reshape(-1, WIDTH), path, strict=True) for i in f)
    return emit + model.start[path[0]] + sum(model.change[a, b] for a, b in zip(path, path[1:], strict=False))


def sentence(rng, n):
    return rng.integers(0, 12, n * WIDTH)


def test_sums_over_all_paths():
    """Path sums, marginals, expected changes and best paths as over all 3**n paths, in one batch of unlike lengths."""
    rng, model = np.random.default_rng(1), chain()
    feats = [sentence(rng, n) for n in (1, 4, 2, 6, 3)]
    for part, held, lengths in crf._groups(feats, WIDTH):
        emit = crf._emissions(model, held)
        total, each, pairs = crf.marginals(emit, lengths, model)
        best = crf.best_path(emit, lengths, model)
        for row, i in enumerate(part):
            n = lengths[row]
            paths = list(product(range(3), repeat=int(n)))
            weights = np.array([score(model, feats[i], p) for p in paths])
            whole = np.log(np.exp(weights).sum())
            share = np.exp(weights - whole)
            assert np.isclose(total[row], whole)
            assert np.allclose(each[row, :n], [[sum(s for s, p in zip(share, paths, strict=True) if p[k] == y) for y in range(3)] for k in range(n)])
            assert np.allclose(pairs[row], [[sum(s * sum(p[k : k + 2] == (a, b) for k in range(n - 1)) for s, p in zip(share, paths, strict=True)) for b in range(3)] for a in range(3)])
            assert tuple(best[row, :n]) == paths[int(weights.argmax())]


def test_slope_as_by_differences():
    rng, model = np.random.default_rng(2), chain(3)
    rows = [(sentence(rng, n), rng.integers(0, 3, n), w) for n, w in ((5, 1.0), (1, 0.5), (3, 2.0))]
    slope, _, tokens = crf.gradient(model, rows, WIDTH)
    assert tokens == 5 + 0.5 + 6
    for k in range(len(slope)):
        step = np.zeros(len(slope))
        step[k] = 1e-5
        up, down = (crf.gradient(model.moved(s * step), rows, WIDTH)[1] for s in (1, -1))
        assert np.isclose(slope[k], (up - down) / 2e-5, atol=1e-4)


def test_whole_gradient_is_the_sum(spark):
    rng, model = np.random.default_rng(4), chain(5, 3000)
    rows = [(i, float(1 + i % 3), rng.integers(0, 3, n := int(rng.integers(1, 9))).tolist(), rng.integers(0, 3000, n * WIDTH).tolist()) for i in range(80)]
    frame = spark.createDataFrame(rows, "k long, weight double, labels array<int>, feats array<int>").repartition(6)
    slope, loss, tokens = crf.whole_gradient(frame, model, WIDTH)
    wanted = crf.gradient(model, [(np.array(f), np.array(y), w) for _, w, y, f in rows], WIDTH)
    assert np.allclose(slope, wanted[0]) and np.isclose(loss, wanted[1]) and tokens == wanted[2]


def test_rates_and_labels():
    rates = [crf.rate(k, 20, 1.0, 0.2) for k in range(20)]
    assert rates[:4] == [0.25, 0.5, 0.75, 1.0] and rates[4] == 1.0 and rates[-1] == 1 / 16 and rates[4:] == sorted(rates[4:], reverse=True)
    assert crf.lawful(np.array([2, 2, 0, 2, 1, 2, 2, 0])).tolist() == [1, 2, 0, 1, 1, 2, 2, 0]


def test_chain_beats_single_tokens(spark):
    """An aspect runs from `soal` up to `lalu`, over words that occur outside too: the labels inside hang on one another."""
    rng, rows = np.random.default_rng(6), []
    for i in range(120):
        words = [f"k{x}" for x in rng.integers(0, 6, 14)]
        at = int(rng.integers(1, 5))
        end = at + int(rng.integers(4, 8))
        if i % 4:
            words[at - 1], words[end] = "soal", "lalu"
        rows += [(i, k, w, (1 if k == at else 2 if at < k < end else 0) if i % 4 else 0) for k, w in enumerate(words)]
    tags = spark.createDataFrame(rows, "doc_idx long, pos int, token string, label int")
    model, one = E.train_tagger(tags, epochs=8)
    _, single = E.train_tagger(tags, sequence=False)
    assert one["after"]["f1"] > single["after"]["f1"] + 0.1 and one["after"]["f1"] > 0.9 and one["accepted"]
    assert len(one["history"]) == 8 and one["history"][-1]["loss"] < one["history"][0]["loss"]
    held, width = crf.taggable(tags, "doc_idx")
    for r in crf.decode(held, model, width).collect():
        assert len(r.predicted) == 14 and (crf.lawful(np.array(r.predicted)) == r.predicted).all() and all(0 <= c <= 1.0001 for c in r.conf)


def test_document_rows_train_as_token_rows(spark):
    """A row a document: the same labels as bio_tags gives tokens, the same features as their neighbours give, the same report."""
    from lontar.operators import spans as P

    texts = [(i, f"kita bicara soal hal{i % 5} baru Hari-ini" if i % 6 else "tidak ada apa") for i in range(60)] + [(60, None), (61, " . ")]
    docs = spark.createDataFrame(texts, "doc_idx long, text string")
    found = P.resolve_overlaps(P.literal_spans(docs, [f"hal{k} baru" for k in range(5)]))
    words = P.word_spans(docs)
    tags = P.bio_tags(words.selectExpr("doc_idx", "pos", "start", "end", "false AS special"), found).join(words.select("doc_idx", "pos", "word"), ["doc_idx", "pos"]).withColumnRenamed("word", "token")
    held = P.tagged_words(docs, found)
    rows = {r.doc_idx: (r.tokens, r.labels) for r in held.collect()}
    wanted = {r.doc_idx: (r.tokens, r.labels) for r in crf.tagged_texts(tags, "doc_idx").collect()}
    assert rows == wanted and len(rows) == 60 and rows[1][1] == [0, 0, 0, 1, 2, 0, 0]
    (_, one), (_, other) = E.train_tagger(held, epochs=2), E.train_tagger(tags, epochs=2)
    assert {k: one[k] for k in ("after", "train", "val")} == {k: other[k] for k in ("after", "train", "val")}
    assert "Window" not in (plan := held._jdf.queryExecution().executedPlan().toString()) and "pos#" not in plan


def test_features_of_words_stand_once(spark):
    row = crf.sentences(spark.createDataFrame([(0, ["Aa", "b1", "aa", "Aa"], [0, -100, 1, 2])], "k long, tokens array<string>, labels array<int>"), "k", 1 << 16).first()
    feats, labels = crf.spread(np.array(row.ids), np.array(row.kinds), np.array(row.labels))
    named = [("w=aa", "p=", "q=", "n=b1", "e=aa", "b=aa", "s=Xx", "bias"), ("w=aa", "p=b1", "q=aa", "n=aa", "e=aa", "b=aa", "s=xx", "bias"), ("w=aa", "p=aa", "q=b1", "n=", "e=aa", "b=aa", "s=Xx", "bias")]
    wanted = spark.createDataFrame([(i, j, f) for i, r in enumerate(named) for j, f in enumerate(r)], "i int, j int, f string").selectExpr("i", "j", "pmod(xxhash64(f), 65536) AS x").orderBy("i", "j").collect()
    assert feats.tolist() == [r.x for r in wanted] and labels.tolist() == [0, 1, 2] and len(row.kinds) == 1 + 4 * crf.KIND


def test_validation_rows_without_a_join(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(101)], "k long, y int")
    wanted = {r.k for r in E.stratified_split(rows, "y", "k").filter("split = 'val'").collect()}
    assert {r.k for r in rows.filter(E.in_validation(rows, "y", "k")).collect()} == wanted and len(wanted) == 20


def test_sums_without_logarithms_and_sentences_read_at_once():
    """each place took logarithms of sums over all labels, and each sentence was read and weighed by itself."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    model = crf.Chain.empty(40).moved(rng.normal(size=40 * 3 + 12))
    lengths = np.array([3, 1, 700, 2])  # in no order
    emit = rng.normal(scale=30, size=(4, 700, 3))
    total, each, pairs = crf.marginals(emit, lengths, model)
    for i, n in enumerate(lengths):
        alone = crf.marginals(emit[i : i + 1, :n], lengths[i : i + 1], model)
        assert np.isclose(total[i], alone[0][0]) and np.allclose(each[i, :n], alone[1][0]) and np.allclose(pairs[i], alone[2][0])
        assert np.allclose(each[i, :n].sum(1), 1) and not each[i, n:].any() and np.isclose(pairs[i].sum(), n - 1)
    ids, kinds = [[1, 2, 1], [], [1], [2, 1]], [rng.integers(0, 40, 1 + 3 * crf.KIND).tolist() for _ in range(4)]
    labels = [[0, -100, 1], [], [-100], [2, 0]]
    feats, kept = crf._read([pa.array(x, pa.list_(pa.int32())) for x in (labels, ids, kinds)])
    for i in range(4):
        f, y = crf.spread(np.array(ids[i], np.int32), np.array(kinds[i]), np.array(labels[i], np.int32))
        assert feats[i].tolist() == f.tolist() and kept[i].tolist() == y.tolist()
        words = np.array(kinds[i][1:]).reshape(-1, crf.KIND)
        around = [0, 0, *ids[i], 0]
        assert feats[i].reshape(-1, crf.KIND + 1).tolist() == [[words[w, 0], words[around[k + 1], 1], words[around[k], 2], words[around[k + 3], 3], words[w, 4], words[w, 5], words[w, 6], kinds[i][0]] for k, w in enumerate(ids[i]) if labels[i][k] != -100]
