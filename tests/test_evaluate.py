import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lontar.operators import evaluate as E
from lontar.operators.limiter import Window, rate_limit


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "true int, pred int")


def test_split(spark):
    df = spark.createDataFrame([(i, "a" if i < 78 else "b" if i < 93 else "c" if i < 99 else "d") for i in range(100)], "id long, label string")
    split = E.stratified_split(df, "label", "id")
    n = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert n == {("a", "train"): 62, ("a", "val"): 16, ("b", "train"): 12, ("b", "val"): 3, ("c", "train"): 5, ("c", "val"): 1, ("d", "train"): 1}
    again = E.stratified_split(df.repartition(7), "label", "id")
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in again.collect()}
    assert E.retrain_preview(df, "label", "id").first().warnings == ["imbalanced", "small_class"]


def test_distribution_and_weights(spark):
    df = spark.createDataFrame([(i, "negative" if i < 78 else "positive" if i < 93 else "neutral") for i in range(100)], "id long, label string")
    rows = {r.label: r for r in E.label_distribution(df, "label", "id").collect()}
    assert rows["negative"].majority and not rows["positive"].majority and rows["neutral"].imbalance_ratio == 11.14 and rows["positive"].pct == 15.0
    w = {r.label: r.weight for r in E.class_weights(df, "label", ["positive", "neutral", "negative", "other"]).collect()}
    assert w["neutral"] > w["positive"] > w["negative"] and w["other"] == 1.0 and w["neutral"] == pytest.approx(100 / (3 * 7))


def test_classification(spark):
    df = frame(spark, [(0, 0), (0, 1), (1, 1), (1, 1)])
    assert [(r.true, r.pred_0, r.pred_1) for r in E.confusion_matrix(df, "true", "pred", [0, 1]).orderBy("true").collect()] == [(0, 1, 1), (1, 0, 2)]
    skewed = E.classification_report(E.confusion(frame(spark, [(2, 2)] * 8 + [(0, 2), (1, 2)]), "true", "pred")).first()
    assert skewed.accuracy == 0.8 and skewed.macro_f1 < 0.5
    rows = {r.label: r for r in E.class_metrics(E.confusion(df, "true", "pred")).collect()}
    assert (rows[0].precision, rows[0].recall, rows[1].precision, rows[1].support) == (1.0, 0.5, 0.6667, 2)


def test_token_and_span_scores(spark):
    df = spark.createDataFrame([([-100, 1, 2, 0, 0], [1, 2, 0, 0, 1])], "t array<int>, p array<int>")
    r = E.token_f1(df, "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    s = lambda rows: spark.createDataFrame(rows, "doc_idx long, start int, end int")
    r = E.span_prf(s([(0, 0, 3), (0, 5, 8), (1, 0, 2)]), s([(0, 0, 3), (0, 0, 3), (1, 0, 3)])).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 2, 0.5, 0.3333)


def test_calibration(spark):
    df = spark.createDataFrame([(0.0, False), (0.1, False), (0.3, True), (0.7, True), (1.0, True)], "c double, ok boolean")
    bins = [(0.05, 0.0, 2), (0.3, 1.0, 1), (0.7, 1.0, 1), (1.0, 1.0, 1)]
    assert E.calibration_error(df, "c", "ok").first().ece == pytest.approx(sum(abs(a - c) * n for c, a, n in bins) / 5, abs=1e-4)
    buckets = {r.bucket: r for r in E.confidence_buckets(df, "c", "ok").collect()}
    assert set(buckets) == {"[0.00, 0.50)", "[0.70, 0.90)", "[0.99, 1.01)"} and buckets["[0.00, 0.50)"].n == 3
    y = {r.threshold: r for r in E.review_yield(df, "c", "ok").collect()}
    assert (y[0.5].reviewed, y[0.5].caught, y[0.5].recall, y[0.5].lift) == (3, 2, 1.0, 1.67)
    gate = spark.createDataFrame([(0.8, 0.8), (0.8, 0.79996), (0.8, 0.79)], "b double, a double")
    assert [r[0] for r in gate.select(E.accept_checkpoint(F.col("b"), F.col("a"))).collect()] == [True, True, False]
    assert all(r[0] for r in gate.select(E.accept_checkpoint(F.col("b"), F.col("a"), force=True)).collect())


def test_temperature(spark):
    rows = [([4.0, 0.0], 0 if i % 4 else 1) for i in range(80)]
    df = spark.createDataFrame(rows, "z array<double>, y int")
    want = 4 / math.log(3)  # three in four right: sigmoid(4 / T) is 0.75
    assert E.fit_temperature(df, "z", "y") == pytest.approx(want, rel=0.02)
    assert E.fit_temperature(df.limit(20), "z", "y") == 1.0 and E.fit_temperature(df.filter("y = 0"), "z", "y") == 1.0


def test_fingerprint_and_errors(spark):
    df = spark.createDataFrame([("b",), ("a",)], "t string")
    assert E.pool_fingerprint(df, "t").first().fingerprint == hashlib.sha256(b"a\0b\0").hexdigest()[:16] == "8fb20ef63ced4145"
    wrong = spark.createDataFrame([(0, "x" * 500, 0.9, False), (1, "y", 0.95, False), (2, "z", 0.99, True)], "id long, t string, c double, ok boolean")
    rows = E.errors(wrong, "ok", "c", "t", "id", 5).collect()
    assert [(r.id, len(r.t)) for r in rows] == [(1, 1), (0, 400)]


def test_runs_and_agreement(spark):
    runs = spark.createDataFrame([(5, 5, 3, 0.4, 0.1), (5, 4, 3, 0.4, 0.1), (5, 5, 1, 0.4, 0.1), (5, 5, 3, 0.6, 0.1), (5, 5, 3, 0.4, 0.3)], "n_in int, n_out int, topics int, largest_share double, outlier_rate double")
    assert [r.verdict for r in E.robustness_verdict(runs).collect()] == ["ok", "misaligned", "too_few_topics", "dominated", "too_many_outliers"]
    v = E.seed_variance(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "k double"), ["k"]).first()
    assert (v.k_mean, v.k_stdev, v.runs) == (2.3333, 1.5275, 3)
    p = spark.createDataFrame([(i, m, (i if m == "a" else 0)) for i in range(4) for m in ("a", "b")], "doc_idx long, model string, label int")
    assert E.model_agreement(p).first().agreement == 0.25


def test_training_gate(spark):
    rows = [(i, ["bagus", "sekali", f"w{i % 3}"] if i % 3 else ["jelek", f"w{i % 3}"], int(bool(i % 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, label int")
    _, report = E.train_classifier(df, "tokens", "label", "id", features=1 << 10)
    assert report["accepted"] and report["after"]["macro_f1"] == 1.0 and report["before"]["macro_f1"] < 0.5
    assert report["weighted_f1_delta"] > 0 and report["temperature"] == 1.0 and report["train"] + report["val"] == 60
    with pytest.raises(ValueError, match="validation"):
        E.train_classifier(df.limit(0), "tokens", "label", "id")


def test_rows_that_cannot_be_trained_on(spark):
    df = spark.createDataFrame([("a", 0), (" ", 1), (None, 7), ("b", 7), ("c", None)], "t string, y int")
    good, skipped = E.training_rows(df, "t", "y", [0, 1])
    assert [r.t for r in good.collect()] == ["a"]
    assert {(r.reason, r.label): r.n for r in skipped.collect()} == {("empty_text", 1): 1, ("empty_text", 7): 1, ("unknown_label", 7): 1, ("unknown_label", None): 1}
    assert E.inherited_temperature(1.0, 2.5, 10) == (2.5, True) and E.inherited_temperature(1.0, 2.5, 90) == (1.0, False) and E.inherited_temperature(1.7, 2.5, 10) == (1.7, False)


def test_tagger(spark):
    """The word after 'soal' is an aspect."""
    rows = []
    for i in range(60):
        words = ["kita", "bicara", "soal", f"hal{i % 5}", "hari", "ini"] if i % 6 else ["tidak", "ada", "apa"]
        rows += [(i, k, w, int(k > 0 and words[k - 1] == "soal") if k else -100) for k, w in enumerate(words)]
    tags = spark.createDataFrame(rows, "doc_idx long, pos int, token string, label int")
    _, report = E.train_tagger(tags, weighted=True)
    assert report["accepted"] and report["after"]["f1"] == 1.0 and report["before"]["f1"] == 0.0 and report["split"] == "stratified"
    assert (report["train"], report["val"]) == (48, 12)
    _, official = E.train_tagger(tags.filter("doc_idx < 40"), official=tags.filter("doc_idx >= 40"))
    assert official["split"] == "official" and (official["train"], official["val"]) == (40, 20)


def test_pool_digest_is_of_the_set_and_its_counts(spark):
    rows = [(f"text {i}",) for i in range(50)] + [(None,), ("",)]
    digest = lambda r, parts=3: tuple(E.pool_digest(spark.createDataFrame(r, "t string").repartition(parts), "t").first())
    assert digest(rows) == digest(rows[::-1], 5) and digest(rows)[1] == 52
    assert len({digest(rows)[0], digest(rows[1:])[0], digest(rows + rows[:1])[0], digest([])[0]}) == 4
    with pytest.raises(ValueError, match="pool_digest"):
        E.pool_fingerprint(spark.createDataFrame([("x" * 20,)], "t string"), "t", most_chars=10)


def test_rate_limit(spark):
    w = Window(2, 10)
    assert [w.allow(t) for t in (0, 1, 2, 11)] == [True, True, False, True]
    events = spark.createDataFrame([("a", t) for t in (0.0, 1.0, 2.0, 11.0)] + [("b", 0.0)] * 4 + [(None, 5.0), ("c", None)], "k string, t double")
    rows = [(r.k, r["at"], r.allowed) for r in rate_limit(events, "k", F.col("t"), 2, 10.0).collect()]
    assert sorted(r[1:] for r in rows if r[0] == "a") == [(0.0, True), (1.0, True), (2.0, False), (11.0, True)]
    assert sorted(r[2] for r in rows if r[0] == "b") == [False, False, True, True] and (None, 5.0, True) in rows and len(rows) == 9
    assert all(r.allowed for r in rate_limit(events, "k", F.col("t"), 0).collect())


def test_pool_digests_deals_texts_by_document(spark, tables, monkeypatch):
    """Both tables of the query are dealt evenly: four languages would be four tasks at most, however large the table."""
    from lontar.plans import source_queries as Q

    seen = []
    monkeypatch.setattr(E, "pool_digest", lambda df, text, made=E.pool_digest: (seen.append(df), made(df, text))[1])
    assert tuple(Q.pool_digests(spark, tables).first()) == (2, True)
    plan = seen[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_idx" in plan and "RepartitionByExpression [lang" not in plan
