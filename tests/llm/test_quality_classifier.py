import numpy as np

from lontar.llm.quality_classifier import fit_ordinal, grade, op9_quality_classifier
from tests.llm.cases import awkward, frame, table


def test_awkward(spark):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, None), (2, 0, 0), (9, 1, 1), (None, 1, 0), (11, None, 1)], "doc_id long, quality int, toxic int")
    found = grade(frame(spark, awkward()), labels).collect()
    assert len(found) == len(awkward())
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.p_good <= 1 and r.selected == (r.p_good > 0.5) for r in found)


def test_empty_and_unrated(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert grade(frame(spark, []), labels).collect() == []
    assert {(r.p_good, r.selected) for r in grade(frame(spark, awkward()), labels).collect()} == {(None, False)}


def test_thresholds_are_ordered_and_grades_follow_the_score():
    rng = np.random.default_rng(1)
    ids = [np.array([k], np.int32) for k in rng.integers(0, 3, 300)]
    grades = np.array([int(i[0]) for i in ids])
    model = fit_ordinal(ids, [np.ones(1, np.float32)] * 300, grades)
    assert model["cuts"][0] < model["cuts"][1]
    assert model["w"][0] < model["cuts"][0] < model["w"][1] < model["cuts"][1] < model["w"][2]


def test_separates_rated_documents(spark, tables):
    rated = {r["doc_id"]: r for r in table(tables, "labels")}
    found = [r for r in op9_quality_classifier(spark, tables).collect() if r.doc_id in rated]
    low = [r.expected_grade for r in found if not rated[r.doc_id]["quality"]]
    good = [r.expected_grade for r in found if rated[r.doc_id]["quality"] and not rated[r.doc_id]["toxic"]]
    assert np.mean(good) > np.mean(low) + 0.5


def test_grades_are_those_of_a_loop(spark):
    """Expected grade and tail probability of the fitted links, word by word; of several ratings the lowest counts."""
    import math

    from lontar.llm.quality_classifier import Features, fit, grade

    texts = [("sangat baik sekali " * (i % 4 + 1) if i % 3 else "BURUK!!! x x x " * (i % 5 + 1)) + f"nomor{i}" for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, "teks lain"), (None, "tanpa nomor"), (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 9 == 1)) for i in range(80)] + [(2, 0, 0), (None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    model, known = fit(docs, labels), Features()
    low, high = model["cuts"]
    assert low < high
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    want = []
    for i, t in list(enumerate(texts)) + [(7, "teks lain"), (None, "tanpa nomor"), (500, None)]:
        ids, values = known.row(t)
        total = sum(float(v) * float(model["w"][k]) for k, v in zip(ids, values, strict=True))
        want.append((i, round(sigmoid(total - low) + sigmoid(total - high), 4), round(sigmoid(total - high), 4)))
    got = [(r.doc_id, round(r.expected_grade, 4), round(r.p_good, 4)) for r in grade(docs, labels).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 2e-3 and abs(a[2] - b[2]) < 2e-3
