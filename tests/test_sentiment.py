import pytest
from pyspark.sql import functions as F

from lontar.config import CleanConfig, SentimentConfig
from lontar.operators import sentiment as S


def scored(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")
    return sorted(S.score_lexicon(df, "text").collect(), key=lambda r: r.doc_idx)


def brute(text):
    from lontar.lexicons import LEXICON_NEGATIONS, NEGATIVE, POSITIVE

    pos = neg = 0
    until = -1
    for i, w in enumerate(text.lower().split()):
        t = w.strip('.,!?;:"()[]')
        if t in LEXICON_NEGATIONS:
            until = i + 2
        elif t in POSITIVE | NEGATIVE:
            if (t in POSITIVE) != (i <= until):
                pos += 1
            else:
                neg += 1
    return pos, neg


def test_negation_scope(spark):
    texts = ["pelayanannya tidak bagus", "pelayanannya tidak mengecewakan", "tidak ada masalah apa pun dan pelayanannya sangat memuaskan", "tidak jelek tapi bagus", "biasa saja", "", None, " \n ", "bagus, bagus! (bagus) bagus bagus jelek"]
    rows = scored(spark, texts)
    assert [r.sentiment for r in rows] == ["negative", "positive", "positive", "positive", "neutral", "neutral", "neutral", "neutral", "positive"]
    assert rows[3].confidence == 0.8 and rows[4].confidence == 0.5 and rows[4].scores.neutral == 1.0
    assert rows[8].confidence == 0.95 and rows[8].scores.asDict() == {"positive": 0.8333, "neutral": 0.0, "negative": 0.1667}
    assert [r.method for r in rows[5:8]] == ["empty"] * 3 and rows[5].confidence == 0.0


def test_counts_agree_with_a_loop(spark):
    words = ["tidak", "bagus", "jelek!", "kurang", "dan", "(mahal)", "aman."]
    texts = [" ".join(words[(i * k + j * j) % 7] for j in range(i % 12)) for i in range(40) for k in (1, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string").select("doc_idx", S.polarity_counts(F.col("text")).alias("c"))
    assert {r.doc_idx: (r.c.pos, r.c.neg) for r in df.collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_reports(spark):
    rows = [(0, "positive", 0.9, "rule-based"), (1, "neutral", 0.0, "empty"), (2, "negative", 0.7, "rule-based"), (3, "neutral", 0.0, "error"), (4, "positive", 0.7, "rule-based")]
    df = spark.createDataFrame(rows, "doc_idx long, sentiment string, confidence double, method string")
    d = S.distribution(df).first()
    assert (d.positive, d.neutral, d.negative, d.total) == (50.0, 25.0, 25.0, 4)
    m = S.metrics(df).first()
    assert (m.avg_confidence, m.min_confidence, m.total_analyzed, m.total_texts, m.empty, m.failed) == (0.575, 0.0, 4, 5, 1, 1)
    assert [r.doc_idx for r in S.review_queue(df).orderBy("review_rank").collect()] == [3, 2, 4, 0]
    assert [r.doc_idx for r in S.review_queue(df, SentimentConfig(review_limit=2)).orderBy("review_rank").collect()] == [3, 2]
    assert S.review_share(df, SentimentConfig(review_threshold=0.8)).first().share == 0.75
    assert S.summary(S.distribution(df)).first().summary == "Dari 4 teks yang dianalisis, 50.0% menunjukkan sentimen positif. Distribusi lengkap: 50.0% positif, 25.0% netral, 25.0% negatif."
    empty = S.distribution(df.filter("false")).first()
    assert (empty.positive, empty.total) == (0.0, 0)


def test_model_boundary(spark):
    def scorer(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[2.0, 0.0, 1.0] if "good" in t else [0.0, 0.0, 3.0] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["good", "bad one", "meh", "", None] + ["good"] * 20)], "doc_idx long, text string")
    rows = {r.doc_idx: r for r in S.finish_model_rows(S.score_with(df, scorer, "text", batch=4), "text", config=SentimentConfig(temperature=1.0)).collect()}
    assert len(rows) == 25 and rows[0].sentiment == "positive" and rows[2].sentiment == "negative"
    assert (rows[1].method, rows[1].sentiment, rows[1].confidence) == ("error", "neutral", 0.0) and rows[3].method == rows[4].method == "empty"
    assert rows[0].confidence == pytest.approx(0.6652, abs=1e-4) and sum(r.method == "model" for r in rows.values()) == 22


def test_label_maps_and_calibration(tmp_path):
    assert S.resolve_label_map({0: "Negatif", 1: "Netral", 2: "Positif"}) == {0: "negative", 1: "neutral", 2: "positive"}
    assert S.resolve_label_map({0: "LABEL_0"}) == {0: "positive", 1: "neutral", 2: "negative"}
    S.save_calibration(str(tmp_path / "t.json"), 1.5)
    assert S.load_calibration(str(tmp_path / "t.json")) == 1.5 and S.load_calibration(str(tmp_path / "none.json"), 2.0) == 2.0
    S.save_calibration(str(tmp_path / "t.json"), 50)
    assert S.load_calibration(str(tmp_path / "t.json")) == 1.0
    with pytest.raises(ValueError, match="temperature"):
        SentimentConfig(temperature=0.01)


def test_analyze_cleans_only_if_asked(spark):
    df = spark.createDataFrame([(0, "BAGUS #sekali"), (1, "@siapa"), (2, "tidak bagus")], "doc_idx long, text string")
    raw, made = S.analyze(df), S.analyze(df, CleanConfig())
    assert {r.doc_idx: r.method for r in raw["predictions"].collect()}[1] == "rule-based"
    rows = {r.doc_idx: r for r in made["predictions"].collect()}
    assert rows[1].method == "empty" and rows[0].processed_text == "bagus sekali" and rows[2].sentiment == "negative"
    assert made["metrics"].first().empty == 1
