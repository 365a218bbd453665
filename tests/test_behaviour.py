from collections import Counter

from pyspark.sql import functions as F

from lontar.config import CleanConfig
from lontar.lexicons import LEXICON_NEGATIONS, NEGATIVE, POSITIVE
from lontar.operators import behaviour as B
from lontar.operators import sentiment as S
from lontar.operators.spans import literal_spans
from lontar.plans.evaluation_queries import _SUITE


def label(text):
    """The lexicon rule as a loop, for texts of plain words."""
    pos = neg = 0
    words = text.lower().replace("!", "").split()
    for i, w in enumerate(words):
        flip = any(x in LEXICON_NEGATIONS for x in words[max(0, i - 2) : i])
        pos += (w in POSITIVE) != flip if w in POSITIVE | NEGATIVE else 0
        neg += (w in NEGATIVE) != flip if w in POSITIVE | NEGATIVE else 0
    return "positive" if pos > neg else "negative" if neg > pos else "neutral"


def test_cases(spark):
    rows = B.behaviour_cases(spark).collect()
    assert Counter(r.kind for r in rows) == {"MFT": 117, "INV": 120, "DIR": 12} and len({(r.kind, r.test, r.text) for r in rows}) == 249
    assert {r.text for r in rows if r.test == "drawn out"} >= {"pelayanannya bagussss", "produknya burukkkk"}
    assert "tmptnya" not in {r.text for r in rows} and sum(r.text.isupper() for r in rows) == 24
    base = {r.i: r.text for r in B.base_texts(spark).collect()}
    assert base[0] == "pelayanannya bagus" and base[11] == "makanannya ramah" and base[12] == "pelayanannya buruk" and len(base) == 24


def test_suite_counts_are_those_of_a_loop(spark):
    plain = {}
    for r in B.behaviour_cases(spark).filter("kind = 'MFT'").collect():
        got = label(r.text)
        n, ok = plain.get(r.test, (0, 0))
        plain[r.test] = n + 1, ok + (got != "negative" if r.expected == "not-negative" else got == r.expected)
    assert plain == {t: (n, p) for k, t, n, p in _SUITE if k == "MFT"}
    found = B.report(B.judged(B.behaviour_cases(spark), lambda texts: S.analyze(texts, CleanConfig())["predictions"])).collect()
    assert {(r.kind, r.test, r.n, r.passed) for r in found} == set(_SUITE)


def test_probe(spark):
    cases = B.probe_cases(spark, ["soal {} itu", "{} naik"], {"seen": ["harga"], "nonce": ["blorf"]})
    rows = {r["group"]: (r.n, r.hits, r.hit_rate) for r in B.probe_report(cases, literal_spans(cases, ["harga", "itu"])).collect()}
    assert rows == {"seen": (2, 2, 100.0), "nonce": (2, 0, 0.0)}
    assert [B.probe_verdict(dict(zip(("seen", "unseen", "nonce"), r, strict=True))) for r in ((40, 40, 40), (90, 80, 60), (90, 80, 40), (90, 60, 0), (90, 10, 0))] == ["rarely", "pattern", "mixed", "partly", "memory"]


def test_texts_are_not_shuffled_to_meet_their_scores(spark):
    cases = spark.createDataFrame([("INV", "t", f"x{i}", f"y{i % 3}", None) for i in range(9)], "kind string, test string, text string, base string, expected string")

    def score(texts):
        return texts.select("doc_idx", F.when(F.col("text").startswith("x"), "negative").otherwise("positive").alias("sentiment"), F.struct(F.lit(0.5).alias("positive")).alias("scores"))

    for distinct in (True, False):
        made = B.report(B.judged(cases, score, distinct))
        assert [tuple(r) for r in made.collect()] == [("INV", "t", 9, 0, 0.0)]
        assert "hashpartitioning(text" not in (plan := made._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(base" not in plan
