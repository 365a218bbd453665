import json
import random

import pytest
from pyspark.sql import functions as F

from lontar.operators.limiter import rate_limit
from lontar.sources import readers as R
from lontar.sources import writers as W
from lontar.streaming.limiter import stream_rate_limit
from lontar.streaming.sentiment import stream_distribution, stream_sentiment


#: Seconds: a watermark starts at the epoch, and what isn't after it counts as late.
BASE = 1_000_000.0


def put(tmp_path, name, content):
    path = tmp_path / name
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


def test_corpora(spark, tmp_path):
    for content in (["a", " ", "b", {"text": "c"}, {"text": None}], {"data": [{"text": "a"}, "b", "", {"text": "c"}]}, {"rows": ["a", "b", "c"]}):
        path = put(tmp_path, f"c{len(json.dumps(content))}.json", content)
        assert [(r.doc_idx, r.text) for r in R.read_corpus(spark, path).orderBy("doc_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
        assert R.read_corpus(spark, path, 2).count() == 2


def test_gold_lexicon_and_words(spark, tmp_path):
    gold = put(tmp_path, "gold.json", [{"text": "x", "label": "Positive"}, {"text": " ", "label": "neutral"}, {"text": "y", "label": "odd"}, {"text": "z", "label": "negative"}])
    assert [(r.text, r.label) for r in R.read_gold(spark, gold).orderBy("doc_idx").collect()] == [("x", "positive"), ("z", "negative")]
    assert tuple(R.gold_drops(spark, gold).first()) == (2, 2)
    lexicon = put(tmp_path, "lex.json", {"_note": "n", "aspects": [{"term": "harga", "provenance": "p"}, {"term": "wifi", "literal_only": True}]})
    assert [(r.term, r.literal_only) for r in R.read_lexicon(spark, lexicon).collect()] == [("harga", False), ("wifi", True)]
    assert R.read_stopwords(spark, put(tmp_path, "stop.txt", "Yang\n\ndi \nyang\n")) == {"yang", "di"}
    assert R.read_stopwords(spark, str(tmp_path / "none.txt"), frozenset({"x"})) == {"x"}
    assert R.read_pairs(spark, put(tmp_path, "slang.json", {"bgt": "banget", "yg": ""})) == {"bgt": "banget", "yg": ""}


def test_conll(spark, tmp_path):
    path = put(tmp_path, "a.txt", "ac\tB\nrusak\tO\nbroken\n\n \nwifi\tb\nlemot\tO")
    rows = R.read_conll(spark, path).orderBy("doc_idx", "pos").collect()
    assert [(r.doc_idx, r.pos, r.token, r.label) for r in rows] == [(0, 0, "ac", "B"), (0, 1, "rusak", "O"), (1, 0, "wifi", "B"), (1, 1, "lemot", "O")]


def test_corpus_rules(spark):
    df = spark.createDataFrame([("c", 3, " x "), ("c", 1, None), ("d", 2, "")], "corpus_id string, t long, text string")
    rows = R.number_documents(R.validate_corpus(df), "t").collect()
    assert {(r.corpus_id, r.doc_idx, r.text) for r in rows} == {("c", 0, ""), ("c", 1, "x"), ("d", 0, "")}
    assert [tuple(r) for r in R.corpus_problems(df).select("corpus_id", "problem").collect()] == [("d", "all_blank")]
    with pytest.raises(Exception, match="characters"):
        R.validate_corpus(spark.createDataFrame([("y" * 11,)], "text string"), max_chars=10).collect()
    assert R.validate_corpus(spark.createDataFrame([("y" * 10_001,)], "text string")).count() == 1
    assert [r.problem for r in R.corpus_problems(df, max_texts=1).orderBy("corpus_id").collect()] == ["too_many_texts", "all_blank"]


def test_numbers_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("corpus_id"), (1000 - F.col("id")).alias("t")).repartition(7)
    rows = R.number_documents(df, "t").collect()
    for c in range(3):
        part = sorted((r.t, r.doc_idx) for r in rows if r.corpus_id == c)
        assert [i for _, i in part] == list(range(len(part)))


def test_tasks_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "harga dan wifi"), (1, "kosong")], "doc_idx long, text string")
    spans = spark.createDataFrame([(0, 10, 14), (0, 0, 5)], "doc_idx long, start int, end int")
    out = str(tmp_path / "tasks")
    W.write_json(W.to_tasks(docs, spans).drop("doc_idx"), out)
    back = {r.text: [tuple(s) for s in r.spans] for r in R.read_tasks(spark, out, lines=True).collect()}
    assert back == {"harga dan wifi": [(0, 5), (10, 14)], "kosong": []}
    from lontar.operators.datasets import harvest_terms

    assert {(r.term, r.n) for r in harvest_terms(R.read_tasks(spark, out, lines=True)).collect()} == {("harga", 1), ("wifi", 1)}
    payload = {r.doc_idx: r.aspects for r in W.to_retrain_payload(docs, spans).collect()}
    assert payload == {0: ["harga", "wifi"], 1: []} and W.to_retrain_payload(docs, spans, only_with_aspects=True).count() == 1


def test_results(spark, tmp_path):
    out = str(tmp_path / "results")
    W.write_results(spark.createDataFrame([("a", 1), ("b", 2)], "label string, v int"), out)
    W.write_results(spark.createDataFrame([("a", 9)], "label string, v int"), out)
    assert {(r.label, r.v) for r in spark.read.json(out).collect()} == {("a", 9), ("b", 2)}
    assert W.render_table(spark.createDataFrame([("a", 0.5)], "k string, v double"), ["k", "v"]) == "| k | v |\n| --- | --- |\n| a | 0.5000 |"
    with pytest.raises(ValueError, match="rows"):
        W.render_table(spark.range(5), ["id"], most=4)
    page = W.render_between("intro", "x", "| a |")
    assert W.render_between(page, "x", "| b |") == page.replace("| a |", "| b |") and page.startswith("intro")
    gold = W.to_gold(spark.createDataFrame([(0, "harga dan wifi"), (1, "kosong")], "doc_idx long, text string"), spark.createDataFrame([(0, 10, 14), (0, 0, 5)], "doc_idx long, start int, end int"))
    assert {r.doc_idx: [tuple(s) for s in r.spans] for r in gold.collect()} == {0: [(0, 5, "harga"), (10, 14, "wifi")], 1: []}
    assert W.write_provenance(spark, str(tmp_path / "p"), {"seed": 1}) and json.loads(spark.read.text(str(tmp_path / "p")).first()[0]) == {"seed": 1}


def run(query, name, spark):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(240), "the query over what is available didn't end"
        assert q.exception() is None
        return spark.table(name).collect()
    finally:
        q.stop()


def test_stream_rate_limit(spark, tmp_path):
    folder = str(tmp_path / "events")
    for batch in ([("a", 0.0), ("a", 1.0), ("b", 0.0)], [("a", 2.0), ("a", 11.0)]):
        spark.createDataFrame(batch, "k string, t double").select("k", (F.col("t") + BASE).cast("timestamp").alias("t")).coalesce(1).write.mode("append").parquet(folder)
    events = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    rows = run(stream_rate_limit(events, "k", "t", 2, 10.0, late="1 minute"), "limited", spark)
    assert len(rows) == 5 and sum(r.allowed for r in rows) == 4 and not next(r for r in rows if r["at"] == BASE + 2.0).allowed


def test_one_key_with_many_events_in_a_trigger(spark, tmp_path):
    """More events than an Arrow batch holds, in no order: decisions are those of the batch form."""
    folder = str(tmp_path / "many")
    times = list(range(25_000))
    random.Random(3).shuffle(times)
    spark.createDataFrame([("a", float(t)) for t in times], "k string, t double").select("k", (F.col("t") + BASE).cast("timestamp").alias("t")).coalesce(2).write.parquet(folder)
    events = spark.readStream.schema("k string, t timestamp").parquet(folder)
    got = {r["at"]: r.allowed for r in run(stream_rate_limit(events, "k", "t", 2, 10.0, late="1 day"), "many", spark)}
    batch = rate_limit(spark.read.parquet(folder), "k", F.col("t"), 2, 10.0).collect()
    assert got == {r["at"]: r.allowed for r in batch} and sum(got.values()) == 5000


def test_stream_sentiment(spark, tmp_path):
    folder = str(tmp_path / "texts")
    spark.createDataFrame([("tidak bagus", "2024-01-01 00:00:00"), ("bagus sekali", "2024-01-01 00:01:00"), ("jelek", "2024-01-01 01:00:00")], "text string, at string").select("text", F.to_timestamp("at").alias("at")).write.parquet(folder)
    texts = spark.readStream.schema("text string, at timestamp").parquet(folder)
    rows = run(stream_sentiment(texts).select("text", "sentiment"), "scored", spark)
    assert {r.text: r.sentiment for r in rows} == {"tidak bagus": "negative", "bagus sekali": "positive", "jelek": "negative"}
    made = run(stream_distribution(stream_sentiment(texts), "at"), "shares", spark)
    assert [(r.total, r.positive, r.negative) for r in made] == [(2, 50.0, 50.0)]


def test_texts_meet_their_spans_once(spark):
    """A text of many spans is not repeated for each: no join is of spans with texts."""
    docs = spark.createDataFrame([(0, "harga dan wifi"), (1, "kosong")], "doc_idx long, text string")
    spans = spark.createDataFrame([(0, 10, 14), (0, 0, 5)], "doc_idx long, start int, end int")
    for made in (W.to_tasks(docs, spans), W.to_gold(docs, spans), W.to_retrain_payload(docs, spans)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1 and made.count() == 2
    found = {r.doc_idx: [(v.value.start, v.value.text) for v in r.predictions[0].result] for r in W.to_tasks(docs, spans).collect()}
    assert found == {0: [(0, "harga"), (10, "wifi")], 1: []}
