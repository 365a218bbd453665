"""Evaluation, calibration, behaviour and limiter queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.operators import evaluate as E
from lontar.operators import limiter
from lontar.plans.common import ASPECTS, DOCS, LATIN, docs, in_list, read
from lontar.plans.registry import query
from lontar.plans.sentiment_queries import predictions_sql


def _labels(spark, sf_dir) -> DataFrame:
    """quality as the truth, a rule on toxic and the id as the prediction, and a confidence."""
    pred = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", pred.alias("pred"), (F.col("doc_id") * 37 % 101 / 100.0).alias("confidence"), (pred == F.col("quality")).alias("correct"))


_LAB = "lab AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS pred, (doc_id * 37 % 101) / 100.0::DOUBLE AS confidence, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END = quality AS correct FROM labels)"


@query(f"WITH {_LAB}, n AS (SELECT quality, count(*) AS n FROM lab GROUP BY quality), v AS (SELECT quality, n, CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), n - 1) END AS v FROM n) SELECT quality, 'val' AS split, v AS n FROM v WHERE v > 0 UNION ALL SELECT quality, 'train', n - v FROM v")
def stratified_split_sizes(spark, sf_dir):
    """Sizes; membership goes by hash."""
    return E.stratified_split(_labels(spark, sf_dir), "quality", "doc_id").groupBy("quality", "split").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT lang AS label, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY lang) SELECT label, n, round(n * 100 / sum(n) OVER (), 2) AS pct, row_number() OVER (ORDER BY n DESC, f) = 1 AS majority, round(max(n) OVER () / min(n) OVER (), 2) AS imbalance_ratio FROM c")
def label_distribution(spark, sf_dir):
    """E2."""
    return E.label_distribution(read(spark, sf_dir, "documents"), "lang", "doc_id")


@query("WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang), d AS (SELECT unnest(['en', 'fr', 'de', 'es', 'id']) AS label) SELECT d.label, coalesce((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * c.n), 1.0) AS weight FROM d LEFT JOIN c USING (label)")
def class_weights(spark, sf_dir):
    """An absent class weighs 1."""
    return E.class_weights(read(spark, sf_dir, "documents"), "lang", ["en", "fr", "de", "es", "id"])


@query(f"WITH {_LAB} SELECT quality AS true, pred, count(*) AS n FROM lab GROUP BY quality, pred")
def confusion(spark, sf_dir):
    """Cells."""
    return E.confusion(_labels(spark, sf_dir), "quality", "pred")


@query(f"WITH {_LAB} SELECT quality AS true, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1, CAST(0 AS BIGINT) AS pred_2 FROM lab GROUP BY quality")
def confusion_matrix(spark, sf_dir):
    """The matrix."""
    return E.confusion_matrix(_labels(spark, sf_dir), "quality", "pred", [0, 1, 2])


_METRICS = f"""{_LAB}, k AS (SELECT unnest([0, 1]) AS label), s AS (SELECT k.label, count(*) FILTER (quality = label) AS support, count(*) FILTER (pred = label) AS predicted, count(*) FILTER (pred = label AND quality = label) AS hit FROM k, lab GROUP BY k.label),
m AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)"""


@query(f"WITH {_METRICS} SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM f")
def class_metrics(spark, sf_dir):
    """By class."""
    return E.class_metrics(E.confusion(_labels(spark, sf_dir), "quality", "pred")).drop("_f1", "hit")


@query(f"WITH {_METRICS} SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(avg(f), 4) AS macro_f1, round(sum(f * support) / sum(support), 4) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM f")
def classification_report(spark, sf_dir):
    """The summary."""
    return E.classification_report(E.confusion(_labels(spark, sf_dir), "quality", "pred"))


@query("""WITH t AS (SELECT doc_id, unnest(generate_series(0, 19)) AS i FROM documents), l AS (SELECT CASE WHEN i IN (0, 19) THEN -100 ELSE (doc_id + i) % 3 END AS t, (doc_id * 2 + i * i) % 3 AS p FROM t),
c AS (SELECT count(*) FILTER (t IN (1, 2) AND p IN (1, 2)) AS tp, count(*) FILTER (t = 0 AND p IN (1, 2)) AS fp, count(*) FILTER (t IN (1, 2) AND p = 0) AS fn FROM l)
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""")
def token_f1(spark, sf_dir):
    """E5: B for I is a hit; -100 doesn't count."""
    places = F.sequence(F.lit(0), F.lit(19))
    rows = read(spark, sf_dir, "documents").select(
        F.transform(places, lambda i: F.when(i.isin(0, 19), -100).otherwise(((F.col("doc_id") + i) % 3).cast("int"))).alias("t"), F.transform(places, lambda i: ((F.col("doc_id") * 2 + i * i) % 3).cast("int")).alias("p")
    )
    return E.token_f1(rows, "t", "p")


@query("SELECT doc_id, round(((doc_id * 13) % 100) / 100.0::DOUBLE - ((doc_id * 7) % 100) / 100.0::DOUBLE, 4) >= -0.05 AS accepted FROM labels")
def checkpoint_gate(spark, sf_dir):
    """E6."""
    return read(spark, sf_dir, "labels").select("doc_id", E.accept_checkpoint(F.col("doc_id") * 7 % 100 / 100.0, F.col("doc_id") * 13 % 100 / 100.0, 0.05).alias("accepted"))


@query(f"WITH {_LAB}, b AS (SELECT greatest(0, least(9, ceil(confidence * 10) - 1)) AS b, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM lab GROUP BY 1) SELECT round(sum(abs(a - c) * n) / sum(n), 4) AS ece, CAST(sum(n) AS BIGINT) AS n FROM b")
def calibration_error(spark, sf_dir):
    """E7."""
    return E.calibration_error(_labels(spark, sf_dir), "confidence", "correct")


@query(f"""WITH {_LAB}, b AS (SELECT CASE WHEN confidence < 0.5 THEN '[0.00, 0.50)' WHEN confidence < 0.7 THEN '[0.50, 0.70)' WHEN confidence < 0.9 THEN '[0.70, 0.90)' WHEN confidence < 0.99 THEN '[0.90, 0.99)' ELSE '[0.99, 1.01)' END AS bucket, correct FROM lab)
SELECT bucket, count(*) AS n, round(avg(correct::INT), 4) AS accuracy, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM b GROUP BY bucket""")
def confidence_buckets(spark, sf_dir):
    """E15."""
    return E.confidence_buckets(_labels(spark, sf_dir), "confidence", "correct")


@query(f"""WITH {_LAB}, t AS (SELECT unnest([{', '.join(map(str, E.REVIEW_THRESHOLDS))}])::DOUBLE AS threshold), n AS (SELECT count(*) AS total, count(*) FILTER (NOT correct) AS errors FROM lab),
y AS (SELECT threshold, count(*) FILTER (confidence < threshold) AS reviewed, count(*) FILTER (confidence < threshold AND NOT correct) AS caught FROM t, lab GROUP BY threshold)
SELECT threshold, reviewed, caught, round(reviewed / total, 4) AS share, round(caught / errors, 4) AS recall, CASE WHEN reviewed > 0 THEN round((caught / errors) / (reviewed / total), 2) ELSE 0 END AS lift FROM y, n""")
def review_yield(spark, sf_dir):
    """One pass for all thresholds."""
    return E.review_yield(_labels(spark, sf_dir), "confidence", "correct")


@query(f"WITH {_LAB} SELECT doc_id, confidence, substr(text, 1, 400) AS text FROM lab JOIN documents USING (doc_id) WHERE NOT correct ORDER BY confidence DESC, doc_id LIMIT 50")
def error_dump(spark, sf_dir):
    """The surest mistakes."""
    joined = _labels(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return E.errors(joined, "correct", "confidence", "text", "doc_id").select("doc_id", "confidence", "text")


def _grid(k: int, low: str, high: str) -> str:
    """CTEs of a round of the search: the grid's step of least loss between low and high."""
    return f"""g{k} AS (SELECT s, {low} + ({high} - {low}) * s / 20.0::DOUBLE AS lt FROM range(21) AS r(s), b{k - 1}),
n{k} AS (SELECT s, lt, sum(greatest(x, y, z) / exp(lt) + ln(exp((x - greatest(x, y, z)) / exp(lt)) + exp((y - greatest(x, y, z)) / exp(lt)) + exp((z - greatest(x, y, z)) / exp(lt))) - CASE label WHEN 0 THEN x WHEN 1 THEN y ELSE z END / exp(lt)) AS loss FROM rows_, g{k} GROUP BY s, lt),
b{k} AS (SELECT arg_min(lt, (loss, s)) AS best, any_value(w) / 10.0::DOUBLE AS w FROM n{k}, (SELECT w FROM b{k - 1}))"""


@query(f"""WITH l AS (SELECT vec_id, embedding[1]::DOUBLE * 4 AS x, embedding[2]::DOUBLE * 4 AS y, embedding[3]::DOUBLE * 4 AS z FROM embeddings), t AS (SELECT *, CASE greatest(x, y, z) WHEN x THEN 0 WHEN y THEN 1 ELSE 2 END AS top FROM l),
rows_ AS (SELECT x, y, z, CASE WHEN vec_id % 3 = 0 THEN (top + 1) % 3 ELSE top END AS label FROM t), b0 AS (SELECT 0.0::DOUBLE AS best, ln(10.0::DOUBLE) - ln(0.25::DOUBLE) AS w),
{_grid(1, "ln(0.25::DOUBLE)", "ln(10.0::DOUBLE)")}, {_grid(2, "(best - w / 2)", "(best + w / 2)")}, {_grid(3, "(best - w / 2)", "(best + w / 2)")} SELECT round(exp(best), 6) AS temperature FROM b3""")
def temperature_fit(spark, sf_dir):
    """The one-dimensional search; a third of the labels is wrong."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 4).alias("logits"))
    top = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    rows = e.withColumn("label", F.when(F.col("vec_id") % 3 == 0, (top + 1) % 3).otherwise(top))
    return spark.createDataFrame([(round(E.fit_temperature(rows, "logits", "label"), 6),)], "temperature double")


@query("SELECT substr(sha256(string_agg(text || chr(0), '' ORDER BY encode(text))), 1, 16) AS fingerprint, count(*) AS n FROM benchmark")
def pool_fingerprint(spark, sf_dir):
    """E9."""
    return E.pool_fingerprint(read(spark, sf_dir, "benchmark"), "text")


@query(f"WITH {_LAB}, n AS (SELECT quality, count(*) AS n FROM lab GROUP BY quality), v AS (SELECT n, least(greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)), n - 1) AS v FROM n), r AS (SELECT CAST(sum(n - v) AS BIGINT) AS train, CAST(sum(v) AS BIGINT) AS val, round(max(n) / min(n), 2) AS imbalance_ratio, min(n) AS smallest FROM v) SELECT train, val, imbalance_ratio, smallest, array_to_string(list_filter([CASE WHEN imbalance_ratio >= 10 THEN 'imbalanced' END, CASE WHEN smallest < 10 THEN 'small_class' END, CASE WHEN val < 5 THEN 'small_validation' END], lambda x: x IS NOT NULL), ',') AS warnings FROM r")
def retrain_preview(spark, sf_dir):
    """E14."""
    return E.retrain_preview(_labels(spark, sf_dir), "quality", "doc_id").withColumn("warnings", F.array_join("warnings", ","))


@query()
def retrain_sentiment(spark, sf_dir):
    """Rows that can't be trained on go, split, weights, a linear model, metrics before and after, the gate, temperature."""
    from lontar.functions.text import tokens

    given = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").withColumn("quality", F.col("quality").cast("int"))
    good, _ = E.training_rows(given, "text", "quality", [0, 1])
    _, report = E.train_classifier(good.select("doc_id", "quality", tokens(F.lower("text")).alias("tokens")), "tokens", "quality", "doc_id")
    row = report["before"]["weighted_f1"], report["after"]["weighted_f1"], report["weighted_f1_delta"], report["accepted"], report["temperature"], report["train"], report["val"]
    return spark.createDataFrame([row], "before double, after double, delta double, accepted boolean, temperature double, train long, val long")


@query(f"WITH r AS (SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN lang IS NULL OR lang NOT IN ('en', 'fr') THEN 'unknown_label' END AS reason, lang AS label FROM documents) SELECT reason, label, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason, label")
def skipped_training_rows(spark, sf_dir):
    """What can't be trained on, and why."""
    return E.training_rows(read(spark, sf_dir, "documents").select("text", "lang"), "text", "lang", ["en", "fr"])[1]


@query()
def retrain_tagger(spark, sf_dir):
    """BIO labels of aspect spans, a split by whether a document has one, a linear tagger, the gate on token F1."""
    from lontar.operators import spans as P
    from lontar.plans.common import ASPECTS

    d = docs(spark, sf_dir)
    _, report = E.train_tagger(P.tagged_words(d, P.resolve_overlaps(P.literal_spans(d, ASPECTS))))
    row = report["before"]["f1"], report["after"]["f1"], report["f1_delta"], report["accepted"], report["train"], report["val"]
    return spark.createDataFrame([row], "before double, after double, delta double, accepted boolean, train long, val long")


_RUNS = "runs AS (SELECT source, lang, count(*) AS n_in, count(*) FILTER (n_chars > 0) AS n_out, count(DISTINCT n_chars % 4) AS topics, max(CASE WHEN n_chars % 4 = 0 THEN 0.6 ELSE 0.3 END)::DOUBLE AS largest_share, avg(CASE WHEN n_chars % 5 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS outlier_rate FROM documents GROUP BY source, lang)"


def _runs(spark, sf_dir) -> DataFrame:
    n = F.col("n_chars")
    return read(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n_in"), F.count_if(n > 0).alias("n_out"), F.count_distinct(n % 4).alias("topics"), F.max(F.when(n % 4 == 0, 0.6).otherwise(0.3)).alias("largest_share"), F.avg(F.when(n % 5 == 0, 1.0).otherwise(0.0)).alias("outlier_rate")
    )


@query(f"WITH {_RUNS} SELECT source, lang, CASE WHEN n_in <> n_out THEN 'misaligned' WHEN topics < 2 THEN 'too_few_topics' WHEN largest_share > 0.5 THEN 'dominated' WHEN outlier_rate > 0.25 THEN 'too_many_outliers' ELSE 'ok' END AS verdict FROM runs")
def robustness_verdict(spark, sf_dir):
    """E34."""
    return E.robustness_verdict(_runs(spark, sf_dir)).select("source", "lang", "verdict")


@query(f"WITH {_RUNS} SELECT lang, round(avg(topics), 4) AS topics_mean, round(stddev_samp(topics), 4) AS topics_stdev, round(avg(outlier_rate), 4) AS outlier_rate_mean, round(stddev_samp(outlier_rate), 4) AS outlier_rate_stdev, count(*) AS runs FROM runs GROUP BY lang")
def seed_variance(spark, sf_dir):
    """Mean and sample deviation over runs."""
    return E.seed_variance(_runs(spark, sf_dir), ["topics", "outlier_rate"], ("lang",))


_MODELS = "p AS (SELECT doc_id, 'a' AS model, n_chars % 3 AS label FROM documents UNION ALL SELECT doc_id, 'b', n_chars % 5 % 3 FROM documents UNION ALL SELECT doc_id, 'c', doc_id % 3 FROM documents)"


@query(f"WITH {_MODELS} SELECT x.model AS model1, y.model AS model2, round(avg((x.label = y.label)::INT), 4) AS agreement, count(*) AS n FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.model < y.model GROUP BY 1, 2")
def model_agreement(spark, sf_dir):
    """Without a self-join, as a document has one row a model."""
    d = read(spark, sf_dir, "documents")
    part = lambda m, c: d.select(F.col("doc_id").alias("doc_idx"), F.lit(m).alias("model"), c.alias("label"))
    return E.model_agreement(part("a", F.col("n_chars") % 3).unionByName(part("b", F.col("n_chars") % 5 % 3)).unionByName(part("c", F.col("doc_id") % 3)))


#: Cases of the suite and how many the lexicon scorer passes, worked out by hand from the word lists (tests/test_behaviour.py).
_SUITE = [
    ("MFT", "plain praise", 20, 20), ("MFT", "plain blame", 20, 20), ("MFT", "negated praise", 24, 24), ("MFT", "negated blame", 24, 24),
    ("MFT", "contrast to blame", 12, 0), ("MFT", "contrast to praise", 12, 0), ("MFT", "plain facts", 5, 5),
    ("INV", "respelling", 24, 24), ("INV", "drawn out", 24, 24), ("INV", "emoji", 24, 24), ("INV", "capitals", 24, 24), ("INV", "exclamation", 24, 24), ("DIR", "added blame", 12, 12),
]


_BLAME = " on with die des que"


def _scored(text: str) -> str:
    return f"(WITH base AS (SELECT doc_id AS doc_idx, lang, {text} AS text FROM documents WHERE text IS NOT NULL), {predictions_sql('base')} SELECT doc_idx, sentiment, s_pos FROM pred)"


def _held(kind: str, test: str, text: str, passed: str) -> str:
    return f"SELECT '{kind}' AS kind, '{test}' AS test, count(*) AS n, count(*) FILTER ({passed}) AS passed, round(avg(CASE WHEN {passed} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS pass_rate FROM {_scored('text')} b JOIN {_scored(text)} c USING (doc_idx)"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{t}', {n}::BIGINT, {p}::BIGINT, round({p} / {n}, 4))" for k, t, n, p in _SUITE) + ") AS v(kind, test, n, passed, pass_rate)"
       + f" UNION ALL {_held('INV', 'documents in capitals', 'upper(text)', 'b.sentiment = c.sentiment')} UNION ALL {_held('DIR', 'documents with blame', f"text || '{_BLAME}'", 'round(c.s_pos - b.s_pos, 6) <= 0.05')}")
def behaviour_suite(spark, sf_dir):
    """All cases through cleaning and the lexicon scorer, and every document perturbed and scored again."""
    from lontar.config import CleanConfig
    from lontar.operators import behaviour as B
    from lontar.operators import sentiment as S
    from lontar.plans.common import TABLE_LEXICON

    suite = B.report(B.judged(B.behaviour_cases(spark), lambda texts: S.analyze(texts, CleanConfig())["predictions"]))
    d, none = docs(spark, sf_dir).filter("text is not null"), F.lit(None).cast("string")
    case = lambda kind, test, text: d.select(F.lit(kind).alias("kind"), F.lit(test).alias("test"), text.alias("text"), F.col("text").alias("base"), none.alias("expected"))
    cases = case("INV", "documents in capitals", F.upper("text")).unionByName(case("DIR", "documents with blame", F.concat("text", F.lit(_BLAME))))
    return suite.unionByName(B.report(B.judged(cases, lambda texts: S.score_lexicon(texts, "text", TABLE_LEXICON), distinct=False)))


@query(f"""WITH {DOCS}, {LATIN}, t AS (SELECT DISTINCT word, CASE WHEN word IN ({in_list(ASPECTS)}) THEN 'seen' WHEN len(word) > 7 THEN 'nonce' ELSE 'unseen' END AS grp FROM lat),
c AS (SELECT grp, word FROM t, (VALUES ('We saw that '), ('No ')) AS s(h))
SELECT grp AS "group", count(*) AS n, count(*) FILTER (word IN ({in_list(ASPECTS)})) AS hits, round(count(*) FILTER (word IN ({in_list(ASPECTS)})) * 100 / count(*), 1) AS hit_rate FROM c GROUP BY grp""")
def pattern_probe(spark, sf_dir):
    """E30, with literal search for a tagger and the documents' words for slots: it finds the words it knows and no others."""
    from lontar.operators import behaviour as B
    from lontar.operators.spans import literal_spans
    from lontar.operators.topics import label_tokens

    found = docs(spark, sf_dir).select(F.explode(label_tokens(F.col("text"), frozenset())).alias("word")).distinct()
    words = found.select(F.when(F.col("word").isin(*ASPECTS), "seen").when(F.char_length("word") > 7, "nonce").otherwise("unseen").alias("group"), "word")
    cases = B.probe_cases(spark, ["We saw that {} is late", "No {} was there"], words)
    return B.probe_report(cases, literal_spans(cases, ASPECTS))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT user_id, i, [s] AS held, true AS allowed FROM e WHERE i = 1
UNION ALL SELECT q.user_id, q.i, CASE WHEN len(q.h) < 3 THEN list_append(q.h, q.s) ELSE q.h END, len(q.h) < 3 FROM (SELECT e.user_id, e.i, e.s, list_filter(r.held, lambda x: x > e.s - 86400) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) q)
SELECT user_id, count(*) AS requests, count(*) FILTER (allowed) AS allowed FROM r GROUP BY user_id""")
def rate_limiter(spark, sf_dir):
    """Three a day for each user; refused requests use up nothing."""
    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("s"))
    made = limiter.rate_limit(events, "user_id", F.col("s"), 3, 86400.0)
    return made.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("allowed")).alias("allowed"))


@query("SELECT source AS corpus_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS doc_idx, CASE WHEN length(trim(coalesce(text, ''))) > 10000 THEN 'too_long' ELSE '' END AS problem FROM documents")
def document_numbers(spark, sf_dir):
    """Ingest: blank and overlong texts stay, doc_idx counts within each corpus, and problem names texts over the limit."""
    from lontar.sources.readers import number_documents, text_problem

    held = docs(spark, sf_dir).select(F.col("source").alias("corpus_id"), F.col("doc_idx").alias("doc_id"), text_problem(F.col("text"), 10_000).alias("problem"))
    return number_documents(held, "doc_id").select("corpus_id", "doc_id", "doc_idx", "problem")
