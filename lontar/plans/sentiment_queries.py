"""Sentiment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.config import CleanConfig, SentimentConfig
from lontar.operators import sentiment as S
from lontar.plans.common import DOCS, TABLE_LEXICON, docs, in_list, read, words_sql
from lontar.plans.registry import query
from lontar.plans.text_queries import clean_ctes

_L = TABLE_LEXICON
_EDGE = """^[.,!?;:"()\\[\\]]+|[.,!?;:"()\\[\\]]+$"""


def predictions_sql(source: str = "docs") -> str:
    """CTEs up to `pred`: one row a document of `source` (doc_idx, lang, text)."""
    return f"""w AS (SELECT doc_idx, lang, list_transform({words_sql('lower(text)')}, lambda x: regexp_replace(x, '{_EDGE}', '', 'g')) AS w FROM {source}),
t AS (SELECT doc_idx, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM w),
k AS (SELECT doc_idx, x, pos, CASE WHEN x IN ({in_list(_L.lexicon_negations)}) THEN 'n' WHEN x IN ({in_list(_L.positive)}) THEN 'p' WHEN x IN ({in_list(_L.negative)}) THEN 'm' END AS kind FROM t),
fl AS (SELECT *, coalesce(max(CASE WHEN kind = 'n' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_idx ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) AS flip FROM k),
c AS (SELECT doc_idx, count(*) FILTER ((kind = 'p' AND flip = 0) OR (kind = 'm' AND flip = 1)) AS pos, count(*) FILTER ((kind = 'm' AND flip = 0) OR (kind = 'p' AND flip = 1)) AS neg FROM fl GROUP BY doc_idx),
m AS (SELECT w.doc_idx, w.lang, len(w.w) = 0 AS blank, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM w LEFT JOIN c USING (doc_idx)),
pred AS (SELECT doc_idx, lang, CASE WHEN blank THEN 'neutral' WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN blank THEN 0.0::DOUBLE WHEN pos = neg THEN 0.5::DOUBLE ELSE round(least(0.6::DOUBLE + greatest(pos, neg) * 0.1::DOUBLE, 0.95::DOUBLE), 4) END AS confidence,
    CASE WHEN blank OR pos + neg = 0 THEN 0.0::DOUBLE ELSE round(pos / (pos + neg), 4) END AS s_pos, CASE WHEN blank OR pos + neg = 0 THEN 0.0::DOUBLE ELSE round(neg / (pos + neg), 4) END AS s_neg,
    CASE WHEN blank THEN 'empty' ELSE 'rule-based' END AS method FROM m)"""


_PRED = f"WITH {DOCS}, {predictions_sql()}"


def predictions(spark, sf_dir) -> DataFrame:
    return S.score_lexicon(docs(spark, sf_dir), "text", _L)


@query(f"{_PRED} SELECT doc_idx, sentiment, confidence, s_pos AS positive, CASE WHEN method = 'empty' THEN 0.0 WHEN s_pos + s_neg = 0 THEN 1.0 ELSE round(greatest(0.0, 1.0 - s_pos - s_neg), 4) END AS neutral, s_neg AS negative, method FROM pred")
def sentiment_lexicon(spark, sf_dir):
    """T6, T8, T9."""
    return predictions(spark, sf_dir).select("doc_idx", "sentiment", "confidence", "scores.*", "method")


_SHARES = ", ".join(f"round(count(*) FILTER (sentiment = '{k}') * 100 / count(*), 2) AS {k}" for k in S.LABELS)


@query(f"{_PRED} SELECT lang, {_SHARES}, count(*) AS total FROM pred WHERE method <> 'empty' GROUP BY lang")
def sentiment_distribution(spark, sf_dir):
    """T10 by language: the flagship."""
    return S.distribution(predictions(spark, sf_dir), ("lang",))


@query(f"{_PRED} SELECT lang, round(avg(confidence) FILTER (method <> 'empty'), 4) AS avg_confidence, round(min(confidence) FILTER (method <> 'empty'), 4) AS min_confidence, round(max(confidence) FILTER (method <> 'empty'), 4) AS max_confidence, count(*) FILTER (method <> 'empty') AS total_analyzed, count(*) AS total_texts, count(*) FILTER (method = 'empty') AS empty, CAST(0 AS BIGINT) AS truncated, CAST(0 AS BIGINT) AS failed FROM pred GROUP BY lang")
def sentiment_metrics(spark, sf_dir):
    """T11."""
    return S.metrics(predictions(spark, sf_dir), ("lang",))


@query(f"{_PRED} SELECT doc_idx, confidence, row_number() OVER (ORDER BY confidence, doc_idx) AS review_rank FROM pred WHERE method <> 'empty' AND confidence < 0.94 ORDER BY confidence, doc_idx LIMIT 200")
def review_queue(spark, sf_dir):
    """The least sure 200."""
    return S.review_queue(predictions(spark, sf_dir)).select("doc_idx", "confidence", F.col("review_rank").cast("long").alias("review_rank"))


@query(f"{_PRED} SELECT 0.94::DOUBLE AS threshold, count(*) FILTER (confidence < 0.94) AS count, round(count(*) FILTER (confidence < 0.94) / count(*), 4) AS share FROM pred WHERE method <> 'empty'")
def review_share(spark, sf_dir):
    return S.review_share(predictions(spark, sf_dir))


@query(f"""{_PRED}, d AS (SELECT lang, {_SHARES}, count(*) AS total FROM pred WHERE method <> 'empty' GROUP BY lang), g AS (SELECT *, greatest(positive, neutral, negative) AS most FROM d)
SELECT lang, 'Dari ' || total || ' teks yang dianalisis, ' || most || '% menunjukkan sentimen ' || CASE most WHEN positive THEN 'positif' WHEN neutral THEN 'netral' ELSE 'negatif' END || '. Distribusi lengkap: ' || positive || '% positif, ' || neutral || '% netral, ' || negative || '% negatif.' AS summary FROM g""")
def sentiment_summary(spark, sf_dir):
    """T13."""
    return S.summary(S.distribution(predictions(spark, sf_dir), ("lang",))).select("lang", "summary")


_T = SentimentConfig().temperature


@query(f"""WITH l AS (SELECT vec_id, embedding[1]::DOUBLE * 5 AS a, embedding[2]::DOUBLE * 5 AS b, embedding[3]::DOUBLE * 5 AS c FROM embeddings),
e AS (SELECT *, exp((a - greatest(a, b, c)) / {_T}) AS x, exp((b - greatest(a, b, c)) / {_T}) AS y, exp((c - greatest(a, b, c)) / {_T}) AS z FROM l)
SELECT vec_id, CASE greatest(x, y, z) WHEN x THEN 'positive' WHEN y THEN 'neutral' ELSE 'negative' END AS sentiment, round(greatest(x, y, z) / (x + y + z), 4) AS confidence,
round(x / (x + y + z), 4) AS positive, round(y / (x + y + z), 4) AS neutral, round(z / (x + y + z), 4) AS negative FROM e""")
def model_scores(spark, sf_dir):
    """Softmax at a temperature over given logits."""
    logits = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 5)
    return S.score_logits(read(spark, sf_dir, "embeddings").select("vec_id", logits.alias("logits"))).select("vec_id", "sentiment", "confidence", "scores.*")


@query(f"SELECT doc_id, CAST(least(512, ceil(len({words_sql('text')}) / 8) * 8) AS BIGINT) AS padded, len({words_sql('text')}) >= 512 AS truncated FROM documents")
def padded_lengths(spark, sf_dir):
    """What a batch is padded to, and what is cut."""
    from lontar.functions.text import tokens

    n = F.size(tokens(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", S.padded_length(n).cast("long").alias("padded"), (n >= 512).alias("truncated"))


@query(f"""WITH s AS (SELECT doc_id AS doc_idx, text, trim(text) = '' AS blank, contains(text, '!!') AS bad, len(text) % 7 AS a, len(text) % 5 AS b, len(text) % 3 AS c FROM documents),
e AS (SELECT *, exp((a - greatest(a, b, c)) / {_T}) AS x, exp((b - greatest(a, b, c)) / {_T}) AS y, exp((c - greatest(a, b, c)) / {_T}) AS z FROM s)
SELECT doc_idx, CASE WHEN blank OR bad THEN 'neutral' ELSE CASE greatest(x, y, z) WHEN x THEN 'positive' WHEN y THEN 'neutral' ELSE 'negative' END END AS sentiment,
CASE WHEN blank OR bad THEN 0.0 ELSE round(greatest(x, y, z) / (x + y + z), 4) END AS confidence, CASE WHEN blank THEN 'empty' WHEN bad THEN 'error' ELSE 'model' END AS method FROM e""")
def plugin_scorer(spark, sf_dir):
    """A plug-in scorer in length order; texts that break it are found by halving and marked."""

    def scorer(texts):
        if any("!!" in t for t in texts):
            raise ValueError("cannot score")
        return [[len(t) % 7, len(t) % 5, len(t) % 3] for t in texts]

    scored = S.score_with(docs(spark, sf_dir), scorer, "text")
    return S.finish_model_rows(scored, "text").select("doc_idx", "sentiment", "confidence", "method")


def _prepared(name: str, ctes: str, column: str) -> str:
    """A subquery of a preparation's predictions."""
    head = f"{ctes}, " if ctes else ""
    source = f"SELECT doc_idx, lang, {column} AS text FROM f" if ctes else "SELECT doc_id AS doc_idx, lang, text FROM documents"
    return f"(WITH {head}v AS ({source}), {predictions_sql('v')} SELECT '{name}' AS config, sentiment, method FROM pred)"


_PLAIN, _NORMAL = clean_ctes(typos=False, slang=False), clean_ctes()


@query(
    f"SELECT config, {_SHARES}, count(*) AS total FROM (SELECT * FROM " + " UNION ALL SELECT * FROM ".join(
        [_prepared("none", "", ""), _prepared("case_and_punctuation", _PLAIN, "processed_text"), _prepared("normalised", _NORMAL, "processed_text"), _prepared("as_sent", _NORMAL, "processed_text")]
    ) + ") WHERE method <> 'empty' GROUP BY config"
)
def preprocessing_ablation(spark, sf_dir):
    """Four preparations, of which the last two must agree."""
    return S.distribution(S.preprocessing_ablation(docs(spark, sf_dir).select("doc_idx", "text"), lexicon=_L), ("config",))


@query(f"WITH {_NORMAL}, v AS (SELECT doc_idx, lang, processed_text AS text FROM f), {predictions_sql('v')} SELECT doc_idx, sentiment, confidence, method FROM pred")
def sentiment_cleaned(spark, sf_dir):
    """Cleaning first, under the transformer profile."""
    found = S.analyze(docs(spark, sf_dir), CleanConfig(), _L)
    return found["predictions"].select("doc_idx", "sentiment", "confidence", "method")


@query("""WITH d AS (SELECT CASE WHEN lang = 'en' THEN 'own names' ELSE 'unknown names' END AS model, CAST(n_chars % 3 AS INTEGER) AS id FROM documents)
SELECT model, id, CASE WHEN (model = 'own names') = (id = 0) AND id <> 1 THEN 'negative' WHEN id = 1 THEN 'neutral' ELSE 'positive' END AS label, count(*) AS n FROM d GROUP BY ALL""")
def label_maps(spark, sf_dir):
    """Labels that models gave documents by number; names in any order, the default order where they don't name all three."""
    models = {"own names": {0: "NEG", 1: "Netral", 2: "positif"}, "unknown names": {0: "LABEL_0", 1: "LABEL_1", 2: "LABEL_2"}}
    named = spark.createDataFrame([(m, i, label) for m, names in models.items() for i, label in S.resolve_label_map(names).items()], "model string, id int, label string")
    given = read(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "own names").otherwise("unknown names").alias("model"), (F.col("n_chars") % 3).cast("int").alias("id"))
    return given.groupBy("model", "id").agg(F.count("*").alias("n")).join(named, ["model", "id"])
