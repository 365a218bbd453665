"""Topic, association and coherence queries. A document's topic is its source or language here, so results are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.config import TopicConfig
from lontar.operators import association as Q
from lontar.operators import quality as M
from lontar.operators import topics as K
from lontar.plans.common import ASPECTS, DOCS, LATIN, docs, in_list, latin_sql
from lontar.plans.registry import query

_STOP = frozenset({"the", "of", "and", "de", "in"})
_NO_STOP: frozenset[str] = frozenset()


def _topic(column) -> F.Column:
    return F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(-1)


_TOPIC = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE -1 END"
_BASE = f"{DOCS}, {LATIN}, asg AS (SELECT doc_idx, {_TOPIC} AS topic_id FROM docs)"


def _tokens(spark, sf_dir, stopwords=_NO_STOP) -> DataFrame:
    return docs(spark, sf_dir).select("doc_idx", "lang", K.label_tokens(F.col("text"), stopwords).alias("tokens"))


def _assigned(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_idx", _topic("lang").alias("topic_id"))


@query(f"WITH {_BASE}, df AS (SELECT word, count(*) AS tf, count(DISTINCT doc_idx) AS df FROM lat WHERE word NOT IN ({in_list(_STOP)}) GROUP BY word) SELECT word, tf, df FROM df WHERE df >= 2 AND df <= 0.85 * (SELECT count(*) FROM docs)")
def count_vocabulary(spark, sf_dir):
    """K2's vocabulary: min_df 2, max_df 0.85."""
    return K.vocabulary_counts(_tokens(spark, sf_dir, _STOP))


@query(f"WITH {_BASE}, df AS (SELECT word, count(*) AS tf, count(DISTINCT doc_idx) AS df FROM lat WHERE word NOT IN ({in_list(_STOP)}) GROUP BY word), v AS (SELECT * FROM df WHERE df >= 2 AND df <= 0.85 * (SELECT count(*) FROM docs)) SELECT count(*) AS words, CAST(sum(tf) AS BIGINT) AS counted FROM v")
def count_vectors(spark, sf_dir):
    """K2's vectors: how many words there are and how often they are counted. Vectors stay sparse: as an array each would be
    as long as the vocabulary."""
    counted, vocabulary = K.count_vectors(_tokens(spark, sf_dir, _STOP))
    held = F.udf(lambda v: int(v.values.sum()), "long")
    total = counted.agg(F.coalesce(F.sum(held("counts")), F.lit(0)).alias("counted"))
    return total.select(F.lit(len(vocabulary)).cast("long").alias("words"), "counted")


@query(f"WITH {_BASE}, c AS (SELECT word, count(*) AS frequency, min(struct_pack(d := doc_idx, p := pos)) AS f FROM lat WHERE len(word) > 2 AND word NOT IN ({in_list(_STOP)}) GROUP BY word) SELECT word, frequency, row_number() OVER (ORDER BY frequency DESC, f) AS rank FROM c ORDER BY frequency DESC, f LIMIT 50")
def word_frequency_topk(spark, sf_dir):
    """K15."""
    return K.word_frequencies(_tokens(spark, sf_dir), stopwords=_STOP).withColumn("rank", F.col("rank").cast("long"))


_FREQ = f"""WITH {_BASE}, f AS (SELECT * FROM lat WHERE word NOT IN ({in_list(_STOP)})), c AS (SELECT word, count(*) AS n, min(struct_pack(d := doc_idx, p := pos)) AS fst FROM f GROUP BY word),
top AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, fst) - 1 AS r FROM c ORDER BY n DESC, fst LIMIT 15), b AS (SELECT word, n, r, r // 5 AS topic_id FROM top),
sh AS (SELECT doc_idx, topic_id, count(DISTINCT f.word) AS k FROM f JOIN b USING (word) GROUP BY doc_idx, topic_id), ch AS (SELECT doc_idx, topic_id FROM sh QUALIFY row_number() OVER (PARTITION BY doc_idx ORDER BY k DESC, topic_id) = 1),
a AS (SELECT d.doc_idx, CAST(coalesce(ch.topic_id, -1) AS BIGINT) AS topic_id FROM docs d LEFT JOIN ch USING (doc_idx))"""


@query(f"{_FREQ} SELECT doc_idx, topic_id FROM a")
def frequency_topic_documents(spark, sf_dir):
    """Each document's bucket."""
    return K.frequency_topics(_tokens(spark, sf_dir), stopwords=_STOP)[1].withColumn("topic_id", F.col("topic_id").cast("long"))


@query(f"{_FREQ}, s AS (SELECT topic_id, count(*) AS n FROM a GROUP BY topic_id) SELECT CAST(b.topic_id AS BIGINT) AS topic_id, string_agg(word, ' ' ORDER BY r) AS words, coalesce(any_value(s.n), 0) AS size, round(coalesce(any_value(s.n), 0) / (SELECT count(*) FROM docs), 4) AS proportion FROM b LEFT JOIN s ON s.topic_id = b.topic_id GROUP BY b.topic_id")
def frequency_topics(spark, sf_dir):
    """The buckets."""
    topics = K.frequency_topics(_tokens(spark, sf_dir), stopwords=_STOP)[0]
    return topics.select(F.col("topic_id").cast("long").alias("topic_id"), F.array_join("words", " ").alias("words"), "size", "proportion")


@query(f"WITH {_BASE}, s AS (SELECT topic_id, count(*) AS n FROM asg GROUP BY topic_id) SELECT count(*) FILTER (topic_id <> -1) AS clusters, max(n) FILTER (topic_id <> -1) / sum(n) AS largest_share, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (topic_id <> -1) < greatest(3, least(8, floor(sum(n) / 250))) OR max(n) FILTER (topic_id <> -1) / sum(n) > 0.5 AS degenerate FROM s")
def degenerate_check(spark, sf_dir):
    """K7."""
    return K.degenerate(_assigned(spark, sf_dir))


_CTF = """tf AS (SELECT topic_id, word AS term, count(*) AS tf FROM lat JOIN asg USING (doc_idx) {where} GROUP BY topic_id, word),
pt AS (SELECT topic_id, sum(tf) AS tw FROM tf GROUP BY topic_id), pw AS (SELECT term, sum(tf) AS tc FROM tf GROUP BY term), av AS (SELECT avg(tw) AS a FROM pt),
ctf AS (SELECT topic_id, term, tf, {share} * ln(1 + a / tc) AS weight FROM tf JOIN pt USING (topic_id) JOIN pw USING (term), av)"""


@query(f"WITH {_BASE}, {_CTF.format(where='', share='sqrt(tf / tw)')} SELECT CAST(topic_id AS BIGINT) AS topic_id, term, tf, round(weight, 8) AS weight FROM ctf")
def class_tfidf(spark, sf_dir):
    """K10."""
    found = K.class_tfidf(_tokens(spark, sf_dir), _assigned(spark, sf_dir))
    return found.select(F.col("topic_id").cast("long").alias("topic_id"), "term", "tf", F.round("weight", 8).alias("weight"))


@query(f"WITH {_BASE}, {_CTF.format(where='', share='sqrt(tf / tw)')}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS k FROM ctf) SELECT CAST(topic_id AS BIGINT) AS topic_id, string_agg(term, ' ' ORDER BY k) AS words FROM r WHERE k <= 10 GROUP BY topic_id")
def topic_labels(spark, sf_dir):
    """K10's ten strongest words a topic."""
    found = K.top_terms(K.class_tfidf(_tokens(spark, sf_dir), _assigned(spark, sf_dir)))
    return found.select(F.col("topic_id").cast("long").alias("topic_id"), F.array_join("words", " ").alias("words"))


@query(f"""WITH {_BASE}, {_CTF.format(where='WHERE topic_id <> -1', share='(tf / tw)')}, tn AS (SELECT topic_id, sqrt(sum(weight * weight)) AS n FROM ctf GROUP BY topic_id),
idf AS (SELECT term, max(weight / tf) AS i FROM ctf GROUP BY term), dt AS (SELECT doc_idx, word AS term, count(*) AS f FROM lat JOIN asg USING (doc_idx) WHERE topic_id = -1 GROUP BY doc_idx, word),
v AS (SELECT doc_idx, term, f * i AS w FROM dt JOIN idf USING (term)), dn AS (SELECT doc_idx, sqrt(sum(w * w)) AS n FROM v GROUP BY doc_idx),
s AS (SELECT v.doc_idx, c.topic_id, sum(v.w * c.weight) / (any_value(tn.n) * any_value(dn.n)) AS s FROM v JOIN ctf c USING (term) JOIN tn ON tn.topic_id = c.topic_id JOIN dn ON dn.doc_idx = v.doc_idx GROUP BY v.doc_idx, c.topic_id),
b AS (SELECT doc_idx, topic_id FROM s QUALIFY row_number() OVER (PARTITION BY doc_idx ORDER BY s DESC, topic_id) = 1 AND s >= 0.1)
SELECT a.doc_idx, CAST(coalesce(b.topic_id, a.topic_id) AS BIGINT) AS topic_id FROM asg a LEFT JOIN b USING (doc_idx)""")
def outlier_pull(spark, sf_dir):
    """K9: Spanish documents are the outliers."""
    return K.pull_outliers(_tokens(spark, sf_dir), _assigned(spark, sf_dir)).withColumn("topic_id", F.col("topic_id").cast("long"))


@query(f"WITH {_BASE} SELECT word AS term, count(*) AS n FROM lat WHERE word NOT IN ({in_list(_STOP)}) GROUP BY word HAVING count(*) >= 20")
def label_vocabulary(spark, sf_dir):
    """K12."""
    return K.label_vocabulary(docs(spark, sf_dir), min_freq=20, stopwords=_STOP)


@query(f"WITH {_BASE}, {_CTF.format(where='', share='sqrt(tf / tw)')}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS k FROM ctf), v AS (SELECT word AS term FROM lat GROUP BY word HAVING count(*) >= 30), t AS (SELECT topic_id, term, k, term IN (SELECT term FROM v) AS hit FROM r WHERE k <= 30), h AS (SELECT *, max(hit) OVER (PARTITION BY topic_id) AS any_hit FROM t), q AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY k) AS o FROM h WHERE hit OR NOT any_hit) SELECT CAST(topic_id AS BIGINT) AS topic_id, string_agg(term, ' ' ORDER BY k) AS words FROM q WHERE o <= 10 GROUP BY topic_id")
def label_filter(spark, sf_dir):
    """K13."""
    d = docs(spark, sf_dir)
    topics = K.top_terms(K.class_tfidf(_tokens(spark, sf_dir), _assigned(spark, sf_dir)), 30)
    found = K.filter_label_words(topics, K.label_vocabulary(d, min_freq=30, stopwords=_NO_STOP))
    return found.select(F.col("topic_id").cast("long").alias("topic_id"), F.array_join("words", " ").alias("words"))


@query(f"WITH {_BASE}, s AS (SELECT word, count(*) AS n, min(struct_pack(d := doc_idx, p := pos)) AS f FROM (SELECT doc_id AS doc_idx, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {latin_sql('lower(text)', 3)} AS w FROM documents)) GROUP BY word) SELECT substr(word, 1, 4) AS stem, word AS surface, n FROM s WHERE substr(word, 1, 4) IN ('tion', 'erst', 'thin', 'enhe') QUALIFY row_number() OVER (PARTITION BY substr(word, 1, 4) ORDER BY n DESC, f) = 1")
def surface_forms(spark, sf_dir):
    """K16, with the first four letters as stems."""
    d = docs(spark, sf_dir)
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))).alias("token")).distinct().withColumn("stem", F.substring("token", 1, 4))
    wanted = spark.createDataFrame([("tion",), ("erst",), ("thin",), ("enhe",)], "word string")
    return K.surface_map(d, wanted, words)


@query(f"WITH {_BASE}, s AS (SELECT topic_id, count(*) AS size FROM asg WHERE topic_id <> -1 GROUP BY topic_id), r AS (SELECT topic_id, size, row_number() OVER (ORDER BY round(size / (SELECT count(*) FROM asg), 4) DESC, topic_id) - 1 AS k FROM s) SELECT a.doc_idx, coalesce(r.k, -1) AS topic_id FROM asg a LEFT JOIN r USING (topic_id)")
def renumbered_topics(spark, sf_dir):
    """K18."""
    topics = spark.createDataFrame([(0, ["x"]), (1, ["y"]), (2, ["z"])], "topic_id int, words array<string>")
    return K.renumber(topics, _assigned(spark, sf_dir))[1].withColumn("topic_id", F.col("topic_id").cast("long"))


@query()
def lda_topics(spark, sf_dir):
    """K3: another sampler than the reference's, so rows only."""
    topics, _ = K.lda_topics(_tokens(spark, sf_dir, _STOP))
    return topics.select("topic_id", "words", "size", "proportion")


@query()
def kmeans_topics(spark, sf_dir):
    """K4, K5: TF-IDF, PCA, k-means; class TF-IDF labels."""
    tokens = _tokens(spark, sf_dir, _STOP).filter(F.size("tokens") > 0)
    assigned = K.cluster(K.features(tokens), 4)
    return K.renumber(K.top_terms(K.class_tfidf(tokens, assigned)), assigned)[0].select("topic_id", "words", "size", "proportion")


@query()
def diverse_labels(spark, sf_dir):
    """Maximal marginal relevance over topics' terms, with class-share vectors."""
    weights = K.class_tfidf(_tokens(spark, sf_dir), _assigned(spark, sf_dir))
    return K.diverse_labels(weights, [-1, 0, 1, 2]).select("topic_id", "words")


_SURFACES = f"s AS (SELECT word, count(*) AS n, min(struct_pack(d := doc_idx, p := pos)) AS f FROM (SELECT doc_id AS doc_idx, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {latin_sql('lower(text)', 3)} AS w FROM documents)) GROUP BY word), sf AS (SELECT substr(word, 1, 4) AS stem, word AS surface FROM s QUALIFY row_number() OVER (PARTITION BY substr(word, 1, 4) ORDER BY n DESC, f) = 1)"


@query(f"WITH {_SURFACES}, t AS (SELECT * FROM (VALUES (0, 0, 'tion'), (0, 1, 'thin'), (1, 0, 'erst'), (1, 1, 'zzzz'), (1, 2, 'enhe')) AS v(topic_id, i, w)) SELECT topic_id, string_agg(coalesce(surface, w), ' ' ORDER BY i) AS words, string_agg(w, ' ' ORDER BY i) AS words_stemmed FROM t LEFT JOIN sf ON stem = w GROUP BY topic_id")
def readable_labels(spark, sf_dir):
    """K17, with the first four letters as stems; a stem that nobody wrote stays."""
    d = docs(spark, sf_dir)
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))).alias("token")).distinct().withColumn("stem", F.substring("token", 1, 4))
    topics = spark.createDataFrame([(0, ["tion", "thin"]), (1, ["erst", "zzzz", "enhe"])], "topic_id int, words array<string>")
    wanted = topics.select(F.explode("words").alias("word"))
    shown = K.readable(topics, K.surface_map(d, wanted, words))
    return shown.select("topic_id", F.array_join("words", " ").alias("words"), F.array_join("words_stemmed", " ").alias("words_stemmed"))


@query(f"{_FREQ} SELECT count(DISTINCT topic_id) AS num_topics, 'Ditemukan ' || count(DISTINCT topic_id) || ' topik dengan frekuensi kata. Topik utama: ' || (SELECT string_agg(word, ', ' ORDER BY r) FROM b WHERE topic_id = 0 AND r < 3) || '.' AS summary FROM b")
def topic_summary(spark, sf_dir):
    """K19."""
    return K.summary(K.frequency_topics(_tokens(spark, sf_dir), stopwords=_STOP)[0])


def _by_source(spark, sf_dir) -> DataFrame:
    """Sources, numbered by their names, as a clustering of 20 topics."""
    names = docs(spark, sf_dir).select("source").distinct()
    from pyspark.sql import Window

    numbered = names.withColumn("topic_id", (F.row_number().over(Window.orderBy("source")) - 1).cast("int"))
    return docs(spark, sf_dir).join(F.broadcast(numbered), "source").select("doc_idx", "topic_id")


@query()
def topic_sweep(spark, sf_dir):
    """Measures of every number of topics that 20 clusters merge down to."""
    return K.sweep_k(_tokens(spark, sf_dir, _STOP), _by_source(spark, sf_dir))


@query(f"WITH {_BASE} SELECT 3 AS k, round(count(*) FILTER (topic_id = -1) / count(*), 4) AS outlier_rate, (SELECT round(max(n) / (SELECT count(*) FROM asg), 4) FROM (SELECT count(*) AS n FROM asg WHERE topic_id <> -1 GROUP BY topic_id)) AS largest_share FROM asg")
def sweep_shares(spark, sf_dir):
    """E32's shares, of languages as they are."""
    return K.sweep_k(_tokens(spark, sf_dir, _STOP), _assigned(spark, sf_dir), [3]).select("k", "outlier_rate", "largest_share")


@query()
def auto_topics(spark, sf_dir):
    """K6, K8: the number of topics by balance and C_v."""
    chosen = K.choose_topics(_tokens(spark, sf_dir, _STOP), _by_source(spark, sf_dir), 0)
    return chosen.groupBy("topic_id").agg(F.count("*").alias("size"))


@query()
def topic_analysis(spark, sf_dir):
    """K1: the whole chain, with readable labels."""
    found = K.analyze(docs(spark, sf_dir).select("doc_idx", "text"), num_topics=4, stopwords=_STOP)
    return found["topics"].select("topic_id", "words", "words_stemmed", "size", "proportion")


# ---- association ------------------------------------------------------------------------------------------------------
_PRES = f"""{_BASE}, aw AS (SELECT DISTINCT doc_idx, word AS aspect, min(pos) AS pos FROM lat WHERE word IN ({in_list(a for a in ASPECTS if ' ' not in a)}, 'of', 'to', 'en', 'in') GROUP BY doc_idx, word),
pr AS (SELECT doc_idx, aspect, pos, topic_id FROM aw JOIN asg USING (doc_idx) WHERE topic_id <> -1), nt AS (SELECT topic_id, count(*) AS n FROM asg WHERE topic_id <> -1 GROUP BY topic_id), tot AS (SELECT sum(n) AS n FROM nt),
na AS (SELECT aspect, count(*) AS n, min(struct_pack(d := doc_idx, p := pos)) AS f FROM pr GROUP BY aspect HAVING count(*) >= 3), co AS (SELECT aspect, topic_id, count(*) AS n FROM pr GROUP BY aspect, topic_id),
pmi AS (SELECT co.aspect, co.topic_id, co.n AS co_occurrence, round(log2((co.n / tot.n) / ((na.n / tot.n) * (nt.n / tot.n))), 4) AS pmi, na.f FROM co JOIN na USING (aspect) JOIN nt USING (topic_id), tot)"""


def _doc_aspects(spark, sf_dir) -> DataFrame:
    chosen = [*(a for a in ASPECTS if " " not in a), "of", "to", "en", "in"]
    words = K.label_tokens(F.col("text"), _NO_STOP)
    flat = docs(spark, sf_dir).select("doc_idx", F.posexplode(words).alias("pos", "w")).filter(F.col("w").isin(*chosen)).groupBy("doc_idx", "w").agg(F.min("pos").alias("pos"))
    return flat.groupBy("doc_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]).alias("aspects"))


@query(f"WITH {_PRES} SELECT aspect, CAST(topic_id AS BIGINT) AS topic_id, pmi, co_occurrence FROM pmi")
def pmi_pairs(spark, sf_dir):
    """Q1, Q3: all pairs that meet."""
    return Q.pmi(_doc_aspects(spark, sf_dir), _assigned(spark, sf_dir)).select("aspect", F.col("topic_id").cast("long").alias("topic_id"), "pmi", "co_occurrence")


@query(f"WITH {_PRES}, pl AS (SELECT aspect, doc_idx, row_number() OVER (PARTITION BY doc_idx ORDER BY pos) - 1 AS k FROM aw), fa AS (SELECT aspect, min(struct_pack(d := doc_idx, p := k)) AS f FROM pl SEMI JOIN (SELECT doc_idx FROM asg WHERE topic_id <> -1) USING (doc_idx) GROUP BY aspect) SELECT aspect, CAST(topic_id AS BIGINT) AS topic_id, pmi, co_occurrence, row_number() OVER (ORDER BY pmi DESC, fa.f, topic_id) AS rank FROM pmi JOIN fa USING (aspect) WHERE pmi > 0 ORDER BY pmi DESC, fa.f, topic_id LIMIT 20")
def pmi_top(spark, sf_dir):
    """Q1: the strongest positive ones."""
    top = Q.top_associations(Q.pmi(_doc_aspects(spark, sf_dir), _assigned(spark, sf_dir)))
    return top.select("aspect", F.col("topic_id").cast("long").alias("topic_id"), "pmi", "co_occurrence", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_PRES} SELECT aspect, coalesce(max(pmi) FILTER (topic_id = 0), 0) AS topic_0, coalesce(max(pmi) FILTER (topic_id = 1), 0) AS topic_1, coalesce(max(pmi) FILTER (topic_id = 2), 0) AS topic_2, CAST(0 AS DOUBLE) AS topic_3 FROM pmi GROUP BY aspect")
def pmi_heatmap(spark, sf_dir):
    """Q2: dense; topic 3 is empty."""
    return Q.heatmap(_doc_aspects(spark, sf_dir), _assigned(spark, sf_dir), 4)


# ---- coherence --------------------------------------------------------------------------------------------------------
_TOPICS = [(0, ["the", "of", "and", "to", "in"]), (1, ["de", "la", "en", "le", "des"]), (2, ["der", "die", "und", "den", "of"]), (3, ["the", "zzz"])]
_TERMS = "tw(topic_id, i, term) AS (VALUES " + ", ".join(f"({t}, {i}, '{w}')" for t, ws in _TOPICS for i, w in enumerate(ws)) + ")"


def _topics(spark) -> DataFrame:
    return spark.createDataFrame(_TOPICS, "topic_id int, words array<string>")


def _npmi_sql(size: int) -> str:
    """CTEs up to `cell`: topic_id, i, j, npmi for all ordered pairs of words."""
    return f"""{_TERMS}, {DOCS}, {LATIN}, ln AS (SELECT doc_idx, count(*) AS n FROM lat GROUP BY doc_idx),
voc AS (SELECT l.doc_idx, word, pos, n, least(n, {size}) AS w FROM lat l JOIN ln USING (doc_idx) WHERE word IN (SELECT term FROM tw)),
win AS (SELECT DISTINCT doc_idx, word, unnest(generate_series(greatest(0, pos - w + 1), least(pos, n - w))) AS k FROM voc), tot AS (SELECT sum(greatest(1, n - {size} + 1)) AS n FROM ln),
one AS (SELECT word, count(*) AS n FROM win GROUP BY word), two AS (SELECT a.word AS w1, b.word AS w2, count(*) AS n FROM win a JOIN win b ON a.doc_idx = b.doc_idx AND a.k = b.k GROUP BY 1, 2),
pr AS (SELECT a.topic_id, a.i, b.i AS j, a.term AS w1, b.term AS w2, coalesce(two.n, 0) / tot.n AS p12, coalesce(x.n, 0) / tot.n AS p1, coalesce(y.n, 0) / tot.n AS p2
    FROM tw a JOIN tw b USING (topic_id) LEFT JOIN two ON two.w1 = a.term AND two.w2 = b.term LEFT JOIN one x ON x.word = a.term LEFT JOIN one y ON y.word = b.term, tot),
cell AS (SELECT *, CASE WHEN w1 = w2 THEN 1.0::DOUBLE WHEN p1 <= 0 OR p2 <= 0 THEN 0.0::DOUBLE WHEN p12 >= 1 - 1e-12::DOUBLE THEN 1.0::DOUBLE ELSE ln((p12 + 1e-12::DOUBLE) / (p1 * p2)) / -ln(p12 + 1e-12::DOUBLE) END AS npmi FROM pr)"""


@query(f"WITH {_npmi_sql(10)} SELECT w1 AS term1, w2 AS term2, n FROM two WHERE w1 <= w2")
def window_cooccurrence(spark, sf_dir):
    """Q4, Q5: windows of ten words, within a vocabulary, counted from the words' places for all its pairs."""
    vocabulary = _topics(spark).select(F.explode("words").alias("term")).distinct()
    pairs = vocabulary.withColumnRenamed("term", "term1").crossJoin(F.broadcast(vocabulary.withColumnRenamed("term", "term2"))).filter("term1 <= term2")  # the topics' words
    return M.window_counts(_tokens(spark, sf_dir), "tokens", 10, pairs)


@query(f"WITH {_npmi_sql(110)} SELECT w1 AS term1, w2 AS term2, n FROM two WHERE w1 IN ('de', 'of') AND w2 IN ('de', 'of', 'the') AND w1 <= w2")
def window_pair_counts(spark, sf_dir):
    """Q5 for given pairs of words, counted from their places without making windows."""
    pairs = spark.createDataFrame([(a, b) for a in ("de", "of") for b in ("de", "of", "the") if a <= b], "term1 string, term2 string")
    return M.window_counts(_tokens(spark, sf_dir), "tokens", 110, pairs)


_CNPMI = "(SELECT round(avg(v), 4) FROM (SELECT topic_id, avg(npmi) AS v FROM {cell} WHERE i < j GROUP BY topic_id))"


@query(f"WITH {_npmi_sql(10)} SELECT {_CNPMI.format(cell='cell')} AS c_npmi")
def npmi_coherence(spark, sf_dir):
    """Q6, Q7."""
    return M.npmi_coherence(_topics(spark), _tokens(spark, sf_dir)).select(F.round("c_npmi", 4).alias("c_npmi"))


_CV = """sm AS (SELECT topic_id, j, sum(npmi) AS s FROM cell GROUP BY topic_id, j), cs AS (SELECT c.topic_id, c.i, sum(c.npmi * s) / (sqrt(sum(c.npmi * c.npmi)) * sqrt(sum(s * s))) AS v FROM cell c JOIN sm ON sm.topic_id = c.topic_id AND sm.j = c.j GROUP BY c.topic_id, c.i)"""


@query(f"WITH {_npmi_sql(110)}, {_CV} SELECT round(avg(v), 4) AS c_v FROM (SELECT topic_id, avg(v) AS v FROM cs GROUP BY topic_id)")
def cv_coherence(spark, sf_dir):
    """Q8."""
    return M.cv_coherence(_topics(spark), _tokens(spark, sf_dir)).select(F.round("c_v", 4).alias("c_v"))


@query(f"WITH {_BASE}, c AS (SELECT topic_id, word, count(*) AS tf FROM lat JOIN asg USING (doc_idx) GROUP BY ALL), r AS (SELECT word FROM c QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY tf DESC, word) <= 25) SELECT count(DISTINCT word) / count(*) AS diversity FROM r")
def topic_diversity(spark, sf_dir):
    """Q9, of the 25 most frequent words of each topic."""
    counts = K.class_counts(_tokens(spark, sf_dir), _assigned(spark, sf_dir))
    return M.diversity(K.top_terms(counts.withColumn("weight", F.col("tf")), 25), 25)


@query(f"WITH {_BASE} SELECT avg(CASE WHEN topic_id = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS outlier_rate FROM asg")
def outlier_rate(spark, sf_dir):
    """Q10."""
    return M.outlier_rate(_assigned(spark, sf_dir))


@query(f"""SELECT (WITH {_npmi_sql(110)}, {_CV} SELECT round(avg(v), 4) FROM (SELECT topic_id, avg(v) AS v FROM cs GROUP BY topic_id)) AS c_v, (WITH {_npmi_sql(10)} SELECT {_CNPMI.format(cell='cell')}) AS c_npmi,
(WITH {_TERMS} SELECT round(count(DISTINCT term) / count(*), 4) FROM tw) AS diversity, (WITH {_BASE} SELECT round(avg(CASE WHEN topic_id = -1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) FROM asg) AS outlier_rate, CAST({len(_TOPICS)} AS BIGINT) AS num_topics""")
def topic_quality(spark, sf_dir):
    """Q11: the measures above in one row."""
    return M.evaluate(_topics(spark), _tokens(spark, sf_dir), _assigned(spark, sf_dir))


@query()
def combined_analysis(spark, sf_dir):
    """Sentiment-bearing aspects against k-means topics: the whole chain, K1 to Q1."""
    d = docs(spark, sf_dir)
    found = K.analyze(d, num_topics=4, config=TopicConfig(), stopwords=_STOP)
    from lontar.operators.aspects import document_aspects
    from lontar.operators.spans import literal_spans

    aspects = document_aspects(d, literal_spans(d, ASPECTS))
    return Q.top_associations(Q.pmi(aspects, found["document_topics"]))
