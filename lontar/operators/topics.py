"""Topics: vectorising, LDA and clustering with MLlib, labels, and the rules that choose and repair a clustering."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import CountVectorizer, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.config import CleanConfig, Lexicon, TopicConfig
from lontar.functions.stem import stem_map
from lontar.functions.text import tokens as split_tokens
from lontar.lexicons import INDONESIAN, TOPIC_LABEL_STOPWORDS
from lontar.operators import lda, products, quality
from lontar.operators.clean import clean, filter_rare_tokens
from lontar.operators.density import density_clusters
from lontar.operators.layout import graph_layout
from lontar.operators.lda import LDA
from lontar.operators.neighbours import distinct_points
from lontar.tables import materialize, remove

#: Hash values of terms, and columns that their fixed random projection leaves for PCA.
TERMS, COLUMNS = 1 << 20, 1000


def label_tokens(text: Column, stopwords=TOPIC_LABEL_STOPWORDS) -> Column:
    """Words of two or more a-z letters that may label a topic."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b([a-z][a-z]+)\b"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*sorted(stopwords))) if stopwords else words


def vocabulary_counts(docs: DataFrame, words: str = "tokens", key: str = "doc_idx", for_classes: bool = False) -> DataFrame:
    """word, tf, df of the words that are counted: from 50 documents on those of two documents or more and of no more than 85 %
    of them; else, and for class weights, all."""
    flat = docs.select(key, F.explode(words).alias("word"))
    by = flat.groupBy("word", key).agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    n = docs.count()
    return by if for_classes or n < 50 else by.filter((F.col("df") >= 2) & (F.col("df") <= 0.85 * n))


def count_vectors(docs: DataFrame, words: str = "tokens", output: str = "counts", for_classes: bool = False):
    """Term counts under vocabulary_counts' rule, over all terms. Returns the frame and the vocabulary, which MLlib's models
    keep at the driver."""
    many = not for_classes and docs.count() >= 50
    model = CountVectorizer(inputCol=words, outputCol=output, minDF=2 if many else 1, maxDF=0.85 if many else 2**62, vocabSize=2**31 - 1).fit(docs)
    return model.transform(docs), model.vocabulary


def auto_k(n: int) -> int:
    return max(2, min(20, int(sqrt(n / 2))))


def lda_k(requested: int, n: int, vocabulary: int) -> int:
    return max(2, min(requested or auto_k(n), n - 1, vocabulary))


def lda_topics(docs: DataFrame, words: str = "tokens", key: str = "doc_idx", num_topics: int = 5, config: TopicConfig = TopicConfig(), iterations: int = 20):
    """Topics and hard assignments by variational LDA; topics are numbered by their share of documents. Words are counted under
    vocabulary_counts' rule; at the driver are their names and a weight for each topic, in plain arrays."""
    vocabulary = materialize(vocabulary_counts(docs, words, key).select("word"), "lda_words")
    n, many = docs.count(), vocabulary.count()
    if n < 2 or many < 2:
        raise ValueError("too few documents or words for LDA")
    k = lda_k(num_topics, n, many)
    names, weights = products.sorted_block(vocabulary.select("word", *lda.start(k, config.seed)))
    corpus = lda.numbered(docs, words, key, names)
    few = corpus.coalesce(docs.sparkSession.sparkContext.defaultParallelism)  # a part sends sums as long as its vocabulary: their number follows the cores
    weights, alpha = LDA(k=k, maxIter=iterations).fit(few, weights, n)
    whole, rows = weights.sum(0), []
    for i in range(k):
        best = np.argpartition(-weights[:, i], min(many, config.top_words) - 1)[: config.top_words]
        best = best[np.lexsort((best, -weights[best, i]))]
        rows.append((i, names.take(pa.array(best)).to_pylist(), (weights[best, i] / whole[i]).tolist(), "lda"))
    found = materialize(lda.assigned(corpus, weights, alpha, key), "lda_assigned")
    remove(vocabulary, corpus)
    named = docs.sparkSession.createDataFrame(rows, "topic_id int, words array<string>, weights array<double>, method string")
    return renumber(named, found, key)


def renumber(topics: DataFrame, assigned: DataFrame, key: str = "doc_idx"):
    """Numbers topics by share of documents (of equal ones the lower old number first), keeps -1, adds size, proportion."""
    sizes = assigned.filter("topic_id != -1").groupBy("topic_id").agg(F.count("*").alias("size"))
    total = assigned.agg(F.count("*").alias("_n"))
    ranked = topics.join(sizes, "topic_id", "left").withColumn("size", F.coalesce("size", F.lit(0))).crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("proportion", F.when(F.col("_n") > 0, F.round(F.col("size") / F.col("_n"), 4)).otherwise(0.0)).withColumn("_new", F.row_number().over(Window.orderBy(F.desc("proportion"), "topic_id")) - 1)
    ids = ranked.select("topic_id", "_new")
    moved = assigned.join(F.broadcast(ids), "topic_id", "left").select(key, F.coalesce("_new", F.lit(-1)).alias("topic_id"))  # one row a topic
    return ranked.drop("topic_id", "_n").withColumnRenamed("_new", "topic_id"), moved


def features(docs: DataFrame, words: str = "tokens", method: str = "pca", size: int = 16, seed: int = 42) -> DataFrame:
    """Document vectors of length 1 for clustering: TF-IDF to PCA, or Word2Vec means. An encoder's vectors can replace them."""
    if method == "word2vec":
        made = Word2Vec(inputCol=words, outputCol="_raw", vectorSize=size, minCount=1, seed=seed).fit(docs).transform(docs)
        return Normalizer(inputCol="_raw", outputCol="features").transform(made).drop("_raw")
    return _principal(docs, words, min(size, COLUMNS), seed)


def _projection(docs: DataFrame, words: str, seed: int):
    """docs with the hashed terms _h; and what makes dense tables of them, 500 texts at a time: TF-IDF of hashed terms under
    count_vectors' rules for rare and frequent ones, by a fixed sparse random projection: each term adds to one of COLUMNS with a
    random sign. Document frequencies of the TERMS hash values, a bounded table, go to the tasks."""
    hashed = docs.withColumn("_h", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(TERMS)).cast("int")))
    counts = hashed.select(F.explode(F.array_distinct("_h")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).toPandas()
    df, n = np.zeros(TERMS, np.int64), docs.count()
    df[counts.h.to_numpy(int)] = counts.n.to_numpy()
    rng = np.random.default_rng(seed)
    column, sign = rng.integers(0, COLUMNS, TERMS), rng.choice([-1.0, 1.0], TERMS)
    weight = sign * np.log((n + 1) / (df + 1)) * ((df >= 2) & (df <= 0.85 * n) if n >= 50 else df > 0)

    def dense(hashes: pa.Array):
        for at in range(0, len(hashes), 500):
            part = hashes.slice(at, 500)
            rows = np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            h = part.flatten().to_numpy(zero_copy_only=False)
            yield np.bincount(rows * COLUMNS + column[h], weight[h], len(part) * COLUMNS).reshape(len(part), COLUMNS)

    return hashed, dense


def _principal(docs: DataFrame, words: str, size: int, seed: int) -> DataFrame:
    """docs with features: the projected TF-IDF's `size` principal components, of length 1. One pass adds up the products of the
    columns, a table of fixed size for each task; the next one projects, and rows of all COLUMNS never leave a task."""
    hashed, dense = _projection(docs, words, seed)

    def products(batches):
        sums = np.zeros((COLUMNS + 1, COLUMNS))
        n = 0
        for batch in batches:
            for x in dense(batch.column(0)):
                sums[:COLUMNS] += x.T @ x
                sums[COLUMNS] += x.sum(0)
                n += len(x)
        if n:
            yield pa.record_batch([pa.array(np.arange(COLUMNS + 1), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "row"])

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(r.values) for r in group.column("row").combine_chunks()], axis=0)
        return pa.table([group.column("i").slice(0, 1), pa.array([total], pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i int, row array<double>"
    found = {r.i: np.array(r.row) for r in hashed.select("_h").mapInArrow(products, schema).groupBy("i").applyInArrow(added, schema).collect()}
    n = max(2, docs.count())
    mean = found.get(COLUMNS, np.zeros(COLUMNS)) / n
    table = np.stack([found.get(i, np.zeros(COLUMNS)) for i in range(COLUMNS)])
    onto = np.linalg.svd(table / (n - 1) - np.outer(mean, mean) * (n / (n - 1)))[0][:, :size].copy()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def turned(hashes: pa.Array) -> pa.Array:
        y = np.concatenate([np.empty((0, size)), *(x @ onto for x in dense(hashes))])
        lengths = np.sqrt((y * y).sum(1, keepdims=True))
        y /= np.where(lengths > 0, lengths, 1.0)
        return pa.ListArray.from_arrays(np.arange(0, y.size + 1, size, dtype=np.int32), y.ravel())

    return hashed.withColumn("features", array_to_vector(turned("_h"))).drop("_h")


def kmeans_k(requested: int, n: int) -> int:
    return max(2, min(20, requested or int(sqrt(n / 2)), n // 2))


def cluster(vectors: DataFrame, k: int, key: str = "doc_idx", seed: int = 42, bisecting: bool = False, outlier_share: float = 0.0) -> DataFrame:
    """key, topic_id by (bisecting) k-means. About outlier_share of each cluster's documents, those farthest from its centre,
    are -1 (by an approximate percentile of the distances; documents at the cut itself stay)."""
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol="features", predictionCol="topic_id").fit(vectors)
    out = model.transform(vectors).withColumn("topic_id", F.col("topic_id").cast("int"))
    if outlier_share <= 0:
        return out.select(key, "topic_id")
    centres = out.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "topic_id int, _c array<double>")
    apart = F.sqrt(F.aggregate(F.zip_with(vector_to_array("features"), "_c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    far = out.join(F.broadcast(centres), "topic_id").select(key, "topic_id", apart.alias("_d"))  # k rows
    cuts = far.groupBy("topic_id").agg(F.percentile_approx("_d", 1 - outlier_share, 10_000).alias("_cut"))
    return far.join(F.broadcast(cuts), "topic_id").select(key, F.when(F.col("_d") > F.col("_cut"), -1).otherwise(F.col("topic_id")).cast("int").alias("topic_id"))


def density_cluster(vectors: DataFrame, key: str = "doc_idx", seed: int = 42, size: int = 5, k: int | None = None, min_size: int | None = None) -> DataFrame:
    """key, topic_id by density: documents are laid out in `size` dimensions by their k nearest neighbours (one in 59, 10 to
    30), and dense parts of the layout are clusters; their number, and the outliers (-1), follow from the data."""
    rows = materialize(vectors.select(key, vector_to_array("features").alias("v")), "density_features")
    near = k or max(10, min(30, rows.count() // 59))
    points = materialize(distinct_points(rows, key), "density_distinct")
    layout = graph_layout(points, size, near, seed)
    laid = materialize(rows.join(points, "v").join(layout.withColumnRenamed("v", "at"), "node").select(key, F.col("at").alias("v")), "density_layout")
    out = density_clusters(laid, key, "v", min_size, k=near, seed=seed)
    remove(rows, points, layout, laid)
    return out


def degenerate(assigned: DataFrame, config: TopicConfig = TopicConfig()) -> DataFrame:
    """clusters, largest_share (of all documents, outliers too), degenerate."""
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("n"))
    real = F.col("topic_id") != -1
    row = sizes.agg(F.count_if(real).alias("clusters"), F.coalesce(F.max(F.when(real, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("largest_share"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    least = F.greatest(F.lit(config.degenerate_min), F.least(F.lit(config.degenerate_cap), F.floor(F.col("total") / config.docs_per_topic)))
    return row.withColumn("degenerate", (F.col("clusters") < least) | (F.col("largest_share") > config.max_share))


def acceptable_k(largest_share: float, k: int, config: TopicConfig = TopicConfig()) -> bool:
    return largest_share <= config.max_share and largest_share * k <= config.max_share_times_k


def select_k(natural: int, measure, config: TopicConfig = TopicConfig()) -> int:
    """Of natural down to min_topics, the accepted k with most coherence (of equal ones the larger); natural if it is small or
    none is accepted. measure(k) gives (largest share, c_v)."""
    if natural <= config.min_topics:
        return natural
    best, most = natural, None
    for k in range(natural, config.min_topics - 1, -1):
        share, c_v = measure(k)
        if acceptable_k(share, k, config) and (most is None or c_v > most):
            best, most = k, c_v
    return best


def class_counts(tokens: DataFrame, assigned: DataFrame, words: str = "tokens", key: str = "doc_idx") -> DataFrame:
    met = tokens.select(key, words).join(assigned.select(key, "topic_id"), key)  # a text meets its topic once, not each of its words
    return met.select("topic_id", F.explode(words).alias("term")).groupBy("topic_id", "term").agg(F.count("*").alias("tf"))


def class_weights(counts: DataFrame, reduce_frequent: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """topic_id, term, tf, weight: (root of) the share of a term in its topic times ln(1 + mean words a topic / the term's
    count); `by` names columns that part clusterings from one another."""
    tf = counts if by else counts.withColumn("_one", F.lit(0))
    keys = list(by) or ["_one"]
    per_topic = tf.groupBy(*keys, "topic_id").agg(F.sum("tf").alias("topic_words"))
    per_term = tf.groupBy(*keys, "term").agg(F.sum("tf").alias("term_count"))
    average = per_topic.groupBy(*keys).agg((F.sum("topic_words") / F.count("*")).alias("average"))
    share = F.col("tf") / F.col("topic_words")
    weight = (F.sqrt(share) if reduce_frequent else share) * F.ln(1 + F.col("average") / F.col("term_count"))
    whole = tf.join(per_topic, [*keys, "topic_id"]).join(per_term, [*keys, "term"]).join(average, keys)
    return whole.select(*by, "topic_id", "term", "tf", weight.alias("weight"))


def class_tfidf(tokens: DataFrame, assigned: DataFrame, words: str = "tokens", key: str = "doc_idx", reduce_frequent: bool = True) -> DataFrame:
    """topic_id, term, tf, weight of class_weights over a clustering."""
    return class_weights(class_counts(tokens, assigned, words, key), reduce_frequent)


def _by_term(counts: DataFrame) -> DataFrame:
    """term, topics, tfs: a row of counts for each term, so that what is done to a term's topics needs no further shuffle."""
    return counts.groupBy("term").agg(F.collect_list(F.struct("topic_id", "tf")).alias("s")).select("term", F.col("s.topic_id").alias("topics"), F.col("s.tf").alias("tfs"))


def _term_rows(batch: pa.RecordBatch, ids: np.ndarray):
    """Slices of a batch of _by_term's rows: its terms, and the counts as a dense table of terms and topics `ids`."""
    some = max(1, (1 << 21) // max(1, len(ids)))
    for at in range(0, len(batch), some):
        part = batch.slice(at, some)
        rows = np.repeat(np.arange(len(part)), part.column(1).value_lengths().to_numpy(zero_copy_only=False))
        tf = np.zeros((len(part), len(ids)))
        tf[rows, np.searchsorted(ids, part.column(1).flatten().to_numpy(zero_copy_only=False))] = part.column(2).flatten().to_numpy(zero_copy_only=False)
        yield part.column(0), tf


def _topic_words(by_term: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Topics, ascending, and how many words each has."""
    flat = by_term.select(F.explode(F.arrays_zip("topics", "tfs")).alias("z")).groupBy("z.topics").agg(F.sum("z.tfs").alias("n"))
    rows = sorted((r.topics, r.n) for r in flat.collect())
    return np.array([t for t, _ in rows], np.int64), np.array([n for _, n in rows], float)


def merge_order(counts: DataFrame, by_term: DataFrame | None = None) -> dict[int, dict[int, int]]:
    """For each number of topics from all down to 1, the topic that each topic is then part of: the two most alike by class
    TF-IDF (average linkage of cosines) merge, one pair at a time. Topics are few, so their cosines come to the driver: each
    task adds up the products of its own terms' weights."""
    by_term = _by_term(counts) if by_term is None else by_term
    ids, held = _topic_words(by_term)
    average = held.sum() / max(1, len(ids))

    def products(batches):
        sums = np.zeros((len(ids), len(ids)))
        for batch in batches:
            for _, tf in _term_rows(batch, ids):
                w = tf / held * np.log(1 + average / tf.sum(1, keepdims=True))
                sums += w.T @ w
        yield pa.record_batch([pa.array(np.arange(sums.size), pa.int64()), pa.array(sums.ravel())], names=["i", "d"])

    dots = np.zeros(len(ids) * len(ids))
    for r in by_term.mapInArrow(products, "i long, d double").groupBy("i").agg(F.sum("d").alias("d")).collect():
        dots[r.i] = r.d
    dots = dots.reshape(len(ids), len(ids))
    lengths = np.sqrt(dots.diagonal())
    squares = ids.tolist()
    alike = {(a, b): dots[i, j] / (lengths[i] * lengths[j]) for i, a in enumerate(squares) for j, b in enumerate(squares) if i < j and lengths[i] * lengths[j]}
    groups = [[t] for t in sorted(squares)]
    mean = lambda g, h: sum(alike.get((min(a, b), max(a, b)), 0.0) for a in g for b in h) / (len(g) * len(h))
    found = {}
    while groups:
        found[len(groups)] = {t: min(g) for g in groups for t in g}
        if len(groups) == 1:
            break
        i, j = max(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: (mean(groups[p[0]], groups[p[1]]), -p[0], -p[1]))
        groups[i] = groups[i] + groups.pop(j)
    return found


def merged(assigned: DataFrame, parts: dict[int, int], key: str = "doc_idx") -> DataFrame:
    """The assignment after a merge; outliers stay."""
    table = assigned.sparkSession.createDataFrame(sorted(parts.items()), "topic_id int, _to int")
    return assigned.join(F.broadcast(table), "topic_id", "left").select(key, F.coalesce("_to", "topic_id").alias("topic_id"))  # one row a topic


def _merged_terms(by_term: DataFrame, maps: list[tuple[int, int, int]], n: int) -> DataFrame:
    """topic_id, term, weight: the n strongest terms or more by class_weights of each topic `to` of maps (k, topic, to), which
    other topics have merged into. A task keeps the n strongest of its own terms, so no count is a row for each k."""
    ids, held = _topic_words(by_term)
    tos = sorted({(to, k) for k, _, to in maps})
    column = {to: i for i, (to, _) in enumerate(tos)}
    turn = np.zeros((len(ids), len(tos)))
    for _, old, to in maps:
        turn[np.searchsorted(ids, old), column[to]] = 1.0
    whole = held @ turn
    average = np.array([whole[[k == x for _, x in tos]].mean() for _, k in tos])
    names = np.array([to for to, _ in tos], np.int64)

    def strongest(batches):
        for batch in batches:
            for terms, tf in _term_rows(batch, ids):
                counted, all_of = tf @ turn, tf.sum(1)
                weight, at = [], []
                for c in range(len(names)):
                    rows = np.flatnonzero(counted[:, c])
                    w = np.sqrt(counted[rows, c] / whole[c]) * np.log(1 + average[c] / all_of[rows])
                    if len(rows) > n:  # ties with the n-th stay, for the order by name
                        keep = w >= np.partition(w, -n)[-n]
                        rows, w = rows[keep], w[keep]
                    at.append(rows)
                    weight.append(w)
                topic = np.repeat(names, [len(r) for r in at])
                yield pa.record_batch([pa.array(topic, pa.int64()), terms.take(pa.array(np.concatenate([np.empty(0, np.int64), *at]))), pa.array(np.concatenate([np.empty(0), *weight]))], names=["topic_id", "term", "weight"])

    return by_term.mapInArrow(strongest, "topic_id long, term string, weight double")


def sweep_k(tokens: DataFrame, assigned: DataFrame, ks: list[int] | None = None, words: str = "tokens", key: str = "doc_idx", config: TopicConfig = TopicConfig(), by_term: DataFrame | None = None) -> DataFrame:
    """k, c_v, c_npmi, diversity, outlier_rate, largest_share for numbers of topics that a clustering is merged down to (all
    down to 2). Words of all of them are scored in one pass over the corpus."""
    if by_term is None:
        by_term = materialize(_by_term(class_counts(tokens, assigned.filter("topic_id != -1"), words, key)), "sweep_counts")
    order = merge_order(by_term, by_term)
    chosen = sorted(k for k in order if (k in ks if ks is not None else k > 1))
    width = max([0, *(t for m in order.values() for t in m)]) + 1
    spark = tokens.sparkSession
    flat = [(k, old, k * width + new) for k in chosen for old, new in order[k].items()]
    maps = spark.createDataFrame(flat, "k int, topic_id int, _to int")
    labels = materialize(top_terms(_merged_terms(by_term, flat, config.top_words), config.top_words), "sweep_labels")
    of = F.floor(F.col("topic_id") / width).cast("int").alias("k")
    mean = lambda scores, name: scores.groupBy(of).agg(F.round(F.avg("v"), 4).alias(name))
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("n"))
    held = sizes.join(F.broadcast(maps), "topic_id").groupBy("k", "_to").agg(F.sum("n").alias("n")).groupBy("k").agg(F.max("n").alias("most"))
    total = sizes.agg(F.sum("n").alias("all"), F.coalesce(F.sum(F.when(F.col("topic_id") == -1, F.col("n"))), F.lit(0)).alias("out"))
    shares = held.join(F.broadcast(total), how="cross").select("k", F.round(F.col("out") / F.col("all"), 4).alias("outlier_rate"), F.round(F.col("most") / F.col("all"), 4).alias("largest_share"))  # one row
    varied = labels.select(of, F.explode("words").alias("w")).groupBy("k").agg(F.round(F.count_distinct("w") / F.count("*"), 4).alias("diversity"))
    counted = quality.topic_windows(labels, tokens, words, config.top_words)
    return mean(quality.cv_by_topic(labels, tokens, words, top_n=config.top_words, counted=counted), "c_v").join(mean(quality.npmi_by_topic(labels, tokens, words, top_n=config.top_words, counted=counted), "c_npmi"), "k").join(varied, "k").join(shares, "k")


def choose_topics(tokens: DataFrame, assigned: DataFrame, num_topics: int, words: str = "tokens", key: str = "doc_idx", config: TopicConfig = TopicConfig()) -> DataFrame:
    """The assignment with at most num_topics topics; 0 or less: with the number that select_k takes by balance and C_v."""
    natural = assigned.filter("topic_id != -1").select("topic_id").distinct().count()
    if natural <= (config.min_topics if num_topics <= 0 else num_topics):
        return assigned
    by_term = materialize(_by_term(class_counts(tokens, assigned.filter("topic_id != -1"), words, key)), "choose_counts")
    if num_topics <= 0:
        rows = {r.k: r for r in sweep_k(tokens, assigned, list(range(config.min_topics, natural + 1)), words, key, config, by_term).collect()}
        num_topics = select_k(natural, lambda k: (rows[k].largest_share, rows[k].c_v), config)
    parts = merge_order(by_term, by_term)[num_topics] if natural > num_topics else None
    remove(by_term)
    return assigned if parts is None else merged(assigned, parts, key)


def top_terms(weights: DataFrame, n: int = 10) -> DataFrame:
    """One row per topic: words and weights, strongest first, of equal ones by name."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    kept = weights.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    lists = kept.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("_r", "term", "weight"))).alias("_s"))
    return lists.select("topic_id", F.transform("_s", lambda s: s["term"]).alias("words"), F.transform("_s", lambda s: s["weight"]).alias("weights"))


def pull_outliers(tokens: DataFrame, assigned: DataFrame, words: str = "tokens", key: str = "doc_idx", config: TopicConfig = TopicConfig()) -> DataFrame:
    """Gives documents of topic -1 the topic whose class-TF-IDF vector is most similar, if its cosine is high enough."""
    weights = class_tfidf(tokens, assigned.filter("topic_id != -1"), words, key, False)
    norms = weights.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_tn"))
    lost = assigned.filter("topic_id = -1").select(key)
    tf = tokens.select(key, F.explode(words).alias("term")).join(lost, key, "left_semi").groupBy(key, "term").agg(F.count("*").alias("_f"))
    idf = weights.groupBy("term").agg(F.max(F.col("weight") / F.col("tf")).alias("_i"))
    vectors = tf.join(idf, "term").withColumn("_w", F.col("_f") * F.col("_i"))
    doc_norm = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_dn"))
    dots = vectors.join(weights.select("topic_id", "term", "weight"), "term").groupBy(key, "topic_id").agg(F.sum(F.col("_w") * F.col("weight")).alias("_dot"))
    similar = dots.join(norms, "topic_id").join(doc_norm, key).withColumn("similarity", F.col("_dot") / (F.col("_tn") * F.col("_dn")))
    best = similar.groupBy(key).agg(F.max(F.struct("similarity", (-F.col("topic_id")).alias("_t"))).alias("_b")).filter(F.col("_b.similarity") >= config.outlier_similarity)
    return assigned.join(best.select(key, (-F.col("_b._t")).alias("_new")), key, "left").select(key, F.coalesce("_new", "topic_id").alias("topic_id"))


def term_vectors(weights: DataFrame, topics: list[int]) -> DataFrame:
    """term, vector: a term's weights over the topics, which stand for its meaning where no encoder does."""
    wide = weights.groupBy("term").pivot("topic_id", topics).agg(F.first("weight"))
    return wide.select("term", F.array(*(F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in topics)).alias("vector"))


def mmr(candidates: DataFrame, n: int = 10, diversity: float = 0.3) -> DataFrame:
    """Maximal marginal relevance within each topic: topic_id, term, relevance, vector -> topic_id, words, weights.

    A topic's candidates are few (its top terms), and one topic is one group.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "term"], ascending=[False, True])
        terms, relevance = pdf.term.tolist(), pdf.relevance.to_numpy(float)
        v = np.stack([np.asarray(x, float) for x in pdf.vector])
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        alike, chosen, rest = v @ v.T, [0], list(range(1, len(terms)))
        while rest and len(chosen) < n:
            gain = [(1 - diversity) * relevance[i] - diversity * alike[i, chosen].max() for i in rest]
            chosen.append(rest.pop(int(np.argmax(gain))))
        return pd.DataFrame({"topic_id": [int(pdf.topic_id.iloc[0])], "words": [[terms[i] for i in chosen]], "weights": [[float(relevance[i]) for i in chosen]]})

    return candidates.select("topic_id", "term", "relevance", "vector").groupBy("topic_id").applyInPandas(choose, "topic_id int, words array<string>, weights array<double>")


def diverse_labels(weights: DataFrame, topics: list[int], n: int = 10, diversity: float = 0.3) -> DataFrame:
    """topic_id, words, weights: of each topic's 3 n strongest terms the n that mmr picks."""
    top = top_terms(weights, 3 * n).select("topic_id", F.explode(F.arrays_zip("words", "weights")).alias("z"))
    named = top.select("topic_id", F.col("z.words").alias("term"), F.col("z.weights").alias("relevance"))
    return mmr(named.join(term_vectors(weights, topics), "term"), n, diversity)


def label_vocabulary(docs: DataFrame, text: str = "text", min_freq: int = 1, stopwords=TOPIC_LABEL_STOPWORDS) -> DataFrame | None:
    """term, n of words frequent enough to label topics; None (no restriction) if the threshold is 1 or less, or the corpus
    has under 50 documents or such words."""
    if min_freq <= 1 or docs.limit(50).count() < 50:
        return None
    found = docs.select(F.explode(label_tokens(F.col(text), stopwords)).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= min_freq)
    return found if found.limit(50).count() >= 50 else None


def filter_label_words(topics: DataFrame, vocabulary: DataFrame | None, n: int = 10) -> DataFrame:
    """Keeps a topic's words that are in the vocabulary, all non-blank ones if none is, and at most n."""
    flat = topics.select("topic_id", F.posexplode("words").alias("_i", "term")).filter(F.trim("term") != "")
    hit = flat.withColumn("_hit", F.lit(True)) if vocabulary is None else flat.join(vocabulary.select("term", F.lit(True).alias("_hit")), "term", "left")
    lists = hit.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("_i", "term", "_hit"))).alias("_s"))
    kept = F.filter("_s", lambda s: s["_hit"].isNotNull())
    chosen = F.slice(F.when(F.size(kept) > 0, kept).otherwise(F.col("_s")), 1, n)
    return topics.drop("words").join(lists.select("topic_id", F.transform(chosen, lambda s: s["term"]).alias("words")), "topic_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def _first_place(docs: DataFrame, key: str) -> Column:
    """The least (key, _p) of a group. A whole-number key and the place are one number, which hash tables can hold, unlike structs,
    for which all rows would be sorted; null keys come first."""
    if dict(docs.dtypes)[key] not in ("tinyint", "smallint", "int", "bigint"):
        return F.min(F.struct(key, "_p"))
    number = F.coalesce(F.col(key).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    return F.min(number * F.lit(1 << 32).cast("decimal(11,0)") + F.col("_p"))


def word_frequencies(docs: DataFrame, words: str = "tokens", key: str = "doc_idx", top_n: int = 50, stopwords=TOPIC_LABEL_STOPWORDS, surfaces: DataFrame | None = None) -> DataFrame:
    """word, frequency of the most frequent words of over two letters; ties by first place. surfaces (stem, surface) turn
    stems into readable words, whose counts add up."""
    flat = docs.select(key, F.posexplode(F.transform(words, F.lower)).alias("_p", "word")).filter((F.char_length("word") > 2) & ~F.col("word").isin(*sorted(stopwords)))
    counted = flat.groupBy("word").agg(F.count("*").alias("frequency"), _first_place(docs, key).alias("_first"))
    top = counted.orderBy(F.desc("frequency"), "_first").limit(top_n)
    if surfaces is not None:
        shown = top.join(surfaces.select(F.col("stem").alias("word"), "surface"), "word", "left").withColumn("word", F.coalesce("surface", "word"))
        top = shown.groupBy("word").agg(F.sum("frequency").alias("frequency"), F.min("_first").alias("_first"))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "_first"))).drop("_first")


def frequency_topics(docs: DataFrame, words: str = "tokens", key: str = "doc_idx", stopwords=TOPIC_LABEL_STOPWORDS):
    """Topics of the 15 most frequent words in fives, and each document's topic: the bucket it shares most distinct words
    with (the first of equals), -1 if none. Size and proportion follow that assignment."""
    flat = docs.select(key, F.posexplode(words).alias("_p", "word"))
    if stopwords:
        flat = flat.filter(~F.col("word").isin(*sorted(stopwords)))
    counted = flat.groupBy("word").agg(F.count("*").alias("n"), _first_place(docs, key).alias("_first"))
    top = counted.orderBy(F.desc("n"), "_first").limit(15).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "_first")) - 1)
    bucketed = top.select("word", "n", "_r", F.floor(F.col("_r") / 5).cast("int").alias("topic_id"))
    shared = flat.select(key, "word").distinct().join(F.broadcast(bucketed), "word").groupBy(key, "topic_id").agg(F.count("*").alias("_k"))  # 15 rows
    best = shared.groupBy(key).agg(F.max(F.struct("_k", (-F.col("topic_id")).alias("_t"))).alias("_b"))
    assigned = docs.select(key).join(best.select(key, (-F.col("_b._t")).alias("topic_id")), key, "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
    lists = bucketed.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("_r", "word", "n"))).alias("_s"))
    sizes = assigned.groupBy("topic_id").agg(F.count("*").alias("size"))
    total = assigned.agg(F.count("*").alias("_n"))
    topics = lists.join(sizes, "topic_id", "left").crossJoin(F.broadcast(total)).select(
        "topic_id", F.transform("_s", lambda s: s["word"]).alias("words"), F.transform("_s", lambda s: s["n"]).alias("weights"),
        F.coalesce("size", F.lit(0)).alias("size"), F.round(F.coalesce("size", F.lit(0)) / F.col("_n"), 4).alias("proportion"), F.lit("frequency-based").alias("method"),
    )
    return topics, assigned


def surface_map(docs: DataFrame, wanted: DataFrame, stems: DataFrame | None = None, text: str = "text", key: str = "doc_idx", roots=frozenset()) -> DataFrame:
    """stem, surface: the most frequent written form of each wanted stem (of equals the first). Words of three letters or
    more that hold the stem, or all of it but its first letter, are looked at; stems (token, stem) tells their stems, or roots do."""
    flat = docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))).alias("_p", "token"))
    counted = flat.groupBy("token").agg(F.count("*").alias("n"), _first_place(docs, key).alias("_first"))
    if stems is None:  # the words that were counted are stemmed, so texts are cut once
        counted = materialize(counted, "topic_written")
        stems = stem_map(counted, "token", roots)
    near = counted.join(stems, "token").join(wanted.select(F.col("word").alias("stem")).distinct(), "stem").filter(F.col("token").contains(F.col("stem")) | F.col("token").contains(F.expr("substring(stem, 2)")))
    rank = Window.partitionBy("stem").orderBy(F.desc("n"), "_first")
    return near.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").select("stem", F.col("token").alias("surface"), "n")


def readable(topics: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Puts surfaces into `words`, keeping the stems as `words_stemmed`."""
    flat = topics.select("topic_id", F.posexplode("words").alias("_i", "stem")).join(surfaces.select("stem", "surface"), "stem", "left")
    lists = flat.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("surface", "stem").alias("w")))), lambda s: s["w"]).alias("_w"))
    return topics.withColumnRenamed("words", "words_stemmed").join(lists, "topic_id", "left").withColumnRenamed("_w", "words")


METHOD_NAMES = {"lda": "LDA", "density": "kepadatan", "kmeans": "KMeans", "bisecting": "Bisecting KMeans", "frequency-based": "frekuensi kata"}


def summary(topics: DataFrame) -> DataFrame:
    first = F.min_by(F.array_join(F.slice("words", 1, 3), ", "), "topic_id")
    names = F.create_map(*[F.lit(x) for kv in METHOD_NAMES.items() for x in kv])
    row = topics.agg(F.count("*").alias("num_topics"), first.alias("_w"), F.max("proportion").alias("_p"), F.first("method").alias("_m"))
    text = F.concat(F.lit("Ditemukan "), F.col("num_topics").cast("string"), F.lit(" topik dengan "), F.coalesce(F.element_at(names, F.col("_m")), F.col("_m")), F.lit(". Topik utama: "), F.col("_w"), F.lit("."))
    return row.select("num_topics", F.when(F.col("num_topics") == 0, "Tidak ada topik yang ditemukan.").otherwise(text).alias("summary"))


def readable_topics(topics: DataFrame, frequent: DataFrame, docs: DataFrame, text: str, key: str, roots) -> tuple[DataFrame, DataFrame]:
    """Topics with words as people write them (words_stemmed keeps the stems), and the surfaces of these and the frequent words."""
    wanted = topics.select(F.explode("words").alias("word")).unionByName(frequent.select("word")).distinct()
    surfaces = materialize(surface_map(docs, wanted, None, text, key, roots), "topic_surfaces")
    return readable(topics, surfaces), surfaces


def analyze(docs: DataFrame, user: dict | None = None, num_topics: int = 5, text: str = "text", key: str = "doc_idx", lexicon: Lexicon = INDONESIAN, config: TopicConfig = TopicConfig(), method: str = "kmeans", stopwords=TOPIC_LABEL_STOPWORDS, iterations: int = 20) -> dict:
    """Cleans with the bag-of-words profile, filters rare tokens, drops blank documents, and models the rest; documents that
    were not modelled get -1. Under three documents, or when LDA finds too few words, topics come from word frequencies.

    Clusters come from k-means, by bisection if it degenerates, and their farthest documents are outliers; with method
    "density" from density_cluster, then LDA if that finds one at most, or k-means if it degenerates and k-means does not.
    num_topics of 0 or less chooses a number by balance and C_v; clusters beyond the number merge, and outliers near a topic are pulled in. Labels
    are diverse terms that the label vocabulary has, as people write them; quality is measured on their stems.
    """
    cleaned = clean(docs.select(key, text), CleanConfig.for_task("bag_of_words", user), text, (key,), lexicon)
    tokens = filter_rare_tokens(cleaned.select(key, split_tokens(F.col("processed_text")).alias("tokens")), "tokens", [key], config.min_token_freq)
    tokens = materialize(tokens, "topic_tokens")  # each later step would plan the cleaning anew
    kept = tokens.filter(F.size("tokens") > 0)
    n = kept.count()
    if n < 3:
        topics, assigned = frequency_topics(kept, "tokens", key, stopwords)
    elif method == "lda":
        try:
            topics, assigned = lda_topics(kept, "tokens", key, num_topics, config, iterations)
        except ValueError:
            topics, assigned = frequency_topics(kept, "tokens", key, stopwords)
    else:
        vectors = materialize(features(kept, seed=config.seed).select(key, "features"), "topic_vectors")
        k = kmeans_k(num_topics, n)
        clustered = lambda bisecting: materialize(cluster(vectors, k, key, config.seed, bisecting, config.outlier_share), "topic_clusters")
        assigned = density_cluster(vectors, key, config.seed) if method == "density" else clustered(method == "bisecting")
        found = degenerate(assigned, config).first()
        if method == "density" and found.clusters < 2:
            remove(vectors, tokens)
            return analyze(docs, user, num_topics, text, key, lexicon, config, "lda", stopwords, iterations)
        if method != "bisecting" and found.degenerate:
            again = clustered(method != "density")
            if not degenerate(again, config).first().degenerate:
                assigned, method = again, "kmeans" if method == "density" else "bisecting"
        assigned = materialize(choose_topics(kept, assigned, num_topics, "tokens", key, config), "topic_merged")
        pulled = materialize(pull_outliers(kept, assigned, "tokens", key, config), "topic_pulled")
        weights = materialize(class_tfidf(kept, pulled.filter("topic_id != -1"), "tokens", key), "topic_weights")
        ids = sorted(r[0] for r in weights.select("topic_id").distinct().collect())
        labels = materialize(diverse_labels(weights, ids, config.top_words, config.label_diversity), "topic_labels")
        topics, assigned = renumber(labels.withColumn("method", F.lit(method)), pulled, key)
        remove(vectors)
    vocabulary = label_vocabulary(kept.select(key, F.array_join("tokens", " ").alias("tokens")), "tokens", config.min_label_freq, stopwords)
    topics, assigned = materialize(filter_label_words(topics, vocabulary, config.top_words), "topics"), materialize(assigned, "topic_documents")
    aligned = docs.select(key).join(assigned, key, "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
    shown, surfaces = readable_topics(topics, word_frequencies(kept, "tokens", key, stopwords=stopwords), docs, text, key, lexicon.roots)
    return {"topics": shown, "document_topics": aligned, "word_frequencies": word_frequencies(kept, "tokens", key, stopwords=stopwords, surfaces=surfaces), "quality": quality.evaluate(topics, kept, aligned), "summary": summary(shown)}
