"""Aspect-topic association by pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aspect_name(value: Column, field: Column | None = None) -> Column:
    """A name given as a string or as a record's field: trimmed, blank ones null."""
    name = F.trim(F.coalesce(field, value) if field is not None else value)
    return F.when(name != "", name)


def presence(doc_aspects: DataFrame, doc_topics: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Distinct (doc, topic, aspect) of documents with a topic, with the aspect's first place. aspects: array per document."""
    topics = doc_topics.filter("topic_id != -1").select(key, "topic_id")
    flat = doc_aspects.select(key, F.posexplode("aspects").alias("_pos", "_a")).withColumn("aspect", aspect_name(F.col("_a"))).filter("aspect is not null")
    return flat.join(topics, key).groupBy(key, "topic_id", "aspect").agg(F.min("_pos").alias("_pos"))


def pmi(doc_aspects: DataFrame, doc_topics: DataFrame, min_mentions: int = 3, key: str = "doc_idx") -> DataFrame:
    """aspect, topic_id, pmi, co_occurrence of pairs that occur together, for aspects of at least min_mentions documents.

    PMI is log2(P(a, t) / (P(a) P(t))) over documents with a topic. Counts are aggregated before they meet.
    """
    together = presence(doc_aspects, doc_topics, key)
    pairs = together.groupBy("aspect", "topic_id").agg(F.count("*").alias("co"), F.min(F.struct(key, "_pos")).alias("first"))
    mentions = pairs.groupBy("aspect").agg(F.sum("co").alias("n_aspect"), F.min("first").alias("first")).filter(F.col("n_aspect") >= min_mentions)
    sizes = doc_topics.filter("topic_id != -1").groupBy("topic_id").agg(F.count("*").alias("n_topic"))
    total = sizes.agg(F.sum("n_topic").alias("n"))
    joined = pairs.drop("first").join(mentions, "aspect").join(sizes, "topic_id").crossJoin(F.broadcast(total))  # total: one row
    value = F.log2((F.col("co") / F.col("n")) / ((F.col("n_aspect") / F.col("n")) * (F.col("n_topic") / F.col("n"))))
    return joined.select("aspect", "topic_id", F.round(value, 4).alias("pmi"), F.col("co").alias("co_occurrence"), "first")


def top_associations(pairs: DataFrame, n: int = 20) -> DataFrame:
    """The strongest positive pairs; of equal PMI the aspect that came first, then the lower topic."""
    top = pairs.filter("pmi > 0").orderBy(F.desc("pmi"), "first", "topic_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pmi"), "first", "topic_id"))).drop("first")


def heatmap(doc_aspects: DataFrame, doc_topics: DataFrame, num_topics: int, min_mentions: int = 3, key: str = "doc_idx") -> DataFrame:
    """Every valid aspect by topic_0 .. topic_k-1: 0 where they never meet or the topic is empty."""
    pairs = pmi(doc_aspects, doc_topics, min_mentions, key)
    wide = pairs.groupBy("aspect").pivot("topic_id", list(range(num_topics))).agg(F.first("pmi"))
    return wide.select("aspect", *(F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(f"topic_{k}") for k in range(num_topics)))


def analyze(doc_aspects: DataFrame, doc_topics: DataFrame, num_topics: int, min_mentions: int = 3, key: str = "doc_idx") -> dict[str, DataFrame]:
    """Top associations and the dense matrix. Documents of only one of the two frames raise."""
    odd = doc_aspects.select(key).join(doc_topics.select(key), key, "full_outer").count() - doc_aspects.join(doc_topics.select(key), key).count()
    if odd:
        raise ValueError(f"{odd} documents are in one of the frames only")
    return {"top": top_associations(pmi(doc_aspects, doc_topics, min_mentions, key)), "heatmap": heatmap(doc_aspects, doc_topics, num_topics, min_mentions, key)}
