"""Lexicon sentiment over a stream: the batch expressions as they are, and windowed shares with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.config import CleanConfig, Lexicon
from lontar.lexicons import INDONESIAN
from lontar.operators.clean import clean_tokens
from lontar.operators.sentiment import LABELS, score_lexicon


def stream_sentiment(texts: DataFrame, text: str = "text", lexicon: Lexicon = INDONESIAN, user: dict | None = None) -> DataFrame:
    """Cleans with the transformer profile and scores each row; no state."""
    words = clean_tokens(F.col(text), CleanConfig.for_task("transformer", user), lexicon)
    return score_lexicon(texts.withColumn("processed_text", F.array_join(words, " ")), "processed_text", lexicon)


def stream_distribution(scored: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts and percents of each label in event-time windows; rows later than the watermark are left out."""
    kept = scored.filter("method != 'empty'").withWatermark(at, late)
    by = kept.groupBy(F.window(at, width, slide)) if slide else kept.groupBy(F.window(at, width))
    return by.agg(F.count("*").alias("total"), *(F.round(F.count_if(F.col("sentiment") == k) * 100 / F.count("*"), 2).alias(k) for k in LABELS))
