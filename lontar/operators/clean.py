"""Preprocessing: the cleaning chain, stemming by vocabulary, the corpus-wide rare-token filter, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.config import CleanConfig, Lexicon
from lontar.functions import text as X
from lontar.functions.stem import stem_lists_udf
from lontar.lexicons import INDONESIAN


def stopword_set(config: CleanConfig, lexicon: Lexicon = INDONESIAN) -> frozenset[str]:
    chosen = lexicon.stopwords | frozenset(config.custom_stopwords)
    return chosen - lexicon.negations if config.protect_negation else chosen


def clean_tokens(text: Column, config: CleanConfig, lexicon: Lexicon = INDONESIAN, before_stemming: bool = False) -> Column:
    """Tokens after every step but stemming; null and empty give none. before_stemming stops after the stopwords."""
    t = F.coalesce(text, F.lit(""))
    t = X.no_emoji(X.no_hash_signs(X.no_mentions(X.no_emails(X.no_urls(t)))))
    if config.case_folding:
        t = F.lower(t)
    t = X.squeeze_letters(X.latin_only(t, not config.remove_punctuation), lexicon.roots)
    t = X.one_space(t)
    if config.fix_typos:
        t = F.array_join(X.map_tokens(X.tokens(X.replace_phrases(t, lexicon.typos)), {k: v for k, v in lexicon.typos.items() if " " not in k}), " ")
    words = X.tokens(t)
    if config.normalize_slang:
        words = X.map_tokens(words, lexicon.slang)
    if config.remove_numbers:
        words = X.tokens(F.regexp_replace(F.array_join(words, " "), r"[0-9]+", ""))
    if config.remove_stopwords:
        words = X.without(words, stopword_set(config, lexicon))
    return words if before_stemming else finish_tokens(words, config)


def finish_tokens(words: Column, config: CleanConfig) -> Column:
    words = X.min_length(words, config.min_token_length)
    return X.no_adjacent_repeats(words) if config.collapse_repeated_words else words


def stem_tokens(df: DataFrame, words: str, roots) -> DataFrame:
    """Replaces an array of tokens by their stems, row by row, without a shuffle; null ones and empty stems go. inline() keeps
    the stemmer out of later steps' lambdas, where it cannot run."""
    stemmed = df.select("*", F.inline(F.array(F.struct(stem_lists_udf(roots)(F.col(words)).alias("_stems")))))
    return stemmed.withColumn(words, F.filter("_stems", lambda t: t.isNotNull() & (t != ""))).drop("_stems")


def clean(df: DataFrame, config: CleanConfig | None, text: str = "text", keys: tuple[str, ...] = ("doc_idx",), lexicon: Lexicon = INDONESIAN) -> DataFrame:
    """Adds `processed_text`. As many rows as before."""
    if config is None:
        return df.withColumn("processed_text", F.col(text))
    if not config.stemming:
        return df.withColumn("processed_text", F.array_join(clean_tokens(F.col(text), config, lexicon), " "))
    words = df.withColumn("_words", clean_tokens(F.col(text), config, lexicon, before_stemming=True))
    stemmed = stem_tokens(words, "_words", lexicon.roots)
    return stemmed.withColumn("processed_text", F.array_join(finish_tokens(F.col("_words"), config), " ")).drop("_words")


def filter_rare_tokens(df: DataFrame, words: str, keys: list[str], min_freq: int = 2) -> DataFrame:
    """Drops tokens that the corpus has fewer than min_freq times; rows may be left with none. 1 or less changes nothing."""
    if min_freq <= 1:
        return df
    flat = df.select(*keys, F.posexplode(words).alias("_pos", "token"))
    kept = flat.groupBy("token").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_freq).select("token")
    held = flat.join(kept, "token", "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "token"))).alias("_held"))
    back = df.join(held, keys, "left")
    return back.withColumn(words, F.coalesce(F.transform("_held", lambda s: s["token"]), F.array().cast("array<string>"))).drop("_held")


def statistics(original: Column, cleaned: Column) -> list[Column]:
    before, after = F.coalesce(original, F.lit("")), F.coalesce(cleaned, F.lit(""))
    n = lambda t: F.size(X.tokens(t)).cast("long")
    length = lambda t: F.char_length(t).cast("long")
    return [
        length(before).alias("original_length"), length(after).alias("cleaned_length"), n(before).alias("original_words"), n(after).alias("cleaned_words"),
        (length(before) - length(after)).alias("removed_chars"), (n(before) - n(after)).alias("removed_words"),
        F.when(length(before) > 0, F.round(length(after) / length(before) * 100, 2)).otherwise(F.lit(0.0)).alias("compression_ratio"),
    ]


def applied_steps(config: CleanConfig) -> list[str]:
    """Names of the steps a plan holds, in order."""
    optional = [
        ("case_folding", config.case_folding), ("remove_punctuation", config.remove_punctuation), ("squeeze_letters", True), ("one_space", True),
        ("fix_typos", config.fix_typos), ("normalize_slang", config.normalize_slang), ("remove_numbers", config.remove_numbers),
        ("remove_stopwords", config.remove_stopwords), ("stemming", config.stemming), ("min_token_length", config.min_token_length > 1),
        ("collapse_repeated_words", config.collapse_repeated_words),
    ]
    return ["no_urls", "no_emails", "no_mentions", "no_hash_signs", "no_emoji", *(name for name, on in optional if on)]


def cleaning_report(df: DataFrame, config: CleanConfig, original: str = "text", cleaned: str = "processed_text") -> DataFrame:
    steps = F.array(*map(F.lit, applied_steps(config)))
    return df.withColumn("report", F.struct(*statistics(F.col(original), F.col(cleaned)), F.col(original).alias("original_text"), F.col(cleaned).alias("cleaned_text"), steps.alias("steps_applied")))

