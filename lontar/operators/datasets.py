"""Building and checking training data: annotation terms, vocabulary, projection, augmentation, diversity, de-leaking."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.functions.ranks import rank_in_group
from lontar.functions.stem import stem_map
from lontar.functions.text import let
from lontar.lexicons import NEGATIVE, POSITIVE, ROOTS, STOPWORDS, TIME_UNITS, VERBAL_PREFIXES
from lontar.operators.patterns import term_spans
from lontar.operators.spans import find_spans, literal_spans, resolve_overlaps
from lontar.tables import materialize

MAX_WORDS, MIN_CHARS = 4, 3
_SPLICED = T.StructType().add("text", "string").add("spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("surface", "string")))
# ---- FIXED VALUES: the names of the reasons, as users read them, in the order of the rules
REASONS = ("terlalu pendek", "mengandung angka", "berkepala kata fungsi", "seluruhnya kata fungsi", "berkepala kata opini", "berkepala satuan waktu", "berkepala verba", "nama diri")
# ---- end of fixed values


def normalize_term(raw: Column) -> Column:
    """A candidate term as a tidy noun phrase: without brackets, edge punctuation, trailing numbers and time units; over
    four words are cut to three; null if under three characters are left."""
    t = F.regexp_replace(F.trim(raw), r"\s*[\(\[].*?[\)\]]\s*", " ")
    t = F.regexp_replace(t, r"\s*[\(\[].*$", " ")
    t = F.regexp_replace(t, r"\s*-\s*", "-")
    t = F.regexp_replace(t, r"""^[ .,;:!?"'`\-–—]+|[ .,;:!?"'`\-–—]+$""", "")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    t = F.regexp_replace(t, r"(?:^|(?<=\S)\s+)[0-9.,%]+(?:\s+[0-9.,%]+)*$", "")
    t = F.regexp_replace(t, r"(?i)(?<=\S)(?:\s+(?:" + "|".join(sorted(TIME_UNITS)) + "))+$", "")
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    cut = let(words, lambda w: F.array_join(F.when(F.size(w) > MAX_WORDS, F.slice(w, 1, 3)).otherwise(w), " "))
    return let(cut, lambda c: F.when(F.char_length(c) >= MIN_CHARS, c))


def term_counts(raw: DataFrame, column: str = "raw", least: int = 1) -> DataFrame:
    """term, n of raw terms that occur at least so often, tidied. Equal raw terms are counted first, in each task too, and tidied
    once; the table is written, so that steps that read it again don't cut texts again."""
    counted = raw.groupBy(column).agg(F.count("*").alias("_n"))
    terms = counted.select(normalize_term(F.col(column)).alias("term"), "_n").filter("term is not null").groupBy("term").agg(F.sum("_n").alias("n"))
    return materialize(terms.filter(F.col("n") >= least), "terms")


def reject_reasons(terms: DataFrame, vocabulary: DataFrame | None = None, column: str = "term", roots=ROOTS, function_words=STOPWORDS, opinion_words=POSITIVE | NEGATIVE) -> DataFrame:
    """Adds `reason` (of REASONS), null where a term may be an aspect: the first that holds of too short, digits, function word
    at the head or throughout, opinion or time word or verb at the head, proper noun (unless all short capitals)."""
    words = F.split(column, " ")
    low = F.transform(words, F.lower)
    head = F.get(low, 0)
    framed = terms.withColumn("_head", head)
    stems = stem_map(framed, "_head", roots).select(F.col("token").alias("_head"), F.col("stem").alias("_stem"))
    joined = framed.join(stems, "_head", "left")
    affixed = F.lit(False)
    for p in VERBAL_PREFIXES:
        affixed = affixed | F.col("_head").startswith(p)
    verbal = affixed & ~F.col("_head").isin(*sorted(opinion_words)) & (F.col("_stem") != F.col("_head")) & (F.char_length("_stem") >= 3)
    alpha = F.filter(words, lambda w: w.rlike(r"^\p{L}"))
    acronym = (F.size(alpha) > 0) & F.forall(alpha, lambda w: (F.upper(w) == w) & (F.char_length(w) <= 6))
    capital = (F.size(alpha) > 0) & F.forall(alpha, lambda w: w.rlike(r"^\p{Lu}"))
    if vocabulary is not None:
        seen = vocabulary.select(F.col("term").alias("_v")).distinct().withColumn("_seen", F.lit(True))
        exploded = joined.select(column, F.explode(F.array_distinct(low)).alias("_v")).distinct().join(seen, "_v").select(column).distinct().withColumn("_known", F.lit(True))
        joined = joined.join(exploded, column, "left")
    known = F.coalesce("_known", F.lit(False)) if vocabulary is not None else F.lit(False)
    short, digit, function_head, function_all, opinion, time, verb, name = REASONS
    reason = (
        F.when(F.char_length(column) < MIN_CHARS, short).when(F.col(column).rlike(r"\p{Nd}"), digit).when(F.col("_head").isin(*sorted(function_words)), function_head)
        .when(F.forall(low, lambda w: w.isin(*sorted(function_words))), function_all).when(F.col("_head").isin(*sorted(opinion_words)), opinion)
        .when(F.col("_head").isin(*sorted(TIME_UNITS)), time).when(verbal, verb).when(capital & ~acronym & ~known, name)
    )
    return joined.select(*terms.columns, reason.alias("reason"))


def harvest_terms(tasks: DataFrame, text: str = "text") -> DataFrame:
    """term, n from annotation tasks (text, spans array<struct<start, end>>): the offsets count, not the stored text."""
    return tasks.select(F.explode("spans").alias("s"), F.col(text).alias("_t")).select(F.expr("substring(_t, s.start + 1, s.end - s.start)").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def lowercase_vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of two characters or more, a-z and hyphens, that occur in lower case somewhere."""
    return docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([a-z][a-z\-]+)\b"), F.lit(1)))).alias("term")).distinct()


def project(docs: DataFrame, terms: list[str], key: str = "doc_idx", text: str = "text") -> DataFrame:
    """Occurrences of terms in any letter case, with any white space between their words and no word character beside them; the
    longest of overlapping ones, of equally long ones the first."""
    return resolve_overlaps(term_spans(docs, terms, key, text), key)


def annotate(docs: DataFrame, lexicon: list[tuple[str, bool]], key: str = "doc_idx", text: str = "text", roots=ROOTS) -> DataFrame:
    """Spans of lexicon terms (term, literal_only), by words and, unless literal_only, by stems; overlaps resolved."""
    literal = [t for t, only in lexicon if only]
    loose = [t for t, only in lexicon if not only]
    found = find_spans(docs, loose, key, text, True, roots).unionByName(literal_spans(docs, literal, key, text).withColumn("match_type", F.lit("literal")))
    return resolve_overlaps(found, key)


def substitution_pool(docs: DataFrame, spans: DataFrame, key: str = "doc_idx", text: str = "text", top: int = 600, function_words=STOPWORDS) -> DataFrame:
    """Replacement words: frequent tokens of at least four letters outside the spans' words."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b([a-z]{4,})\b"), F.lit(1))).alias("term"))
    counted = words.filter(~F.col("term").isin(*sorted(function_words))).groupBy("term").agg(F.count("*").alias("n")).filter("n >= 2")
    aspects = spans.select(F.explode(F.split(F.lower("surface"), " ")).alias("term")).distinct()
    kept = counted.join(aspects, "term", "left_anti").orderBy(F.desc("n"), "term").limit(top)
    return kept.select("term", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).alias("slot"))


def substitute(docs: DataFrame, spans: DataFrame, pool: DataFrame, seed: int = 42, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """Replaces each span (not overlapping) by a pool word picked by hash, and recomputes offsets: key, new_text, new_spans."""
    size = pool.agg(F.max("slot").alias("_m"))
    picked = spans.join(F.broadcast(size), how="cross").withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("start")), F.col("_m") + 1)).join(F.broadcast(pool), "slot")  # one row; at most 600 words
    lists = picked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "term"))).alias("_s"))
    cut = lambda name: F.transform("_s", lambda s: s[name])
    made = docs.join(lists, key).withColumn("_f", _spliced(text, cut("start"), cut("end"), cut("term")))
    return made.select(key, F.col("_f.text").alias("new_text"), F.col("_f.spans").alias("new_spans"))


@F.arrow_udf(_SPLICED)
def _spliced(texts: pa.Array, starts: pa.Array, ends: pa.Array, terms: pa.Array) -> pa.Array:
    """Texts with pieces replaced, each put together once, and where the new pieces stand."""
    new, spans = [], []
    for text, a, b, words in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), terms.to_pylist(), strict=True):
        parts, held, at, size = [], [], 0, 0
        for start, end, word in zip(a, b, words, strict=True):
            size += start - at + len(word)
            parts += [text[at:start], word]
            held.append({"start": size - len(word), "end": size, "surface": word})
            at = end
        new.append("".join([*parts, text[at:]]))
        spans.append(held)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string())]))
    return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(spans, kind)], ["text", "spans"])


def augment(docs: DataFrame, spans: DataFrame, pool: DataFrame, factor: int = 1, negatives: DataFrame | None = None, seed: int = 42, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """A training set: the given documents, `factor` copies with replaced spans of each that has spans, and negatives
    (documents without aspects). key, copy (0: as given), kind (given, augmented, negative), text, spans, and position, a
    reproducible shuffle. No document is lost."""
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("spans"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    out = docs.select(key, text).join(lists, key, "left").select(key, F.lit(0).alias("copy"), F.lit("given").alias("kind"), F.col(text).alias("text"), F.coalesce("spans", empty).alias("spans"))
    for k in range(1, factor + 1):
        made = substitute(docs, spans, pool, seed + k - 1, key, text)
        bare = F.transform("new_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        out = out.unionByName(made.select(key, F.lit(k).alias("copy"), F.lit("augmented").alias("kind"), F.col("new_text").alias("text"), bare.alias("spans")))
    if negatives is not None:
        out = out.unionByName(negatives.select(key, F.lit(0).alias("copy"), F.lit("negative").alias("kind"), F.col(text).alias("text"), empty.alias("spans")))
    hashed = out.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key), F.col("copy"), F.col("kind"))).withColumn("_all", F.lit(1))
    return rank_in_group(hashed, ["_all"], F.col("_h"), [F.col("_h"), F.col(key), F.col("copy"), F.col("kind")], "position").drop("_h", "_all")


def diversity(spans: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """spans, unique, ttr, top10_share; with `outside` (token) also ambiguous: span types that occur outside spans too."""
    types = spans.groupBy(F.lower("surface").alias("type")).agg(F.count("*").alias("n"))
    top = types.orderBy(F.desc("n"), "type").limit(10).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_top"))
    row = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("spans"), F.count("*").alias("unique_types")).crossJoin(F.broadcast(top))
    out = row.select("spans", "unique_types", F.when(F.col("spans") > 0, F.round(F.col("unique_types") / F.col("spans"), 4)).otherwise(0.0).alias("ttr"), F.when(F.col("spans") > 0, F.round(F.col("_top") / F.col("spans"), 4)).otherwise(0.0).alias("top10_share"))
    if outside is None:
        return out
    both = types.join(outside.select(F.lower("token").alias("type")).distinct(), "type", "left_semi").agg(F.count("*").alias("ambiguous"))
    return out.crossJoin(F.broadcast(both))


def deleak(train: DataFrame, *held_out: DataFrame, text: str = "text") -> DataFrame:
    """Training rows whose text no held-out set has."""
    for other in held_out:
        train = train.join(other.select(text).distinct(), text, "left_anti")
    return train


def fidelity(docs: DataFrame, spans: DataFrame, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """matches (whole-word occurrences of each document's own span texts), gold (its spans), ratio."""
    wanted = spans.select(key, "surface").distinct().join(docs.select(key, text), key)
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])\Q"), F.col("surface"), F.lit(r"\E(?![\p{L}\p{N}])"))
    counted = wanted.select(F.regexp_count(text, pattern).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("matches"))
    gold = spans.agg(F.count("*").alias("gold"))
    return counted.crossJoin(F.broadcast(gold)).withColumn("ratio", F.when(F.col("gold") > 0, F.round(F.col("matches") / F.col("gold"), 4)).otherwise(0.0))


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A reproducible order: rank by hash of seed and key."""
    return rank_in_group(df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("_all", F.lit(1)), ["_all"], F.col("_h"), [F.col("_h"), F.col(key)], "position").drop("_h", "_all")
