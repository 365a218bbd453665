"""Aspects: candidate extraction, variant merging, semantic mapping, per-aspect sentiment. All on the flat occurrence
table (doc, aspect, surface, start, end, ...); nesting happens at the output edge only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.config import Lexicon
from lontar.functions.ranks import rank_by_order
from lontar.functions.stem import prefix_class, stem_map
from lontar.functions.text import cosine, let
from lontar.lexicons import CLITICS, COMMON_ASPECTS, CONNECTIVES, INDONESIAN, MERGE_PREFIXES, ROOTS, STOPWORDS
from lontar.operators import sentiment
from lontar.operators.spans import char_context, clause_groups, context_words, decode_bio, find_spans, normalize_aspect, overlap_anti_join
from lontar.tables import materialize


def strip_clitic(word: Column, roots=ROOTS) -> Column:
    """Takes one of nya, ku, mu off a word of at least three more letters that is no root itself."""
    first = F.lit(None).cast("string")
    for c in reversed(CLITICS):
        first = F.when(word.endswith(c) & (F.char_length(word) - len(c) >= 3), F.substring(word, F.lit(1), F.char_length(word) - len(c))).otherwise(first)
    bare = F.coalesce(first, word)
    return F.when(word.isin(*sorted(roots)), word).otherwise(bare) if roots else bare


def strip_clitics(name: Column, roots=ROOTS) -> Column:
    """Clitics written apart at the end go while another word is left, then each word loses its own."""
    words = F.filter(F.split(F.regexp_replace(F.trim(name), r"(?<=\S)(?:\s+(?:nya|ku|mu))+$", ""), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: strip_clitic(w, roots)), " ")


def merge_keys(names: DataFrame, column: str = "aspect", roots=ROOTS) -> DataFrame:
    """For each distinct name: bare (without clitics), stem_key, prefix. Two names merge if the last two are equal."""
    bare = names.select(column).distinct().withColumn("bare", strip_clitics(normalize_aspect(F.col(column)), roots))
    words = bare.select(column, "bare", F.posexplode(F.split("bare", " ")).alias("_i", "token"))
    stems = words.join(stem_map(words, "token", roots), "token")
    keyed = stems.groupBy(column, "bare").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "stem"))), lambda s: s["stem"]), " ").alias("stem_key"))
    squash = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return keyed.withColumn("prefix", prefix_class(squash(F.col("bare")), squash(F.col("stem_key")), MERGE_PREFIXES))


def ranked(entries: DataFrame, by: str) -> DataFrame:
    """Adds rank, 1, 2, ...: most of `by` first, of equal ones the first seen, over ranges of any number of entries."""
    placed = rank_by_order(entries.withColumn("_less", -F.col(by)), [], ["_less", "first"], "_rank")
    return placed.withColumn("rank", (F.col("_rank") + 1).cast("int")).drop("_less", "_rank")


def merge_variants(aspects: DataFrame, roots=ROOTS) -> DataFrame:
    """Merges entries (aspect, count, confidence, variants, first) that differ in inflection only.

    The label is the most frequent form; of equal counts the shorter, then the larger name. Confidence is weighted by
    count; score is count times confidence, or count. rank orders by score, then first occurrence.
    """
    keyed = aspects.join(merge_keys(aspects, "aspect", roots), "aspect")
    order = F.struct("count", (-F.char_length("aspect")).alias("shorter"), "aspect")
    weighed = F.sum(F.when(F.col("confidence").isNotNull(), F.col("confidence") * F.col("count")))
    merged = keyed.groupBy("stem_key", "prefix").agg(
        F.max_by("aspect", order).alias("aspect"), F.sum("count").alias("count"), (weighed / F.sum(F.when(F.col("confidence").isNotNull(), F.col("count")))).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"), F.array_sort(F.collect_list("aspect")).alias("merged_from"), F.min("first").alias("first"),
    )
    scored = merged.withColumn("score", F.coalesce(F.col("count") * F.col("confidence"), F.col("count").cast("double")))
    return ranked(scored.drop("stem_key", "prefix"), "score")


def group_occurrences(occurrences: DataFrame, key: str = "doc_idx") -> DataFrame:
    """One row per aspect: count, mean confidence, variants, first place, score, rank; occurrences as optional nesting."""
    sure = F.avg("confidence") if "confidence" in occurrences.columns else F.lit(None).cast("double")
    grouped = occurrences.groupBy("aspect").agg(F.count("*").alias("count"), sure.alias("confidence"), F.array_sort(F.collect_set("surface")).alias("variants"), F.min(F.struct(key, "start")).alias("first"))
    scored = grouped.withColumn("score", F.coalesce(F.col("count") * F.col("confidence"), F.col("count").cast("double")))
    return ranked(scored, "score")


def document_aspects(docs: DataFrame, occurrences: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Every document with its aspects, each once, in order of the aspects' rank if there is one, else of first place."""
    order = F.min("rank") if "rank" in occurrences.columns else F.min("start")
    once = occurrences.groupBy(key, "aspect").agg(order.alias("_o"))
    lists = once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "aspect"))), lambda s: s["aspect"]).alias("aspects"))
    return docs.select(key).join(lists, key, "left").withColumn("aspects", F.coalesce("aspects", F.array().cast("array<string>")))


def base_forms(doc_aspects: DataFrame, key: str = "doc_idx", roots=ROOTS) -> DataFrame:
    """document_aspects with each name as its stemmed base form, each once."""
    flat = doc_aspects.select(key, F.posexplode("aspects").alias("_i", "aspect"))
    keyed = flat.join(merge_keys(flat, "aspect", roots).select("aspect", "stem_key"), "aspect")
    lists = keyed.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_i", "stem_key"))), lambda s: s["stem_key"])).alias("_b"))
    return doc_aspects.select(key).join(lists, key, "left").select(key, F.coalesce("_b", F.array().cast("array<string>")).alias("aspects"))


def keyword_aspects(docs: DataFrame, key: str = "doc_idx", text: str = "text", keywords=COMMON_ASPECTS, stopwords=STOPWORDS) -> DataFrame:
    """Unigrams and bigrams of a-z words that are keywords and no stopwords, each once a document."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b([a-z]+)\b"), F.lit(1))
    chosen = sorted(set(keywords) - set(stopwords))

    def found(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(F.concat(w, pairs), lambda x: x.isin(*chosen)))

    return docs.select(key, let(words, found).alias("keywords"))


def merge_keyword_and_model(keywords: DataFrame, model: DataFrame, key: str = "doc_idx", least: float = 0.6) -> DataFrame:
    """Keyword rows (doc, aspect), and model spans surer than `least` whose text no keyword has."""
    extra = model.filter(F.col("confidence") > least).withColumn("aspect", F.lower("surface")).select(key, "aspect").join(keywords.select(key, "aspect"), [key, "aspect"], "left_anti")
    return keywords.select(key, "aspect", F.lit("keyword").alias("origin")).unionByName(extra.distinct().withColumn("origin", F.lit("model")))


def extract_model(docs: DataFrame, tags: DataFrame, key: str = "doc_idx", text: str = "text", threshold: float | None = None, stopwords=STOPWORDS) -> DataFrame:
    """Occurrences from a tagger's BIO labels: text of the span, its context; at least three letters and no stopword."""
    spans = decode_bio(tags, key, threshold).join(docs.select(key, F.col(text).alias("_t")), key)
    info = spans.withColumn("surface", F.expr("substring(_t, start + 1, end - start)")).withColumn("aspect", normalize_aspect(F.col("surface")))
    kept = info.filter((F.char_length("aspect") >= 3) & ~F.col("aspect").isin(*sorted(stopwords)))
    return kept.select(key, "aspect", "surface", "start", "end", "confidence", char_context(F.col("_t"), F.col("start"), F.col("end")).alias("context"))


def zero_shot(occurrences: DataFrame, n_docs: int, common=COMMON_ASPECTS, share: float = 0.05, least: int = 2) -> DataFrame:
    """Aspects that occur max(least, share of the documents) times, or are common ones; score is the count."""
    counted = occurrences.groupBy("aspect").agg(F.count("*").alias("count"))
    return counted.filter((F.col("count") >= max(least, share * n_docs)) | F.col("aspect").isin(*sorted(common))).withColumn("score", F.col("count").cast("double"))


def mean_vectors(rows: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Element-wise means of arrays of floats. Groups are pre-aggregated by position before the shuffle."""
    flat = rows.select(*group, F.posexplode(vector).alias("_i", "_v"))
    means = flat.groupBy(*group, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return means.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vector))


def prototypes(templates: DataFrame, background: DataFrame, group: str = "aspect", vector: str = "embedding") -> DataFrame:
    """Mean of a category's template vectors, less the mean of background vectors, of length 1."""
    base = mean_vectors(background.withColumn("_all", F.lit(1)), ["_all"], vector).select(F.col(vector).alias("_b"))  # one row
    centred = mean_vectors(templates, [group], vector).crossJoin(F.broadcast(base)).withColumn(vector, F.zip_with(vector, "_b", lambda a, b: a - b))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))
    return centred.withColumn("_n", norm).select(group, F.when(F.col("_n") > 0, F.transform(vector, lambda v: v / F.col("_n"))).otherwise(F.col(vector)).alias(vector))


def semantic_matches(candidates: DataFrame, prototypes_: DataFrame, keys: list[str], vector: str = "embedding", group: str = "aspect", least: float = 0.15, margin: float = 0.01) -> DataFrame:
    """Candidates with the nearest prototype, if its cosine is high enough and the runner-up is not near.

    Prototypes are one row per category, so they come as one array row; each candidate scores them where it stands, and
    keeps the two best, without a shuffle.
    """
    table = prototypes_.agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col(vector).alias("p"))).alias("_all"))
    scored = candidates.select(*keys, vector).join(F.broadcast(table), how="cross")  # one row
    score = F.transform("_all", lambda c: F.struct(cosine(F.col(vector), c["p"]).alias("s"), c["g"].alias("g")))
    top = scored.select(*keys, F.inline(F.array(F.struct(F.slice(F.sort_array(score, asc=False), 1, 2).alias("_t")))))
    best, second = F.get("_t", 0), F.coalesce(F.get("_t", 1)["s"], F.lit(-1.0))
    return top.filter((best["s"] >= least) & (best["s"] - second >= margin)).select(*keys, best["g"].alias(group), best["s"].alias("similarity"))


def pool_spans(spans: DataFrame, tokens: DataFrame, key: str = "doc_idx", vector: str = "vector") -> DataFrame:
    """spans (key, start, end, ...) with the mean of the token vectors (key, start, end, vector) that overlap them; a span that
    no token overlaps gets the mean of its text. An encoder gives the token vectors."""
    t = tokens.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_z"), F.col(vector).alias("_v"))
    met = spans.join(t, (F.col(key) == F.col("_k")) & (F.col("_a") < F.col("end")) & (F.col("_z") > F.col("start")))
    own = mean_vectors(met.withColumnRenamed("_v", vector), [key, "start", "end"], vector).withColumnRenamed(vector, "_own")
    whole = mean_vectors(tokens.select(key, vector), [key], vector).withColumnRenamed(vector, "_whole")
    return spans.join(own, [key, "start", "end"], "left").join(whole, key, "left").withColumn(vector, F.coalesce("_own", "_whole")).drop("_own", "_whole")


def extract_rule_based(docs: DataFrame, predefined: list[str], key: str = "doc_idx", text: str = "text", candidates: DataFrame | None = None, prototypes_: DataFrame | None = None, roots=ROOTS) -> DataFrame:
    """Occurrences of predefined aspects: by words, then by meaning for candidate spans (with vectors) that no lexical one
    overlaps. match_type tells which."""
    lexical = find_spans(docs, predefined, key, text, True, roots).withColumn("similarity", F.lit(None).cast("double"))
    if candidates is None or prototypes_ is None:
        return lexical
    free = overlap_anti_join(candidates, lexical, key)
    matched = semantic_matches(free, prototypes_, [key, "surface", "start", "end"]).withColumn("match_type", F.lit("semantic"))
    return lexical.unionByName(matched.select(*lexical.columns))


def rule_based_counts(occurrences: DataFrame, key: str = "doc_idx") -> DataFrame:
    grouped = occurrences.groupBy("aspect").agg(
        F.count("*").alias("count"), F.count_if(F.col("match_type") != "semantic").alias("lexical_matches"), F.count_if(F.col("match_type") == "semantic").alias("semantic_matches"), F.min(F.struct(key, "start")).alias("first")
    )
    return ranked(grouped, "count").drop("first")


def clause_sentiments(docs: DataFrame, occurrences: DataFrame, key: str = "doc_idx", text: str = "text", lexicon: Lexicon = INDONESIAN, connectives=CONNECTIVES) -> DataFrame:
    """clause_groups with the sentiment of the clause and of the whole text (_ws, _wc): each is scored once, however many
    occurrences stand in it."""
    judged = sentiment.score_lexicon(docs.select(key, F.col(text).alias("_whole")), "_whole", lexicon).select(key, "_whole", F.col("sentiment").alias("_ws"), F.col("confidence").alias("_wc"))
    return sentiment.score_lexicon(clause_groups(occurrences, judged, key, "_whole", connectives, ("_ws", "_wc")), "_clean", lexicon).drop("scores", "method")


def sentiments_of(clauses: DataFrame, columns: list[str], key: str = "doc_idx", retry_below: float = 0.6, whole_texts: bool = True) -> DataFrame:
    """Occurrences (key and `columns`) of clause_sentiments, with clause, sentiment, confidence."""
    flat = clauses.select(*(c for c in clauses.columns if c != "_members"), F.col("sentiment").alias("_cs"), F.col("confidence").alias("_cc"), F.inline("_members"))
    again = ~F.col("_fits") | (F.col("_cc") < retry_below)
    label, sure = F.when(again, F.col("_ws")).otherwise(F.col("_cs")), F.when(again, F.col("_wc")).otherwise(F.col("_cc"))
    piece = F.when(F.col("_fits"), F.col("_clean"))
    return flat.select(key, *columns, (F.coalesce(piece, "_text") if whole_texts else piece).alias("clause"), label.alias("sentiment"), sure.alias("confidence"))


def aspect_sentiments(docs: DataFrame, occurrences: DataFrame, key: str = "doc_idx", text: str = "text", lexicon: Lexicon = INDONESIAN, retry_below: float = 0.6, connectives=CONNECTIVES, whole_texts: bool = True) -> DataFrame:
    """Occurrences with their clause and its sentiment. Each clause is scored once; where a clause is unsure or is the
    whole text, the whole text's prediction is taken, which is made once for each document. Without whole_texts, a clause that
    is the whole text is null, so that a table of them holds no text once for each occurrence."""
    columns = [c for c in occurrences.columns if c != key]
    made = sentiments_of(clause_sentiments(docs, occurrences, key, text, lexicon, connectives), columns, key, retry_below, whole_texts)
    return made.select(*occurrences.columns, "clause", "sentiment", "confidence")


def aspect_polarity(scored: DataFrame) -> DataFrame:
    """Per aspect: how many, percent of each label, and the label that leads (the first of equals)."""
    n = {k: F.count_if(F.col("sentiment") == k) for k in sentiment.LABELS}
    out = scored.groupBy("aspect").agg(F.count("*").alias("count"), *(F.round(n[k] * 100 / F.count("*"), 2).alias(k) for k in n))
    most = F.greatest(*sentiment.LABELS)
    return out.withColumn("dominant", F.coalesce(*(F.when(F.col(k) == most, k) for k in sentiment.LABELS)))


def statistics(polarity: DataFrame) -> DataFrame:
    """Totals, and the aspects with most mentions, most positive and most negative share; of equals the first by name."""
    lead = lambda c: F.min_by("aspect", F.struct((-F.col(c)).alias("m"), F.col("aspect")))
    return polarity.agg(
        F.count("*").alias("total_aspects"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_mentions"), lead("count").alias("most_mentioned"), lead("positive").alias("most_positive"), lead("negative").alias("most_negative")
    )


def summary(stats: DataFrame) -> DataFrame:
    text = F.when(F.col("total_aspects") == 0, "Tidak ada aspek yang ditemukan.").otherwise(
        F.concat(F.lit("Ditemukan "), F.col("total_aspects").cast("string"), F.lit(" aspek dengan "), F.col("total_mentions").cast("string"), F.lit(" penyebutan. Paling sering: "), F.col("most_mentioned"), F.lit("."))
    )
    return stats.withColumn("summary", text)


def extract_zero_shot(docs: DataFrame, tags: DataFrame | None = None, key: str = "doc_idx", text: str = "text", keywords=COMMON_ASPECTS, stopwords=STOPWORDS, share: float = 0.05, least: int = 2) -> DataFrame:
    """Occurrences without a trained tagger: keywords, each once a document, and spans of an untrained one that is fairly sure;
    names of under three letters or stopwords go, and so do rare ones that are no keyword. An occurrence stands where its name
    is first found, and has no place if it isn't."""
    found = keyword_aspects(docs, key, text, keywords, stopwords).select(key, F.explode("keywords").alias("aspect"))
    merged = found.withColumn("origin", F.lit("keyword"))
    if tags is not None:
        merged = merge_keyword_and_model(found, extract_model(docs, tags, key, text, 0.5, stopwords), key)
    held = merged.filter((F.char_length("aspect") >= 3) & ~F.col("aspect").isin(*sorted(stopwords))).join(docs.select(key, F.col(text).alias("_t")), key)
    at = F.nullif(F.expr("instr(lower(_t), aspect)"), F.lit(0)) - 1
    placed = held.withColumn("start", at).withColumn("end", F.col("start") + F.char_length("aspect")).withColumn("context", context_words(F.col("aspect"), F.col("_t")))
    kept = zero_shot(placed, docs.count(), frozenset(keywords), share, least).select("aspect")
    return placed.join(kept, "aspect").select(key, "aspect", F.col("aspect").alias("surface"), "start", "end", "context", "origin")


def relabel(occurrences: DataFrame, merged: DataFrame) -> DataFrame:
    """Occurrences under the names that merge_variants chose."""
    names = merged.select(F.col("aspect").alias("_to"), F.explode("merged_from").alias("aspect"))
    return occurrences.join(names, "aspect").drop("aspect").withColumnRenamed("_to", "aspect")


def analyze(docs: DataFrame, mode: str = "automatic", predefined: list[str] | None = None, tags: DataFrame | None = None, trained: bool = True, candidates: DataFrame | None = None, prototypes_: DataFrame | None = None, lexicon: Lexicon = INDONESIAN, roots=ROOTS, keywords=COMMON_ASPECTS, stopwords=STOPWORDS, key: str = "doc_idx", text: str = "text") -> dict[str, DataFrame]:
    """Aspects of texts as they are (cleaning would move offsets): aspects, occurrences, sentiments, statistics, summary,
    document_aspects and their base forms.

    mode "rule-based" takes the predefined aspects, by words and, with candidates and prototypes, by meaning; they are the
    user's own, so variants are not merged. Otherwise a trained tagger's labels (tags), or keywords with an untrained one's,
    give occurrences, and names that differ in inflection are one aspect from then on.
    """
    if mode == "rule-based" and predefined:
        occurrences = extract_rule_based(docs, predefined, key, text, candidates, prototypes_, roots)
        found = rule_based_counts(occurrences, key)
    else:
        raw = extract_model(docs, tags, key, text, None, stopwords) if tags is not None and trained else extract_zero_shot(docs, tags, key, text, keywords, stopwords)
        raw = materialize(raw, "aspect_occurrences")
        found = materialize(merge_variants(group_occurrences(raw, key), roots), "aspects")
        occurrences = relabel(raw, found)
    occurrences = materialize(occurrences, "aspect_named")
    placed = occurrences.drop("confidence")
    clauses = materialize(clause_sentiments(docs, placed, key, text, lexicon).drop("_text"), "aspect_scored")  # a clause stands there once
    scored = sentiments_of(clauses, [c for c in placed.columns if c != key], key, whole_texts=False)
    shown = scored.join(docs.select(key, F.col(text).alias("_t")), key).withColumn("clause", F.coalesce("clause", "_t")).drop("_t")
    polarity = aspect_polarity(scored)
    stats = statistics(polarity)
    ranked = occurrences.join(found.select("aspect", "rank"), "aspect")
    lists = document_aspects(docs, ranked, key)
    return {"aspects": found, "occurrences": shown, "sentiments": polarity, "statistics": stats, "summary": summary(stats), "document_aspects": lists, "document_aspects_normalized": base_forms(lists, key, roots)}


def uncertainty(probabilities: DataFrame, keys: list[str], column: str = "probs") -> DataFrame:
    """1 less the mean margin between the two best labels over a document's real tokens."""
    top = F.sort_array(column, asc=False)
    margin = F.get(top, 0) - F.coalesce(F.get(top, 1), F.lit(0.0))
    return probabilities.groupBy(*keys).agg((1 - F.avg(margin)).alias("uncertainty"))


def bio_report(rows: DataFrame, spans: DataFrame, key: str = "doc_idx") -> DataFrame:
    """Quality of a tagging set (key, aspects array) against found spans (key, aspect): totals, unmatched percent, documents
    without any span."""
    wanted = rows.select(key, F.explode_outer(F.array_distinct("aspects")).alias("aspect"))
    hit = spans.select(key, "aspect").distinct().withColumn("_hit", F.lit(1))
    joined = wanted.withColumn("aspect", normalize_aspect(F.col("aspect"))).join(hit, [key, "aspect"], "left")
    per_doc = joined.groupBy(key).agg(F.count("aspect").alias("aspects"), F.sum(F.coalesce("_hit", F.lit(0))).alias("matched"))
    return per_doc.agg(
        F.count("*").alias("samples"), F.sum("aspects").alias("total_aspects"), (F.sum("aspects") - F.sum("matched")).alias("unmatched"),
        F.when(F.sum("aspects") > 0, F.round((F.sum("aspects") - F.sum("matched")) * 100 / F.sum("aspects"), 2)).otherwise(0.0).alias("unmatched_pct"), F.count_if(F.col("matched") == 0).alias("all_o_samples"),
    )
