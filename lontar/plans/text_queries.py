"""Preprocessing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.config import CleanConfig
from lontar.functions import text as X
from lontar.functions.stem import stem_map
from lontar.operators import clean as C
from lontar.plans.common import DOCS, TABLE_LEXICON, TOKENS, case_map, docs, in_list, read, words_sql
from lontar.plans.registry import query

_TAIL = r"(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]+"


def _strip_sql(e: str) -> str:
    for pattern, target in ((f"http[s]?://{_TAIL}", ""), (rf"www\.{_TAIL}", ""), (r"\S+@\S+", ""), (r"@\w+|RT\s+", ""), (r"#(\w+)", r"\1"), (_EMOJI, "")):
        e = f"regexp_replace({e}, '{pattern}', '{target}', 'g')"
    return e


def _squeeze_sql(e: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        e = f"regexp_replace({e}, '{c}{{3,}}', '{c}', 'g')"
    return e


_NOISY = "'RT @user1 see ' || url || ' and www.shop.example/a?b #promo_1 mail me@home.example sooo GOOOD!!! 😀 1000 ' || html"


def _noisy(spark, sf_dir) -> DataFrame:
    text = F.concat(F.lit("RT @user1 see "), "url", F.lit(" and www.shop.example/a?b #promo_1 mail me@home.example sooo GOOOD!!! 😀 1000 "), "html")
    return read(spark, sf_dir, "pages").select("page_id", text.alias("text"))


_LATIN_ONLY = "regexp_replace(lower(t), '[^a-zA-Z0-9\\s]', ' ', 'g')"


@query(f"WITH a AS (SELECT page_id, {_strip_sql(_NOISY)} AS t FROM pages), b AS (SELECT page_id, {_LATIN_ONLY} AS t FROM a), c AS (SELECT page_id, {_squeeze_sql('t')} AS t FROM b) SELECT page_id, array_to_string({words_sql('t')}, ' ') AS processed_text FROM c")
def clean_basic(spark, sf_dir):
    """Links, addresses, mentions, hash signs, emoji, case, characters, repeated letters, spaces."""
    t = F.col("text")
    stripped = X.no_emoji(X.no_hash_signs(X.no_mentions(X.no_emails(X.no_urls(t)))))
    return _noisy(spark, sf_dir).select("page_id", F.array_join(X.tokens(X.squeeze_letters(X.latin_only(F.lower(stripped)))), " ").alias("processed_text"))


@query(f"SELECT page_id, {_strip_sql(_NOISY)} AS stripped FROM pages")
def clean_hashtag_mention(spark, sf_dir):
    """P1-P5 on their own."""
    t = F.col("text")
    return _noisy(spark, sf_dir).select("page_id", X.no_emoji(X.no_hash_signs(X.no_mentions(X.no_emails(X.no_urls(t))))).alias("stripped"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace({_NOISY}, '[^a-zA-Z0-9\\s.,!?]', ' ', 'g'), '\\s+', ' ', 'g')) AS kept FROM pages")
def keep_punctuation(spark, sf_dir):
    """P7 with sentence marks kept, P9."""
    return _noisy(spark, sf_dir).select("page_id", F.trim(X.one_space(X.latin_only(F.col("text"), True))).alias("kept"))


@query(f"WITH d AS (SELECT doc_id, replace(text, 'e', 'eeee') AS t FROM documents) SELECT doc_id, {_squeeze_sql('t')} AS squeezed FROM d")
def squeeze_letters(spark, sf_dir):
    """P8 without roots."""
    return read(spark, sf_dir, "documents").select("doc_id", X.squeeze_letters(F.replace("text", F.lit("e"), F.lit("eeee"))).alias("squeezed"))


_L = TABLE_LEXICON
_TYPO_WORDS = {k: v for k, v in _L.typos.items() if " " not in k}
_DICT = f"""WITH a AS (SELECT doc_id, regexp_replace(lower(text), '\\bto the\\b', 'toward the', 'g') AS t FROM documents),
b AS (SELECT doc_id, list_transform({words_sql('t')}, lambda x: {case_map('x', _TYPO_WORDS)}) AS w FROM a),
c AS (SELECT doc_id, list_transform(w, lambda x: {case_map('x', _L.slang)}) AS w FROM b)
SELECT doc_id, array_to_string({words_sql("array_to_string(w, ' ')")}, ' ') AS normalised FROM c"""


@query(_DICT)
def dict_normalise(spark, sf_dir):
    """Phrases, typos, slang (empty values drop, several words go in)."""
    t = X.replace_phrases(F.lower("text"), _L.typos)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.map_tokens(X.map_tokens(X.tokens(t), _TYPO_WORDS), _L.slang), " ").alias("normalised"))


@query(f"SELECT page_id, array_to_string({words_sql(f'regexp_replace(html, {chr(39)}[0-9]+{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}, ' ') AS no_digits FROM pages")
def digits_removed(spark, sf_dir):
    """P12."""
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(X.tokens(F.regexp_replace("html", "[0-9]+", "")), " ").alias("no_digits"))


@query(f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_tokens, array_to_string({words_sql('text')}, '|') AS joined FROM documents")
def tokenise(spark, sf_dir):
    """One row out for each row in."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(X.tokens(F.col("text")), "|").alias("joined"))


@query(f"SELECT doc_id, array_to_string(list_filter({words_sql('lower(text)')}, lambda x: x NOT IN ({in_list(_L.stopwords - _L.negations)}) AND len(x) >= 3), ' ') AS kept FROM documents")
def stopword_filter(spark, sf_dir):
    """P14 with protected negations, P16; repeats stay."""
    kept = X.without(X.tokens(F.lower("text")), C.stopword_set(CleanConfig(), _L))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.min_length(kept, 3), " ").alias("kept"))


@query(f"WITH {DOCS}, {TOKENS}, k AS (SELECT doc_idx, word, pos, lag(word) OVER (PARTITION BY doc_idx ORDER BY pos) AS b FROM tok) SELECT doc_idx, string_agg(word, ' ' ORDER BY pos) AS collapsed, count(*) AS n FROM k WHERE b IS NULL OR b <> word GROUP BY doc_idx")
def adjacent_dedup(spark, sf_dir):
    """P17."""
    w = X.no_adjacent_repeats(X.tokens(F.col("text")))
    return docs(spark, sf_dir).select("doc_idx", F.array_join(w, " ").alias("collapsed"), F.size(w).cast("long").alias("n"))


@query(f"""WITH {DOCS}, {TOKENS}, f AS (SELECT word FROM tok GROUP BY word HAVING count(*) >= 5),
k AS (SELECT doc_idx, string_agg(word, ' ' ORDER BY pos) AS kept FROM tok WHERE word IN (SELECT word FROM f) GROUP BY doc_idx)
SELECT d.doc_idx, coalesce(k.kept, '') AS kept FROM docs d LEFT JOIN k USING (doc_idx)""")
def rare_token_filter(spark, sf_dir):
    """Over the corpus; documents may be left empty."""
    tokens = docs(spark, sf_dir).select("doc_idx", X.tokens(F.col("text")).alias("tokens"))
    return C.filter_rare_tokens(tokens, "tokens", ["doc_idx"], 5).select("doc_idx", F.array_join("tokens", " ").alias("kept"))


_CONFIG = CleanConfig.for_task("transformer", {"remove_numbers": True})


def clean_ctes(typos: bool = True, slang: bool = True, numbers: bool = False) -> str:
    """CTEs up to `f` (doc_idx, text, lang, processed_text): the chain under the transformer profile; numbers: digits go."""
    phrase = "regexp_replace({}, '\\bto the\\b', 'toward the', 'g')".format
    c = f"regexp_replace({_squeeze_sql('t')}, '\\s+', ' ', 'g')"
    d = f"list_transform({words_sql('t')}, lambda x: {case_map('x', _TYPO_WORDS)})" if typos else words_sql("t")
    e = words_sql(f"array_to_string(list_transform(w, lambda x: {case_map('x', _L.slang)}), ' ')") if slang else "w"
    f = words_sql("regexp_replace(array_to_string(w, ' '), '[0-9]+', '', 'g')") if numbers else "w"
    return f"""c1 AS (SELECT doc_id AS doc_idx, text, lang, {_strip_sql('text')} AS t FROM documents), c2 AS (SELECT doc_idx, text, lang, {_LATIN_ONLY} AS t FROM c1),
c3 AS (SELECT doc_idx, text, lang, {phrase(c) if typos else c} AS t FROM c2), c4 AS (SELECT doc_idx, text, lang, {d} AS w FROM c3), c5 AS (SELECT doc_idx, text, lang, {e} AS w FROM c4),
f AS (SELECT doc_idx, text, lang, array_to_string({f}, ' ') AS processed_text FROM c5)"""


_FULL = f"WITH {clean_ctes(numbers=True)}"


@query(_FULL + " SELECT doc_idx, processed_text FROM f")
def clean_transformer(spark, sf_dir):
    """The whole chain under the transformer profile."""
    return C.clean(docs(spark, sf_dir), _CONFIG, lexicon=_L).select("doc_idx", "processed_text")


@query(_FULL + f""" SELECT doc_idx, CAST(len(text) AS BIGINT) AS original_length, CAST(len(processed_text) AS BIGINT) AS cleaned_length, CAST(len({words_sql('text')}) AS BIGINT) AS original_words,
CAST(len({words_sql('processed_text')}) AS BIGINT) AS cleaned_words, CAST(len(text) - len(processed_text) AS BIGINT) AS removed_chars, CAST(len({words_sql('text')}) - len({words_sql('processed_text')}) AS BIGINT) AS removed_words,
CASE WHEN len(text) > 0 THEN round(len(processed_text) / len(text) * 100, 2) ELSE 0 END AS compression_ratio,
'no_urls,no_emails,no_mentions,no_hash_signs,no_emoji,case_folding,remove_punctuation,squeeze_letters,one_space,fix_typos,normalize_slang,remove_numbers' AS steps FROM f""")
def clean_statistics(spark, sf_dir):
    """P20, P21."""
    made = C.cleaning_report(C.clean(docs(spark, sf_dir), _CONFIG, lexicon=_L), _CONFIG)
    return made.select("doc_idx", "report.*").withColumn("steps", F.array_join("steps_applied", ",")).drop("original_text", "cleaned_text", "steps_applied")


@query()
def clean_bag_of_words(spark, sf_dir):
    """The whole chain under the bag-of-words profile; stemming is no SQL."""
    return C.clean(docs(spark, sf_dir), CleanConfig.for_task("bag_of_words")).select("doc_idx", "processed_text")


_SHOWN_ROOTS = ("bangun", "jalan", "lihat", "dengar", "bantu", "kirim", "latih", "buka")
_SHOWN_AFFIXES = (("di", "kan"), ("", "nya"), ("ter", ""), ("ber", ""), ("ke", "an"), ("", "lah"))
_SHOWN = f"list_extract({list(_SHOWN_ROOTS)}, CAST((doc_idx + pos) % {len(_SHOWN_ROOTS)} AS INT) + 1)"
_SHOWN_ENDS = [f"list_extract({[a[k] for a in _SHOWN_AFFIXES]}, CAST(pos % {len(_SHOWN_AFFIXES)} AS INT) + 1)" for k in (0, 1)]


@query(f"WITH {DOCS}, {TOKENS} SELECT {_SHOWN_ENDS[0]} || {_SHOWN} || {_SHOWN_ENDS[1]} AS word, {_SHOWN} AS stem, count(*) AS n, count(DISTINCT doc_idx) AS n_documents FROM tok GROUP BY ALL")
def affixed_roots(spark, sf_dir):
    """An affixed word for each token, from its document and place; the stemmer must give back the root that SQL knows."""
    flat = docs(spark, sf_dir).select("doc_idx", F.posexplode(X.tokens(F.col("text"))).alias("pos", "_t"))
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    pos = F.col("pos")
    formed = flat.select("doc_idx", F.concat(pick([a for a, _ in _SHOWN_AFFIXES], pos), pick(_SHOWN_ROOTS, F.col("doc_idx") + pos), pick([b for _, b in _SHOWN_AFFIXES], pos)).alias("word"))
    counted = formed.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_idx").alias("n_documents"))
    return counted.join(stem_map(counted, "word").withColumnRenamed("token", "word"), "word").select("word", "stem", "n", "n_documents")
