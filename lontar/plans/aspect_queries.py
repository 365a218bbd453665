"""Aspect, span and training-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.operators import aspects as A
from lontar.operators import datasets as D
from lontar.operators import evaluate as E
from lontar.operators import spans as P
from lontar.operators.sentiment import LABELS
from lontar.plans.common import ASPECTS, DOCS, LATIN, TABLE_LEXICON, TOKENS, docs, in_list, latin_sql, read, words_sql
from lontar.plans.registry import query
from lontar.plans.sentiment_queries import predictions_sql

_NAMES = "(VALUES " + ", ".join(f"('{a}')" for a in ASPECTS) + ")"
#: occ: literal spans, by trying each place where an aspect's text stands.
_OCC = f"""d AS (SELECT doc_id AS doc_idx, text, lower(text) AS l FROM documents),
pos AS (SELECT doc_idx, text, l, aspect, unnest(list_filter(generate_series(1, len(l) - len(aspect) + 1), lambda i: substr(l, i, len(aspect)) = aspect)) AS i FROM d, {_NAMES} AS n(aspect) WHERE contains(l, aspect)),
occ AS (SELECT doc_idx, aspect, CAST(i - 1 AS BIGINT) AS start, CAST(i - 1 + len(aspect) AS BIGINT) AS "end", substr(text, i, len(aspect)) AS surface, text FROM pos
    WHERE NOT (i > 1 AND regexp_matches(substr(l, i - 1, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(l, i + len(aspect), 1), '[\\p{{L}}\\p{{N}}]'))"""


def _occurrences(spark, sf_dir) -> DataFrame:
    return P.literal_spans(docs(spark, sf_dir), ASPECTS)


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query(f'WITH {_OCC} SELECT doc_idx, aspect, start, "end", surface FROM occ')
def literal_spans(spark, sf_dir):
    """Whole words in any case, overlapping ones too."""
    return _long(_occurrences(spark, sf_dir), "start", "end")


@query(f'WITH {_OCC} SELECT doc_idx, aspect, start, "end", substr(text, CAST(greatest(0, start - 30) AS BIGINT) + 1, CAST(least(len(text), "end" + 30) - greatest(0, start - 30) AS BIGINT)) AS context FROM occ')
def char_context(spark, sf_dir):
    """30 characters on either side."""
    held = _occurrences(spark, sf_dir).join(docs(spark, sf_dir).select("doc_idx", "text"), "doc_idx")
    return _long(held.select("doc_idx", "aspect", "start", "end", P.char_context(F.col("text"), F.col("start"), F.col("end")).alias("context")), "start", "end")


@query(f"WITH {_OCC}, f AS (SELECT doc_idx, aspect, min(start) AS s FROM occ GROUP BY doc_idx, aspect), l AS (SELECT doc_idx, string_agg(aspect, '|' ORDER BY s, aspect) AS a FROM f GROUP BY doc_idx) SELECT d.doc_idx, coalesce(l.a, '') AS aspects FROM d LEFT JOIN l USING (doc_idx)")
def document_aspects(spark, sf_dir):
    """Every document, each aspect once."""
    return A.document_aspects(docs(spark, sf_dir), _occurrences(spark, sf_dir)).select("doc_idx", F.array_join("aspects", "|").alias("aspects"))


@query(f"WITH {_OCC} SELECT aspect, count(*) AS count, count(DISTINCT surface) AS n_variants, CAST(count(*) AS DOUBLE) AS score FROM occ GROUP BY aspect")
def aspect_groups(spark, sf_dir):
    """Entries from occurrences."""
    return A.group_occurrences(_occurrences(spark, sf_dir)).select("aspect", "count", F.size("variants").cast("long").alias("n_variants"), "score")


@query(f"WITH {_OCC} SELECT aspect, count(*) AS count, CAST(count(*) AS DOUBLE) AS score FROM occ GROUP BY aspect HAVING count(*) >= greatest(2, 0.05 * (SELECT count(*) FROM documents)) OR aspect = 'heit'")
def zero_shot_aspects(spark, sf_dir):
    """A19's count rule."""
    d = docs(spark, sf_dir)
    return A.zero_shot(_occurrences(spark, sf_dir), d.count(), frozenset({"heit"}))


_KEYWORDS = ("the", "of the", "and", "thin", "de la", "der", "in the")


@query(f"""WITH w AS (SELECT doc_id AS doc_idx, {latin_sql('lower(text)')} AS w FROM documents),
g AS (SELECT doc_idx, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS k FROM w)
SELECT doc_idx, k AS keyword FROM g WHERE k IN ({in_list(_KEYWORDS)}) GROUP BY doc_idx, k""")
def keyword_aspects(spark, sf_dir):
    """Unigrams and bigrams, each once a document."""
    return A.keyword_aspects(docs(spark, sf_dir), keywords=frozenset(_KEYWORDS), stopwords=frozenset()).select("doc_idx", F.explode("keywords").alias("keyword"))


@query(f"""WITH {_OCC}, w AS (SELECT doc_id AS doc_idx, {latin_sql('lower(text)')} AS w FROM documents),
k AS (SELECT DISTINCT doc_idx, k AS aspect FROM (SELECT doc_idx, unnest(w) AS k FROM w) WHERE k IN ('the', 'and')),
m AS (SELECT DISTINCT doc_idx, lower(surface) AS aspect FROM occ WHERE (start % 10) / 10.0 > 0.6)
SELECT doc_idx, aspect, 'keyword' AS origin FROM k UNION ALL SELECT doc_idx, aspect, 'model' AS origin FROM m ANTI JOIN k USING (doc_idx, aspect)""")
def keyword_model_merge(spark, sf_dir):
    """Model spans that are sure and new."""
    keywords = A.keyword_aspects(docs(spark, sf_dir), keywords=frozenset({"the", "and"}), stopwords=frozenset()).select("doc_idx", F.explode("keywords").alias("aspect"))
    return A.merge_keyword_and_model(keywords, _occurrences(spark, sf_dir).withColumn("confidence", F.col("start") % 10 / 10.0))


#: Labels made by rule from word places: doc_idx, pos, start, end, label, conf.
_TAGS = f"""{DOCS}, {TOKENS}, tags AS (SELECT doc_idx, pos, pos * 10 + 1 AS start, pos * 10 + 6 AS "end",
CASE WHEN (doc_idx + pos * pos) % 7 IN (0, 3) THEN 1 WHEN (doc_idx + pos * 3) % 5 < 2 THEN 2 ELSE 0 END AS label, ((doc_idx * 31 + pos * 17) % 100) / 100.0::DOUBLE AS conf FROM tok)"""


def _tags(spark, sf_dir) -> DataFrame:
    from lontar.functions.text import tokens

    flat = docs(spark, sf_dir).select("doc_idx", F.posexplode(tokens(F.col("text"))).alias("pos", "w"))
    label = F.when(((F.col("doc_idx") + F.col("pos") * F.col("pos")) % 7).isin(0, 3), 1).when((F.col("doc_idx") + F.col("pos") * 3) % 5 < 2, 2).otherwise(0)
    return flat.select("doc_idx", "pos", (F.col("pos") * 10 + 1).alias("start"), (F.col("pos") * 10 + 6).alias("end"), label.alias("label"), ((F.col("doc_idx") * 31 + F.col("pos") * 17) % 100 / 100.0).alias("conf"))


def _islands(where: str, having: str) -> str:
    return f"""WITH {_TAGS}, l AS (SELECT * REPLACE ({where} AS label) FROM tags), i AS (SELECT *, sum(CASE WHEN label <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_idx ORDER BY pos) AS g FROM l)
SELECT doc_idx, min(pos) AS first_pos, max(pos) AS last_pos, min(start) AS start, max("end") AS "end", round(avg(conf), 6) AS confidence FROM i WHERE label <> 0 GROUP BY doc_idx, g HAVING arg_min(label, pos) = 1{having}"""


@query(_islands("label", ""))
def bio_decode(spark, sf_dir):
    """An I without an open span is nothing."""
    return _long(P.decode_bio(_tags(spark, sf_dir)), "first_pos", "last_pos", "start", "end").withColumn("confidence", F.round("confidence", 6))


@query(_islands("CASE WHEN conf < 0.4 THEN 0 ELSE label END", " AND avg(conf) >= 0.4"))
def bio_decode_threshold(spark, sf_dir):
    """A21."""
    return _long(P.decode_bio(_tags(spark, sf_dir), threshold=0.4), "first_pos", "last_pos", "start", "end").withColumn("confidence", F.round("confidence", 6))


_GOLD = 'gold AS (SELECT DISTINCT doc_idx, start, "end" FROM tags WHERE label = 1)'
_PRED = 'pred AS (SELECT DISTINCT doc_idx, start, "end" FROM tags WHERE conf < 0.3)'


@query(f"""WITH {_TAGS}, {_GOLD}, {_PRED}, c AS (SELECT count(*) FILTER (g.start IS NOT NULL AND p.start IS NOT NULL) AS tp, count(*) FILTER (g.start IS NULL) AS fp, count(*) FILTER (p.start IS NULL) AS fn
FROM gold g FULL OUTER JOIN pred p ON g.doc_idx = p.doc_idx AND g.start = p.start AND g."end" = p."end")
SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM c""")
def span_prf(spark, sf_dir):
    """E19."""
    tags = _tags(spark, sf_dir)
    return E.span_prf(tags.filter("label = 1"), tags.filter("conf < 0.3"))


@query(f'WITH {_TAGS}, c AS (SELECT doc_idx, start, "end" + 12 AS "end" FROM tags WHERE conf < 0.2), t AS (SELECT doc_idx, start, "end" FROM tags WHERE label = 1 AND conf > 0.7) SELECT doc_idx, start, "end" FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_idx = c.doc_idx AND c.start < t."end" AND c."end" > t.start)')
def overlap_anti_join(spark, sf_dir):
    """Candidates that no taken span overlaps."""
    tags = _tags(spark, sf_dir)
    candidates = tags.filter("conf < 0.2").select("doc_idx", "start", (F.col("end") + 12).alias("end"))
    return _long(P.overlap_anti_join(candidates, tags.filter("label = 1 AND conf > 0.7")), "start", "end")


@query(f"""WITH {_TAGS}, s AS (SELECT doc_idx, start AS a, "end" + 10 AS z FROM tags WHERE label = 1 AND conf < 0.5), h AS (SELECT t.doc_idx, t.pos, min(struct_pack(a := s.a, z := s.z)) AS s FROM tags t JOIN s ON t.doc_idx = s.doc_idx AND t.start >= s.a AND t."end" <= s.z GROUP BY t.doc_idx, t.pos),
j AS (SELECT t.doc_idx, t.pos, h.s FROM tags t LEFT JOIN h USING (doc_idx, pos)) SELECT doc_idx, pos, CASE WHEN s IS NULL THEN 0 WHEN pos = min(pos) OVER (PARTITION BY doc_idx, s) THEN 1 ELSE 2 END AS label FROM j""")
def bio_tags(spark, sf_dir):
    """Tokens by the spans that hold them."""
    tags = _tags(spark, sf_dir)
    spans = tags.filter("label = 1 AND conf < 0.5").select("doc_idx", "start", (F.col("end") + 10).alias("end"))
    return P.bio_tags(tags.select("doc_idx", "pos", "start", "end", F.lit(False).alias("special")), spans).select("doc_idx", F.col("pos").cast("long").alias("pos"), "label")


@query(f"""WITH {_OCC}, a AS (SELECT DISTINCT doc_idx, aspect FROM occ), w AS (SELECT doc_idx, aspect FROM d, (VALUES ('the'), ('und'), ('zzz')) AS n(aspect)),
p AS (SELECT w.doc_idx, count(*) AS n, count(a.aspect) AS m FROM w LEFT JOIN a USING (doc_idx, aspect) GROUP BY w.doc_idx)
SELECT count(*) AS samples, CAST(sum(n) AS BIGINT) AS total_aspects, CAST(sum(n) - sum(m) AS BIGINT) AS unmatched, round((sum(n) - sum(m)) * 100 / sum(n), 2) AS unmatched_pct, count(*) FILTER (m = 0) AS all_o_samples FROM p""")
def bio_report(spark, sf_dir):
    """A33."""
    rows = docs(spark, sf_dir).select("doc_idx", F.array(F.lit("the"), F.lit("und"), F.lit("zzz")).alias("aspects"))
    return A.bio_report(rows, _occurrences(spark, sf_dir))


@query(f"""WITH RECURSIVE {DOCS}, {TOKENS}, t AS (SELECT doc_idx, pos, word, CASE WHEN (doc_idx + pos * pos) % 7 IN (0, 3) THEN 'B' WHEN (doc_idx + pos) % 5 < 2 THEN 'I' ELSE 'O' END AS label,
coalesce(sum(len(word) + 1) OVER (PARTITION BY doc_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM tok),
g AS (SELECT *, sum(CASE WHEN label = 'B' OR (label = 'I' AND b = 'O') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_idx ORDER BY pos) AS i FROM (SELECT *, coalesce(lag(label) OVER (PARTITION BY doc_idx ORDER BY pos), 'O') AS b FROM t))
SELECT doc_idx, CAST(min(s) AS BIGINT) AS start, CAST(max(s + len(word)) AS BIGINT) AS "end", string_agg(word, ' ' ORDER BY pos) AS surface FROM g WHERE label <> 'O' GROUP BY doc_idx, i""")
def iob_spans(spark, sf_dir):
    """Character spans of labelled tokens; an orphan I starts one."""
    from lontar.functions.text import tokens

    flat = docs(spark, sf_dir).select("doc_idx", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    label = F.when(((F.col("doc_idx") + F.col("pos") * F.col("pos")) % 7).isin(0, 3), "B").when((F.col("doc_idx") + F.col("pos")) % 5 < 2, "I").otherwise("O")
    return _long(P.iob_spans(flat.withColumn("label", label)), "start", "end")


#: win: the spans of occ that stay when longest come first, then earliest, then by name.
_GREEDY = """o AS (SELECT doc_idx, aspect, start, "end", row_number() OVER (PARTITION BY doc_idx ORDER BY start - "end", start, "end", aspect) AS i FROM occ),
r AS (SELECT doc_idx, i, [struct_pack(a := start, z := "end")] AS held, true AS stays FROM o WHERE i = 1
UNION ALL SELECT o.doc_idx, o.i, CASE WHEN len(list_filter(r.held, lambda k: k.a < o."end" AND o.start < k.z)) = 0 THEN list_append(r.held, struct_pack(a := o.start, z := o."end")) ELSE r.held END, len(list_filter(r.held, lambda k: k.a < o."end" AND o.start < k.z)) = 0
    FROM r JOIN o ON o.doc_idx = r.doc_idx AND o.i = r.i + 1),
win AS (SELECT o.* FROM o JOIN r USING (doc_idx, i) WHERE r.stays)"""


@query(f'WITH RECURSIVE {_OCC}, {_GREEDY} SELECT doc_idx, aspect, start, "end" FROM win')
def resolve_overlaps(spark, sf_dir):
    """Greedy, longest first."""
    return _long(P.resolve_overlaps(_occurrences(spark, sf_dir)), "start", "end")


@query(f"WITH RECURSIVE {_OCC}, {_GREEDY} SELECT doc_idx, count(*) AS n, min(start) AS first_start FROM win WHERE aspect IN ('the', 'of the', 'reason') GROUP BY doc_idx")
def gold_spans(spark, sf_dir):
    """A gold set with the annotators' offsets, read back from its own structure."""
    from lontar.sources.writers import to_gold

    made = to_gold(docs(spark, sf_dir), P.resolve_overlaps(_occurrences(spark, sf_dir)).filter("aspect IN ('the', 'of the', 'reason')"))
    flat = made.select("doc_idx", F.explode("spans").alias("s")).filter("char_length(s.surface) = s.end - s.start")
    return flat.groupBy("doc_idx").agg(F.count("*").alias("n"), F.min("s.start").cast("long").alias("first_start"))


@query(f"""WITH {_OCC}, w AS (SELECT doc_id AS doc_idx, {words_sql('lower(text)')} AS w, lower(text) AS l FROM documents),
f AS (SELECT doc_idx, l, w, aspect, list_position(w, aspect) AS p FROM w, (VALUES ('the'), ('reason'), ('und'), ('zzz')) AS n(aspect))
SELECT doc_idx, aspect, CASE WHEN p IS NULL OR p = 0 THEN substr(l, 1, 50) ELSE array_to_string(w[greatest(1, p - 3):least(len(w), p + 3)], ' ') END AS context FROM f""")
def word_context(spark, sf_dir):
    """Three words on either side of the first occurrence."""
    names = F.explode(F.array(*map(F.lit, ("the", "reason", "und", "zzz"))))
    return docs(spark, sf_dir).select("doc_idx", "text", names.alias("aspect")).select("doc_idx", "aspect", P.context_words(F.col("aspect"), F.col("text")).alias("context"))


@query()
def lexicon_annotation(spark, sf_dir):
    """By words and by stems."""
    return D.annotate(docs(spark, sf_dir), [("the", True), ("reason", False), ("heit", False)], roots=frozenset({"reason", "heit"}))


_CONNECTIVES = ("and", "der", "que", "mais")
#: cl: occ with its clause. Bounds are the ends of the text, places after sentence marks, and whole connectives.
_CLAUSES = f"""l0 AS (SELECT doc_id AS doc_idx, text, lower(text) AS l FROM documents),
mk AS (SELECT doc_idx, unnest(list_filter(generate_series(1, len(text)), lambda i: contains('.!?;' || chr(10), substr(text, i, 1)))) AS b FROM l0),
cx AS (SELECT doc_idx, l, c, unnest(list_filter(generate_series(1, len(l)), lambda i: substr(l, i, len(c)) = c)) AS i FROM l0, (VALUES {", ".join(f"('{c}')" for c in _CONNECTIVES)}) AS n(c) WHERE contains(l, c)),
bd AS (SELECT doc_idx, CAST(0 AS BIGINT) AS b FROM l0 UNION SELECT doc_idx, len(text) FROM l0 UNION SELECT doc_idx, b FROM mk
    UNION SELECT doc_idx, i - 1 FROM cx WHERE NOT (i > 1 AND regexp_matches(substr(l, i - 1, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(l, i + len(c), 1), '[\\p{{L}}\\p{{N}}]')),
lo AS (SELECT o.doc_idx, o.aspect, o.start, o."end", o.text, max(b) AS low FROM occ o JOIN bd ON bd.doc_idx = o.doc_idx AND b <= start GROUP BY ALL),
hi AS (SELECT lo.*, high FROM lo JOIN (SELECT o.doc_idx, o.aspect, o.start, min(b) AS high FROM occ o JOIN bd ON bd.doc_idx = o.doc_idx AND b >= "end" GROUP BY ALL) USING (doc_idx, aspect, start)),
pc AS (SELECT *, regexp_replace(regexp_replace(substr(text, CAST(low AS BIGINT) + 1, CAST(high - low AS BIGINT)), '^[ ,.;!?\\n]+|[ ,.;!?\\n]+$', '', 'g'), '^(?i:{"|".join(_CONNECTIVES)}) [ ,]*', '') AS piece FROM hi),
cl AS (SELECT doc_idx, aspect, start, "end", text, CASE WHEN len({words_sql('piece')}) <= len({words_sql('substr(text, CAST(start AS BIGINT) + 1, CAST("end" - start AS BIGINT))')}) THEN text ELSE piece END AS clause FROM pc)"""


def _scored(spark, sf_dir) -> DataFrame:
    return A.aspect_sentiments(docs(spark, sf_dir), _occurrences(spark, sf_dir), lexicon=TABLE_LEXICON, connectives=_CONNECTIVES)


@query(f'WITH {_OCC}, {_CLAUSES} SELECT doc_idx, aspect, start, "end", clause FROM cl')
def clause_of_aspect(spark, sf_dir):
    """A26."""
    made = P.add_clauses(_occurrences(spark, sf_dir), docs(spark, sf_dir), connectives=_CONNECTIVES)
    return _long(made.select("doc_idx", "aspect", "start", "end", "clause"), "start", "end")


#: sc: cl with the sentiment of its clause, or of the whole text where that is unsure.
_SCORED = f"""q AS (SELECT row_number() OVER (ORDER BY doc_idx, aspect, start) AS q, * FROM cl), qc AS (SELECT q AS doc_idx, clause AS text, '' AS lang FROM q),
pq AS (WITH {predictions_sql('qc')} SELECT * FROM pred), pw AS (WITH {DOCS}, {predictions_sql()} SELECT * FROM pred),
sc AS (SELECT q.doc_idx, aspect, CASE WHEN pq.confidence < 0.6 AND clause <> q.text THEN pw.sentiment ELSE pq.sentiment END AS sentiment FROM q JOIN pq ON pq.doc_idx = q.q JOIN pw ON pw.doc_idx = q.doc_idx),
po AS (SELECT aspect, count(*) AS count, {", ".join(f"round(count(*) FILTER (sentiment = '{k}') * 100 / count(*), 2) AS {k}" for k in LABELS)} FROM sc GROUP BY aspect)"""


@query(f"WITH {_OCC}, {_CLAUSES}, {_SCORED} SELECT *, CASE greatest(positive, neutral, negative) WHEN positive THEN 'positive' WHEN neutral THEN 'neutral' ELSE 'negative' END AS dominant FROM po")
def aspect_polarity(spark, sf_dir):
    """Clauses, retry on the whole text, shares by aspect."""
    return A.aspect_polarity(_scored(spark, sf_dir))


@query(f"""WITH {_OCC}, {_CLAUSES}, {_SCORED}, st AS (SELECT count(*) AS total_aspects, CAST(sum(count) AS BIGINT) AS total_mentions, arg_min(aspect, (-count, aspect)) AS most_mentioned, arg_min(aspect, (-positive, aspect)) AS most_positive, arg_min(aspect, (-negative, aspect)) AS most_negative FROM po)
SELECT *, 'Ditemukan ' || total_aspects || ' aspek dengan ' || total_mentions || ' penyebutan. Paling sering: ' || most_mentioned || '.' AS summary FROM st""")
def aspect_statistics(spark, sf_dir):
    """A29, A30."""
    return A.summary(A.statistics(A.aspect_polarity(_scored(spark, sf_dir))))


@query()
def aspect_merge(spark, sf_dir):
    """Stems, clitics, prefixes."""
    return A.merge_variants(A.group_occurrences(_occurrences(spark, sf_dir)).withColumn("confidence", F.lit(0.5)))


@query(f"WITH {_OCC}, f AS (SELECT doc_idx, aspect, min(start) AS s FROM occ GROUP BY doc_idx, aspect), l AS (SELECT doc_idx, string_agg(aspect, '|' ORDER BY s, aspect) AS a FROM f GROUP BY doc_idx) SELECT d.doc_idx, coalesce(l.a, '') AS aspects FROM d LEFT JOIN l USING (doc_idx)")
def base_form_lists(spark, sf_dir):
    """A10, without roots: the base form of these names is the name."""
    lists = A.document_aspects(docs(spark, sf_dir), _occurrences(spark, sf_dir))
    return A.base_forms(lists, roots=frozenset()).select("doc_idx", F.array_join("aspects", "|").alias("aspects"))


@query(f"""WITH {DOCS}, {LATIN}, b AS (SELECT doc_idx, word FROM lat WHERE len(word) >= 6 AND NOT regexp_matches(word, '(nya|ku|mu)$')),
c AS (SELECT word, word || CASE doc_idx % 4 WHEN 0 THEN '' WHEN 1 THEN 'nya' WHEN 2 THEN ' nya' ELSE 'ku' END AS form, count(*) AS n FROM b GROUP BY ALL)
SELECT max_by(form, struct_pack(n := n, s := -len(form), f := form)) AS aspect, count(*) AS n_forms, CAST(sum(n) AS BIGINT) AS count FROM c GROUP BY word""")
def clitic_merge(spark, sf_dir):
    """The documents' longer words, given clitics by document, join the name that they come from."""
    d = docs(spark, sf_dir)
    words = d.select("doc_idx", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-z]{6,})\b"), F.lit(1))).alias("word")).filter("word not rlike '(nya|ku|mu)$'")
    clitic = F.element_at(F.array(F.lit(""), F.lit("nya"), F.lit(" nya"), F.lit("ku")), (F.col("doc_idx") % 4 + 1).cast("int"))
    names = words.groupBy(F.concat("word", clitic).alias("aspect")).agg(F.count("*").alias("count"), F.lit(0.5).alias("confidence"), F.min("doc_idx").alias("first")).withColumn("variants", F.array("aspect"))
    return A.merge_variants(names, frozenset()).select("aspect", F.size("merged_from").cast("long").alias("n_forms"), "count")


@query(f"""WITH {_OCC}, f AS (SELECT doc_idx, aspect FROM occ WHERE aspect IN ('the', 'und', 'reason'))
SELECT aspect, count(*) AS count, count(*) AS lexical_matches, CAST(0 AS BIGINT) AS semantic_matches FROM f GROUP BY aspect""")
def rule_based_analysis(spark, sf_dir):
    """A1 in rule-based mode: the user's own aspects, without merging."""
    found = A.analyze(docs(spark, sf_dir), "rule-based", ["the", "und", "reason"], lexicon=TABLE_LEXICON, roots=frozenset())
    return found["aspects"].select("aspect", "count", "lexical_matches", "semantic_matches")


@query(f"""WITH w AS (SELECT doc_id AS doc_idx, lower(text) AS l, {latin_sql('lower(text)')} AS w FROM documents),
k AS (SELECT DISTINCT doc_idx, k AS aspect FROM (SELECT doc_idx, unnest(w) AS k FROM w) WHERE k IN ('the', 'and', 'thin')),
n AS (SELECT aspect, count(*) AS count FROM k GROUP BY aspect) SELECT aspect, count, count::DOUBLE AS score FROM n""")
def automatic_aspects(spark, sf_dir):
    """A1 in automatic mode without a trained tagger: keywords, each once a document, merged and counted."""
    found = A.analyze(docs(spark, sf_dir), keywords=frozenset({"the", "and", "thin"}), stopwords=frozenset(), lexicon=TABLE_LEXICON, roots=frozenset())
    return found["aspects"].select("aspect", "count", "score")


@query(f"""WITH {_TAGS}, s AS (SELECT doc_idx, start, "end", conf AS c FROM tags WHERE label = 1 AND pos < 3)
SELECT s.doc_idx, s.start, s."end", round(avg(t.pos), 6) AS x, round(avg(t.conf), 6) AS y FROM s JOIN tags t ON t.doc_idx = s.doc_idx AND t.start < s."end" + 12 AND t."end" > s.start GROUP BY s.doc_idx, s.start, s."end" """)
def span_vectors(spark, sf_dir):
    """Means of the token vectors that overlap a span."""
    tags = _tags(spark, sf_dir).withColumn("vector", F.array(F.col("pos").cast("double"), "conf"))
    spans = tags.filter("label = 1 AND pos < 3").select("doc_idx", "start", (F.col("end") + 12).alias("end"))
    made = A.pool_spans(spans, tags)
    return _long(made.select("doc_idx", "start", (F.col("end") - 12).alias("end"), F.round(F.get("vector", 0), 6).alias("x"), F.round(F.get("vector", 1), 6).alias("y")), "start", "end")


@query(rf"""WITH {_islands('label', '').split('WITH ', 1)[1].replace('SELECT doc_idx, min(pos)', ', b AS (SELECT doc_idx, min(pos)', 1)}), o AS (SELECT b.doc_idx, b.start, b."end", substr(text, CAST(b.start AS BIGINT) + 1, CAST(b."end" - b.start AS BIGINT)) AS surface FROM b JOIN documents ON doc_id = b.doc_idx)
SELECT doc_idx, count(*) AS n, CAST(min(start) AS BIGINT) AS first_start FROM o WHERE len(trim(regexp_replace(lower(surface), '^[^\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+$', '', 'g'))) >= 3 GROUP BY doc_idx""")
def tagger_aspects(spark, sf_dir):
    """Occurrences from a tagger's labels; what is left of a name has three letters at least."""
    made = A.extract_model(docs(spark, sf_dir), _tags(spark, sf_dir), stopwords=frozenset({"zzz"}))
    return made.groupBy("doc_idx").agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_start"))


@query()
def rule_based_aspects(spark, sf_dir):
    """Words, else stems."""
    return A.rule_based_counts(A.extract_rule_based(docs(spark, sf_dir), ASPECTS))


_VEC = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
b AS (SELECT i, avg(x) AS m FROM v GROUP BY i), p AS (SELECT label, v.i, avg(x) - any_value(b.m) AS x FROM v JOIN b USING (i) GROUP BY label, v.i)"""


@query(f"""WITH {_VEC}, n AS (SELECT label, sqrt(sum(x * x)) AS n FROM p GROUP BY label), vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id),
s AS (SELECT v.vec_id, p.label, sum(v.x * p.x) / (any_value(vn.n) * any_value(n.n)) AS s FROM v JOIN p ON v.i = p.i JOIN n ON n.label = p.label JOIN vn ON vn.vec_id = v.vec_id GROUP BY v.vec_id, p.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS k, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label DESC) AS nx FROM s)
SELECT vec_id, label AS nearest, round(s, 4) AS similarity FROM r WHERE k = 1 AND s >= 0.15 AND s - nx >= 0.01""")
def semantic_mapping(spark, sf_dir):
    """Centred prototypes, nearest one with a margin."""
    e = read(spark, sf_dir, "embeddings")
    prototypes = A.prototypes(e.withColumnRenamed("label", "aspect"), e)
    found = A.semantic_matches(e.select("vec_id", "embedding"), prototypes, ["vec_id"])
    return found.select("vec_id", F.col("aspect").alias("nearest"), F.round("similarity", 4).alias("similarity"))


@query("SELECT vec_id % 20 AS doc_idx, round(1 - avg(s[1] - s[2]), 6) AS uncertainty FROM (SELECT vec_id, list_reverse_sort(list_transform(embedding[1:3], lambda x: abs(x)::DOUBLE)) AS s FROM embeddings) GROUP BY vec_id % 20")
def tagger_uncertainty(spark, sf_dir):
    """Real tokens only."""
    p = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("doc_idx"), F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x).cast("double")).alias("probs"))
    return A.uncertainty(p, ["doc_idx"]).withColumn("uncertainty", F.round("uncertainty", 6))


@query(r"SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\p{Z}\p{P}\p{S}\p{C}]', 'X', 'g'), '\b[a-z][a-z\-]+\b')) AS term FROM documents")
def lowercase_vocabulary(spark, sf_dir):
    """E26's vocabulary. SQL's boundaries know ASCII only, so other letters become an X there."""
    return D.lowercase_vocabulary(docs(spark, sf_dir))


_PROJECTED = ("the", "reason", "la", "und", "of the", "De  la", "in\tthe")


@query(r"""WITH p AS (SELECT doc_id AS doc_idx, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS a FROM documents),
t AS (SELECT doc_idx, text, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM p),
w AS (SELECT *, sum(len(piece)) OVER o - len(piece) AS start, lead(piece, 1) OVER o AS gap, lead(piece, 2) OVER o AS next FROM t WINDOW o AS (PARTITION BY doc_idx ORDER BY i)),
one AS (SELECT doc_idx, lower(piece) AS aspect, start, start + len(piece) AS "end", piece AS surface, i FROM w WHERE lower(piece) IN ('the', 'reason', 'la', 'und')),
two AS (SELECT doc_idx, CASE lower(piece) WHEN 'of' THEN 'of the' WHEN 'de' THEN 'De  la' ELSE 'in' || chr(9) || 'the' END AS aspect, start, start + len(piece || gap || next) AS "end", piece || gap || next AS surface, i FROM w
    WHERE regexp_full_match(gap, '\s+') AND (lower(piece), lower(next)) IN (('of', 'the'), ('de', 'la'), ('in', 'the')))
SELECT doc_idx, aspect, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM two
UNION ALL SELECT doc_idx, aspect, CAST(start AS BIGINT), CAST("end" AS BIGINT) FROM one WHERE NOT EXISTS (FROM two WHERE two.doc_idx = one.doc_idx AND two.i IN (one.i, one.i - 2))""")
def term_projection(spark, sf_dir):
    """E26's projection: any white space between words, whole words, longest first."""
    return _long(D.project(docs(spark, sf_dir), list(_PROJECTED)), "start", "end")


@query()
def term_candidates(spark, sf_dir):
    """Capitalised word pairs as raw terms, normalised and judged."""
    d = docs(spark, sf_dir)
    raw = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9(]+ [A-Za-z0-9)]+)"), F.lit(1))).alias("raw"))
    return D.reject_reasons(D.term_counts(raw, least=3), D.lowercase_vocabulary(d))


@query("SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT 'given' AS kind, doc_id FROM documents UNION ALL SELECT 'negative', doc_id + 1000000000 FROM documents WHERE lang = 'fr') GROUP BY kind")
def augmentation_parts(spark, sf_dir):
    """Every document stays, and every negative comes."""
    made = _augmented(spark, sf_dir).filter("kind != 'augmented'")
    return made.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_idx").alias("documents"))


@query()
def augmentation(spark, sf_dir):
    """Documents, copies with spans replaced from a pool and offsets anew, negatives, shuffled."""
    return _augmented(spark, sf_dir).select("doc_idx", "copy", "kind", "text", F.size("spans").alias("n"), "position")


def _augmented(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir)
    spans = P.resolve_overlaps(_occurrences(spark, sf_dir)).join(_occurrences(spark, sf_dir).select("doc_idx", "start", "end", "surface"), ["doc_idx", "start", "end"])
    negatives = d.filter("lang = 'fr'").withColumn("doc_idx", F.col("doc_idx") + 1_000_000_000)
    return D.augment(d, spans, D.substitution_pool(d, spans), 1, negatives)


@query(f"""WITH {_OCC}, t AS (SELECT lower(surface) AS y, count(*) AS n FROM occ GROUP BY 1), p AS (SELECT sum(n) AS n FROM (SELECT n FROM t ORDER BY n DESC, y LIMIT 10)), {DOCS}, {LATIN}
SELECT CAST(sum(t.n) AS BIGINT) AS spans, count(*) AS unique_types, round(count(*) / sum(t.n), 4) AS ttr, round(any_value(p.n) / sum(t.n), 4) AS top10_share, count(*) FILTER (y IN (SELECT word FROM lat)) AS ambiguous FROM t, p""")
def span_diversity(spark, sf_dir):
    """E28."""
    words = docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b([a-z][a-z]+)\b"), F.lit(1))).alias("token"))
    return D.diversity(_occurrences(spark, sf_dir), words)


@query(f"WITH {_OCC}, g AS (SELECT DISTINCT doc_idx, surface FROM occ WHERE aspect = 'the'), m AS (SELECT count(*) AS n FROM occ o WHERE aspect = 'the'), c AS (SELECT doc_idx, count(DISTINCT surface) AS k, count(*) AS n FROM occ WHERE aspect = 'the' GROUP BY doc_idx) SELECT CAST((SELECT sum(k * n) FROM c) AS BIGINT) AS matches, m.n AS gold, round((SELECT sum(k * n) FROM c) / m.n, 4) AS ratio FROM m")
def gold_fidelity(spark, sf_dir):
    """Texts of spans found again, over the spans."""
    return D.fidelity(docs(spark, sf_dir), _occurrences(spark, sf_dir).filter("aspect = 'the'"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 1) AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 2)")
def deleak(spark, sf_dir):
    """Training rows whose text is in neither held-out set."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    part = lambda k: d.filter(F.col("doc_id") % 3 == k)
    return D.deleak(part(0), part(1), part(2)).select("doc_id")


@query(f"WITH {_OCC}, l AS (SELECT doc_idx, string_agg(surface, '|' ORDER BY start, \"end\") AS a FROM (SELECT doc_idx, surface, min(start) AS start, min(\"end\") AS \"end\" FROM occ WHERE aspect IN ('the', 'und') GROUP BY doc_idx, surface) GROUP BY doc_idx) SELECT doc_idx, a AS aspects FROM l")
def retrain_payload(spark, sf_dir):
    """Texts with their aspects."""
    from lontar.sources.writers import to_retrain_payload

    made = to_retrain_payload(docs(spark, sf_dir), _occurrences(spark, sf_dir).filter("aspect IN ('the', 'und')"), only_with_aspects=True)
    return made.select("doc_idx", F.array_join("aspects", "|").alias("aspects"))


@query(f"WITH {_OCC} SELECT doc_idx, count(*) AS n_results, min(start) AS first_start FROM occ WHERE aspect = 'the' GROUP BY doc_idx")
def annotation_tasks(spark, sf_dir):
    """Task records, read back from their own structure."""
    from lontar.sources.writers import to_tasks

    made = to_tasks(docs(spark, sf_dir), _occurrences(spark, sf_dir).filter("aspect = 'the'"))
    flat = made.select("doc_idx", F.explode(F.get("predictions", 0)["result"]).alias("r"))
    return flat.groupBy("doc_idx").agg(F.count("*").alias("n_results"), F.min("r.value.start").cast("long").alias("first_start"))


