"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule's cost (seconds a document) and selectivity (share rejected) are estimated on a bounded sample, rules are
ordered by rejection per cost, and the order becomes a chain of nested CASE WHENs: a document that one rule rejects is not
put to the next ones. The order changes what is computed, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import read, words

#: Documents of the sample that orders the rules, about; it decides nothing else. Each rule is timed over so many repeats of it.
SAMPLE_DOCS, REPEATS = 400, 12

#: 3-word windows are sorted as (hash bits, position) in one long; this many bits hold the position.
_POS = 21


def _repeat_positions() -> str:
    """SQL: positions of windows that occur twice or more. Hash neighbours are compared word by word, so no collision
    counts; if any neighbours differ in spite of equal hash bits, or the text has over 2**21 words, whole windows are
    sorted instead."""
    low = (1 << _POS) - 1
    key = f"shiftrightunsigned(s[j], {_POS})"
    return f"""
    CASE WHEN n_words < 4 THEN array()
    WHEN n_words > {low} OR exists(sequence(1, size(s) - 1), j -> {key} = shiftrightunsigned(s[j - 1], {_POS}) AND NOT (
        w[cast(s[j] & {low} AS int)] = w[cast(s[j - 1] & {low} AS int)]
        AND w[cast(s[j] & {low} AS int) + 1] = w[cast(s[j - 1] & {low} AS int) + 1]
        AND w[cast(s[j] & {low} AS int) + 2] = w[cast(s[j - 1] & {low} AS int) + 2]))
    THEN transform(array(sort_array(transform(sequence(0, n_words - 3), i -> struct(w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, i AS i)))), q ->
        transform(filter(q, (x, j) -> (j > 0 AND x.a = q[j - 1].a AND x.b = q[j - 1].b AND x.c = q[j - 1].c)
            OR (j < size(q) - 1 AND x.a = q[j + 1].a AND x.b = q[j + 1].b AND x.c = q[j + 1].c)), x -> x.i))[0]
    ELSE transform(filter(s, (x, j) -> (j > 0 AND shiftrightunsigned(x, {_POS}) = shiftrightunsigned(s[j - 1], {_POS}))
        OR (j < n_words - 3 AND shiftrightunsigned(x, {_POS}) = shiftrightunsigned(s[j + 1], {_POS}))), x -> cast(x & {low} AS int)) END"""


def with_metrics(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to a frame that has `_text`."""
    text = F.coalesce("_text", F.lit(""))
    spread = F.expr(f"""CASE WHEN n_words < 4 OR n_words > {(1 << _POS) - 1} THEN array() ELSE
        sort_array(transform(sequence(0, n_words - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), {_POS}) | cast(i AS bigint))) END""")
    lines = F.expr("filter(split(coalesce(_text, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')")
    return (
        df.withColumn("w", words(F.col("_text")))
        .withColumn("n_words", F.size("w"))
        .withColumn("s", spread)
        .withColumn("p", F.expr(_repeat_positions()))
        .withColumn("l", lines)
        .select(
            *df.columns,
            # inline() keeps a later filter from being pushed below, where each use of a metric would compute it anew
            F.inline(F.array(F.struct(
                F.col("n_words").cast("long").alias("n_words"),
                F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
                (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
                F.size("l").cast("long").alias("n_lines"),
                F.size(F.array_distinct(F.expr("flatten(transform(p, x -> array(x, x + 1, x + 2)))"))).cast("long").alias("n_repeat_words"),
            ))),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )


def rules() -> dict[str, Column]:
    """Each is true where it rejects. They read `_text` and the metrics; text is never null here."""
    text = F.coalesce("_text", F.lit(""))
    left = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "duplicate_lines": (2 * F.col("n_dup_lines") > F.col("n_lines")) & (F.col("n_lines") > 3),
        "repeats": 100 * F.col("n_repeat_words") > 35 * F.col("n_words"),
        "capitals": 100 * left(r"\p{Lu}") > 40 * F.col("word_chars"),
        "shouting": 4 * left(r"[!?]") > F.col("n_words"),
        "letters": 100 * left(r"\p{L}") < 60 * F.col("word_chars"),
        "ellipsis": 100 * F.expr(r"size(regexp_extract_all(coalesce(_text, ''), '(?:\\.\\.\\.|…)[\\x20\\x09\\x0B-\\x0D]*(?:\\n|$)', 0))") > 30 * F.col("n_lines"),
    }


def cascade_order(sample: DataFrame, chosen: dict[str, Column]) -> list[str]:
    """Rule names by share rejected per second. A rule's cost is the time of one job that puts it to many repeats of the cached
    sample, less the time of the same job without a rule, so that what starting a job takes is no part of it."""
    shares = sample.agg(*(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(k) for k, c in chosen.items())).first()
    many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_again"))

    def seconds(rule: Column) -> float:
        began = time.perf_counter()
        many.agg(F.count_if(rule)).collect()
        return time.perf_counter() - began

    nothing = min(seconds(F.col("_again") > 0) for _ in range(2))
    cost = {name: max(1e-4, seconds(rule) - nothing) for name, rule in chosen.items()}
    return sorted(chosen, key=lambda name: (-shares[name] / cost[name], name))


def cascade(chosen: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in the order that rejects, or null: later rules run only where earlier ones passed."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(chosen[name], F.lit(name)).otherwise(verdict)
    return verdict


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept to each row of docs.

    docs' columns come back in the struct `_row`, so names can't clash. Null text counts as empty, which fails the base
    rules; null ids, ties and repeated rows are rows like any others; whole texts count, however long; an empty table gives none.
    """
    frame = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    chosen = rules()
    one_in = max(1, docs.count() // SAMPLE_DOCS)
    texts = frame.select("_text").filter(F.pmod(F.xxhash64("_text"), F.lit(one_in)) == 0)  # rows stay where they are read
    sample = with_metrics(texts).filter("not base_failed").persist()
    try:
        order = cascade_order(sample, chosen)
    finally:
        sample.unpersist()
    rejected = F.when(~F.col("base_failed"), cascade(chosen, order))
    return with_metrics(frame).withColumn("kept", ~F.col("base_failed") & rejected.isNull()).drop("_text", "n_lines")


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents").select("doc_id", "text")).select("_row.doc_id", *COLUMNS)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(t) - len(regexp_replace(t, '\p{Lu}', '', 'g')) AS caps, len(t) - len(regexp_replace(t, '[!?]', '', 'g')) AS shouts,
    len(t) - len(regexp_replace(t, '\p{L}', '', 'g')) AS letters,
    len(regexp_extract_all(t, '(?:\.\.\.|…)[\x20\x09\x0B-\x0D]*(?:\n|$)')) AS dots
    FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (2 * n_dup_lines > n_lines AND n_lines > 3) OR 100 * n_repeat_words > 35 * n_words OR 100 * caps > 40 * word_chars
    OR 4 * shouts > n_words OR 100 * letters < 60 * word_chars OR 100 * dots > 30 * n_lines) AS kept FROM f
"""
