"""What the queries share: tables, a lexicon for the tables' languages, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.config import Lexicon

#: The tables hold invented words and real function words of four languages, so these stand for a polarity lexicon.
TABLE_LEXICON = Lexicon(
    slang={"the": "", "and": "plus also", "of": "from", "der": "d", "les": "le"},
    typos={"to the": "toward the", "en": "in", "une": "un"},
    stopwords=frozenset({"a", "is", "und", "et", "y", "as"}),
    negations=frozenset({"is"}),
    positive=frozenset({"and", "that", "der", "les", "el", "an"}),
    negative=frozenset({"is", "on", "with", "die", "des", "que"}),
    lexicon_negations=frozenset({"to", "or", "ist", "un", "the"}),
)
ASPECTS = ["reason", "the", "of the", "heit", "tion", "ment", "de la", "und", "ción"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Tables below so many bytes are dealt over the cores, as their few row groups would keep few of them busy.
SMALL = 1 << 28


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the operators name them. A small table is dealt over all cores; others are read as they lie."""
    d = read(spark, sf_dir, "documents")
    small = int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL
    named = d.select(F.col("doc_id").alias("doc_idx"), "text", "lang", "source")
    return named.repartition(2 * spark.sparkContext.defaultParallelism) if small else named


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


def case_map(column: str, pairs: dict[str, str]) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {column} END"


DOCS = "docs AS (SELECT doc_id AS doc_idx, text, lang, source FROM documents)"


def words_sql(expression: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({expression}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"


#: doc_idx, word, pos of all tokens between white space.
TOKENS = f"tok AS (SELECT doc_idx, lang, source, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_idx, lang, source, {words_sql('text')} AS w FROM docs))"


def latin_sql(expression: str, least: int = 1) -> str:
    """List of words of a-z letters only; a word ends where no letter, mark, digit or underscore follows."""
    return f"list_filter(regexp_extract_all({expression}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{{least},}}'))"


#: doc_idx, word, pos of a-z words of two letters or more, in lower case.
LATIN = f"lat AS (SELECT doc_idx, lang, source, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_idx, lang, source, {latin_sql('lower(text)', 2)} AS w FROM docs))"
