"""Sources: corpora, gold sets, CoNLL, lexicons, word lists, annotation tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lontar.functions.ranks import rank_by_order
from lontar.sources.splits import json_elements, read_pieces, with_count_before

LABELS = ("positive", "neutral", "negative")


def number_documents(df: DataFrame, order: str, corpus: str = "corpus_id") -> DataFrame:
    """Adds doc_idx 0, 1, 2, ... within each corpus, by a column that orders it, however large the corpus."""
    return rank_by_order(df, [corpus], [order], "doc_idx")


def validate_corpus(df: DataFrame, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Trims. Blank texts are kept: results stay aligned with the corpus. With max_chars, longer texts raise at run time."""
    trimmed = F.trim(F.coalesce(F.col(text), F.lit("")))
    if max_chars is None:
        return df.withColumn(text, trimmed)
    return df.withColumn(text, F.when(F.char_length(trimmed) > max_chars, F.raise_error(F.lit(f"a text has over {max_chars} characters"))).otherwise(trimmed))


def text_problem(text: Column, max_chars: int) -> Column:
    """too_long where validate_corpus would raise, else empty; null is blank."""
    return F.when(F.char_length(F.trim(F.coalesce(text, F.lit("")))) > max_chars, "too_long").otherwise("")


def corpus_problems(df: DataFrame, corpus: str = "corpus_id", text: str = "text", max_texts: int | None = None) -> DataFrame:
    """Corpora with too many texts for a caller's limit, or none but blank ones."""
    by = df.groupBy(corpus).agg(F.count("*").alias("n"), F.count_if(F.trim(F.coalesce(text, F.lit(""))) != "").alias("filled"))
    many = F.col("n") > max_texts if max_texts is not None else F.lit(False)
    return by.withColumn("problem", F.when(many, "too_many_texts").when(F.col("filled") == 0, "all_blank")).filter("problem is not null")


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_idx, text from a JSON array of strings or of objects with a `text`, or an object that wraps such an array (under
    `data`, else under its first name). Blank texts go; doc_idx counts what is left in file order; limit takes the first ones."""
    items = json_elements(spark, path).withColumn("x", F.parse_json("value"))
    text = F.when(F.expr("schema_of_variant(x)") == "STRING", F.expr("try_variant_get(x, '$', 'string')")).otherwise(F.expr("try_variant_get(x, '$.text', 'string')"))
    kept = items.select("_file", "_block", "_n", text.alias("text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    out = rank_by_order(kept, [], ["_file", "_block", "_n"], "doc_idx").select("doc_idx", "text")
    return out.filter(F.col("doc_idx") < limit) if limit is not None else out


def _gold_rows(spark: SparkSession, path: str) -> DataFrame:
    part = lambda name: F.expr(f"try_variant_get(try_parse_json(value), '$.{name}', 'string')").alias(name)
    return json_elements(spark, path, strict=False).select("_file", "_block", "_n", part("text"), part("label")).withColumn("label", F.lower(F.trim("label")))


def _is_gold() -> Column:
    return F.coalesce((F.trim(F.coalesce("text", F.lit(""))) != "") & F.col("label").isin(*LABELS), F.lit(False))


def read_gold(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_idx, text, label of a JSON array; rows with a blank text or an unknown label go, and files that don't close."""
    good = _gold_rows(spark, path).filter(_is_gold())
    out = rank_by_order(good, [], ["_file", "_block", "_n"], "doc_idx").select("doc_idx", "text", "label")
    return out.filter(F.col("doc_idx") < limit) if limit is not None else out


def gold_drops(spark: SparkSession, path: str) -> DataFrame:
    """kept, dropped of a gold file."""
    return _gold_rows(spark, path).agg(F.count_if(_is_gold()).alias("kept"), F.count_if(~_is_gold()).alias("dropped"))


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """doc_idx, pos, token, label of CoNLL files: blank lines end documents; lines of under two fields are skipped, and a
    document of such lines alone is none. doc_idx counts documents over all files, in the order of files. Files are read in
    ranges of lines."""
    blank = F.trim("value", F.lit(" \t\r")) == ""
    lines = with_count_before(read_pieces(spark, path), blank, "_gap").withColumn("_f", F.split(F.rtrim("value"), "\t")).filter(~blank & (F.size("_f") >= 2))
    placed = rank_by_order(lines.select("_file", "_gap", "_block", "_n", "_f"), ["_file", "_gap"], ["_block", "_n"], "pos")
    documents = rank_by_order(lines.select("_file", "_gap").distinct(), [], ["_file", "_gap"], "doc_idx")
    return placed.join(documents, ["_file", "_gap"]).select("doc_idx", F.col("pos").cast("int").alias("pos"), F.get("_f", 0).alias("token"), F.upper(F.trim(F.get("_f", 1))).alias("label"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, provenance, literal_only from the `aspects` of a lexicon file; its other keys are notes."""
    item = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("provenance", T.StringType()), T.StructField("literal_only", T.BooleanType())]))
    rows = spark.read.schema(T.StructType([T.StructField("aspects", item)])).json(path, multiLine=True)
    return rows.select(F.inline("aspects")).withColumn("literal_only", F.coalesce("literal_only", F.lit(False)))


def read_stopwords(spark: SparkSession, path: str, fallback: frozenset[str] = frozenset()) -> frozenset[str]:
    """A word list, one a line, in lower case; the fallback if the file is empty or missing. A dictionary is a constant of
    the plan, so it comes to the driver."""
    from pyspark.errors import AnalysisException

    try:
        found = {r[0] for r in spark.read.text(path).select(F.lower(F.trim("value"))).filter("value <> ''").distinct().collect()}
    except AnalysisException:
        found = set()
    return frozenset(found - {""}) or fallback


def read_roots(spark: SparkSession, path: str, fallback: frozenset[str] = frozenset()) -> frozenset[str]:
    """A root dictionary, one word a line; hyphens are kept. Pass it as `roots` of a Lexicon, a stemmer or an operator."""
    return read_stopwords(spark, path, fallback)


def read_pairs(spark: SparkSession, path: str) -> dict[str, str]:
    """A slang or typo dictionary: a JSON object of strings. Later keys win."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>", {"mapKeyDedupPolicy": "LAST_WIN"}).alias("m")).collect()
    return {k: v for r in rows for k, v in (r.m or {}).items()}


TASK = T.StructType([
    T.StructField("data", T.StructType([T.StructField("text", T.StringType())])),
    T.StructField("predictions", T.ArrayType(T.StructType([
        T.StructField("model_version", T.StringType()),
        T.StructField("result", T.ArrayType(T.StructType([
            T.StructField("from_name", T.StringType()), T.StructField("to_name", T.StringType()), T.StructField("type", T.StringType()),
            T.StructField("value", T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType()))])),
        ]))),
    ]))),
])


def read_tasks(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """text, spans array<struct<start, end>> of annotation tasks; the stored span text is not used, as offsets are right
    where it isn't. Files are JSON arrays, read in ranges, or one record a line, as write_json leaves them."""
    rows = spark.read.schema(TASK).json(path) if lines else json_elements(spark, path).select(F.inline(F.array(F.from_json("value", TASK))))
    values = F.flatten(F.transform("predictions", lambda p: p["result"]))
    return rows.select(F.col("data.text").alias("text"), F.transform(values, lambda r: F.struct(r["value"]["start"].alias("start"), r["value"]["end"].alias("end"))).alias("spans"))
