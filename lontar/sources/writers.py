"""Sinks: annotation tasks, retraining payloads, gold sets, results by label, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OFFSETS = "array<struct<start:int,end:int>>"


def _with_spans(docs: DataFrame, spans: DataFrame, key: str, how: str = "left") -> DataFrame:
    """docs with `_s`, their spans by place, or null. A text meets its spans once, as a list of offsets, so it is not repeated."""
    item = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    return docs.join(spans.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s")), key, how)


def _surface(text: str, s: Column) -> Column:
    return F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])


def to_tasks(docs: DataFrame, spans: DataFrame, key: str = "doc_idx", text: str = "text", version: str = "lexicon", label: str = "ASPECT") -> DataFrame:
    """data, predictions records, one a document; documents without spans have an empty result."""

    def item(s: Column) -> Column:
        value = F.struct(s["start"].alias("start"), s["end"].alias("end"), _surface(text, s).alias("text"), F.array(F.lit(label)).alias("labels"))
        return F.struct(F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), value.alias("value"))

    results = F.transform(F.coalesce("_s", F.array().cast(_OFFSETS)), item)
    return _with_spans(docs, spans, key).select(key, F.struct(F.col(text).alias("text")).alias("data"), F.array(F.struct(F.lit(version).alias("model_version"), results.alias("result"))).alias("predictions"))


def to_retrain_payload(docs: DataFrame, spans: DataFrame, key: str = "doc_idx", text: str = "text", only_with_aspects: bool = False) -> DataFrame:
    """text, aspects (each surface once, by place), spans."""
    joined = _with_spans(docs, spans, key, "inner" if only_with_aspects else "left")
    aspects = F.coalesce(F.array_distinct(F.transform("_s", lambda x: _surface(text, x))), F.array().cast("array<string>"))
    return joined.select(key, text, aspects.alias("aspects"), F.col("_s").alias("spans"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_results(df: DataFrame, path: str, label: str = "label") -> None:
    """Results by run label; a rerun replaces its own label's files only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label).json(path)


def to_gold(docs: DataFrame, spans: DataFrame, key: str = "doc_idx", text: str = "text") -> DataFrame:
    """text, spans array<struct<start, end, surface>> by place: a gold set that keeps the annotators' offsets. Documents
    without spans have an empty array; write it with write_json."""
    named = F.transform(F.coalesce("_s", F.array().cast(_OFFSETS)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _surface(text, s).alias("surface")))
    return _with_spans(docs.select(key, text), spans, key).select(key, text, named.alias("spans"))


def render_table(df: DataFrame, columns: list[str], most: int = 1000) -> str:
    """A Markdown table of a small result, in its order. Over `most` rows raise, as a page holds no table of that size."""
    rows = df.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; raise `most` or aggregate first")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line(r) for r in rows)])


def render_between(page: str, name: str, table: str) -> str:
    """The page with the table put between the marks of that name; a page without them gets both at its end."""
    first, last = f"<!-- AUTO:{name} -->", f"<!-- /AUTO:{name} -->"
    if first not in page or last not in page:
        return f"{page.rstrip()}\n\n{first}\n{table}\n{last}\n"
    return page[: page.index(first) + len(first)] + f"\n{table}\n" + page[page.index(last) :]


def write_provenance(spark: SparkSession, path: str, record: dict) -> bool:
    """A record beside a model; failing to write it is no failure."""
    import json

    try:
        spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return True
    except Exception:
        return False
