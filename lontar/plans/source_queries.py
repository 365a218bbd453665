"""Source and sink queries: a table goes out as files of a format, in the folder that all share, and comes back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.operators import spans
from lontar.operators.datasets import harvest_terms
from lontar.plans.common import docs, read
from lontar.plans.registry import query
from lontar.sources import readers as R
from lontar.sources import writers as W
from lontar.tables import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(df: DataFrame, name: str, group: str, value) -> str:
    """One file for each value of the column `group`: the text that `value` makes of the group's rows."""
    path = _folder(df.sparkSession, name)
    df.groupBy(F.col(group).alias("g")).agg(value.alias("value")).write.partitionBy("g").text(path)
    return path


def _benchmark(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "benchmark").withColumn("g", F.lpad((F.col("item_id") % 16).cast("string"), 2, "0"))


def _items():
    return F.array_sort(F.collect_list(F.struct("item_id", "text")))


_NUMBERED = "SELECT row_number() OVER (ORDER BY lpad(CAST(item_id % 16 AS VARCHAR), 2, '0'), item_id) - 1 AS doc_idx, text FROM benchmark"


@query(_NUMBERED)
def corpus_scan(spark, sf_dir):
    """JSON arrays of strings and records."""
    mixed = F.transform(_items(), lambda x: F.when(x["item_id"] % 3 == 0, F.to_json(F.struct(x["text"].alias("t")))).otherwise(F.to_json(F.struct(x["text"].alias("text")))))
    bare = F.transform(mixed, lambda j: F.regexp_replace(j, r'(?s)^\{"t":(.*)\}$', "$1"))
    return R.read_corpus(spark, _files(_benchmark(spark, sf_dir), "corpus", "g", F.concat(F.lit('["  ",'), F.array_join(bare, ","), F.lit("]"))))


@query(_NUMBERED)
def wrapped_corpus_scan(spark, sf_dir):
    """Arrays that a record wraps, under `data` or another name."""
    body = F.to_json(F.transform(_items(), lambda x: F.struct(x["text"].alias("text"))))
    return R.read_corpus(spark, _files(_benchmark(spark, sf_dir), "wrapped", "g", F.concat(F.when(F.min("item_id") % 2 == 0, '{"data":').otherwise('{"rows":'), body, F.lit("}"))))


@query("SELECT text, CASE item_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS label FROM benchmark WHERE item_id % 4 <> 3")
def gold_scan(spark, sf_dir):
    """S3: rows with a known label, in any letter case."""
    label = lambda i: F.when(i % 4 == 0, " Positive").when(i % 4 == 1, "neutral").when(i % 4 == 2, "NEGATIVE ").otherwise("odd")
    value = F.to_json(F.transform(_items(), lambda x: F.struct(x["text"].alias("text"), label(x["item_id"]).alias("label"))))
    return R.read_gold(spark, _files(_benchmark(spark, sf_dir), "gold", "g", value)).select("text", "label")


@query("""WITH t AS (SELECT item_id, doc_idx, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT item_id, row_number() OVER (ORDER BY lpad(CAST(item_id % 16 AS VARCHAR), 2, '0'), item_id) - 1 AS doc_idx, list_filter(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark))
SELECT doc_idx, pos, token, CASE (item_id + pos) % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'I' ELSE 'O' END AS label FROM t""")
def conll_scan(spark, sf_dir):
    """Tokens and labels by line, documents by blank lines, lines without a label between them; 16 files."""
    from lontar.functions.text import tokens

    line = lambda x: F.array_join(F.transform(tokens(x["text"]), lambda t, i: F.concat(t, F.lit("\t"), F.element_at(F.array(F.lit("b"), F.lit("I"), F.lit("O")), ((x["item_id"] + i) % 3 + 1).cast("int")))), "\n")
    value = F.array_join(F.transform(_items(), line), "\nnolabel\n \n\n")
    return R.read_conll(spark, _files(_benchmark(spark, sf_dir), "conll", "g", value)).select("doc_idx", F.col("pos").cast("long").alias("pos"), "token", "label")


@query("SELECT DISTINCT source AS term, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS provenance, lang = 'de' AS literal_only FROM (SELECT source, min(lang) AS lang FROM documents GROUP BY source)")
def lexicon_scan(spark, sf_dir):
    """The terms of a lexicon file; its notes are none."""
    terms = docs(spark, sf_dir).groupBy("source").agg(F.min("lang").alias("lang")).withColumn("g", F.lit("0"))
    item = F.struct(F.col("source").alias("term"), F.when(F.col("lang") != "en", F.col("lang")).alias("provenance"), F.when(F.col("lang") == "de", True).alias("literal_only"))
    return R.read_lexicon(spark, _files(terms, "lexicon", "g", F.concat(F.lit('{"_note": "x", "aspects": '), F.to_json(F.collect_list(item)), F.lit("}"))))


def _words(spark, sf_dir, reader) -> DataFrame:
    lines = docs(spark, sf_dir).select(F.concat(F.lit(" "), F.upper("source"), F.lit("\n\n")).alias("value")).distinct()
    path = _folder(spark, "words")
    lines.write.text(path)
    return spark.createDataFrame([(w,) for w in sorted(reader(spark, path))], "word string")


@query("SELECT DISTINCT lower(source) AS word FROM documents")
def stopword_scan(spark, sf_dir):
    """S6."""
    return _words(spark, sf_dir, R.read_stopwords)


@query("SELECT DISTINCT lower(source) AS word FROM documents")
def root_scan(spark, sf_dir):
    """S7."""
    return _words(spark, sf_dir, R.read_roots)


@query("""WITH d AS (SELECT doc_id AS doc_idx, text, lower(text) AS l FROM documents), p AS (SELECT text, l, unnest(list_filter(generate_series(1, len(l) - 2), lambda i: substr(l, i, 3) = 'the')) AS i FROM d WHERE contains(l, 'the'))
SELECT substr(text, i, 3) AS term, count(*) AS n FROM p WHERE NOT (i > 1 AND regexp_matches(substr(l, i - 1, 1), '[\\p{L}\\p{N}]')) AND NOT regexp_matches(substr(l, i + 3, 1), '[\\p{L}\\p{N}]') GROUP BY 1""")
def task_harvest(spark, sf_dir):
    """Tasks go out and come back; terms are read at their offsets."""
    d = docs(spark, sf_dir)
    path = _folder(spark, "tasks")
    W.write_json(W.to_tasks(d, spans.literal_spans(d, ["the"])).drop("doc_idx"), path)
    return harvest_terms(R.read_tasks(spark, path, lines=True))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def results_by_label(spark, sf_dir):
    """One folder a label; a rerun of one replaces its own."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    path = _folder(spark, "results")
    W.write_results(d, path, "lang")
    W.write_results(d.filter("lang = 'fr'"), path, "lang")
    return spark.read.json(path).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("""WITH c AS (SELECT quality, count(*) AS n, avg(toxic) AS t FROM labels GROUP BY quality), l AS (SELECT 0 AS line, '| quality | n | toxic |' AS content UNION ALL SELECT 1, '| --- | --- | --- |'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY quality) - 1, '| ' || quality || ' | ' || n || ' | ' || printf('%.4f', t) || ' |' FROM c) SELECT CAST(line AS BIGINT) AS line, content FROM l""")
def markdown_table(spark, sf_dir):
    """S13."""
    found = read(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.avg("toxic").alias("toxic")).orderBy("quality")
    return spark.createDataFrame(list(enumerate(W.render_table(found, ["quality", "n", "toxic"]).split("\n"))), "line long, content string")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT user_id, i, [s] AS held, true AS allowed FROM e WHERE i = 1
UNION ALL SELECT q.user_id, q.i, CASE WHEN len(q.h) < 3 THEN list_append(q.h, q.s) ELSE q.h END, len(q.h) < 3 FROM (SELECT e.user_id, e.i, e.s, list_filter(r.held, lambda x: x > e.s - 86400) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) q)
SELECT user_id, count(*) AS requests, count(*) FILTER (allowed) AS allowed FROM r GROUP BY user_id""")
def rate_limiter_stream(spark, sf_dir):
    """R1, R2 as a stream over all events that are there, which ends by itself."""
    from lontar.streaming.limiter import stream_rate_limit

    table, out = read(spark, sf_dir, "events"), _folder(spark, "limited")
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(table.schema)  # a stream reads folders: the table's, or the one that holds its file
    rows = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if table.inputFiles()[0].endswith("/events.parquet") else stream.parquet(path)
    events = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    run = stream_rate_limit(events, "user_id", "ts", 3, 86400.0, late="1 day").writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    try:
        if not run.awaitTermination(600):
            raise TimeoutError("the stream didn't end")
    finally:
        run.stop()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("allowed")).alias("allowed"))


@query("SELECT CAST(2 AS BIGINT) AS n, true AS same")
def pool_digests(spark, sf_dir):
    """E9 for tables of any size: the digest of a table doesn't depend on its order or parts."""
    from lontar.operators.evaluate import pool_digest

    d = docs(spark, sf_dir)
    both = pool_digest(d, "text").unionByName(pool_digest(d.repartition("doc_idx"), "text"))
    return both.agg(F.count("*").alias("n"), (F.count_distinct("fingerprint") == 1).alias("same"))
