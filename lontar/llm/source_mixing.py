"""Mixing sources to target weights by systematic sampling, in built-in functions only.

Within a source every document expects target / source size copies. Documents are ranked by size, so the prefix sum of
expected copies at rank k is k times that; one offset is added, and a document is emitted once for each integer boundary
its step crosses. Ranking by size makes the words taken follow the target closely. Ranks come from counts of (source,
size, salt), so that no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions.ranks import rank_by_order
from lontar.llm.common import materialize, read, words

SEED = "mixing-1"
#: Source weights by position in code-point order, repeating; and how often a source may be repeated at most.
WEIGHTS, MOST = (1, 2, 3), 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds _target and _copies (expected for each document) to one row per source with _src and source_size.

    Sources whose share would be over 3 times their size are full; the rest share what is left by weight, which may fill more
    of them, so that is repeated until none is added. Only sums reach the driver, and ranks by name come from ranges of names,
    as there may be many sources.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_r") % len(WEIGHTS) + 1).cast("int")).cast("long")
    held = materialize(rank_by_order(sizes, [], ["_src"], "_r").select("_src", "source_size", weight.alias("_w")), "mix_sources")
    most = MOST * F.col("source_size")
    total, left, open_weight = held.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    while True:
        full = most.cast("double") / F.col("_w") <= F.lit(float(left) / max(open_weight, 1))
        taken, still = held.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0))).first()
        if still == open_weight or not still:
            break
        left, open_weight = total - taken, still
    share = (F.lit(left) * F.col("_w")).cast("double") / F.lit(float(max(open_weight, 1)))
    target = F.when(full, most.cast("double")).otherwise(share)
    copies = F.when(F.col("source_size") > 0, F.col("_target") / F.col("source_size")).otherwise(F.lit(0.0))
    return held.withColumn("_target", target).select("_src", "source_size", "_target", copies.alias("_copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, seed: str = SEED) -> DataFrame:
    """Each row of docs, as the struct `_row`, with size, source_size, target, copies (how often the mix takes it) and taken.

    Size counts words, unless size_col has it already; null text has none. Null source is a source of its own, last in
    order. A source without words takes nothing. Whole texts count, however long. Rows of a source and size are in an order
    that hashes of their ids begin; rows equal in every column are interchangeable, and each is sampled by itself. Reruns
    agree, as the offset comes from a hash of seed and source. An empty table gives no row.
    """
    rows = docs.select(
        F.struct("*").alias("_row"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("_src"),
        (F.col(size_col) if size_col else F.size(words(F.col(text_col)))).cast("long").alias("size"),
        F.col(id_col).alias("_id"),
        F.xxhash64("*").alias("_tie"),
    ).withColumn("_salt", F.substring(F.md5(F.coalesce(F.col("_id").cast("string"), F.col("_tie").cast("string"))), 1, 3))  # 4,096 parts
    keys = ["_src", "size", "_salt"]
    parts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    by_size = parts.groupBy("_src", "size").agg(F.sum("_n").alias("_n"))
    sources = source_targets(by_size.groupBy("_src").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")))
    sized = by_size.select("_src", "size", (F.sum("_n").over(Window.partitionBy("_src").orderBy("size")) - F.col("_n")).alias("_below"))
    first = (
        parts.withColumn("_salted", F.sum("_n").over(Window.partitionBy("_src", "size").orderBy("_salt")) - F.col("_n"))
        .join(sized, ["_src", "size"])
        .join(sources, "_src")
        .select(*keys, (F.col("_below") + F.col("_salted")).alias("_first"), "source_size", "_target", "_copies")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_id", "_tie"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_src"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    crossed = lambda k: F.floor(F.col("_copies") * k + F.col("_offset"))
    return (
        rows.withColumn("_in", rank)
        .join(first, keys)
        .withColumn("_k", F.col("_first") + F.col("_in"))
        .withColumn("_offset", offset)
        .withColumn("copies", F.least(F.lit(MOST), crossed(F.col("_k")) - crossed(F.col("_k") - 1)).cast("int"))
        .select("_row", "size", "source_size", F.col("_target").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


def op6_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")  # the words are counted before anything moves, and the text stays behind
    counted = docs.select("doc_id", "source", F.size(words(F.col("text"))).alias("n_words"))
    return mix_sources(materialize(counted, "mix_words"), size_col="n_words").select("_row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM s),
f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w AS fill FROM w),
g AS (SELECT *, CAST(3 * source_size AS DOUBLE) / w <= CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(w) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM f),
t AS (SELECT *, CASE WHEN filled THEN CAST(3 * source_size AS DOUBLE) ELSE CAST((sum(source_size) OVER () - coalesce(sum(CASE WHEN filled THEN 3 * source_size END) OVER (), 0)) * w AS DOUBLE)
    / sum(CASE WHEN NOT filled THEN w END) OVER () END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies,
    CAST(CAST('0x' || substr(md5('mixing-1' || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.copies, e.u,
    row_number() OVER (PARTITION BY d.src ORDER BY d.size, substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 3), d.doc_id) AS k FROM d JOIN e ON e.src = d.src)
SELECT doc_id, size, source_size, target, CAST(least(3, floor(copies * k + u) - floor(copies * (k - 1) + u)) AS BIGINT) * size AS taken FROM k
"""
