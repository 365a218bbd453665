"""Line dedup by overlapping windows of three lines.

Consecutive non-blank lines are hashed, three digests make a window, and windows are grouped by 128-bit hash over all
documents. Of a repeated window the first occurrence (by doc_id, then position) stays; the lines that later occurrences
cover are merged per document and removed. Each removed line still stands at an earlier place: the line it repeats comes
strictly before it, and if that one goes too, it repeats one before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lontar.llm.common import materialize, read, slices

WINDOW = 3
_REMOVED = "array<struct<from:int,until:int>>"


def _windows(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("first", pa.int32()), ("lines", pa.list_(pa.int32())), ("window", pa.binary())])
    for batch in batches:
        ids, versions, firsts, lines, keys = [], [], [], [], []

        def flush():
            columns = (ids, versions, firsts, lines, keys)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            for c in columns:
                c.clear()
            return out

        for doc_id, version, text in (row for part in slices(batch) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)):
            held = [(i, xxh3_128_digest(line.encode("utf-8", "surrogatepass"))) for i, line in enumerate((text or "").split("\n")) if line.strip(" \t\r\x0b\x0c")]
            for k in range(len(held) - WINDOW + 1):
                part = held[k : k + WINDOW]
                ids.append(doc_id)
                versions.append(version)
                firsts.append(part[0][0])
                lines.append([i for i, _ in part])
                keys.append(xxh3_128_digest(b"".join(d for _, d in part)))
                if len(ids) >= 50_000:
                    yield flush()
        if ids:
            yield flush()


def _without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    out = []
    for text, gone in (row for at in range(0, len(texts), 500) for row in zip(texts.slice(at, 500).to_pylist(), removed.slice(at, 500).to_pylist(), strict=True)):
        if text is None or gone is None:
            out.append(None)
            continue
        lines, kept, at = text.split("\n"), [], 0
        for span in gone:
            kept += lines[at : span["from"]]
            at = span["until"]
        out.append("\n".join(kept + lines[at:]))
    return pa.array(out, pa.string())


def _spans(lists: pa.Array) -> pa.Array:
    """Merges line numbers into sorted half-open spans."""
    out = []
    for found in lists.to_pylist():
        spans: list[dict] = []
        for i in sorted(set(found)):
            if spans and spans[-1]["until"] == i:
                spans[-1]["until"] = i + 1
            else:
                spans.append({"from": i, "until": i + 1})
        out.append(spans)
    return pa.array(out, pa.list_(pa.struct([("from", pa.int32()), ("until", pa.int32())])))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs as the struct `_row`, with new_text (what is left), removed (line spans, null if none), n_removed.

    Lines are what newlines part; blank ones make no window and stay. Null text stays null, texts of fewer than three
    lines stay as they are. A null id comes first. Rows equal in id and text count as one document: they lose the same
    lines and don't repeat each other. Rows of one id with different texts are different documents, the smaller hash first.
    An empty table gives no row.
    """
    named = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("_text"))
    windows = materialize(named.select("doc_id", "version", "_text").mapInArrow(_windows, "doc_id long, version long, first int, lines array<int>, window binary"), "line_windows")
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.col("version").alias("version"), F.col("first").alias("first"))
    repeated = materialize(windows.groupBy("window").agg(F.min(place).alias("stays"), F.max(place).alias("last")).filter("stays < last").select("window", "stays"), "line_repeats")
    later = windows.join(repeated, "window").filter(F.col("stays") < place)
    merged = (
        later.select("doc_id", "version", F.explode("lines").alias("line")).groupBy("doc_id", "version").agg(F.collect_set("line").alias("found"))
        .select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.arrow_udf(_spans, _REMOVED)("found").alias("removed"))
    )
    rest = F.arrow_udf(_without, "string")(F.when(F.col("removed").isNotNull(), F.col("_text")), "removed")
    return (
        named.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
        .withColumn("_rest", rest)
        .select("_row", F.when(F.col("removed").isNull(), F.col("_text")).otherwise(F.col("_rest")).alias("new_text"), "removed",
                F.coalesce(F.aggregate("removed", F.lit(0), lambda n, s: n + s["until"] - s["from"]), F.lit(0)).alias("n_removed"))
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("_row.doc_id", F.col("new_text").alias("text"), "n_removed", F.to_json("removed").alias("removed"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.i AS i0, b.i AS i1, c.i AS i2, row_number() OVER (PARTITION BY a.line, b.line, c.line ORDER BY a.doc_id, a.i) AS r
    FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN n c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
g AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM w WHERE r > 1),
s AS (SELECT doc_id, min(i) AS a, max(i) + 1 AS b FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM g) GROUP BY doc_id, grp),
j AS (SELECT doc_id, '[' || string_agg('{"from":' || a || ',"until":' || b || '}', ',' ORDER BY a) || ']' AS removed, CAST(sum(b - a) AS INTEGER) AS n FROM s GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i WHERE g.i IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(j.n, 0) AS n_removed, j.removed
FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
