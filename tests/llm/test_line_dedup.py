from collections import Counter

from lontar.llm.line_dedup import line_dedup, op4_line_dedup
from pyspark.sql import functions as F
from tests.llm.cases import awkward, frame, table


def brute(spark, rows):
    """rows: (doc_id, version, text), any order."""
    seen, gone = set(), {}
    for i, v, t in sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], r[1])):
        lines = (t or "").split("\n")
        held = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        out = set()
        for a, b, c in zip(held, held[1:], held[2:], strict=False):
            key = (lines[a], lines[b], lines[c])
            if key in seen:
                out |= {a, b, c}
            seen.add(key)
        gone[i, t] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in out)
    return Counter((i, gone[i, t]) for i, _, t in rows)


def check(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    found = line_dedup(docs).select("_row.doc_id", "new_text").collect()
    assert Counter(map(tuple, found)) == brute(spark, rows)


def test_awkward(spark):
    check(spark, frame(spark, awkward()))


def test_overlaps(spark):
    texts = ["a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "q\nq\nq\nq\nq", "b\nc\nd\ne\nf\na\nb\nc", "a\nb\n\nc"]
    check(spark, frame(spark, [(9 - i, t, None, None, 0, None, None, None, None) for i, t in enumerate(texts)]))


def test_empty(spark):
    assert line_dedup(frame(spark, [])).collect() == []


def test_table(spark, tables):
    check(spark, spark.read.parquet(f"{tables}/documents.parquet"))
    found = op4_line_dedup(spark, tables).collect()
    assert sum(r.n_removed for r in found) > 0 and len(found) == len(table(tables, "documents"))
