import re
from collections import Counter

from lontar.llm.quality_rules import cascade, op2_quality_rules, quality_rules, rules, with_metrics
from pyspark.sql import functions as F
from tests.llm.cases import awkward, frame, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def metrics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def check(spark, docs, rows):
    found = quality_rules(docs).select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter(tuple(r)[:8] for r in found) == Counter((i, t, *metrics(t)) for i, t in rows)
    assert not any(r.base_failed and r.kept for r in found)
    return found


def test_awkward(spark):
    rows = awkward()
    check(spark, frame(spark, rows), [(r[0], r[1]) for r in rows])


def test_repeats(spark):
    texts = ["a b c a b c", "a a a a a a a", "a b c d e f a b c", "x y", "x y z", "p q r s p q r s p q", "ab c d abc d ab c d"]
    rows = [(i, t, None, None, 0, None, None, None, None) for i, t in enumerate(texts)]
    check(spark, frame(spark, rows), [(r[0], r[1]) for r in rows])


def test_empty(spark):
    assert quality_rules(frame(spark, [])).collect() == []


def test_table_keeps_clean_documents(spark, tables):
    quality = {r["doc_id"]: r["quality"] for r in table(tables, "labels")}
    found = op2_quality_rules(spark, tables).collect()
    long_enough = [r for r in found if r.n_words >= 50 and r.doc_id in quality]
    assert [r.kept for r in long_enough] == [quality[r.doc_id] == 1 for r in long_enough]


def test_order_never_changes_the_verdict(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", F.col("text").alias("_text"))
    chosen, names = rules(), list(rules())
    both = with_metrics(docs).select(cascade(chosen, names).isNull().alias("a"), cascade(chosen, names[::-1]).isNull().alias("b"))
    assert both.filter("a != b").count() == 0


def test_overlapping_windows_of_short_texts(spark):
    texts = ["a a a a", "a b a b a", "a a a a a", "a b c a b", "a b c d", "a a a"]
    found = check(spark, frame(spark, [(i, t, None, None, 0, None, None, None, None) for i, t in enumerate(texts)]), list(enumerate(texts)))
    assert {r.text: r.n_repeat_words for r in found} == dict(zip(texts, [4, 5, 5, 0, 0, 0], strict=True))
