"""Awkward documents that every operator must take, and the tables as plain rows."""

import pyarrow.parquet as pq
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("_n", T.LongType()),
])

LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(40_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood " * 3


def awkward():
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\n ", None, "a"), (4, "Ünïcode ÉÀ ß 😀 İstanbul", "de", None),
        (5, LONG, "en", "b"), (6, LONG + " tail", "en", "b"), (7, PROSE, "en", "c"), (8, PROSE.upper(), None, "c"), (9, PROSE, "en", "a"),
        (None, "no id here", "en", "a"), (None, PROSE, None, None), (10, "twice", "en", "d"), (10, "twice", "en", "d"), (10, "same id, other text", "fr", "d"),
        (11, "one\ntwo\nthree\nfour", "en", "d"), (12, "zero\none\ntwo\nthree\nfour\nfive", "en", "d"), (13, "one\n\ntwo\n \nthree", "en", "e"),
        (-5, "negative id", "en", "e"), (2**53 + 1, "large id <|endoftext|> it's", "en", "e"), (14, "x\x1cy \x85z w", "en", "e"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "x", None, "y", 7) for i, t, lang, source in texts]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def table(tables, name):
    return pq.read_table(f"{tables}/{name}.parquet").to_pylist()
