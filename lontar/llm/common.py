"""What the training-data operators share: word rules, ranks without gaps, and the library's tables in the shared folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lontar.tables import materialize, remove, shared_folder

__all__ = ["gapless", "lower_ascii", "materialize", "piecewise", "read", "remove", "salts_for", "shared_folder", "shuffle_partitions", "slices", "words"]

#: A word is a run of anything but the six ASCII white-space characters; `bytes.split()` splits at the same six.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same for a text that is ASCII throughout, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salts_for(largest: int, rows: int = 200_000) -> int:
    """How many salts cut a group of that size into parts of about `rows`; 64 at least."""
    return max(64, -(-largest // rows))


def slices(batch, rows: int = 500):
    """A batch or array in short pieces, so that a worker holds few texts as Python objects at a time."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def piecewise(made, texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """made(list of texts) of each piece of an array, as one array."""
    return pa.chunked_array([made(part.to_pylist()) for part in slices(texts)], kind).combine_chunks()


def gapless(df: DataFrame, groups: list[str], salt: str, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: ranks 0, 1, 2, ... in each group (order: salt, then `order`), with no task that holds a whole group.

    Counts of (group, salt) give each salt its first rank; row_number goes on inside it. `salt` must spread rows of one
    group over many values. Group columns must not be null.
    """
    keys = [*groups, salt]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = counts.select(*keys, (F.sum("_n").over(Window.partitionBy(*groups).orderBy(salt)) - F.col("_n")).alias("_first"))
    inside = df.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return inside.join(first, keys).withColumn(name, F.col("_first") + F.col("_in")).drop("_first", "_in")
