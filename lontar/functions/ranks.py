"""Ranks within groups without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.tables import materialize


def rank_in_group(df: DataFrame, groups: list[str], hashed: Column, order: list[Column], name: str, bits: int = 8) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... in each group by an order that begins with a 64-bit hash. The hash's top bits cut a group
    into parts; counts of parts give each its first rank. Null group values are a group."""
    part = F.shiftright(hashed, 64 - bits)
    keyed = df.withColumn("_part", part).withColumn("_g", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}))
    counts = keyed.groupBy("_g", "_part").agg(F.count("*").alias("_c"))
    first = counts.select("_g", "_part", (F.sum("_c").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_c")).alias("_first"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_g", "_part").orderBy(*order)) - 1)
    return inside.join(first, ["_g", "_part"]).withColumn(name, F.col("_first") + F.col("_in")).drop("_g", "_part", "_first", "_in")


def rank_by_order(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... in each group by columns that order it, without a task that holds a whole group: rows are cut
    into ranges, counts of ranges give each its first rank. The table in between fixes what range a row is in. Null group
    values are a group; df has `groups` and `order` among its columns."""
    ranged = df.repartitionByRange(*groups, *order) if groups else df.repartitionByRange(*order)
    held = materialize(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_g", F.to_json(F.struct(*groups, F.lit(0).alias("_")), {"ignoreNullFields": "false"})), "ranges")
    counts = held.groupBy("_g", "_part").agg(F.count("*").alias("_c"))
    first = counts.select("_g", "_part", (F.sum("_c").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_c")).alias("_first"))  # one row a range
    inside = held.withColumn("_in", F.row_number().over(Window.partitionBy("_g", "_part").orderBy(*order)) - 1)
    return inside.join(first, ["_g", "_part"]).withColumn(name, F.col("_first") + F.col("_in")).drop("_g", "_part", "_first", "_in")
