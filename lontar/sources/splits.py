"""Records of files that Spark reads in byte ranges, so one large file is the work of many tasks.

The text source cuts a file into ranges and gives each piece between separators to the range it begins in. A piece has its
place: file, first byte of its range, and number in it. What depends on all that came before (whether a comma is inside a
string, how deep brackets are) is summed up for each range, the few sums of ranges are added up along a file, and each piece
starts from its range's sum. No task reads a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lontar.tables import materialize

_RANGE = ["_file", "_block"]


def _before():
    """A range's pieces before each."""
    return Window.partitionBy(*_RANGE).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)


def _earlier():
    """A file's ranges before each, of a table with one row a range."""
    return Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _total_before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0))


def read_pieces(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """_file, _block, _n, value: what lies between separators (ends of lines, if none is given), with its place."""
    source = spark.read if separator is None else spark.read.option("lineSep", separator)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n")]
    return source.text(path).select(*place, "value")


def with_last(rows: DataFrame, marked: Column, name: str) -> DataFrame:
    """Adds `name`: the place of the last row at or before each, in its file, that is marked; null before the first one."""
    flagged = rows.withColumn("_mark", F.when(marked, F.struct("_block", "_n")))
    ends = flagged.groupBy(*_RANGE).agg(F.max("_mark").alias("_top"))
    carried = ends.select(*_RANGE, F.max("_top").over(_earlier()).alias("_carried"))
    inside = flagged.withColumn("_own", F.max("_mark").over(Window.partitionBy(*_RANGE).orderBy("_n")))
    return inside.join(carried, _RANGE).withColumn(name, F.coalesce("_own", "_carried")).drop("_mark", "_own", "_carried")


def with_count_before(rows: DataFrame, counted: Column, name: str) -> DataFrame:
    """Adds `name`: how many rows before each, in its file, are counted."""
    flagged = rows.withColumn("_c", counted.cast("long"))
    first = flagged.groupBy(*_RANGE).agg(F.sum("_c").alias("_all")).select(*_RANGE, _total_before(F.col("_all"), _earlier()).alias("_first"))
    inside = flagged.withColumn("_in", _total_before(F.col("_c"), _before()))
    return inside.join(first, _RANGE).withColumn(name, F.col("_first") + F.col("_in")).drop("_c", "_first", "_in")


def _depth_change(text: Column) -> Column:
    """Opening less closing brackets outside strings of a text without escapes that begins outside a string."""
    bare = F.regexp_replace(text, '"[^"]*("|$)', "")
    return F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))


def _with_depth(pieces: DataFrame) -> DataFrame:
    """Adds _string, _depth: what holds at each piece's beginning; _root, the file's first bracket; _whole, if all closes."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # an escape is never cut, as no separator follows a backslash
    quotes = F.char_length(plain) - F.char_length(F.replace(plain, F.lit('"')))
    signs = pieces.withColumn("_q", quotes).withColumn("_d0", _depth_change(plain)).withColumn("_d1", _depth_change(F.concat(F.lit('"'), plain)))
    inside = signs.withColumn("_odd", _total_before(F.col("_q"), _before()) % 2 == 1)
    either = lambda odd, a, b: F.when(odd, F.col(a)).otherwise(F.col(b))
    ranges = inside.groupBy(*_RANGE).agg(
        F.sum("_q").alias("_q"), F.sum(either(F.col("_odd"), "_d1", "_d0")).alias("_e0"), F.sum(either(F.col("_odd"), "_d0", "_d1")).alias("_e1"),
        F.min_by(F.regexp_extract("value", r"^[\s\x{FEFF}]*([\[{])", 1), F.when(F.col("value").rlike(r"[^\s\x{FEFF}]"), F.col("_n"))).alias("_r"),
    )
    whole = Window.partitionBy("_file")
    ranges = ranges.withColumn("_starts_odd", _total_before(F.col("_q"), _earlier()) % 2 == 1).withColumn("_e", either(F.col("_starts_odd"), "_e1", "_e0"))
    ranges = ranges.select(
        *_RANGE, "_starts_odd", _total_before(F.col("_e"), _earlier()).alias("_starts_deep"), F.min_by("_r", F.when(F.col("_r").isNotNull(), F.col("_block"))).over(whole).alias("_root"),
        ((F.sum("_e").over(whole) == 0) & (F.sum("_q").over(whole) % 2 == 0)).alias("_whole"),
    )
    known = inside.join(ranges, _RANGE).withColumn("_string", F.col("_odd") != F.col("_starts_odd"))
    deep = F.col("_starts_deep") + _total_before(either(F.col("_string"), "_d1", "_d0"), _before())
    return known.withColumn("_depth", deep).select("_file", "_block", "_n", "value", "_string", "_depth", "_root", "_whole")


def json_elements(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """_file, _block, _n, value: the JSON text of each element of the array that is each file, or that an object there wraps
    under `data`, else under its first name. (_block, _n) orders a file's elements.

    A file is read in ranges of spark.sql.files.maxPartitionBytes, also if it is one line. Files whose brackets or strings
    don't close raise, or give nothing if not strict. Files with neither an array nor one wrapped give nothing.
    """
    known = _with_depth(read_pieces(spark, path, ","))
    if strict:
        known = known.withColumn("_whole", F.when(F.col("_whole"), True).otherwise(F.raise_error(F.concat(F.lit("brackets or strings do not close in "), F.col("_file"))).cast("boolean")))
    base = F.when(F.col("_root") == "[", 1).when(F.col("_root") == "{", 2)
    pieces = materialize(
        known.filter("_whole").select("_file", "_block", "_n", "value", "_root", (~F.col("_string") & (F.col("_depth") <= base)).alias("_begins"), (~F.col("_string") & (F.col("_depth") < base)).alias("_enters")).filter("_root <> ''"),
        "json_pieces",
    )
    placed = with_last(with_last(pieces, F.col("_begins"), "_element"), F.col("_enters"), "_member")
    parts = F.array_sort(F.collect_list(F.struct("_block", "_n", "value")))
    glued = placed.groupBy("_file", "_root", "_member", "_element").agg(F.array_join(F.transform(parts, lambda p: p["value"]), ",").alias("value"))
    opened = r'^[\s\x{FEFF}]*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*\['
    first = F.col("_member") == F.col("_element")
    heads = glued.filter(first).select("_file", "_root", "_member", F.regexp_extract("value", opened, 1).alias("_key"), (F.col("_root") == "[").alias("_bare"), F.col("value").rlike(opened).alias("_array"))
    rank = F.when(F.col("_key") == "data", 0).otherwise(1)
    usable = F.col("_bare") | F.col("_array")
    chosen = heads.groupBy("_file").agg(
        F.min_by("_member", F.when(F.col("_bare") | (F.col("_array") & (rank == 0)), F.col("_member"))).alias("_named"), F.min("_member").alias("_lead"), F.min_by(usable, F.col("_member")).alias("_fits"),
    )
    member = F.coalesce("_named", F.when(F.col("_fits"), F.col("_lead")))
    kept = glued.join(chosen.select("_file", member.alias("_member")).filter("_member is not null"), ["_file", "_member"])
    lasts = kept.groupBy("_file").agg(F.max("_element").alias("_last"))
    text = F.when(first, F.when(F.col("_root") == "[", F.regexp_replace("value", r"^[\s\x{FEFF}]*\[", "")).otherwise(F.regexp_replace("value", opened, ""))).otherwise(F.col("value"))
    ended = kept.withColumn("value", text).join(lasts, "_file")
    closed = F.when(F.col("_element") == F.col("_last"), F.regexp_replace("value", r"\]\s*\}?\s*$", "")).otherwise(F.col("value"))
    return ended.select("_file", F.col("_element._block").alias("_block"), F.col("_element._n").alias("_n"), F.trim(closed, F.lit(" \t\r\n")).alias("value")).filter("value <> ''")
