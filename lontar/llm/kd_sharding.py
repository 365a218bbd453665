"""Sharding by a k-d tree: leaves are split at weighted medians along their widest metadata dimension.

Dimensions are comparable: language and source are places on a line of all bytes, each value as long as its share of them, so
a node's extent there is the share of the corpus that its values span; size is a document's place between the least and the
largest logarithm. Points are groups of equal texts, weighted by bytes, so copies share a shard. Groups of copies heavier than GROUP_SHARE of
a shard would upset the medians, so they are placed first, whole where a shard has room within TOLERANCE, else in as few
equal parts as fit; the tree's cuts then aim at the room that is left in the shards of each side. Each level finds all nodes' medians at once: a
histogram of weights over the sort key is narrowed around the median, and only bins (bounded) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm.common import gapless, materialize, read, salts_for

SHARDS = 16
#: Bins of one histogram round, and the share of a shard from which a group of copies is placed before the tree.
BINS, GROUP_SHARE = 1024, 0.02
#: What a shard may hold over the mean.
TOLERANCE = 0.08
#: Sort keys are below 2**55: 24 bits of the dimension, 31 bits of a hash that breaks ties.
_TIE = 31

DIMENSIONS = ("d_size", "d_lang", "d_source")


def place(groups: list[tuple[str, int, int]], mean: float, shards: int) -> tuple[list[tuple[str, int, int, int]], list[float]]:
    """For groups (name, rows, bytes): (name, parts, part, shard), and the bytes that each shard got. Largest first, each
    part to the emptiest shard, in the least number of parts that all fit; a group that never fits in as many parts as
    there are shards is dealt over all of them."""
    placed, held = [], [0.0] * shards
    for name, n, size in sorted(groups, key=lambda x: (-x[2], x[0])):
        for parts in range(1, min(n, shards) + 1):
            emptiest = sorted(range(shards), key=lambda k: (held[k], k))[:parts]
            weights = [(n // parts + (i < n % parts)) * (size / n) for i in range(parts)]
            if parts == min(n, shards) or all(held[k] + w <= (1 + TOLERANCE) * mean for k, w in zip(emptiest, weights, strict=True)):
                break
        for i, (k, w) in enumerate(zip(emptiest, weights, strict=True)):
            placed.append((name, parts, i, k))
            held[k] += w
    return placed, held


def _points(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """Documents with the shard of their group's part where it is placed already, points (other groups) with weight and
    dimensions scaled to 0 .. 2**24 - 1, and the room left in each shard."""
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("size").alias("one"))
    groups = materialize(groups, "kd_groups")
    total, least, most = groups.agg(F.sum("w"), F.log2(F.min("one").cast("double")), F.log2(F.max("one").cast("double"))).first()
    mean = (total or 0) / shards
    heavy = groups.filter((F.col("n") > 1) & (F.col("w") > max(1, GROUP_SHARE * mean)))
    given = [(r.g, r.n, r.w) for r in heavy.select("g", "n", "w").collect()]  # at most shards / GROUP_SHARE
    placed, held = place(given, mean, shards)
    parts = rows.sparkSession.createDataFrame(placed, "g string, parts int, part int, placed int")
    named = rows.join(F.broadcast(parts.filter("part = 0").select("g", "parts")), "g", "left")
    whole = named.filter("parts is null or parts = 1").withColumn("part", F.lit(0))
    split = named.filter("parts > 1").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "row_tie"), F.lit(salts_for(max((n for _, n, _ in given), default=0)))))
    split = gapless(split, ["g"], "_salt", [F.col("doc_id"), F.col("row_tie")], "_rank").withColumn("part", (F.col("_rank") % F.col("parts")).cast("int"))
    dealt = whole.unionByName(split.drop("_salt", "_rank")).join(F.broadcast(parts.drop("parts")), ["g", "part"], "left").drop("part", "parts")
    scale = lambda c: F.least(F.lit(2**24 - 1), F.greatest(F.lit(0), F.floor(c * F.lit(2**24)))).cast("long")
    size = (F.log2(F.col("one").cast("double")) - F.lit(least or 0.0)) / F.lit(max((most or 0.0) - (least or 0.0), 1e-9))
    points = groups.join(F.broadcast(parts), "g", "left_anti")
    for name in ("lang", "source"):
        points = points.join(_line(groups, name, total or 1), F.col(name).eqNullSafe(F.col("_value"))).drop("_value").withColumn(f"d_{name}", scale(F.col("_at"))).drop("_at")
    points = points.select("g", "w", scale(size).alias("d_size"), "d_lang", "d_source", F.pmod(F.xxhash64("g"), F.lit(2**_TIE)).alias("tie"))
    return dealt, points, [max(0.0, mean - h) for h in held]


def _line(groups: DataFrame, name: str, total: int) -> DataFrame:
    """_value, _at: where each value of a column begins on a line on which values, by name, are as long as their bytes' share.
    Values are cut into ranges, so that sources may be many."""
    weights = groups.groupBy(F.col(name).alias("_value")).agg(F.sum("w").alias("_w"))
    held = materialize(weights.repartitionByRange("_value").withColumn("_part", F.spark_partition_id()), "kd_line")
    sums = held.groupBy("_part").agg(F.sum("_w").alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))  # one row a range
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy("_value")) - F.col("_w")
    return held.withColumn("_in", inside).join(F.broadcast(before), "_part").select("_value", ((F.col("_in") + F.col("_before")) / F.lit(float(total))).alias("_at"))


def _at_nodes(points: DataFrame, columns: str, rows: list[tuple]) -> DataFrame:
    """Points with columns of their node, from a table of one row a node, and their `key` along its axis.

    The rows are data of the plan, not literals in its expressions, so every round runs the same generated code."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in rows)
    nodes = points.sparkSession.sql(f"SELECT * FROM VALUES {values} AS n(node, axis, {columns})")
    key = F.element_at(F.array(*DIMENSIONS), F.col("axis").cast("int") + 1) * F.lit(2**_TIE) + F.col("tie")
    return points.join(F.broadcast(nodes), "node").withColumn("key", key)  # at most `shards` rows


def _medians(points: DataFrame, nodes: dict[int, tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """For each node (axis, smallest and largest key, the weight its left side should get): node, axis, and the key up to which rows go left.

    A round counts weights in BINS bins of each node's range and narrows the range to the keys of the bin that holds the
    median, until that is one key or weighs too little to matter. Two or three rounds do.
    """
    cut, state = [], {n: (axis, lo, hi, 0, half) for n, (axis, lo, hi, half) in nodes.items()}
    while state:
        held = _at_nodes(points, "lo, hi", [(n, axis, lo, hi) for n, (axis, lo, hi, *_) in state.items()])
        step = F.floor((F.col("hi") - F.col("lo")) / BINS) + 1
        binned = held.filter((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))).withColumn("bin", F.floor((F.col("key") - F.col("lo")) / step))
        rows = binned.groupBy("node", "bin").agg(F.sum("w").alias("w"), F.min("key").alias("low"), F.max("key").alias("high")).collect()  # at most nodes * BINS
        for n, (axis, _, hi, below, half) in list(state.items()):
            seen = below
            for r in sorted((r for r in rows if r.node == n), key=lambda r: r.low):
                if seen + r.w >= half:
                    if r.low == r.high or r.w <= 0.0005 * half:
                        cut.append((n, axis, r.high if seen + r.w - half <= half - seen else r.low - 1))
                        del state[n]
                    else:
                        state[n] = (axis, r.low, r.high, seen, half)
                    break
                seen += r.w
            else:
                cut.append((n, axis, hi))
                del state[n]
    return cut


def _left_share(room: list[float]) -> float:
    left, total = sum(room[: len(room) // 2]), sum(room)
    return left / total if total else 0.5


def kd_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    shards is a power of two. Size is the text's UTF-8 bytes plus 1; null text counts as empty, null lang and source are
    values like any others, and null ids too. Whole texts count, however long; one longer than a shard's share makes its shard
    larger. Equal texts share a shard unless no shard has room for all of them within TOLERANCE of the mean. Rows equal in id
    and text may swap slots. Other columns are left out; an empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("g"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        ).withColumn("row_tie", F.xxhash64("lang", "source")),
        "kd_rows",
    )
    dealt, points, room = _points(rows, shards)
    points = materialize(points.withColumn("node", F.lit(0).cast("long")), "kd_points")
    ends = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    span = shards
    while span > 1:
        nodes = {}
        for r in points.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect():
            axis = max(range(len(DIMENSIONS)), key=lambda a: r[f"max_{DIMENSIONS[a]}"] - r[f"min_{DIMENSIONS[a]}"])
            d = DIMENSIONS[axis]
            nodes[r.node] = (axis, r[f"min_{d}"] << _TIE, ((r[f"max_{d}"] + 1) << _TIE) - 1, r.w * _left_share(room[r.node * span : (r.node + 1) * span]))
        span //= 2
        if not nodes:
            break
        split = _at_nodes(points, "cut", _medians(points, nodes))
        points = materialize(split.withColumn("node", F.col("node") * 2 + (F.col("key") > F.col("cut")).cast("long")).select(*points.columns), "kd_points")
    done = dealt.filter("placed is not null").withColumn("shard", F.col("placed").cast("long")).drop("placed")  # large groups stay out of the join
    found = dealt.filter("placed is null").drop("placed").join(points.select("g", F.col("node").alias("shard")), "g")
    placed = done.unionByName(found).withColumn("spread", F.pmod(F.xxhash64("doc_id", "g"), F.lit(salts_for(rows.count() // shards))))
    slots = gapless(placed, ["shard"], "spread", [F.col("doc_id"), F.col("g"), F.col("row_tie")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_kd_sharding(spark, sf_dir: str) -> DataFrame:
    return kd_shards(read(spark, sf_dir, "documents"))
