"""Pairs of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, by prefix filtering.

Shingles are put into one order for all texts, rare ones first. Two texts as similar as that share one of the first
n // 5 + 1 shingles of each, whatever the order, so no pair is lost; a sample tells which shingles are frequent and decides
nothing else. What stands before the first shingle that two texts share is in one of them only, so its places bound what
they can have in common. Candidates must also pass a bound by parity bitmaps (the bits in which two bitmaps differ are no more than the
shingles in which the sets differ), and are then verified on their whole sets. Pairs between texts that are linked already
are left out, so that a dense group costs about two candidates a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lontar.llm.common import materialize, piecewise, remove

WORDS, SEED = 5, 42
#: One text in so many, by hash, is counted to find frequent shingles; those of three such texts or more are ranked last.
SAMPLE = 8
#: Bits of the smallest and largest table of levels (log2 of counts), a byte each, that goes to the workers.
LEVELS = (16, 24)
#: Bits of the smallest and largest parity bitmap; it has two bits a shingle or more in between.
BITMAP = (64, 1 << 18)
#: Word hashes that a worker remembers.
_REMEMBERED = 100_000
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_known: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a shorter text is one shingle, and no words give none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_known) > _REMEMBERED:
        _known.clear()
    for w in set(found).difference(_known):
        _known[w] = xxh64_intdigest(w, SEED)
    hashes = np.fromiter(map(_known.__getitem__, found), np.uint64, len(found))
    last = max(min(1, len(hashes)), len(hashes) - WORDS + 1)
    total = np.zeros(last, np.uint64)
    for k in range(min(WORDS, len(hashes))):
        total += hashes[k : k + last] * _FACTORS[k]
    return np.unique((total ^ (total >> np.uint64(33))).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _sets(text: Column) -> Column:
    def made(texts: pa.Array) -> pa.Array:
        return piecewise(lambda part: _lists(list(map(shingles, part))), texts, pa.list_(pa.int64()))

    return F.arrow_udf(made, "array<long>")(text)


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap as longs: a bit is set if an odd number of the shingles fall on it. The half of a bitmap with twice the bits,
    xor the other half, is the bitmap with these bits."""
    low, high = BITMAP
    bits = min(high, max(low, 1 << int(2 * len(s)).bit_length()))
    odd = (np.bincount(s & (bits - 1), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def apart(a: Column, b: Column) -> Column:
    """Bits in which two parity bitmaps differ, the larger one folded; 0 if one is over twice the other."""
    n, m = F.size(a), F.size(b)
    w = F.least(n, m)
    folded = lambda x: F.when(F.size(x) == w, x).otherwise(F.zip_with(F.slice(x, 1, w), F.slice(x, w + 1, w), lambda p, q: p.bitwiseXOR(q)))
    differ = F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)
    return F.when(F.greatest(n, m) > 2 * w, 0).otherwise(differ)


def _profiles(text: Column, levels: np.ndarray) -> Column:
    """n (shingles), p (the first of them in the common order), b (parity bitmap)."""
    mask = len(levels) - 1

    def first(s: np.ndarray) -> np.ndarray:
        return s[np.lexsort((s, levels[s & mask]))[: len(s) // 5 + 1]]

    kind = pa.struct([("n", pa.int32()), ("p", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def part_of(texts: list) -> pa.Array:
        sets = list(map(shingles, texts))
        fields = pa.array(np.array(list(map(len, sets)), np.int32)), _lists(list(map(first, sets))), _lists(list(map(parity, sets)))
        return pa.StructArray.from_arrays(fields, ["n", "p", "b"])

    def made(texts: pa.Array) -> pa.Array:
        return piecewise(part_of, texts, kind)

    return F.arrow_udf(made, "struct<n:int,p:array<long>,b:array<long>>")(text)


def _levels(texts: DataFrame) -> np.ndarray:
    """A byte for each value of a shingle's low bits: log2 of how often the sample has the most frequent of its shingles, 0
    for under three. The table grows with the shingles it has to tell apart, up to a bound."""
    sample = texts.filter(F.pmod("id", F.lit(SAMPLE)) == 0)
    counts = sample.select(F.explode(_sets(F.col("_text"))).alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n > 2")
    counts = materialize(counts, "near_frequent")
    low, high = LEVELS
    bits = min(high, max(low, (8 * counts.count()).bit_length()))
    rows = counts.groupBy(F.expr(f"g & {(1 << bits) - 1}").alias("at")).agg(F.floor(F.log2(F.max("n").cast("double"))).cast("byte").alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    levels[rows["at"].to_numpy()] = rows["level"].to_numpy()
    remove(counts)
    return levels


def _possible(n: str, i: str) -> str:
    """SQL: a shared shingle at place i of n of one text, and at `i` of `n` of the other, leaves room for 4 / 9 of both in common
    (which is a similarity of 0.8), as nothing before is shared. A similar pair passes with the first shingle it shares."""
    return f"5 * {n} >= 4 * n AND 5 * n >= 4 * {n} AND 9 * least({n} - {i}, n - i) >= 4 * ({n} + n)"


def _verified(texts: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links u, v (fingerprints) of the pairs a, b (ids) that are similar enough: by bitmaps, then by whole sets."""
    side = lambda i, f: profiles.select(F.col("id").alias(i), F.col("fp").alias(f), F.col("n").alias(f"n{i}"), F.col("b").alias(f"b{i}"))
    near = pairs.join(side("a", "u"), "a").withColumnsRenamed({"ba": "_ba"}).join(side("b", "v"), "b").filter("u != v")
    near = materialize(near.filter(9 * apart(F.col("_ba"), F.col("bb")) <= F.col("na") + F.col("nb")).select("a", "b", "u", "v"), "near_pairs")
    wanted = materialize(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near_wanted")
    sets = materialize(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]).select("id", _sets(F.col("_text")).alias("s")), "near_sets")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    found = both.withColumn("c", F.size(F.array_intersect("sa", "sb"))).filter(5 * F.col("c") >= 4 * (F.size("sa") + F.size("sb") - F.col("c")))
    links = materialize(found.select("u", "v").distinct(), "near_links")
    remove(near, wanted, sets)
    return links


def similar_links(texts: DataFrame, prints: DataFrame, links: DataFrame, components) -> DataFrame:
    """links (u, v: fingerprints) and those of similar texts. texts: id (hash of the text), _text; prints: id, fp.

    First each text meets two that have most of its shingles where they have the fewest rare ones before them (of copies with
    changes, the least changed), or are the smallest; what is still in different components after that is compared pair by pair.
    """
    levels = _levels(texts)
    rows = texts.select("id", _profiles(F.col("_text"), levels).alias("x")).groupBy("id").agg(F.first("x").alias("x"))
    profiles = materialize(rows.join(prints, "id").select("id", "fp", "x.n", "x.p", "x.b"), "near_profiles")
    flat = profiles.select("id", "n", F.posexplode("p").alias("i", "g"))
    groups = flat.groupBy("g").agg(F.count("*").alias("k"), F.min(F.struct("i", "n", "id")).alias("first"), F.min(F.struct("n", "i", "id")).alias("least")).filter("k > 1").drop("k")
    postings = materialize(flat.join(groups, "g"), "near_postings")

    other = lambda r, c: F.struct(F.lit(r).alias("r"), *(F.col(f"{c}.{k}").alias(k) for k in ("i", "n", "id")))
    met = postings.select("id", "n", "i", F.explode(F.array(other(0, "first"), other(1, "least"))).alias("o")).filter("o.id != id").filter(_possible("o.n", "o.i"))
    best = met.groupBy("id", "o.r", F.col("o.id").alias("o")).agg(F.count("*").alias("k")).groupBy("id", "r").agg(F.max(F.struct("k", "o")).alias("m"))
    tried = materialize(best.select(F.least("id", "m.o").alias("a"), F.greatest("id", "m.o").alias("b")).distinct(), "near_tried")
    first = materialize(links.select("u", "v").unionByName(_verified(texts, profiles, tried)).distinct(), "near_first")

    roots = components(first).withColumnRenamed("node", "fp")
    rooted = profiles.select("id", "fp").join(roots, "fp", "left").select("id", F.coalesce("root", "fp").alias("root"))
    placed = materialize(postings.select("g", "id", "n", "i").join(rooted, "id"), "near_placed")
    # a group that is one component by now has no pair to compare
    mixed = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("g")
    open_ = materialize(placed.join(mixed, "g", "left_semi"), "near_open")
    left = open_.select("g", *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "i", "root")))
    rest = left.join(open_, (left["g"] == open_["g"]) & F.expr("root_a != root AND id_a < id") & F.expr(_possible("n_a", "i_a")))
    rest = materialize(rest.select(F.col("id_a").alias("a"), F.col("id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "near_rest")
    found = materialize(first.unionByName(_verified(texts, profiles, rest)).distinct(), "near_found")
    remove(postings, tried, first, placed, open_, rest, profiles)
    return found
