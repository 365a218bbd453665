"""SimHash near-dedup by a binary trie self-join.

Distinct fingerprints are joined by walking a trie's nodes in pairs, level by level, adding up differing bits and leaving a
node pair as soon as the budget is exceeded. To deal the walk over tasks, the 64 bits are cut into blocks: of budget + k
blocks, two fingerprints within the budget are equal in k at least. So there is a trie for each choice of k blocks, with
their bits first and no difference allowed in them; its subtrees are walked apart, and each fingerprint goes to one subtree
of each trie. k is the least with which subtrees are small (see `orders`), so copies of a fingerprint are 5 up to some 1e8
fingerprints, 15 up to 3e10, 35 beyond. Subtrees that are large all the same, as fingerprints lie unevenly, are cut into
leaves, and the pairs of nodes above them are walked as a table; nothing of either comes to the driver. A node pair whose
fingerprints are all linked already is left too, so that dense groups cost no pair by pair work, and a task returns a forest
of its links. Components of the forests are found by alternating star operations.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lontar.llm.common import materialize, read, remove, shuffle_partitions, slices
from lontar.llm.shingle_links import similar_links

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Up to so many distinct fingerprints are one trie. More are cut into subtrees, and subtrees over LEAF into leaves of at most
#: LEAF, as far as 64 bits can tell them apart.
WHOLE, LEAF = 4096, 65_536
#: Links that are dealt to a number of tasks that follows their number.
FEW = 2_000_000
#: Bits by which the nodes of large subtrees grow from one table of node pairs to the next.
STEP = 6
#: Most blocks whose equality is asked for: 35 tries for a budget of 4.
MOST = 3


def blocks(budget: int, equal: int = 1) -> list[tuple[int, int]]:
    """(bits before, width) of the budget + equal blocks of 64 bits."""
    n = budget + equal
    ends = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def orders(n: int, budget: int = BUDGET, leaf: int = LEAF, equal: int | None = None) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(bits that may not differ, moves) of each trie over n fingerprints; moves are (from, to, width) of runs of bits, which
    bring the chosen blocks to the front. The number of chosen blocks is the least that leaves half a leaf or less in a
    subtree if fingerprints are even, up to MOST."""
    least = lambda k: min(w for _, w in blocks(budget, k)) * k
    k = equal or next((k for k in range(1, MOST) if n <= leaf // 2 << least(k)), MOST)
    cut, found = blocks(budget, k), []
    for chosen in combinations(range(len(cut)), k):
        moves, to = [], 0
        for i in [*chosen, *(i for i in range(len(cut)) if i not in chosen)]:
            moves.append((cut[i][0], to, cut[i][1]))
            to += cut[i][1]
        found.append((sum(cut[i][1] for i in chosen), moves))
    return found


def moved(prints: np.ndarray, moves: list[tuple[int, int, int]], back: bool = False) -> np.ndarray:
    """Fingerprints with their runs of bits moved (back)."""
    out = np.zeros_like(prints)
    for a, b, width in moves:
        a, b = (b, a) if back else (a, b)
        out |= ((prints << np.uint64(a)) >> np.uint64(64 - width)) << np.uint64(64 - width - b)
    return out


def _moved(fp: Column, moves: list[tuple[int, int, int]]) -> Column:
    out = F.lit(0).cast("long")
    for a, b, width in moves:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.shiftleft(fp, a), 64 - width), 64 - width - b))
    return out


def _mask(start: int, end: int) -> int:
    """Bits start to end, counted from the left, as a signed long."""
    bits = (1 << (64 - start)) - (1 << (64 - end))
    return bits - 2**64 if bits >= 2**63 else bits


def fingerprint(text: str | None) -> bytes:
    """Big-endian fingerprint: bits set in over half of the hashes of the shingles. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(64, np.int64)
    starts, ends = starts[:last].tolist(), (ends[-last:]).tolist()
    for at in range(0, last, 65_536):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * total > last).tobytes()


def _fingerprints(texts: pa.Array) -> pa.Array:
    joined = b"".join(fingerprint(t) for part in slices(texts) for t in part.to_pylist())
    return pa.array(np.frombuffer(joined, ">i8").astype(np.int64))


class _Trie:
    """Levels of a sorted array's binary trie below `depth`: nodes are ranges, and children are numbered in the next level."""

    def __init__(self, prints: np.ndarray, depth: int):
        self.prints, self.depth, self.levels = prints, depth, {}
        self.starts = {depth: np.array([0])}

    def level(self, depth: int):
        """starts, sizes, zero child, one child (-1: none) of the nodes at a depth."""
        if depth not in self.levels:
            if depth == 64:
                starts, n = self.starts[64], len(self.prints)
                none = np.full(len(starts), -1)
                self.levels[64] = starts, np.diff(starts, append=n), none, none
            else:
                starts = self.starts[depth]
                bit = (self.prints >> np.uint64(63 - depth)) & np.uint64(1)
                rises = np.flatnonzero((bit[1:] == 1) & (bit[:-1] == 0)) + 1
                below = np.union1d(starts, rises)
                self.starts[depth + 1] = below
                first = np.searchsorted(below, starts)
                width = np.diff(first, append=len(below))
                ones = bit[starts] == 1
                self.levels[depth] = starts, np.diff(starts, append=len(self.prints)), np.where(ones, -1, first), np.where(width == 2, first + 1, np.where(ones, first, -1))
        return self.levels[depth]


class Links:
    """Union-find over positions that keeps the pairs which joined two classes."""

    def __init__(self, n: int):
        self.label, self.forest, self.version = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            high, one = np.unique(np.maximum(a, b), return_index=True)
            self.forest.append((i[one], j[one]))
            parent = np.arange(len(self.label))
            parent[high] = np.minimum(a, b)[one]
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label, self.version = parent[self.label], self.version + 1


def trie_join(left: np.ndarray, right: np.ndarray | None, budget: int = BUDGET, equal: int = 0, chunk: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between two sorted leaves (right None: within one), as two arrays of fingerprints.

    Both tries are walked from the root, whose nodes above a leaf's depth have one child. The first `equal` bits may not differ.
    """
    same = right is None
    a, b = _Trie(left, 0), None
    b = a if same else _Trie(right, 0)
    both = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    links = Links(len(both))
    stack = [(0, np.array([0]), np.array([0]), np.array([budget], np.int8))]
    while stack:
        depth, x, y, rest = stack.pop()
        if len(x) > chunk:
            for at in range(0, len(x), chunk):
                stack.append((depth, x[at : at + chunk], y[at : at + chunk], rest[at : at + chunk]))
            continue
        sa, na, a0, a1 = a.level(depth)
        sb, nb, b0, b1 = b.level(depth)
        if links.version and len(x) > 512:  # leave node pairs that are one class already
            la, lb = links.label[: len(left)], links.label[shift : shift + len(b.prints)]
            low_a, high_a = np.minimum.reduceat(la, sa), np.maximum.reduceat(la, sa)
            low_b, high_b = np.minimum.reduceat(lb, sb), np.maximum.reduceat(lb, sb)
            todo = ~((low_a == high_a)[x] & (low_b == high_b)[y] & (low_a[x] == low_b[y]))
            x, y, rest = x[todo], y[todo], rest[todo]
        small = (na[x] * nb[y] <= 64) | (depth == 64)
        if small.any():
            _compare(a, b, sa, na, sb, nb, x[small], y[small], budget, same, shift, links)
            x, y, rest = x[~small], y[~small], rest[~small]
        if not len(x):
            continue
        following = []
        for ca, cb, cost in ((a0, b0, 0), (a1, b1, 0), (a0, b1, 1), (a1, b0, 1)):
            if cost and depth < equal:
                continue
            i, j = ca[x], cb[y]
            fine = (i >= 0) & (j >= 0) & (rest >= cost)
            if same:
                fine &= i <= j
            following.append((i[fine], j[fine], rest[fine] - cost))
        x, y, rest = (np.concatenate(c) for c in zip(*following, strict=True))
        if len(x):
            stack.append((depth + 1, x, y, rest))
    if not links.forest:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    i, j = (np.concatenate(c) for c in zip(*links.forest, strict=True))
    return both[i], both[j]


def _compare(a, b, sa, na, sb, nb, x, y, budget, same, shift, links) -> None:
    """All pairs of the two ranges of small node pairs, at most 64 each, in blocks."""
    sizes = na[x] * nb[y]
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // 2_000_000)) + 1).tolist(), len(x)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        p, q, n = x[lo:hi], y[lo:hi], sizes[lo:hi]
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = nb[q][which]
        i, j = sa[p][which] + k // width, sb[q][which] + k % width
        near = np.bitwise_count(a.prints[i] ^ b.prints[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            links.add(i[near], j[near] + shift)


def node_pairs(placed: DataFrame, heavy: DataFrame, equal: list[int], depth: int, budget: int = BUDGET, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(leaves, pairs) below the nodes (t, p) of `heavy`, which begin with `depth` equal bits: each fingerprint (t, a) of these
    nodes with its leaf (p: its first bits, pd: how many), and the pairs (t, p, pd, q, qd) of leaves whose common bits
    differ in at most `budget`, and not in the first equal[t] of trie t.

    Pairs of nodes are walked together, STEP bits at a time. Both are tables, made anew a level; the levels end where no node
    holds more than `leaf` fingerprints, at 64 bits at the latest."""
    alive = materialize(placed.withColumn("p", F.col("a").bitwiseAND(F.lit(_mask(0, depth)))).join(heavy.select("t", "p"), ["t", "p"], "left_semi"), "simhash_alive")
    pairs = materialize(heavy.select("t", "p", F.lit(depth).alias("pd"), F.lit(True).alias("pin"), F.col("p").alias("q"), F.lit(depth).alias("qd"), F.lit(True).alias("qin"), F.lit(budget).alias("rest")), "simhash_pairs")
    fixed = F.element_at(F.array(*(F.lit(_mask(0, e)) for e in equal)), F.col("t") + 1)
    leaves, ended = [], []
    while True:
        deeper = min(depth + STEP, 64)
        below = alive.withColumn("c", F.col("a").bitwiseAND(F.lit(_mask(0, deeper))))
        kids = materialize(below.groupBy("t", "p", "c").agg((F.count("*") > leaf).alias("cin")), "simhash_nodes")
        leaves.append(materialize(below.join(kids.filter("not cin").select("t", "c"), ["t", "c"], "left_semi").select("t", "a", F.col("c").alias("p"), F.lit(deeper).alias("pd")), "simhash_leaves"))
        left = pairs.join(kids, ["t", "p"]).select("t", F.col("c").alias("p"), F.lit(deeper).alias("pd"), F.col("cin").alias("pin"), "q", "qd", "qin", "rest", (F.col("p") == F.col("q")).alias("one"))
        right = kids.select("t", F.col("p").alias("q"), "c", "cin")
        apart = F.col("p").bitwiseXOR(F.col("c"))
        cost = F.bit_count(apart.bitwiseAND(F.lit(_mask(depth, deeper))))
        both = left.filter("qin").join(right, ["t", "q"]).filter((cost <= F.col("rest")) & (apart.bitwiseAND(fixed) == 0) & (~F.col("one") | (F.col("p") <= F.col("c"))))
        both = both.select("t", "p", "pd", "pin", F.col("c").alias("q"), F.lit(deeper).alias("qd"), F.col("cin").alias("qin"), (F.col("rest") - cost).alias("rest"))
        alone = left.filter("not qin").drop("one")  # the leaf's further bits are not known here
        # a node that goes on comes first
        turned = F.col("qin") & ~F.col("pin")
        walked = both.unionByName(alone).select("t", *(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("p", "q"), ("pd", "qd"), ("pin", "qin"), ("q", "p"), ("qd", "pd"), ("qin", "pin"))), "rest")
        found = materialize(walked, "simhash_pairs")
        ended.append(found.filter("not pin").select("t", "p", "pd", "q", "qd"))
        going = materialize(below.join(kids.filter("cin").select("t", "c"), ["t", "c"], "left_semi").select("t", F.col("c").alias("p"), "a"), "simhash_alive")
        remove(alive, kids)
        alive, pairs, depth = going, found.filter("pin"), deeper
        if depth == 64 or going.isEmpty():
            remove(alive)
            union = lambda parts: parts[0] if len(parts) == 1 else union(parts[:-1]).unionByName(parts[-1])
            return union(leaves), union(ended)


def fingerprint_links(prints: DataFrame, budget: int = BUDGET, leaf: int = LEAF, whole: int = WHOLE, equal: int | None = None) -> DataFrame:
    """Links u, v between distinct fingerprints (column fp) of at most `budget` differing bits: a forest for each subtree or
    pair of leaves, so components are whole, and no more links than fingerprints dealt out. `equal` sets the number of
    blocks whose equality is asked for; else it follows from the number of fingerprints."""
    n = prints.count()
    tries = [(0, [(0, 0, 64)])] if n <= whole else orders(n, budget, leaf, equal)
    equals = [e for e, _ in tries]
    depth = min(min(equals), max(0, (4 * n // leaf).bit_length()))
    arranged = F.array(*(_moved(F.col("fp"), moves) for _, moves in tries))
    placed = prints.select(F.posexplode(arranged).alias("t", "a"))

    def join(t: int, sides: list[np.ndarray]) -> pd.DataFrame:
        left, *right = (np.sort(side.view(np.uint64)) for side in sides)
        u, v = trie_join(left, right[0] if right else None, budget, equals[t])
        return pd.DataFrame({"u": moved(u, tries[t][1], True).view(np.int64), "v": moved(v, tries[t][1], True).view(np.int64)})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return join(int(pdf.t.iloc[0]), [pdf.a.to_numpy()])

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        t, p, pd_, q, qd = pdf.iloc[0][["t", "p", "pd", "q", "qd"]].tolist()
        return join(int(t), [pdf.a[pdf.side == side].to_numpy() for side in ((0,) if (p, pd_) == (q, qd) else (0, 1))])

    inside = placed.withColumn("p", F.col("a").bitwiseAND(F.lit(_mask(0, depth))))
    heavy = None
    if n > leaf:
        heavy = materialize(inside.groupBy("t", "p").count().filter(F.col("count") > leaf), "simhash_heavy")
        heavy = None if heavy.isEmpty() else heavy
    parts = max(shuffle_partitions(prints.sparkSession), min(len(tries) << depth, len(tries) * n // 1_000_000 + 1))
    light = inside if heavy is None else inside.join(heavy, ["t", "p"], "left_anti")
    links = light.repartition(parts, "t", "p").groupBy("t", "p").applyInPandas(within, "u long, v long")
    if heavy is None:
        return links
    leaves, pairs = node_pairs(placed, heavy, equals, depth, budget, leaf)
    second = pairs.filter("p != q or pd != qd").select("t", F.col("q").alias("_p"), F.col("qd").alias("_pd"), "p", "pd", "q", "qd")
    named = leaves.select("t", F.col("p").alias("_p"), F.col("pd").alias("_pd"), "a")
    first = pairs.select("t", F.col("p").alias("_p"), F.col("pd").alias("_pd"), "p", "pd", "q", "qd")
    sides = [named.join(x, ["t", "_p", "_pd"]).select("t", "p", "pd", "q", "qd", F.lit(i).alias("side"), "a") for i, x in enumerate((first, second))]
    unit = ["t", "p", "pd", "q", "qd"]
    return links.unionByName(sides[0].unionByName(sides[1]).repartition(parts, *unit).groupBy(*unit).applyInPandas(between, "u long, v long"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root (smallest node that links reach) for every node with a link, by large-star and small-star rounds.

    A round ends in a table in the shared folder; rounds stop when the links don't change. Rounds are about log2 of the
    longest shortest path, squared at worst.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), name)
    n, state = edges.count(), None
    # few links need few tasks; many are left to the session's partitions, which AQE may split where a node has most of them
    dealt = (lambda df: df.repartition(n // 100_000 + 1, "u")) if n < FEW else (lambda df: df)
    while True:
        both = dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(dealt(both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), name)
        again = dealt(large)
        small = again.join(again.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        found = materialize(dealt(small.select(pairs.alias("e")).select("e.u", "e.v").filter("u != v")).distinct(), name)
        remove(edges, large)
        edges = found
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, leaf: int = LEAF, similar: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (hex), component_id, component (its least fingerprint), text_hash.

    Whole texts are read, however long; null and empty ones have fingerprint zero and link like any other. component_id is the smallest doc_id reachable; null
    ids don't count for it, and it is null where a component has no other. Repeated rows are in one component. Other
    columns are left out; an empty table gives no row. Distinct fingerprints alone are joined, so copies cost nothing.
    With `similar`, texts whose five-word shingles have Jaccard similarity 0.8 or more are linked too.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    rows = materialize(named.select("doc_id", F.arrow_udf(_fingerprints, "long")("_text").alias("fp"), F.xxhash64("_text").alias("text_hash")), "simhash_rows")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "simhash_prints")
    links = fingerprint_links(prints, budget, leaf)
    if similar:
        prints_of = rows.select(F.col("text_hash").alias("id"), "fp").distinct()
        links = similar_links(named.select(F.xxhash64("_text").alias("id"), "_text"), prints_of, materialize(links, "simhash_links"), components)
    roots = materialize(components(links), "simhash_roots")
    whole = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    reach = whole.groupBy("root").agg(F.min("smallest").alias("component_id"))
    found = materialize(whole.select("fp", "root").join(reach, "root").select("fp", "root", "component_id"), "simhash_components")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(found, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("root").alias("component"), "text_hash")


def representatives(found: DataFrame) -> DataFrame:
    """doc_id, text_hash of the document that stays for each component of simhash_dedup's rows: the one with the smallest
    doc_id, of equal ones the one with the smallest hash. A component without ids keeps one of its documents too."""
    least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"))
    return least.select("s.doc_id", "s.text_hash")


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_dedup(read(spark, sf_dir, "documents"))
