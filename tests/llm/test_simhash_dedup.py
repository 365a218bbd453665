from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lontar.llm.simhash_dedup import blocks, components, fingerprint, fingerprint_links, moved, node_pairs, op10_simhash_dedup, orders, simhash_dedup, trie_join
from tests.llm.cases import awkward, frame, table


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    prints, parent = list(prints), {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                parent[find(p)] = find(q)
    return {p: find(p) for p in prints}


def brute(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    root = classes({f for _, f in fps})
    least = defaultdict(lambda: None)
    for i, f in fps:
        if i is not None and (least[root[f]] is None or i < least[root[f]]):
            least[root[f]] = i
    return Counter((i, f"{f:016x}", least[root[f]]) for i, f in fps)


def test_awkward(spark):
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    assert Counter(tuple(r)[:3] for r in simhash_dedup(frame(spark, rows)).collect()) == brute([(r[0], r[1]) for r in rows])
    assert len(simhash_dedup(frame(spark, awkward())).collect()) == len(awkward())


def test_empty(spark):
    assert simhash_dedup(frame(spark, [])).collect() == []


def test_table(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in table(tables, "documents")]
    assert Counter(tuple(r)[:3] for r in op10_simhash_dedup(spark, tables).collect()) == brute(rows)
    assert Counter(tuple(r)[:3] for r in simhash_dedup(spark.read.parquet(f"{tables}/documents.parquet"), leaf=20).collect()) == brute(rows)


def test_long_fingerprint():
    text = " ".join(f"a{i * i % 9973}" for i in range(3000))
    assert int.from_bytes(fingerprint(text), "big") == slow_fingerprint(text)


def grouped(pairs, all_):
    parent = {int(p): int(p) for p in all_}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for u, v in pairs:
        parent[find(int(u))] = find(int(v))
    groups = defaultdict(set)
    for p in parent:
        groups[find(p)].add(p)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_the_same_classes_as_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 40, np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8))])
    dense = np.uint64(12345) ^ rng.integers(0, 256, 300).astype(np.uint64)
    prints = np.unique(np.concatenate([near, dense, rng.integers(0, 2**64, 500, np.uint64)]))
    want = defaultdict(set)
    for p, r in classes([int(x) for x in prints]).items():
        want[r].add(p)
    u, v = trie_join(prints, None, chunk=97)
    assert grouped(zip(u, v, strict=True), prints) == {frozenset(g) for g in want.values()}
    assert len(u) < len(prints) and all((int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(u, v, strict=True))


def test_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 150, np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(0b1011 << 40), np.uint64(7 << 58) ^ rng.integers(0, 64, 60).astype(np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    want = defaultdict(set)
    for p, r in classes([int(x) for x in prints]).items():
        want[r].add(p)
    for options in ({"leaf": 30}, {"leaf": 30, "whole": 0}, {"leaf": 8, "whole": 0}, {"whole": 0}, {"whole": 0, "equal": 2}, {"leaf": 8, "whole": 0, "equal": 3}):
        links = [(r.u % 2**64, r.v % 2**64) for r in fingerprint_links(df, **options).collect()]
        assert all((u ^ v).bit_count() <= 4 for u, v in links)
        assert grouped(links, prints) == {frozenset(g) for g in want.values()}


def test_blocks_and_moves():
    assert sum(w for _, w in blocks(4)) == 64 and [a for a, _ in blocks(4)] == [0, 12, 25, 38, 51]
    prints = np.random.default_rng(1).integers(0, 2**64, 50, np.uint64)
    for equal, tries in ((1, 5), (2, 15), (3, 35)):
        assert len(orders(0, equal=equal)) == tries
        for _, moves in orders(0, equal=equal):
            assert np.array_equal(moved(moved(prints, moves), moves, True), prints)


def test_near_fingerprints_share_the_front_of_a_trie():
    rng = np.random.default_rng(2)
    one = rng.integers(0, 2**64, 500, np.uint64)
    other = one.copy()
    for _ in range(4):
        other ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    for equal in (1, 2, 3):
        shared = [moved(one, moves) >> np.uint64(64 - width) == moved(other, moves) >> np.uint64(64 - width) for width, moves in orders(0, equal=equal)]
        assert np.any(shared, axis=0).all()


def test_copies_of_a_fingerprint_are_bounded():
    """An even subtree holds half a leaf at most while copies go 5, 15, 35; they don't double with the corpus."""
    for n, copies in ((1e4, 5), (1e8, 5), (1e9, 15), (1e10, 15), (3e10, 15), (1e11, 35), (1e12, 35)):
        tries = orders(int(n))
        assert len(tries) == copies and n / 2 ** min(width for width, _ in tries) <= 32_768


@pytest.mark.parametrize("equal", [0, 3])
def test_node_pairs_are_those_of_all_pairs(spark, equal):
    rng = np.random.default_rng(equal)
    prints = np.unique(rng.integers(0, 2**64, 400, np.uint64) >> rng.integers(0, 3, 400).astype(np.uint64))
    placed = spark.createDataFrame([(0, int(p)) for p in prints.view(np.int64)], "t int, a long")
    leaves, pairs = node_pairs(placed, spark.createDataFrame([(0, 0)], "t int, p long"), [equal], 0, 4, 9)
    held = Counter((r.p % 2**64, r.pd) for r in leaves.collect())
    assert sum(held.values()) == len(prints) and max(held.values()) <= 9
    spans = sorted((p, p + (1 << (64 - m))) for p, m in held)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    want = set()
    for p, m in held:
        for q, k in held:
            apart = (p ^ q) >> (64 - min(m, k))
            if apart.bit_count() <= 4 and not ((p ^ q) >> (64 - equal)):
                want.add(frozenset([(p, m), (q, k)]))
    found = [frozenset([(r.p % 2**64, r.pd), (r.q % 2**64, r.qd)]) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(-7, 5000), (5000, 4000)] + [(9, 9)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).select(F.col("node"), F.col("root")).collect()))
    assert all(found[i] == 0 for i in range(61)) and all(found[k] == 1000 for k in range(1000, 1100)) and found[4000] == found[5000] == found[-7] == -7
