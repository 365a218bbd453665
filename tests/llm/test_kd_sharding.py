import zlib
from collections import Counter, defaultdict

from lontar.llm.kd_sharding import SHARDS, kd_shards, op5_kd_sharding, place
from tests.llm.cases import awkward, frame, table


def check(found, rows, near=0.08):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in found:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(SHARDS))
    if near:
        mean = sum(sizes.values()) / SHARDS
        assert max(abs(sizes[k] - mean) for k in range(SHARDS)) <= near * mean + max(r["size"] for r in found), sizes
    assert {r.law for r in found} <= {"bytes"}


def test_awkward(spark):
    rows = awkward()
    check(kd_shards(frame(spark, rows)).collect(), [(r[0], r[1]) for r in rows], None)


def test_hot_group_is_dealt_and_small_groups_stay_together(spark):
    rows = [(i, "the hot text of this corpus" if i % 3 == 0 else f"text number {i // 6} " * (i % 6 // 3 + 1), "en", f"s{i % 4}", 0, None, None, None, None) for i in range(6000)]
    found = kd_shards(frame(spark, rows)).collect()
    check(found, [(r[0], r[1]) for r in rows])
    shards = defaultdict(set)
    for r in found:
        shards[r.text_crc32].add(r.shard)
    assert sorted(map(len, shards.values()))[-2:] != [1, 1] and sum(len(s) > 1 for s in shards.values()) == 1


def test_empty(spark):
    assert kd_shards(frame(spark, [])).collect() == []


def test_table(spark, tables):
    check(op5_kd_sharding(spark, tables).collect(), [(r["doc_id"], r["text"]) for r in table(tables, "documents")], 0.25)


def test_copies_that_fit_a_shard_stay_together_on_the_tables(spark):
    for sf, near in (("sf0.001", 0.25), ("sf0.01", 0.08)):
        rows = table(f"/root/testdata/{sf}", "documents")
        found = op5_kd_sharding(spark, f"/root/testdata/{sf}").collect()
        check(found, [(r["doc_id"], r["text"]) for r in rows], near)
        at, total = {r.doc_id: r.shard for r in found}, sum(r["size"] for r in found)
        groups = defaultdict(list)
        for r in rows:
            groups[r["text"] or ""].append(r["doc_id"])
        small = [g for t, g in groups.items() if len(g) * (len(t.encode()) + 1) <= total / SHARDS]
        assert len(small) == len(groups) and all(len({at[i] for i in g}) == 1 for g in small)


def test_parts_are_as_few_as_fit():
    placed, held = place([("a", 250, 250), ("b", 90, 90), ("c", 20, 20)], 100, 4)
    parts = {n: p for n, p, _, _ in placed}
    assert parts == {"a": 3, "b": 1, "c": 1} and max(held) <= 108 and round(sum(held)) == 360
