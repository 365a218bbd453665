import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lontar.llm.best_fit_packing import CAPACITY, ZONES, Chunks, aims, default_vocabulary, match, op8_best_fit_packing, pack, sweep, zone_of
from tests.llm.cases import awkward, frame, table


def whole(rows):
    tok, out = Tokenizer.from_file(default_vocabulary()), Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[at : at + CAPACITY]
            out[i, k, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    return out


def check(found, rows):
    assert Counter(tuple(r)[:5] for r in found) == whole(rows)
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(places), sum(r.length for r in found)


def test_awkward(spark):
    rows = awkward()
    check(pack(frame(spark, rows)).collect(), [(r[0], r[1]) for r in rows])


def test_empty(spark):
    assert pack(frame(spark, [])).collect() == []


def test_table(spark, tables):
    n, total = check(op8_best_fit_packing(spark, tables).collect(), [(r["doc_id"], r["text"]) for r in table(tables, "documents")])
    assert n <= -(-total // CAPACITY) * 1.02 + 1


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x250), st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sré́İΣ<|>\x1c")), max_size=40))
def test_chunks_give_the_tokenizers_ids(text):
    chunks = test_chunks_give_the_tokenizers_ids.__dict__.setdefault("chunks", Chunks(default_vocabulary()))
    assert chunks.text(text) == np.asarray(chunks.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def in_rounds(counts, capacity, zones):
    """Placed runs by the operator's own steps, without Spark."""
    state, waiting, gaps, placed, opened, rounds = [("d", size, 0, n) for size, n in counts.items()], counts, set(), [], 0, 0
    while waiting:
        tops, more = aims(waiting, gaps, capacity, zones)
        state += [("g", capacity, opened, more)] if more else []
        opened += more
        zoned = defaultdict(list)
        for r in state:
            own = zone_of(r[1], capacity, zones)
            zoned[own if r[0] == "g" else next((z for z, top in enumerate(tops) if own <= z and r[1] <= top), zones - 1)].append(r)
        done = [r for runs in zoned.values() for r in sweep(runs, capacity)]
        placed += [r[1:] for r in done if r[0] == "p"]
        state = [r[:4] for r in done if r[0] != "p"]
        waiting, gaps = Counter(), {r[1] for r in state if r[0] == "g"}
        for kind, size, _, n in state:
            if kind == "d":
                waiting[size] += n
        rounds += 1
        assert rounds < 500
    return placed


def held(placed, counts, capacity):
    """Sequences of placed runs: every rank once, no overlap, no gap before a document."""
    seats, seen = defaultdict(list), Counter()
    for size, first, n, seq, off, per in placed:
        for k in range(n):
            seen[size, first + k] += 1
            seats[seq + k // per].append((off + k % per * size, size))
    assert seen == Counter({(size, r): 1 for size, n in counts.items() for r in range(n)})
    for s in seats.values():
        at = 0
        for offset, size in sorted(s):
            assert offset == at
            at += size
        assert at <= capacity
    return len(seats)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20), st.sampled_from([1, 2, 4]))
def test_rounds_place_each_rank_once_and_about_as_well_as_one_by_one(counts, zones):
    used = held(in_rounds(counts, 64, zones), counts, 64)
    gaps, bins = [], 0
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):  # one document at a time
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            bins += 1
            gaps.append(64 - length)
    assert used <= 1.1 * bins + 1


def test_rounds_in_spark_are_the_same(spark):
    rng = np.random.default_rng(0)
    counts = Counter((np.exp(rng.normal(3, 1, 3000)).astype(int) % 128 + 1).tolist())
    got = [tuple(r) for r in match(counts, 128, spark.range(1)).collect()]
    assert sorted((size, low, high - low, seq, off, per) for size, low, high, seq, off, per in got) == sorted(in_rounds(counts, 128, ZONES))
    assert held([(size, low, high - low, seq, off, per) for size, low, high, seq, off, per in got], counts, 128) <= 1.01 * -(-sum(k * n for k, n in counts.items()) // 128) + 1


def test_frequent_chunks_survive_a_full_cache(monkeypatch):
    from lontar.llm import best_fit_packing as B

    monkeypatch.setattr(B, "CACHE", 50)
    chunks, asked = Chunks(default_vocabulary()), Counter()
    spell = chunks.model.tokenize
    chunks.model = type("Counted", (), {"tokenize": staticmethod(lambda w: asked.update([w]) or spell(w))})
    for k in range(400):
        text = f"often Word{chr(97 + k % 26)}{chr(97 + k // 26)}x, café{k}"
        assert chunks.text(text) == np.asarray(chunks.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert asked["often"] == 1
    assert max(len(chunks), len(chunks.older), len(chunks.words), len(chunks.older_words)) <= 50
    chunks.forget()
    assert not (chunks or chunks.older or chunks.words or chunks.older_words)
