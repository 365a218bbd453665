from collections import Counter

from lontar.llm.token_counts import MARK, Pieces, TrieCounts, default_vocabulary, op3_token_counts, token_counts
from tests.llm.cases import awkward, frame, table


def slow_count(pieces, word):
    text, best = MARK + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        options = [(best[end - 1][0] + width * pieces.byte, -(best[end - 1][1] + width))]
        options += [(best[s][0] + pieces.score[text[s:end]], -(best[s][1] + 1)) for s in range(end) if text[s:end] in pieces.score]
        score, n = max(options)
        best.append((score, -n))
    return best[-1][1]


def brute(rows):
    pieces, known = Pieces(default_vocabulary()), {}
    out = Counter()
    for i, t in rows:
        words = [w for w in (t or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
        for w in set(words) - known.keys():
            known[w] = slow_count(pieces, w)
        out[i, len(words), sum(known[w] for w in words), len((t or "").encode())] += 1
    return out


def test_awkward(spark):
    rows = awkward()
    assert Counter(map(tuple, token_counts(frame(spark, rows)).collect())) == brute([(r[0], r[1]) for r in rows])


def test_empty(spark):
    assert token_counts(frame(spark, [])).collect() == []


def test_table(spark, tables):
    assert Counter(map(tuple, op3_token_counts(spark, tables).collect())) == brute([(r["doc_id"], r["text"]) for r in table(tables, "documents")])


def test_prefixes_are_scored_once():
    counts = TrieCounts(Pieces(default_vocabulary()))
    counts.extend(["inter", "internal", "international", "internet"])
    assert counts.nodes == len({(MARK + w)[:k] for w in ("inter", "internal", "international", "internet") for k in range(1, len(w) + 2)})
