import zlib

import numpy as np

from lontar.llm.language_id import codewords, identify, op7_language_id
from tests.llm.cases import awkward, frame, table


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def test_awkward(spark):
    rows = awkward()
    found = identify(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in found)
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == "und"
    assert by_id[7].lang_pred in {"en", "de", "fr"}


def test_empty_and_unlabelled(spark):
    assert identify(frame(spark, [])).collect() == []
    rows = [(1, "text", None, None, 4, None, None, None, None), (2, None, None, None, 4, None, None, None, None)]
    assert {(r.lang_pred, r.score) for r in identify(frame(spark, rows)).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark, tables):
    lang = {r["doc_id"]: r["lang"] for r in table(tables, "documents")}
    found = op7_language_id(spark, tables).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(lang) and len(held) > 20
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9


def test_codewords_are_apart():
    for n in (2, 4, 9, 40):
        code = codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[i + 1 :]]
        assert min(apart) >= code.shape[1] // 5 and (np.abs(code.sum(0)) < n).all()


def test_decoding_is_that_of_a_loop():
    """Loss-weighted decoding, word by word and bit by bit."""
    import math

    import numpy as np
    from lontar.llm.language_id import MARGIN, decode

    rng = np.random.default_rng(3)
    model = {"w": rng.normal(size=(7, 5)), "code": np.array([[1, 1, -1, 1, -1], [-1, 1, 1, -1, -1], [1, -1, 1, 1, 1]], float), "bit": rng.random(5)}
    x = rng.normal(size=(40, 6))
    best, score, near = decode(x, model)
    for row, k, p, flag in zip(x, best, score, near, strict=True):
        margins = [sum(a * b for a, b in zip(row, model["w"][:-1, j], strict=True)) + model["w"][-1, j] for j in range(5)]
        losses = [sum(model["bit"][j] * math.log1p(math.exp(-word[j] * margins[j])) for j in range(5)) for word in model["code"]]
        shares = sorted((math.exp(min(losses) - z) / sum(math.exp(min(losses) - y) for y in losses) for z in losses), reverse=True)
        assert k == min(range(3), key=losses.__getitem__) and abs(p - shares[0]) < 1e-9 and flag == (shares[0] - shares[1] < MARGIN)


def test_the_bound_on_training_texts_holds_for_repeated_ids(spark):
    from lontar.llm import language_id as L

    rows = [(1 + i % 3, f"kata biasa nomor {i}", "id") for i in range(2000)] + [(i, "the same text", "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    original, L.train = L.train, lambda x, labels, n: seen.append(len(x)) or original(x, labels, n)
    try:
        languages, _ = L.fit(docs)
    finally:
        L.train = original
    assert languages == ["en", "id"] and seen[0] <= L.PER_LANGUAGE + 1
