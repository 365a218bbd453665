"""Steps whose cost must follow the input: what they may not build on the way, and that results stay the same."""

from __future__ import annotations

from lontar.plans import registry


def test_count_vectors_stay_sparse(spark, tables, monkeypatch):
    """an array as long as the vocabulary was made for each document."""
    from pyspark.ml import functions

    monkeypatch.setattr(functions, "vector_to_array", None)
    row = registry.queries()["count_vectors"](spark, tables).first()
    want = registry.queries()["count_vocabulary"](spark, tables).selectExpr("count(*) words", "sum(tf) counted").first()
    assert tuple(row) == tuple(want)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_stems_are_found_where_a_text_stands(spark):
    """each word went through windows of its document."""
    from lontar.operators import spans as P

    texts = [(1, "Pelayanan baik; pelayanannya  ramah"), (2, None), (3, ""), (4, "di balai-kota lama, Balai kota")]
    docs = spark.createDataFrame(texts, "doc_idx long, text string")
    words = P.word_spans(docs)
    assert "Window" not in plan(words)
    want = [(1, 0, 0, 9, "Pelayanan"), (1, 1, 10, 14, "baik"), (1, 2, 16, 28, "pelayanannya"), (1, 3, 30, 35, "ramah")]
    assert sorted(tuple(r) for r in words.filter("doc_idx = 1").select("doc_idx", "pos", "start", "end", "word").collect()) == want
    found = P.stem_spans(docs, ["layan", "balai kota"], roots=frozenset({"layan", "balai", "kota"}))
    assert "Window" not in plan(found) and "text" not in [c.name for c in found.schema]
    got = {tuple(r) for r in found.select("doc_idx", "aspect", "start", "end", "surface").collect()}
    assert got >= {(4, "balai kota", 3, 13, "balai-kota"), (4, "balai kota", 20, 30, "Balai kota")}


def test_a_text_meets_its_occurrences_once(spark):
    """The text was joined to every occurrence, and so was shuffled and written once for each."""
    from lontar.operators import aspects as A

    docs = spark.createDataFrame([(1, "harga bagus tapi pelayanan buruk. harga"), (2, "harga")], "doc_idx long, text string")
    occ = spark.createDataFrame([(1, "harga", 0, 5), (1, "pelayanan", 17, 26), (1, "harga", 34, 39), (2, "harga", 0, 5)], "doc_idx long, aspect string, start int, `end` int")
    made = A.aspect_sentiments(docs, occ)
    assert plan(made).count("Join ") == 1
    assert "collect_list" in plan(made)
    got = {(r.doc_idx, r.start): r.clause for r in made.collect()}
    assert got == {(1, 0): "harga bagus", (1, 17): "pelayanan buruk", (1, 34): "harga bagus tapi pelayanan buruk. harga", (2, 0): "harga"}
    short = A.aspect_sentiments(docs, occ, whole_texts=False)
    assert {(r.doc_idx, r.start): r.sentiment for r in short.collect()} == {(r.doc_idx, r.start): r.sentiment for r in made.collect()}
    assert {r.clause for r in short.filter("doc_idx = 2").collect()} == {None}


def test_stems_of_lists_need_no_shuffle(spark):
    """F23, and the cleaning of F18, F21: every token was joined with its stem and brought back to its document."""
    from lontar.config import CleanConfig
    from lontar.operators import clean as C

    rows = [(1, ["pelayanannya", "baik", "pelayanannya"]), (2, []), (3, None), (4, ["x", None, "--"]), (4, ["layan"])]
    lists = spark.createDataFrame(rows, "doc_idx long, tokens array<string>")
    made = C.stem_tokens(lists, "tokens", frozenset({"layan"}))
    got = sorted((r.doc_idx, tuple(r.tokens)) for r in made.collect())
    assert got == [(1, ("layan", "baik", "layan")), (2, ()), (3, ()), (4, ("layan",)), (4, ("x",))]
    docs = spark.createDataFrame([(1, "Pelayanan baik sekali"), (2, None)], "doc_idx long, text string")
    cleaned = C.clean(docs, CleanConfig.for_task("bag_of_words"))
    assert "Join" not in plan(cleaned) and "Aggregate" not in plan(cleaned)
    assert len(cleaned.collect()) == 2


def test_windows_are_counted_without_shuffling_the_corpus(spark, tables):
    """all tokens were shuffled to meet the few wanted words, and F6 made a row for each word and window."""
    made = registry.queries()["window_cooccurrence"](spark, tables)
    physical = made._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in physical.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    assert "sequence(" not in plan(made)


def test_stems_are_found_without_a_row_for_each_word(spark):
    """every piece of a text became a row that joins met, and literal spans were found twice and joined by document."""
    from lontar.operators import spans as P

    texts = [(1, "Ⓐlayan ²layan layan² layan‍x"), (2, "Pelayanannya, LAYANAN; layan—layan\nmelayani layan_x"), (3, None), (4, "balai  kota, balai-kotanya menghargai harganya"), (5, "")]
    docs = spark.createDataFrame(texts, "doc_idx long, text string")
    roots = frozenset({"layan", "balai", "kota", "harga"})
    made = P.find_spans(docs, ["layan", "harga", "balai kota"], roots=roots)
    assert not any(x in plan(made.filter("match_type = 'stem'")) for x in ("Join", "Aggregate", "Window"))
    got = sorted((r.doc_idx, r.aspect, r.start, r.end, r.surface) for r in P.stem_spans(docs, ["layan", "harga", "balai kota"], roots=roots).collect())
    assert got == [
        (1, "layan", 0, 6, "Ⓐlayan"), (1, "layan", 8, 13, "layan"), (1, "layan", 14, 19, "layan"), (2, "layan", 0, 12, "Pelayanannya"),
        (2, "layan", 14, 21, "LAYANAN"), (2, "layan", 23, 28, "layan"), (2, "layan", 29, 34, "layan"),
        (4, "balai kota", 0, 11, "balai  kota"), (4, "balai kota", 13, 26, "balai-kotanya"), (4, "harga", 38, 46, "harganya"),
    ]
    kinds = {(r.doc_idx, r.aspect): r.match_type for r in made.collect()}
    assert kinds == {(1, "layan"): "literal", (2, "layan"): "literal", (4, "balai kota"): "stem", (4, "harga"): "stem"}


def test_a_clause_is_scored_once(spark):
    """F8: each occurrence looked through all clauses of its document, and its clause was scored and written again."""
    from lontar.operators import aspects as A
    from lontar.operators import spans as P

    docs = spark.createDataFrame([(1, "harga harga harga bagus. pelayanan buruk"), (2, None)], "doc_idx long, text string")
    occ = spark.createDataFrame([(1, "h", 0, 5), (1, "h", 6, 11), (1, "h", 12, 17), (1, "p", 25, 34), (1, "p", 25, 99), (2, "x", 0, 1)], "doc_idx long, aspect string, start int, `end` int")
    groups = P.clause_groups(occ, docs).collect()
    assert sorted((r._clean or "", len(r._members)) for r in groups) == [("", 1), ("", 1), ("harga harga harga bagus", 3), ("pelayanan buruk", 1)]
    assert A.aspect_sentiments(docs, occ).count() == 6
