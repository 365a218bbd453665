import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lontar.lexicons import ROOTS
from lontar.operators import aspects as A
from lontar.operators import datasets as D
from lontar.operators import spans as P


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")


def spans_of(df):
    return sorted((r.doc_idx, r.aspect, r.start, r.end) for r in df.collect())


def test_literal_spans(spark):
    d = docs(spark, ["Pelayanannya bagus tapi harga mahal", "Seharganya wajar", "harga naik, harga turun, harga stabil", "Soal pajak memang berat", None, "", "😀 HARGA_x harga", "a a a", "harga"])
    found = spans_of(P.literal_spans(d, ["harga", "pajak.", "a a", " "]))
    assert found == [(0, "harga", 24, 29), (2, "harga", 0, 5), (2, "harga", 12, 17), (2, "harga", 25, 30), (3, "pajak", 5, 10), (6, "harga", 2, 7), (6, "harga", 10, 15), (7, "a a", 0, 3), (7, "a a", 2, 5), (8, "harga", 0, 5)]
    assert all(r.surface.lower() == r.aspect for r in P.literal_spans(d, ["harga"]).collect())
    assert P.literal_spans(d, [""]).count() == 0


def test_stem_spans_and_verbs(spark):
    d = docs(spark, ["Layanannya lambat sekali", "Kita harus menghargai jasa mereka", "pejabatnya kaya", "Kualitas produknya baik"])
    found = spans_of(P.find_spans(d, ["pelayanan", "harga", "pejabat", "kualitas produk"]))
    assert found == [(0, "pelayanan", 0, 10), (2, "pejabat", 0, 10), (3, "kualitas produk", 0, 18)]
    assert P.find_spans(d, ["pelayanan"], use_stemming=False).count() == 0


def test_bio_decoding(spark):
    labels = [1, 2, 0, 2, 1, 1, 2]
    tags = spark.createDataFrame([(0, i, lab, 10 * i + 1, 10 * i + 5, 0.9 if i else 0.1) for i, lab in enumerate(labels)] + [(0, 7, 1, 0, 0, 0.9)], "doc_idx long, pos int, label int, start int, end int, conf double")
    assert sorted((r.first_pos, r.last_pos) for r in P.decode_bio(tags).collect()) == [(0, 1), (4, 4), (5, 6)]
    assert sorted((r.first_pos, r.last_pos) for r in P.decode_bio(tags, threshold=0.5).collect()) == [(4, 4), (5, 6)]
    tokens = tags.select("doc_idx", "pos", "start", "end", (F.col("pos") == 7).alias("special"))
    back = P.bio_tags(tokens, spark.createDataFrame([(0, 1, 15), (0, 41, 45)], "doc_idx long, start int, end int"))
    assert [r.label for r in back.orderBy("pos").collect()] == [1, 2, 0, 0, 1, 0, 0, -100]


def test_iob_and_overlaps(spark):
    tokens = spark.createDataFrame([(0, i, w, lab) for i, (w, lab) in enumerate([("ac", "I"), ("rusak", "O"), ("wifi", "B"), ("hotel", "I"), ("wifi", "B")])], "doc_idx long, pos int, token string, label string")
    assert sorted((r.start, r.end, r.surface) for r in P.iob_spans(tokens).collect()) == [(0, 2, "ac"), (9, 19, "wifi hotel"), (20, 24, "wifi")]
    rows = [(0, "a", 0, 5), (0, "b", 3, 12), (0, "c", 12, 15), (0, "d", 13, 16), (1, "e", 0, 2)]
    df = spark.createDataFrame(rows, "doc_idx long, aspect string, start int, end int")
    chosen = []
    for i, a, s, e in sorted(rows, key=lambda r: (r[0], r[2] - r[3], r[2])):
        if not any(i == j and s < z and b < e for j, _, b, z in chosen):
            chosen.append((i, a, s, e))
    assert spans_of(P.resolve_overlaps(df)) == sorted(chosen)
    left = P.overlap_anti_join(df, spark.createDataFrame([(0, 4, 13)], "doc_idx long, start int, end int"))
    assert spans_of(left) == [(0, "d", 13, 16), (1, "e", 0, 2)]


@pytest.mark.parametrize(
    ("text", "aspect", "clause"),
    [
        ("Pelayanannya bagus tapi harganya mahal", "Pelayanannya", "Pelayanannya bagus"), ("Pelayanannya bagus tapi harganya mahal", "harganya", "harganya mahal"),
        ("Pajak naik terus padahal fasilitas umum memadai", "fasilitas umum", "fasilitas umum memadai"), ("Wifi. Kamarnya sangat nyaman dan bersih sekali", "Wifi", "Wifi. Kamarnya sangat nyaman dan bersih sekali"),
        ("Setapak jalannya rusak parah sekali", "jalannya", "Setapak jalannya rusak parah sekali"), ("Bersih, TETAPI kamar sempit! Ok", "kamar", "kamar sempit"),
    ],
)
def test_clauses(spark, text, aspect, clause):
    s = text.index(aspect)
    occ = spark.createDataFrame([(0, aspect, s, s + len(aspect))], "doc_idx long, aspect string, start int, end int")
    assert P.add_clauses(occ, docs(spark, [text])).first().clause == clause


def test_bad_offsets_give_the_text(spark):
    occ = spark.createDataFrame([(0, "a", None, None), (0, "b", -5, 3), (0, "c", 0, 999)], "doc_idx long, aspect string, start int, end int")
    assert {r.clause for r in P.add_clauses(occ, docs(spark, ["Pelayanan bagus sekali"])).collect()} == {"Pelayanan bagus sekali"}


def test_contexts_and_keywords(spark):
    df = spark.createDataFrame([("harga", "satu dua tiga empat harga lima enam tujuh delapan"), ("ongkir", "Tidak Ada"), ("a b", "x a b y")], "a string, t string")
    assert [r[0] for r in df.select(P.context_words(F.col("a"), F.col("t"))).collect()] == ["dua tiga empat harga lima enam tujuh", "tidak ada", "x a b y"]
    d = docs(spark, ["Harga dan kualitas, harga! customer service", None])
    assert {r.doc_idx: sorted(r.keywords) for r in A.keyword_aspects(d).collect()} == {0: ["customer", "harga", "kualitas", "service"], 1: []}


def test_clitics_and_merging(spark):
    names = ["gajinya", "anggarannya", "tninya", "gaji nya", "nya", "makanya", "alutsistanya", "punya"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(A.strip_clitics(F.col("n"))).collect()] == ["gaji", "anggaran", "tni", "gaji", "nya", "makanya", "alutsista", "punya"]
    entries = spark.createDataFrame([("gaji", 3, 0.5, ["gaji"], 0), ("gajinya", 1, 0.9, ["gajinya"], 1), ("petugas", 2, None, ["petugas"], 2), ("tugasnya", 2, 0.5, ["tugasnya"], 3), ("petugasnya", 2, None, ["petugasnya"], 4)], "aspect string, count long, confidence double, variants array<string>, first long")
    rows = A.merge_variants(entries).orderBy("rank").collect()
    assert [(r.aspect, r["count"]) for r in rows] == [("petugas", 4), ("gaji", 4), ("tugasnya", 2)]
    assert rows[1].confidence == pytest.approx(0.6) and rows[1].variants == ["gaji", "gajinya"] and rows[0].confidence is None


def test_rule_based_and_polarity(spark):
    d = docs(spark, ["Harga mahal tapi pelayanan bagus", "Pelayanan lambat sekali", "layanannya ramah, harganya terjangkau"])
    found = A.extract_rule_based(d, ["harga", "pelayanan"])
    assert {r.aspect: r["count"] for r in A.rule_based_counts(found).collect()} == {"harga": 2, "pelayanan": 3}
    polarity = {r.aspect: r for r in A.aspect_polarity(A.aspect_sentiments(d, found)).collect()}
    assert (polarity["harga"].positive, polarity["harga"].negative) == (50.0, 50.0) and polarity["harga"].dominant == "positive"
    stats = A.summary(A.statistics(A.aspect_polarity(A.aspect_sentiments(d, found)))).first()
    assert stats.total_mentions == 5 and stats.most_mentioned == "pelayanan" and "pelayanan" in stats.summary
    lists = {r.doc_idx: r.aspects for r in A.document_aspects(d, found).collect()}
    assert lists[0] == ["harga", "pelayanan"] and lists[1] == ["pelayanan"]
    assert {r.doc_idx: r.aspects for r in A.base_forms(A.document_aspects(d, found)).collect()}[1] == ["layan"]


def test_semantic_mapping(spark):
    protos = spark.createDataFrame([("pelayanan", [1.0, 0.0, 0.0]), ("harga", [0.0, 1.0, 0.0])], "aspect string, embedding array<double>")
    cand = spark.createDataFrame([(0, "x", 0, 3, [0.9, 0.1, 0.0]), (1, "y", 0, 3, [0.0, 0.0, 1.0]), (2, "z", 0, 3, [0.7, 0.7, 0.0]), (3, "w", 0, 3, [0.1, 0.9, 0.0])], "doc_idx long, surface string, start int, end int, embedding array<double>")
    got = {r.doc_idx: r.aspect for r in A.semantic_matches(cand, protos, ["doc_idx"]).collect()}
    assert got == {0: "pelayanan", 3: "harga"}
    d = docs(spark, ["abc", "def", "ghi", "harga"])
    both = A.extract_rule_based(d, ["harga"], candidates=cand, prototypes_=protos, roots=ROOTS)
    assert sorted((r.doc_idx, r.match_type) for r in both.collect()) == [(0, "semantic"), (3, "literal")]
    made = {r.aspect: r.embedding for r in A.prototypes(protos, protos).collect()}
    assert made["harga"] == pytest.approx([-(0.5**0.5), 0.5**0.5, 0.0])


def test_terms(spark):
    raw = ["kinerja 2003", "kantor akuntan publik ( KAP )", "( )", "kinerja tahun", " ,harga- ", "satu dua tiga empat lima", "2003", "ab", "harga tahun 2003", None]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r[0] for r in df.select(D.normalize_term(F.col("r"))).collect()] == ["kinerja", "kantor akuntan publik", None, "kinerja", "harga", "satu dua tiga", None, None, "harga", None]
    terms = spark.createDataFrame([(t,) for t in ["layanan 3G", "yang terbaik", "Manchester City", "RUPS", "bagus sekali", "tahun lalu", "membayar pajak", "Pajak", "harga saham"]], "term string")
    seen = spark.createDataFrame([("pajak",)], "term string")
    assert {r.term: r.reason for r in D.reject_reasons(terms, seen).collect()} == {
        "layanan 3G": "mengandung angka", "yang terbaik": "berkepala kata fungsi", "Manchester City": "nama diri", "RUPS": None, "bagus sekali": "berkepala kata opini",
        "tahun lalu": "berkepala satuan waktu", "membayar pajak": "berkepala verba", "Pajak": None, "harga saham": None,
    }


def test_projection_and_substitution(spark):
    d = docs(spark, ["membeli Saham publik hari ini", "saham naik lalu saham turun, saham lagi", "ac rusak dan wifi lemot"])
    assert [r.aspect for r in D.project(d, ["saham", "saham publik"]).filter("doc_idx = 0").collect()] == ["saham publik"]
    assert D.project(d, ["saham"]).filter("doc_idx = 1").count() == 3
    spans = spark.createDataFrame([(2, 0, 2, "ac"), (2, 13, 17, "wifi")], "doc_idx long, start int, end int, surface string")
    made = D.substitute(d, spans, spark.createDataFrame([("resepsionis", 0)], "term string, slot int")).first()
    assert made.new_text == "resepsionis rusak dan resepsionis lemot"
    assert [made.new_text[s.start : s.end] for s in made.new_spans] == ["resepsionis"] * 2
    order = D.shuffled(d, "doc_idx").select("doc_idx", "position").collect()
    assert sorted(r.position for r in order) == [0, 1, 2]


def test_reports_on_training_data(spark):
    d = docs(spark, ["harga mahal", "pelayanan ramah"])
    rows = spark.createDataFrame([(0, ["harga", "zzz"]), (1, ["harga"])], "doc_idx long, aspects array<string>")
    r = A.bio_report(rows, P.literal_spans(d, ["harga"])).first()
    assert (r.samples, r.total_aspects, r.unmatched, r.unmatched_pct, r.all_o_samples) == (2, 3, 2, 66.67, 1)
    got = defaultdict(int)
    for s in D.annotate(d, [("harga", True), ("layan", False)]).collect():
        got[s.aspect] += 1
    assert dict(got) == {"harga": 1, "layan": 1}


def brute_spans(texts, names):
    out = []
    for i, t in enumerate(texts):
        for n in names:
            for at in range(len(t) - len(n) + 1):
                before, after = t[at - 1 : at], t[at + len(n) : at + len(n) + 1]
                if t[at : at + len(n)].lower() == n and not (before.isalpha() or before.isnumeric()) and not (after.isalpha() or after.isnumeric()):
                    out.append((i, n, at, at + len(n)))
    return sorted(out)


def test_literal_spans_of_long_texts_are_those_of_a_loop(spark):
    rng = random.Random(4)
    words = ["harga", "harga pasar", "pasar", "a", "a a", "x-harga", "Harga,", "sepasar", "9", "harga9"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 63, 64, 65, 500)]
    names = ["harga", "harga pasar", "pasar", "a a", "a", "9", "harga pasar a"]
    assert spans_of(P.literal_spans(docs(spark, texts), names)) == brute_spans(texts, names)


def test_work_on_long_texts_grows_in_proportion(spark):
    """Eight times the text takes far less than 64 times the time."""
    one = "harga naik dan pasar turun tapi kualitas bagus. "

    def seconds(repeats):
        d = docs(spark, [one * repeats])
        best = []
        for _ in range(2):
            began = time.perf_counter()
            P.literal_spans(d, ["harga", "pasar"]).count()
            d.select(F.size(P.clause_bounds(F.col("text"))), P.context_words(F.lit("zzz"), F.col("text"))).collect()
            A.keyword_aspects(d).collect()
            best.append(time.perf_counter() - began)
        return min(best)

    seconds(100)
    small, large = seconds(1000), seconds(8000)
    assert large < 24 * small + 2


def test_span_vectors(spark):
    tokens = spark.createDataFrame([(0, 0, 5, [1.0, 0.0]), (0, 6, 9, [0.0, 1.0]), (0, 10, 14, [0.0, 3.0])], "doc_idx long, start int, end int, vector array<double>")
    spans = spark.createDataFrame([(0, 0, 5), (0, 3, 8), (0, 20, 25)], "doc_idx long, start int, end int")
    got = {(r.start, r.end): r.vector for r in A.pool_spans(spans, tokens).collect()}
    assert got[0, 5] == [1.0, 0.0] and got[3, 8] == [0.5, 0.5] and got[20, 25] == pytest.approx([1 / 3, 4 / 3])


def test_analyze_modes(spark):
    texts = ["Harga mahal tapi pelayanan bagus", "Pelayanan lambat sekali", "layanannya ramah, harganya terjangkau", "", None]
    d = docs(spark, texts)
    own = A.analyze(d, "rule-based", ["harga", "pelayanan"])
    assert {r.aspect: r["count"] for r in own["aspects"].collect()} == {"harga": 2, "pelayanan": 3}
    assert {r.doc_idx: r.aspects for r in own["document_aspects"].collect()} == {0: ["pelayanan", "harga"], 1: ["pelayanan"], 2: ["pelayanan", "harga"], 3: [], 4: []}
    assert {r.doc_idx: r.aspects for r in own["document_aspects_normalized"].collect()}[1] == ["layan"]
    assert own["statistics"].first().total_mentions == 5 and "pelayanan" in own["summary"].first().summary
    kept = A.analyze(d, "rule-based", ["gaji", "gajinya"])  # the user's own aspects are not merged
    assert kept["aspects"].count() == 0 and kept["document_aspects"].count() == 5
    auto = A.analyze(d)
    assert {r.aspect: r["count"] for r in auto["aspects"].collect()} == {"harga": 1, "pelayanan": 2}
    places = {(r.doc_idx, r.aspect): (r.start, r.end) for r in auto["occurrences"].collect()}
    assert places == {(0, "harga"): (0, 5), (0, "pelayanan"): (17, 26), (1, "pelayanan"): (0, 9)}


def test_analyze_with_a_tagger_merges_variants(spark):
    texts = ["gajinya besar", "gaji kecil", "gaji nya naik"]
    spans = [(0, 0, 7), (1, 0, 4), (2, 0, 8)]
    tags = spark.createDataFrame([(i, 0, 1, s, e, 0.9) for i, s, e in spans] + [(0, 1, 0, 8, 13, 0.9)], "doc_idx long, pos int, label int, start int, end int, conf double")
    found = A.analyze(docs(spark, texts), tags=tags)
    row = found["aspects"].first()
    assert (row.aspect, row["count"], row.variants) == ("gaji", 3, ["gaji", "gaji nya", "gajinya"]) and row.score == pytest.approx(2.7)
    assert {r.aspect for r in found["occurrences"].collect()} == {"gaji"}


def test_augmentation_keeps_all_and_adds(spark):
    d = docs(spark, ["ac rusak dan wifi lemot", "tanpa aspek", None])
    spans = spark.createDataFrame([(0, 0, 2, "ac"), (0, 13, 17, "wifi")], "doc_idx long, start int, end int, surface string")
    pool = spark.createDataFrame([("resepsionis", 0), ("kamar", 1)], "term string, slot int")
    more = spark.createDataFrame([(100, "kalimat biasa")], "doc_idx long, text string")
    rows = D.augment(d, spans, pool, 2, more).collect()
    assert sorted((r.kind, r.doc_idx, r["copy"]) for r in rows) == [("augmented", 0, 1), ("augmented", 0, 2), ("given", 0, 0), ("given", 1, 0), ("given", 2, 0), ("negative", 100, 0)]
    assert sorted(r.position for r in rows) == list(range(6))
    for r in rows:
        words = [r.text[s.start : s.end] for s in r.spans]
        assert words == (["ac", "wifi"] if r.kind == "given" and r.doc_idx == 0 else []) or (r.kind == "augmented" and set(words) <= {"resepsionis", "kamar"} and len(words) == 2)


def test_terms_are_counted_before_they_are_tidied(spark):
    raw = [("Harga Wifi",)] * 3 + [("harga (baru",)] * 2 + [("harga",), (None,), ("x",)]
    made = D.term_counts(spark.createDataFrame(raw, "raw string"), least=3)
    assert {r.term: r.n for r in made.collect()} == {"Harga Wifi": 3, "harga": 3} and made.inputFiles()
