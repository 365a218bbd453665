import pytest
from pyspark.sql import functions as F

from lontar.config import CleanConfig
from lontar.functions import text as X
from lontar.functions.stem import stem
from lontar.lexicons import INDONESIAN, ROOTS
from lontar.operators.clean import applied_steps, clean, cleaning_report, filter_rare_tokens


def cleaned(spark, texts, config, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_idx long, text string")
    rows = clean(df, config, **options).collect()
    assert len(rows) == len(texts)
    return [r.processed_text for r in sorted(rows, key=lambda r: r.doc_idx)]


PLAIN = CleanConfig(stemming=False, remove_stopwords=False, collapse_repeated_words=False, min_token_length=1)


def test_cases_of_the_whole_chain(spark):
    given = [
        "HARGA Mahal!!!", "bagusss", "bagus bgt", "sesuai pasal 4 ayat 9 dan 8 orang", "terima kasi banyak", "utang 1000 triliun", "anggaran 100000 rupiah",
        "saaangat baik", "maaaaf ya", "baca #pajak dan #korupsi", "", None, "   ", "😀 https://a.example/B?x=1 www.b.example/c me@x.example @you hi", "SMART phone RT @a",
    ]
    out = cleaned(spark, given, PLAIN)
    assert out[:9] == ["harga mahal", "bagus", "bagus bgt", "sesuai pasal 4 ayat 9 dan 8 orang", "terima kasih banyak", "utang 1000 triliun", "anggaran 100000 rupiah", "sangat baik", "maaf ya"]
    assert out[9:13] == ["baca pajak dan korupsi", "", "", ""]
    assert out[13] == "hi" and out[14] == "smaphone"


def test_slang_comes_from_a_file(spark, tmp_path):
    from dataclasses import replace

    from lontar.sources.readers import read_pairs

    (tmp_path / "slang.json").write_text('{"bgt": "banget", "gpp": "tidak apa apa"}')
    slang = replace(INDONESIAN, slang=read_pairs(spark, str(tmp_path / "slang.json")))
    df = spark.createDataFrame([(0, "bagus bgt"), (1, "gpp kok")], "doc_idx long, text string")
    assert [r.processed_text for r in clean(df, PLAIN, lexicon=slang).orderBy("doc_idx").collect()] == ["bagus banget", "tidak apa apa kok"]


def test_profiles(spark):
    bag, transformer = CleanConfig.for_task("bag_of_words"), CleanConfig.for_task("transformer", {"stemming": True, "custom_stopwords": ["x"]})
    assert transformer.stemming is False and transformer.custom_stopwords == ("x",) and CleanConfig.for_task("span") is None
    assert cleaned(spark, ["bagus dong pelayanannya"], transformer) == ["bagus dong pelayanannya"]
    assert cleaned(spark, ["bagus dong pelayanannya", "tidak bagus bagus"], bag) == ["bagus layan", "tidak bagus"]
    with pytest.raises(ValueError, match="unknown task"):
        CleanConfig.for_task("other")


def test_punctuation_numbers_and_steps(spark):
    from dataclasses import replace

    assert cleaned(spark, ["Wah, murah! 10% (diskon)"], replace(PLAIN, remove_punctuation=False)) == ["wah, murah! 10 diskon"]
    assert cleaned(spark, ["ada 12 anak"], replace(PLAIN, remove_numbers=True)) == ["ada anak"]
    assert "stemming" not in applied_steps(PLAIN) and applied_steps(PLAIN)[0] == "no_urls"
    row = cleaning_report(clean(spark.createDataFrame([(0, "Halo  dunia!!")], "doc_idx long, text string"), PLAIN), PLAIN).first().report
    assert (row.original_length, row.cleaned_length, row.original_words, row.removed_chars, row.compression_ratio) == (13, 10, 2, 3, 76.92)


def test_squeeze_decides_by_roots(spark):
    df = spark.createDataFrame([("maaaaf",), ("bagusss sekaliii",), ("aaabbb 1111",)], "t string")
    assert [r[0] for r in df.select(X.squeeze_letters(F.col("t"), ROOTS)).collect()] == ["maaf", "bagus sekali", "ab 1111"]
    assert [r[0] for r in df.select(X.squeeze_letters(F.col("t"))).collect()] == ["maf", "bagus sekali", "ab 1111"]


def test_rare_tokens_keep_order_and_rows(spark):
    df = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["c"]), (2, []), (3, ["b", "a"])], "k long, w array<string>")
    assert {r.k: r.w for r in filter_rare_tokens(df, "w", ["k"], 2).collect()} == {0: ["a", "b", "a"], 1: [], 2: [], 3: ["b", "a"]}
    assert filter_rare_tokens(df, "w", ["k"], 1) is df


@pytest.mark.parametrize(
    ("word", "root"),
    [("pelayanan", "layan"), ("harganya", "harga"), ("pekerjaan", "kerja"), ("membayar", "bayar"), ("menulis", "tulis"), ("pejabat", "jabat"), ("kebersihan", "bersih"), ("makanya", "makanya"), ("menghargai", "harga"), ("petugasnya", "tugas"), ("xyzzy", "xyzzy"), ("rumah-rumah", "rumah"), ("mengirim", "kirim"), ("penyakit", "sakit")],
)
def test_stems(word, root):
    assert stem(word) == root


def test_softmax_and_cosine(spark):
    row = spark.range(1).select(X.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), X.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0))).alias("c"), X.exact_round(F.lit(0.03125), 4).alias("r")).first()
    assert row.s == [0.5, 0.5] and row.c == pytest.approx(1.0) and row.r == 0.0312


def test_results_dont_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, f"pelayanan nomor {i % 7} bagusss sekali") for i in range(60)], "doc_idx long, text string")
    bag = CleanConfig.for_task("bag_of_words")
    one, many = ({(r.doc_idx, r.processed_text) for r in clean(df.repartition(n), bag, lexicon=INDONESIAN).collect()} for n in (1, 8))
    assert one == many and len(one) == 60
