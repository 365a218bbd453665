"""The stemmer held to words stemmed by hand, with the numbers of the rules that take their prefixes."""

import random

import pytest
from pyspark.sql import functions as F

from lontar.config import CleanConfig, Lexicon
from lontar.functions.stem import DISALLOWED, INFIX_RULES, PREFIX_RULES, explain, stem, stem_map
from lontar.functions.text import squeeze_letters
from lontar.operators.clean import clean
from lontar.sources.readers import read_roots

#: Words by rule, with their roots.
BY_RULE = {
    1: "berangkat:angkat beradu:adu berencana:rencana berumah:rumah beribadah:ibadah berolahraga:olahraga berambut:rambut",
    2: "berlari:lari berjalan:jalan bercerita:cerita bersama:sama bermain:main berkata:kata bernyanyi:nyanyi berteman:teman",
    3: "berdaerah:daerah berkaerang:kaerang",
    4: "belajar:ajar",
    5: "bekerja:kerja beternak:ternak",
    6: "terangkat:angkat terendam:rendam terasa:rasa terambil:ambil terurai:urai",
    7: "terserang:serang terkerabat:kerabat",
    8: "terlihat:lihat terjatuh:jatuh terbuka:buka terkenal:kenal tertidur:tidur tersusun:susun",
    9: "tepercik:percik teperdaya:perdaya",
    10: "melihat:lihat merasa:rasa mewarnai:warna meyakini:yakin melayani:layan merokok:rokok melukis:lukis",
    11: "membaca:baca memfitnah:fitnah memvonis:vonis membuat:buat membeli:beli membuka:buka",
    12: "mempengaruhi:pengaruh mempesona:pesona",
    13: "memakan:makan memukul:pukul memilih:pilih memasak:masak memulai:mulai meminjam:pinjam memotong:potong",
    14: "mencari:cari mendengar:dengar menjual:jual menziarahi:ziarah mensyukuri:syukur mentaati:taat",
    15: "menulis:tulis menari:tari menikah:nikah menanam:tanam menolong:tolong menunggu:tunggu menilai:nilai",
    16: "menggali:gali menghitung:hitung mengkritik:kritik mengganti:ganti menghapus:hapus",
    17: "mengambil:ambil mengirim:kirim mengecat:cat mengikat:ikat mengarang:karang mengukur:ukur mengebom:bom",
    18: "menyapu:sapu menyanyi:nyanyi menyewa:sewa menyiram:siram menyala:nyala",
    19: "memproses:proses memprotes:protes",
    20: "pewarna:warna peyakin:yakin",
    21: "peramal:amal perokok:rokok perusak:rusak",
    23: "perjalanan:jalan pertahanan:tahan permainan:main persamaan:sama",
    24: "perdaerah:daerah",
    25: "pembaca:baca pemfitnah:fitnah pembeli:beli pembangunan:bangun",
    26: "pemukul:pukul pemilih:pilih pemain:main pemotong:potong",
    27: "pencuri:curi pendengar:dengar penjual:jual pencarian:cari",
    28: "penulis:tulis penari:tari penolong:tolong penilaian:nilai",
    29: "penggali:gali penghitung:hitung penghapus:hapus",
    30: "pengambil:ambil pengirim:kirim pengecat:cat pengukur:ukur",
    31: "penyapu:sapu penyanyi:nyanyi penyakit:sakit penyiram:siram",
    32: "pelajar:ajar pelari:lari pelukis:lukis pelayan:layan",
    34: "petani:tani petugas:tugas pedagang:dagang pejabat:jabat petinju:tinju",
    35: "terpercaya:percaya terkerdil:kerdil",
    36: "pekerja:kerja peternak:ternak",
    37: "gerigi:gigi",
    38: "geligi:gigi telunjuk:tunjuk",
    39: "gemetar:getar",
    40: "kinerja:kerja sinambung:sambung",
}
#: Words without a numbered rule, of several affixes, doubled, or with letters that look like affixes.
OTHERS = (
    "harganya:harga rumahku:rumah bukumu:buku siapakah:siapa bacalah:baca apapun:apa makanan:makan minuman:minum sukai:suka "
    "tulisan:tulis ambilkan:ambil dibaca:baca dimakan:makan ditulis:tulis kebersihan:bersih kedua:dua sebuah:buah seorang:orang "
    "kuambil:ambil kaubaca:baca pekerjaan:kerja pelayanan:layan pelayanannya:layan kepercayaan:percaya ketahanan:tahan "
    "mempermainkan:main memperbaiki:baik diperbaiki:baik keberhasilan:hasil keterlambatan:lambat ketertarikan:tarik "
    "menyebabkan:sebab membersihkan:bersih dibersihkan:bersih membicarakan:bicara mengetahui:tahu diketahui:tahu bersekolah:sekolah "
    "bertebaran:tebar dimulai:mulai terabai:abai perubahan:ubah mengendarai:kendara menghargai:harga pertanggungjawaban:tanggungjawab "
    "rumah-rumah:rumah buku-bukunya:buku anak-anak:anak berjalan-jalan:jalan meniru-niru:tiru bukuku:buku buku-ku:buku "
    "makan:makan ikan:ikan bulan:bulan hari:hari telah:telah sekolah:sekolah berani:berani ini:ini itu:itu di:di nasi:nasi "
    "masakan:masak sepatu:sepatu katak:katak katakan:kata rusaknya:rusak kerusakan:rusak perusakan:rusak memakan:makan "
    "xyzzy:xyzzy dilempar-lempar:lempar kembalikan:kembali pengembalian:kembali tendangan:tendang katakanlah:kata"
)
PAIRS = [p.split(":") for words in (*BY_RULE.values(), OTHERS) for p in words.split()]
LIST_ROOTS = frozenset(r for _, r in PAIRS) - {"xyzzy"}


def test_list_is_whole():
    assert len(PAIRS) >= 200
    assert set(BY_RULE) == {n for n, _, _ in (*PREFIX_RULES, *INFIX_RULES)} - {33}


def test_words_and_rules():
    wrong = [(w, r, explain(w, LIST_ROOTS)) for w, r in PAIRS if stem(w, LIST_ROOTS) != r]
    assert not wrong
    missed = [(n, w, explain(w, LIST_ROOTS)) for n, words in BY_RULE.items() for w, _ in (p.split(":") for p in words.split()) if n not in explain(w, LIST_ROOTS)[1]]
    assert not missed


def test_rule_33_takes_a_consonant_too():
    assert explain("peserani", frozenset({"erani"})) == ("erani", (33,))


@pytest.mark.parametrize(("prefix", "suffix"), sorted(DISALLOWED))
def test_disallowed_pairs_keep_their_word(prefix, suffix):
    """The root alone is known, so only the pair could lead to it."""
    outer = {"be": "ber", "te": "ter", "me": "mem"}.get(prefix, prefix)
    word = f"{outer}bocor{suffix}"
    assert stem(word, frozenset({"bocor"})) == word
    assert stem(f"{outer}bocor", frozenset({"bocor"})) == "bocor"


def test_steps_show_the_order():
    assert explain("pelayanannya", LIST_ROOTS) == ("layan", ("nya", "an", 32))
    assert explain("mempermainkan", LIST_ROOTS)[0] == "main" and explain("mempermainkan", LIST_ROOTS)[1][0] == "kan"
    assert explain("bersekolah", LIST_ROOTS) == ("sekolah", (2,))
    assert explain("katakan", frozenset({"katak", "kata"})) == ("kata", ("kan",))
    assert explain("katakan", frozenset({"katak"})) == ("katak", ("an",))  # the k may be the root's
    assert explain("di", LIST_ROOTS) == ("di", ()) and explain("", LIST_ROOTS) == ("", ()) and explain("-", LIST_ROOTS) == ("", ())


def test_large_dictionary(spark, tmp_path):
    """30,000 roots from a file: read, shipped to the stemmer and used to squeeze letters; every root is found again."""
    letters, rng = "bdgklmnprst", random.Random(3)
    syllable = lambda: rng.choice(letters) + rng.choice("aiueo")
    made = sorted({syllable() + syllable() + syllable() + rng.choice("bdgpr") for _ in range(60_000)})[:29_000]
    double = [w[:3] + w[3] * 2 + w[4:] for w in made[:1_000]]
    assert len(made) == 29_000
    path = tmp_path / "roots.txt"
    path.write_text("\n".join(made + double))
    roots = read_roots(spark, str(path))
    assert len(roots) == 30_000
    words = spark.createDataFrame([(f"di{w}kan", w) for w in made[::10]] + [(f"{w}nya", w) for w in made[5::10]], "word string, root string")
    back = stem_map(words, "word", roots).join(words, F.col("token") == F.col("word"))
    assert back.filter("stem <> root").count() == 0 and back.count() == len({w for w in made[::10]}) + len(made[5::10])
    text = spark.createDataFrame([(0, double[7].replace(double[7][3] * 2, double[7][3] * 5) + " " + made[2_000] + made[2_000][-1] * 4)], "doc_idx long, text string")
    assert text.select(squeeze_letters(F.col("text"), roots)).first()[0] == f"{double[7]} {made[2_000]}"
    config = CleanConfig(remove_stopwords=False, fix_typos=False, normalize_slang=False)
    assert clean(text, config, lexicon=Lexicon(roots=roots)).first().processed_text == f"{double[7]} {made[2_000]}"
