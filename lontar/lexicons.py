"""Indonesian word lists.

The lists under FIXED VALUES must equal the ones users know for right results. There is no slang dictionary here: pass one as a
file (sources.read_pairs). The stopword and root lists in daily use are longer than the seeds here: pass files for those
too (sources.read_stopwords, read_roots).
"""

from __future__ import annotations

from lontar.config import Lexicon

# ---- FIXED VALUES -----------------------------------------------------------------------------------------------------
NEGATIONS = frozenset(
    "tidak tak tdk bukan bkn jangan jgn belum blm kurang krg tanpa gak nggak ga gk enggak engga kagak ndak never no not".split()
)
LEXICON_NEGATIONS = frozenset("tidak tak bukan gak nggak enggak ga kagak jangan belum tanpa kurang".split())
POSITIVE = frozenset(
    "baik bagus hebat mantap keren sempurna memuaskan senang suka cinta indah cantik ganteng pintar cerdas ramah sopan "
    "berkualitas recommended puas excellent positif gembira sukses berhasil unggul terbaik nyaman murah cepat bersih enak "
    "lancar adil jujur aman rapi terjangkau membantu".split()
)
NEGATIVE = frozenset(
    "buruk jelek parah mengecewakan kecewa benci marah kesal lambat rusak salah gagal error bermasalah komplain negatif sedih "
    "susah sulit ribet payah mahal kotor lelet curang korupsi bohong menyiksa menyebalkan terlambat antri macet bangkrut "
    "menderita".split()
)
SOCIAL_STOPWORDS = frozenset(
    "sih kok dong deh lho nih dunk donk yg utk dgn tsb dll dsb dst krn pd tdk dr kpd thd dg gak ga ngga nggak gk ya jadi nah "
    "wah aduh waduh duh ah oh eh anjay anjir astaga asem asdf asdfgh nya lah kah pun tuh yah sih2".split()
)
TYPOS = {
    "terima kasi": "terima kasih", "terimakasi": "terima kasih", "terimakasih": "terima kasih", "trimakasih": "terima kasih",
    "silahkan": "silakan", "silahakan": "silakan", "applikasi": "aplikasi", "aplication": "aplikasi", "comunity": "komunitas",
    "communtiy": "komunitas", "reccomend": "rekomendasi", "recomend": "rekomendasi", "rekomen": "rekomendasi",
    "drngan": "dengan", "drpat": "dapat", "adlah": "adalah", "trlalu": "terlalu", "brlaku": "berlaku", "brkata": "berkata",
    "brjalan": "berjalan", "mngkin": "mungkin", "mnrt": "menurut", "untk": "untuk", "untul": "untuk", "unruk": "untuk",
    "dgan": "dengan", "denga": "dengan", "yng": "yang", "yagn": "yang", "apotik": "apotek", "analisa": "analisis",
    "analisys": "analisis", "ijin": "izin", "jaman": "zaman", "praktek": "praktik", "resiko": "risiko", "sistim": "sistem",
    "system": "sistem", "tehnik": "teknik", "tehnologi": "teknologi", "technology": "teknologi", "methode": "metode",
    "aktifitas": "aktivitas", "effectif": "efektif", "effisien": "efisien", "standard": "standar", "frequency": "frekuensi",
    "kwalitas": "kualitas", "kwantitas": "kuantitas", "wa": "whatsapp", "wassap": "whatsapp", "tokped": "tokopedia",
    "toped": "tokopedia", "shope": "shopee", "go-jek": "gojek",
}
TOPIC_LABEL_STOPWORDS = NEGATIONS | frozenset(
    "susah gampang mudah banget sekali sangat lebih paling makin terus aja saja juga udah sudah masih lagi harus bisa ada "
    "punya jadi buat hahaha haha wkwk wkwkwk ngapain emang memang kali kayak gitu gini begitu begini bilang orang yg nya ha "
    "hah loh lho lha noh nih tuh yah deh dong kok toh bu pak mas mbak bang ny lah kah pun".split()
)
COMMON_ASPECTS = frozenset(
    "pelayanan layanan service kualitas quality harga price kemasan packaging pengiriman delivery rasa taste tekstur ukuran "
    "size warna color desain design fitur feature performa performance ketahanan durability garansi warranty respon response "
    "kecepatan speed admin seller penjual toko shop store aplikasi app tampilan interface menu proses hasil kebersihan suasana "
    "lokasi tempat parkir akses fasilitas customer produk barang item stok stock cicilan ongkir ongkos biaya voucher diskon "
    "promo cashback bonus gratis komplain refund".split()
)
CLITICS = ("nya", "ku", "mu")
MERGE_PREFIXES = ("menge", "peng", "meng", "pem", "pen", "per", "mem", "men", "ber", "ter", "pe", "me", "di", "ke", "se")
VERBAL_PREFIXES = ("me", "di", "ter", "ber")
CONNECTIVES = ("tetapi", "namun", "sayangnya", "sedangkan", "padahal", "walaupun", "meskipun", "walau", "meski", "hanya saja", "cuma", "tapi", "kecuali")
TIME_UNITS = frozenset(
    "tahun bulan minggu hari jam menit detik pekan januari februari maret april mei juni juli agustus september oktober "
    "november desember senin selasa rabu kamis jumat sabtu".split()
)
# ---- end of fixed values ----------------------------------------------------------------------------------------------

#: Function words, own selection.
STOPWORDS = frozenset(
    "yang di ke dari dan atau untuk dengan pada adalah ini itu saya kamu dia kami kita mereka akan sudah telah sedang masih "
    "juga saja lagi oleh karena sebagai dalam bagi para serta agar supaya maka jika kalau bila ketika saat hingga sampai "
    "antara tentang seperti yaitu yakni bahwa tersebut ada bisa dapat harus sangat lebih paling hanya pun lah kah tidak "
    "bukan belum".split()
)

#: Root words, a seed of common ones.
ROOTS = frozenset(
    "layan harga baik bagus kerja tugas jabat pajak bersih cepat guna bayar beli jual kirim tulis baca ajar didik bangun "
    "jalan rumah makan minum pakai pilih lihat dengar kata tanya jawab bantu perintah negara rakyat uang gaji anggaran "
    "korupsi hukum adil aman damai kuat lemah besar kecil tinggi rendah mahal murah kualitas produk barang tempat kamar "
    "hotel wifi maaf saat lama baru sangat senang suka puas kecewa marah sedih susah mudah sulit sakit sehat obat dokter "
    "sekolah guru murid kantor usaha dagang tani ikan laut darat udara air api tanah hutan kota desa pulau hujan panas "
    "dingin terang gelap hidup mati lahir tumbuh kembang ubah tambah kurang naik turun masuk keluar buka tutup mulai akhir "
    "prajurit tunjangan gedung latih makanya empunya bahwasanya perang tahan serang menang kalah".split()
)

INDONESIAN = Lexicon(typos=TYPOS, stopwords=STOPWORDS | SOCIAL_STOPWORDS, negations=NEGATIONS, positive=POSITIVE, negative=NEGATIVE, lexicon_negations=LEXICON_NEGATIONS, roots=ROOTS)
