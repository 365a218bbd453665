"""Behaviour tests of a sentiment scorer, and a probe of whether a tagger reads patterns or remembers words.

Cases are frames: templates filled by joins of small word lists, and perturbed by Column expressions. A scorer is any function
of a frame with a text column to one with sentiment and scores, so what scores corpora is what is tested.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.tables import materialize

# ---- FIXED VALUES: the words that fill the templates, and how people respell them -----------------------------------------
SUBJECTS = ("pelayanannya", "produknya", "aplikasinya", "makanannya", "tempatnya", "harganya", "kualitasnya", "petugasnya")
GOOD = ("bagus", "memuaskan", "ramah", "cepat", "nyaman", "rapi")
BAD = ("buruk", "mengecewakan", "lambat", "kotor", "berantakan", "payah")
NEGATORS = ("tidak", "kurang", "nggak", "gak")
FACTS = (
    "rapat dimulai pukul sembilan pagi", "kantor buka setiap hari senin sampai jumat", "antrian dibagi menjadi tiga jalur",
    "formulir tersedia di lantai dua", "jadwal keberangkatan tertera di layar",
)
RESPELLED = {"tidak": "gk", "sangat": "bgt", "yang": "yg", "dengan": "dgn", "saja": "aja", "sudah": "udh", "tempatnya": "tmptnya"}
ADDED_BLAME = " tapi petugasnya sangat kasar"
RISE = 0.05
# ---- end of fixed values ----------------------------------------------------------------------------------------------


def _list(spark: SparkSession, name: str, words) -> DataFrame:
    """The words with their numbers."""
    return spark.createDataFrame(list(enumerate(words)), f"{name}_i int, {name} string")


def minimal_cases(spark: SparkSession) -> DataFrame:
    """test, text, expected of the minimal functionality tests: plain praise and blame, negated ones, contrast, plain facts.
    `not-negative` takes positive and neutral."""
    subjects, good, bad, no = (_list(spark, n, w) for n, w in (("s", SUBJECTS), ("g", GOOD), ("b", BAD), ("n", NEGATORS)))
    case = lambda df, test, text, expected: df.select(F.lit(test).alias("test"), text.alias("text"), F.lit(expected).alias("expected"))
    spaced = lambda *c: F.concat_ws(" ", *c)
    first = subjects.filter("s_i < 5")
    few = subjects.filter("s_i < 4").join(no.filter("n_i < 2"), how="cross")
    other = subjects.select((F.col("s_i") - 4).alias("s_i"), F.col("s").alias("o"))
    contrast = subjects.filter("s_i < 4").join(other, "s_i").join(good.filter("g_i < 3").join(bad, F.col("g_i") == F.col("b_i")), how="cross")
    parts = [
        case(first.join(good.filter("g_i < 4"), how="cross"), "plain praise", spaced("s", "g"), "positive"),
        case(first.join(bad.filter("b_i < 4"), how="cross"), "plain blame", spaced("s", "b"), "negative"),
        case(few.join(good.filter("g_i < 3"), how="cross"), "negated praise", spaced("s", "n", "g"), "negative"),
        case(few.join(bad.filter("b_i < 3"), how="cross"), "negated blame", spaced("s", "n", "b"), "not-negative"),
        case(contrast, "contrast to blame", spaced("s", "g", F.lit("tapi"), "o", "b"), "negative"),
        case(contrast, "contrast to praise", spaced("s", "b", F.lit("tapi"), "o", "g"), "positive"),
        case(_list(spark, "f", FACTS), "plain facts", F.col("f"), "neutral"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def base_texts(spark: SparkSession) -> DataFrame:
    """i, text: plain sentences that perturbations start from, praise first."""
    subjects = _list(spark, "s", SUBJECTS[:4])
    words = spark.createDataFrame([(k, w) for k, w in enumerate((*GOOD[:3], *BAD[:3]))], "k int, w string")
    return subjects.join(words, how="cross").select((F.floor(F.col("k") / 3) * 12 + F.col("s_i") * 3 + F.col("k") % 3).cast("int").alias("i"), F.concat_ws(" ", "s", "w").alias("text"))


def perturbations() -> dict[str, Callable[[Column], Column]]:
    """Surface changes that must leave a label as it is."""

    def respelled(text: Column) -> Column:
        word = lambda w: F.coalesce(*(F.when(w == k, v) for k, v in RESPELLED.items()), w)
        return F.array_join(F.transform(F.split(text, " "), word), " ")

    return {
        "respelling": respelled, "drawn out": lambda t: F.concat(t, F.repeat(F.substring(t, -1, 1), F.lit(3))), "emoji": lambda t: F.concat(t, F.lit(" 😊😊")),
        "capitals": F.upper, "exclamation": lambda t: F.concat(t, F.lit("!!!")),
    }


def behaviour_cases(spark: SparkSession) -> DataFrame:
    """kind (MFT, INV, DIR), test, text, base (the text it is held against, null for MFT), expected."""
    none = F.lit(None).cast("string")
    out = minimal_cases(spark).select(F.lit("MFT").alias("kind"), "test", "text", none.alias("base"), "expected")
    base = base_texts(spark)
    for name, change in perturbations().items():
        out = out.unionByName(base.select(F.lit("INV").alias("kind"), F.lit(name).alias("test"), change(F.col("text")).alias("text"), F.col("text").alias("base"), none.alias("expected")))
    blamed = base.filter("i < 12").select(F.lit("DIR").alias("kind"), F.lit("added blame").alias("test"), F.concat("text", F.lit(ADDED_BLAME)).alias("text"), F.col("text").alias("base"), none.alias("expected"))
    return out.unionByName(blamed)


def judged(cases: DataFrame, score: Callable[[DataFrame], DataFrame], distinct: bool = True) -> DataFrame:
    """cases with label, base_label, score, base_score (of praise) and passed. score gets a frame with doc_idx and text and
    gives doc_idx, sentiment, scores. Cases meet their scores by digests of their texts.

    Each distinct text is scored once, for which texts are shuffled; without `distinct` each is scored where it stands, which
    costs less for a cheap scorer, and must then score equal texts alike."""
    digest = lambda c: F.md5(F.col(c))
    texts = cases.select(F.explode(F.array("text", "base")).alias("text")).filter("text is not null")
    scored = score((texts.distinct() if distinct else texts).withColumn("doc_idx", digest("text"))).groupBy("doc_idx").agg(F.first("sentiment").alias("label"), F.first("scores.positive").alias("score"))
    named = materialize(scored, "behaviour_scores")
    keyed = cases.withColumns({"_t": digest("text"), "_b": digest("base")})
    both = keyed.join(named.withColumnRenamed("doc_idx", "_t"), "_t").join(named.withColumnsRenamed({"doc_idx": "_b", "label": "base_label", "score": "base_score"}), "_b", "left").drop("_t", "_b")
    right = F.when(F.col("expected") == "not-negative", F.col("label") != "negative").otherwise(F.col("label") == F.col("expected"))
    passed = F.when(F.col("kind") == "MFT", right).when(F.col("kind") == "INV", F.col("label") == F.col("base_label")).otherwise(F.round(F.col("score") - F.col("base_score"), 6) <= RISE)
    return both.withColumn("passed", passed)


def report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "test").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("double")), 4).alias("pass_rate"))


# ---- the pattern probe ------------------------------------------------------------------------------------------------
def probe_cases(spark: SparkSession, templates: list[str], groups: dict[str, list[str]] | DataFrame) -> DataFrame:
    """doc_idx, group, word, text, slot_start, slot_end: every word of every group in every template (`{}` is the slot).
    groups: words by group, or a frame of group and word."""
    words = groups if isinstance(groups, DataFrame) else spark.createDataFrame([(g, w) for g, held in groups.items() for w in held], "group string, word string")
    shapes = F.array(*(F.struct(F.lit(t.split("{}", 1)[0]).alias("head"), F.lit(t.split("{}", 1)[1]).alias("tail")) for t in templates))
    filled = words.select("group", "word", F.inline(shapes))
    text = F.concat("head", "word", "tail")
    return filled.select(F.xxhash64("group", text).alias("doc_idx"), "group", "word", text.alias("text"), F.char_length("head").alias("slot_start"), (F.char_length("head") + F.char_length("word")).alias("slot_end"))


def probe_report(cases: DataFrame, spans: DataFrame, key: str = "doc_idx") -> DataFrame:
    """group, n, hits, hit_rate (percent): cases in which a span overlaps the slot."""
    s = spans.select(F.col(key).alias("_k"), F.col("start").alias("_a"), F.col("end").alias("_z"))
    hit = cases.join(s, (F.col(key) == F.col("_k")) & (F.col("_a") < F.col("slot_end")) & (F.col("_z") > F.col("slot_start")), "left_semi").select(key, F.lit(1).alias("_hit"))
    joined = cases.join(hit, key, "left")
    return joined.groupBy("group").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"), F.round(F.count("_hit") * 100 / F.count("*"), 1).alias("hit_rate"))


def probe_verdict(rates: dict[str, float]) -> str:
    """What hit rates of seen, unseen and made-up words tell: rarely, pattern, mixed, partly, memory."""
    gap = rates["seen"] - rates["unseen"]
    if rates["seen"] < 50:
        return "rarely"
    if gap <= 15:
        return "pattern" if rates["nonce"] >= 50 else "mixed"
    return "partly" if gap <= 40 else "memory"
