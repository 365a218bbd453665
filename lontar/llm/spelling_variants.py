"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary sends out all that one deletion, one replacement and one insertion over the observed alphabet
make of it, each once. What is in the vocabulary is a near word, by construction: candidates are hash-joined with the
vocabulary as they are, and no distance is computed. So that candidates that are in no vocabulary stay where they were
made, tasks first look up their rolling hashes in a bit filter of the vocabulary, whose size is bounded; a full filter lets
more candidates through to the join, which is exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import materialize, read, remove
from lontar.llm.merkle_manifest import CRC_TABLE, crc32_sql

#: Bits of the filter are powers of two between these: 64 MB at most, and 64 bits or more a word up to eight million words.
FILTER_BITS = (18, 29)
#: Different words of a task that are counted before it hands on its counts; runs of a text that are held at a time.
COUNTED, HELD = 200_000, 100_000
#: Candidates that a task hashes at a time.
CANDIDATES = 1_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
HITS = pa.schema([("word", pa.string()), ("candidate", pa.string())])


def _count(least: int, damage: int):
    """Partial counts of the runs of letters. In Latin-1, where other characters become `?`, a character is a byte and
    lower() changes A-Z only."""
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def held(counts: Counter):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], schema=COUNTS)

    def task(batches):
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                found = (m[0] for m in run.finditer((text.as_py() or "").encode("latin-1", "replace").lower()))
                while part := Counter(islice(found, HELD)):
                    for word, n in part.items():
                        if damage and (h := zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)) % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        counts[word] += n
                    if len(counts) > COUNTED:
                        yield held(counts)
                        counts.clear()
        yield held(counts)

    return task


def mixed(hashes: np.ndarray, lengths) -> np.ndarray:
    """Spreads rolling hashes of words of those lengths over 64 bits."""
    x = hashes + np.asarray(lengths, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1, *[_MULTIPLIER] * (n - 1)], np.uint64)) if n else np.empty(0, np.uint64)


def _rows(words: list[bytes]):
    """Words of one length as rows of codes, a few at a time: (length, words, codes)."""
    by: dict[int, list[bytes]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for length, group in by.items():
        step = max(1, CANDIDATES // (100 * (length + 1)))
        for at in range(0, len(group), step):
            part = group[at : at + step]
            yield length, part, np.frombuffer(b"".join(part), np.uint8).reshape(len(part), length)


def places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A word's two bits in the filter."""
    mask = np.uint64(size - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(33)) & mask).astype(np.int64)


def neighbourhood(length: int, codes: np.ndarray, alphabet: np.ndarray):
    """All different words one edit away from words of one length, as (kind, first position, hashes): hashes has a row a word
    and a column a position, and for `replace` and `insert` a third axis, the letter. False in the mask that goes along: this
    edit gives the word itself, or what another position gives."""
    powers, letters = _powers(length + 1), alphabet.astype(np.uint64)
    sums = np.zeros((len(codes), length + 1), np.uint64)
    np.cumsum(codes * powers[:length], axis=1, out=sums[:, 1:])
    whole = sums[:, -1:]
    inner = np.ones((len(codes), length), bool)
    inner[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of equal letters side by side the first goes
    yield "delete", 0, sums[:, :-1] + (whole - sums[:, 1:]) * np.uint64(_INVERSE), inner
    step = max(1, CANDIDATES // (len(codes) * len(letters) or 1))
    for a in range(0, length + 1, step):
        b = min(a + step, length + 1)
        stem, own = sums[:, a:b], codes[:, a : min(b, length)]
        new = np.ones((len(codes), b - a, len(letters)), bool)
        new[:, : own.shape[1]] = own[:, :, None] != alphabet  # an equal letter goes in behind the one that stands there
        yield "insert", a, (stem + (whole - stem) * np.uint64(_MULTIPLIER))[:, :, None] + letters * powers[a:b, None], new
        if own.shape[1]:
            at = powers[a : a + own.shape[1]]
            yield "replace", a, (whole - own * at)[:, :, None] + letters * at[:, None], new[:, : own.shape[1]]


def _filter_places(size: int):
    def task(batches):
        for batch in batches:
            for length, part, codes in _rows([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                hashes = mixed((codes * _powers(length)).sum(axis=1, dtype=np.uint64), length)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(hashes, size)))], names=["place"])

    return task


def _emit(bits: np.ndarray, alphabet: bytes):
    size, letters = len(bits) * 8, np.frombuffer(alphabet, np.uint8)
    longer = {"delete": -1, "replace": 0, "insert": 1}

    def task(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for length, words, codes in _rows([w.encode("latin-1") for w in batch.column(0).to_pylist()]):
                for kind, first, hashes, new in neighbourhood(length, codes, letters):
                    one, two = places(mixed(hashes, length + longer[kind]), size)
                    hit = new & ((bits[one >> 3] >> (one & 7)) & 1 == 1)
                    for found in zip(*np.nonzero(hit), strict=True):
                        if bits[two[found] >> 3] >> (two[found] & 7) & 1:
                            word, at = words[found[0]], first + int(found[1])
                            letter = b"" if kind == "delete" else alphabet[found[2] : found[2] + 1]
                            out[0].append(word.decode("latin-1"))
                            out[1].append((word[:at] + letter + word[at + (kind != "insert") :]).decode("latin-1"))
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], schema=HITS)
                    out = ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], schema=HITS)

    return task


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, candidate): words of the vocabulary (column word, Latin-1 letters, each once) one edit apart, either way round."""
    low, high = FILTER_BITS
    size = 1 << min(high, max(low, (64 * vocabulary.count()).bit_length()))
    bit = F.col("place") + 1
    filled = vocabulary.select("word").mapInArrow(_filter_places(size), "place long").groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    bits = np.zeros(size // 8, np.uint8)
    for b, held in filled.toLocalIterator():  # at most 16,384 rows of 4 KB
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(held, np.uint8)[: size // 8]
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()  # 90 at most
    alphabet = "".join(sorted(r.c for r in letters.collect())).encode("latin-1")
    emitted = vocabulary.select("word").mapInArrow(_emit(bits, alphabet), "word string, candidate string")
    return emitted.join(vocabulary.select(F.col("word").alias("candidate")), "candidate", "left_semi")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form, by doubling: a form's count is five times its word's or more, so 27 steps are
    the longest way and five rounds reach its end."""
    here = materialize(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = here.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialize(here.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling_roots")
        remove(here)
        here = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return here


def spelling_variants(docs: DataFrame, least: int = 6, occurrences: int = 5, ratio: int = 5, damage: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least `least` letters and so many occurrences.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Near words differ by one inserted, deleted or replaced
    code point. form: the near word of largest n, ties to the smaller in code-point order, if its n is `ratio` (at least 2)
    times the word's or more; root: where forms lead. damage: a run whose CRC-32 with the id (empty if null) it divides loses
    a letter, which plants variants. Null and empty texts have no words; whole texts count, however long; rows repeated count
    each; other columns are left out; a table without words gives no row.
    """
    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(_count(least, damage), "word string, n long")
    vocabulary = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= occurrences) & (F.char_length("word") >= least)), "spelling_words")
    near = near_words(vocabulary).join(vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("near_n")), "candidate")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "candidate")).alias("best")).select("word", "n_near", F.col("best.candidate").alias("form"), (-F.col("best.col1")).alias("form_n"))
    found = F.col("form_n") >= ratio * F.col("n")
    words = materialize(vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(found, F.col("form")).alias("form"), F.when(found, F.col("form_n")).alias("form_n")), "spelling_forms")
    remove(vocabulary)
    ends = roots(words.filter("form is not null"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), damage=199)


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents),
each AS (SELECT r, coalesce(doc_id::VARCHAR, '') || ':' || r AS s, count(*) AS n FROM runs WHERE length(r) >= 6 GROUP BY doc_id, r),
hashed AS (SELECT r, n, {crc32_sql("s")} AS h FROM each, crc),
voc AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(n) >= 5 AND length(word) >= 6),
dels AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM voc)),
pairs AS (
  SELECT a.word, b.word AS other FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word FROM dels a JOIN voc v ON a.d = v.word
  UNION SELECT v.word, a.word FROM dels a JOIN voc v ON a.d = v.word),
near AS (SELECT p.word, other, o.n AS m, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, other) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN voc o ON o.word = other),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM voc v LEFT JOIN near x ON x.word = v.word AND k = 1),
way(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM way w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN way w ON w.word = f.word JOIN forms e ON e.word = w.here AND e.form IS NULL
"""
