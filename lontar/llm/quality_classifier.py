"""Quality classifier: ordinal cumulative-link (proportional-odds) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds part them:
P(grade >= k) = sigmoid(w.x - threshold_k). A document gets its expected grade and the probability of the top grade.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import read

#: Hashed features (a power of two), rated documents used for fitting at most, training steps, weight penalty.
WIDTH, SAMPLE, STEPS, PENALTY = 2**16, 6000, 150, 2e-4
#: Grades: low quality 0, good but toxic 1, good 2. A document is selected if P(grade >= 2) is over one half.
GRADES = 3
_EDGE = re.compile(r"^\W+|\W+$")
_FIB = 11400714819323198485


class Features(dict):
    """Feature number of a word, and of its shape (letter case and punctuation, runs shortened)."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) > 500_000:
            self.clear()
        shape = re.sub(r"(.)\1{2,}", r"\1\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))
        self[word] = found = (_hash("w" + _EDGE.sub("", word.lower())), _hash("s" + shape[:12]))
        return found

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers and values: 1 for a word that occurs, root of the share for shapes and repeats."""
        words = (text or "").split()
        if not words:
            return np.array([_EMPTY], np.int32), np.ones(1, np.float32)
        pairs = np.array([self[w] for w in words], np.int64)
        lexical = np.unique(pairs[:, 0])
        shapes, n = np.unique(pairs[:, 1], return_counts=True)
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        ids = np.concatenate([lexical, shapes, [_REPEAT, _LENGTH]])
        values = np.concatenate([np.ones(len(lexical)), 3 * np.sqrt(n / len(words)), [3 * np.sqrt(again / len(words)), 1 / np.sqrt(len(words))]])
        return ids.astype(np.int32), values.astype(np.float32)


def _hash(token: str) -> int:
    h = 1469598103934665603
    for b in token.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 1099511628211) & (2**64 - 1)
    return ((h * _FIB) & (2**64 - 1)) >> (64 - 16)


_EMPTY, _REPEAT, _LENGTH = _hash("<empty>"), _hash("<repeat>"), _hash("<length>")


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_ordinal(ids: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, steps: int = STEPS) -> dict:
    """Proportional-odds fit by Adagrad on the likelihood of the cumulative links, classes weighted evenly.

    Thresholds are a first one and positive steps (exponentials), so they stay ordered.
    """
    where, flat = np.cumsum([0, *map(len, ids)])[:-1], np.concatenate(ids)
    value = np.concatenate(values)
    which = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    seen = np.maximum(np.bincount(grades, minlength=GRADES), 1)
    weight = (1 / seen)[grades] / GRADES
    w, cuts = np.zeros(WIDTH), np.array([-0.5, 0.0])
    gw, gc = np.full(WIDTH, 1e-8), np.full(2, 1e-8)
    for _ in range(steps):
        score = np.add.reduceat(value * w[flat], where)
        low, high = cuts[0], cuts[0] + np.exp(cuts[1])
        p1, p2 = _sigmoid(score - low), _sigmoid(score - high)
        d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
        prob = np.maximum(np.choose(grades, [1 - p1, p1 - p2, p2]), 1e-9)
        to1 = np.choose(grades, [-d1, d1, np.zeros_like(d1)]) / prob * weight  # d log p / d (score - low)
        to2 = np.choose(grades, [np.zeros_like(d2), -d2, d2]) / prob * weight
        slope = np.bincount(flat, weights=value * (to1 + to2)[which], minlength=WIDTH) - PENALTY * w
        cut_slope = np.array([-(to1.sum() + to2.sum()), -to2.sum() * np.exp(cuts[1])])
        gw += slope**2
        gc += cut_slope**2
        w += 0.1 * slope / np.sqrt(gw)
        cuts += 0.1 * cut_slope / np.sqrt(gc)
    return {"w": w.astype(np.float32), "cuts": (float(cuts[0]), float(cuts[0] + np.exp(cuts[1])))}


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model from at most SAMPLE rated documents, first by hash of their ids. docs: doc_id, text. Of several ratings of a
    document the lowest counts, and of several texts of an id the one with the smallest hash, so the bound holds."""
    rated = labels.filter("doc_id is not null and quality is not null").select("doc_id", (2 * F.col("quality") - F.when(F.col("quality") > 0, F.coalesce("toxic", F.lit(0))).otherwise(0)).cast("int").alias("grade"))
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def features(batches):
        known = Features()
        for batch in batches:
            rows = [known.row(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=["grade", "i", "v"])

    rows = sample.select("grade", "text").mapInArrow(features, "grade int, i binary, v binary").collect()  # SAMPLE rows
    if not rows:
        return None
    return fit_ordinal([np.frombuffer(r.i, np.int32) for r in rows], [np.frombuffer(r.v, np.float32) for r in rows], np.clip([r.grade for r in rows], 0, GRADES - 1))


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, expected_grade (0 to 2), p_good (probability of grade 2), selected.

    labels holds doc_id, quality (0, 1) and toxic (0, 1; null counts as 0); of several labels of a document the lowest grade
    counts. Null text counts as empty, and all of a text is read, however long. Without any rated document grades and
    probabilities are null and nothing is selected. Null ids and repeated rows are graded like others; a document at one half
    is not selected; other columns are left out; an empty table gives no row.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(named, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("p_good", pa.float64()), ("selected", pa.bool_())])

    def score(batches):
        known = Features()
        for batch in batches:
            if model is None:
                none = pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0), none, none, pa.array([False] * batch.num_rows)], schema=schema)
                continue
            totals = np.array([float(v @ model["w"][i]) for i, v in map(known.row, batch.column(1).to_pylist())])
            p1, p2 = (_sigmoid(totals - cut) for cut in model["cuts"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p1 + p2), pa.array(p2), pa.array(p2 > 0.5)], schema=schema)

    return named.mapInArrow(score, "doc_id long, expected_grade double, p_good double, selected boolean")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return grade(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
