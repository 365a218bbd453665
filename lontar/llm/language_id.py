"""Language ID by error-correcting output codes.

Each language has a codeword; binary classifiers over hashed byte trigrams predict its bits; decoding weights each bit's
logistic loss by how well that bit did in training and takes the nearest codeword, flagging texts whose runner-up is near.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm.common import read

#: Features; labelled documents a language gives at most; steps of training; runner-up closer than this is ambiguous.
WIDTH, PER_LANGUAGE, STEPS, MARGIN = 2048, 300, 120, 0.2
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, all else in ASCII as a space; bytes of other characters stay.
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_RUNS = re.compile(rb" +")


def trigrams(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, so that the vector's length is 1. No letters: zero."""
    raw = np.frombuffer(_RUNS.sub(b" ", b" " + (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN) + b" "), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(WIDTH, np.float32)
    codes = (raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)) * np.uint32(2654435761)
    found = np.bincount(codes >> np.uint32(32 - 11), minlength=WIDTH).astype(np.float32)
    return np.sqrt(found / found.sum())


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 with a large least distance: the best of 500 seeded draws. Each column tells some apart."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    bits, rng, best, most = max(15, 5 * int(np.ceil(np.log2(n)))), np.random.default_rng(7), None, -1
    for _ in range(500):
        drawn = rng.integers(0, 2, (n, bits)) * 2 - 1
        drawn[0, np.abs(drawn.sum(0)) == n] *= -1
        least = min(int((drawn[i] != drawn[j]).sum()) for i, j in combinations(range(min(n, 64)), 2))
        if least > most:
            best, most = drawn, least
    return best.astype(np.float32)


def train(features: np.ndarray, labels: np.ndarray, n: int) -> dict:
    """Logistic regression for every bit at once, by Nesterov steps; languages weigh the same however often they occur."""
    code = codewords(n)
    want = code[labels]
    weight = (1 / np.bincount(labels, minlength=n))[labels][:, None].astype(np.float32)
    weight /= weight.sum()
    x = np.hstack([features, np.ones((len(features), 1), np.float32)])
    w = ahead = np.zeros((x.shape[1], code.shape[1]), np.float32)
    for step in range(STEPS):
        slope = -want / (1 + np.exp(np.clip(want * (x @ ahead), -30, 30))) * weight
        new = ahead - 8.0 * (x.T @ slope + 1e-5 * ahead)
        w, ahead = new, new + step / (step + 3) * (new - w)
    hit = (np.sign(x @ w) == want).astype(np.float32) * weight
    error = np.clip(1 - hit.sum(0), 0.001, 0.499)
    return {"w": w, "code": code, "bit": np.log((1 - error) / error).astype(np.float32) / np.log(999)}


def decode(features: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of exp(-loss) over all, and whether the runner-up is near."""
    margin = np.clip(features @ model["w"][:-1] + model["w"][-1], -30, 30)
    plus, minus = np.log1p(np.exp(-margin)) * model["bit"], np.log1p(np.exp(margin)) * model["bit"]
    loss = plus @ (model["code"].T > 0) + minus @ (model["code"].T < 0)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    order = np.sort(share, 1)
    second = order[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
    return share.argmax(1), order[:, -1], order[:, -1] - second < MARGIN


def _held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame) -> tuple[list[str], dict | None]:
    """Model of the languages in docs (doc_id, text, lang), from at most PER_LANGUAGE texts of each, by hash order. Of texts
    that are repeated in a language one is learned from, so the bound holds whatever the ids are."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~_held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("text"))
    distinct = labelled.groupBy("lang", "h").agg(F.min(F.xxhash64("doc_id")).alias("o"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "h"))
    chosen = distinct.withColumn("r", place).filter(F.col("r") <= PER_LANGUAGE).select("lang", "h")
    sample = labelled.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # PER_LANGUAGE texts of each language

    def features(batches):
        for batch in batches:
            rows = [trigrams(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    rows = sample.select("lang", "text").mapInArrow(features, "lang string, x binary").collect()
    languages = sorted({r.lang for r in rows})
    if not rows:
        return [], None
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows])
    return languages, train(x, np.array([languages.index(r.lang) for r in rows]), len(languages))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    A null text, or one without letters, is `und` with score 0; so are all where no row is labelled. Predictions read the
    text alone, and all of it, however long. A null id counts as an empty string in the held-out rule, which holds it out, so
    it is never learned from; nor are null labels. Of languages with equal loss the first by name is predicted. Repeated rows
    get equal predictions; other columns are left out; an empty table gives no row.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    languages, model = fit(named)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def predict(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(2).to_pylist()
                lettered = np.array([bool(t and _LETTER.search(t)) and model is not None for t in texts])
                best, score, near = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if lettered.any():
                    x = np.stack([trigrams(t) for t, yes in zip(texts, lettered, strict=True) if yes])
                    best[lettered], score[lettered], near[lettered] = decode(x, model)
                names = [languages[k] if yes else "und" for k, yes in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(score), pa.array(near)], schema=schema)

    return named.select("doc_id", _held_out(F.col("doc_id")), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
