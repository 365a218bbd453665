"""Exact dedup by a Golomb-coded fingerprint exchange.

Senders (input partitions) sort the 64-bit fingerprints of their texts, code the gaps with a Golomb-Rice code and send a
message to each owner of a fingerprint range. Owners answer with bitmaps of what occurs twice or more. Only the suspects
so found are shuffled with their texts, where grouping by the bytes themselves settles equality. Texts and hashes of documents
that the suspects' filter does not hit are never shuffled: such a document is alone, and its row is made where its hash lies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import lower_ascii, materialize, shuffle_partitions, slices

ROW = "doc_id long, sha binary, owner int, sender long, n int, rice int, unary binary, rest binary, twice binary"
#: The suspects' filter that is broadcast has 16 bits or more a suspect, between these powers of two: 64 MB at most, which is
#: full enough for 30 million suspects. Fuller filters let more rows through to the join, which is exact.
FILTER_BITS = (15, 29)
#: Fingerprints that one owner merges, at most on average.
OWNED = 4_000_000


def rice_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of unsigned gaps: parameter, unary quotients, and remainders of so many bits each."""
    mean = float(gaps.astype(np.float64).mean()) if len(gaps) else 1.0
    k = int(max(0, min(63, np.floor(np.log2(max(mean * 0.69, 1.0))))))
    shift = np.uint64(k)
    quotients = (gaps >> shift).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k)
    gaps <<= np.uint64(k)
    for j in range(k):
        gaps |= bits[:, j].astype(np.uint64) << np.uint64(j)
    return gaps


def owner_start(owner: int, owners: int) -> int:
    """Smallest fingerprint of an owner's range: those whose upper half times `owners`, over 2**32, rounds down to it."""
    return -(-(owner << 32) // owners) << 32


def digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass").lower()).digest()  # bytes.lower() changes A-Z only


def _send(owners: int):
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("owner", pa.int32()), ("sender", pa.int64()), ("n", pa.int32()), ("rice", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary()), ("twice", pa.binary())])

    def run(batches):
        sender, seen = TaskContext.get().partitionId(), []
        for batch in batches:
            shas = [digest(t) for part in slices(batch) for t in part.column(1).to_pylist()]
            if shas:
                seen.append(np.frombuffer(b"".join(shas), ">u8")[::4].astype(np.uint64))
            none = [None] * len(shas)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), *(pa.array(none, f.type) for f in list(schema)[2:])], schema=schema)
        if not seen:
            return
        prints, counts = np.unique(np.concatenate(seen), return_counts=True)
        to = ((prints >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(to, prepend=to[0] + np.uint64(1)))
        for a, b in zip(cuts, [*cuts[1:], len(prints)], strict=True):
            owner = int(to[a])
            k, unary, rest = rice_encode(np.diff(prints[a:b], prepend=np.uint64(owner_start(owner, owners))))
            message = [None, None, owner, sender, int(b - a), k, unary, rest, np.packbits(counts[a:b] > 1).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(message, schema, strict=True)], schema=schema)

    return run


def _prints(row, owners: int) -> np.ndarray:
    return np.cumsum(rice_decode(row.n, row.rice, row.unary, row.rest), dtype=np.uint64) + np.uint64(owner_start(row.owner, owners))


def _answer(owners: int):
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        rows = list(messages.itertuples(index=False))
        lists = [_prints(r, owners) for r in rows]
        twice = [np.unpackbits(np.frombuffer(r.twice, np.uint8))[: r.n].astype(bool) for r in rows]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        doubled = np.union1d(values[counts > 1], np.concatenate([x[t] for x, t in zip(lists, twice, strict=True)]))
        out = [(r.owner, r.sender, np.packbits(hit).tobytes()) for r, x in zip(rows, lists, strict=True) if (hit := np.isin(x, doubled, assume_unique=True)).any()]
        return pd.DataFrame(out, columns=["owner", "sender", "bitmap"])

    return run


def _suspects(owners: int):
    def run(frames):
        for pdf in frames:
            found = [_prints(r, owners)[np.unpackbits(np.frombuffer(r.bitmap, np.uint8))[: r.n].astype(bool)] for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"fp": np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)})

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after lower-casing A-Z; null text counts as empty. The largest doc_id of equal texts stays; a
    null doc_id is below all others, and keep_id is null where a group has no other. Of rows equal in doc_id and text one
    stays. Whole texts count, however long. An empty table gives no row; other columns, whatever their names, are left out.
    """
    spark = docs.sparkSession
    owners = owners or max(shuffle_partitions(spark), -(-docs.count() // OWNED))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = materialize(base.mapInArrow(_send(owners), ROW), "exact_dedup_sent")
    messages = sent.filter("owner is not null").drop("doc_id", "sha")
    answers = messages.groupBy("owner").applyInPandas(_answer(owners), "owner int, sender long, bitmap binary")
    suspects = materialize(messages.join(answers, ["owner", "sender"]).mapInPandas(_suspects(owners), "fp long").distinct(), "exact_dedup_suspects")

    low, high = FILTER_BITS
    size = 1 << min(high, max(low, (16 * suspects.count()).bit_length()))
    place = F.expr(f"fp & {size - 1}") + 1
    filled = suspects.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = np.zeros(size // 8, np.uint8)
    for b, bits in filled.collect():  # at most 16,384 rows of 4 KB
        bitmap[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)

    def suspected(hashes: np.ndarray) -> pa.Array:
        low = hashes & np.uint64(size - 1)
        hit = (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1
        return pa.array(hashes.view(np.int64), mask=hit == 0)

    firsts = lambda shas: np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
    of_text = F.arrow_udf(lambda texts: suspected(firsts(digest(t) for part in slices(texts) for t in part.to_pylist())), "long")
    of_hash = F.arrow_udf(lambda shas: suspected(firsts(shas.to_pylist())), "long")
    moved = base.withColumn("fp", of_text("text")).filter("fp is not null").join(suspects, "fp", "left_semi")
    groups = (
        moved.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("t"))
        .groupBy("t").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
        .filter("size > 1").select(F.sha2("t", 256).alias("text_sha256"), "keep", "size")
    )
    rows = sent.filter("owner is null").select("doc_id", F.lower(F.hex("sha")).alias("text_sha256"), of_hash("sha").alias("fp"))
    alone = rows.filter("fp is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    asked = rows.filter("fp is not null").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"))
    keep_id = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    settled = (
        asked.join(groups, "text_sha256", "left")
        .select("doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )
    return alone.unionByName(settled)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from lontar.llm.common import read

    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
