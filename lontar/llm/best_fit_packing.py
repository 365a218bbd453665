"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents and gaps are run-length coded: a run stands for any number of documents of a length, ranked 0, 1, 2, ..., or of
sequences in a row with the same gap, so a round's table depends on the capacity, not on the documents. A round deals the runs
to ranges of sizes; in each range a sweep from large to small gives documents the smallest gap that is still free and holds
them. Where documents want the same gap the larger one has it, and of equal ones that of lower rank; the others wait. Then gaps
are updated, documents aim at the lowest range with a gap that holds them, as many sequences are opened as those need that no
gap can hold, and the next round begins, until none is left. Documents get their ranks from distributed counts and their places
by one join on length and rank.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm.common import gapless, materialize, read, remove, salts_for, slices

CAPACITY, END_ID = 2048, 0
#: Entries of one generation of a worker's cache of coded chunks, and of its words. A full generation becomes the older one, and
#: what is met there again moves to the new one; so frequent chunks stay and rare ones leave.
CACHE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Chunks(dict):
    """Ids of chunks between spaces, as little-endian 32-bit words. No pre-token crosses a space, so a text's ids are its
    chunks' ids in order. Chunks of plain Latin letters go straight to the BPE model, word by word; all others through
    the whole tokenizer."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.forget()
        self.simple = re.compile("[\x21-\x7eÀ-ÖØ-öø-įı-ſ]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.letters = byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if chunk.isascii() and chunk.isalpha():
                ids = self.word(chunk.lower())
            elif self.simple(chunk) and "<|" not in chunk:
                ids = b"".join(map(self.word, self.split(chunk.lower())))
            else:
                ids = np.asarray(self.full.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if ids is None:
                spelled = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
                found = [t.id for t in self.model.tokenize(spelled)]
                ids = struct.pack(f"<{len(found)}I", *found)
            if len(self.words) >= CACHE:
                self.older_words, self.words = self.words, {}
            self.words[word] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.older, self.words, self.older_words = {}, {}, {}

    def text(self, text: str) -> bytes:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def _chunks(path: str) -> Chunks:
    return Chunks(path)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and END_ID, cut at multiples of the capacity."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches):
        chunks = _chunks(vocabulary or default_vocabulary())
        for batch in (part for whole in batches for part in slices(whole, 1000)):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = chunks.text(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        chunks.forget()  # the worker serves other operators next

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: Ranges of sizes that are swept apart.
ZONES = 2
#: kind d: documents `first` .. `first + n - 1` of length `size`; g: sequences `first` .. of gap `size`; p: documents placed, `per`
#: to a sequence from `seq` on, at offsets `off`, `off + size`, ...
RUN = "kind string, size int, first long, n long, seq long, off int, per int"


def zone_of(size, capacity: int, zones: int = ZONES):
    return (size - 1) * zones // capacity


def sweep(runs: list[tuple], capacity: int) -> list[tuple]:
    """One range's round: runs (kind, size, first, n) to placed, waiting and free runs. Gaps that are passed go on a stack, so
    the smallest one that holds a document is on top."""
    out, free = [], []
    for kind, size, first, n in sorted(runs, key=lambda r: (-r[1], r[0] == "d", r[2])):
        if kind == "g":
            free.append([size, first, n])
            continue
        while n and free:
            gap, seq, there = free[-1]
            per = gap // size
            whole = min(there, n // per)
            for seats, docs in ((whole, whole * per), (1, n - whole * per) if whole < there and n < (whole + 1) * per else (0, 0)):
                if docs:
                    out.append(("p", size, first, docs, seq, capacity - gap, docs // seats))
                    if gap > docs // seats * size:
                        out.append(("g", gap - docs // seats * size, seq, seats, None, None, None))
                    first, n, seq, there = first + docs, n - docs, seq + seats, there - seats
            free[-1][1:] = seq, there
            if not there:
                free.pop()
        if n:
            out.append(("d", size, first, n, None, None, None))
    return out + [("g", gap, seq, n, None, None, None) for gap, seq, n in free]


def aims(waiting: dict[int, int], gaps: set[int], capacity: int, zones: int = ZONES) -> tuple[list[int], int]:
    """The largest gap of each range (0: none), and how many sequences the documents need that no gap can hold."""
    tops = [max((g for g in gaps if zone_of(g, capacity, zones) == z), default=0) for z in range(zones)]
    volume = sum(size * n for size, n in waiting.items() if size > max(tops))
    if volume:
        tops[-1] = capacity
    return tops, -(-volume // capacity)


def match(counts: dict[int, int], capacity: int, docs: DataFrame, zones: int = ZONES) -> DataFrame:
    """Runs of placed documents (l, low, high, first, off, per) for a number of documents of each length."""
    spark = docs.sparkSession
    own = F.floor((F.col("size") - 1) * zones / capacity).cast("int")

    def round_(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sweep(list(pdf[["kind", "size", "first", "n"]].itertuples(index=False, name=None)), capacity)
        return pd.DataFrame(rows, columns=["kind", "size", "first", "n", "seq", "off", "per"], dtype="object")

    rows = [("d", size, 0, n, None, None, None) for size, n in sorted(counts.items())]
    state, placed, opened, waiting, gaps = spark.createDataFrame(rows, RUN), [], 0, counts, set()
    while waiting:
        tops, more = aims(waiting, gaps, capacity, zones)
        fresh = spark.createDataFrame([("g", capacity, opened, more, None, None, None)] if more else [], RUN)
        opened += more
        aim = F.coalesce(*(F.when((own <= z) & (F.col("size") <= top), z) for z, top in enumerate(tops)), F.lit(zones - 1))
        zoned = state.unionByName(fresh).withColumn("zone", F.when(F.col("kind") == "d", aim).otherwise(own))
        done = materialize(zoned.repartition(zones, "zone").groupBy("zone").applyInPandas(round_, RUN), "pack_round")
        placed.append(done)
        state = done.filter("kind != 'p'")
        left = state.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect()  # two rows a size at most
        waiting, gaps = {r["size"]: r.n for r in left if r.kind == "d"}, {r["size"] for r in left if r.kind == "g"}
    if not placed:
        return spark.createDataFrame([], "l int, low long, high long, first long, off int, per int")
    runs = placed[0]
    for more in placed[1:]:
        runs = runs.unionByName(more)
    runs = runs.filter("kind = 'p'").select(F.col("size").alias("l"), F.col("first").alias("low"), (F.col("first") + F.col("n")).alias("high"), F.col("seq").alias("first"), "off", "per")
    kept = materialize(runs.coalesce(1), "pack_runs")
    remove(*placed)
    return kept


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: a piece of the end id alone. Whole texts are coded, however long. Null ids are kept as they are;
    repeated rows are packed each by itself, and where equal in id and text may swap places. Other columns are left out; an
    empty table gives no row.
    """
    pieces = materialize(token_pieces(docs, id_col, text_col, capacity, vocabulary), "pack_pieces")
    counts = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = match(counts, capacity, docs)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts_for(max(counts.values(), default=0)))))
    ranked = gapless(pieces, ["length"], "salt", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank")
    place = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    nth = F.col("rank") - F.col("low")
    found = ranked.join(F.broadcast(runs), place)  # runs follow the capacity, not the documents
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("off") + nth % F.col("per") * F.col("length")).alias("offset"))


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
