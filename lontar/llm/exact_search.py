"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights. Queries and candidates are cut into blocks, and every pair of blocks meets in one
task: there each dimension of the candidates is a posting list (places and weights), a query scatters its weights over the
lists of its own dimensions into a dense array of scores, and a partition at the k-th score selects. What the blocks select
is merged by rank. No score is left out and none is estimated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.llm.common import materialize, read, shuffle_partitions

#: Components of a block of candidates, and of one of queries.
BLOCK, QUERY_BLOCK = 4_000_000, 500_000
#: Weights are held to this on either side; at 128 dimensions no score leaves 64 bits.
MOST = 1 << 28
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of an array of lists."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class Postings:
    """Candidates by dimension, at places in the order of (id, row), null ids last: ties go to the smaller place."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, values: np.ndarray):
        order = np.lexsort((rows, ids, no_id))
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.rows, self.ids, self.no_id, self.size = rows[order], ids[order], no_id[order], len(rows)
        terms = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        places, kept = np.repeat(place, lengths), values != 0
        terms, places, weights = terms[kept], places[kept], values[kept]
        by = np.lexsort((places, terms))
        terms, places, weights = terms[by], places[by], weights[by]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        self.largest = np.zeros(int(terms[-1]) + 1 if len(terms) else 0, np.int64)
        self.lists = {}
        for a, b in zip(starts, [*starts[1:], len(terms)], strict=True):
            full = b - a == self.size  # such a list's places are all places
            self.lists[int(terms[a])] = (None if full else places[a:b], weights[a:b])
            self.largest[terms[a]] = np.abs(weights[a:b]).max()
        self.narrow = {t: (p, w.astype(np.int32)) for t, (p, w) in self.lists.items()}

    def scores(self, query: np.ndarray) -> np.ndarray:
        terms = np.flatnonzero(query[: len(self.largest)])
        bound = sum(int(abs(query[t])) * int(self.largest[t]) for t in terms)  # 32 bits hold any partial sum below this
        kind, lists = (np.int32, self.narrow) if bound < 1 << 31 else (np.int64, self.lists)
        out, part = np.zeros(self.size, kind), np.empty(self.size, kind)
        for t in terms:
            if (found := lists.get(int(t))) is None:
                continue
            places, weights = found
            if places is None:
                np.multiply(weights, kind(query[t]), out=part)
                out += part
            else:
                out[places] += weights * kind(query[t])
        return out

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best candidates but the row `own`."""
        scores = self.scores(query)
        at = np.flatnonzero(self.rows == own)
        least = np.iinfo(scores.dtype).min
        scores[at] = least  # below every real score
        n = min(k, self.size - len(at))
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        kth = np.partition(scores, self.size - n)[self.size - n]
        above = np.flatnonzero(scores > kth)
        chosen = np.concatenate([above, np.flatnonzero(scores == kth)[: n - len(above)]])
        return chosen, scores[chosen].astype(np.int64)


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return FOUND.empty_table()
        ids = candidates.column("vec_id")
        postings = Postings(candidates.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), *_flat(candidates.column("weights")))
        lengths, values = _flat(queries.column("weights"))
        ends = np.cumsum(lengths)
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for row, vec, a, b in zip(queries.column("row").to_numpy(), queries.column("vec_id").to_numpy(), ends - lengths, ends, strict=True):
            at, scores = postings.best(values[a:b], row, k)
            for held, x in zip(out, (np.full(len(at), row), np.full(len(at), vec), postings.rows[at], at, scores), strict=True):
                held.append(x)
        query_row, query_id, row, at, score = map(np.concatenate, out)
        return pa.table([pa.array(query_row), pa.array(query_id), pa.array(row), pa.array(postings.ids[at], mask=postings.no_id[at]), pa.array(score)], schema=FOUND)

    return run


def exact_search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of highest integer inner product, all if there are fewer.

    Weights are floor(scale * x), held to 2**28 either way. Queries are the rows whose id `every` divides, candidates all rows
    but the query's own. Ties go to the smaller id, null last; rows repeated are rows, and each query row has its own list.
    Vectors that are null or hold a null or non-finite component take no part; an empty one does, with score 0. Of vectors of
    different lengths the shorter counts as if zeros followed. Other columns, whatever their names, are left out; an empty
    table gives no row.
    """
    spark = vectors.sparkSession
    finite = F.coalesce(F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))  # NaN is above infinity
    weight = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(scale) * x.cast("double")))).cast("int")
    taken = vectors.filter(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, weight).alias("weights"))
    rows = materialize(taken.select(F.monotonically_increasing_id().alias("row"), "*"), "search_rows")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n = rows.agg(F.coalesce(F.sum(F.size("weights") + 1), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(asks, F.size("weights") + 1)), F.lit(0)).alias("asked"), F.count("*").alias("rows"), F.count_if(asks).alias("queries")).first()
    blocks, query_blocks = max(1, -(-n["all"] // BLOCK)), max(1, -(-n["asked"] // QUERY_BLOCK))
    while blocks * query_blocks < 2 * shuffle_partitions(spark) and (n["queries"] > 32 * query_blocks or n["rows"] > 8192 * blocks):  # else tasks lie idle
        if n["queries"] > 32 * query_blocks and n["asked"] / query_blocks > n["all"] / blocks / 64 or n["rows"] <= 8192 * blocks:
            query_blocks *= 2
        else:
            blocks *= 2
    deal = lambda count: F.pmod(F.xxhash64("row"), F.lit(count))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    queries = rows.filter(asks).select("*", deal(query_blocks).alias("q")).select("*", each(blocks).alias("c"))
    candidates = rows.select("*", deal(blocks).alias("c")).select("*", each(query_blocks).alias("q"))
    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(_search(k), "query_row long, query_id long, row long, vec_id long, score long")
    merged = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.select("*", F.row_number().over(merged).alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_exact_search(spark, sf_dir: str) -> DataFrame:
    return exact_search(read(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, list_inner_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) QUALIFY row_number() OVER w <= 5
"""
