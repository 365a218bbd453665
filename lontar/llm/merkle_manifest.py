"""A Merkle manifest of a dataset: a leaf a row, a 16-ary tree a source, and one over the sources' subroots.

Leaves are hashed where their rows are read, and ranked within their source. Aligned buckets of 4096 consecutive leaves are
whole subtrees, so a task can hash them alone: it hands its buckets to DuckDB as Arrow tables, whose ordered string_agg and
sha256 make a level a query. Spark combines the buckets' roots level by level, and gives each bucket the siblings on its way
to the root; a second pass over the buckets appends these to the proofs and folds every leaf up to the root.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.functions.ranks import rank_by_order
from lontar.llm.common import lower_ascii, materialize, read, remove, shuffle_partitions

FANOUT = 16
#: Levels of a bucket's subtree, and its leaves.
DEPTH = 3
BUCKET = FANOUT**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOTS = pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("h", pa.string())])
PROOFS = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
_CHAIN = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A field as it enters a leaf: `-` if null, else its number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields.values())), 256)


class Blocks:
    """Whole buckets of a task in DuckDB, at most about BUCKET leaves at a time. Nothing goes to a disk."""

    def __init__(self, leaves: pa.Table):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.db.register("given", leaves)
        self.db.execute(f"""
            CREATE TABLE buckets AS
            SELECT *, (sum(n) OVER (ORDER BY b) - n) // {BUCKET} AS block
            FROM (SELECT row_number() OVER (ORDER BY key, bucket) AS b, key, bucket, count(*) AS n, if(bucket > 0, {BUCKET}, count(*)) AS whole FROM given GROUP BY key, bucket)
        """)  # a bucket that isn't its source's first has all levels, whatever it holds; a first one that isn't full is its source's only one

    def __iter__(self):
        for (block,) in self.db.execute("SELECT DISTINCT block FROM buckets ORDER BY block").fetchall():
            self.db.execute(f"CREATE OR REPLACE TABLE leaves AS SELECT b, doc_id, pos % {BUCKET} AS pos, leaf, tampered FROM given JOIN buckets USING (key, bucket) WHERE block = {block}")
            self.db.execute("CREATE OR REPLACE TABLE nodes AS SELECT b, pos, leaf AS h FROM leaves")
            yield block

    def level(self, k: int) -> None:
        """Runs of 16 nodes of level k, and the nodes of level k + 1 that they become."""
        self.db.execute(f"CREATE OR REPLACE TABLE runs AS SELECT b, pos // {FANOUT} AS run, string_agg(h, '' ORDER BY pos) AS joined FROM nodes JOIN buckets USING (b) WHERE whole > {FANOUT**k} GROUP BY b, run")
        self.db.execute(f"CREATE OR REPLACE TABLE nodes AS SELECT b, run AS pos, sha256(joined) AS h FROM runs UNION ALL SELECT b, pos, h FROM nodes JOIN buckets USING (b) WHERE whole <= {FANOUT**k}")

    def table(self, sql: str, schema: pa.Schema) -> pa.Table:
        return self.db.sql(sql).to_arrow_table().select(schema.names).cast(schema)


def _roots(leaves: pa.Table) -> pa.Table:
    """Roots of whole buckets."""
    blocks, out = Blocks(leaves), []
    for _ in blocks:
        for k in range(DEPTH):
            blocks.level(k)
        out.append(blocks.table("SELECT key, bucket, h FROM nodes JOIN buckets USING (b)", ROOTS))
    return pa.concat_tables([ROOTS.empty_table(), *out])


def _prove(leaves: pa.Table, outer: pa.Table) -> pa.Table:
    """Proofs of the leaves of whole buckets, and their tampered leaves folded; outer: a bucket's siblings on the way up."""
    blocks, out = Blocks(leaves), []
    blocks.db.register("outer_given", outer)
    blocks.db.execute("CREATE TABLE above AS SELECT b, subroot, root, chain FROM outer_given JOIN buckets USING (key, bucket)")
    high = blocks.db.execute("SELECT coalesce(max(len(chain)), 0) FROM above").fetchone()[0]
    for _ in blocks:
        blocks.db.execute("CREATE OR REPLACE TABLE folded AS SELECT b, doc_id, pos, leaf, tampered AS fold, '' AS proof FROM leaves")
        for k in range(DEPTH):
            blocks.level(k)
            place = f"64 * (pos // {FANOUT**k} % {FANOUT})"
            blocks.db.execute(f"""
                CREATE OR REPLACE TABLE folded AS
                SELECT b, doc_id, pos, leaf, if(after IS NULL, fold, sha256(before || fold || after)) AS fold, if(after IS NULL, proof, proof || before || after) AS proof
                FROM (SELECT f.*, substr(joined, 1, {place}) AS before, substr(joined, {place} + 65) AS after
                      FROM folded f LEFT JOIN runs r ON r.b = f.b AND r.run = f.pos // {FANOUT ** (k + 1)})
            """)
        for k in range(1, high + 1):
            blocks.db.execute(f"""
                CREATE OR REPLACE TABLE folded AS
                SELECT b, doc_id, pos, leaf, if(step IS NULL, fold, sha256(step.before || fold || step.after)) AS fold, if(step IS NULL, proof, proof || step.before || step.after) AS proof
                FROM (SELECT f.*, chain[{k}] AS step FROM folded f JOIN above USING (b))
            """)
        out.append(blocks.table("SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM folded JOIN above USING (b)", PROOFS))
    return pa.concat_tables([PROOFS.empty_table(), *out])


def combine(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (key, pos, h), a tree a key: (key, pos, chain) with each node's siblings from below upwards, and
    (key, h), the roots. A level is a job over a sixteenth of the nodes of the one below; no task holds a tree."""
    levels, here, roots = [], nodes, None
    while True:
        many = here.filter("pos > 0").select("key").distinct()  # of these more than one node remains
        done = here.join(many, "key", "left_anti").select("key", "h")
        roots = done if roots is None else roots.unionByName(done)
        run = F.expr(f"pos div {FANOUT}").alias("run")
        held = here.join(many, "key", "left_semi").groupBy("key", run).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("parts"))  # 16 at most
        level = materialize(held.select("key", "run", F.col("parts.h").alias("hs")), "manifest_level")
        if level.isEmpty():
            remove(level)
            break
        levels.append(level)
        here = level.select("key", F.col("run").alias("pos"), F.sha2(F.array_join("hs", ""), 256).alias("h"))
    chains = None
    for level in reversed(levels):
        at = F.posexplode("hs").alias("i", "h")
        step = F.struct(F.array_join(F.slice("hs", F.lit(1), F.col("i")), "").alias("before"), F.array_join(F.slice("hs", F.col("i") + 2, F.lit(FANOUT)), "").alias("after"))
        below = level.select("key", "run", "hs", at).select("key", "run", (F.col("run") * FANOUT + F.col("i")).alias("pos"), F.array(step).alias("chain"))
        if chains is None:
            chains = below.select("key", "pos", "chain")
        else:
            up = chains.select("key", F.col("pos").alias("run"), F.col("chain").alias("further"))
            chains = below.join(up, ["key", "run"], "left").select("key", "pos", F.concat("chain", F.coalesce("further", F.array().cast(_CHAIN))).alias("chain"))
    none = F.array().cast(_CHAIN)
    found = nodes.select("key", "pos", none.alias("chain")) if chains is None else nodes.join(chains, ["key", "pos"], "left").select("key", "pos", F.coalesce("chain", none).alias("chain"))
    return found, roots


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: what some of the fields hold when the proof is checked (default: what they held). Leaves of a source are
    ordered by doc_id, null first, of equal ids by leaf; rows repeated are equal leaves side by side. A null source is a
    source, before all others; a null field is `-`, an empty one `0:`. Whole texts are hashed, however long. Other columns,
    whatever their names, are left out. An empty table gives no row.
    """
    spark = docs.sparkSession
    given = {c: docs[c] for c in fields}
    leaf = leaf_of(given)
    later = leaf_of(given | tampered) if tampered else leaf
    same = [given[c].eqNullSafe(v) for c, v in (tampered or {}).items()]
    held = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("")).alias("key"),
        leaf.alias("leaf"), F.when(F.forall(F.array(*same), lambda x: x), leaf).otherwise(later).alias("tampered") if same else leaf.alias("tampered"),
    )
    leaves = materialize(held, "manifest_leaves")
    ranked = rank_by_order(leaves, ["key"], ["doc_id", "leaf"], "pos").select("key", "doc_id", "leaf", "tampered", "pos")
    packs = max(shuffle_partitions(spark), -(-leaves.count() // BUCKET))
    bucket = F.expr(f"pos div {BUCKET}").alias("bucket")
    dealt = materialize(ranked.select("*", bucket).withColumn("pack", F.pmod(F.xxhash64("key", "bucket"), F.lit(packs))), "manifest_ranked")
    remove(leaves)
    tops = materialize(dealt.groupBy("pack").applyInArrow(_roots, "key string, bucket long, h string"), "manifest_buckets")

    chains, subroots = combine(tops.select("key", F.col("bucket").alias("pos"), "h"))
    subroots = materialize(subroots, "manifest_subroots")
    numbered = materialize(rank_by_order(subroots, [], ["key"], "pos").select("key", "h", "pos", F.lit("").alias("all")), "manifest_numbered")
    further, root = combine(numbered.select(F.col("all").alias("key"), "pos", "h"))
    top = root.first()  # one row: the root
    above = numbered.join(further.select("pos", F.col("chain").alias("further")), "pos").select("key", F.col("h").alias("subroot"), "further")
    outer = chains.join(above, "key").select(
        "key", F.col("pos").alias("bucket"), F.concat("chain", "further").alias("chain"), "subroot", F.lit(top.h if top else None).cast("string").alias("root"),
        F.pmod(F.xxhash64("key", F.col("pos")), F.lit(packs)).alias("pack"),
    )
    outer = materialize(outer, "manifest_outer")
    proofs = dealt.groupBy("pack").cogroup(outer.groupBy("pack")).applyInArrow(_prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    remove(tops, subroots)
    return proofs


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return manifest(docs, {"text": F.when(hit, lower_ascii(docs["text"])).otherwise(docs["text"])})


_CRC_STEPS = "list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)"
#: crc.t: the 256 remainders of CRC-32.
CRC_TABLE = f"crc AS (SELECT list({_CRC_STEPS} ORDER BY i) AS t FROM range(256) r(i))"


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; the query has CRC_TABLE among its tables."""
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


_BEFORE_TEXT = " || ".join(map(_field_sql, FIELDS[:-1]))
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT *, coalesce('s' || source, '') AS key, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later FROM documents, crc),
hashed AS (SELECT doc_id, key, sha256({_BEFORE_TEXT} || {_field_sql("text")}) AS leaf, sha256({_BEFORE_TEXT} || {_field_sql("later")}) AS tampered FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
nodes(lvl, key, pos, h, n) AS (
  SELECT 0, key, pos, leaf, count(*) OVER (PARTITION BY key) FROM leaves
  UNION ALL SELECT lvl + 1, key, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY lvl, key, pos // 16, n),
subroots AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS place FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (
  SELECT 0, place, h, count(*) OVER () FROM subroots
  UNION ALL SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY lvl, pos // 16, n),
runs AS (SELECT lvl, key, pos // 16 AS run, string_agg(h, '' ORDER BY pos) AS joined FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT lvl + 100, NULL, pos // 16, string_agg(h, '' ORDER BY pos) FROM tops WHERE n > 1 GROUP BY ALL),
ways AS (
  SELECT l.key, l.pos, lvl, joined, pos // (16 ** lvl)::BIGINT % 16 AS i FROM leaves l JOIN runs r ON r.key = l.key AND r.run = l.pos // (16 ** (lvl + 1))::BIGINT
  UNION ALL SELECT l.key, l.pos, lvl, joined, place // (16 ** (lvl - 100))::BIGINT % 16 FROM leaves l JOIN subroots USING (key) JOIN runs r ON r.key IS NULL AND r.run = place // (16 ** (lvl - 99))::BIGINT),
steps AS (SELECT key, pos, list(substr(joined, 1, (64 * i)::BIGINT) || '|' || substr(joined, (64 * i + 65)::BIGINT) ORDER BY lvl) AS s FROM ways GROUP BY key, pos)
SELECT doc_id, leaf, b.h AS subroot, r.h AS root, sha256(array_to_string(list_transform(coalesce(s, []), lambda x: replace(x, '|', '')), '')) AS proof_sha256,
  list_reduce(coalesce(s, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), tampered) AS folded_root,
  list_reduce(coalesce(s, []), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), tampered) = r.h AS verified
FROM leaves l JOIN subroots b USING (key) CROSS JOIN (SELECT h FROM tops WHERE n = 1) r LEFT JOIN steps USING (key, pos)
"""
