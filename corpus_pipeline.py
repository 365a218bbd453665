"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Columns
beyond those of documents, whatever their names, go along untouched. Null ids, rows repeated and empty tables are taken
everywhere; whole texts are read, however long. What null and empty texts and ties give is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm.best_fit_packing import pack
from lontar.llm.common import materialize, read, remove
from lontar.llm.line_dedup import line_dedup
from lontar.llm.quality_rules import quality_rules
from lontar.llm.simhash_dedup import representatives, simhash_dedup
from lontar.llm.source_mixing import mix_sources


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or cascade rules reject go; null and empty texts are among them."""
    return quality_rules(docs).filter("kept").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; documents stay, and n_chars follows. The occurrence with the
    smallest doc_id is the first one (null before all), of equal ids that with the smaller hash of its text; rows equal in
    both lose the same lines. A null text stays null, and a text may be left empty."""
    left = line_dedup(docs)
    return left.select(*(
        F.col("new_text").alias("text") if c == "text"
        else F.char_length("new_text").cast(t).alias("n_chars") if c == "n_chars" else F.col(f"_row.`{c}`").alias(c)
        for c, t in docs.dtypes
    ))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; rows equal in id and text stay once.

    Links are op10's (four-word SimHash, at most 4 bits) and pairs of five-word Jaccard similarity 0.8 or more. Texts without
    words, null ones too, are one component, of which one stays. Of texts that share the smallest id the one with the smallest
    hash stays; of a component without ids one of its rows."""
    kept = representatives(simhash_dedup(docs, similar=True)).select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"))
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    stays = named.join(kept, F.col("_doc").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left_semi")
    return stays.dropDuplicates(["_doc", "_hash"]).select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it: 0 to 3 times. Texts without words weigh nothing: in a source
    that holds no other text they go, else they are taken like the others. Null sources are one source."""
    taken = mix_sources(docs).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens; a null or empty text is a piece of one token."""
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mixing", mix), ("packing", packing)]

#: SQL can't express the SimHash stage; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        done = materialize(stage(spark, docs, sf_dir), f"pipeline_{name.replace(' ', '_')}")
        if k:
            remove(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
