"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local master, as in tests, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = chosen.get() if chosen.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lontar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again; with `by`, its last column, in a folder for each value
    and in Zstandard, which halves repeated numbers.

    This cuts the lineage, survives lost executors, fixes what depended on the physical partition, and lets later steps
    read single columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by).option("compression", "zstd") if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(*calls) -> list:
    """Results of calls that do not need one another; their jobs run at the same time, as none of them keeps all cores busy."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


#: Bytes of a table of words up to which it goes to every task whole.
WHOLE_BYTES = 1 << 26


def to_tasks(table: DataFrame, word: str, most: int = WHOLE_BYTES) -> DataFrame:
    """A materialised table of words, marked for broadcast if its rows are small enough together; else it joins by a shuffle."""
    size = table.agg(F.sum(F.octet_length(word) + 64)).first()[0] or 0
    return F.broadcast(table) if size <= most else table


def remove(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once nothing that is still to run reads them. Others are left alone."""
    for df in tables:
        spark = df.sparkSession
        folder = shared_folder(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"{folder.split(':', 1)[-1].lstrip('/')}/" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
