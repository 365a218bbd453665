import random

import pytest
from pyspark.sql import functions as F

from lontar.operators.limiter import rate_limit
from lontar.streaming.limiter import ordered_rate_limit

BASE = 1_000_000.0


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_late_events_over_triggers_give_the_batch_decisions(spark, tmp_path, rocks):
    """Events shuffled within 40 seconds over five triggers; one far ahead at the end lets the watermark pass the rest."""
    rng = random.Random(1)
    events = [(rng.choice("aab"), BASE + rng.randrange(3000) / 10) for _ in range(300)] + [("idle", BASE + 5)]
    came = sorted(events, key=lambda e: e[1] + rng.random() * 40)
    source = tmp_path / "in"
    ahead = [("end", BASE + 5000.0)], [("end", BASE + 6000.0), ("a", BASE + 1.55)]  # the last one is too late
    parts = [came[k : k + 62] for k in range(0, len(came), 62)]
    schema = "who string, t double"
    for part in (*parts, *ahead):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source)).withColumn("ts", F.col("t").cast("timestamp"))
        limited = ordered_rate_limit(stream, "who", "ts", "60 seconds", most=5, window=30.0)
        query = limited.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r.who, round(r["at"], 3), r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).filter("who <> 'end'").collect())
    want = rate_limit(spark.createDataFrame(events, schema), "who", F.col("t"), 5, 30.0).collect()
    assert got == sorted((r.who, round(r["at"], 3), r.allowed) for r in want)
    assert {a for _, _, a in got} == {True, False}
