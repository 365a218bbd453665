import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lontar.plans import registry
from tests.conftest import ROOT


def test_queries_load_without_a_session():
    """The register is read before there is a session."""
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT}).returncode == 0


def test_names_agree():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(sql.strip().upper().startswith(("SELECT", "WITH")) for sql in entry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "labels", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got, want = registry.queries()[name](spark, tables).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_document_numbers_covers_whole_tables(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = registry.queries()["document_numbers"](spark, f"/root/testdata/{sf}").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["document_numbers"]).fetchall())
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchall()[0][0] and (sf == "sf0.001" or sum(r.problem == "too_long" for r in got) == 30)
