"""Registered queries against their SQL, at the smallest size."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return con


def in_order(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_query_against_sql(spark, tables, name):
    got, want = entry.queries()[name](spark, SF_DIR).toPandas(), tables.sql(entry.oracle_sql()[name]).df()
    assert in_order(got) == in_order(want)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_footnote_refs_keeps_long_runs_as_they_stand(spark, tmp_path):
    texts = ["of x,", "of x, y, z,", "of x ,", "of x\t,\n", "of x\x0b,", "of\x0bx,", "of x,", "q,", "of X,", "aq,r,", "of p q,r,", "", None, "of " + "m, " * 20_000, "of " + "m, " * 20_000 + "ends"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = con.sql(entry.oracle_sql()["footnote_refs"]).fetchall()
    assert dict(map(tuple, entry.queries()["footnote_refs"](spark, str(tmp_path)).collect())) == dict(want)


@pytest.fixture
def crowded(spark, tmp_path):
    """A nation of many sections and tables on few pages."""
    spark.createDataFrame([(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(600).selectExpr("id c_custkey", "concat('C', id) c_name", "1 c_nationkey", "'SEG' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(600).selectExpr("id s_suppkey", "concat('S', id) s_name", "1 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("nation", "customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    return str(tmp_path), con


def test_section_texts_puts_pages_together_once(spark, crowded):
    found = entry.queries()["section_texts"](spark, crowded[0])
    assert in_order(found.toPandas()) == in_order(crowded[1].sql(entry.oracle_sql()["section_texts"]).df())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spread = re.findall(r"Generate posexplode\(pages#\d+\).*\[nth#.*\n[\s:+|-]*(\w+)", plan)
    assert spread and set(spread) == {"Aggregate"}  # different lists of pages, not the sections that have them


def test_index_nodes_writes_no_texts(spark, crowded):
    written = lambda: sum(p.stat().st_size for p in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if p.is_file())
    before = written()
    found = entry.queries()["index_nodes"](spark, crowded[0])
    grown = written() - before
    assert in_order(found.toPandas()) == in_order(crowded[1].sql(entry.oracle_sql()["index_nodes"]).df())
    texts = entry.queries()["section_texts"](spark, crowded[0]).selectExpr("sum(length(content))").first()[0]
    assert grown < texts / 2
