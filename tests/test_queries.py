"""Every query with an oracle against DuckDB on the smallest tables, and the entry point."""

import re
from pathlib import Path

import pytest

import __spark_entry__
from mailframe.plans import queries as Q

SMALL = Path(__spark_entry__.SMALL)
pytestmark = pytest.mark.skipif(not SMALL.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, duck, name):
    got, want = Q.QUERIES[name](spark, str(SMALL)).toPandas(), duck.execute(Q.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert {r.origin for r in rows} == {"documents", "pages"}
    assert set(Q.QUERIES) <= set(__spark_entry__.queries()) and set(Q.ORACLE) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", ["date_and_copy_headers", "header_repairs", "header_warnings", "quoted_latin1_bodies", "sender_hosts", "strip_parentheses", "unescape_entities"])
def test_short_rows_are_dealt_out(spark, name):
    """A table that is one split is no single task."""
    plan = Q.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().optimizedPlan().toString()
    dealt = re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan)
    assert dealt and min(map(int, dealt)) >= 24
