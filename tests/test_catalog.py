"""Every query of the engine with a DuckDB form gives its rows."""

import glob
import os

import duckdb
import pytest

from trendweave.plans import catalog


def _rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(v) for v in r]) for r in frame[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert _rows(catalog.QUERIES[name](spark, small).toPandas()) == _rows(con.sql(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "topic"
