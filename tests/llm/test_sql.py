"""The queries that SQL can express against that SQL, on the smallest tables."""

import duckdb
import pytest

from quern.llm.oracle import ORACLE
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(ORACLE[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(str(tuple(r[cols.index(c)] for c in df.columns)) for r in got.fetchall())
    assert sorted(str(tuple(r)) for r in df.collect()) == want and want
