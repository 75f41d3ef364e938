"""Queries against their SQL on the smallest tables; the driver does the same on larger ones."""

import duckdb
import pytest

import __spark_entry__
from quern import queries, run_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# The scoring queries share their plan; these few cover it here.
SKIP = {"score_runs", "score_summary", "score_grouping_sets", "protocol_audit", "side_by_side", "row_counts", "pair_scores", "greedy_alignment", "per_paper_pivot"}


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - SKIP))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLE:
        got = duck.execute(queries.ORACLE[name])
        cols = [c[0] for c in got.description]
        assert sorted(cols) == sorted(df.columns)
        want = sorted(tuple(shown(r[cols.index(c)]) for c in df.columns) for r in got.fetchall())
        assert sorted(tuple(shown(r[c]) for c in df.columns) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["column", "version", "tp", "tp_rng", "fp", "fp_un", "fn", "p", "r", "f1"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
