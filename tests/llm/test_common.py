import pytest

from quern.llm import common


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_skew_join(spark, how):
    x = [("hot", i) for i in range(400)] + [("hot", 1)] + [(f"k{i % 7}", i) for i in range(60)] + [(None, 1)]
    x = spark.createDataFrame(x, "k string, v int")
    y = spark.createDataFrame([("hot", 401, "a"), ("k1", 9, "b"), ("k2", 9, "c"), ("none", 0, "d"), (None, 1, "e")], "k string, n long, w string")
    want = rows(x.join(y.drop("n"), "k", how))
    for options in ({}, {"least": 100, "shares": 10}, {"least": 100, "counted": "n"}):
        right = y if "counted" in options else y.drop("n")
        assert rows(common.skew_join(x, right, ["k"], how, **options)) == want
    two = common.skew_join(x.selectExpr("k", "v % 2 as p", "v"), y.selectExpr("k", "1 as p", "w"), ["k", "p"], least=50, shares=10)
    assert two.count() == 201 + sum(1 for i in range(60) if i % 7 in (1, 2) and i % 2)


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.work_dir(Session)


def test_staged_tables_are_dropped(spark):
    t = common.staged(spark.range(5), "t")
    assert t.count() == 5
    common.drop(t)
    with pytest.raises(Exception):  # noqa: B017  any reader's error
        spark.read.parquet(t.staged_at).count()
