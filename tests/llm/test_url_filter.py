import pytest

from quern.llm.url_filter import filter_urls, judge_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("Bad.com", "", "block"), (None, "/", "block")]
SCHEMA = "page_id long, url string, html string, rule string, q_row int"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def test_rules_and_defined_cases(spark, rules):
    rows = [
        (1, "http://Example.ORG/es/a?x", "", "x", 1), (1, "http://Example.ORG/es/a?x", "", "x", 1), (2, "https://a.example.org/en", None, None, None),
        (3, "no scheme", "", "x", 1), (4, None, "", "x", 1), (None, "http://notexample.org", "", "x", 1), (6, "ftp://x.com/de/", "", "x", 1),
        (7, "http://a.bad.com#f", "", "x", 1), (8, "http://" + "a." * 5000 + "com/de/" + "y" * 9000, "", "x", 1), (9, "http://notbad.com/de", "", "x", 1),
    ]
    got = judge_urls(spark.createDataFrame(rows, SCHEMA), rules)
    assert "q_row" in got.columns
    found = sorted(((r.page_id, r.rule, r.verdict) for r in got.collect()), key=str)
    want = [
        (1, "example.org/es/", "block"), (1, "example.org/es/", "block"), (2, "org/", "allow"), (3, None, "allow"), (4, None, "allow"),
        (None, None, "allow"), (6, "com/de/", "block"), (7, "bad.com", "block"), (8, "com/de/", "block"), (9, None, "allow"),
    ]
    assert found == sorted(want, key=str)


def test_filter_keeps_columns(spark, rules):
    pages = spark.createDataFrame([(1, "http://x.com/de/1", "h", "r", 1), (2, "http://x.com/", None, "r", None)], SCHEMA)
    got = filter_urls(pages, rules)
    assert got.columns == pages.columns and [r.page_id for r in got.collect()] == [2]


def test_empty(spark, rules):
    pages = spark.createDataFrame([(1, "http://x.com/de/1", "h", "r", 1)], SCHEMA)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in judge_urls(pages, rules.limit(0)).collect()] == ["allow"]


def test_shuffled_rules_agree(spark, rules):
    pages = spark.createDataFrame([(1, "http://x.com/de/1", "h", "r", 1), (2, "http://a.b.org/", None, "r", None)], SCHEMA)
    a = judge_urls(pages, rules).select("page_id", "rule", "verdict")
    b = judge_urls(pages, rules, broadcast_rows=0).select("page_id", "rule", "verdict")
    assert sorted(a.collect()) == sorted(b.collect())
