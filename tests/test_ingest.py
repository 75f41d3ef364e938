import json

from pyspark.sql import functions as F

from quern.functions.replies import parse_reply
from quern.operators import ingest
from quern.plans import rebuild
from quern.sources import readers


def test_reply_forms():
    rows = [{"a": 1}, {"b": None}]
    body = json.dumps(rows)
    assert parse_reply(f"  {body} ") == (rows, "bare")
    assert parse_reply(f"Sure:\n```json\n{body}\n```\nbye") == (rows, "fenced")
    assert parse_reply('{"a": 1}\n{"b": null}') == (rows, "jsonl")
    assert parse_reply('{"note": "none"}\n\n[]') == ([], "extra")
    assert parse_reply(f"x {body} and [3]") == (rows, "extra")
    assert parse_reply(json.dumps({"n": 2, "experiments": rows})) == (rows, "bare")
    assert parse_reply('{"a": 1}') == ([{"a": 1}], "jsonl") and parse_reply("see {broken and [1, 2") is None
    assert parse_reply("") is None and parse_reply("nothing") is None and parse_reply('[1, "a", {"a": 1}]') == ([{"a": 1}], "bare")


def harmonised(spark, *objects):
    rows = [(i, [(k, None if v is None else json.dumps(v) if isinstance(v, (list, dict)) else str(v), isinstance(v, (list, dict))) for k, v in o.items()]) for i, o in enumerate(objects)]
    df = spark.createDataFrame(rows, "i int, entries array<struct<key:string,value:string,nested:boolean>>")
    return ingest.harmonise(df, "entries", F.lit("Paper")).orderBy("i").collect()


def test_harmonise(spark):
    a, b, c, d = harmonised(
        spark,
        {"Temp": "n/a", "temperature-K": "~ 623 ", "Temperature_K": "700", "catalyst": " Cu ", "junk": 1},
        {"space velocity": "LHSV of 2 h-1", "SV": "15", "gas  feed": ["N2", "H2"], "paper": "other"},
        {"mass": "Not Reported", "conversion_%": 0.5, "temperature (K)": "5"},
        {},
    )
    assert (a.temperature_K, a.catalyst, a.paper, a._uncertain, a._raw_values) == ("623", "Cu", "Paper", {"temperature_K": True}, {"temperature_K": "~ 623", "catalyst": "Cu"})
    assert (b.LHSV_h, b.GHSV_h, b.gas_mix, b._uncertain) == ("LHSV of 2 h-1", None, '["N2", "H2"]', None)
    assert (c.loading_g, c.conversion_pct, c.temperature_K) == (None, "0.5", None)
    assert d.paper == "Paper" and d.catalyst is None


def test_dedupe_is_on_the_full_schema(spark):
    rows = harmonised(spark, {"catalyst": "Cu", "temp": "1"}, {"catalyst": " cu ", "temp": "1"}, {"catalyst": "Cu", "temp": "2"})
    df = spark.createDataFrame([(r.i, r.catalyst, r.temperature_K) for r in rows], "i int, catalyst string, temperature_K string")
    assert sorted(r.i for r in ingest.dedupe_keep_first(df, [], ["i"], ("catalyst", "temperature_K")).collect()) == [0, 2]


def test_rebuild_from_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    files = {
        "p1_V4_r1_results[1].txt": '[{"catalyst": "Cu", "temp": 5}]', "p1_V4_r1_methods.txt": '[{"catalyst": "cu ", "temp": "5"}, {"catalyst": "Ni"}]',
        "p1_V4_r1_tables_a1.FAILED.txt": "junk", "p1_V4_r1_tables_a2.FAILED.txt": 'x [{"catalyst": "Zn"}]', "p1_V4_r1_methods_a1.FAILED.txt": '[{"catalyst": "no"}]',
        "p2_B0_r2_chars[1].txt": "nothing", "other.txt": "[]",
    }
    for n, t in files.items():
        (raw / n).write_text(t)
    replies = readers.read_replies(spark, str(raw))
    corpus = spark.createDataFrame([("p1", "Paper One")], "slug string, paper string")
    rows = rebuild.rebuild(replies, corpus)
    got = rows.orderBy("pred_ord").collect()
    assert [(r.paper, r.catalyst, r.temperature_K, r.pred_ord) for r in got] == [("Paper One", "cu", "5", 0), ("Paper One", "Ni", None, 1), ("Paper One", "Zn", None, 2)]
    assert {(r.slug, r.n_rows) for r in rebuild.cells_with_rows(replies, rows).collect()} == {("p1", 3), ("p2", 0)}
    s = rebuild.summary(replies).first()
    assert tuple(s) == (4, 2, 1, 1, 0.25)
    assert {r.form: r.n for r in rebuild.reply_forms(replies).collect()} == {"bare": 2, "extra": 1}


def test_retryable(spark):
    df = spark.createDataFrame([("exit 1: Usage limit reached",), ("timeout",), (None,)], "e string")
    assert [r.x for r in df.select(ingest.retryable(F.col("e")).alias("x")).collect()] == [False, True, True]
