import base64
import hashlib
import random

from quern.llm.warc import LoserTree, merge_index, read_archives, record, parse_record, url_key, warc_report, write_archives

SCHEMA = "page_id long, url string, html string, first long, w_key int"


def rows():
    rng = random.Random(2)
    out = []
    for i in range(300):
        out.append((i, f"http://h{rng.randrange(9)}.example.org/p{rng.randrange(40)}?q=é {i}", rng.choice(["a", "bb", "é" * 3, f"<p>{i}</p>" * 50]), 1, 1))
    return out + [(0, None, None, 1, 1), (500, "no scheme\r\nX: y", "", 1, 1), (None, "http://x/", "a", 1, 1), (None, "http://x/", "only", 1, 1), (7, "http://x/", "z" * 300_000, 1, 1), (7, "http://x/", "z" * 300_000, 1, 1), (499, "http://x/", None, 1, 1)]


def brute(data):
    out = []
    for p, _, h, *_ in data:
        raw = (h or "").encode()
        ids = [q for q, _, g, *_ in data if (g or "").encode() == raw and q is not None]
        first = min(ids, default=None)
        revisit = first is not None and p != first
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_loser_tree():
    rng = random.Random(1)
    for n in range(0, 12):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(9))) for _ in range(n)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_record_round_trip():
    from quern.llm.warc import EPOCH

    r = parse_record(record(4, "http://é/\n", b"\r\n\r\nx\r\n", EPOCH, None))
    assert r["payload"] == b"\r\n\r\nx\r\n" and r["full"] == 7 and r["headers"]["WARC-Record-ID"] == "<urn:page:4>"
    r = parse_record(record(4, None, b"abc", EPOCH, 2))
    assert r["payload"] is None and r["full"] == 3 and r["headers"]["WARC-Refers-To"] == "<urn:page:2>"


def test_report_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = warc_report(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(data)
    assert warc_report(df.limit(0)).count() == 0


def test_merged_index_is_ordered_in_rounds_and_ranges(spark):
    data = rows()
    folder, runs = write_archives(spark.createDataFrame(data, SCHEMA).repartition(9), archive_bytes=3000)
    assert runs.count() > 8
    got = merge_index(folder, runs, fan_in=3, range_rows=40).collect()
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == len(data)
    assert sorted(k[0] for k in keys) == sorted(url_key(d[1]) for d in data)
    records = read_archives(folder, runs)
    assert records.rdd.getNumPartitions() == runs.count()  # archives are read back side by side
    urls = sorted(str(r.url) for r in records.collect())
    assert urls == sorted(str(d[1] and d[1].replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A")) for d in data)


def test_min_payload(spark):
    folder, runs = write_archives(spark.createDataFrame(rows(), SCHEMA), min_payload=3)
    assert {r.record_type for r in read_archives(folder, runs).where("payload_bytes < 3").collect()} == {"response"}
