import hashlib
import os
import random
import tarfile
import zlib
from collections import Counter

import pytest

from quern.llm.media import decode_png, encode_png, feature, media_report, pad, read_media, write_media
from quern.llm.store import open_fs

SCHEMA = "doc_id long, text string, media int, payload string"


def rows():
    rng = random.Random(8)
    out = [(i, "".join(rng.choices("aé\n x", k=rng.randrange(2000))), 1, "p") for i in range(60)]
    return out + [(1, None, 1, "p"), (None, "", 1, None), (None, "x" * 576, 1, "p"), (3, "é" * 200_000, None, "p"), (3, "é" * 200_000, None, "p")]


def test_png_round_trip():
    for text in ("", "a", "é" * 288, "x" * 577):
        p = pad(text.encode())
        assert len(p) % 576 == 0 and len(p) > 0 and decode_png(encode_png(p)) == p
    with pytest.raises(ValueError):
        decode_png(encode_png(pad(b"a"))[:-20] + bytes(20))


def test_report(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = media_report(df).collect()
    want = []
    for d, t, *_ in data:
        raw = (t or "").encode()
        p = pad(raw)
        m = encode_png(p)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
    assert Counter(map(tuple, got)) == Counter(want)
    assert media_report(df.limit(0)).count() == 0


def test_ranges_and_retries(spark):
    data = rows()
    folder, archives = write_media(spark.createDataFrame(data, SCHEMA).repartition(3), archive_bytes=20_000)
    want = Counter(pad((t or "").encode()) for _, t, *_ in data)
    for options in ({"split_bytes": 700}, {"split_bytes": 5000, "batch_bytes": 1}):
        assert Counter(bytes(r.payload) for r in read_media(spark, folder, archives, **options).collect()) == want
        assert Counter(bytes(r.payload) for r in read_media(spark, folder, **options).collect()) == want  # by walking headers
    _, path = open_fs(folder)
    name = sorted(x for x in os.listdir(path) if x.endswith(".tar"))[0]
    with tarfile.open(f"{path}/{name}") as t:  # any reader can read the archives
        first = t.getmembers()[0]
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(first.offset_data + 30)
        f.write(b"\0\1\2\3\4\5\6\7")
    kept = read_media(spark, folder, errors="keep", retries=1).collect()
    assert sum(r.error is not None for r in kept) == 1 and len(kept) == len(data)
    with pytest.raises(Exception, match="damaged|incorrect|invalid|decompress"):
        read_media(spark, folder, retries=0).collect()
