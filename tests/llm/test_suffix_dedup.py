import hashlib
import random

import numpy as np
import pytest

from quern.llm import suffix_dedup
from quern.llm.suffix_dedup import anchors, cut_repeats, repeated_windows, suffix_report, suffix_sort


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30), prose(60), prose(12)]
    out = []
    for _ in range(60):
        parts = [prose(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) // 2)
            parts += [s[cut:] if rng.random() < 0.5 else s[: len(s) - cut], prose(rng.randrange(1, 20))]
        out.append(" ".join(parts))
    near = prose(150)
    for _ in range(12):
        x = list(near)
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = "#"
        out.append("".join(x))
    return out + [out[0], out[0], None, "", "ab", "a" * 900, "ab" * 300, ("line of text, " * 9 + "\n") * 12, prose(20_000), "x" * 59, "x" * 60, "x" * 60]


@pytest.mark.parametrize("options", [{}, {"group_contexts": 3, "batch": 20}, {"group_contexts": 1, "batch": 1}])
def test_against_brute_force(spark, options):
    ts = texts()
    df = spark.createDataFrame([(i % 40 if i % 9 else None, t, 1, b"") for i, t in enumerate(ts)], "doc_id long, text string, gram int, kept binary")
    got = cut_repeats(df, length=60, gram=16, **options).collect()
    want = [(i % 40 if i % 9 else None, *b) for i, b in enumerate(brute(ts, 60))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(want, key=str)


def test_contract_length(spark):
    ts = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string")
    got = sorted(map(tuple, suffix_report(df).collect()))
    assert got == [(i, *b) for i, b in enumerate(brute(ts, 400))]
    assert suffix_report(df.limit(0)).count() == 0


def test_anchors_agree_in_equal_windows():
    rng = random.Random(1)
    a = bytes(rng.choices(b"ab", k=300))
    x = np.frombuffer(b"zzz" + a + b"q" * 40, dtype=np.uint8)
    y = np.frombuffer(a + b"w" * 90, dtype=np.uint8)
    own = []
    for raw in (x, y):
        g, p, f, t = anchors(raw, 60, 10)
        assert f[0] == 0 and t[-1] == len(raw) - 60 and (f[1:] == t[:-1] + 1).all()
        own.append({w: (int(gg), int(pp) - w) for gg, pp, ff, tt in zip(g, p, f, t, strict=True) for w in range(ff, tt + 1)})
    assert all(own[0][w + 3] == own[1][w] for w in range(241))


def test_suffix_sort_and_collisions(monkeypatch):
    rng = random.Random(2)
    rows = [bytes(rng.choices(b"ab", k=rng.randrange(0, 30))) for _ in range(157)]
    size = np.array([len(r) for r in rows])
    text = np.zeros((len(rows), 30), dtype=np.uint8)
    for i, r in enumerate(rows):
        text[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    want = sorted(range(len(rows)), key=lambda i: (rows[i], i))
    for bad in (False, True):
        if bad:  # every hash collides: the bytes decide
            monkeypatch.setattr(suffix_dedup.H, "VALUE", np.zeros(256, dtype=np.uint64))
        order, lcp = suffix_sort(text, size)
        assert order.tolist() == want
        for k in range(1, len(rows)):
            a, b = rows[want[k - 1]], rows[want[k]]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == n
    assert repeated_windows([], np.zeros(0, dtype=int), np.zeros(0, dtype=int), 5) == []


def test_very_common_line_and_passages(spark):
    """Rows that share one line, a long passage and a passage under ``length``: groups are split by content."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, long_, short = prose(30)[:150], prose(110)[:520], prose(70)[:390]
    ts = [f"{prose(rng.randrange(8, 60))}\n{line}\n{prose(5)} {rng.choice([prose(40), long_, short])} {prose(rng.randrange(1, 60))}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    for bound in (8_000, 20):
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut_repeats(df, group_contexts=bound).collect())
        assert got == [(i, *b) for i, b in enumerate(brute(ts, 400))]
        assert all((r[2] > 0) == (long_ in ts[r[0]]) for r in got)


def test_window_minima_in_stretches():
    h = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    want = [int(np.argmin(h[k : k + 50] >> np.uint64(8))) + k for k in range(2951)]
    assert suffix_dedup.H.window_minima(h, 50, bits=8).tolist() == want == suffix_dedup.H.window_minima(h, 50).tolist()
