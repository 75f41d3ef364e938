import hashlib
import random

import numpy as np
import pytest
import xxhash

from quern.llm.graph import components
from quern.llm.simhash import block_links, keep_one, links, near_duplicates, shingle_hashes, simhash_report

M = (1 << 64) - 1


def brute_fp(text, k=4):
    ws = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    sh = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] if len(ws) > k else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, near):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(fps[i], fps[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def texts():
    rng = random.Random(3)
    v = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        base = rng.choices(v, k=rng.choice([3, 60, 300, 900]))
        for _ in range(rng.choice([1, 3, 8])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(v)
            out.append(" ".join(t))
    rng.shuffle(out)
    return out + ["", None, " \t\n", "One", "one", "A B c", "É x", "é x", "a b c d e f"]


def test_against_brute_force(spark):
    ts = texts()
    rows = [(3 * i % 211 if i % 13 else None, t, i) for i, t in enumerate(ts)] + [(5, ts[0], 0), (5, ts[0], 0), (900, "z " * 30000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    fps = [brute_fp(t) for _, t, _ in rows]
    want = brute_components([r[0] for r in rows], fps, lambda a, b: (a ^ b).bit_count() <= 4)
    got = sorted(map(tuple, simhash_report(df).collect()), key=str)
    assert got == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True)), key=str)
    assert simhash_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("count", [40, 700])
def test_block_links(count):
    rng = random.Random(count)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = []
    for _ in range(count):
        x = rng.choice(base)
        for _ in range(rng.randrange(9)):
            x ^= 1 << rng.randrange(16)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    if count > 512:
        fps += [f ^ (0x1F << 40) for f in fps[:200]]
    tally = {}
    root, _ = block_links(np.zeros(len(fps), dtype=np.int64), np.array(fps, dtype=np.uint64), 4, tally=tally)
    assert tally["formed"] >= tally["left"] >= tally["near"] > 0
    assert root.tolist() == brute_components(list(range(len(fps))), fps, lambda a, b: (a ^ b).bit_count() <= 4)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {(a, b) for a, b in edges if a is not None and a != b}
    ids = sorted({x for p in pairs for x in p})
    want = brute_components(ids, ids, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert got == dict(zip(ids, want, strict=True))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_at_0_8(spark):
    rng = random.Random(12)
    v = [f"w{i}" for i in range(3000)]
    rows, truth = [], []
    for g in range(60):
        base = rng.choices(v, k=200)
        for _ in range(rng.choice([1, 2, 4])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                t[rng.randrange(200)] = rng.choice(v)
            rows.append((len(rows), " ".join(t), g, 1))
            truth.append(g)
    df = spark.createDataFrame(rows, "doc_id long, text string, group int, key int")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.group for r in kept.collect()) == list(range(60))
    odd = spark.createDataFrame([(None, None, 1, 1), (None, None, 1, 1), (2, "", 1, 1), (2, "", 1, 2), (3, "one", 1, 1)], df.schema)
    assert sorted(r.doc_id for r in keep_one(odd).collect()) == [2, 3]
    assert keep_one(df.limit(0)).count() == 0 and near_duplicates(df.limit(0)).count() == 0


def test_near_copy_with_a_repeated_line(spark):
    rng = random.Random(13)
    v = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        base = rng.choices(v, k=200)
        rows.append((len(rows), " ".join(base)))
        rows.append((len(rows), " ".join(base[:110] + base[100:110] * 10 + base[110:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == list(range(0, 80, 2))


def test_similarity_is_exact_near_0_8(spark):
    rng = random.Random(14)
    v = [f"w{i}" for i in range(30_000)]
    rows, want = [], []
    for g in range(120):
        base = rng.sample(v, 300)
        t, edits = list(base), 6 + g % 2  # (296 - 30) / (296 + 30) = 0.816, (296 - 35) / (296 + 35) = 0.789
        for i in range(edits):
            t[20 + 40 * i] = f"x{g}-{i}"
        want += [len(rows)] + [len(rows) + 1] * (edits == 7)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(t))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == want


def test_split_blocks_lose_no_link(spark):
    rng = random.Random(15)
    fps = sorted({(rng.getrandbits(1) << 40) ^ sum(1 << b for b in rng.sample(range(24), rng.randrange(9))) for _ in range(900)})
    df = spark.createDataFrame([(1, f, f) for f in fps] + [(2, f, f) for f in fps[:20]], "key long, node long, fp long")
    want = brute_components(fps, fps, lambda a, b: (a ^ b).bit_count() <= 2)
    for rows in (100, 16_384):
        tied = {r.node: r.root for r in components(links(df, 2, block_rows=rows).select("a", "b")).collect()}
        assert [tied.get(f, f) for f in fps] == want


def test_near_duplicates_by_similarity(spark):
    """Groups are the components of all pairs at 0.8 or more, by brute force; small group bounds split."""
    rng = random.Random(16)
    v = [f"w{i}" for i in range(20_000)]
    texts = []
    for _ in range(60):
        base = rng.sample(v, rng.choice([20, 120, 400]))
        for _ in range(6):
            t = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                t[rng.randrange(len(t))] = rng.choice(v)
            texts.append(" ".join(t))
    base = rng.sample(v, 300)  # a family about the threshold
    for _ in range(150):
        t = list(base)
        for i in rng.sample(range(0, 300, 6), 3):
            t[i] = rng.choice(v)
        texts.append(" ".join(t))
    texts = list(dict.fromkeys(texts))
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = brute_components(list(range(len(texts))), sets, like)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {hashlib.sha256(t.encode()).hexdigest(): i for i, t in enumerate(texts)}
    for bound in (64 << 20, 100_000):
        groups = {}
        for r in near_duplicates(df, group_bytes=bound).collect():
            groups.setdefault(r.group, []).append(key[r.key])
        low = {i: min(g) for g in groups.values() for i in g}
        assert [low[i] for i in range(len(texts))] == want
