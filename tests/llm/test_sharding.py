import zlib
from collections import Counter
from fractions import Fraction
from math import comb, log, prod, sqrt

import numpy as np

from quern.llm.sharding import communication_matrix, exact_sizes, hypergeometric, log_factorial_step, shard_documents, shard_rows


def test_matrix_sums():
    m = communication_matrix([5, 0, 17, 30], [13, 13, 13, 13], 3)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 30] and m.sum(axis=0).tolist() == [13] * 4 and (m >= 0).all()


def test_matrix_follows_the_law():
    # Of 6 rows in partition 0 and 6 in partition 1, shard 0 (4 rows) gets h ~ Hypergeometric(6, 6, 4).
    got = Counter(int(communication_matrix([6, 6], [4, 8], s)[0, 0]) for s in range(4000))
    for k in range(5):
        assert abs(got[k] / 4000 - comb(6, k) * comb(6, 4 - k) / comb(12, 4)) < 0.03


def test_exact_shards(spark):
    rows = [(i % 7 if i % 5 else None, "x" * i if i % 3 else None, i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(5)
    got = shard_documents(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(t or "") + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))


def test_blocks_reruns_and_uniformity(spark):
    df = spark.range(0, 4000, 1, 4).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: (r.shard, r.slot) for r in shard_rows(df, 4, block_rows=100).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in shard_rows(df, 4, block_rows=100).collect()}
    assert a == b and len(set(a.values())) == 4000
    # The ids of each input partition spread evenly over shards and over slots.
    for p in range(4):
        own = [a[i] for i in range(1000 * p, 1000 * p + 1000)]
        assert all(190 < n < 310 for n in Counter(s for s, _ in own).values())
        assert abs(np.mean([x for _, x in own]) - 500) < 40


def test_empty(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string"), 4).count() == 0


def test_draws_follow_the_exact_law():
    rng = np.random.Generator(np.random.PCG64(1))
    for good, bad, n in ((3, 4, 5), (40, 60, 30), (1, 500, 7), (0, 5, 2), (5, 0, 3), (6, 6, 12), (700, 300, 400)):
        got = Counter(hypergeometric(rng, np.full(40_000, good), bad, n).tolist())
        for k in range(max(0, n - bad), min(n, good) + 1):
            p = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
            assert abs(got[k] / 40_000 - p) < 5 * sqrt(p * (1 - p) / 40_000) + 1e-4
        assert all(max(0, n - bad) <= k <= min(n, good) for k in got)


def test_draws_beyond_a_billion_rows():
    rng = np.random.Generator(np.random.PCG64(2))
    for good, bad, n in ((3 * 10**9, 47 * 10**9, 10**8), (10**9, 15 * 10**9, 10), (10**11, 10**12, 10**10)):
        x = hypergeometric(rng, np.full(40_000, good), bad, n)
        total = good + bad
        mean, var = n * good / total, n * (good / total) * (bad / total) * ((total - n) / (total - 1))
        assert abs(x.mean() - mean) < 5 * sqrt(var / 40_000) and abs(x.var() / var - 1) < 0.05
    x = Counter(hypergeometric(rng, np.full(40_000, 10**9), 15 * 10**9, 10).tolist())  # ten rows of sixteen billion
    assert all(abs(x[k] / 40_000 - comb(10, k) * 15 ** (10 - k) / 16**10) < 0.01 for k in range(11))


def test_ratios_of_factorials():
    for a, d in ((0, 5), (3, 40), (40, -37), (17, -17), (5 * 10**10, 60), (5 * 10**10, -60), (10**6, 900)):
        low, high = min(a, a + d), max(a, a + d)
        want = sum(log(v) for v in range(low + 1, high + 1)) * (1 if d > 0 else -1)
        assert abs(float(log_factorial_step(np.array(float(a)), np.array(float(d)))) - want) < 1e-6 * max(1, abs(want) * 1e-3)
    # Across a mode the four steps make a ratio near one: against exact fractions.
    g, b, n, m, d = 3 * 10**10, 4 * 10**10, 10**9, 428571428, 40
    exact = prod((Fraction((g - m - i) * (n - m - i), (m + 1 + i) * (b - n + m + 1 + i)) for i in range(d)), start=Fraction(1))
    f = lambda v, s: float(log_factorial_step(np.array(float(v)), np.array(float(s))))
    assert abs(-f(m, d) - f(g - m, -d) - f(n - m, -d) - f(b - n + m, d) - log(exact)) < 1e-7


def test_rows_go_where_the_matrix_says(spark):
    df = spark.range(0, 3001, 1, 7).selectExpr("id as doc_id", "spark_partition_id() as part")
    got = Counter((r.part, r.shard) for r in shard_rows(df, 5, seed=3, block_rows=50).collect())
    counts = Counter(r.part for r in df.collect())
    m = communication_matrix([counts[p] for p in sorted(counts)], exact_sizes(3001, 5), 3)
    assert m.sum(axis=0).tolist() == exact_sizes(3001, 5)
    assert {(p, j): int(m[i, j]) for i, p in enumerate(sorted(counts)) for j in range(5) if m[i, j]} == dict(got)
