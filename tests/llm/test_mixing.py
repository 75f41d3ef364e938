import re
from collections import defaultdict

import pytest

from quern.llm.mixing import integrate, mix_documents, mixed, targets

SCHEMA = "doc_id long, text string, source string, m_row int, n long"


def brute_targets(sizes, weights):
    t = [sum(sizes) * w / sum(weights) for w in weights]
    while any(x > 3 * s + 1e-9 for x, s in zip(t, sizes, strict=True)):
        done = [x >= 3 * s for x, s in zip(t, sizes, strict=True)]
        excess = sum(max(0, x - 3 * s) for x, s in zip(t, sizes, strict=True))
        t = [min(x, 3 * s) for x, s in zip(t, sizes, strict=True)]
        free = sum(w for w, d in zip(weights, done, strict=True) if not d)
        t = [x if d else x + excess * w / free for x, w, d in zip(t, weights, done, strict=True)]
    return t


@pytest.mark.parametrize("sizes", [[100, 1, 50, 7], [5, 5, 5], [1000, 0, 3, 90, 4]])
def test_targets(sizes):
    weights = [(1, 2, 3)[k % 3] for k in range(len(sizes))]
    assert targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_schedule_integral():
    _, w, c = integrate([(0.0, 2.0), (0.5, 1.0), (1.0, 0.0)])
    assert c == pytest.approx([0, 0.75, 1.0])


def docs(spark):
    rows = [(i, " \t".join(["w x"] * (i % 11)), None if i % 9 == 0 else "s%d" % (i * i % 5), i, i) for i in range(300)]
    rows += [(1, None, "s1", 0, 0), (None, "a b c", "s1", None, None), (5, "", "s0", 1, 1), (7, "q " * 4000, "z", 1, 1), (7, "q " * 40, "s0", 1, 1), (7, "q " * 40, "s0", 1, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_contract(spark):
    rows, df = docs(spark)
    got = mix_documents(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s, *_ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([size[s] for s in order], [(1, 2, 3)[k % 3] for k in range(len(order))]), strict=True))
    taken = defaultdict(int)
    by_target = {(size[s], round(t, 6)): s for s, t in want.items()}
    for r in got:
        s = by_target[r.source_size, round(r.target, 6)]
        taken[s] += r.taken
        assert r.source_size == size[s] and 0 <= r.taken <= 3 * r.size and all(0 <= p <= 1 for p in r.positions)
        assert list(r.positions) == sorted(r.positions)
    for s in want:
        assert abs(taken[s] - want[s]) <= 1
    again = mix_documents(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert [x.taken for x in sorted(got, key=key)] == [x.taken for x in sorted(again, key=key)]


def test_mixed_keeps_columns_and_order(spark):
    rows, df = docs(spark)
    out = mixed(df)
    assert out.columns == df.columns
    got = out.collect()
    assert max(sum(r.doc_id == i for r in got) for i in range(20, 40)) <= 3
    assert mixed(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0
