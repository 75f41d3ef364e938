import hashlib
import random
import re

import pytest

from quern.llm.decontamination import contamination, decontaminate, decontamination_report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, n=8):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        hit, ids = set(), set()
        for k in range(len(w)):
            for m in range(1, n + 1):
                if k + m <= len(w) and tuple(w[k : k + m]) in wins:
                    hit.update(range(k, k + m))
                    ids |= wins[tuple(w[k : k + m])]
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2))
    return out


def data():
    rng = random.Random(4)
    v = ["a", "B", "été", "É", "w1", "c", "dd"]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([0, 1, 3, 9, 20])))) for i in range(30)] + [(1, "same words here"), (10, None), (None, "x y z t"), (2, "a a"), (3, "Is abÉ q")]
    docs = [(i, " .,".join(rng.choices(v, k=rng.choice([0, 2, 7, 30, 90])))) for i in range(120)]
    docs += [(1, None), (None, items[5][1]), (3, ""), (3, "..!"), (4, items[7][1] * 30), (4, items[7][1] * 30), (9, "x y z t"), (9, "is ABÉ Q, same-words here")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_rows": 3}, {"shingle": 2}])
def test_against_brute_force(spark, options):
    docs, items = data()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, d_words int")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, win int")
    x = contamination(d, b, **options)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in x.collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)
    if not options:
        assert sorted(map(tuple, decontamination_report(d, b).collect()), key=str) == sorted(got, key=str)
        kept = decontaminate(d, b, min_items=2)
        assert kept.columns == d.columns
        assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None and r.text) == sorted(x for x, y in zip(docs, brute(docs, items), strict=True) if not y[5] and x[0] is not None and x[1])


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontamination_report(d, b.limit(0)).collect()] == [(1, 2, 0, 0)]
    assert decontamination_report(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).count() == 1 and decontaminate(d, b).count() == 0
