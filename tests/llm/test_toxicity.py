import numpy as np

from quern.llm.common import read
from quern.llm.toxicity import Sample, fit, reject_toxic, score, tokens, toxicity_report, train


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = train(docs, labels.where("doc_id % 2 = 0"))
    got = score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").collect()
    right = sum(r.toxic == bool(r.truth) for r in got)
    assert len(got) > 1000 and right / len(got) >= 0.98


def test_ordinal_grades():
    rng = np.random.Generator(np.random.PCG64(1))
    rows, y = [], []
    for _ in range(900):
        bad = int(rng.integers(0, 7))
        rows.append({b"bad%d" % i for i in range(bad)} | {b"w%d" % rng.integers(0, 9)})
        y.append(0 if bad == 0 else 1 if bad < 4 else 2)
    m = fit(Sample(rows[:600]), np.array(y[:600]))
    assert m.thresholds == sorted(m.thresholds) and len(m.thresholds) == 2
    s = m.severity(np.array([sum(m.weights.get(t, 0) for t in r) for r in rows[600:]]))
    assert (np.rint(s) == np.array(y[600:])).mean() > 0.9


def test_defined_cases(spark):
    rows = [(i, "idiot moron here" if i % 4 == 0 else "good words here", 0) for i in range(80)] + [(3, None, 0), (None, "", 0), (4, "idiot " * 20000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity int")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity_report(docs, labels).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.toxic} == {i for i in range(80) if i % 4 == 0}
    kept = reject_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 62
    assert toxicity_report(docs.limit(0), labels).count() == 0
    assert not any(r.toxic for r in toxicity_report(docs, labels.limit(0)).collect())
    assert all(r.toxic for r in toxicity_report(docs, labels.where("toxic = 1")).collect())
    assert tokens("A-bÉ C3") == [b"a", "bÉ".encode(), b"c3"]
