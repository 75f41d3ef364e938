"""Each stage against a plain reading of what it does, on rows with planted cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from quern.llm.mixing import targets

TOXIC = ["idiot", "moron", "loser"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    v = [f"w{i}" for i in range(300)]
    prose = lambda n: rng.choices(v, k=n)
    rows, kind = [], {}
    items = [(i, " ".join(prose(20))) for i in range(6)]

    def add(words, what):
        i = len(rows)
        rows.append((i, " ".join(words), "en", f"s{rng.randrange(4)}" if i % 17 else None, len(words)))
        kind[i] = what

    for _ in range(240):
        add(prose(rng.randrange(30, 200)), ("clean",))
    for _ in range(40):
        add([*prose(40), *TOXIC, *prose(40)], ("toxic",))
    for g in range(8):
        base = prose(150)
        for c in range(rng.choice([2, 5])):
            t = list(base)
            if c % 2:
                t[rng.randrange(150)] = "edit"
            add(t, ("copy", g))
    for i, text in items:
        t = prose(60)
        t[20:20] = text.split()[3:15]
        add(t, ("leak", i))
    labels = [(i, 1, int(k[0] == "toxic")) for i, k in kind.items() if k[0] in ("clean", "toxic")]
    rows += [(None, None, None, None, None), (500, "", "en", "s1", 0), (501, None, "en", "s1", None)]
    return rows, kind, items, labels


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    rows, kind, items, labels = corpus()
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    outs, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{sf}/out-{name}")
        docs = spark.read.parquet(f"{sf}/out-{name}")
        outs[name] = docs
    return rows, kind, sf, outs


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages(run):
    rows, kind, _, outs = run
    left = set(ids(outs["toxicity"]))
    assert left == {r[0] for r in rows if r[0] is None or kind.get(r[0], ("",))[0] != "toxic"}
    after = Counter(ids(outs["near_duplicates"]))
    groups = defaultdict(list)
    for i, k in kind.items():
        if k[0] == "copy":
            groups[k[1]].append(i)
    assert all(sum(after[i] for i in g) == 1 and after[min(g)] == 1 for g in groups.values())
    assert {i for i, k in kind.items() if k[0] in ("clean", "leak")} <= set(after)
    clean = set(ids(outs["decontamination"]))
    assert clean == {i for i in after if kind.get(i, ("",))[0] != "leak"}
    for name in list(outs)[:-1]:
        assert outs[name].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_mixing_against_brute_force(run):
    _, _, _, outs = run
    before, after = outs["decontamination"].collect(), outs["mixing"].collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, took, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        size[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    for r in after:
        took[r.source] += words(r.text)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = targets([size[s] for s in order], [1.0 + k % 3 for k in range(len(order))])
    for s, t in zip(order, want, strict=True):
        assert abs(took[s] - t) <= longest[s]
    assert max(Counter(r.doc_id for r in after if r.text).values()) <= 3


def test_sharding(run):
    _, _, _, outs = run
    rows = outs["sharding"].collect()
    assert Counter(r.doc_id for r in rows) == Counter(ids(outs["mixing"]))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_run_and_odd_inputs(spark, run):
    _, _, sf, outs = run
    got = corpus_pipeline.run(spark, sf)
    assert got.columns[-2:] == ["shard", "slot"] and sorted(ids(got), key=str) == sorted(ids(outs["sharding"]), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    clash = spark.createDataFrame(
        [(1, "a b c", "en", "s", 3, "k", 1, 2), (1, "a b c", "en", "s", 3, "k", 1, 2), (None, None, None, None, None, None, None, None), (2, "x " * 40_000, "en", "s", 1, "k", 1, 2)],
        SCHEMA + ", key string, toxic int, shard int",
    )
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, sf)
        assert out.count() == (3 if name == "near_duplicates" else out.count())
        assert set(clash.columns) <= set(out.columns)
