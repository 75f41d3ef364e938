"""The plain functions of ``functions.cells`` against the column functions, and the plans that use them."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quern import queries, run_queries  # noqa: F401
from quern.functions import cells, composition, text, units
from quern.operators import align, pairing, tables
from quern.plans import score
from quern.schema import ALL_COLS, Protocol
from quern.sources import readers, writers

SF = "/root/testdata/sf0.001"
PARTS = ["5", "1.5", "-3", "+.5", "2.", "1e3", "1E-2", "12", "350", " ", "  ", " ", " ", "-", "–", "−", " to ", "~", "±", "...", "K", "°C", " C", "℃", "℉", "degC", "kelvin", "F"]
PARTS += ["kPa", "MPa", "bar", "atm", "psi", "torr", "%", " %", ",", "/AC", "/C", "MgO", "Mg", "Al", "Cu", "Ni", "Zn", "Li", "O", "Ox", "C", "AC", "activated carbon", "(", ")", "[", "wt", "wt%", "20 wt% "]
PARTS += ["3:1 ", "PMO", "HT", "hydrotalcite", " catalyst", " mixed oxide", "c-", "γ-", "-", "_", "none", "NULL", "NaN", "n/a", "x", "\n", "\x01", "É", "İ", "0.9", "2", "1.1", "/"]
NAMES = ["Mg-Al", "Cu/Mg-Al", "CuNi-PMO", "20% MgO/C", "Co0.9Mg2Al1.1", "0.0005% Mg/AC", "12345678 wt% MgAlOx", "Mg0Al0", "Mg3Al0", "Zn-Al (calcined)", "γ-Al2O3", "5 % Ru/HT pellets", "1:2 MgAl", "2.50%Cu-PMO"]


def written():
    r = random.Random(7)
    return ["", None, *NAMES, *("".join(r.choice(PARTS) for _ in range(r.randrange(1, 7))) for _ in range(4000))]


def test_values_are_read_as_columns_are(spark):
    v = F.col("v")
    x = spark.createDataFrame([(i, s) for i, s in enumerate(written())], "i int, v string")
    plain = F.regexp_replace(text.normalised(v), "%+$", "")
    dims = (None, "pressure", "temperature")
    x = x.select(
        "v", text.is_null(v).alias("null"), text.normalised(v).alias("norm"), F.when(plain.rlike(f"^{units.NUMBER}$"), plain.try_cast("double")).alias("number"),
        *[units.parse_quantity(v, d).alias(f"q{k}") for k, d in enumerate(dims)], composition.comparable(v).alias("m"), composition.canonical_catalyst(v).alias("name"),
    )
    for r in x.collect():
        assert (cells.is_null(r.v), cells.normalised(r.v), cells.plain_number(r.norm)) == (r.null, r.norm, r.number), repr(r.v)
        for k, d in enumerate(dims):
            assert cells.quantity(r.v, d) == (r[f"q{k}"] and (r[f"q{k}"].lo, r[f"q{k}"].hi)), (repr(r.v), d)
        assert cells.comparable(r.v) == (r.m and tuple(r.m)), repr(r.v)
        assert cells.canonical(cells.parse_catalyst(r.v)) == r.name, repr(r.v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_moves_rows_once(spark):
    """Pairs are no rows of the plan, and no side is broadcast, however small it is taken to be."""
    for name in ("side_by_side", "greedy_alignment", "pair_scores", "score_grouping_sets", "text_scores"):
        shown = plan(queries.QUERIES[name](spark, SF))
        assert not any(x in shown for x in ("HashJoin", "SortMergeJoin", "CartesianProduct", "collect_list")), name
        assert shown.count("REPARTITION_BY_COL") == (2 if name == "side_by_side" else 1), name


def records(spark):
    r = random.Random(3)
    row = lambda: [None if r.random() < 0.2 else f"{r.choice((5, 50, 60, 61))}{r.choice(('', ' kPa', ' C', '-70'))}" for _ in ALL_COLS[1:]]
    cols = ", ".join(f"{c} string" for c in ALL_COLS)
    t = spark.createDataFrame([(f"P{k % 3}", *row(), k) for k in range(90)], f"{cols}, gt_ord long")
    p = spark.createDataFrame([(f"P{k % 4}", *row(), "V4", k % 2, k) for k in range(160)], f"{cols}, version string, rep int, pred_ord long")
    return t, p


def test_parts_of_a_group_give_what_the_whole_gives(spark):
    t, p = records(spark)
    protocols = [Protocol(), Protocol("loose", frozenset()), Protocol().plus("both", "composition_cells", "composition_gate")]
    whole, parts = (sorted(align.greedy(t, p, protocols, score.KEYS, block=n).collect(), key=str) for n in (pairing.BLOCK, 64))
    assert whole == parts and len(whole) > 3 * 90 * 2
    chosen = {(r.protocol, r.rep, r.pred_ord) for r in whole if r.side == "gt" and r.pred_ord is not None}
    assert len(chosen) == sum(1 for r in whole if r.side == "gt" and r.pred_ord is not None)


def test_groups_across_batches(spark):
    t, p = records(spark)
    x, shared, groups, runs = align._sorted_sides(t, p, score.KEYS)
    table = pa.Table.from_batches(x.coalesce(1).sortWithinPartitions(*shared, "side", *groups, "ord").toArrow().to_batches())
    f = pairing.outcomes([Protocol()], shared, groups, runs, False, True)
    both = [sorted((str(r) for b in f(iter(table.to_batches(max_chunksize=n))) for r in b.to_pylist())) for n in (7, 1000)]
    assert both[0] == both[1]
    papers = [set(c["paper"].to_pylist()) for c in pairing.chunks(iter(table.to_batches(max_chunksize=7)), shared, 10)]
    assert len(papers) > 2 and sum(map(len, papers)) == len(set.union(*papers)) == 4


def test_a_null_key_is_scored_but_never_paired(spark):
    t, p = records(spark)
    p = p.withColumn("version", F.when(F.col("pred_ord") % 8 < 4, F.col("version")))
    out = score.score_run(t, p)
    assert out["matches"].where("version is null").count() == 0 and out["matches"].count() > 0
    assert out["rows"].where("version is null and side = 'gt'").count() == 90 * 2
    assert align.score_pairs(t, p, [Protocol()], score.KEYS).where("version is null").count() > 0


def test_names_are_compared_as_columns_are(spark):
    x = spark.createDataFrame([(a, b) for a in [None, "", *NAMES] for b in [None, "", *NAMES, "Mg3Al1", "Mg6Al2", "Mg3Al2"]], "a string, b string")
    a, b = F.col("a"), F.col("b")
    x = x.select("a", "b", cells.catalyst_match(a, b).alias("m"), composition.catalyst_match(a, b).alias("w"), cells.canonical_catalyst(a).alias("c"), composition.canonical_catalyst(a).alias("d"))
    assert all((r.m, r.c) == (r.w, r.d) for r in x.collect())


def test_a_sample_of_few_large_groups(spark):
    """No task holds a group: what is windowed are counts, a row per group and task."""
    x = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5000).alias("o")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    out = tables.systematic_sample(x.repartition(9), ["g"], ["o"], 7)
    rows = {g: sorted(i * 7919 % 5000 for i in range(5000) if (i % 3 or None) == g) for g in (None, 1, 2)}
    want = {(g, v[j * max(1, len(v) // 7)]) for g, v in rows.items() for j in range(7)}
    assert {(r.g, r.o) for r in out.collect()} == want
    shown = plan(out)
    assert "Window" in shown and "row_number" not in shown and all("s_m" in line for line in shown.splitlines() if "- Window" in line)


def test_a_reference_table_of_many_files(spark, tmp_path):
    x = spark.range(1000).select(F.lit("").alias("r"), F.lit("").alias("o"), *[F.when(F.col("id") % 9 != 0, F.concat(F.lit("P\n"), F.col("id").cast("string"))).alias(c) for c in ALL_COLS], "id")
    writers.write_csv(x.repartitionByRange(7, "id").sortWithinPartitions("id").drop("id"), str(tmp_path / "t"))
    back = readers.read_truth(spark, str(tmp_path / "t")).select("gt_ord", "paper").collect()
    assert len(spark.read.csv(str(tmp_path / "t")).inputFiles()) > 3
    assert sorted((r.gt_ord, r.paper) for r in back) == [(i, f"P\n{i}") for i in range(1000) if i % 9]
