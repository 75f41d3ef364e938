"""Queries over the test tables, one per operator or plan, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs, oracle
from .functions import cells, fidelity, replies, segments, text, units
from .inputs import LINES, PREDS, REPLIES, TRUTH, register, rows
from .operators import align, documents, ingest, manifest, metrics, tables
from .plans import rebuild as rebuilding
from .plans import score as scoring
from .schema import Protocol, audit_protocols, c3_protocols

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STRICT = Protocol("strict")
RESTRICTED = STRICT.without("restricted", "surplus")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    register(spark, sf_dir, "orders")
    return spark.sql(TRUTH), spark.sql(PREDS)


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


COUNTS = ("tp", "tp_rng", "fp", "fp_un", "fn")


# ── Scoring ──────────────────────────────────────────────────────────────────


@query(oracle.scoring([STRICT], f'select "column", version, {oracle.SUMS}, {oracle.PRF} from cells group by "column", version'))
def score_columns(spark, sf_dir):
    """Pooled counts and scores of every column and version: the flagship."""
    truth, preds = _records(spark, sf_dir)
    x = metrics.with_prf(metrics.pooled(scoring.score_run(truth, preds, [STRICT])["cells"], ["column", "version"]))
    return _rounded(x.select("column", "version", *COUNTS, "p", "r", "f1"), "p", "r", "f1")


@query(oracle.scoring([STRICT, RESTRICTED], f"select protocol, version, rep, {oracle.SUMS}, {oracle.PRF} from cells group by protocol, version, rep"))
def score_runs(spark, sf_dir):
    x = scoring.score_run(*_records(spark, sf_dir), [STRICT, RESTRICTED])["scores"]
    return _rounded(x.select("protocol", "version", "rep", *COUNTS, "p", "r", "f1"), "p", "r", "f1")


@query(
    oracle.scoring(
        [STRICT],
        f"""select version, round(avg(f1), 6) as f1_mean, round(coalesce(stddev_samp(f1), 0), 6) as f1_sd, round(avg(p), 6) as p_mean, round(avg(r), 6) as r_mean, count(*) as n_reps
        from (select version, rep, {oracle.P} as p, {oracle.R} as r, {oracle.F1} as f1 from cells group by version, rep) group by version""",
    )
)
def score_summary(spark, sf_dir):
    x = scoring.score_run(*_records(spark, sf_dir), [STRICT])["summary"]
    return _rounded(x.select("version", "f1_mean", "f1_sd", "p_mean", "r_mean", "n_reps"), "f1_mean", "f1_sd", "p_mean", "r_mean")


@query(
    oracle.scoring(
        [STRICT],
        f"""select version, paper, "column", case when grouping(paper) = 0 and grouping("column") = 0 then 'paper,column' when grouping("column") = 0 then 'column'
        when grouping(paper) = 0 then 'paper' else 'all' end as level, {oracle.SUMS}
        from cells group by grouping sets ((version, paper, "column"), (version, "column"), (version, paper), (version))""",
    )
)
def score_grouping_sets(spark, sf_dir):
    x = scoring.score_run(*_records(spark, sf_dir), [STRICT])["cells"]
    return metrics.grouping_sets(x, ["version"]).select("version", "paper", "column", "level", *COUNTS)


@query(
    oracle.scoring(
        [STRICT],
        f"""select paper, round(avg(f1) filter (version = 'V4'), 6) as "V4", round(avg(f1) filter (version = 'V5'), 6) as "V5"
        from (select paper, version, rep, {oracle.F1} as f1 from cells group by paper, version, rep) group by paper""",
    )
)
def per_paper_pivot(spark, sf_dir):
    x = scoring.score_run(*_records(spark, sf_dir), [STRICT])["papers"]
    return _rounded(metrics.per_paper_pivot(x, ["V4", "V5"]), "V4", "V5")


def _audit_sql(protocols):
    return oracle.scoring(
        protocols,
        f"""select protocol, step, {oracle.SUMS}, round(f1, 6) as f1, round(f1 - lag(f1) over (order by step), 6) as d_f1, round(f1 - first_value(f1) over (order by step), 6) as d_f1_base
        from (select protocol, step, sum(tp) as tp, sum(tp_rng) as tp_rng, sum(fp) as fp, sum(fp_un) as fp_un, sum(fn) as fn, {oracle.F1} as f1
        from cells join (select protocol, step from k) using (protocol) group by protocol, step) group by protocol, step, f1""",
    )


def _audit(spark, sf_dir, protocols):
    x = scoring.audit(*_records(spark, sf_dir), protocols)
    return _rounded(x.select("protocol", "step", *COUNTS, "f1", "d_f1", "d_f1_base"), "f1", "d_f1", "d_f1_base")


@query(_audit_sql(audit_protocols(False)))
def protocol_audit(spark, sf_dir):
    """Seven cumulative protocols in one plan."""
    return _audit(spark, sf_dir, audit_protocols(False))


@query(_audit_sql(c3_protocols()))
def c3_ablation(spark, sf_dir):
    return _audit(spark, sf_dir, c3_protocols())


@query(oracle.scoring([STRICT], "select paper, version, rep, gt_ord, pred_ord from matched"))
def greedy_alignment(spark, sf_dir):
    return scoring.score_run(*_records(spark, sf_dir), [STRICT])["matches"].select("paper", "version", "rep", "gt_ord", "pred_ord")


@query(oracle.scoring([STRICT], "select paper, version, rep, gt_ord, pred_ord from matched"))
def greedy_alignment_streamed(spark, sf_dir):
    """The same choice for groups of very many pairs."""
    out = scoring.score_run(*_records(spark, sf_dir), [STRICT], match=align.greedy_large)["matches"]
    return out.select("paper", "version", "rep", "gt_ord", "pred_ord")


@query(oracle.scoring([STRICT], "select paper, version, rep, gt_ord, pred_ord, score from pairs"))
def pair_scores(spark, sf_dir):
    truth, preds = _records(spark, sf_dir)
    x = align.score_pairs(truth, preds, [STRICT], scoring.KEYS, codes=False)
    return x.select("paper", "version", "rep", "gt_ord", "pred_ord", "score")


@query(
    oracle.scoring(
        [STRICT],
        """select p.paper, p.version, p.rep, n_gt, n_pred, coalesce(n_matched, 0) as n_matched, n_pred - coalesce(n_matched, 0) as n_unmatched_pred
        from (select paper, version, rep, count(*) as n_pred from pred group by all) p join (select paper, count(*) as n_gt from truth group by all) t using (paper)
        left join (select paper, version, rep, count(*) as n_matched from matched group by all) m using (paper, version, rep)""",
    )
)
def row_counts(spark, sf_dir):
    truth, preds = _records(spark, sf_dir)
    matches = scoring.score_run(truth, preds, [STRICT])["matches"]
    x = metrics.row_counts(truth, preds, matches, scoring.KEYS)
    return x.select("paper", "version", "rep", "n_gt", "n_pred", "n_matched", "n_unmatched_pred")


@query(
    oracle.scoring(
        [STRICT],
        """select paper, version, rep, gt_ord, pred_ord, "column", case outcome when 'exact' then '✓' when 'range' then '≈' else case when outcome is not null then '✗' end end as mark, null::bigint as n_filled
        from cells where side = 'gt' union all
        select paper, version, rep, null, pred_ord, null, null, count(outcome) from cells where side = 'pred' group by paper, version, rep, pred_ord""",
    )
)
def side_by_side(spark, sf_dir):
    truth, preds = _records(spark, sf_dir)
    x = align.side_by_side(scoring.score_run(truth, preds, [STRICT])["rows"], [STRICT], scoring.KEYS, texts=False)
    return x.select("paper", "version", "rep", "gt_ord", "pred_ord", "column", "mark", "n_filled")


@query(
    """with c as (select count(*) filter (quality = 1 and toxic = 1) as tp, count(*) filter (quality = 1 and toxic = 0) as fp, count(*) filter (quality = 0 and toxic = 1) as fn from labels)
    select tp, fp, fn, round(tp::double / nullif(tp + fp, 0), 6) as p, round(tp::double / nullif(tp + fn, 0), 6) as r,
      round(case when tp + fp = 0 or tp + fn = 0 then null when tp = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 6) as f1 from c"""
)
def binary_prf(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/labels.parquet")
    count = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    x = x.agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn")).withColumn("fn_fig", F.lit(0))
    return _rounded(metrics.with_prf(x).select("tp", "fp", "fn", "p", "r", "f1"), "p", "r", "f1")


# ── Quantities and compositions ──────────────────────────────────────────────

PRESSURES = f"select p_partkey, {inputs.text('p_size')} || ' ' || {inputs.pick('p_partkey', ('Pa', 'hPa', 'kPa', 'Mpa', 'bar', 'mbar', 'atm', 'Torr', 'psi', 'psig', 'ell', 'GPa'))} as written from part"
TEMPERATURES = f"select p_partkey, {inputs.text('p_size')} || {inputs.pick('p_partkey', (' K', ' degC', ' °C', ' C', ' F', '', ' kelvin', ' ℃', ' x'))} as written from part"
RANGES = f"""select event_id, {inputs.text('event_id % 90')} || {inputs.pick('event_id', ('-', ' – ', ' to ', '~', '±', '...', ' K - ', ' and '))} || {inputs.text('user_id % 50')} || '.5 h-1' as written from events"""


def _quantity_sql(source: str, key: str, dimension: str | None) -> str:
    return f"select {key}, round(q.lo, 6) as lo, round(q.hi, 6) as hi from (select {key}, {oracle.quantity('written', dimension)} as q from ({source}))"


def _quantities(df: DataFrame, key: str, dimension: str | None) -> DataFrame:
    x = df.select(key, units.parse_quantity(F.col("written"), dimension).alias("q"))
    return x.select(key, F.round("q.lo", 6).alias("lo"), F.round("q.hi", 6).alias("hi"))


@query(_quantity_sql(PRESSURES, "p_partkey", "pressure"))
def unit_pressure(spark, sf_dir):
    return _quantities(rows(spark, sf_dir, PRESSURES, "part"), "p_partkey", "pressure")


@query(_quantity_sql(TEMPERATURES, "p_partkey", "temperature"))
def unit_temperature(spark, sf_dir):
    return _quantities(rows(spark, sf_dir, TEMPERATURES, "part"), "p_partkey", "temperature")


@query(_quantity_sql(RANGES, "event_id", None))
def range_parse(spark, sf_dir):
    return _quantities(rows(spark, sf_dir, RANGES, "events"), "event_id", None)


KINDS = f"""select l_orderkey, l_linenumber,
  case when l_partkey % 4 = 0 then {inputs.text('l_partkey % 100')} || ' - ' || {inputs.text('l_partkey % 100 + 9')} else {inputs.text('l_partkey % 100 + l_suppkey % 7')} end as pred,
  case when l_partkey % 6 = 0 then {inputs.text('l_partkey % 100 + 1')} || '-' || {inputs.text('l_partkey % 100 + 8')} else {inputs.text('l_partkey % 100')} end as truth from lineitem"""


@query(
    f"""select kind_abs, kind_rel, count(*) as n from (select {oracle.kind_of('p', 't', "'abs'", '2.0::double')} as kind_abs, {oracle.kind_of('p', 't', "'rel'", '0.05::double')} as kind_rel
    from (select {oracle.quantity('pred', None)} as p, {oracle.quantity('truth', None)} as t from ({KINDS}))) group by all"""
)
def tolerance_kinds(spark, sf_dir):
    x = rows(spark, sf_dir, KINDS, "lineitem", spread=True).select(units.parse_quantity(F.col("pred")).alias("p"), units.parse_quantity(F.col("truth")).alias("t"))
    kind = lambda m, t: units.quantity_kind(F.col("p"), F.col("t"), F.lit(m), F.lit(t))
    return x.select(kind("abs", 2.0).alias("kind_abs"), kind("rel", 0.05).alias("kind_rel")).groupBy("kind_abs", "kind_rel").agg(F.count("*").alias("n"))


NAMES = f"select p_partkey, {inputs.pick('p_partkey', inputs.CATALYSTS)} as a, {inputs.pick('p_partkey + p_partkey % 5', inputs.SPELLINGS)} as b from part"


@query(f"select p_partkey, {oracle.material('a')} as canon_a, {oracle.material('b')} as canon_b from ({NAMES})")
def catalyst_canonical(spark, sf_dir):
    x = rows(spark, sf_dir, NAMES, "part", spread=True)
    return x.select("p_partkey", *[cells.canonical_catalyst(F.col(c)).alias(f"canon_{c}") for c in "ab"])


@query(f"select p_partkey, {oracle.material('a')} = {oracle.material('b')} as same from ({NAMES})")
def catalyst_match(spark, sf_dir):
    x = rows(spark, sf_dir, NAMES, "part", spread=True)
    return x.select("p_partkey", cells.catalyst_match(F.col("a"), F.col("b")).alias("same"))


WRITTEN = f"select event_id, {inputs.text('event_id % 40')} || {inputs.pick('event_id', ('.5', '', '.25', ' to 9', '.75'))} as written from events"


@query(
    f"""select event_id, case when try_cast(written as double) is null then written else cast(cast(round_even(try_cast(written as double) + 273.15, 0) as bigint) as varchar) end as kelvin,
    case when try_cast(written as double) is null then written else cast(cast(round_even(try_cast(written as double) * 101.325::double, 0) as bigint) as varchar) || ' kPa' end as kpa from ({WRITTEN})"""
)
def convert_round_even(spark, sf_dir):
    x = rows(spark, sf_dir, WRITTEN, "events")
    return x.select("event_id", units.celsius_cell(F.col("written")).alias("kelvin"), units.atm_cell(F.col("written")).alias("kpa"))


VALUES = f"select event_id, {inputs.pick('event_id', ('', ' none ', 'NULL', 'n/a', 'x /AC', ' NaN', 'None', 'Not reported', '1,5', '-'))} as v from events"


@query(
    f"""select event_id, {oracle.empty('v')} as cell_null, case when v in ('', 'None') then null else v end as csv, {oracle.norm('v')} as norm,
    lower(trim(v)) in ('null', 'none', 'n/a', 'not reported', '') as ingest_null from ({VALUES})"""
)
def null_vocab(spark, sf_dir):
    x, v = rows(spark, sf_dir, VALUES, "events"), F.col("v")
    return x.select("event_id", text.is_null(v).alias("cell_null"), text.null_csv(v).alias("csv"), text.normalised(v).alias("norm"), text.is_null_ingest(v).alias("ingest_null"))


# ── Replies and records ──────────────────────────────────────────────────────


@query(f"select {inputs.FORMS} as form, count(*) as n from events group by all")
def reply_forms(spark, sf_dir):
    x = rows(spark, sf_dir, REPLIES, "events").select(replies.parsed(F.col("text"))["form"].alias("form"))
    return x.groupBy("form").agg(F.count("*").alias("n"))


@query(
    f"""select slug, version, rep, label, form from (select slug, version, rep, label, {inputs.FORMS} as form, failed from (select r.*, event_id from ({REPLIES}) r join events e on r.path = cast(e.event_id as varchar)))
    where not failed or form is not null"""
)
def first_success(spark, sf_dir):
    x = ingest.usable_attempts(rows(spark, sf_dir, REPLIES, "events", spread=True), ["slug", "version", "rep", "label"])
    return x.select("slug", "version", "rep", "label", "form")


ATTEMPTS = "select user_id, event_id as attempt, case when event_id % 3 = 0 then 'ok' else 'parse_error' end as status from events"


@query(f"select user_id, max(attempt) as attempt from ({ATTEMPTS}) where status = 'ok' group by user_id")
def latest_success(spark, sf_dir):
    return ingest.latest_success(rows(spark, sf_dir, ATTEMPTS, "events"), ["user_id"]).select("user_id", "attempt")


_REBUILT = f"""
select case event_id % 6 when 0 then 'Mg-Al' when 1 then 'Zn-Al' when 2 then 'Cu' when 4 then 'Ni' end as catalyst,
  case event_id % 6 when 0 then cast(event_id % 50 as varchar) end as temperature_K, case event_id % 6 when 0 then 'GHSV 15' end as GHSV_h,
  case event_id % 6 when 1 then cast(event_id % 9 as varchar) end as conversion_pct, case event_id % 6 when 2 then 'N2' end as gas_mix,
  case event_id % 6 when 4 then '{{"v": 1}}' end as pressure, case when event_id % 12 = 11 then '3' end as loading_g,
  'u' || cast(user_id % 40 as varchar) as slug, case when event_id % 2 = 0 then 'V3' else 'V4' end as version, cast(1 + event_id % 3 as int) as rep, event_id
from events where event_id % 6 <> 3 and event_id % 12 <> 5"""


@query(
    f"""select slug, version, rep, pred_ord, catalyst, "temperature_K", "GHSV_h", conversion_pct, gas_mix, pressure, loading_g from (
      select *, row_number() over (partition by slug, version, rep order by failed, path) - 1 as pred_ord from (
        select slug, version, rep, catalyst, "temperature_K", "GHSV_h", conversion_pct, gas_mix, pressure, loading_g,
          min(event_id % 6 = 5) as failed, arg_min(cast(event_id as varchar), (event_id % 6 = 5, cast(event_id as varchar))) as path
        from ({_REBUILT}) group by all))"""
)
def rebuild_records(spark, sf_dir):
    """Replies to harmonised rows without exact repeats, in the order of their files."""
    x = rebuilding.rebuild(rows(spark, sf_dir, REPLIES, "events", spread=True))
    return x.select("slug", "version", "rep", "pred_ord", "catalyst", "temperature_K", "GHSV_h", "conversion_pct", "gas_mix", "pressure", "loading_g")


@query(
    f"""select count(*) as chunks, count(*) filter (f is not null and not failed) as parsed_first_attempt, count(*) filter (f is not null and failed) as recovered_from_rejected,
    count(*) filter (f is null) as still_unparseable, round(count(*) filter (f is null)::double / count(*), 4) as true_parse_failure_rate from (select {inputs.FORMS} as f, event_id % 6 = 5 as failed from events)"""
)
def rebuild_summary(spark, sf_dir):
    return rebuilding.summary(rows(spark, sf_dir, REPLIES, "events"))


KEYS = f"select event_id, {inputs.pick('event_id', ('Temp', ' temperature-K ', 'LHSV', 'Space Velocity', 'sv', 'mass', 'Paper', 'conversion %', 'Temperature (K)', 'gas  feed'))} as key, {inputs.pick('event_id', ('1', 'whsv 3', '2 LHSV'))} as value from events"


@query(
    f"""select event_id, case event_id % 10 when 0 then 'temperature_K' when 1 then 'temperature_K' when 2 then 'LHSV_h' when 3 then v when 4 then v when 5 then 'loading_g' when 6 then 'paper'
    when 7 then 'conversion_pct' when 9 then 'gas_mix' end as col from (select *, case event_id % 3 when 1 then 'WHSV_h' when 2 then 'LHSV_h' end as v from ({KEYS}))"""
)
def key_alias(spark, sf_dir):
    return rows(spark, sf_dir, KEYS, "events").select("event_id", ingest.canonical_key(F.col("key"), F.col("value")).alias("col"))


@query("select doc_id from (select doc_id, row_number() over (partition by lower(trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) order by doc_id) as k from documents) where k = 1")
def dedupe_keep_first(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ingest.dedupe_keep_first(x, [], ["doc_id"], ("text",)).select("doc_id")


# ── Grids, ranks, samples, hashes ────────────────────────────────────────────


# A grid with a hole in every fourth diagonal.
HELD = "select c_nationkey, c_mktsegment from customer where (c_nationkey + length(c_mktsegment)) % 4 <> 0"


@query(f"select n_nationkey as c_nationkey, c_mktsegment from nation cross join (select distinct c_mktsegment from customer) x where not exists (select 1 from ({HELD}) h where h.c_nationkey = n_nationkey and h.c_mktsegment = x.c_mktsegment)")
def grid_completeness(spark, sf_dir):
    x = rows(spark, sf_dir, HELD, "customer", "nation")
    expected = tables.grid(spark.table("nation").select(F.col("n_nationkey").alias("c_nationkey")), spark.table("customer").select("c_mktsegment").distinct())
    return tables.missing_cells(expected, x, ["c_nationkey", "c_mktsegment"])


@query("select s.source, l.lang, count(d.doc_id) as n from (select distinct source from documents) s cross join (select distinct lang from documents) l left join documents d on d.source = s.source and d.lang = l.lang group by all")
def zero_filled(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "lang")
    keys = tables.grid(x.select("source").distinct(), x.select("lang").distinct())
    return tables.zero_filled(keys, x.groupBy("source", "lang").agg(F.count("*").alias("n")), ["source", "lang"], ["n"])


@query("select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc nulls last, doc_id) as k from documents) where k <= 3")
def label_top_n(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", "doc_id", "n_chars")
    return tables.top_n(x, ["source"], [F.desc_nulls_last("n_chars"), "doc_id"], 3)


@query(
    """select l_orderkey, l_linenumber, l_returnflag from (select *, greatest(1, n // 7) as k from (select l_orderkey, l_linenumber, l_returnflag,
    row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as i, count(*) over (partition by l_returnflag) as n from lineitem)) where i % k = 0 and i // k < 7"""
)
def systematic_sample(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey")
    return tables.systematic_sample(x, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 7).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("select doc_id, sha256(text) as sha256, left(sha256(source), 16) as source_hash, replace(replace(lower(source || ' /' || lang), ' ', ''), '/', '') as slug from documents")
def sha_manifest(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat("source", F.lit(" /"), "lang")
    return x.select("doc_id", manifest.content_hash(F.col("text")).alias("sha256"), replies.prompt_hash(F.col("source")).alias("source_hash"), tables.slug(name).alias("slug"))


@query(
    """select c_nationkey, c.k as place, c.c_custkey, s.s_suppkey as b_s_suppkey from (select *, row_number() over (partition by c_nationkey order by c_custkey) as k from customer) c
    join (select *, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier) s on c.c_nationkey = s.s_nationkey and c.k = s.k"""
)
def positional_join(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey", "c_custkey")
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey")
    return tables.positional_join(a, b, ["c_custkey"], ["s_suppkey"], ["c_nationkey"])


@query("select source, sum(chars) as chars, sum(n) as n, round(sum(chars)::double / sum(n), 4) as mean_chars from (select source, sum(n_chars) as chars, count(*) as n from documents group by source, doc_id % 3) group by source")
def merge_totals(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = x.groupBy("source", F.col("doc_id") % 3).agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    return metrics.merge_totals(parts, ["source"], ["chars", "n"], ("mean_chars", "chars", "n"))


# ── Documents ────────────────────────────────────────────────────────────────


def _lines(spark, sf_dir):
    return rows(spark, sf_dir, LINES, "lineitem", spread=True)


TOKENS = f"select l_orderkey, l_linenumber, l_partkey, translate({inputs.text('l_partkey')} || '.' || {inputs.text('l_suppkey % 10')}, '01586', 'OlSBG') as token, '0' || {inputs.text('l_suppkey')} as zero from lineitem"


@query(
    f"""select l_orderkey, l_linenumber, translate(token, 'OSlIBG', '051186') as t1, case when regexp_matches(zero, '^0\\d{{1,4}}$') then '0.' || substr(zero, 2) end as d1,
    regexp_matches(token, '^[0-9OSlIBG.,%()\\-+/±–—:;*]+$') as shaped, regexp_matches(token, '^[-+(]?\\d{{1,6}}(?:[.,]\\d{{1,6}})?[)%]?[.,;:]?$') as clean from ({TOKENS})"""
)
def ocr_tiers(spark, sf_dir):
    t = F.col("token")
    return rows(spark, sf_dir, TOKENS, "lineitem").select(
        "l_orderkey", "l_linenumber", fidelity.repair_chars(t).alias("t1"), fidelity.leading_zero(F.col("zero")).alias("d1"), fidelity.shape_ok(t).alias("shaped"), fidelity.is_clean_number(t).alias("clean")
    )


@query(f"select l_orderkey, l_linenumber, list_filter(range(1, len(token) + 1), lambda i: substr(token, i, 1) <> substr(translate(token, 'OSlIBG', '051186'), i, 1))::int[] as places from ({TOKENS})")
def changed_positions(spark, sf_dir):
    t = F.col("token")
    return rows(spark, sf_dir, TOKENS, "lineitem").select("l_orderkey", "l_linenumber", fidelity.changed_positions(t, fidelity.repair_chars(t)).alias("places"))


DOC_LINE = "doc, page, line_no"


@query(f"{oracle.damaged_lines(LINES, DOC_LINE)} select {DOC_LINE}, kind, suspects, repaired from damaged")
def ocr_line_kind(spark, sf_dir):
    """Damaged lines with their kind, tokens and repairs."""
    x = documents.line_verdicts(_lines(spark, sf_dir))
    return x.select("doc", "page", "line_no", "kind", "suspects", "repaired")


@query(
    f"""{oracle.edited_lines(oracle.numbered(LINES), f'uid, {DOC_LINE}', True)} select {DOC_LINE}, cast(n as int) as n, kind, before, after, tier, trim(line) as line_before, trim(fixed) as line_after
    from edits join fixed using (uid, {DOC_LINE})"""
)
def repair_edits(spark, sf_dir):
    return documents.changes(documents.repaired_lines(_lines(spark, sf_dir), use_d2=True))


@query(oracle.coverage(LINES, "page"))
def repair_coverage(spark, sf_dir):
    return documents.repair_coverage(documents.repaired_lines(_lines(spark, sf_dir)), ["page"])


@query(f"{oracle.damaged_lines(LINES, DOC_LINE)} {oracle.CHARS}")
def char_hits(spark, sf_dir):
    return documents.char_hits(documents.line_verdicts(_lines(spark, sf_dir)))


def _pages(spark, sf_dir):
    x = inputs.read(spark, sf_dir, "documents", spread=True).where("doc_id is not null")
    return x.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")


@query(oracle.REPORT)
def doc_report(spark, sf_dir):
    """Line statistics of every document, with fonts and image covers derived from its id."""
    pages = _pages(spark, sf_dir)
    fonts = pages.select("doc", F.when(F.col("doc") % 2 == 0, "Courier").otherwise("ABCDEF+Times").alias("font"), F.length("text").alias("n"))
    images = pages.select("doc", "page", (F.col("doc") % 5 / 3.0).alias("cover"))
    return documents.document_report(pages, fonts, images)


VERDICTS = "select event_id, (event_id % 10) / 100.0 as subset, cast(1 + event_id % 5 as int) as fonts, (event_id % 7) / 6.0 as cover, (event_id % 4) / 4.0 as density, case when event_id % 3 = 0 then 'Courier' else 'X' end as font from events"


@query(
    f"""select event_id, case when s and density >= 0.5 then 'SCANNED_OCR' when s then 'SCANNED_OCR (clean)' when density >= 0.5 then 'NATIVE (corruption flagged)' else 'NATIVE_TEXT' end as verdict
    from (select *, subset < 0.05 and fonts <= 3 and cover > 0.80 and font = 'Courier' as s from ({VERDICTS}))"""
)
def verdict(spark, sf_dir):
    x = rows(spark, sf_dir, VERDICTS, "events")
    made = documents.provenance(F.col("subset"), F.col("fonts"), F.col("cover"), F.array("font"), F.col("density"))
    return x.select("event_id", made.alias("verdict"))


# A page marker before every second line, headings between: shaped like extracted documents.
PAGED = """select doc_id, '[Page 1]' || chr(10) || replace(text, chr(10), chr(10) || '[Page 2]' || chr(10)) as text from documents where text is not null"""
HEADED = """select doc_id, 'Title' || chr(10) || 'Abstract' || chr(10) || text || chr(10) || '2. Experimental Section:' || chr(10) || text || chr(10) || 'Results and Discussion' || chr(10) || left(text, 50)
  || chr(10) || 'Supplementary Material' || chr(10) || 'x' || chr(10) || 'References' || chr(10) || '[1] a' as text from documents where text is not null"""


@query(
    f"""with recursive p as (select doc_id, string_split(text, '[Page ') as parts, text from ({PAGED}) where length(text) > 3000),
    f(doc_id, i, cur, done) as (
      select doc_id, 1, '', []::varchar[] from p union all
      select f.doc_id, i + 1,
        case when length(cur) + length(parts[i]) < 3000 then cur || case when parts[i] <> '' then '[Page ' || parts[i] else '' end else '[Page ' || parts[i] end,
        case when length(cur) + length(parts[i]) < 3000 or cur = '' then done else list_append(done, cur) end
      from f join p using (doc_id) where i <= len(parts)
    ), packed as (
      select doc_id, case when cur <> '' then list_append(done, cur) else done end as c from f join p using (doc_id) where i = len(parts) + 1
      union all select doc_id, [text] from ({PAGED}) where length(text) <= 3000)
    select doc_id, len(c) as n_chunks, md5(array_to_string(c, '|')) as chunks_md5 from packed"""
)
def page_pack(spark, sf_dir):
    x = rows(spark, sf_dir, PAGED, "documents").select("doc_id", segments.pack_pages(F.col("text"), 3000).alias("c"))
    return x.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.md5(F.array_join("c", "|")).alias("chunks_md5"))


@query(f"select doc_id, case when strpos(text, chr(10) || 'References' || chr(10)) > length(text) * 0.2 then length(left(text, strpos(text, chr(10) || 'References' || chr(10)))) else length(text) end as n from ({HEADED})")
def tail_strip(spark, sf_dir):
    x = rows(spark, sf_dir, HEADED, "documents")
    return x.select("doc_id", F.length(segments.strip_tail(F.col("text"))).cast("long").alias("n"))


@query(f"with {oracle.sections('text', HEADED, 'doc_id')} select doc_id, cast(row_number() over (partition by doc_id order by k) - 1 as int) as no, kind, heading, md5(body) as body_md5 from sections")
def section_split(spark, sf_dir):
    x = rows(spark, sf_dir, HEADED, "documents").select("doc_id", F.posexplode(segments.split_sections(F.col("text"))).alias("no", "s"))
    return x.select("doc_id", "no", "s.kind", "s.heading", F.md5("s.body").alias("body_md5"))


@query(oracle.chunked(HEADED, 4000))
def chunks_by_version(spark, sf_dir):
    x = rows(spark, sf_dir, HEADED, "documents").withColumn("version", F.when(F.col("doc_id") % 2 == 0, "V3").otherwise("V1"))
    x = x.select("doc_id", F.posexplode(segments.chunks_for(F.col("version"), F.col("text"), 4000)).alias("no", "c"))
    return x.select("doc_id", "no", "c.label", F.length("c.text").alias("n_chars"))


TABLED = """select event_id, 'Prose' || chr(10) || '[Table on page 1]' || chr(10) || 'a | ' || event_type || chr(10) || ' | ' || chr(10) || chr(10) || 'b | 2' || chr(10) || 'prose again | not' || chr(10) || 'end'
  || chr(10) || '[Table on page 2]' || chr(10) || ' | | ' as text from events"""


@query(f"select event_id, '[Table on page 1]' || chr(10) || 'a | ' || event_type || chr(10) || 'b | 2' || chr(10) || 'prose again | not' as tables from events")
def collect_tables(spark, sf_dir):
    return rows(spark, sf_dir, TABLED, "events").select("event_id", segments.collect_tables(F.col("text")).alias("tables"))
