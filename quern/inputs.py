"""Records, replies and pages derived from the test tables by key arithmetic.

The SQL runs unchanged on Spark and on DuckDB, so a query and its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALYSTS = ("Mg-Al", "Cu/Mg-Al", "Zn-Al", "CuNi-PMO", "20% MgO/C", "Co0.9Mg2Al1.1")
# The same materials, written otherwise, and what either spelling amounts to.
SPELLINGS = ("MgAlOx", "Cu-MgAlOx", "ZnAlOx", "CuNi-Mg-Al", "20 wt% MgO/AC", "Co-Mg-Al")
CANONICAL = ("Mg-Al", "Cu-Mg-Al", "Zn-Al", "CuNi-Mg-Al", "20% MgO/C", "Co-Mg-Al")


def pick(key: str, values: tuple[str, ...]) -> str:
    return f"case ({key}) % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def text(x: str) -> str:
    return f"cast({x} as string)"


TRUTH = f"""
select 'P' || {text('o_custkey')} as paper, o_orderkey as gt_ord, {pick('o_orderkey', CATALYSTS)} as catalyst,
  case when o_orderkey % 5 = 0 then null else {text('1 + o_orderkey % 9')} || '.5' end as loading_g,
  case when o_orderkey % 7 = 0 then {text('550 + o_orderkey % 200')} || ' - ' || {text('650 + o_orderkey % 200')} else {text('550 + o_orderkey % 200')} end as temperature_K,
  {pick('o_orderkey', ('EtOH/N2', 'EtOH, H2', 'none'))} as gas_mix,
  {text('10 + o_orderkey % 50')} as flow_rate_mL_min, cast(null as string) as LHSV_h,
  {text('1 + o_orderkey % 13')} || ' h-1' as WHSV_h, case when o_orderkey % 6 = 0 then '15 mL g-1 h-1' else null end as GHSV_h,
  {pick('o_orderkey', ('1 atm', '101 kPa', '0.1 MPa', '10 bar'))} as pressure,
  {text('o_orderkey % 90')} as conversion_pct, case when o_orderkey % 8 = 0 then '15-30' else {text('o_orderkey % 70')} end as selectivity_pct
from orders"""

# v shifts the damage per version, r per repeat.
PREDS = f"""
select 'P' || {text('o_custkey')} as paper, case v when 0 then 'V4' else 'V5' end as version, r as rep, o_orderkey as pred_ord,
  case when (o_orderkey + r) % 4 = 0 then {pick('o_orderkey', SPELLINGS)} when (o_orderkey + v) % 9 = 0 then {pick('o_orderkey + 1', CATALYSTS)} else {pick('o_orderkey', CATALYSTS)} end as catalyst,
  case when (o_orderkey + r) % 6 = 0 then null else {text('1 + o_orderkey % 9')} || '.6' end as loading_g,
  case when (o_orderkey + v) % 5 = 0 then {text('277 + o_orderkey % 200')} || ' C' else {text('550 + o_orderkey % 200 + 4 * ((o_orderkey + r) % 5)')} end as temperature_K,
  case when (o_orderkey + r) % 10 = 0 then 'air' else {pick('o_orderkey', ('etoh / n2', 'EtOH,H2', 'n/a'))} end as gas_mix,
  {text('10 + o_orderkey % 50 + (o_orderkey + v) % 3')} as flow_rate_mL_min, case when (o_orderkey + r) % 12 = 0 then '2.5' else null end as LHSV_h,
  {text('1 + o_orderkey % 13')} as WHSV_h, case when o_orderkey % 6 = 0 then '15' else '' end as GHSV_h,
  {pick('o_orderkey + v', ('101 kPa', '1 bar', '100 kPa', '1 MPa'))} as pressure,
  case when (o_orderkey + r) % 7 = 0 then {text('o_orderkey % 90')} || '-' || {text('o_orderkey % 90 + 9')} else {text('o_orderkey % 90 + (o_orderkey + v) % 4')} end as conversion_pct,
  case when o_orderkey % 8 = 0 then '15 - 31' else {text('o_orderkey % 70 + (o_orderkey + r) % 5')} || '%' end as selectivity_pct
from orders, (values (0), (1)) as a(v), (values (1), (2)) as b(r)
where (o_orderkey + 3 * v + r) % 11 <> 0"""

# Replies of an extractor: one chunk per event, in five written forms, some of them unusable.
REPLIES = f"""
select 'u' || {text('user_id % 40')} as slug, case when event_id % 2 = 0 then 'V3' else 'V4' end as version, cast(1 + event_id % 3 as int) as rep,
  'results[' || {text('event_id')} || ']' as label, event_id % 6 = 5 as failed, {text('event_id')} as path,
  case event_id % 6
    when 0 then '[{{"Catalyst": "Mg-Al", "Temp": "~' || {text('event_id % 50')} || '", "space velocity": "GHSV 15"}}]'
    when 1 then 'Here:' || chr(10) || '```json' || chr(10) || '[{{"catalyst": null, "Catalyst": "Zn-Al", "conversion": ' || {text('event_id % 9')} || '}}]' || chr(10) || '```'
    when 2 then '{{"catalyst": "Cu", "feed gas": "N2"}}' || chr(10) || '{{"catalyst": "Cu", "feed gas": "N2", "other": [1, 2]}}'
    when 3 then 'Note {{"a": 1}} then [] done'
    when 4 then '{{"rows": [{{"catalyst": "Ni", "pressure": {{"v": 1}}}}], "n": 1}}'
    else case when event_id % 12 = 5 then 'no data here' else 'retry: [{{"mass": " n/a ", "catalyst_mass": "3"}}]' end end as text
from events"""

FORMS = """case event_id % 6 when 0 then 'bare' when 1 then 'fenced' when 2 then 'jsonl' when 3 then 'extra' when 4 then 'bare'
  else case when event_id % 12 = 5 then null else 'extra' end end"""

# Rows of measured numbers, damaged as scans damage them, and sound rows.
LINES = f"""
select l_orderkey as doc, cast(1 + l_partkey % 5 as int) as page, l_linenumber as line_no,
  case when l_orderkey % 3 = 0 then 'Run ' || translate({text('100 + l_partkey % 900')} || ' ' || {text('l_suppkey % 90')} || '.' || {text('l_partkey % 10')}, '0158', 'OlSB') || ' ' || {text('l_partkey % 77')} || ' 0' || {text('10 + l_suppkey % 80')}
       when l_orderkey % 3 = 1 then {text('200 + l_partkey % 100')} || ' 1O.' || {text('l_partkey % 10')} || ' ' || {text('l_suppkey % 99')} || '.5 12.1 13.2 14.3 2SS'
       else 'The catalyst Mg3Al1O was calcined, see US 8,318,989 B2 and Table 1B' end as line
from lineitem"""


def read(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """A test table. With ``spread``, one in fewer files than there are cores is dealt out to all of them first:
    a test table is one file of one row group, which is one task, and the work on a row may be long."""
    x = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return x.repartition(cores) if spread and len(x.inputFiles()) < cores else x


def register(spark: SparkSession, sf_dir: str, *tables: str, spread: bool = False) -> None:
    for t in tables:
        read(spark, sf_dir, t, spread).createOrReplaceTempView(t)


def rows(spark: SparkSession, sf_dir: str, sql: str, *tables: str, spread: bool = False) -> DataFrame:
    register(spark, sf_dir, *tables, spread=spread)
    return spark.sql(sql)
