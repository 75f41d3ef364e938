"""DuckDB SQL that the queries are held against, written from the definitions, not from the plans."""

from __future__ import annotations

from .functions import fidelity, segments
from .functions.text import WS
from .functions.units import KPA
from .inputs import CANONICAL, CATALYSTS, PREDS, SPELLINGS, TRUTH
from .schema import ALL_COLS, DIMENSIONS, PLAIN_TOLERANCE, SCORE_COLS, TOLERANCES, Protocol

NUM = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
RANGE = rf"(?i)^({NUM})\s*(?:-|to|~|±|\.\.\.|\.\.)\s*({NUM})\s*(.*)$"
SINGLE = rf"^({NUM})\s*(.*)$"


def quantity(x: str, dimension: str | None) -> str:
    """SQL for {lo, hi} of a text expression, or null."""
    s = f"translate(trim({x}, chr(9) || chr(10) || chr(13) || ' '), '‐‑‒–—―−', '-------')"
    ranged = f"regexp_matches({s}, '{RANGE}')"
    part = lambda r, one: f"case when {ranged} then regexp_extract({s}, '{RANGE}', {r}) else regexp_extract({s}, '{SINGLE}', {one}) end"
    unit = f"trim(regexp_replace(lower(regexp_extract(trim({part(3, 2)}), '^(\\S+)', 1)), '[°º∘˚℃℉\\s._]', '', 'g'), '%')"
    conv = {
        None: lambda v: v,
        "pressure": lambda v: f"case u when '' then {v} " + " ".join(f"when '{k}' then {v} * {f!r}::double" for k, f in KPA.items()) + " end",
        "temperature": lambda v: (
            f"case when u in ('', 'k', 'degk', 'kelvin') then {v} when u in ('c', 'degc', 'celsius', 'centigrade') then {v} + 273.15::double "
            f"when u in ('f', 'degf', 'fahrenheit') then ({v} - 32.0::double) * 5.0::double / 9.0::double + 273.15::double end"
        ),
    }[dimension]
    lo, hi = conv("a"), conv("b")
    return f"""(select case when {x} is null or lower({s}) in ('', 'none', 'null', 'n/a', 'na', '-', '—', 'nan') or {lo} is null or {hi} is null then null
      else {{'lo': least({lo}, {hi}), 'hi': greatest({lo}, {hi})}} end
      from (select try_cast({part(1, 1)} as double) as a, try_cast({part(2, 1)} as double) as b, {unit} as u))"""


def kind_of(p: str, t: str, mode: str, tol: str) -> str:
    pad = lambda lo, hi: f"(case when {mode} = 'abs' then {tol} else {tol} * greatest(abs({lo}), abs({hi}), 1e-9::double) end)"
    near = lambda v, r: f"abs({v} - {r}) <= {pad(r, r)}"
    inside = lambda r, x: f"{x}.lo >= {r}.lo - {pad(f'{r}.lo', f'{r}.hi')} and {x}.lo <= {r}.hi + {pad(f'{r}.lo', f'{r}.hi')}"
    return f"""case when {p} is null or {t} is null then 'no_parse'
      when {p}.lo <> {p}.hi and {t}.lo <> {t}.hi then case when {near(f'{p}.lo', f'{t}.lo')} and {near(f'{p}.hi', f'{t}.hi')} then 'exact' else 'miss' end
      when {p}.lo = {p}.hi and {t}.lo = {t}.hi then case when {near(f'{p}.lo', f'{t}.lo')} then 'exact' else 'miss' end
      when {p}.lo <> {p}.hi then case when {inside(p, t)} then 'range' else 'miss' end
      else case when {inside(t, p)} then 'range' else 'miss' end end"""


def norm(x: str) -> str:
    return f"case when lower({x}) in ('null', 'none', '') then null else replace(replace(replace(replace(lower(trim({x})), ' ', ''), ',', '.'), '/ac', '/c'), 'mgo/ac', 'mgo/c') end"


def empty(x: str) -> str:
    return f"({x} is null or lower(trim({x})) in ('', 'none', 'null', 'nan', 'n/a'))"


def material(x: str) -> str:
    known = {n: c for names in (CATALYSTS, SPELLINGS) for n, c in zip(names, CANONICAL, strict=True)}
    return f"case {x} " + " ".join(f"when '{n}' then '{c}'" for n, c in known.items()) + " end"


def _side(rows: str, ord_: str, extra: str) -> str:
    cols = []
    for c in ALL_COLS:
        cols += [f"{norm(c)} as {c}_s", f"{empty(c)} as {c}_e"]
        if c in TOLERANCES:
            cols += [f"{quantity(c, DIMENSIONS.get(c))} as {c}_q", f"try_cast(rtrim({norm(c)}, '%') as double) as {c}_n"]
    return f"select {extra} {ord_}, {material('catalyst')} as c3, {', '.join(cols)} from ({rows})"


def cell(c: str) -> str:
    """The kind of a cell; p and t are sides, k the protocol."""
    same = f"case when p.{c}_s = t.{c}_s then 'exact' else 'miss' end"
    out = f"when p.{c}_s is null and t.{c}_s is null then 'exact' when p.{c}_s is null or t.{c}_s is null then 'miss'"
    if c not in TOLERANCES:
        return f"case {out} else {same} end"
    mode, tol = TOLERANCES[c]
    m, w = f"(case when k.own_tolerance then '{mode}' else '{PLAIN_TOLERANCE[0]}' end)", f"(case when k.own_tolerance then {tol}::double else {PLAIN_TOLERANCE[1]}::double end)"
    q = kind_of(f"p.{c}_q", f"t.{c}_q", m, w)
    near = f"case when {m} = 'abs' then abs(p.{c}_n - t.{c}_n) <= {w} else abs(p.{c}_n - t.{c}_n) / greatest(abs(t.{c}_n), 1e-9::double) <= {w} end"
    plain = f"case when p.{c}_n is null or t.{c}_n is null then {same} when {near} then 'exact' else 'miss' end"
    return f"case {out} when not k.in_units then {plain} else (case when ({q}) = 'no_parse' or (({q}) = 'range' and not k.in_ranges) then {same} else {q} end) end"


def scoring(protocols: list[Protocol], tail: str, preds: str = PREDS, truth: str = TRUTH, shown: dict[str, str] | None = None) -> str:
    """Common tables for scoring under ``protocols``; ``tail`` selects from cells, matched, truth, pred. ``shown``: conditions
    on pred_ord under which a column's value stands in the text; elsewhere its miss is one of a figure."""
    shown = shown or {}
    b = lambda v: "true" if v else "false"
    table = ", ".join(
        f"('{p.name}', {i}, {b('own_tolerance' in p)}, {b('units' in p)}, {b('ranges' in p)}, {p.floor}, {b('surplus' in p)}, {b('no_paper' not in p)}, {b('composition_cells' in p)}, {b('composition_gate' in p)})"
        for i, p in enumerate(protocols)
    )
    kinds = ", ".join(f"{cell(c)} as {c}_k" for c in ALL_COLS)
    informed = " + ".join(f"(case when {c}_k <> 'miss' and not {c}_pe and not {c}_te then 1 else 0 end)" for c in SCORE_COLS)
    loose = " + ".join(f"(case when {c}_k <> 'miss' then 1 else 0 end)" for c in SCORE_COLS) + " + (case when paper_counts and paper_k <> 'miss' then 1 else 0 end)"
    flags = ", ".join(f"p.{c}_e as {c}_pe, t.{c}_e as {c}_te" for c in ALL_COLS)
    outcome = lambda c: (
        f"case when pred_ord is null then (case when not {c}_te then 'fn' end) when {c}_pe and {c}_te then null when {c}_te then 'fp' when {c}_pe then case when {shown.get(c, 'true')} then 'fn' else 'fn_fig' end else "
        + (f"(case when by_composition then (case when pc3 = tc3 then 'exact' else 'miss' end) else {c}_k end)" if c == "catalyst" else f"{c}_k")
        + " end"
    )
    own = " union all ".join(
        f"select paper, version, rep, protocol, 'gt' as side, gt_ord, pred_ord, '{c}' as \"column\", {outcome(c)} as outcome from matched_cells" + (" where paper_counts" if c == "paper" else "") for c in ALL_COLS
    )
    more = " union all ".join(
        f"select paper, version, rep, protocol, 'pred', null, pred_ord, '{c}', case when not {c}_e then 'fp_un' end from surplus" + (" where paper_counts" if c == "paper" else "") for c in ALL_COLS
    )
    return f"""
with recursive k(protocol, step, own_tolerance, in_units, in_ranges, least, surplus_counts, paper_counts, by_composition, gated) as (values {table}),
truth as materialized ({_side(truth, 'gt_ord', 'paper,')}),
pred as materialized ({_side(preds, 'pred_ord', 'paper, version, rep,')}),
pairs0 as materialized (
  select p.paper, p.version, p.rep, k.*, t.gt_ord, p.pred_ord, p.c3 as pc3, t.c3 as tc3, {kinds}, {flags}
  from pred p join truth t using (paper), k
), pairs as materialized (
  select paper, version, rep, protocol, least, gt_ord, pred_ord,
    case when gated and pc3 <> tc3 then -1 when least <= 0 then {loose} else {informed} end as score
  from pairs0
), lists as (
  select paper, version, rep, protocol, gt_ord, greatest(least, 0) as floor,
    list({{'s': -score, 'p': pred_ord}} order by -score, pred_ord) as cells
  from pairs group by all
), m as materialized (
  select paper, version, rep, protocol, floor, list(gt_ord order by gt_ord) as gts, list(cells order by gt_ord) as m from lists group by all
), walk(paper, version, rep, protocol, step, used) as (
  select paper, version, rep, protocol, 0, []::bigint[] from m
  union all
  select w.paper, w.version, w.rep, w.protocol, step + 1,
    list_append(used, coalesce(list_filter(m.m[step + 1], lambda x: -x.s >= floor and not list_contains(used, x.p))[1].p, -1))
  from walk w join m using (paper, version, rep, protocol) where step < len(m.m)
), matched as materialized (
  select * from (
    select w.paper, w.version, w.rep, w.protocol, unnest(m.gts) as gt_ord, unnest(w.used) as pred_ord
    from walk w join m using (paper, version, rep, protocol) where w.step = len(m.m)
  ) where pred_ord >= 0
), runs as (select distinct version, rep from pred),
grid as (select t.paper, r.version, r.rep, k.protocol, t.gt_ord from truth t, runs r, k),
chosen as (select g.*, x.pred_ord from grid g left join matched x using (paper, version, rep, protocol, gt_ord)),
matched_cells as materialized (
  select c.paper, c.version, c.rep, k.*, c.gt_ord, c.pred_ord, p.c3 as pc3, t.c3 as tc3, {kinds}, {flags}
  from chosen c join truth t using (paper, gt_ord) join k on k.protocol = c.protocol
  left join pred p on p.paper = c.paper and p.version = c.version and p.rep = c.rep and p.pred_ord = c.pred_ord
), surplus as (
  select p.*, k.protocol, k.paper_counts from pred p, k where k.surplus_counts and not exists (
    select 1 from matched x where x.paper = p.paper and x.version = p.version and x.rep = p.rep and x.pred_ord = p.pred_ord and x.protocol = k.protocol)
), outcomes as (
  {own} union all {more}
), cells as materialized (
  select *, cast(coalesce(outcome in ('exact', 'range'), false) as bigint) as tp, cast(coalesce(outcome = 'range', false) as bigint) as tp_rng,
    cast(coalesce(outcome in ('fp', 'miss', 'fp_un'), false) as bigint) as fp, cast(coalesce(outcome = 'fp_un', false) as bigint) as fp_un,
    cast(coalesce(outcome in ('fn', 'fn_fig', 'miss'), false) as bigint) as fn, cast(coalesce(outcome = 'fn_fig', false) as bigint) as fn_fig
  from outcomes
)
{tail}"""


SUMS = "cast(sum(tp) as bigint) as tp, cast(sum(tp_rng) as bigint) as tp_rng, cast(sum(fp) as bigint) as fp, cast(sum(fp_un) as bigint) as fp_un, cast(sum(fn) as bigint) as fn"
P = "sum(tp)::double / nullif(sum(tp) + sum(fp), 0)"
R = "sum(tp)::double / nullif(sum(tp) + sum(fn), 0)"
F1 = f"case when ({P}) + ({R}) = 0 then 0.0 else 2 * ({P}) * ({R}) / (({P}) + ({R})) end"
PRF = f"round({P}, 6) as p, round({R}, 6) as r, round({F1}, 6) as f1"


# ── Lines of documents ───────────────────────────────────────────────────────

SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NO_SPACE = SPACE.replace("[", "[^", 1)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_quoted(pattern)})"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(_quoted(v) for v in values)


def _element(x: str) -> str:
    # Whether there is a match doesn't depend on looking ahead instead of taking.
    return "(" + " or ".join(_has(x, p.replace("(?=", "(?:")) for p in (fidelity.ELEMENT_2, fidelity.ELEMENT_1)) + ")"


def damaged_lines(source: str, keys: str) -> str:
    """Common tables up to ``damaged``: keys, line, kind, tk (tokens), cores, clean, places (from 1)."""
    core = "cores[i]"
    candidate = f"""{core} <> '' and (length({core}) > 1 or {core} = 'O') and upper({core}) not in ({_listed(fidelity.CHEMICAL + fidelity.LEXICAL)})
      and not {_has(core, fidelity.CPC)} and not ({_has(core, fidelity.IDENTIFIER)} and not {_has(core, '[.,]')} and length(regexp_replace({core}, '[^0-9]', '', 'g')) >= 2)
      and not {_has(core, fidelity.INITIAL)} and {_has(core, '[OSlIBG]')} and {_has(core, fidelity.SHAPE)} and {_has(f"translate({core}, 'OSlIBG', '051186')", fidelity.CLEAN)}"""
    before = f"list_filter(list_reverse(list_filter(cores[1:i - 1], lambda c: c <> ''))[1:4], lambda c: not {_has('c', fidelity.SUBSCRIPT)})[1]"
    oxygen = f"contains({core}, 'O') and (coalesce({_element('cores[i + 1]')}, false) or coalesce({_element(before)}, false))"
    number = lambda j: f"(coalesce(clean[{j}], false) or list_contains(found, {j}))"
    real = f"""not (not data and {_has(core, fidelity.PANEL)}) and not ({oxygen})
      and case when not {_has(core, '[0-9.,]')} then data and ((i > 1 and {number('i - 1')}) or {number('i + 1')}) else not formula end"""
    cited = " or ".join(_has("line", p) for p in fidelity.CITATION)
    return f"""with l1 as (select {keys}, line, list_filter(string_split_regex(line, '{SPACE}+'), lambda x: x <> '') as tk from ({source})),
l2 as materialized (select *, list_transform(tk, lambda x: trim(x, {_quoted(fidelity.EDGES)})) as cores from l1),
l3 as materialized (select *, list_transform(cores, lambda c: {_has('c', fidelity.CLEAN)}) as clean, list_filter(range(1, len(cores) + 1), lambda i: {candidate}) as found from l2),
l4 as (select *, len(list_filter(clean, lambda c: c)) as n_clean from l3),
l5 as (select *, n_clean >= 1 and n_clean + len(found) >= 3 and (n_clean + len(found)) / len(tk) >= 0.5 as data from l4 where len(found) > 0),
l6 as (select *, {_has('line', fidelity.FORMULA)} and not data as formula from l5),
l7 as (select *, list_filter(found, lambda i: {real}) as places from l6),
damaged as materialized (select *, case when {cited} then 'CITATION' when data then 'DATA' else 'PROSE' end as kind,
  list_transform(places, lambda i: tk[i]) as suspects, list_transform(places, lambda i: translate(cores[i], 'OSlIBG', '051186')) as repaired
  from l7 where len(places) > 0)"""


def edited_lines(source: str, keys: str, consensus: bool) -> str:
    """``damaged_lines`` and edits (keys, kind, line, n, i, before, after, tier) and fixed (keys, fixed)."""
    same = "v is not null and len(v) >= 4 and list_bool_and(list_transform(v, lambda t: coalesce(try_cast(regexp_replace(t, '[.,;:%)]+$', '') as double) < 100, false))) and len(list_filter(v, lambda t: regexp_matches(t, '^\\d{1,2}\\.\\d$'))) / len(v) >= 0.6"
    names = ", ".join(k.split(" as ")[-1].strip() for k in keys.split(","))
    return f"""{damaged_lines(source, keys)},
m1 as (select *, list_transform(list_filter(range(2, len(tk) + 1), lambda i: not list_contains(places, i) and clean[i]), lambda i: cores[i]) as v from damaged where kind = 'DATA'),
m2 as (select *, {same if consensus else 'false'} as agreed from m1),
m3 as (select *, unnest(places) as i from m2),
m4 as (select *, cores[i] as core, translate(cores[i], 'OSlIBG', '051186') as t1 from m3),
m5 as (select *, case when regexp_matches(t1, '^0\\d{{1,4}}$') then '0.' || substr(t1, 2) end as d1, case when i > 1 and agreed and regexp_matches(t1, '^[1-9]\\d{{2}}$') then t1[1:2] || '.' || t1[3] end as d2 from m4),
edits as materialized (select {names}, kind, line, i, tk[i] as before, row_number() over (partition by {names} order by i) - 1 as n,
  substr(tk[i], 1, strpos(tk[i], core) - 1) || coalesce(d1, d2, t1) || substr(tk[i], strpos(tk[i], core) + length(core)) as after,
  case when d1 is not null then 'D1' when d2 is not null then 'D2' else 'T1' end as tier from m5 where coalesce(d1, d2, t1) <> core),
m6 as (select {names}, any_value(line) as line, map_from_entries(list((i, after))) as news from edits group by {names}),
m7 as (select *, string_split_regex(line, '{NO_SPACE}+') as gaps, list_filter(string_split_regex(line, '{SPACE}+'), lambda x: x <> '') as tk from m6),
fixed as materialized (select {names}, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(news[i], tk[i], '')), '') as fixed from m7)"""


def _number_count(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{SPACE}+'), lambda x: {_has(f'trim(x, {_quoted(fidelity.EDGES)})', fidelity.CLEAN)}))"


def numbered(source: str) -> str:
    return f"select row_number() over () as uid, * from ({source})"


def coverage(source: str, by: str) -> str:
    return f"""with src as materialized ({numbered(source)}), {edited_lines('select * from src', 'uid', False).removeprefix('with ')},
n1 as (select s.*, k.kind, coalesce(f.fixed, s.line) as fixed, coalesce(e.n, 0) as n_edits from src s left join damaged k using (uid) left join fixed f using (uid)
  left join (select uid, count(*) as n from edits group by uid) e using (uid)),
n2 as (select *, len(list_filter(string_split_regex(line, '{SPACE}+'), lambda x: x <> '')) as n_tokens, {_number_count('line')} as n_ok, {_number_count('fixed')} as n_after from n1),
n3 as (select {by}, cast(coalesce(sum(n_ok) filter (d), 0) as bigint) as parseable_before, cast(coalesce(sum(n_after) filter (d), 0) as bigint) as parseable_after,
  cast(coalesce(sum(n_tokens) filter (d), 0) as bigint) as data_tokens_total, cast(sum(n_edits) as bigint) as tokens_modified
  from (select *, coalesce(kind = 'DATA', false) or (n_tokens >= 4 and n_ok >= 3) as d from n2) group by {by})
select *, parseable_after - parseable_before as rescued, round(coalesce(100.0::double * parseable_before / nullif(data_tokens_total, 0), 0), 2) as coverage_before_pct,
  round(coalesce(100.0::double * parseable_after / nullif(data_tokens_total, 0), 0), 2) as coverage_after_pct from n3"""


CHARS = f"""select doc, char, count(*) as n from (select doc, unnest(string_split(trim(s, {_quoted(fidelity.EDGES)}), '')) as char from (select doc, unnest(suspects) as s from damaged))
where char in ('O', 'S', 'l', 'I', 'B', 'G') group by doc, char"""

REPORT = f"""{damaged_lines("select doc_id as doc, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents where doc_id is not null", 'doc')},
s as (select doc, count(*) as lines, sum(len(suspects)) as n, count(*) filter (kind = 'DATA') as ld, count(*) filter (kind = 'CITATION') as lc, count(*) filter (kind = 'PROSE') as lp,
  sum(len(suspects)) filter (kind = 'DATA') as sd, sum(len(suspects)) filter (kind = 'CITATION') as sc, sum(len(suspects)) filter (kind = 'PROSE') as sp from damaged group by doc),
d as (select doc_id as doc, count(*) as pages, sum(length(coalesce(text, ''))) as n_chars, sum(len(regexp_extract_all(coalesce(text, ''), '(?i)\\bexamples?\\b'))) as n_kw,
  case when sum(length(text)) is null then null when doc_id % 2 = 0 then 0.0 else 1.0 end as subset, least(1.0, max((doc_id % 5) / 3.0)) as cover,
  case when doc_id % 2 = 0 then 'Courier' else 'ABCDEF+Times' end as font from documents where doc_id is not null group by doc_id),
x as (select d.*, s.*exclude(doc), round(coalesce(1000.0 * coalesce(n, 0) / nullif(n_chars, 0), 0), 3) as density from d left join s using (doc))
select doc, pages, cast(n_chars as bigint) as n_chars, cast(n_kw as bigint) as n_example_kw, coalesce(lines, 0) as n_suspect_lines, cast(coalesce(n, 0) as bigint) as n_suspect_tokens,
  coalesce(ld, 0) as lines_data, coalesce(lc, 0) as lines_citation, coalesce(lp, 0) as lines_prose, cast(coalesce(sd, 0) as bigint) as suspects_in_data,
  cast(coalesce(sc, 0) as bigint) as suspects_in_citation, cast(coalesce(sp, 0) as bigint) as suspects_in_prose, density as corruption_per_1k,
  cast(subset as double) as subset_font_frac, cast(1 as bigint) as n_distinct_fonts, [font] as fonts, cast(round(cover, 3) as double) as page_image_cover,
  case when doc % 2 = 0 and cover > 0.8 then case when density >= 0.5 then 'SCANNED_OCR' else 'SCANNED_OCR (clean)' end when density >= 0.5 then 'NATIVE (corruption flagged)' else 'NATIVE_TEXT' end as verdict
from x"""


# ── Sections and chunks ──────────────────────────────────────────────────────

_STRIP = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_HEAD = _quoted(segments.HEADING.replace("(?mdi)", "(?mi)"))
_TAIL = _quoted(segments.TAIL.replace("(?md)", "(?m)").replace(WS, SPACE))


def sections(text: str, source: str, keys: str) -> str:
    """Common tables up to ``sections``: keys, k (place among the headings), kind, heading, body."""
    return f"""h as (select {keys}, regexp_extract_all({text}, {_HEAD}, 2) as names, string_split_regex({text}, {_HEAD}) as parts from ({source})),
h2 as (select {keys}, unnest(range(1, len(names) + 1)) as k, names, parts from h where len(names) >= 2),
h3 as (select {keys}, k, lower(names[k]) as name, trim(names[k], {_STRIP}) as heading, trim(parts[k + 1], {_STRIP}) as body from h2),
h4 as (select *, case when regexp_matches(name, 'method|experimental|material') then 'methods' when regexp_matches(name, 'result|discussion|conclusion') then 'results'
  when regexp_matches(name, 'abstract|introduction') then 'front' else 'back' end as first from h3 where body <> ''),
sections as (select {keys}, k, case when first = 'front' and length(body) > {segments.FRONT_MAX} then 'results' else first end as kind, heading, body from h4)"""


def packed(x: str, size: int) -> str:
    """Pages of a text expression in chunks, as a fold over what stands between page markers."""
    fold = f"""list_reduce(list_transform(string_split({x}, '[Page '), lambda e: {{'cur': e, 'done': []::varchar[]}}),
      lambda s, e: case when length(s.cur) + length(e.cur) < {size} then {{'cur': s.cur || case when e.cur <> '' then '[Page ' || e.cur else '' end, 'done': s.done}}
        else {{'cur': '[Page ' || e.cur, 'done': case when s.cur = '' then s.done else list_append(s.done, s.cur) end}} end, {{'cur': '', 'done': []::varchar[]}})"""
    return f"(select case when length(t) <= {size} then [t] else (select case when r.cur <> '' then list_append(r.done, r.cur) else r.done end from (select {fold.replace(x, 't')} as r)) end from (select {x} as t))"


def chunked(source: str, size: int) -> str:
    """Chunks of even documents by section, of odd ones by page; their texts hold no table markers."""
    kinds = " union all ".join(
        f"select doc_id, {i} as part, {packed(f'(trim(body, {_STRIP}))', size)} as c, '{k}' as name from (select doc_id, string_agg(body, chr(10) || chr(10) order by k) as body from sections where kind = '{k}' group by doc_id)"
        for i, k in enumerate(segments.KINDS)
    )
    return f"""with src as materialized (select doc_id, text from ({source})),
bodies as materialized (select doc_id, text, case when len(string_split_regex(text, {_TAIL})) > 1 and length(string_split_regex(text, {_TAIL})[1]) > length(text) * 0.2
  then string_split_regex(text, {_TAIL})[1] else text end as body from src),
{sections('body', 'select * from bodies where doc_id % 2 = 0', 'doc_id')},
own as materialized ({kinds}),
lists as (select * from own union all select doc_id, 0, {packed('body', size)}, 'body' from bodies where doc_id % 2 = 0 and doc_id not in (select doc_id from own)
  union all select doc_id, 0, {packed('text', size)}, 'chars' from bodies where doc_id % 2 <> 0),
flat as (select doc_id, part, name, c, unnest(range(1, len(c) + 1)) as i from lists)
select doc_id, cast(row_number() over (partition by doc_id order by part, i) - 1 as int) as no,
  case when len(c) = 1 and name not in ('body', 'chars') then name else name || '[' || i || ']' end as label, cast(length(c[i]) as int) as n_chars from flat"""
