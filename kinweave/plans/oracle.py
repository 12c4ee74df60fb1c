"""DuckDB SQL for the queries of catalogue.py, written on its own terms."""

from __future__ import annotations

from kinweave.sources.roster import roster_sql, truth_sql

# Fixed values, written here once more so that a wrong entry in the library shows.
_NICK = (
    "BOB ROBERT,BILL WILLIAM,MIKE MICHAEL,RICK RICHARD,TOM THOMAS,JOE JOSEPH,DAN DANIEL,MATT MATTHEW,TONY ANTHONY,BEN BENJAMIN,NICK NICHOLAS,ALEX ALEXANDER,GREG GREGORY,TIM TIMOTHY,"
    "TED THEODORE,FRED FREDERICK,JON JONATHAN,CHARLIE CHARLES,CHRIS CHRISTOPHER,KATE KATHERINE,LIZ ELIZABETH,PEGGY MARGARET,JEN JENNIFER,PAT PATRICIA,DEBBIE DEBORAH,BARB BARBARA,"
    "SUE SUSAN,BECKY REBECCA,KIM KIMBERLY,STEPH STEPHANIE,VICKY VICTORIA,JESS JESSICA,CINDY CYNTHIA,SAM SAMANTHA,RONNIE VERONICA,CILLA PRISCILLA"
)
_ROAD = (
    "ST STREET,STR STREET,AVE AVENUE,AV AVENUE,RD ROAD,BLVD BOULEVARD,BOUL BOULEVARD,DR DRIVE,DRV DRIVE,LN LANE,PKWY PARKWAY,PKY PARKWAY,CT COURT,CRT COURT,PL PLACE,TER TERRACE,"
    "CIR CIRCLE,HWY HIGHWAY,N NORTH,S SOUTH,E EAST,W WEST"
)
NICKNAMES, STREET_WORDS = (dict(x.split() for x in table.split(",")) for table in (_NICK, _ROAD))

_FIELDS = ["npi", "given", "family", "street", "phone", "zip", "state", "specialty"]


def _case(column: str, table: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {column} end"


_SUITE = r"\s*(?:#|\bUNIT|\bAPT|\bSTE|\bSUITE)\s*[.]?\s*([-0-9A-Z]+)\s*$"
_RUNS = "translate(regexp_replace(upper(family), '[^A-Z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
for _d in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"


def _soundex(column: str) -> str:
    letters = f"regexp_replace(upper({column}), '[^A-Z]', '', 'g')"
    return f"case when {letters} <> '' then substr(concat(substr({letters}, 1, 1), replace(substr({_RUNS.replace('family', column)}, 2), '0', ''), '000'), 1, 4) end"


NORM = f"""roster as ({roster_sql('duckdb')}),
n1 as (select *, trim(regexp_replace(regexp_replace(trim(regexp_split_to_array(name_raw, '\\s+and\\s+')[1]), '(?i)[,\\s]+(M\\.?D|D\\.?O|N\\.?P|P\\.?A|Ph\\.?D)\\.?\\s*$', ''), '(?i)^(Dr|Doctor|Prof)\\.?\\s+', '')) as bare,
  regexp_replace(npi, '[^0-9]', '', 'g') as npi_d, regexp_replace(phone, '[^0-9]', '', 'g') as phone_d, regexp_replace(zip, '[^0-9]', '', 'g') as zip_d from roster),
n2 as (select *, regexp_split_to_array(bare, '\\s+') as words, case when length(phone_d) = 11 and phone_d[1] = '1' then substr(phone_d, 2) else phone_d end as phone_e from n1),
n3 as (select source_system, source_row_id, entity_id, ingest_batch, observed_at, multi, moved, network_status, specialty,
  nullif(upper(replace(regexp_extract(trim(regexp_split_to_array(name_raw, '\\s+and\\s+')[1]), '(?i)[,\\s]+(M\\.?D|D\\.?O|N\\.?P|P\\.?A|Ph\\.?D)\\.?\\s*$', 1), '.', '')), '') as credential,
  case when length(npi_d) = 10 then npi_d end as npi, case when length(phone_e) = 10 then phone_e end as phone, case when length(zip_d) >= 5 then zip_d[1:5] end as zip,
  case when regexp_full_match(upper(trim(state)), '[A-Z][A-Z]') then upper(trim(state)) end as state, upper(trim(city)) as city,
  case when source_system = 'payer_feed' then case when contains(bare, ',') then upper(nullif(trim(substr(bare, instr(bare, ',') + 1)), '')) end when len(words) >= 2 then upper(words[1]) end as given,
  case when source_system = 'payer_feed' then case when contains(bare, ',') then upper(nullif(trim(substr(bare, 1, instr(bare, ',') - 1)), '')) end when len(words) >= 2 then upper(words[-1]) end as family,
  coalesce(list_transform(list_filter(string_split(regexp_replace(regexp_replace(upper(street), '{_SUITE}', ''), '[^A-Z0-9 ]', ' ', 'g'), ' '), lambda x: x <> ''), lambda x: {_case('x', STREET_WORDS)}), []) as tokens,
  coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(upper(suite), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '\\b(STE|APT|UNIT)\\b', 'SUITE', 'g'), ''), 'SUITE ' || nullif(regexp_extract(upper(street), '{_SUITE}', 1), '')) as suite from n2),
nrow as (select *, family[1:4] as surname4, {_soundex('family')} as family_soundex from n3)"""

_ORDER = "(a.source_system, a.source_row_id) < (b.source_system, b.source_row_id)"
_KEYS = {"npi_exact": "a.npi = b.npi", "zip_surname4": "a.zip = b.zip and a.surname4 = b.surname4", "soundex_state": "a.family_soundex = b.family_soundex and a.state = b.state", "phone_exact": "a.phone = b.phone"}
_PAIR = "a.source_system as a_sys, a.source_row_id as a_id, b.source_system as b_sys, b.source_row_id as b_id"


def _pairs(condition: str) -> str:
    return f"select {_PAIR} from nrow a join nrow b on ({condition}) and {_ORDER}"


_EVERY = _pairs(" or ".join(f"({c})" for c in _KEYS.values()))


def _exact(f: str) -> str:
    return f"case when a.{f} is null or b.{f} is null then 'missing' when a.{f} = b.{f} then 'agree' else 'disagree' end as {f}"


_JW = "(case when {x} = {y} then 1.0::double else jaro_winkler_similarity({x}, {y}) end)"
_GIVEN = f"greatest({_JW.format(x='a.given', y='b.given')}, {_JW.format(x=_case('a.given', NICKNAMES), y=_case('b.given', NICKNAMES))})"
_FAMILY = _JW.format(x="a.family", y="b.family")
_TOKENS = "(len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(list_concat(a.tokens, b.tokens))))"
VECTORS = f"""{NORM}, vec as (select {_PAIR}, {_exact('npi')},
  case when a.given is null or b.given is null then 'missing' when {_GIVEN} >= 0.95::double then 'agree' when {_GIVEN} >= 0.85::double then 'partial' else 'disagree' end as given,
  case when a.family is null or b.family is null then 'missing' when {_FAMILY} >= 0.95::double then 'agree' when {_FAMILY} >= 0.88::double then 'partial' else 'disagree' end as family,
  case when len(a.tokens) = 0 or len(b.tokens) = 0 then 'missing' when {_TOKENS} >= 0.85::double then 'agree' when {_TOKENS} >= 0.5::double then 'partial' else 'disagree' end as street,
  {_exact('phone')}, {_exact('zip')}, {_exact('state')}, {_exact('specialty')}, a.entity_id = b.entity_id as is_match, least(a.entity_id, b.entity_id) as entity, (a.multi or b.multi) as multi,
  greatest(a.ingest_batch, b.ingest_batch) as batch from nrow a join nrow b on ({' or '.join(f'({c})' for c in _KEYS.values())}) and {_ORDER})"""

_CELLS = " union all ".join(f"select '{f}' as field, {f} as level, is_match from vec where entity % 2 = 1" for f in _FIELDS)
WEIGHTS = f"""{VECTORS}, cells as ({_CELLS}),
grid as (select * from (select unnest({_FIELDS}) as field), (select unnest(['agree', 'partial', 'disagree', 'missing']) as level)),
total as (select count(*) filter (is_match) as nm, count(*) filter (not is_match) as nu from vec where entity % 2 = 1),
weight as (select g.field, g.level, count(*) filter (c.is_match) as m, count(*) filter (not c.is_match) as u, any_value(nm) as nm, any_value(nu) as nu from grid g cross join total left join cells c on c.field = g.field and c.level = g.level group by 1, 2),
w as (select field, level, m, u, round(log2(((m + 0.5::double) / (nm + 2)) / ((u + 0.5::double) / (nu + 2))), 4) as weight from weight)"""
SCORES = f"{WEIGHTS}, sc as (select v.*, round({' + '.join(f'w_{f}.weight' for f in _FIELDS)}, 4) as score from vec v " + " ".join(f"join w w_{f} on w_{f}.field = '{f}' and w_{f}.level = v.{f}" for f in _FIELDS) + ")"
CURVE = f"""{SCORES}, ev as (select score, is_match from sc where entity % 2 = 0), ends as (select min(score) as lo, max(score) as hi from ev),
tot as (select coalesce(sum(k * (k - 1) // 2), 0)::bigint as total from (select count(*) as k from nrow where entity_id % 2 = 0 group by entity_id)),
raw as (select i, lo + (hi - lo) * i / 200 as th from range(201) t(i), ends),
cnt as (select i, th, (select count(*) from ev where score >= th and is_match) as tp, (select count(*) from ev where score >= th and not is_match) as fp, (select total from tot) as total from raw),
pr as (select *, total - tp as fn, case when tp + fp = 0 then 1.0::double else tp::double / (tp + fp) end as p, case when total = 0 then 0.0::double else tp::double / total end as r from cnt),
curve as (select round(th, 3) as threshold, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end, 6) as f1 from pr),
opt as (select ratio, threshold, cost from (select ratio, threshold, ratio * fp + fn as cost, row_number() over (partition by ratio order by ratio * fp + fn, threshold) as k from curve, (select unnest([1, 3, 10, 30])::bigint as ratio)) where k = 1)"""


def _run(n: int) -> str:
    return f"""nodes{n} as (select concat(source_system, '/', lpad(source_row_id::varchar, 12, '0')) as node, source_system as sys, source_row_id as id, entity_id, moved from nrow where ingest_batch <= {n}),
edge{n} as (select concat(a_sys, '/', lpad(a_id::varchar, 12, '0')) as x, concat(b_sys, '/', lpad(b_id::varchar, 12, '0')) as y from sc where score >= 8.0 and batch <= {n}),
both{n} as (select x, y from edge{n} union all select y, x from edge{n}),
walk{n}(node, seen) as (select node, node from nodes{n} union select w.node, e.y from walk{n} w join both{n} e on e.x = w.seen),
comp{n} as (select n.sys, n.id, n.entity_id, n.moved, c.component, dense_rank() over (order by c.component) as cluster_id from nodes{n} n join (select node, min(seen) as component from walk{n} group by node) c using (node))"""


RUNS = f"{SCORES}, {_run(1)}, {_run(2)}".replace("with ", "with ")
_KEY4 = "a_sys, a_id, b_sys, b_id"
BUILT = f"""{RUNS}, made as (
  select 'split' as kind, * from (select {_KEY4} from sc where batch = 1 and score >= 8.0 and not is_match order by {_KEY4} limit 200)
  union all select 'merge', * from (select {_KEY4} from sc where batch = 1 and score < 8.0 and is_match order by {_KEY4} limit 200)
  union all select 'pin', * from (select sys, id, null::varchar, null::int from comp1 where sys = 'clearinghouse' and moved order by sys, id limit 100)),
built as (select kind, {_KEY4}, cluster_id as created_id from made join comp1 on sys = a_sys and id = a_id)"""
_EV = "ev as (select user_id, case when floor(value)::bigint % 7 <> 0 then floor(value)::bigint % 7 end as value, event_type as source, event_id as key, ts as seen from events), told as (select * from ev where value is not null)"
_RANK = "case source when 'purchase' then 0 when 'signup' then 1 when 'click' then 2 end"


def _winner(order: str, rows: str = "told") -> str:
    return f"select user_id, value, key as event_id from (select *, row_number() over (partition by user_id order by {order}) as k from {rows}) where k = 1"


_PRIORITY = _winner(f"({_RANK}) is null, ({_RANK}), case when ({_RANK}) is not null then seen end desc, case when ({_RANK}) is not null then key end, seen desc, source desc, key desc")
_ALL4, _MAIL = "clearinghouse payer_feed license_board site_scrape", "payer_feed site_scrape clearinghouse"
_GOLD = {
    "npi": _ALL4, "given": "license_board payer_feed clearinghouse site_scrape", "family": "license_board site_scrape payer_feed clearinghouse", "credential": "license_board payer_feed clearinghouse",
    "street": _MAIL, "suite": _MAIL, "city": _MAIL, "state": "license_board site_scrape clearinghouse payer_feed", "zip": _MAIL, "phone": _MAIL,
    "specialty": "license_board payer_feed clearinghouse site_scrape", "network_status": "payer_feed",
}
_LONG = " union all ".join(f"select c.component, e.entity, '{f}' as field, {'nullif(array_to_string(n.tokens, chr(32)), chr(0))' if f == 'street' else 'n.' + f} as value, n.source_system as source, n.source_row_id::bigint as key, n.observed_at as seen from comp2 c join sound e using (component) join nrow n on n.source_system = c.sys and n.source_row_id = c.id" for f in _GOLD)
GOLDEN = f"{RUNS}, sound as (select component, min(entity_id) as entity from comp2 group by component having count(distinct entity_id) = 1), long as (select * from ({_LONG}) where value is not null and value <> '')"
_SRANK = "case " + " ".join(f"when field = '{f}' and source = '{x}' then {i}" for f, xs in _GOLD.items() for i, x in enumerate(xs.split())) + " end"
_SORDER = f"({_SRANK}) is null, ({_SRANK}), case when ({_SRANK}) is not null then seen end desc, case when ({_SRANK}) is not null then key end, seen desc, source desc, key desc"


def _golden(order: str, name: str, rows: str = "long") -> str:
    return f"{name} as (select component, entity, field, value, source, key from (select *, row_number() over (partition by component, field order by {order}) as k from {rows}) where k = 1)"


_RULES = ", ".join([
    _golden("source, key", "g_first"), _golden("seen desc, source desc, key desc", "g_recent"), "votes as (select *, count(*) over (partition by component, field, value) as c from long)",
    _golden("c desc, seen desc, source desc, key desc", "g_majority", "votes"), _golden(_SORDER, "g_priority"),
])
_TRUTH = f"tr as ({truth_sql('duckdb')}), truth as (" + " union all ".join(f"select entity, '{f}' as field, {f} as truth from tr" for f in _GOLD) + ")"
_R4 = ("first", "recent", "majority", "priority")
_ACCURACY = (
    "two as (select distinct entity_id as entity from nrow group by source_system, entity_id having count(*) > 1), "
    "met as (select c.component, field, truth, c.entity not in (select entity from two) as one, " + ", ".join(f"g_{r}.value as {r}" for r in _R4) + " from (select distinct component, entity from long) c join truth using (entity) "
    + " ".join(f"left join (select component, field, value from g_{r}) g_{r} using (component, field)" for r in _R4) + "), acc as (select field, "
    + ", ".join(f"round(avg(({r} is not distinct from truth)::int), 6) as {r}, round(avg(({r} is not distinct from truth)::int) filter (one), 6) as {r}_single" for r in _R4)
    + ", count(*) as clusters, count(*) filter (one) as clusters_single from met group by field)"
)


def _with(prelude: str, body: str) -> str:
    return f"with recursive {prelude} {body}"


def _measure(name: str, pairs: str) -> str:
    return f"select '{name}' as strategy, count(*) as candidates, count(*) filter (x.entity_id = y.entity_id) as true_found from ({pairs}) p join nrow x on x.source_system = a_sys and x.source_row_id = a_id join nrow y on y.source_system = b_sys and y.source_row_id = b_id"


_NAMES = "names as (select distinct family from nrow where family is not null), np as (select x.family as a, y.family as b from names x join names y on x.family[1] = y.family[1] and x.family < y.family)"
_MEMBERS = "select component as name, cluster_id, string_agg(sys || '/' || id, '|' order by sys || '/' || id) as members from {c} group by 1, 2"

ORACLE: dict[str, str] = {
    "norm_identifiers": _with(NORM, "select source_system, source_row_id, npi, phone, zip, state from nrow"),
    "norm_name": _with(NORM, "select source_system, source_row_id, given, family from nrow"),
    "norm_street": _with(NORM, "select source_system, source_row_id, array_to_string(tokens, '|') as tokens, suite from nrow"),
    "key_soundex": _with(NORM, f"select name, {_soundex('name')} as code from (select family as name from nrow where family is not null union select upper(split_part(p_name, ' ', 1)) from part)"),
    "reach_by_source": _with(NORM, "select source_system, count(*) as n, count(npi) as with_npi, count(zip) as with_zip, count(family_soundex) as with_family_soundex, count(phone) as with_phone from nrow group by 1"),
    "true_pairs": _with(NORM, "select coalesce(sum(k * (k - 1) // 2), 0)::bigint as true_pairs from (select count(*) as k from nrow group by entity_id)"),
    "block_npi": _with(NORM, _pairs(_KEYS["npi_exact"])),
    "block_zip4": _with(NORM, _pairs(_KEYS["zip_surname4"])),
    "block_sdx_state": _with(NORM, _pairs(_KEYS["soundex_state"])),
    "block_phone": _with(NORM, _pairs(_KEYS["phone_exact"])),
    "block_union_distinct": _with(NORM, _EVERY),
    "block_quality": _with(
        NORM + ", m as (" + " union all ".join(_measure(n, _pairs(c)) for n, c in _KEYS.items()) + " union all " + _measure("union", _EVERY) + "), tp as (select sum(k * (k - 1) // 2) as t, sum(k) as n from (select count(*) as k from nrow group by entity_id))",
        "select strategy, candidates, true_found, round(true_found::double / t, 4) as completeness, round(1 - candidates::double / (n::double * (n - 1) / 2), 6) as reduction, round(case when candidates = 0 then 0.0::double else true_found::double / candidates end, 6) as precision from m, tp",
    ),
    "block_part": "select a.p_partkey as a, b.p_partkey as b from part a join part b on a.p_brand = b.p_brand and a.p_type = b.p_type and a.p_name[1:4] = b.p_name[1:4] and a.p_partkey < b.p_partkey",
    "incremental_probe": _with(NORM, "select i.source_row_id as new_id, n.source_system, n.source_row_id from (select * from nrow where source_system = 'clearinghouse' and npi is not null order by source_row_id limit 50) i join nrow n on n.npi = i.npi and n.source_system <> 'clearinghouse'"),
    "sim_jaro": _with(f"{NORM}, {_NAMES}", "select a, b, round(jaro_similarity(a, b), 6) as jaro from np"),
    "sim_jw_level": _with(f"{NORM}, {_NAMES}", "select a, b, case when jaro_winkler_similarity(a, b) >= 0.95::double then 'agree' when jaro_winkler_similarity(a, b) >= 0.88::double then 'partial' else 'disagree' end as level from np"),
    "sim_jaccard": "with p as (select distinct p_name, string_split(p_name, ' ') as t from part) select x.p_name as a, y.p_name as b, round(len(list_intersect(x.t, y.t))::double / len(list_distinct(list_concat(x.t, y.t))), 6) as jaccard from p x join p y on x.p_name < y.p_name and len(list_intersect(x.t, y.t)) > 0",
    "compare_vector": _with(VECTORS, f"select {_KEY4}, {', '.join(_FIELDS)} from vec"),
    "pattern_counts": _with(VECTORS, f"select {', '.join(_FIELDS)}, count(*) as pairs, count(*) filter (is_match) as matches from vec group by {', '.join(_FIELDS)}"),
    "fs_weights": _with(WEIGHTS, "select * from w"),
    "fs_scores": _with(SCORES, f"select {_KEY4}, score, is_match from sc"),
    "sweep_curve": _with(CURVE, "select threshold, tp, fp, fn, precision, recall, f1 from curve"),
    "cost_optima": _with(CURVE, "select ratio, threshold, cost from opt"),
    "review_band": _with(
        CURVE + ", mid as (select threshold as c from opt where ratio = 10), band as (select width, c - width * (hi - lo) / 2 as lower, c + width * (hi - lo) / 2 as upper from (select unnest([0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4])::double as width), mid, ends), bd as (select width, count(*) filter (score >= lower and score < upper) as queue, (10 * count(*) filter (score >= upper and not is_match) + (select total from tot) - count(*) filter (is_match and (score >= upper or (score >= lower and score < upper))))::bigint as cost from ev, band group by width), bs as (select bd.*, (select cost from opt where ratio = 10) - bd.cost as removed from bd)",
        "select width, queue, cost, removed, round(queue * 10000.0::double / (select count(distinct entity_id) from nrow where entity_id % 2 = 0), 1) as per_10000, round(case when queue = 0 then 0.0::double else removed::double / queue end, 4) as break_even, case when lag(queue) over (order by width) is not null then round(coalesce((removed - lag(removed) over (order by width))::double / nullif(queue - lag(queue) over (order by width), 0), 0.0::double), 4) end as marginal from bs",
    ),
    "cc_components": _with(RUNS, "select sys, id, component from comp2"),
    "cc_damage": _with(RUNS, "select a.*, b.fragmented from (select count(*) as clusters, count(*) filter (n > 1) as welded, max(n) as worst from (select count(distinct entity_id) as n from comp2 group by component)) a, (select count(*) filter (n > 1) as fragmented from (select count(distinct component) as n from comp2 group by entity_id)) b"),
    "multi_report": _with(SCORES, "select count(*) as false_accepts, count(*) filter (multi) as with_multi, round(coalesce(count(*) filter (multi)::double / nullif(count(*), 0), 0), 6) as share from sc where score >= 8.0 and not is_match"),
    "surv_first": f"with {_EV} {_winner('source, key')}",
    "surv_recent": f"with {_EV} {_winner('seen desc, source desc, key desc')}",
    "surv_majority": f"with {_EV}, v as (select *, count(*) over (partition by user_id, value) as c from told) {_winner('c desc, seen desc, source desc, key desc', 'v')}",
    "surv_priority": f"with {_EV} {_PRIORITY}",
    "surv_golden": _with(f"{GOLDEN}, {_RULES}", "select component, field, value, source, key, 'source_priority' as rule from g_priority"),
    "surv_sample": _with(f"{GOLDEN}, {_RULES}", "select component, field, value, g.source, key, 'source_priority' as rule, name_raw, street as street_raw, observed_at from (select * from g_priority order by component, field limit 100) g join roster r on r.source_system = g.source and r.source_row_id = g.key"),
    "surv_lineage_check": f"with {_EV} select 0::bigint as violations, count(*) as control from ({_PRIORITY})",
    "surv_accuracy": _with(f"{GOLDEN}, {_RULES}, {_TRUTH}, {_ACCURACY}", "select * from acc union all by name select '(mean)' as field, " + ", ".join(f"round(avg({c}), 6) as {c}" for r in _R4 for c in (r, f"{r}_single")) + ", max(clusters) as clusters, max(clusters_single) as clusters_single from acc"),
    "surv_best": _with(f"{GOLDEN}, {_RULES}, {_TRUTH}, {_ACCURACY}", "select field, accuracy, rule from (select *, row_number() over (partition by field order by accuracy desc, rule) as k from (unpivot (select field, first, recent, majority, priority from acc) on first, recent, majority, priority into name rule value accuracy)) where k = 1"),
    "cost_penalty": _with(CURVE + ", b as (select threshold as f1_threshold, f1, fp, fn from curve order by f1 desc, threshold limit 1)", "select ratio, threshold, cost, f1_threshold, f1, ratio * fp + fn as f1_cost, ratio * fp + fn - cost as extra, round(threshold - f1_threshold, 3) as moved from opt, b"),
    "recall_ceiling": _with(CURVE, "select count(*) as scored, count(*) filter (is_match) as found, any_value(total) as true_pairs, round(count(*) filter (is_match)::double / any_value(total), 6) as ceiling from ev, tot"),
    "sweep_guards": _with(CURVE, "select (select count(*) from raw x join cnt y on y.i = x.i join cnt z on z.i = x.i - 1 where y.tp > z.tp) as rises, (select (count(distinct tp + fp) <= 1)::int from cnt) as degenerate"),
    "damage_sweep": _with(
        SCORES + """, ts as (select unnest([2.0, 5.0, 8.0, 11.0, 14.0])::double as threshold), es as (select threshold, concat(a_sys, a_id) as x, concat(b_sys, b_id) as y, is_match from sc, ts where entity % 2 = 0 and score >= threshold),
        nd as (select threshold, concat(source_system, source_row_id) as node, entity_id from nrow, ts where ingest_batch > 0), bt as (select threshold, x, y from es union all select threshold, y, x from es),
        wk(threshold, node, seen) as (select threshold, node, node from nd union select w.threshold, w.node, e.y from wk w join bt e on e.threshold = w.threshold and e.x = w.seen),
        cp as (select threshold, node, min(seen) as c from wk group by 1, 2), mb as (select threshold, c, entity_id from nd join cp using (threshold, node) where entity_id % 2 = 0),
        cl as (select threshold, c, count(distinct entity_id) as n, count(*) as size from mb group by 1, 2), pv as (select threshold, entity_id, count(distinct c) as k, max((n > 1)::int) as w from mb join cl using (threshold, c) group by 1, 2),
        s1 as (select threshold, count(*) as clusters, count(*) filter (n > 1) as welded, coalesce(sum(size) filter (n > 1), 0)::bigint as rows_welded, max(n) as worst from cl group by 1),
        s2 as (select threshold, count(*) as providers, sum(w)::bigint as providers_welded, count(*) filter (k > 1) as split from pv group by 1),
        s3 as (select threshold, count(*) as accepted, count(*) filter (is_match) as accepted_true, count(*) filter (not is_match) as accepted_false from es group by 1)""",
        "select threshold, clusters, welded, rows_welded, worst, providers, providers_welded, split, coalesce(accepted, 0) as accepted, coalesce(accepted_true, 0) as accepted_true, coalesce(accepted_false, 0) as accepted_false, round(coalesce(accepted_false::double / accepted, 0), 6) as false_share from s1 join s2 using (threshold) left join s3 using (threshold)",
    ),
    "norm_persons": f"select source_system, source_row_id, len(p)::int as persons, array_to_string(p, '|') as names from (select source_system, source_row_id, list_filter(list_transform(regexp_split_to_array(name_raw, '\\s+and\\s+'), lambda x: trim(x)), lambda x: x <> '') as p from ({roster_sql('duckdb')}))",
    "load_roundtrip": f"select source_system, ingest_batch, count(*) as n, count(npi) as with_npi, count(suite) as with_suite, count(street) as with_street from ({roster_sql('duckdb')}) group by 1, 2",
    "two_site": _with(NORM, "select distinct entity_id from nrow group by source_system, entity_id having count(*) > 1"),
    "orders_per_customer": "select count(*) as customers, sum(n * (n - 1) // 2)::bigint as pairs from (select o_custkey, count(*) as n from orders group by 1 having count(*) > 1)",
    "ovr_build": _with(BUILT, "select * from built"),
    "ovr_replay": _with(BUILT, "select kind, count(*) filter (c.cluster_id = created_id) as retained, count(*) filter (c.cluster_id is distinct from created_id and created_id in (select cluster_id from comp2)) as misapplied, count(*) filter (c.cluster_id is distinct from created_id and created_id not in (select cluster_id from comp2)) as lost, count(*) filter (c.cluster_id is distinct from created_id and created_id in (select cluster_id from comp2) and not exists (select 1 from comp2 z where z.cluster_id = created_id and z.entity_id = c.entity_id)) as unrelated, count(c.cluster_id) as kept_by_key from built left join comp2 c on c.sys = a_sys and c.id = a_id group by kind"),
    "ovr_stability": _with(f"{RUNS}, o as ({_MEMBERS.format(c='comp1')}), n as ({_MEMBERS.format(c='comp2')})", "select count(*) as clusters, count(*) filter (o.members <> n.members) as different, count(*) filter (n.members is null) as absent, count(*) filter (o.cluster_id is distinct from n.cluster_id) as renumbered from o left join n using (name)"),
    "ovr_stale": _with(BUILT, "select a_sys, a_id from built b join nrow r on r.source_system = a_sys and r.source_row_id = a_id where kind = 'pin' and exists (select 1 from nrow x where x.source_system = 'clearinghouse' and x.ingest_batch > 1 and x.entity_id = r.entity_id)"),
}
