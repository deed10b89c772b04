"""DuckDB SQL for the queries, written independently of the plans: lists instead of lags, joins instead of windows."""

from __future__ import annotations

from .analogues import SQL_EVENTS, SQL_MATCHES, SQL_PROBS
from .operators import fuzzy

O: dict[str, str] = {}


def _weighted(lst: str) -> str:
    w = f"power(0.85, len({lst}) - i)"
    low = f"list_sum(list_transform({lst}, lambda x, i: case when x is not null then {w} end))"
    return f"round(list_sum(list_transform({lst}, lambda x, i: x * {w})) / {low}, 6)"


_LAST = lambda v, k, by, order: f"coalesce(list({v}) over (partition by {by} order by {order} rows between {k} preceding and 1 preceding), [])"

O["w1_rolling_form"] = f"""
with {SQL_EVENTS},
l as (select *, {", ".join(f"{_LAST('value', k, 'user_id', 'ts, event_id')} as l{k}" for k in (3, 5, 10))}, row_number() over (partition by user_id order by ts, event_id) as rn from ev),
c as (select a.event_id, count(*) filter (b.rn < a.rn) as prior, count(*) filter (b.rn < a.rn and b.ts::date > a.ts::date - 14) as last14, max(b.ts::date) filter (b.rn < a.rn) as before
      from l a join l b on a.user_id = b.user_id group by a.event_id)
select l.event_id, {", ".join(f"{_weighted(f'l{k}')} as value_L{k}" for k in (3, 5, 10))}, c.prior::int as prior, (l.ts::date - c.before)::int as rest, c.last14::int as last14
from l join c on c.event_id = l.event_id"""

O["w5_venue_form"] = f"""
with {SQL_EVENTS}, l as (select event_id, {_LAST("value", 5, "user_id, event_type", "ts, event_id")} as l5 from ev)
select event_id, {_weighted("l5")} as venue_value_L5 from l"""

_SQL_LOG = (
    SQL_MATCHES
    + """,
log as (
  select id, d, 'H' as venue, home as team, away as opponent, case ftr when 'H' then 1.0 when 'D' then 0.5 else 0.0 end::double as res, fthg::double as gf, ftag::double as ga, hs::double as shots_f, as_::double as shots_a from m
  union all
  select id, d, 'A', away, home, case ftr when 'A' then 1.0 when 'D' then 0.5 else 0.0 end::double, ftag, fthg, as_, hs from m)"""
)
O["fe_team_log"] = f"with {_SQL_LOG} select id, venue, team, opponent, res, gf, ga, shots_f, shots_a from log"

O["j1_training_features"] = f"""
with {_SQL_LOG},
f as (select *, {_LAST("res", 5, "team", "d, id")} as lr, {_LAST("gf", 10, "team", "d, id")} as lg, {_LAST("ga", 3, "team", "d, id")} as la, {_LAST("gf", 5, "team, venue", "d, id")} as lv,
             row_number() over (partition by team order by d, id) as rn, lag(d) over (partition by team order by d, id) as before from log),
c as (select a.id, a.venue, count(*) as n from f a join f b on a.team = b.team and b.rn < a.rn and b.d > a.d - 14 group by all),
x as (select f.id, f.venue, {_weighted("lr")} as result_l5, {_weighted("lg")} as gf_l10, {_weighted("la")} as ga_l3, {_weighted("lv")} as venuegf_l5, (d - before)::int as restdays, coalesce(c.n, 0)::int as matcheslast14days
      from f left join c on c.id = f.id and c.venue = f.venue)
select h.id, {", ".join(f"{v}.{c} as {v}_{c}" for v in "ha" for c in ("result_l5", "gf_l10", "ga_l3", "venuegf_l5", "restdays", "matcheslast14days"))}
from x h join x a on a.id = h.id and h.venue = 'H' and a.venue = 'A'"""

O["j11_asof_snapshot"] = f"""
with {SQL_EVENTS},
u as (select user_id, unnest([max(ts::date) - 30, max(ts::date) + 1])::date as as_of from ev group by user_id),
j as (select u.user_id, u.as_of, list(value order by ts, event_id) filter (event_id is not null) as l, count(event_id) as prior, (u.as_of - max(ts::date))::int as rest, count(*) filter (ts::date > u.as_of - 14) as last14
      from u left join ev on ev.user_id = u.user_id and ev.ts::date < u.as_of group by u.user_id, u.as_of),
k as (select *, coalesce(l[greatest(len(l) - 2, 1):], []) as l3, coalesce(l[greatest(len(l) - 9, 1):], []) as l10 from j)
select user_id, as_of, {_weighted("l3")} as value_L3, {_weighted("l10")} as value_L10, prior, rest, last14 from k"""

_SQL_ELO = (
    "recursive "
    + SQL_MATCHES
    + """,
s as (select id, t, row_number() over (partition by t order by d, id) as n from (select id, d, home as t from m union all select id, d, away from m)),
o as (
  select m.id, m.home, m.away, h.n as hn, a.n as an, case when abs(fthg - ftag) <= 1 then 1.0 when abs(fthg - ftag) = 2 then 1.5 else (11 + abs(fthg - ftag)) / 8.0 end::double as mult,
         case when fthg > ftag then 1.0 when fthg = ftag then 0.5 else 0.0 end::double as won
  from m join s h on h.id = m.id and h.t = m.home join s a on a.id = m.id and a.t = m.away),
st as (
  select t, 0::bigint as n, 1500.0::double as r, null::bigint as id, null::double as pre from (select distinct t from s)
  union all
  select * from (
    with ready as (
      select o.*, 20.0 * mult * (won - 1 / (1 + power(10.0, -((h.r + 100) - a.r) / 400))) as k
      from o join st h on o.home = h.t and o.hn = h.n + 1 join st a on o.away = a.t and o.an = a.n + 1)
    select st.t, st.n + (q.id is not null)::int, st.r + coalesce(q.k, 0), q.id, case when q.id is not null then st.r end
    from st left join (select home as t, id, k from ready union all select away, id, -k from ready) q on q.t = st.t
    where exists (select 1 from ready))),
fin as (select t, arg_max(r, n) as r from st group by t)"""
)
O["w6_elo"] = f"""
with {_SQL_ELO}
select h.id, round(h.pre, 6) as home_pre, round(a.pre, 6) as away_pre, round(h.r, 6) as home_post, round(a.r, 6) as away_post
from m join st h on h.id = m.id and h.t = m.home join st a on a.id = m.id and a.t = m.away"""
O["w7_latest_ratings"] = f"with {_SQL_ELO} select t as team, round(r, 1) as rating from fin"

O["p3_season_calendar"] = """
select o_orderkey as id, s as start, s::varchar || '-' || lpad(((s + 1) % 100)::varchar, 2, '0') as label
from (select o_orderkey, (case when month(o_orderdate) >= 7 then year(o_orderdate) else year(o_orderdate) - 1 end)::int as s from orders)"""
O["p2_canonical_names"] = """
select c_custkey, n_name as team from customer join nation on c_nationkey = n_nationkey"""
O["p4_lenient_dates"] = "select o_orderkey as id, case when o_orderkey % 4 < 2 then o_orderdate::date end as d from orders"
O["p7_result_and_key"] = f"with {SQL_MATCHES} select id, ftr as result, strftime(d, '%Y%m%d') || '_Team' || home || '_Team' || away as match_key from m"
O["p8_range_violations"] = f"""
with {SQL_MATCHES}
select id, 'FTHG' as column_name, (fthg * 5)::double as value from m where fthg * 5 not between 0 and 15
union all select id, 'HS', hs * 3 from m where hs * 3 not between 0 and 50"""
O["l3_keep_first"] = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1"""
O["a1_quality_counts"] = """
with r as (select l_shipdate::date as d, l_orderkey as h, l_linenumber as a, case when l_partkey % 10 <> 0 then l_partkey % 5 end as hg, l_suppkey % 4 as ag, case when l_returnflag = 'R' then 'H' else 'D' end as ftr from lineitem),
c as (select count(*) as n from (select distinct d, h, a from r where hg is not null))
select count(*) as rows_in, count(*) filter (hg is null) as missing_core, count(*) filter (hg is not null and ftr <> case when hg > ag then 'H' when hg < ag then 'A' else 'D' end) as result_fixes,
       any_value(c.n) as rows_out, count(*) filter (hg is not null) - any_value(c.n) as duplicates from r, c"""
O["a2_coverage"] = f"""
with {SQL_EVENTS} select 'value' as column_name, round(100.0 * count(value) / count(*), 1)::double as coverage from ev
union all select 'ts', round(100.0 * count(ts) / count(*), 1) from ev union all select 'absent', 0.0"""
O["a3_matches_per_team"] = f"with {SQL_MATCHES} select team, count(*) as n from (select home as team from m union all select away from m) group by team"
O["a4_global_aggregates"] = f"with {SQL_MATCHES} select max(d) as last, round(avg(fthg), 6) as mean_home, round(stddev_samp(hs), 6) as sd_shots, count(distinct home) as teams from m"
O["a8_quantiles"] = f"""
with {SQL_MATCHES} select n as column_name, {", ".join(f"round(quantile_cont(v, {p / 100}), 6) as p{p}" for p in (10, 25, 50, 75, 90))}
from (select 'HS' as n, hs::double as v from m union all select 'AS', as_::double from m) group by n"""
O["j7_played"] = f"with {SQL_MATCHES} select id, exists (select 1 from m x where x.d < date '1997-10-01' and x.d = m.d and x.home = m.home and x.away = m.away) as played from m"
O["p13_schedule_gaps"] = f"with {SQL_MATCHES} select id from m where d >= date '1997-10-01' and d < date '1997-12-30'"
O["a6_next_round"] = f"""
with {SQL_MATCHES}, c as (select *, dayofyear(d)::int % 38 as r from m where d >= date '1997-10-01')
select 'smallest' as rule, min(r)::int as next_round from c where season = 1998
union all select 'by date', (select r from c where d >= date '1998-06-01' order by d, r limit 1)::int"""
O["p14_upcoming_round"] = f"with {SQL_MATCHES} select strftime(d, '%Y%m%d') || '_' || home || '_' || away as match_key, (dayofyear(d) % 38)::int as round from m where d >= date '1997-10-01' and season = 1997 and dayofyear(d) % 38 = 5"

_ARGMAX = "case when p_h >= p_d and p_h >= p_a then 'H' when p_d >= p_a then 'D' else 'A' end"
_ROWS = f"""
s as (
  select *, {_ARGMAX} as guess, -ln(case y when 'H' then p_h when 'D' then p_d else p_a end) as ll,
         (p_h - (y = 'H')::int) ^ 2 + (p_d - (y = 'D')::int) ^ 2 + (p_a - (y = 'A')::int) ^ 2 as br, least(floor(p_h * 10 + 1e-12), 9) as bin
  from {{rows}})"""
_BASE = """count(*) as n, round(avg((guess = y)::int), 6) as accuracy, round(avg(ll), 6) as log_loss, round(avg(br), 6) as brier,
  round(avg((guess = y)::int) filter (y = 'H'), 6) as recall_h, round(avg((guess = y)::int) filter (y = 'D'), 6) as recall_d, round(avg((guess = y)::int) filter (y = 'A'), 6) as recall_a"""


def _report(rows: str, by: str) -> str:
    """n to recall, ece_home and auc of each group; the area by rank sums with average ranks."""
    k = f"{by}, " if by else ""
    on = f"using ({by})" if by else "on true"
    return f"""{_ROWS.format(rows=rows)},
base as (select {k}{_BASE} from s {"group by " + by if by else ""}),
ece as (select {k}round(sum(abs(pm - am) * c) / sum(c), 6) as ece_home from (select {k}bin, avg(p_h) as pm, avg((y = 'H')::int) as am, count(*) as c from s group by {k}bin) {"group by " + by if by else ""}),
long as (select {k}'H' as cls, p_h as v, y = 'H' as hit from s union all select {k}'D', p_d, y = 'D' from s union all select {k}'A', p_a, y = 'A' from s),
rk as (select *, rank() over (partition by {k}cls order by v) + (count(*) over (partition by {k}cls, v) - 1) / 2.0 as r from long),
one as (select {k}cls, (sum(r) filter (hit) - count(*) filter (hit) * (count(*) filter (hit) + 1) / 2.0) / (count(*) filter (hit) * count(*) filter (not hit)::double) as a from rk group by {k}cls),
area as (select {k}round(avg(a), 6) as auc from one {"group by " + by if by else ""}),
report as (select * from base join ece {on} join area {on})"""


O["a9_full_report"] = f"with {SQL_PROBS}, {_report('p', 'model')} select * from report"
O["a15_reliability"] = f"with {SQL_PROBS}, {_ROWS.format(rows='p')} select model, bin::int as bin, round(avg(p_h), 6) as predicted_mean, round(avg((y = 'H')::int), 6) as actual_mean, count(*) as n from s group by model, bin"
O["a17_baseline"] = f"""
with {SQL_PROBS}, sh as (select avg((y = 'H')::int) as p_h, avg((y = 'D')::int) as p_d, avg((y = 'A')::int) as p_a from p where season < 1998),
t as (select y, sh.* from p, sh where season >= 1998), {_report("t", "")} select * from report"""
O["a18_softmax_weights"] = f"with {SQL_PROBS}, {_report('p', 'model')}, e as (select model, exp(-l) as e from (select model, avg(ll) as l from s group by model)) select model, round(e / sum(e) over (), 6) as weight from e"
O["a19_blend"] = f"""
with {SQL_PROBS}, b as (select id, 0.5 * p_h + 0.3 * p_a as h, 0.5 * p_d + 0.3 * p_h as d, 0.5 * p_a + 0.3 * p_d as a from p)
select id, round(h / (h + d + a), 6) as p_h, round(d / (h + d + a), 6) as p_d, round(a / (h + d + a), 6) as p_a from b"""
O["m10_platt_apply"] = f"""
with {SQL_PROBS}, b as (select id, 1 / (1 + exp(-(4 * p_h - 2))) as h, 1 / (1 + exp(-(3 * p_d - 1.5))) as d, 1 / (1 + exp(-(5 * p_a - 2.5))) as a from p)
select id, round(h / (h + d + a), 6) as p_h, round(d / (h + d + a), 6) as p_d, round(a / (h + d + a), 6) as p_a from b"""
O["m10_platt_balance"] = f"with {SQL_PROBS} select {', '.join(f"round(avg((y = '{k}')::int), 4) as {k.lower()}" for k in 'HDA')} from p"
_LASTN = ", ranks as (select season, row_number() over (order by season desc) as k from (select distinct season from p)), q as (select p.*, n.last_n from p join ranks using (season) join (select unnest([1, 2, 3])::int as last_n) n on k <= last_n)"
O["a20_pooled_seasons"] = f"with {SQL_PROBS}{_LASTN}, {_report('q', 'last_n')} select last_n, n, accuracy, log_loss, brier, recall_h, ece_home, auc from report"
O["a21_goals_sanity"] = f"""
with {SQL_PROBS}, {_ROWS.format(rows="p")} select round(avg((guess = y)::int), 6) as accuracy, round(avg(((p_h + p_d / 2 > 0.5) = (goals > 2.5))::int), 6) as over_under_accuracy,
  {", ".join(f"round(avg(p_h) filter (y = '{k}'), 6) as mean_p_h_{k.lower()}" for k in "HDA")} from s"""
O["a29_comparison"] = f"with {SQL_PROBS}, {_report('p', 'model')} select model, n, round(accuracy, 4) as accuracy, round(log_loss, 4) as log_loss, round(brier, 4) as brier, round(auc, 4) as auc, round(ece_home, 4) as ece_home, round(recall_h, 3) as recall_h from report"
O["m11_isotonic"] = f"""
with {SQL_PROBS}, v as (select p_h, count(*) filter (y = 'H') as hits, count(*) as n, row_number() over (order by p_h) as i from p group by p_h),
means as (select j.i as j, k.i as k, (select sum(hits) / sum(n) from v where i between j.i and k.i) as m from v j join v k on j.i <= k.i),
least_from as (select j, k as i, min(m) over (partition by j order by k desc) as m from means),
curve as (select i, max(m) as m from least_from group by i)
select round(p_h, 6) as p_h, round(m, 6) as value, (sum(n) over (partition by round(m, 12)))::bigint as block_rows from v join curve using (i)"""
O["d4_score_balance"] = f"""
with {SQL_MATCHES}, w as (select *, exp(-ln(2) / 260 * datediff('day', d, (select max(d) from m))) as w from m),
s as (select home as team, w * fthg as f, w * ftag as g from w union all select away, w * ftag, w * fthg from w)
select team, round(sum(f), 4) as scored, round(sum(g), 4) as conceded from s group by team"""
O["a30_beating_baseline"] = f"with {SQL_PROBS}, {_report('p', 'model')}, l as (select model, avg(ll) as x, coalesce(avg((guess = y)::int) filter (y = 'D'), 0) as rd from s group by model) select model, round(x, 6) as log_loss, rd < 0.05 as hardly_any_draw from l where model <> 'm0' and x < (select x from l where model = 'm0')"
O["a25_extremes_by_key"] = f"with {SQL_PROBS}, {_ROWS.format(rows='p')}, l as (select model, avg(ll) as x, avg((guess = y)::int) as acc from s group by model) select arg_min(model, x) as best, arg_max(model, acc) as most_accurate, round(min(x), 6) as log_loss from l"
O["w12_walk_forward"] = f"""
with {SQL_MATCHES}, z as (select season, row_number() over (order by season) - 1 as i from (select distinct season from m))
select f.i::int as fold, t.season, case when t.i = f.i then 'test' else 'train' end as role from z f join z t on t.i <= f.i where f.i >= 3"""
O["w13_chronological_split"] = f"""
with {SQL_MATCHES}, z as (select season, row_number() over (order by season desc) as i from (select distinct season from m where season < 2001))
select id, case i when 1 then 'Test' when 2 then 'Validation' else 'Train' end as split from m join z using (season)"""

_GRID = """
r as (select id, 0.6 + home / 10.0 as lh, 0.5 + away / 12.0 as la from m),
g as (
  select distinct lh, la, h, a, exp(-lh) * lh ^ h / factorial(h::int) * exp(-la) * la ^ a / factorial(a::int)
    * greatest(case when h = 0 and a = 0 then 1 - lh * la * -0.08 when h = 0 and a = 1 then 1 + lh * -0.08 when h = 1 and a = 0 then 1 + la * -0.08 when h = 1 and a = 1 then 1.08 else 1 end, 1e-6) as w
  from (select distinct lh::double as lh, la::double as la from r), range(11) x(h), range(11) y(a)),
n as (select lh, la, h, a, w / sum(w) over (partition by lh, la) as p from g)"""
O["d1_expected_goals"] = f"""
with {SQL_MATCHES}, t as (select n_nationkey as team, n_nationkey / 50.0 - 0.2 as att, 0.3 - n_nationkey / 40.0 as def from nation where n_nationkey < 20)
select id, round(exp(0.35 + coalesce(h.att, 0) - coalesce(a.def, 0)), 6) as rate_h, round(exp(0.1 + coalesce(a.att, 0) - coalesce(h.def, 0)), 6) as rate_a
from m left join t h on h.team = home left join t a on a.team = away"""
O["d8_marginals"] = f"""
with {SQL_MATCHES}, {_GRID},
x as (select lh, la, sum(p) filter (h > a) as w, sum(p) filter (h = a) as d, sum(p) filter (h < a) as l, sum(p) filter (h + a > 2.5) as o, sum(p) filter (h >= 1 and a >= 1) as b from n group by lh, la)
select id, round(w, 6) as "P_HomeWin", round(d, 6) as "P_Draw", round(l, 6) as "P_AwayWin", round(o, 6) as "P_Over25", round(1 - o, 6) as "P_Under25", round(b, 6) as "P_BTTS_Yes", round(1 - b, 6) as "P_BTTS_No"
from r join x on x.lh = r.lh::double and x.la = r.la::double"""
O["d7_score_matrix"] = f"with {SQL_MATCHES}, {_GRID} select printf('%.4f|%.4f', lh, la) as k, h::int as hg, a::int as ag, round(p, 6) as probability from n"
O["w9_top_scores"] = f"""
with {SQL_MATCHES}, {_GRID}, z as (select *, row_number() over (partition by lh, la order by round(p, 12) desc, h, a) - 1 as place from n qualify place < 5)
select id, string_agg(h || '-' || a, ' ' order by place) as scores, round(max(p) filter (place = 0), 6) as first, round(max(p) filter (place = 4), 6) as fifth
from r join z on z.lh = r.lh::double and z.la = r.la::double group by id"""
O["a27_score_statistics"] = f"""
with {SQL_MATCHES} select home, away, fthg as hg, ftag as ag, round(sum(exp(-ln(2) / 260 * greatest(date '2001-08-02' - d, 0))), 6) as w, count(*) as n from m group by all"""
O["w8_time_weights"] = f"with {SQL_MATCHES} select id, round(exp(-ln(2) / 260 * greatest(date '1999-01-01' - d, 0)), 6) as w from m"
O["w11_confidence"] = f"""
with {SQL_PROBS}, g as (select id, {_ARGMAX} as predicted, list_reverse_sort([p_h, p_d, p_a]) as l from p)
select id, predicted, case when l[1] - l[2] >= 0.30 then 'High' when l[1] - l[2] >= 0.15 then 'Medium' else 'Low' end as confidence from g"""
O["a24_confidence_counts"] = f"select confidence, count(*) as n from ({O['w11_confidence']}) group by confidence"

_FEED = (
    SQL_MATCHES
    + """,
fz as (
  select id, case when id % 13 <> 0 then id % 101 / 100.0 end as hf, case when id % 17 <> 0 then id % 89 / 88.0 end as af, case when id % 11 <> 0 then id % 46 / 10.0 end as hat, case when id % 19 <> 0 then id % 43 / 10.0 end as aat,
         case when id % 23 <> 0 then id % 41 / 10.0 end as hde, case when id % 29 <> 0 then id % 37 / 10.0 end as ade, case when id % 7 <> 0 then id % 51 / 50.0 end as hv, case when id % 31 <> 0 then id % 21 end as hr, case when id % 37 <> 0 then id % 19 end as ar,
         case when id % 41 <> 0 then id % 6 end as hn, case when id % 43 <> 0 then id % 5 end as an, (1200 + id % 750)::double as hs_, (1200 + id % 733)::double as as_
  from m),
fi as (
  select id, coalesce(hf, 0.5)::double as "HomeForm", coalesce(af, 0.5)::double as "AwayForm", coalesce(hat, 1.4)::double as "HomeAttack", coalesce(aat, 1.4)::double as "AwayAttack", coalesce(hde, 1.4)::double as "HomeDefense", coalesce(ade, 1.4)::double as "AwayDefense",
         coalesce(hv, 0.5)::double as "HomeAdvantage", hs_ as "HomeStrength", as_ as "AwayStrength", hs_ - as_ as "StrengthGap", (coalesce(hf, 0.5) - coalesce(af, 0.5))::double as "FormGap",
         (case when hr is null then 0.18 else 0.6 * (1 - least(greatest(hr, 0), 14) / 14.0) end)::double + (case when hn is null then 0.08 else 0.4 * least(greatest(hn, 0), 4) / 4.0 end)::double as "HomeFatigue",
         (case when ar is null then 0.18 else 0.6 * (1 - least(greatest(ar, 0), 14) / 14.0) end)::double + (case when an is null then 0.08 else 0.4 * least(greatest(an, 0), 4) / 4.0 end)::double as "AwayFatigue"
  from fz)"""
)
O["f5_fatigue"] = f'with {_FEED} select id, round("HomeFatigue", 6) as home, round("AwayFatigue", 6) as away from fi'


def _fuzzy_sql() -> str:
    """Relational inference: memberships read off sampled grids, rules and terms as tables, the centroid as a join with 101 points."""
    grid = []
    for kind, terms in fuzzy.TERMS.items():
        low, high, step = fuzzy.UNIVERSES[kind]
        for i in range(round((high - low) / step) + 1):
            y = low + i * step
            for t, (a, b, c, d) in terms.items():
                v = 1.0 if b <= y <= c else 0.0 if y < a or y > d else (y - a) / (b - a) if y < b else (d - y) / (d - c)
                grid.append(f"('{kind}', '{t}', {i}, {min(max(v, 0.0), 1.0)!r})")
    used = sorted({p for a, _ in fuzzy.rules() for p in a})
    values = ", ".join(f"('{v}', '{fuzzy.kind_of(v)}', {fuzzy.UNIVERSES[fuzzy.kind_of(v)][0]}::double, {fuzzy.UNIVERSES[fuzzy.kind_of(v)][1]}::double, {fuzzy.UNIVERSES[fuzzy.kind_of(v)][2]}::double)" for v in sorted({v for v, _ in used}))
    ante = ", ".join(f"({i}, '{v}', '{t}')" for i, (a, _) in enumerate(fuzzy.rules()) for v, t in a)
    cons = ", ".join(f"({i}, '{o}', '{t}')" for i, (_, b) in enumerate(fuzzy.rules()) for o, t in b)
    points = ", ".join(f"({y}, '{t}', {(1.0 if b <= y <= c else 0.0 if y < a or y > d else (y - a) / (b - a) if y < b else (d - y) / (d - c))!r})" for y in range(101) for t, (a, b, c, d) in fuzzy.OUTPUT_TERMS.items())
    names = ", ".join(f"max(v) filter (o = '{o}') as \"{n}\"" for o, n in fuzzy.OUTPUTS.items())
    cols = ", ".join(f'round("{n}", 9) as "Fuzzy_{n}Potential"' for n in fuzzy.OUTPUTS.values())
    win = '("HomeWin" + "Draw" + "AwayWin")'
    return f"""
with {_FEED},
long as (unpivot fi on {", ".join(f'"{v}"' for v in sorted({v for v, _ in used}))} into name var value x),
vars(var, kind, low, high, step) as (values {values}),
grid(kind, term, i, mf) as (values {", ".join(grid)}),
spot as (select id, var, kind, (least(greatest(x, low), high) - low) / step as pos, round((high - low) / step)::int as last from long join vars using (var)),
near as (select *, least(floor(pos + 1e-9), last - 1)::int as i from spot),
mem as (select n.id, n.var, a.term, a.mf + (b.mf - a.mf) * (n.pos - n.i) as mu from near n join grid a on a.kind = n.kind and a.i = n.i join grid b on b.kind = n.kind and b.term = a.term and b.i = n.i + 1),
ante(rule, var, term) as (values {ante}), cons(rule, o, term) as (values {cons}), pts(y, term, mf) as (values {points}),
fired as (select id, rule, min(mu) as s from mem join ante using (var, term) group by id, rule),
str as (select id, o, term, max(s) as s from fired join cons using (rule) group by id, o, term),
agg as (select id, o, y, max(least(s, mf)) as v from str join pts using (term) where s > 0 group by id, o, y),
cen as (select id, o, sum(y * v) / sum(v) as v from agg group by id, o having sum(v) > 0),
outs as (select unnest([{", ".join(f"'{o}'" for o in fuzzy.OUTPUTS)}]) as o),
every as (select fi.id, outs.o, coalesce(cen.v, 50.0) as v from fi cross join outs left join cen on cen.id = fi.id and cen.o = outs.o),
w as (select id, {names} from every group by id)
select id, {cols}, round("HomeWin" / {win}, 9) as "Fuzzy_P_HomeWin", round("Draw" / {win}, 9) as "Fuzzy_P_Draw", round("AwayWin" / {win}, 9) as "Fuzzy_P_AwayWin",
       round("Over25" / ("Over25" + "Under25"), 9) as "Fuzzy_P_Over25", round("Under25" / ("Over25" + "Under25"), 9) as "Fuzzy_P_Under25" from w"""


O["f10_fuzzy_inference"] = _fuzzy_sql()
O["j4_inference_outcomes"] = f"""
with {SQL_MATCHES}, o as ({O['f10_fuzzy_inference']}),
j as (select m.ftr, m.fthg + m.ftag as goals, o.*, case when Fuzzy_P_HomeWin >= Fuzzy_P_Draw and Fuzzy_P_HomeWin >= Fuzzy_P_AwayWin then 'H' when Fuzzy_P_Draw >= Fuzzy_P_AwayWin then 'D' else 'A' end as guess from m join o on o.id = m.id)
select round(avg((guess = ftr)::int), 6) as accuracy, round(avg(((Fuzzy_P_Over25 > 0.5) = (goals > 2.5))::int), 6) as over_under_accuracy,
  {", ".join(f"round(avg(Fuzzy_P_HomeWin) filter (ftr = '{k}'), 6) as mean_p_h_{k.lower()}" for k in "HDA")} from j"""
O["w10_influences"] = f"""
with {_FEED},
c as (
  select id, 'Recent results (last 5)' as label, 0.15 / 0.25 * (hf - af)::double as score, hf - af > 0 as up from fz where hf is not null and af is not null
  union all select id, 'Goals conceded (last 10)', 0.2 / 0.5 * (ade - hde)::double, ade - hde > 0 from fz where hde is not null and ade is not null
  union all select id, 'Goals scored (last 10)', 0.0, hat - aat > 0 from fz where hat is not null and aat is not null
  union all select id, 'Rest days', 0.025 * (hr - ar)::double, hr - ar > 0 from fz where hr is not null and ar is not null
  union all select id, 'Matches in the last 14 days', 0.0, hn - an > 0 from fz where hn is not null and an is not null
  union all select id, 'Rating difference', 0.4 / 150 * (hs_ - as_), hs_ - as_ > 0 from fz),
z as (select *, row_number() over (partition by id order by round(abs(score), 9) desc, label) - 1 as place from c qualify place < 2)
select id, place::int as place, label, round(score, 6) as score, case when up then 'Home' else 'Away' end as favors from z"""

_PRED = (
    SQL_PROBS
    + """,
pr as (select home as home_team, away as away_team, date_trunc('month', d)::date as match_date, m.id % 50 as prediction_time, printf('v%09d', m.id) as model_version, p_h, p_d, p_a from p join m on m.id = p.id),
lt as (select * from pr qualify row_number() over (partition by home_team, away_team, match_date order by prediction_time desc, model_version) = 1),
ac as (select home as home_team, away as away_team, date_trunc('month', d)::date as match_date, arg_min(fthg, id) as actual_home, arg_min(ftag, id) as actual_away from m where d < date '2000-03-01' group by all),
sc as (
  select l.*, actual_home, actual_away, y as actual_result, guess as predicted_result, guess = y as correct,
         round((p_h - (y = 'H')::int) ^ 2 + (p_d - (y = 'D')::int) ^ 2 + (p_a - (y = 'A')::int) ^ 2, 4) as brier_score, round(-ln(case y when 'H' then p_h when 'D' then p_d else p_a end), 4) as log_loss
  from (select *, """
    + _ARGMAX
    + """ as guess from lt) l join (select *, case when actual_home > actual_away then 'H' when actual_home < actual_away then 'A' else 'D' end as y from ac) a using (home_team, away_team, match_date))"""
)
O["a26_latest_prediction"] = f"with {_PRED} select home_team, away_team, match_date, prediction_time, model_version, round(p_h, 6) as p_h, round(p_d, 6) as p_d, round(p_a, 6) as p_a from lt"
O["j9_reconciled_history"] = f"with {_PRED} select prediction_time, home_team, away_team, match_date, predicted_result, actual_home, actual_away, actual_result, correct, round(brier_score, 3) as brier_score, round(log_loss, 3) as log_loss, model_version from sc where match_date >= date '1996-01-01'"
O["a22_history_summary"] = f"with {_PRED} select count(*) as n, round(avg(correct::int), 3) as hit_rate, round(avg(brier_score), 3) as mean_brier, round(avg(log_loss), 3) as mean_log_loss from sc"
O["j8_pending"] = f"with {_PRED} select count(*) as pending from lt where not exists (select 1 from ac where ac.home_team = lt.home_team and ac.away_team = lt.away_team and ac.match_date = lt.match_date)"
O["l4_newest_rows"] = "select event_id, user_id from events order by ts desc, event_id limit 100"
O["s12_latest_version"] = "select 'models/model_v1205' as path, 1206 as next_version"
O["u2_set_operations"] = f"""
with {SQL_MATCHES}, h as (select home as team, season from m group by all having avg(fthg) > 2), a as (select away as team, season from m group by all having avg(ftag) > 1.5)
select 'union' as op, * from (select * from h union select * from a) union all select 'difference', * from (select * from h except select * from a) union all select 'intersection', * from (select * from h intersect select * from a)"""


def _serving_sql() -> str:
    """Correlated snapshots of both sides; ratings by the recursive fold over the history."""
    elo = _SQL_ELO.replace(SQL_MATCHES, f"{SQL_MATCHES.replace('m as (', 'every as (', 1)}, m as (select * from every where season < 2000)")
    log = _SQL_LOG[len(SQL_MATCHES) :].replace(" from m", " from m where season < 2000")

    def mean(v: str, k: int, team: str, venue: str = "") -> str:
        inner = f"(select {v} as v, row_number() over (order by d desc, id desc) as n from log where team = u.{team} and d < u.d {venue})"
        return f"(select round(sum(v * power(0.85, n - 1)) / sum(power(0.85, n - 1)), 6) from {inner} where n <= {k})"

    return f"""
with {elo}{log}, u as (select id, d, home, away from every where season = 2000)
select id, {mean("gf", 5, "home")} as "Home_GF_L5", {mean("res", 10, "away")} as "Away_Result_L10", {mean("ga", 5, "home", "and venue = 'H'")} as "Home_VenueGA_L5", {mean("res", 5, "away", "and venue = 'A'")} as "Away_VenueResult_L5",
  (u.d - (select max(d) from log where team = u.home and d < u.d))::int as "Home_RestDays", (select count(*) from log where team = u.away and d < u.d) as "Away_MatchesPlayedPrior",
  round(coalesce((select r from fin where t = u.home), 1500), 6) as "HomeEloPre", round(coalesce((select r from fin where t = u.away), 1500), 6) as "AwayEloPre" from u"""


O["j12_serving_features"] = _serving_sql()


O["m1_logistic_balance"] = f"""
with {SQL_MATCHES}, t as ({O['w13_chronological_split']})
select {", ".join(f"round(avg((m.ftr = '{k}')::int), 6) as p_{k.lower()}" for k in "HDA")} from m join t on t.id = m.id where t.split = 'Train'"""


def oracle_sql() -> dict[str, str]:
    return dict(O)
