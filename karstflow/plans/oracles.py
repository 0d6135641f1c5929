"""DuckDB SQL with the same rows as plans.queries, written independently of the plans: common table expressions."""

from __future__ import annotations

from karstflow.plans.queries import FINER, LAMBDA, SHORT, SUPPORT, THRESHOLD

PAIRS = """bought as (select o_custkey as cust, l_partkey as part, l_suppkey as supp from lineitem join orders on o_orderkey = l_orderkey),
  p as (select a.cust as src, b.cust as dst from bought a join bought b using (part, supp))"""
EDGES = PAIRS + ", e as (select distinct src as u, dst as v from p where src > dst)"
DEGREE = EDGES + ", ends as (select u as src, v as dst from e union all select v, u from e), deg as (select src as id, count(*) as k from ends group by src)"
JACCARD = (
    DEGREE
    + """, t as (select e.u, e.v, count(*) as t from e join ends x on x.src = e.u join ends y on y.src = e.v and y.dst = x.dst group by e.u, e.v),
  s0 as (select e.u, e.v, ku.k as ku, kv.k as kv, 1 - (coalesce(t, 0) + 2) / (ku.k + kv.k - coalesce(t, 0)) as d, 0::bigint as win
    from e join deg ku on ku.id = e.u join deg kv on kv.id = e.v left join t on t.u = e.u and t.v = e.v)"""
)


def rounded(x: str, digits: int = 10) -> str:
    return f"round({x}, {digits}) + 0.0"


#: Steps that the SQL of whole runs makes, more than any of the given tables needs; a step without active edges changes nothing.
STEPS = 40


def _delta(k: int, counted: str = "true") -> str:
    """Expressions up to x{k}(u, v, delta) of the state s{k}; weights are summed over counted edges."""
    live = lambda d: f"({d} > 0 and {d} < 1)"
    return f""", a{k} as (select u as src, v as dst, d, {counted} as counted from s{k} union all select v, u, d, {counted} from s{k}),
  w{k} as (select src as id, sum(case when counted then 1 - d else 0 end) as s from a{k} group by src),
  wedge{k} as (select x.src as mid, x.dst as a, y.dst as b, x.d as da, y.d as db, c.d as dc from a{k} x join a{k} y on x.src = y.src and x.dst < y.dst left join s{k} c on c.v = x.dst and c.u = y.dst),
  di{k} as (select u, v, -sin(1 - d) * (1.0 / ku + 1.0 / kv) as x from s{k} where {live("d")}),
  ci{k} as (select b as u, a as v, -sum((1 - db) * sin(1 - da) / ka.k + (1 - da) * sin(1 - db) / kb.k) as x from wedge{k} join deg ka on ka.id = a join deg kb on kb.id = b where {live("dc")} group by a, b),
  th{k} as (select a, b, sum(2 - da - db) / any_value(wa.s + wb.s) as theta from wedge{k} join w{k} wa on wa.id = a join w{k} wb on wb.id = b where dc is null group by a, b having bool_or({live("da")} or {live("db")})),
  rho{k} as (select a, b, case when theta >= {LAMBDA} - 1e-12 then theta else theta - {LAMBDA} end as rho from th{k}),
  arm{k} as (select mid, b as other, db as own, -rho * sin(1 - da) / deg.k as x from wedge{k} join rho{k} using (a, b) join deg on deg.id = mid where dc is null
    union all select mid, a, da, -rho * sin(1 - db) / deg.k from wedge{k} join rho{k} using (a, b) join deg on deg.id = mid where dc is null),
  ei{k} as (select greatest(mid, other) as u, least(mid, other) as v, sum(x) as x from arm{k} where {live("own")} group by 1, 2),
  x{k} as (select u, v, sum(x) as delta from (select * from di{k} union all select * from ci{k} union all select * from ei{k}) group by u, v)"""


def _step(k: int, window: int = SHORT, support: float = SUPPORT) -> str:
    """Expressions up to s{k+1} by the distributed rule."""
    i = k % window
    return (
        _delta(k)
        + f""", b{k} as (select s{k}.*, coalesce(delta, 0) as delta, d > 0 and d < 1 as live, case when coalesce(delta, 0) >= 0 then 1 else 0 end as bit from s{k} left join x{k} using (u, v)),
  r{k} as (select *, case when live then ({'win' if k else '0::bigint'} & ~(1::bigint << {i})) | (bit::bigint << {i}) else 0 end as ring from b{k}),
  f{k} as (select *, case when live and {k} >= {window - 1} and bit_count(ring) > {support * window} then case when bit = 1 then 2 else -2 end else delta end as move from r{k}),
  s{k + 1} as (select u, v, ku, kv, greatest(0.0, least(1.0, d + move)) as d, ring as win from f{k})"""
    )


def _single(k: int) -> str:
    """Expressions up to s{k+1} by the single-machine rule, whose full ring always forces."""
    ring = f"(win & ~(1::bigint << (cnt % {SHORT}))) | (bit::bigint << (cnt % {SHORT}))"
    return (
        _delta(k, "in_s")
        + f""", y{k} as (select s{k}.*, d > 0 and d < 1 as live, coalesce(delta, 0) as delta from s{k} left join x{k} using (u, v)),
  z{k} as (select *, live and abs(delta) > 1e-7 as moves, case when delta >= 0 then 1 else 0 end as bit from y{k}),
  f{k} as (select *, d + case when cnt >= {SHORT - 1} then case when bit = 1 then 2 else -2 end else delta end as new from z{k}),
  s{k + 1} as (select u, v, ku, kv, case when moves then case when new > 1 - 1e-7 then 1.0 when new < 1e-7 then 0.0 else new end when live then d_prev else d end as d, d as d_prev,
    moves or not live as in_s, moves as moved, case when moves then {ring} else win end as win, cnt + moves::bigint as cnt from f{k})"""
    )


def _components(threshold: float, name: str, state: str = "s0", ids: str = "deg") -> str:
    """Expressions up to {name}(id, comm), after JACCARD; needs `with recursive`."""
    return f""", {name}_n as (select u as a, v as b from {state} where d < {threshold} union all select v, u from {state} where d < {threshold}),
  {name}_r(id, r) as (select id, id from {ids} union select {name}_r.id, {name}_n.b from {name}_r join {name}_n on {name}_n.a = {name}_r.r),
  {name}_c as (select id, min(r) as c from {name}_r group by id),
  {name} as (select id, dense_rank() over (order by c) as comm from {name}_c)"""


GRID = "g as (select i % 8 as bits, (i // 8 % 2)::int as bit, (i // 16)::int as step from range(80) t(i))"
RING = f"(bits & ~(1::bigint << (step % {SHORT}))) | (bit::bigint << (step % {SHORT}))"
SAMPLES = """m as (select event_type as run, epoch(date_trunc('second', ts)) + event_id / 1000000.0 as ts, event_id % 2 = 0 as single,
  (event_id * 7 % 1000 * 1048576)::bigint as main_mem, (event_id * 7 % 101)::double as main_cpu, (event_id * 11 % 1000 * 1048576)::bigint as java_mem, (event_id * 11 % 101)::double as java_cpu,
  (event_id * 13 % 1000 * 1048576)::bigint as workers_mem, (event_id * 13 % 101)::double as workers_cpu from events)"""
NATIONS = "truth as (select c_nationkey::bigint as comm_id, c_custkey as node from customer)"
TABLE = "cell as (select comm_id as label, comm, count(*)::double as n from truth join c on c.id = truth.node group by 1, 2), rows_ as (select label, sum(n) as n from cell group by 1), cols as (select comm, sum(n) as n from cell group by 1)"
MATCHES = """sizes as (select comm, count(*) as size from c group by comm),
  one as (select comm_id, count(*) as n, count(c.comm) as known, min(c.comm) as comm, max(c.comm) as other from truth left join c on c.id = truth.node group by comm_id),
  found as (select comm_id, coalesce(n = known and one.comm = other and size = n, false) as exact, coalesce(n = known and one.comm = other, false) as included from one left join sizes on sizes.comm = one.comm)"""
ACCURACY = "select count(*) as total, count(*) filter (exact) as exact_correct, {0} as exact_accuracy, count(*) filter (included) as inclusion_correct, {1} as inclusion_accuracy from found".format(
    rounded("100.0 * count(*) filter (exact) / count(*)"), rounded("100.0 * count(*) filter (included) / count(*)")
)


def sql() -> dict[str, str]:
    parts = JACCARD + _components(THRESHOLD, "c")
    whole = JACCARD + "".join(_step(k, 15, 0.7) for k in range(STEPS)) + ", every as (select distinct src as id from p)" + _components(1.0, "r", f"s{STEPS}", "every")
    single = JACCARD.replace("s0 as (", "j0 as (") + ", s0 as (select *, 0.0::double as d_prev, true as in_s, true as moved, 0::bigint as cnt from j0)"
    finer = parts + _components(FINER, "f") + ", truth as (select comm as comm_id, id as node from f)"
    entropy = lambda t: f"(select -sum(n / total * ln(n / total)) from {t}, (select sum(n) as total from cell))"
    mutual = "(select sum(cell.n / total * ln(cell.n * total / (rows_.n * cols.n))) from cell join rows_ using (label) join cols using (comm), (select sum(n) as total from cell))"
    choose = lambda t: f"(select sum(n * (n - 1) / 2) from {t})"
    chance = f"({choose('rows_')} * {choose('cols')} / (select sum(n) * (sum(n) - 1) / 2 from cell))"
    ari = f"({choose('cell')} - {chance}) / (({choose('rows_')} + {choose('cols')}) / 2 - {chance})"
    nmi = f"{mutual} / (({entropy('rows_')} + {entropy('cols')}) / 2)"
    rule = lambda test: f"case when step >= {SHORT - 1} and {test} then case when bit = 1 then 2.0 else -2.0 end else 0.25 end::double"
    line = "count(*) over (partition by run order by ts rows between 4 preceding and current row)"
    mean = "avg({0}) over (partition by run order by ts rows between 4 preceding and current row)"
    total = "case when single then main_{0} else main_{0} + java_{0} + workers_{0} end"
    return {
        "edges_canonical": f"with {PAIRS} select distinct greatest(src, dst) as u, least(src, dst) as v from p where src <> dst",
        "edge_dedupe": f"with {PAIRS} select greatest(src, dst) as u, least(src, dst) as v, count(*) as copies from p where src <> dst group by 1, 2",
        "vertices": f"with {PAIRS} select distinct src as id from p",
        "degree": f"with {DEGREE} select id, k from deg",
        "bidirectional": f"with {DEGREE} select src, dst from ends",
        "star_graphs": f"with {DEGREE} select src as center, string_agg(dst || ':' || k, ' ' order by dst) as neighbors, count(*) as degree from ends join deg on deg.id = dst group by src",
        "triangles": f"with {EDGES} select x.v as x, x.u as y, y.u as z from e x join e y on x.u = y.v join e z on z.u = y.u and z.v = x.v",
        "wedges": f"with {DEGREE} select x.src as mid, x.dst as a, y.dst as b, e.u is not null as closed from ends x join ends y on x.src = y.src and x.dst < y.dst left join e on e.v = x.dst and e.u = y.dst",
        "jaccard_init": f"with {JACCARD} select u, v, {rounded('d')} as d from s0",
        "vertex_weight_sum": f"with {JACCARD} select id, {rounded('sum(1 - d)')} as s from (select u as id, d from s0 union all select v, d from s0) group by id",
        "di": f"with {JACCARD}{_delta(0)} select u, v, {rounded('x')} as di from di0",
        "ci": f"with {JACCARD}{_delta(0)} select u, v, {rounded('x')} as ci from ci0",
        "theta": f"with {JACCARD}{_delta(0)} select a, b, {rounded('theta')} as theta from th0",
        "rho": f"with {JACCARD}{_delta(0)} select a, b, {rounded('rho')} as rho from rho0",
        "ei": f"with {JACCARD}{_delta(0)} select u, v, {rounded('x')} as ei from ei0",
        "delta": f"with {JACCARD}{_delta(0)} select u, v, {rounded('delta')} as delta from x0",
        "hash_class": f"with {PAIRS} select distinct src as id, ((src - 1000) % 7 + 7) % 7 as class from p",
        "equal_classes": f"""with {EDGES}, h as (select u, v, u % 3 as a, v % 3 as b, (u + v) % 3 as c from e)
  select u, v, (a = b)::int + (a = c)::int + (b = c)::int as equal, a = 0 or a = b or a = c as inside from h""",
        "distance_lookup": f"with {JACCARD} select v as a, u as b, {rounded('d')} as d from s0 union select u, u, 0.0 from s0",
        "weight_lookup": f"with {JACCARD}, q as (select v as a, u + 1 as b from e union select u, u + 1 from e) select a, b, {rounded('coalesce(d, 0)')} as w from q left join s0 on s0.u = greatest(a, b) and s0.v = least(a, b)",
        "triples_per_vertex": f"""with {EDGES}, h as (select u, v, u % 5 as hu, v % 5 as hv from e), r as (select i from range(5) t(i)),
  t as (select u, v, list_sort([x.i, y.i, hu]) as t from h, r x, r y where hu = hv and x.i < y.i and x.i <> hu and y.i <> hu union all select u, v, list_sort([x.i, hu, hv]) from h, r x where hu <> hv and x.i <> hu and x.i <> hv)
  select distinct id, t[1] as i, t[2] as j, t[3] as k from (select u as id, t from t union all select v, t from t)""",
        "replica_normaliser": f"with {EDGES} select u, v, (case when u % 8 = v % 8 then 21 else 6 end)::bigint as copies from e",
        "replica_normaliser_common": f"""with {EDGES}, t as (select x.v as x, x.u as y, y.u as z from e x join e y on x.u = y.v join e z on z.u = y.u and z.v = x.v)
  select x, y, z, (case (x % 5 = y % 5)::int + (x % 5 = z % 5)::int + (y % 5 = z % 5)::int when 3 then 6 when 1 then 3 else 1 end)::bigint as copies from t""",
        "replica_normaliser_exclusive": f"""with {DEGREE}, t as (select x.src as mid, x.dst as a, y.dst as b from ends x join ends y on x.src = y.src and x.dst < y.dst left join e on e.v = x.dst and e.u = y.dst where e.u is null)
  select mid, a, b, (case (mid % 5 = a % 5)::int + (mid % 5 = b % 5)::int + (a % 5 = b % 5)::int when 3 then 6 when 1 then 3 else 1 end)::bigint as copies from t""",
        "window_bit": f"with {GRID} select bits, bit, step, {RING} as ring, reverse(lpad(bin({RING}), {SHORT}, '0')) as text, {RING} as again from g",
        "window_rule_table": f"""with {GRID}, r as (select *, bit_count({RING}) as ones from g) select bits, bit, step, {rule(f'ones > {SUPPORT * SHORT}')} as compat,
  {rule(f'(case when bit = 1 then ones else {SHORT} - ones end) > {SUPPORT * SHORT}')} as symmetric, {rule('true')} as single from r""",
        "update_step1": f"with {JACCARD}{_step(0)} select u, v, {rounded('d')} as d, win from s1",
        "update_step3": f"with {JACCARD}{_step(0)}{_step(1)}{_step(2)} select u, v, {rounded('d')} as d, win from s3",
        "update_single_step1": f"""with {JACCARD}{_delta(0)}, y as (select u, v, d, d > 0 and d < 1 as live, coalesce(delta, 0) as delta from s0 left join x0 using (u, v)), z as (select *, live and abs(delta) > 1e-7 as moved from y)
  select u, v, {rounded("case when moved then case when d + delta > 1 - 1e-7 then 1.0 when d + delta < 1e-7 then 0.0 else d + delta end when live then 0.0 else d end")} as d, moved or not live as in_s, moved,
  (case when moved and delta >= 0 then 1 else 0 end)::bigint as win, (case when moved then 1 else 0 end)::bigint as cnt from z""",
        "update_single_step2": f"with {single}{_single(0)}{_single(1)} select u, v, {rounded('d')} as d, in_s, moved, win, cnt from s2",
        "full_run": f"with recursive {whole} select id, comm from r",
        "full_run_plan": f"with recursive {whole} select id, comm from r",
        "active_count": f"with {JACCARD}{_step(0)} select count(*) as total, count(*) filter (d > 0 and d < 1) as active from s1",
        "communities_threshold": f"with recursive {parts} select id, comm from c",
        "community_nodes": f"with recursive {parts} select comm, string_agg(id::varchar, ' ' order by id) as nodes from c group by comm",
        "remap_ids": f"with {DEGREE}, r as (select id, row_number() over (order by id) as n from deg) select a.n as src, b.n as dst from e join r a on a.id = e.u join r b on b.id = e.v",
        "remap_communities": """with r as (select p_partkey, p_size, row_number() over (order by p_partkey) as n from part)
  select dense_rank() over (order by p_size) as comm_id, string_agg(n::varchar, ' ' order by p_partkey) as members from r group by p_size""",
        "graph_size": f"with {DEGREE} select (select count(*) from deg) as n_vertices, (select count(*) from e) as n_edges, (select max(id) from deg) as max_id",
        "truth_matches": f"with recursive {finer}, {MATCHES} select * from found",
        "accuracy": f"with recursive {finer}, {MATCHES} {ACCURACY}",
        "purity": f"with recursive {parts}, {NATIONS}, {TABLE} select {rounded('(select sum(n) from (select max(n) as n from cell group by comm)) / (select count(distinct node) from truth)')} as purity",
        "nmi": f"with recursive {parts}, {NATIONS}, {TABLE} select {rounded(nmi)} as nmi",
        "ari": f"with recursive {finer}, {TABLE} select {rounded(ari)} as ari",
        "avg_degree": f"with {DEGREE} select {rounded('avg(k)')} as avg_degree from deg",
        "n_communities": f"with recursive {parts} select count(distinct comm) as n_communities from c",
        "quality_summary": f"""with recursive {finer}, {TABLE}, {MATCHES}, acc as ({ACCURACY}) select acc.*, {rounded('(select sum(n) from (select max(n) as n from cell group by comm)) / (select count(distinct node) from truth)')} as purity,
  {rounded(nmi)} as nmi, {rounded(ari)} as ari, {rounded('(select avg(k) from deg)')} as avg_degree, (select count(distinct comm) from c) as n_communities from acc""",
        "moving_average": f"with {SAMPLES}, w as (select run, ts, {line} as n, {mean.format('main_cpu')} as smoothed from m) select run, {rounded('ts', 6)} as ts, {rounded('smoothed')} as smoothed from w where n = 5",
        "run_stats": f"with {SAMPLES} select run, trunc((max(ts) - min(ts)) / 60)::int as minutes, round(avg((main_mem + java_mem + workers_mem) / 1073741824.0), 2) as mean_mem, round(avg(main_cpu + java_cpu + workers_cpu), 2) as mean_cpu from m group by run",
        "metrics_table": f"""with {SAMPLES}, t as (select run, trunc((max(ts) - min(ts)) / 60)::int as minutes, round(avg((main_mem + java_mem + workers_mem) / 1073741824.0), 2) as mem, round(avg(main_cpu + java_cpu + workers_cpu), 2) as cpu from m group by run)
  select '| ' || upper(run[1]) || lower(run[2:]) || ', ' || case when minutes % 2 = 0 then 'single process' else 'MR gamma=5000' end || ' l=0.5, p=8 | ' || minutes || ' | ' || mem || ' | ' || cpu || ' | ' || length(run) || ' | 84.14 | 0.9775 | 0.96 | 0.5798 | 5.5299 |' as line from t""",
        "resource_series": f"""with {SAMPLES}, w as (select run, (ts - min(ts) over (partition by run)) / 60 as minute, ({total.format('mem')}) / 1073741824.0 as mem, {line} as n, {mean.format(total.format('cpu'))} as cpu from m)
  select run, {rounded('minute', 6)} as minute, {rounded('mem')} as mem, {rounded('cpu')} as cpu from w where n = 5""",
        "iteration_seconds": f"with {SAMPLES} select run, {rounded('ts', 6)} as ts, round(ts - lag(ts) over (partition by run order by ts), 3) as seconds from m",
        "run_times": f"select o_orderpriority as dataset, case when o_custkey % 2 = 0 then 'single' else 'distributed' end as mode, {rounded('o_totalprice / 60', 6)} as total_minutes, {rounded('(case when o_custkey % 2 = 0 then o_custkey else o_custkey - 1 end) / 60', 6)} as first_minutes from orders",
        "folder_parse": "select p_partkey as id, 'ds_' || p_size as dataset, (p_partkey % 10) / 10.0 as l, 15 as w, 5000 as g, p_size as p, p_partkey % 2 = 0 as sm from part",
        "edge_list_parse": "select l_partkey as src, l_suppkey as dst, count(*) as lines from lineitem where l_orderkey % 7 >= 3 group by 1, 2",
        "ground_truth_parse": "select b as comm_id, p_partkey as node from (select regexp_extract(p_brand, '([0-9]+)', 1)::bigint as b, p_partkey, p_size, max(p_size) over (partition by p_brand) as last from part) where p_size = last",
    }
