"""Queries of the relational stages and of the temporal graph, over the edge, role, link and order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.ids import norm_id, sql_norm_id, text_date
from tidewheel.operators import etl, graph
from tidewheel.plans.panels import q, r
from tidewheel.plans.records import _sql_date

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Years of the panels and snapshots, and the year of single snapshots.
FIRST, LAST, ASOF = 2000, 2026, 2015
#: Rounds of PageRank in the SQL; 0.85 ** ROUNDS is below the query's tolerance.
ROUNDS = 150


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- relational stages
@query("select c_custkey as id, c_name as name, c_mktsegment as segment from customer where c_mktsegment = 'BUILDING' and c_nationkey is not null")
def universe(spark, sf):
    """Members of one segment."""
    return etl.members(table(spark, sf, "customer"), "c_mktsegment", "BUILDING", {"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}, ["c_nationkey"])


@query(f"""select {sql_norm_id('gvkey')} as gvkey, fyear, round("at", 3) as "at" from fundamentals where datadate >= date '2000-01-01' and {sql_norm_id('gvkey')} in (select {sql_norm_id('gvkey')} from linking_table where preferred = 1)""")
def semi_join_universe(spark, sf):
    f = table(spark, sf, "fundamentals").where(F.col("datadate") >= F.lit("2000-01-01").cast("date")).select(norm_id("gvkey").alias("gvkey"), "fyear", F.round("at", 3).alias("at"))
    links = table(spark, sf, "linking_table").where("preferred = 1").select(norm_id("gvkey").alias("gvkey"))
    return f.join(links, "gvkey", "left_semi")


@query(f"select permco, {sql_norm_id('gvkey')} as gvkey, {sql_norm_id('companyid')} as companyid, score from linking_table where preferred = 1")
def preferred_links(spark, sf):
    return table(spark, sf, "linking_table").where("preferred = 1").select("permco", norm_id("gvkey").alias("gvkey"), norm_id("companyid").alias("companyid"), "score")


_ROLE = "(rolename ilike '%ceo%' or rolename ilike '%chief executive%') and not rolename ilike '%division%'"


@query(f"select {sql_norm_id('directorid_starting')} as directorid_starting, companyid, rolename from ceo_sample where {_ROLE} and companyid in (select try_cast({sql_norm_id('companyid')} as bigint) from linking_table)")
def ilike_roles(spark, sf):
    ids = table(spark, sf, "linking_table").select(norm_id("companyid").try_cast("bigint").alias("companyid"))
    out = etl.roles_of(table(spark, sf, "ceo_sample"), ids, "companyid", "rolename", ["ceo", "chief executive"], ["division"])
    return out.select(norm_id("directorid_starting").alias("directorid_starting"), "companyid", "rolename")


@query("""select coalesce(associationtype, '(none)') as associationtype, count(*) as n from (select associationtype, cast(start_year as varchar) as s, case when end_year is null then 'Curr' else cast(end_year as varchar) end as e from raw_edges)
where regexp_matches(s, '^[0-9]+$') and cast(s as integer) <= 2010 and (lower(e) = 'curr' or cast(e as integer) >= 2005) group by 1""")
def interval_overlap(spark, sf):
    e = table(spark, sf, "raw_edges").select("associationtype", F.col("start_year").cast("string").alias("s"), F.coalesce(F.col("end_year").cast("string"), F.lit("Curr")).alias("e"))
    return e.where(etl.overlaps("s", "e", 2005, 2010)).groupBy(F.coalesce("associationtype", F.lit("(none)")).alias("associationtype")).agg(F.count(F.lit(1)).alias("n"))


_ROLE_YEARS = f"""roles as (select distinct {sql_norm_id('directorid_starting')} as dirid_starting, companyid, rolename, unnest(generate_series(greatest(a, {FIRST}), least(b, {LAST}))) as year from (
  select *, cast(year({_sql_date('datestartrole', False)}) as integer) as a, cast(coalesce(year({_sql_date('dateendrole', True)}), {LAST}) as integer) as b from ceo_sample) where a is not null and {sql_norm_id('directorid_starting')} is not null and greatest(a, {FIRST}) <= least(b, {LAST}))"""


def _role_years(spark, sf):
    c = table(spark, sf, "ceo_sample").select(norm_id("directorid_starting").alias("dirid_starting"), "companyid", "rolename", F.year(text_date("datestartrole")).alias("a"), F.coalesce(F.year(text_date("dateendrole", True)), F.lit(LAST)).alias("b")).where("dirid_starting is not null and a is not null")
    return etl.explode_years(c, F.greatest("a", F.lit(FIRST)), F.least("b", F.lit(LAST))).select("dirid_starting", "companyid", "rolename", "year").distinct()


@query(f"with {_ROLE_YEARS} select dirid_starting, companyid, rolename, cast(year as integer) as year from roles")
def role_year_explode(spark, sf):
    return _role_years(spark, sf)


@query(f"""with {_ROLE_YEARS}, panel as (select {sql_norm_id('dirid_starting')} as dirid_starting, year, n_unique_connected from connection_count_panel where {sql_norm_id('dirid_starting')} is not null),
links as (select distinct try_cast({sql_norm_id('companyid')} as bigint) as companyid, {sql_norm_id('gvkey')} as gvkey, permco from linking_table where preferred = 1),
funds as (select {sql_norm_id('gvkey')} as gvkey, fyear, max(round(sale, 3)) as sale from fundamentals where fyear is not null and sale is not null and not isnan(sale) group by 1, 2)
select p.dirid_starting, p.year, p.n_unique_connected, r.companyid, r.rolename, l.gvkey, l.permco, f.sale from panel p left join roles r on p.dirid_starting = r.dirid_starting and p.year = r.year left join links l on r.companyid = l.companyid left join funds f on l.gvkey = f.gvkey and p.year = f.fyear""")
def panel_merge(spark, sf):
    panel = table(spark, sf, "connection_count_panel").select(norm_id("dirid_starting").alias("dirid_starting"), "year", "n_unique_connected").where("dirid_starting is not null")
    links = table(spark, sf, "linking_table").where("preferred = 1").select(norm_id("companyid").try_cast("bigint").alias("companyid"), norm_id("gvkey").alias("gvkey"), "permco").distinct()
    funds = table(spark, sf, "fundamentals").where("fyear is not null and sale is not null and not isnan(sale)").groupBy(norm_id("gvkey").alias("gvkey"), F.col("fyear").alias("year")).agg(F.max(F.round("sale", 3)).alias("sale"))
    out = etl.merge_panel(panel, _role_years(spark, sf), links, funds)
    return out.select("dirid_starting", "year", "n_unique_connected", "companyid", "rolename", "gvkey", "permco", "sale")


_MONTHLY = "monthly as (select l_suppkey as id, date_trunc('month', l_shipdate) as d, cast(sum(cast(l_discount as decimal(10,2)) - cast(l_tax as decimal(10,2))) as double) / count(*) as ret from lineitem group by 1, 2)"
_ANNUAL = f"{_MONTHLY}, annual as (select id, cast(year(d) as integer) as year, product(1 + ret) - 1 as annual_return, count(*) as n_months from monthly where ret is not null group by 1, 2 having count(*) >= 6)"


def _annual(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "month").alias("d")).agg((F.sum(F.col("l_discount").cast("decimal(10,2)") - F.col("l_tax").cast("decimal(10,2)")).cast("double") / F.count(F.lit(1))).alias("ret"))
    return etl.annual_returns(m, "id", "d", "ret", 6)


@query(f"with {_ANNUAL} select id, year, {q('annual_return', 8)} as annual_return, n_months from annual")
def annual_returns(spark, sf):
    return _annual(spark, sf).select("id", "year", r("annual_return", "annual_return", 8), "n_months")


@query(f"with {_ANNUAL} select id, year, {q('annual_return', 8)} as annual_return, {q('lead(annual_return) over (partition by id order by year)', 8)} as forward_return from annual")
def forward_return(spark, sf):
    return etl.forward_returns(_annual(spark, sf), "id").select("id", "year", r("annual_return", "annual_return", 8), r("forward_return", "forward_return", 8))


@query(f"with {_ANNUAL} select n.n_name as nation, a.year, count(*) as n, {q('avg(a.annual_return)', 8)} as mean_return from annual a join supplier s on s.s_suppkey = a.id join nation n on n.n_nationkey = s.s_nationkey group by 1, 2")
def returns_by_nation(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("nation"))
    return _annual(spark, sf).join(s, "id").groupBy("nation", "year").agg(F.count(F.lit(1)).alias("n"), r(F.avg("annual_return"), "mean_return", 8))


@query("""with last as (select o_custkey as id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as priority from orders where o_orderpriority is not null group by 1)
select c_custkey as id, c_mktsegment as segment, priority from customer left join last on id = c_custkey""")
def latest_dim_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderpriority").alias("priority"))
    last = etl.latest_per_key(o, "id", "at", ["priority"])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")).join(last, "id", "left")


@query(f"""with spans as (select o_custkey as k, o_orderpriority as p, min(o_orderdate) as a, case when o_orderpriority like '1%' then null else max(o_orderdate) end as b from orders group by 1, 2)
select o_orderkey as id, p as link from orders join spans on o_custkey = k and a <= o_orderdate and (b is null or o_orderdate <= b)""")
def range_join_link(spark, sf):
    o = table(spark, sf, "orders")
    spans = o.groupBy("o_custkey", F.col("o_orderpriority").alias("link")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).withColumn("b", F.when(~F.col("link").startswith("1"), F.col("b")))
    return etl.date_effective_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), spans, "o_custkey", "o_orderdate", "a", "b").select(F.col("o_orderkey").alias("id"), "link")


@query("""select l_orderkey as id, l_linenumber as line, strftime(max(o2.o_orderdate), '%Y-%m-%d') as prev_date from lineitem join orders o on o.o_orderkey = l_orderkey left join orders o2 on o2.o_custkey = o.o_custkey and o2.o_orderdate < o.o_orderdate group by 1, 2""")
def asof_prev(spark, sf):
    o = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d"))
    out = etl.previous_date(lines, o.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("x")), "k", "d", "x")
    return out.groupBy("id", "line").agg(F.date_format(F.max("prev_date"), "yyyy-MM-dd").alias("prev_date"))


@query("select c_custkey as id, count(o_orderkey) as n_orders from orders right join customer on c_custkey = o_custkey group by 1")
def right_join_monthly(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").groupBy(F.col("c_custkey").alias("id")).agg(F.count("o_orderkey").alias("n_orders"))


@query(f"""select {sql_norm_id('gvkey')} as gvkey, fyear, count(*) as n from fundamentals where coalesce(case when not isnan("at") then "at" end, case when not isnan(sale) then sale end, case when not isnan(ni) then ni end, case when not isnan(ceq) then ceq end) is not null group by 1, 2""")
def dropna_all(spark, sf):
    cols = ["at", "sale", "ni", "ceq"]
    return table(spark, sf, "fundamentals").dropna("all", subset=cols).groupBy(norm_id("gvkey").alias("gvkey"), "fyear").agg(F.count(F.lit(1)).alias("n"))


@query(f"select distinct {sql_norm_id('directorid_starting')} as directorid_starting from ceo_sample where {sql_norm_id('directorid_starting')} is not null")
def distinct_ids(spark, sf):
    return etl.distinct_ids(table(spark, sf, "ceo_sample"), "directorid_starting")


@query("select permco, cast(cast(floor(min(siccd) / 100) as integer) as varchar) as industry_id from panel_with_returns where siccd is not null and permco is not null group by permco")
def industry_code(spark, sf):
    p = table(spark, sf, "panel_with_returns").where("siccd is not null and permco is not null").select("permco", "siccd")
    return etl.first_per_key(p, ["permco"], ["siccd"]).select("permco", F.floor(F.col("siccd") / 100).cast("string").alias("industry_id"))


@query()
def keyed_sample(spark, sf):
    """A reproducible sample of a thousand edges, by hash of the row."""
    e = table(spark, sf, "raw_edges").select(F.xxhash64("dirid_starting", "dirid_connected", "start_year", "loaded_at").alias("key"), "start_year")
    return etl.keyed_sample(e, "key", 1000)


@query("select * from (select cast(year(o_orderdate) as integer) as year, o_orderpriority, o_totalprice from orders) pivot (count(*) for o_orderpriority in ('1-URGENT' as p1, '2-HIGH' as p2, '3-MEDIUM' as p3) group by year)")
def priority_pivot(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).agg(F.count(F.lit(1)))
    return p.select("year", *[F.coalesce(c, F.lit(0)).alias(a) for c, a in (("1-URGENT", "p1"), ("2-HIGH", "p2"), ("3-MEDIUM", "p3"))])


# ---------------------------------------------------------------- temporal graph
_CORE = f"core as (select {sql_norm_id('dirid_starting')} as s, {sql_norm_id('dirid_connected')} as t, cast(start_year as bigint) as a, cast(end_year as bigint) as b from raw_edges where start_year is not null and {sql_norm_id('dirid_starting')} is not null and {sql_norm_id('dirid_connected')} is not null)"
_ENDS = ("s", "t", "a", "b")


def _core(spark, sf):
    e = graph.edges_core(table(spark, sf, "raw_edges"), "dirid_starting", "dirid_connected", "start_year", "end_year")
    return e.toDF(*_ENDS)


@query(f"with {_CORE} select s as dirid_starting, t as dirid_connected, a as start_year, b as end_year from core")
def edges_core(spark, sf):
    return _core(spark, sf).toDF("dirid_starting", "dirid_connected", "start_year", "end_year")


@query(f"with {_CORE} select distinct s as source, t as target from core where a <= {ASOF}")
def asof_edges_cumulative(spark, sf):
    return graph.asof_edges(_core(spark, sf), ASOF, "cumulative", *_ENDS).toDF("source", "target")


@query(f"with {_CORE} select distinct s as source, t as target from core where a <= {ASOF} and (b is null or b >= {ASOF})")
def asof_edges_active(spark, sf):
    return graph.asof_edges(_core(spark, sf), ASOF, "active", *_ENDS).toDF("source", "target")


@query(f"""with {_CORE}, p as (select s, t, min(a) as y from core group by s, t), n as (select s, y, count(*) as k from p where y between {FIRST} and {LAST} group by s, y),
g as (select s, unnest(generate_series({FIRST}, {LAST})) as y from (select distinct s from core))
select g.s as dirid_starting, cast(g.y as integer) as year, cast(sum(coalesce(k, 0)) over (partition by g.s order by g.y) as bigint) as n_unique_connected from g left join n on n.s = g.s and n.y = g.y""")
def connection_panel(spark, sf):
    return graph.connection_panel(_core(spark, sf), "s", "t", "a", FIRST, LAST).withColumnRenamed("s", "dirid_starting")


def _sql_pairs(mode: str) -> str:
    u = "least(s, t) as x, greatest(s, t) as z"
    if mode == "cumulative":
        return f"pairs as (select unnest(generate_series(greatest(y, {FIRST}), {LAST})) as year, x, z from (select {u}, min(a) as y from core group by 1, 2) where y <= {LAST})"
    return f"pairs as (select distinct unnest(generate_series(lo, hi)) as year, x, z from (select distinct {u}, greatest(a, {FIRST}) as lo, least(coalesce(b, {LAST}), {LAST}) as hi from core) where lo <= hi)"


_ADJ = "adj as (select year, x as i, z as j from pairs where x <> z union all select year, z, x from pairs where x <> z), deg as (select year, i, count(*) as d from adj group by 1, 2), nd as (select distinct year, unnest([x, z]) as i from pairs), sz as (select year, count(*) as n from nd group by 1)"


def _degree(mode: str) -> str:
    return f"with {_CORE}, {_sql_pairs(mode)}, {_ADJ} select cast(nd.year as integer) as year, nd.i as node_id, coalesce(d, 0) as degree, {q('case when n > 1 then coalesce(d, 0) / (n - 1) else 0 end', 9)} as degree_centrality from nd join sz using (year) left join deg on deg.year = nd.year and deg.i = nd.i"


def _pairs(spark, sf, mode):
    return graph.yearly_pairs(_core(spark, sf), mode, FIRST, LAST, *_ENDS)


@query(_degree("cumulative"))
def degree_cumulative(spark, sf):
    return graph.degrees(_pairs(spark, sf, "cumulative"), ["year"]).select("year", "node_id", "degree", r("degree_centrality", "degree_centrality", 9))


@query(_degree("active"))
def degree_active(spark, sf):
    return graph.degrees(_pairs(spark, sf, "active"), ["year"]).select("year", "node_id", "degree", r("degree_centrality", "degree_centrality", 9))


#: Triangles once, by least, middle and greatest id, with the years that the three pairs share.
_TRIANGLES = """tri as (select p1.x as i, p1.z as j, p2.z as k, {years} from once p1 join once p2 on p2.x = p1.z join once p3 on p3.x = p1.x and p3.z = p2.z)"""
_LOCAL = f"""ty as (select i, j, k, year from tri, years where {{there}}),
dy as (select year, i, d from deg),
t as (select year, n as i, count(*) as t from (select year, unnest([i, j, k]) as n from ty) group by 1, 2),
six as (select year, unnest([{{{{'i': i, 'j': j, 'q': k}}}}, {{{{'i': i, 'j': k, 'q': j}}}}, {{{{'i': j, 'j': i, 'q': k}}}}, {{{{'i': j, 'j': k, 'q': i}}}}, {{{{'i': k, 'j': i, 'q': j}}}}, {{{{'i': k, 'j': j, 'q': i}}}}]) as s from ty),
via as (select six.year, s.i as i, s.j as j, sum(1.0 / d) as v from six join dy on dy.year = six.year and dy.i = s.q group by 1, 2, 3),
con as (select adj.year, adj.i, sum(power((1 + coalesce(v, 0)) / d, 2)) as c from adj join dy on dy.year = adj.year and dy.i = adj.i left join via on via.year = adj.year and via.i = adj.i and via.j = adj.j group by 1, 2),
local_metrics as (select cast(nd.year as integer) as year, nd.i as node_id, coalesce(d, 0) as degree, case when n > 1 then coalesce(d, 0) / (n - 1) else 0 end as degree_centrality, case when coalesce(d, 0) >= 2 then 2 * coalesce(t, 0) / (d * (d - 1)) else 0 end as clustering,
case when coalesce(d, 0) >= 2 then d - 2 * coalesce(t, 0) / d else coalesce(d, 0) end as effective_size, c as network_constraint, 1 / c as brokerage
from nd join sz using (year) left join dy on dy.year = nd.year and dy.i = nd.i left join t on t.year = nd.year and t.i = nd.i left join con on con.year = nd.year and con.i = nd.i)"""


def _sql_local(mode: str) -> str:
    """CTEs down to local_metrics, after core."""
    years = f"years as (select cast(unnest(generate_series({FIRST}, {LAST})) as integer) as year)"
    if mode == "cumulative":
        once = f"once as (select least(s, t) as x, greatest(s, t) as z, min(a) as y from core where s <> t group by 1, 2 having min(a) <= {LAST})"
        shared, there = "greatest(p1.y, p2.y, p3.y) as y", "year >= y"
    else:
        once = f"once as (select x, z, bit_or(1::bigint << cast(year - {FIRST} as integer)) as m from pairs where x <> z group by 1, 2)"
        shared, there = "p1.m & p2.m & p3.m as m", f"(m >> (year - {FIRST})) & 1 = 1"
    return f"{_sql_pairs(mode)}, {_ADJ}, {years}, {once}, {_TRIANGLES.format(years=shared)}, {_LOCAL.format(there=there)}"


_LOCAL_OUT = f"select year, node_id, degree, {q('clustering', 8)} as clustering, {q('effective_size', 8)} as effective_size, {q('network_constraint', 8)} as network_constraint, {q('brokerage', 6)} as brokerage from local_metrics"


def _local_panel(spark, sf, mode):
    return graph.local_metrics_of_years(graph.yearly_masks(_core(spark, sf), mode, FIRST, LAST, *_ENDS), FIRST, LAST)


def _local(spark, sf, mode):
    return _local_panel(spark, sf, mode).select("year", "node_id", "degree", r("clustering", "clustering", 8), r("effective_size", "effective_size", 8), r("network_constraint", "network_constraint", 8), r("brokerage", "brokerage", 6))


@query(f"with {_CORE}, {_sql_local('active')} {_LOCAL_OUT}")
def local_metrics_active(spark, sf):
    return _local(spark, sf, "active")


@query(f"with {_CORE}, {_sql_local('cumulative')} {_LOCAL_OUT}")
def local_metrics_cumulative(spark, sf):
    return _local(spark, sf, "cumulative")


def _snapshot(spark, sf):
    """Undirected pairs of all edges begun by the last year."""
    e = graph.asof_edges(_core(spark, sf), LAST, "cumulative", *_ENDS)
    return e.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _sql_pagerank() -> str:
    """x = 1 + 0.85 P'x by plain iteration, scaled to sum 1; a link of weight 0 to itself keeps nodes without neighbours."""
    return f"""with recursive {_CORE}, pairs as (select distinct least(s, t) as x, greatest(s, t) as z from core where a <= {LAST}),
adj as (select x as i, z as j from pairs where x <> z union all select z, x from pairs where x <> z), deg as (select i, count(*) as d from adj group by 1), nd as (select distinct unnest([x, z]) as i from pairs),
links as materialized (select adj.i, adj.j, 0.85 / d as w from adj join deg on deg.i = adj.i union all select i, i, 0.0 from nd),
it as (select 0 as step, i, 1.0::double as x from nd union all select step + 1, j, 1.0 + sum(x * w) from it join links on links.i = it.i where step < {ROUNDS} group by 1, 2)
select i as node_id, {q('x / sum(x) over ()', 9)} as pagerank from it where step = {ROUNDS}"""


@query(_sql_pagerank())
def pagerank(spark, sf):
    return graph.pagerank(_snapshot(spark, sf), []).select("node_id", r("pagerank", "pagerank", 9))


@query()
def eigenvector(spark, sf):
    return graph.eigenvector(_snapshot(spark, sf), [])


@query()
def closeness(spark, sf):
    return graph.closeness(_snapshot(spark, sf)).select("node_id", r("closeness", "closeness", 9))


@query()
def betweenness(spark, sf):
    return graph.betweenness(_snapshot(spark, sf)).select("node_id", r("betweenness", "betweenness", 9))
