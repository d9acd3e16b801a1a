"""Queries over the real panels: network metrics joined to the panel, features of all columns, and the runs over all factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.ids import norm_id, sql_norm_id
from tidewheel.functions.stats import clean
from tidewheel.operators import etl, factor_runs, features, graph, research
from tidewheel.plans import relations
from tidewheel.plans.panels import _CORR, _TAIL, _sql_bucket, _sql_nw, _sql_of, _sql_rank, q, r
from tidewheel.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Names of the metrics in the panel.
METRICS = {"degree_centrality": "degree_centrality", "effective_size": "structural_holes_effective_size", "network_constraint": "network_constraint", "brokerage": "brokerage_measure"}
ITERATIVE = {"eigenvector_centrality": "eigenvector_centrality", "pagerank": "pagerank"}
#: Raw columns of the features, and those whose logarithm is taken; each metric once cumulative and once active.
RAW = ["n_unique_connected", *METRICS.values(), *[f"{c}_active" for c in METRICS.values()]]
LOGS = {"n_unique_connected", *[f"{c}{a}" for c in ("pagerank", "structural_holes_effective_size", "brokerage_measure") for a in ("", "_active")]}
#: Columns that put the rows of a director-year in order.
ORDER = ("gvkey", "companyid", "permco", "industry", "cap", "at", "sale", "n_unique_connected")
CONTROLS = ["cap", "at", "sale"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "panel_with_returns").select(
        F.col("year").alias("date"), norm_id("dirid_starting").alias("entity"), norm_id("gvkey").alias("gvkey"), "companyid", "permco",
        F.floor(F.col("siccd") / 100).cast("string").alias("industry"), clean("mkvalt").alias("cap"), clean("at").alias("at"), clean("sale").alias("sale"),
        F.col("n_unique_connected").cast("double").alias("n_unique_connected"), clean("forward_return").alias("ret"),
    )
    return p.where("entity is not null and date is not null")


_PANEL = f"""panel as (select year as date, {sql_norm_id('dirid_starting')} as entity, {sql_norm_id('gvkey')} as gvkey, companyid, permco, cast(cast(floor(siccd / 100) as bigint) as varchar) as industry,
  case when not isnan(mkvalt) then mkvalt end as cap, case when not isnan("at") then "at" end as "at", case when not isnan(sale) then sale end as sale, cast(n_unique_connected as double) as n_unique_connected, case when not isnan(forward_return) then forward_return end as ret
  from panel_with_returns where year is not null and {sql_norm_id('dirid_starting')} is not null)"""


def _with_network(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with the local metrics of both conventions, of the director at the year."""
    out = _panel(spark, sf)
    for mode, end in (("cumulative", ""), ("active", "_active")):
        m = relations._local_panel(spark, sf, mode).select(F.col("year").alias("date"), F.col("node_id").alias("entity"), *[F.col(c).alias(f"{n}{end}") for c, n in METRICS.items()])
        out = out.join(m, ["date", "entity"], "left")
    return out


_NETWORK = f"""lc as (with {relations._CORE}, {relations._sql_local('cumulative')} select * from local_metrics), la as (with {relations._CORE}, {relations._sql_local('active')} select * from local_metrics),
wide as (select panel.*, {', '.join(f'lc.{c} as {n}' for c, n in METRICS.items())}, {', '.join(f'la.{c} as {n}_active' for c, n in METRICS.items())}
  from panel left join lc on lc.year = panel.date and lc.node_id = panel.entity left join la on la.year = panel.date and la.node_id = panel.entity)"""


@query(f"with {_PANEL}, {_NETWORK} select date, entity, gvkey, {', '.join(f'{q(c, 6 if c.startswith(chr(98)) else 8)} as {c}' for c in RAW[1:])} from wide")
def panel_network(spark, sf):
    """The panel with both network panels."""
    return _with_network(spark, sf).select("date", "entity", "gvkey", *[r(c, c, 6 if c.startswith("b") else 8) for c in RAW[1:]])


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all raw columns; written once, since the runs read them for every report."""
    return checkpoint(features.feature_pipeline(checkpoint(_with_network(spark, sf)), RAW, "date", "entity", "industry", "cap", tuple(LOGS), ORDER, digits=9))


_LONG = " union all ".join(f"select '{c}' as name, date, entity, industry, cap, gvkey, companyid, permco, \"at\", sale, n_unique_connected, ret, {f'case when {c} is not null then ln(1 + greatest({c}, 0)) end' if c in LOGS else c} as x from wide" for c in RAW)
_FEATURES = f"""{_PANEL}, {_NETWORK}, a as ({_LONG}),
b as (select *, quantile_cont(x, 0.01) over d as lo, quantile_cont(x, 0.99) over d as hi from a window d as (partition by name, date)), c as (select *, case when x is not null then greatest(least(x, hi), lo) end as w from b),
z as (select *, (w - avg(w) over d) / nullif(stddev_pop(w) over d, 0) as z from c window d as (partition by name, date)),
n as (select *, coalesce(case when industry is not null then z - avg(z) over (partition by name, date, industry) end, z) as n from z),
s as (select *, case when cap is not null and n is not null then ln(greatest(cap, 1e-9)) end as s, case when cap is not null then n end as y from n),
k as (select *, coalesce(case when s is not null and count(s) over d >= 2 then n - avg(y) over d - coalesce(case when var_pop(s) over d > 1e-18 then covar_pop(y, s) over d / var_pop(s) over d end, 0) * (s - avg(s) over d) end, n) as k from s window d as (partition by name, date)),
l as (select *, lag(k) over (partition by name, entity order by date, {', '.join(f'"{c}" nulls first' for c in ORDER)}) as lagged from k),
feat as (select *, name || '_rank' as factor, {_sql_rank('round(lagged, 9)', 'name, date')} / count(lagged) over (partition by name, date) as rk from l)"""


@query(f"with {_FEATURES} select name, date, entity, {q('w')} as w, {q('z')} as z, {q('n')} as ind_neutral, {q('k')} as cap_neutral, {q('lagged')} as lagged, {q('rk')} as rank from feat")
def real_features(spark, sf):
    """All stages of the features of nine raw columns, as rows of (column, date, entity)."""
    stages = ["w", "z", "ind_neutral", "cap_neutral", "lagged", "rank"]
    cells = [F.struct(F.lit(c).alias("name"), *[F.col(f"{c}_{s}").alias(s) for s in stages]) for c in RAW]
    return _features(spark, sf).select("date", "entity", F.inline(F.array(*cells))).select("name", "date", "entity", *[r(s, s) for s in stages])


# ---------------------------------------------------------------- runs over all factors
def _research(spark, sf):
    p = _features(spark, sf)
    return factor_runs.research_run(p, factor_runs.discovered(p), "ret", "date", "entity", order=ORDER)


_R = f"{_FEATURES}, pairs as (select factor, date, rk as x, ret as y from feat where rk is not null and ret is not null), ranked as (select *, {_sql_rank('x', 'factor, date')} as rx, {_sql_rank('y', 'factor, date')} as ry from pairs)"
_ICS = f"""ics as (select d.factor, d.date, i.ic, i.rank_ic from (select distinct factor, date from feat) d left join (select factor, date, {_CORR.format(x='x', y='y')} as ic, {_CORR.format(x='rx', y='ry')} as rank_ic from ranked group by factor, date) i on i.factor = d.factor and i.date = d.date)"""
_QR = f"""qe as (select *, {_sql_bucket('rk', 5, '(partition by factor, date)')} as e from feat), qb as (select *, cast({_sql_of('rk')} as integer) as bucket from qe),
qr as (select factor, date, bucket, avg(ret) as ret, count(ret) as n from qb where bucket is not null group by all)"""
_LS = "ls as (select factor, date, max(case when bucket = 5 then ret end) - max(case when bucket = 1 then ret end) as ret from qr group by factor, date)"


def _sql_growth(of: str) -> str:
    w = "over (partition by factor order by date rows unbounded preceding)"
    return f"g1 as (select *, product(1 + ret) {w} as growth from {of} where ret is not null), g2 as (select *, max(growth) {w} as peak from g1)"


@query(f"with {_R}, {_ICS} select factor, date, {q('ic')} as ic, {q('rank_ic')} as rank_ic from ics")
def factor_ics(spark, sf):
    """IC and rank IC of every factor and date, joined."""
    return _research(spark, sf)["ic_timeseries"].select("factor", "date", r("ic", "ic"), r("rank_ic", "rank_ic"))


@query(f"with {_FEATURES}, {_QR} select factor, date, 'Q' || bucket as label, {q('ret', 9)} as ret, n from qr")
def factor_quantiles(spark, sf):
    return _research(spark, sf)["quantile_returns"].select("factor", "date", "label", r("ret", "ret", 9), "n")


_COMPARED = f"""{_R}, {_ICS}, {_QR}, {_LS}, {_sql_growth('ls')}, perf as (select factor, avg(ret) as ann_return, avg(ret) / nullif(stddev_pop(ret), 0) as sharpe, min(growth / peak - 1) as max_drawdown from g2 group by factor),
compared as (select i.*, p.sharpe as long_short_sharpe, p.ann_return as long_short_ann_return, p.max_drawdown as long_short_max_drawdown from (select factor, avg(ic) as mean_ic, avg(rank_ic) as mean_rank_ic, avg(rank_ic) / nullif(stddev_pop(rank_ic), 0) as rank_icir from ics group by factor) i left join perf p using (factor))"""
_COMPARED_COLS = ["mean_ic", "mean_rank_ic", "rank_icir", "long_short_sharpe", "long_short_ann_return", "long_short_max_drawdown"]


@query(f"with {_COMPARED} select factor, {', '.join(f'{q(c)} as {c}' for c in _COMPARED_COLS)} from compared")
def factor_comparison(spark, sf):
    """One row per factor: information coefficients and the long-short portfolio."""
    return _research(spark, sf)["comparison"].select("factor", *[r(c, c) for c in _COMPARED_COLS])


def _regressions(spark, sf):
    p = _features(spark, sf)
    return factor_runs.econometrics_run(p, factor_runs.discovered(p), "ret", "date", CONTROLS)



_OLS = """scaled as (select factor, date, ret as y, rk as x from feat), su as (select factor, date, count(*) as n, regr_slope(y, x) as b, avg(x) as mx, avg(y) as my, regr_sxx(y, x) as sxx from scaled where x is not null and y is not null group by factor, date),
ols as (select factor, date, b, my - b * mx as a from su where n > 2 and sxx > 0), series as (select factor, 'const' as variable, date, a as v from ols union all select factor, 'value', date, b from ols)"""
_FM = f"{_OLS}, {_sql_nw('series', 'factor, variable')}, fm as (select *, mean / nullif(se, 0) as tstat from nw)"
_SPLIT = """days as (select date, row_number() over (order by date) as i, count(*) over () as k from (select distinct date from feat)), split as (select s.*, d.i > cast(floor(d.k * 0.7) as integer) as test from scaled s join days d using (date) where x is not null and y is not null),
fit as (select factor, regr_slope(y, x) as b, avg(y) - regr_slope(y, x) * avg(x) as a from split where not test group by factor),
oos as (select factor, 1 - sum((y - a - b * x) * (y - a - b * x)) / regr_syy(y, y) as oos_r2 from split join fit using (factor) where test group by factor)"""
_REGRESSED = f"{_FM}, {_SPLIT}, regressed as (select factor, mean as mean_coef, tstat as t_stat, {_TAIL.format(t='tstat')} as p_value, oos_r2 from fm left join oos using (factor) where variable = 'value')"


@query(f"with {_FEATURES}, {_FM} select factor, variable, {q('mean')} as mean, {q('se')} as se, {q('tstat', 4)} as tstat, {q(_TAIL.format(t='tstat'))} as pvalue, n from fm")
def factor_fama_macbeth(spark, sf):
    """Fama-MacBeth of every factor, constant and p-value included."""
    return _regressions(spark, sf)["fama_macbeth"].select("factor", "variable", r("mean", "mean"), r("se", "se"), r("tstat", "tstat", 4), r("pvalue", "pvalue"), "n")


@query()
def factor_robustness(spark, sf):
    """Fama-MacBeth of every factor without and with controls."""
    return _regressions(spark, sf)["robustness"]


@query()
def factor_multivariate(spark, sf):
    """Fama-MacBeth of all factors at once."""
    return _regressions(spark, sf)["multivariate"]


_CATEGORY = "case when factor like 'pc%' then 'PCA composite' when factor = 'n_unique_connected_rank' then 'Connection count' when contains(factor, '_active_') then 'Active' else 'Cumulative' end"


@query(f"with {_COMPARED}, {_REGRESSED} select factor, {_CATEGORY} as category, {q('long_short_sharpe')} as long_short_sharpe, {q('rank_icir')} as rank_icir, {q('t_stat', 4)} as t_stat, {q('p_value')} as p_value, {q('oos_r2')} as oos_r2, p_value < 0.05 as significant from compared left join regressed using (factor)")
def real_landscape(spark, sf):
    """Every factor with its category, portfolio, regression and significance."""
    out = factor_runs.landscape(_research(spark, sf)["comparison"], _regressions(spark, sf)["comparison"])
    return out.select("factor", "category", r("long_short_sharpe", "long_short_sharpe"), r("rank_icir", "rank_icir"), r("t_stat", "t_stat", 4), r("p_value", "p_value"), r("oos_r2", "oos_r2"), "significant")


def _books(spark, sf):
    p = _features(spark, sf)
    return factor_runs.long_only_run(p, factor_runs.discovered(p), "ret", "date", "entity")


_BOOKS = f"""top as (select factor, date, entity, ret, 1.0 / count(entity) over (partition by factor, date) as weight from feat where rk > 0.8),
bw as (select factor, date, entity, avg(weight) as weight, avg(ret) as ret from top group by all), bd as (select factor, date, lead(date) over (partition by factor order by date) as next, min(date) over (partition by factor) as first from (select distinct factor, date from bw)),
mv as (select factor, date as d, entity, weight from bw union all select bw.factor, next, entity, -weight from bw join bd on bd.factor = bw.factor and bd.date = bw.date where next is not null),
bt as (select bd.factor, bd.date, case when bd.date = bd.first then 0 else coalesce(t, 0) end as turnover from bd left join (select factor, d, sum(abs(c)) / 2 as t from (select factor, d, entity, sum(weight) as c from mv group by all) group by all) x on x.factor = bd.factor and x.d = bd.date),
ba as (select bd.factor, bd.date, coalesce(c.ret, 0) as ret from bd left join (select h.factor, h.next as date, sum(h.weight * b.ret) as ret from (select bw.*, next from bw join bd on bd.factor = bw.factor and bd.date = bw.date) h join bw b on b.factor = h.factor and b.date = h.next and b.entity = h.entity group by all) c on c.factor = bd.factor and c.date = bd.date),
{_sql_growth('ba')}, bv as (select factor, quantile_cont(ret, 0.05) as var from ba group by factor),
books as (select factor, avg(ret) as ann_return, stddev_pop(ret) as ann_vol, avg(ret) / nullif(stddev_pop(ret), 0) as sharpe, min(growth / peak - 1) as max_drawdown, arg_max(growth, date) - 1 as cumulative_return, coalesce(stddev_pop(case when ret < 0 then ret end), 0) as downside_dev, any_value(var) as var, avg(case when ret <= var then ret end) as cvar from g2 join bv using (factor) group by factor)"""
_BOOK_COLS = ["ann_return", "ann_vol", "sharpe", "max_drawdown", "cumulative_return", "downside_dev", "var", "cvar"]


@query(f"with {_FEATURES}, {_BOOKS} select b.factor, {q('t.v')} as avg_turnover, {q('h.v')} as avg_holdings, {', '.join(f'{q(c)} as {c}' for c in _BOOK_COLS)} from books b join (select factor, avg(turnover) as v from bt group by 1) t using (factor) join (select factor, avg(k) as v from (select factor, date, count(*) filter (weight > 0) as k from bw group by all) group by 1) h using (factor)")
def long_only_comparison(spark, sf):
    """Book of the highest fifth of every factor: turnover, holdings, performance and risk."""
    return _books(spark, sf)["comparison"].select("factor", r("avg_turnover", "avg_turnover"), r("avg_holdings", "avg_holdings"), *[r(c, c) for c in _BOOK_COLS])


@query(f"with {_COMPARED.replace('g1 as', 's1 as').replace('from g1)', 'from s1)').replace('g2 as', 's2 as').replace('from g2', 'from s2')}, {_BOOKS} select compared.factor, {q('long_short_sharpe')} as long_short_sharpe, {q('books.sharpe')} as long_only_sharpe, {q('t.v')} as avg_turnover, {q('books.max_drawdown')} as max_drawdown from compared left join books on books.factor = compared.factor left join (select factor, avg(turnover) as v from bt group by 1) t on t.factor = compared.factor")
def long_only_vs_long_short(spark, sf):
    out = factor_runs.books_against_spreads(_research(spark, sf)["comparison"], _books(spark, sf)["comparison"])
    return out.select("factor", *[r(c, c) for c in ("long_short_sharpe", "long_only_sharpe", "avg_turnover", "max_drawdown")])


@query()
def real_pca(spark, sf):
    """Reports of the ranks of three composites of all lagged factors."""
    return factor_runs.pca_run(_features(spark, sf), "date")[2]


#: Rows of the sample; smaller tables are taken whole.
SAMPLE = 50_000


@query(f"with {_FEATURES}, ranks as (select date, entity, {', '.join(f'''max(case when name = '{c}' then k end) as {c}''' for c in RAW[:5])} from (select *, row_number() over (partition by name, date, entity order by {', '.join(f'"{c}" nulls first' for c in ORDER)}, ret nulls first) as i from feat) group by date, entity, i) " + " union all ".join(f"select '{a}_cap_neutral' as col_x, '{b}_cap_neutral' as col_y, {q(_CORR.format(x=a, y=b))} as corr from ranks" for a in RAW[:5] for b in RAW[:5]))
def sampled_correlation(spark, sf):
    """Correlations of five neutralised columns over a reproducible sample of the panel."""
    p = _features(spark, sf).withColumn("key", F.xxhash64("date", "entity", *ORDER))
    return research.correlation_pairs(etl.keyed_sample(p, "key", SAMPLE), [f"{c}_cap_neutral" for c in RAW[:5]]).select("col_x", "col_y", r("corr", "corr"))


# ---------------------------------------------------------------- network panels with the iterative metrics
def _network_panel(spark, sf, mode):
    return graph.network_panel(relations._core(spark, sf), mode, relations.FIRST, relations.LAST, *relations._ENDS)


@query()
def network_panel_cumulative(spark, sf):
    """All metrics that scale, of every year, over all edges begun by it."""
    return _network_panel(spark, sf, "cumulative")


@query()
def network_panel_active(spark, sf):
    """All metrics that scale, of every year, over the edges of that year."""
    return _network_panel(spark, sf, "active")


# ---------------------------------------------------------------- returns and industries
_ANNUAL = f"annual as (select permco, year, max(annual_return) as annual_return, max(forward_return) as forward_return from panel_with_returns where permco is not null and annual_return is not null and not isnan(annual_return) group by 1, 2), links as (select distinct permco, {sql_norm_id('gvkey')} as gvkey from linking_table where permco is not null and {sql_norm_id('gvkey')} is not null), by_firm as (select gvkey, year, annual_return, forward_return from annual join links using (permco))"


@query(f"with {_ANNUAL} select {sql_norm_id('m.dirid_starting')} as dirid_starting, m.year, {sql_norm_id('m.gvkey')} as gvkey, {q('annual_return')} as annual_return, {q('forward_return')} as forward_return from merged_panel m left join by_firm f on f.gvkey = {sql_norm_id('m.gvkey')} and f.year = m.year")
def panel_returns(spark, sf):
    """Annual returns linked to firms, and these to the panel."""
    a = table(spark, sf, "panel_with_returns").where("permco is not null and annual_return is not null and not isnan(annual_return)").groupBy("permco", "year").agg(F.max("annual_return").alias("annual_return"), F.max("forward_return").alias("forward_return"))
    links = table(spark, sf, "linking_table").select("permco", norm_id("gvkey").alias("gvkey")).where("permco is not null and gvkey is not null")
    panel = table(spark, sf, "merged_panel").select(norm_id("dirid_starting").alias("dirid_starting"), "year", norm_id("gvkey").alias("gvkey"))
    out = etl.merge_returns(panel, etl.linked_returns(a, links, "permco", "gvkey"), "gvkey", "year")
    return out.select("dirid_starting", "year", "gvkey", r("annual_return", "annual_return"), r("forward_return", "forward_return"))


@query(f"with dim as (select permco, cast(cast(floor(min(siccd) / 100) as bigint) as varchar) as industry_id from panel_with_returns where siccd is not null and permco is not null group by permco) select {sql_norm_id('dirid_starting')} as dirid_starting, year, permco, industry_id from merged_panel left join dim using (permco)")
def panel_industry(spark, sf):
    """The panel with the industry of its company."""
    codes = table(spark, sf, "panel_with_returns").where("siccd is not null and permco is not null").select("permco", "siccd")
    dim = etl.first_per_key(codes, ["permco"], ["siccd"]).select("permco", F.floor(F.col("siccd") / 100).cast("string").alias("industry_id"))
    return table(spark, sf, "merged_panel").join(dim, "permco", "left").select(norm_id("dirid_starting").alias("dirid_starting"), "year", "permco", "industry_id")
