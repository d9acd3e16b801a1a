"""Queries of features, research, econometrics and portfolios over two panels made from the order tables.

The yearly panel has a row per customer and order year, the monthly one per customer and order month: factor is
the ordered value, cap the customer's balance, industry the market segment, ret the mean of discount less tax.
Sums are taken in decimals, so that both engines start from equal numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.operators import econometrics, features, portfolio, research

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def panel(spark: SparkSession, sf: str, by: str = "year") -> DataFrame:
    date = F.year("o_orderdate") if by == "year" else F.date_format("o_orderdate", "yyyy-MM")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), date.alias("date"), F.col("o_totalprice").cast("decimal(15,2)").alias("price"))
    # lines are merged per order before they meet the orders, and both per customer and date
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_discount").cast("decimal(10,2)") - F.col("l_tax").cast("decimal(10,2)")).alias("d"), F.count(F.lit(1)).alias("k"))
    p = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").groupBy("date", "entity").agg(F.sum("price").cast("double").alias("factor"), F.try_divide(F.sum("d").cast("double"), F.sum("k").cast("double")).alias("ret"), F.count(F.lit(1)).cast("double").alias("orders"))
    return p.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("cap"), F.col("c_mktsegment").alias("industry")), "entity", "left")


def _sql_panel(by: str = "year") -> str:
    date = "year(o_orderdate)" if by == "year" else "strftime(o_orderdate, '%Y-%m')"
    return f"""panel as (select p.date, p.entity, p.factor, p.ret, p.orders, c.c_acctbal as cap, c.c_mktsegment as industry from (
  select cast({date} as {'integer' if by == 'year' else 'varchar'}) as date, o_custkey as entity, cast(sum(cast(o_totalprice as decimal(15,2))) as double) as factor, cast(sum(d) as double) / cast(sum(k) as double) as ret, cast(count(*) as double) as orders
  from orders left join (select l_orderkey, sum(cast(l_discount as decimal(10,2)) - cast(l_tax as decimal(10,2))) as d, count(*) as k from lineitem group by 1) l on o_orderkey = l_orderkey group by 1, 2) p
  left join customer c on c.c_custkey = p.entity)"""


Y, M = _sql_panel("year"), _sql_panel("month")


def r(c, alias: str | None = None, digits: int = 6):
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, digits) + F.lit(0.0)
    return out.alias(alias) if alias else out


def q(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- features
@query(f"with {Y}, e as (select *, quantile_cont(factor, 0.01) over (partition by date) as lo, quantile_cont(factor, 0.99) over (partition by date) as hi from panel) select date, entity, {q('greatest(least(factor, hi), lo)', 2)} as w from e")
def winsorize_xs(spark, sf):
    return features.winsorize(panel(spark, sf), "factor", "w", ["date"]).select("date", "entity", r("w", "w", 2))


@query(f"with {Y}, e as (select quantile_cont(factor, 0.05) as lo, quantile_cont(factor, 0.95) as hi from panel) select date, entity, {q('greatest(least(factor, hi), lo)', 2)} as w from panel, e")
def winsorize_global(spark, sf):
    return features.winsorize(panel(spark, sf), "factor", "w", None, 0.05, 0.95).select("date", "entity", r("w", "w", 2))


_Z = "(factor - avg(factor) over (partition by date)) / nullif(stddev_pop(factor) over (partition by date), 0)"


@query(f"with {Y} select date, entity, {q(_Z)} as z from panel")
def zscore_xs(spark, sf):
    return features.zscore(panel(spark, sf), "factor", "z", ["date"]).select("date", "entity", r("z", "z"))


@query(f"with {Y} select date, entity, {q('(factor - avg(factor) over ()) / stddev_pop(factor) over ()')} as z from panel")
def zscore_global(spark, sf):
    return features.zscore(panel(spark, sf), "factor", "z").select("date", "entity", r("z", "z"))


@query(f"with {Y}, z as (select *, {_Z} as z from panel) select date, entity, case when industry is not null then {q('z - avg(z) over (partition by date, industry)')} end as n from z")
def group_neutralize(spark, sf):
    p = features.zscore(panel(spark, sf), "factor", "z", ["date"])
    return features.group_neutralize(p, "z", "n", ["date", "industry"]).select("date", "entity", r("n", "n"))


_NEUTRAL = "z - avg(z) over d - coalesce(covar_pop(z, s) over d / nullif(var_pop(s) over d, 0), 0) * (s - avg(s) over d)"


@query(f"with {Y}, z as (select *, {_Z} as z, ln(greatest(cap, 1e-9)) as s from panel where cap is not null) select date, entity, {q(_NEUTRAL)} as n from z window d as (partition by date)")
def cap_neutralize(spark, sf):
    p = features.zscore(panel(spark, sf), "factor", "z", ["date"])
    return features.size_neutralize(p, "z", "cap", "n", ["date"]).where("cap is not null").select("date", "entity", r("n", "n"))


@query(f"with {Y} select date, entity, {q('lag(factor) over (partition by entity order by date)', 2)} as lagged from panel")
def lag_feature(spark, sf):
    return features.lag_feature(panel(spark, sf), "factor", "lagged", "entity", ["date"]).select("date", "entity", r("lagged", "lagged", 2))


def _sql_rank(x: str, by: str) -> str:
    has = f"({x} is not null)"
    return f"case when {x} is not null then (rank() over (partition by {by}, {has} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) end"


@query(f"with {Y} select date, entity, {q(_sql_rank('orders', 'date') + ' / count(orders) over (partition by date)')} as pct from panel")
def pct_rank(spark, sf):
    return features.rank_feature(panel(spark, sf), "orders", "pct", ["date"]).select("date", "entity", r("pct", "pct"))


def _sql_bucket(x: str, n: int, w: str) -> str:
    """Two steps: edges e (to be computed as quantile lists over w), then the bucket."""
    edges = ", ".join(str(i / n) for i in range(n + 1))
    return f"list_distinct(quantile_cont({x}, [{edges}]) over {w})"


def _sql_of(x: str) -> str:
    return f"case when {x} is null or len(e) < 2 then null when {x} = list_min(e) then 1 else len(list_filter(e, lambda v: v < {x})) end"


@query(f"with {Y}, b as (select *, {_sql_bucket('factor', 5, '(partition by date)')} as e from panel) select date, entity, cast({_sql_of('factor')} as integer) as bucket from b")
def qcut_buckets(spark, sf):
    return features.quantile_buckets(panel(spark, sf), "factor", "bucket", ["date"], 5).select("date", "entity", "bucket")


@query(f"""with {Y}, b as (select *, {_sql_bucket('factor', 3, '(partition by date, industry)')} as e, {_sql_bucket('cap', 3, '(partition by date, industry)')} as e2 from panel)
select date, entity, cast({_sql_of('factor')} as integer) - 1 as q_factor, cast({_sql_of('cap').replace('(e', '(e2')} as integer) - 1 as q_cap from b""")
def nested_qcut(spark, sf):
    from tidewheel.operators.etl import nested_buckets

    return nested_buckets(panel(spark, sf), ["factor", "cap"], ["date", "industry"], 3).select("date", "entity", "q_factor", "q_cap")


@query(f"""with {Y} select 'factor' as feature, count(*) as n, count(*) - count(factor) as n_null, {q('(count(*) - count(factor)) / count(*)')} as null_share, count(distinct factor) as n_unique,
{q('avg(factor)', 2)} as mean, {q('stddev_samp(factor)', 2)} as std, min(factor) as min, max(factor) as max, count(distinct factor) > 1 and (count(*) - count(factor)) / count(*) <= 0.2 as passed from panel""")
def validate_feature(spark, sf):
    return features.validate_feature(panel(spark, sf), "factor").select("feature", "n", "n_null", r("null_share", "null_share"), "n_unique", r("mean", "mean", 2), r("std", "std", 2), "min", "max", "passed")


_PIPE = f"""{Y}, a as (select *, ln(1 + greatest(factor, 0)) as x from panel), b as (select *, quantile_cont(x, 0.01) over (partition by date) as lo, quantile_cont(x, 0.99) over (partition by date) as hi from a),
c as (select *, greatest(least(x, hi), lo) as w from b), d as (select *, (w - avg(w) over (partition by date)) / nullif(stddev_pop(w) over (partition by date), 0) as z from c),
e as (select *, coalesce(case when industry is not null then z - avg(z) over (partition by date, industry) end, z) as n from d),
f as (select *, case when cap is not null then ln(greatest(cap, 1e-9)) end as s, case when cap is not null then n end as y from e),
g as (select *, coalesce(case when s is not null then n - avg(y) over t - coalesce(covar_pop(y, s) over t / nullif(var_pop(s) over t, 0), 0) * (s - avg(s) over t) end, n) as k from f window t as (partition by date)),
h as (select *, lag(k) over (partition by entity order by date) as lagged from g)"""


@query(f"with {_PIPE} select date, entity, {q('w')} as factor_w, {q('z')} as factor_z, {q('n')} as factor_ind_neutral, {q('k')} as factor_cap_neutral, {q('lagged')} as factor_lagged, {q(_sql_rank('round(lagged, 9)', 'date') + ' / count(lagged) over (partition by date)')} as factor_rank from h")
def feature_pipeline(spark, sf):
    p = features.feature_pipeline(panel(spark, sf), ["factor", "absent"], "date", "entity", "industry", "cap", ("factor",))
    return p.select("date", "entity", *[r(f"factor_{s}", f"factor_{s}") for s in ("w", "z", "ind_neutral", "cap_neutral", "lagged", "rank")])


@query()
def pca_scores(spark, sf):
    """Scores and ranks of three components of four columns."""
    out, _ = features.pca_composites(panel(spark, sf), ["factor", "ret", "orders", "cap"], 3, "date")
    for i in (1, 2, 3):
        out = features.rank_feature(out, f"pc{i}", f"pc{i}_rank", ["date"])
    return out.select("date", "entity", *[r(f"pc{i}{s}", f"pc{i}{s}") for i in (1, 2, 3) for s in ("", "_rank")])


@query()
def pca_loadings(spark, sf):
    """Loadings and the explained share of variance, with its running sum."""
    _, load = features.pca_composites(panel(spark, sf), ["factor", "ret", "orders", "cap"], 3, "date")
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return load.withColumn("cumulative_variance", F.sum("explained_variance_ratio").over(w))


# ---------------------------------------------------------------- research
_CORR = "case when count(*) filter ({x} is not null and {y} is not null) >= 3 then covar_pop({x}, {y}) / nullif(stddev_pop(case when {y} is not null then {x} end) * stddev_pop(case when {x} is not null then {y} end), 0) end"
_IC = f"select date, {_CORR.format(x='factor', y='ret')} as ic from panel group by date"


@query(f"with {M}, i as ({_IC}) select date, {q('ic')} as ic from i")
def ic(spark, sf):
    return research.information_coefficient(panel(spark, sf, "month"), "factor", "ret", "date").select("date", r("ic", "ic"))


_PAIRS = f"pairs as (select date, factor as x, ret as y from panel where factor is not null and ret is not null), ranked as (select date, {_sql_rank('x', 'date')} as rx, {_sql_rank('y', 'date')} as ry from pairs)"
_RIC = f"{_PAIRS}, i as (select d.date, ic from (select distinct date from panel) d left join (select date, {_CORR.format(x='rx', y='ry')} as ic from ranked group by date) using (date))"


@query(f"with {M}, {_RIC} select date, {q('ic')} as ic from i")
def rank_ic(spark, sf):
    return research.rank_ic(panel(spark, sf, "month"), "factor", "ret", "date").select("date", r("ic", "ic"))


_SUM = f"select {q('avg(ic)')} as mean_ic, {q('stddev_pop(ic)')} as std_ic, {q('avg(case when ic > 0 then 1.0 when ic <= 0 then 0.0 end)')} as pct_positive, count(ic) as n, {q('avg(ic) / nullif(stddev_pop(ic), 0)')} as icir from i"


@query(f"with {M}, {_RIC} {_SUM}")
def ic_summary(spark, sf):
    out = research.ic_summary(research.rank_ic(panel(spark, sf, "month"), "factor", "ret", "date"))
    return out.select(*[r(c, c) for c in ("mean_ic", "std_ic", "pct_positive")], "n", r("icir", "icir"))


_HORIZONS = " union all ".join(f"select {h} as horizon, date, factor as x, case when count(ret) over w{h} = {h} then product(1 + ret) over w{h} - 1 end as y from panel window w{h} as (partition by entity order by date rows between current row and {h - 1} following)" for h in range(1, 13))


@query(f"""with {Y}, every as ({_HORIZONS}), pairs as (select horizon, date, x, round(y, 12) as y from every where x is not null and y is not null),
ranked as (select horizon, date, {_sql_rank('x', 'horizon, date')} as rx, {_sql_rank('y', 'horizon, date')} as ry from pairs),
i as (select d.horizon, d.date, ic from (select distinct horizon, date from every) d left join (select horizon, date, {_CORR.format(x='rx', y='ry')} as ic from ranked group by horizon, date) c on c.horizon = d.horizon and c.date = d.date)
{_SUM.replace('select ', 'select horizon, ', 1)} group by horizon""")
def factor_decay(spark, sf):
    out = research.factor_decay(panel(spark, sf), "factor", "ret", "date", "entity", 12, digits=12)
    return out.select("horizon", *[r(c, c) for c in ("mean_ic", "std_ic", "pct_positive")], "n", r("icir", "icir"))


_B = f"b as (select *, {_sql_bucket('factor', 5, '(partition by date)')} as e from panel), k as (select *, cast({_sql_of('factor')} as integer) as bucket from b)"
_QR = "qr as (select date, bucket, avg(ret) as ret, count(ret) as n from k where bucket is not null group by date, bucket)"


@query(f"with {M}, {_B}, {_QR} select date, bucket, {q('ret')} as ret, n from qr")
def quantile_returns(spark, sf):
    return research.quantile_returns(panel(spark, sf, "month"), "factor", "ret", "date").select("date", "bucket", r("ret", "ret"), "n")


@query(f"with {M}, {_B} select date, bucket, {q('sum(case when ret is not null then orders * ret end) / nullif(sum(case when ret is not null then orders end), 0)')} as ret, count(ret) as n from k where bucket is not null group by date, bucket")
def quantile_returns_vw(spark, sf):
    return research.quantile_returns(panel(spark, sf, "month"), "factor", "ret", "date", 5, "orders").select("date", "bucket", r("ret", "ret"), "n")


@query(f"with {M}, {_B}, {_QR} select date, " + ", ".join(f"{q(f'max(case when bucket = {i} then ret end)')} as q{i}" for i in range(1, 6)) + " from qr group by date")
def quantile_matrix(spark, sf):
    out = research.quantile_matrix(research.quantile_returns(panel(spark, sf, "month"), "factor", "ret", "date"), "date")
    return out.select("date", *[r(f"q{i}", f"q{i}") for i in range(1, 6)])


_LS = f"{_B}, {_QR}, ls as (select date, max(case when bucket = (select max(bucket) from qr) then ret end) - max(case when bucket = 1 then ret end) as ret from qr group by date)"


def _long_short(spark, sf):
    return research.long_short(research.quantile_returns(panel(spark, sf, "month"), "factor", "ret", "date"), "date")


@query(f"with {M}, {_LS} select date, {q('ret')} as ret from ls")
def long_short(spark, sf):
    return _long_short(spark, sf).select("date", r("ret", "ret"))


_GROW = "s as (select *, product(1 + ret) over (order by date rows unbounded preceding) as growth from ls where ret is not null), t as (select *, max(growth) over (order by date rows unbounded preceding) as peak from s)"


@query(f"with {M}, {_LS}, {_GROW} select {q('avg(ret) * 12')} as ann_return, {q('stddev_pop(ret) * sqrt(12)')} as ann_vol, {q('avg(ret) * 12 / nullif(stddev_pop(ret) * sqrt(12), 0)')} as sharpe, {q('min(growth / peak - 1)')} as max_drawdown, {q('arg_max(growth, date) - 1')} as cumulative_return, count(*) as n from t")
def performance_stats(spark, sf):
    out = research.performance_stats(_long_short(spark, sf), "date")
    return out.select(*[r(c, c) for c in ("ann_return", "ann_vol", "sharpe", "max_drawdown", "cumulative_return")], "n")


@query(f"with {M}, {_LS} select date, {q('case when count(ret) over w = 12 then avg(ret) over w / nullif(stddev_pop(ret) over w, 0) * sqrt(12) end')} as sharpe from ls window w as (order by date rows between 11 preceding and current row)")
def rolling_sharpe(spark, sf):
    return research.rolling_sharpe(_long_short(spark, sf), "date", 12).select("date", r("sharpe", "sharpe"))


@query(f"with {M}, {_RIC} select date, {q('ic')} as ic, {q('case when count(ic) over w = 12 then avg(ic) over w end')} as ic_ma from i window w as (order by date rows between 11 preceding and current row)")
def ic_moving_average(spark, sf):
    out = research.rolling_mean(research.rank_ic(panel(spark, sf, "month"), "factor", "ret", "date"), "date", 12, "ic", "ic_ma")
    return out.select("date", r("ic", "ic"), r("ic_ma", "ic_ma"))


@query(f"with {M}, {_LS} select date, {q('product(1 + coalesce(ret, 0)) over (order by date rows unbounded preceding)')} as growth from ls")
def cumulative_growth(spark, sf):
    return research.cumulative(_long_short(spark, sf), "date", nulls_as_zero=True).select("date", r("growth", "growth"))


_COLS = ["factor", "ret", "orders", "cap"]


@query(f"with {Y} " + " union all ".join(f"select '{a}' as col_x, '{b}' as col_y, {q(_CORR.format(x=a, y=b))} as corr from panel" for a in _COLS for b in _COLS))
def corr_matrix(spark, sf):
    return research.correlation_pairs(panel(spark, sf), _COLS).select("col_x", "col_y", r("corr", "corr"))


@query(f"with {Y}, e as (select min(factor) as lo, max(factor) as hi from panel), b as (select cast(least(coalesce(floor((factor - lo) / nullif((hi - lo) / 50, 0)), 0) + 1, 50) as integer) as bin, count(*) as n from panel, e where factor is not null group by 1), every as (select cast(unnest(generate_series(1, 50)) as integer) as bin) select every.bin, {q('lo + (every.bin - 1) * (hi - lo) / 50', 4)} as low, coalesce(n, 0) as n from e, every left join b on b.bin = every.bin")
def histogram(spark, sf):
    return research.histogram(panel(spark, sf), "factor", 50).select("bin", r("low", "low", 4), "n")


@query(f"""with {Y}, e as (select min(factor) as lo, max(factor) as hi, stddev_samp(factor) * power(count(factor), -0.2) as h, count(factor) as n from panel), g as (select cast(unnest(generate_series(0, 199)) as integer) as k)
select {q('lo + (hi - lo) * (k / 199)', 2)} as x, {q('sum(exp(-0.5 * power((factor - lo - (hi - lo) * (k / 199)) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) * 1e6', 6)} as density from panel, e, g where factor is not null group by k, lo, hi""")
def kernel_density(spark, sf):
    """Density of the factor at 200 points, in millionths."""
    return research.kernel_density(panel(spark, sf), "factor").select(r("x", "x", 2), r(F.col("density") * 1e6, "density"))


_FACTORS = ["factor", "orders", "cap"]


@query(f"""with {M}, long as ({' union all '.join(f"select '{f}' as name, date, {f} as x, ret as y from panel" for f in _FACTORS)}),
pairs as (select * from long where x is not null and y is not null), ranked as (select name, date, {_sql_rank('x', 'name, date')} as rx, {_sql_rank('y', 'name, date')} as ry from pairs),
i as (select name, date, {_CORR.format(x='rx', y='ry')} as ic from ranked group by name, date)
select name, case when name like 'pc%' then 'composite' when contains(name, '_active_') then 'active' else 'other' end as category, {q('avg(ic)')} as mean_ic, {q('avg(ic) / nullif(stddev_pop(ic), 0)')} as icir, count(ic) as n from i group by name""")
def factor_landscape(spark, sf):
    """All factors in one long job, with their category, best first."""
    p = panel(spark, sf, "month")
    long = p.select("date", "ret", F.inline(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("x")) for f in _FACTORS])))
    s = research.ic_summary(research.rank_ic(long, "x", "ret", "date", ["name"]), ["name"])
    kind = F.when(F.col("name").startswith("pc"), "composite").when(F.col("name").contains("_active_"), "active").otherwise("other")
    return s.select("name", kind.alias("category"), r("mean_ic", "mean_ic"), r("icir", "icir"), "n").orderBy(F.col("icir").desc())


_SIGNAL = f"""{_PIPE}, sig as (select date, {_sql_rank('round(lagged, 9)', 'date')} / count(lagged) over (partition by date) as x, lead(ret) over (partition by entity order by date) as y from h),
pairs as (select * from sig where x is not null and y is not null), ranked as (select date, {_sql_rank('x', 'date')} as rx, {_sql_rank('y', 'date')} as ry from pairs),
i as (select date, {_CORR.format(x='rx', y='ry')} as ic from ranked group by date)"""


@query(f"with {_SIGNAL} {_SUM}")
def signal_quality(spark, sf):
    """The whole way: features of the factor, rank IC with the next year's return, and its summary."""
    p = features.feature_pipeline(panel(spark, sf), ["factor"], "date", "entity", "industry", "cap", ("factor",))
    p = p.withColumn("next_ret", F.lead("ret").over(Window.partitionBy("entity").orderBy("date")))
    out = research.ic_summary(research.rank_ic(p, "factor_rank", "next_ret", "date"))
    return out.select(*[r(c, c) for c in ("mean_ic", "std_ic", "pct_positive")], "n", r("icir", "icir"))


# ---------------------------------------------------------------- econometrics
_SCALED = "scaled as (select date, entity, industry, ret as y, factor / 100000 as x, orders as x2, cap / 1000 as x3 from panel)"


def _scaled(spark, sf, by="year"):
    return panel(spark, sf, by).select("date", "entity", "industry", F.col("ret").alias("y"), (F.col("factor") / 100000).alias("x"), F.col("orders").alias("x2"), (F.col("cap") / 1000).alias("x3"))


def _sql_ols(by: str) -> str:
    """One regressor: sums, coefficients and t-statistics per date."""
    return f"""s as (select {by}, count(*) as n, regr_slope(y, x) as b, avg(x) as mx, avg(y) as my, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy from scaled where x is not null and y is not null group by {by}),
o as (select {by}, my - b * mx as a, b, (syy - sxy * sxy / sxx) as rss, * exclude ({by}, b) from s where n > 2 and sxx > 0)"""


_OLS1 = _sql_ols("date")


@query(f"with {Y}, {_SCALED}, {_OLS1} select date, {q('a')} as coef_const, {q('b')} as coef_x, {q('a / sqrt(rss / (n - 2) * (1 / n + mx * mx / sxx))', 5)} as tstat_const, {q('b / sqrt(rss / (n - 2) / sxx)', 5)} as tstat_x, {q('1 - rss / syy')} as r_squared, n as n_obs from o")
def ols_univariate(spark, sf):
    out = econometrics.simple_regression(_scaled(spark, sf), "y", "x", "date")
    return out.select("date", r("coef_const", "coef_const"), r("coef_x", "coef_x"), r("tstat_const", "tstat_const", 5), r("tstat_x", "tstat_x", 5), r("r_squared", "r_squared"), "n_obs")


_OLS2 = """m as (select date, count(*) as n, avg(y) as my, avg(x) as m1, avg(x2) as m2, var_pop(x) as c11, var_pop(x2) as c22, covar_pop(x, x2) as c12, covar_pop(x, y) as c1, covar_pop(x2, y) as c2, var_pop(y) as cy from scaled where x is not null and x2 is not null and y is not null group by date),
o as (select *, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) as b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) as b2 from m where n > 3 and c11 * c22 - c12 * c12 > 0),
f as (select *, my - b1 * m1 - b2 * m2 as a, n * (cy - b1 * c1 - b2 * c2) as rss from o)"""


@query(f"with {Y}, {_SCALED}, {_OLS2} select date, {q('a')} as coef_const, {q('b1')} as coef_x, {q('b2')} as coef_x2, {q('b1 / sqrt(rss / (n - 3) * c22 / (n * (c11 * c22 - c12 * c12)))', 4)} as tstat_x, {q('b2 / sqrt(rss / (n - 3) * c11 / (n * (c11 * c22 - c12 * c12)))', 4)} as tstat_x2, {q('a / sqrt(rss / (n - 3) / n * (1 + (m1 * m1 * c22 - 2 * m1 * m2 * c12 + m2 * m2 * c11) / (c11 * c22 - c12 * c12)))', 4)} as tstat_const, {q('1 - rss / (n * cy)')} as r_squared, n as n_obs from f")
def ols_multi(spark, sf):
    out = econometrics.cross_sectional_regression(_scaled(spark, sf), "y", ["x", "x2"], "date")
    return out.select("date", r("coef_const", "coef_const"), r("coef_x", "coef_x"), r("coef_x2", "coef_x2"), r("tstat_x", "tstat_x", 4), r("tstat_x2", "tstat_x2", 4), r("tstat_const", "tstat_const", 4), r("r_squared", "r_squared"), "n_obs")


def _sql_nw(of: str, by: str, lags: int = 3) -> str:
    """Newey-West mean of column v of `of`, grouped by `by`."""
    part = f"partition by {by}" if by else ""
    group = f"group by {by}" if by else ""
    lead = f"{by}, " if by else ""
    products = ", ".join(f"u * lag(u, {j}) over ({part} order by date) as p{j}" for j in range(1, lags + 1))
    weights = " + ".join(f"2 * (1 - {j} / {lags + 1}.0) * coalesce(sum(p{j}), 0)" for j in range(1, lags + 1))
    return f"""u as (select {lead}date, v, v - avg(v) over ({part}) as u from {of} where v is not null), p as (select *, u * u as p0, {products} from u),
nw as (select {lead}avg(v) as mean, sqrt(greatest(sum(p0) + {weights}, 0)) / count(v) as se, count(v) as n from p {group})"""


#: Two-sided normal tail of {t} by Simpson's rule.
_TAIL = "(1 - 2 / sqrt(2 * pi()) * abs({t}) / 3000 * (select sum(case when i in (0, 1000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-0.5 * power(abs({t}) * i / 1000, 2))) from (select unnest(generate_series(0, 1000)) as i)))"
_NW_OUT = f"{q('mean')} as mean, {q('se')} as se, {q('mean / nullif(se, 0)', 4)} as tstat, {q(_TAIL.format(t='(mean / nullif(se, 0))'))} as pvalue, n"


def _nw_cols():
    return [r("mean", "mean"), r("se", "se"), r("tstat", "tstat", 4), r("pvalue", "pvalue"), "n"]


@query(f"with {M}, {_SCALED}, {_OLS1}, long as (select 'const' as variable, date, a as v from o union all select 'x', date, b from o), {_sql_nw('long', 'variable')} select variable, {_NW_OUT} from nw")
def fama_macbeth(spark, sf):
    return econometrics.fama_macbeth(_scaled(spark, sf, "month"), "y", ["x"], "date").select("variable", *_nw_cols())


@query(f"with {Y}, {_SCALED}, {_OLS2}, long as (select 'const' as variable, date, a as v from f union all select 'x', date, b1 from f union all select 'x2', date, b2 from f), {_sql_nw('long', 'variable')} select variable, {_NW_OUT} from nw")
def fama_macbeth_multi(spark, sf):
    return econometrics.fama_macbeth(_scaled(spark, sf), "y", ["x", "x2"], "date").select("variable", *_nw_cols())


@query(f"""with {Y}, {_SCALED}, {_OLS1}, {_OLS2.replace('m as', 'm2_ as', 1).replace('from m where', 'from m2_ where').replace('o as (', 'o2 as (').replace('from o)', 'from o2)')},
long as (select 0 as spec, 'none' as controls, date, b as v from o union all select 1, 'x2', date, b1 from f), {_sql_nw('long', 'spec, controls')} select spec, controls, 'x' as variable, {_NW_OUT} from nw""")
def robustness(spark, sf):
    return econometrics.robustness_test(_scaled(spark, sf), "y", ["x"], "date", [[], ["x2"]]).select("spec", "controls", "variable", *_nw_cols())


@query(f"with {Y}, {_SCALED}, {_sql_ols('industry, date')}, long as (select 'const' as variable, industry, date, a as v from o union all select 'x', industry, date, b from o), {_sql_nw('long', 'industry, variable')} select industry, variable, {_NW_OUT} from nw where industry is not null")
def subsample_fm(spark, sf):
    return econometrics.subsample_analysis(_scaled(spark, sf), "y", ["x"], "date", "industry").select("industry", "variable", *_nw_cols())


_GRID = {"lower": [0.01, 0.05], "upper": [0.95, 0.99]}
_SENSE = " union all ".join(f"select '{lo}' as lower, '{hi}' as upper, date, y, greatest(least(x, quantile_cont(x, {hi}) over d), quantile_cont(x, {lo}) over d) as x from scaled where x is not null window d as (partition by date)" for lo in _GRID["lower"] for hi in _GRID["upper"])


@query(f"""with {Y}, scaled0 as (select date, ret as y, factor / 100000 as x from panel), scaled as (with scaled as (select * from scaled0) {_SENSE}), {_sql_ols('lower, upper, date')},
long as (select 'const' as variable, lower, upper, date, a as v from o union all select 'x', lower, upper, date, b from o), {_sql_nw('long', 'lower, upper, variable')} select lower, upper, variable, {_NW_OUT} from nw""")
def sensitivity(spark, sf):
    """Fama-MacBeth after winsorising at each pair of a grid."""
    def transform(df, lower, upper):
        return features.winsorize(df, "x", "x", ["date"], lower, upper)

    return econometrics.sensitivity_analysis(_scaled(spark, sf), "y", ["x"], "date", _GRID, transform).select("lower", "upper", "variable", *_nw_cols())


@query(f"""with {Y}, {_SCALED}, d as (select date, row_number() over (order by date) as i, count(*) over () as k from (select distinct date from panel)),
split as (select s.*, d.i > cast(floor(d.k * 0.7) as integer) as test from scaled s join d using (date) where x is not null and y is not null),
fit as (select regr_slope(y, x) as b, avg(y) - regr_slope(y, x) * avg(x) as a, regr_r2(y, x) as r2, count(*) as n from split where not test)
select any_value(fit.n) as n_train, count(*) as n_test, {q('any_value(r2)')} as in_sample_r2, {q('1 - sum((y - a - b * x) * (y - a - b * x)) / regr_syy(y, y)')} as oos_r2 from split, fit where test""")
def oos_r2(spark, sf):
    return econometrics.out_of_sample(_scaled(spark, sf), "y", ["x"], "date").select("n_train", "n_test", r("in_sample_r2", "in_sample_r2"), r("oos_r2", "oos_r2"))


# ---------------------------------------------------------------- portfolios
@query(f"with {M} select date, entity, {q('1.0 / count(entity) over (partition by date)')} as weight from panel")
def equal_weight(spark, sf):
    return portfolio.equal_weights(panel(spark, sf, "month"), "date", "entity").select("date", "entity", r("weight", "weight"))


@query(f"with {M} select date, entity, {q('factor / nullif(sum(factor) over (partition by date), 0)')} as weight from panel")
def value_weight(spark, sf):
    return portfolio.value_weights(panel(spark, sf, "month"), "date", "factor").select("date", "entity", r("weight", "weight"))


_W = "w as (select date, entity, avg(weight) as weight from (select date, entity, factor / nullif(sum(factor) over (partition by date), 0) as weight from panel) where weight is not null group by date, entity)"


def _weights(spark, sf):
    return portfolio.weight_table(portfolio.value_weights(panel(spark, sf, "month"), "date", "factor"), "date", "entity")


_NEXT = "nxt as (select date, lead(date) over (order by date) as next, row_number() over (order by date) as i from (select distinct date from w)), mv as (select date as d, entity, weight from w union all select next, entity, -weight from w join nxt using (date) where next is not null), ch as (select d as date, entity, sum(weight) as c from mv group by d, entity)"


@query(f"with {M}, {_W}, {_NEXT} select date, {q('case when i = 1 then 0 else sum(abs(c)) / 2 end')} as turnover from ch join nxt using (date) group by date, i")
def turnover(spark, sf):
    return portfolio.turnover(_weights(spark, sf), "date", "entity").select("date", r("turnover", "turnover"))


@query(f"with {M}, {_W}, {_NEXT} select date, {q('case when i = 1 then 0 else sum(abs(c)) end')} as turnover, {q('case when i = 1 then 0 else sum(abs(c)) * 10 / 10000 end')} as cost from ch join nxt using (date) group by date, i")
def transaction_cost(spark, sf):
    return portfolio.transaction_costs(_weights(spark, sf), "date", "entity").select("date", r("turnover", "turnover"), r("cost", "cost"))


_ATT = f"{_W}, {_NEXT}, con as (select n.next as date, w.entity, w.weight * p.ret as c from w join nxt n using (date) join panel p on p.date = n.next and p.entity = w.entity where n.next is not null), att as (select d.date, coalesce(sum(c), 0) as ret from (select distinct date from panel) d left join con using (date) group by d.date)"


@query(f"with {M}, {_ATT} select date, {q('ret', 8)} as total_return from att")
def attribution(spark, sf):
    return portfolio.attribution(_weights(spark, sf), panel(spark, sf, "month"), "date", "entity").select("date", r("total_return", "total_return", 8))


@query(f"with {M}, {_ATT} select entity, {q('avg(c)', 8)} as mean_contribution from con group by entity order by 2 desc, entity limit 10")
def top_contributors(spark, sf):
    c = portfolio.contributions(_weights(spark, sf), panel(spark, sf, "month"), "date", "entity")
    return portfolio.top_contributors(c, "entity", digits=8)


@query(f"""with {M}, {_LS}, v as (select quantile_cont(ret, 0.05) as v from ls) select {q('stddev_pop(ret) * sqrt(12)')} as ann_vol, {q('coalesce(stddev_pop(case when ret < 0 then ret end) * sqrt(12), 0)')} as downside_dev,
{q('any_value(v)')} as var, {q('avg(case when ret <= v then ret end)')} as cvar, count(ret) as n from ls, v where ret is not null""")
def risk_metrics(spark, sf):
    return portfolio.risk_metrics(_long_short(spark, sf)).select(*[r(c, c) for c in ("ann_vol", "downside_dev", "var", "cvar")], "n")


@query(f"with {M}, k as (select *, ({_sql_rank('factor', 'date')}) / count(factor) over (partition by date) as rk from panel) select date, entity, {q('1.0 / count(entity) over (partition by date)')} as weight from k where rk > 0.8")
def long_only_book(spark, sf):
    p = features.rank_feature(panel(spark, sf, "month"), "factor", "rk", ["date"])
    return portfolio.equal_weights(portfolio.long_only_book(p, "rk", 5, 5), "date", "entity").select("date", "entity", r("weight", "weight"))


@query(f"with {M}, {_W} select {q('avg(k)')} as avg_holdings from (select date, count(*) filter (weight > 0) as k from w group by date)")
def average_holdings(spark, sf):
    return portfolio.average_holdings(_weights(spark, sf), "date").select(r("avg_holdings", "avg_holdings"))


@query("select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, strftime(max(o_orderdate), '%Y-%m-%d') as rebalance_date from orders where o_orderdate is not null group by 1")
def month_end_dates(spark, sf):
    out = portfolio.month_end_dates(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")), "d")
    return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("month", "rebalance_date")])


@query(f"""with {Y}, n as (select *, greatest(1, floor(count(*) over (partition by date) / 10)) as size, row_number() over (partition by date order by factor desc, entity) as hi, row_number() over (partition by date order by factor, entity) as lo from panel where factor is not null)
select date, entity, case when hi <= size then 'high' else 'low' end as side from n where hi <= size or lo <= size""")
def sorted_groups(spark, sf):
    return portfolio.sorted_groups(panel(spark, sf), "factor", ["date"], 10, ["entity"]).select("date", "entity", "side")


_GROW_ATT = _GROW.replace("from ls where", "from att where")


@query(f"with {M}, {_ATT}, {_GROW_ATT} select {q('avg(ret) * 12')} as ann_return, {q('stddev_pop(ret) * sqrt(12)')} as ann_vol, {q('avg(ret) * 12 / nullif(stddev_pop(ret) * sqrt(12), 0)', 5)} as sharpe, {q('min(growth / peak - 1)')} as max_drawdown, {q('arg_max(growth, date) - 1')} as cumulative_return, count(*) as n, {q('quantile_cont(ret, 0.05)')} as var, (select {q('avg(t)')} from (select date, case when any_value(i) = 1 then 0 else sum(abs(c)) / 2 end as t from ch join nxt using (date) group by date)) as avg_turnover from t")
def benchmark_report(spark, sf):
    """Performance, risk and average turnover of the whole universe, weighted by value."""
    series = portfolio.attribution(_weights(spark, sf), panel(spark, sf, "month"), "date", "entity").withColumnRenamed("total_return", "ret")
    out = research.performance_stats(series, "date").drop("n").crossJoin(F.broadcast(portfolio.risk_metrics(series).select("var", "n")))
    out = out.crossJoin(F.broadcast(portfolio.turnover(_weights(spark, sf), "date", "entity").agg(F.avg("turnover").alias("avg_turnover"))))
    return out.select(*[r(c, c) for c in ("ann_return", "ann_vol")], r("sharpe", "sharpe", 5), *[r(c, c) for c in ("max_drawdown", "cumulative_return")], "n", r("var", "var"), r("avg_turnover", "avg_turnover"))


@query(f"with {M}, {_SCALED}, {_OLS1}, g as (select date, b / sqrt(rss / (n - 2) / sxx) as t from o) select count(*) as n_dates, cast(count(*) filter (abs(t) > 1.96) as bigint) as n_significant, cast(count(*) filter (t > 1.96) as bigint) as n_positive from g")
def significance_counts(spark, sf):
    """Dates on which the regression's slope is significant."""
    t = econometrics.simple_regression(_scaled(spark, sf, "month"), "y", "x", "date")
    return t.agg(F.count(F.lit(1)).alias("n_dates"), F.count_if(F.abs("tstat_x") > 1.96).alias("n_significant"), F.count_if(F.col("tstat_x") > 1.96).alias("n_positive"))
