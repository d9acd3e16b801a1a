"""Queries of the general record problems 1, 2, 3, 4 and 7, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.ids import is_deleted, is_open_end, norm_id, sql_deleted, sql_norm_id, text_date
from tidewheel.operators.asof import known_at
from tidewheel.operators.intervals import merged_intervals
from tidewheel.operators.keyed_selection import frequent_values, per_key_profile, per_key_quantiles
from tidewheel.operators.mixture_fill import fill_missing, fit_report
from tidewheel.operators.orphans import reference_status
from tidewheel.operators.skew import skew_safe_left_join

#: Problem 1: the share of all rows from which an id counts as frequent.
FREQUENT = 0.03
#: Problem 2: numbers are missing unless within these; years that a donor may be away; valid industry codes.
AMOUNT, YEARS_AWAY, CODES = (0.0, 10_000_000.0), 2, (100, 8999)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- problem 1
def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """One row per id column and usable id of raw_edges; the table is read once."""
    e = table(spark, sf, "raw_edges").select(norm_id("dirid_starting").alias("s"), norm_id("dirid_connected").alias("c"), "start_year")
    side = lambda name, own, other: F.struct(F.lit(name).alias("id_field"), F.col(own).alias("dir_id"), F.col(other).alias("partner"), F.col("start_year"))
    return e.select(F.inline(F.array(side("dirid_starting", "s", "c"), side("dirid_connected", "c", "s")))).where("dir_id is not null")


def _code(c: str):
    """A bigint for an id: itself up to 18 digits, else a negative hash."""
    return F.when(F.length(c) <= 18, F.col(c).try_cast("bigint")).otherwise(-F.abs(F.xxhash64(c) % F.lit(2**62)) - 1)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    ids = _ids(spark, sf).select("id_field", "dir_id", _code("dir_id").alias("code"))
    total = table(spark, sf, "raw_edges").count()
    got = frequent_values(ids, ["id_field"], "code", FREQUENT, total)
    out = spark.createDataFrame([(f, str(c)) for f, c, _ in got if c > 0], "id_field string, dir_id string")
    if hashed := [(f, c) for f, c, _ in got if c < 0]:  # exact check of ids too long for a bigint
        few = F.broadcast(spark.createDataFrame(hashed, "id_field string, code bigint"))
        long = ids.join(few, ["id_field", "code"], "left_semi").groupBy("id_field", "dir_id").count()
        out = out.unionByName(long.where(F.col("count") >= FREQUENT * total).select("id_field", "dir_id"))
    return out


def p1_per_id(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct partners, first and median start year of every usable id in either column."""
    ids = _ids(spark, sf).select(F.concat_ws(":", "id_field", "dir_id").alias("k"), "partner", "start_year")
    profile = per_key_profile(ids, "k", "partner", "start_year", "k").withColumnRenamed("first_when", "first_year")
    median = per_key_quantiles(ids, ["k"], "start_year", [0.5]).select("k", F.col("start_year").alias("median_year"))
    out = profile.join(median, "k", "left")
    return out.select(F.split("k", ":")[0].alias("id_field"), F.split("k", ":")[1].alias("dir_id"), "n_rows", "n_partners", "first_year", "median_year")


# ---------------------------------------------------------------- problem 2
#: Problem 2: the fields of each table.
FIELDS = {"merged_panel": ["mkvalt", "sale"], "panel_with_returns": ["mkvalt", "sale", "siccd"]}


def _panel(spark: SparkSession, sf: str, name: str) -> tuple:
    """A table with its ids in normal form, and the other arguments of the operators of problem 2."""
    fields = FIELDS[name]
    df = table(spark, sf, name).select(norm_id("dirid_starting").alias("dirid_starting"), norm_id("gvkey").alias("gvkey"), "year", *fields)
    return df, "gvkey", "year", {"mkvalt": AMOUNT, "sale": AMOUNT}, YEARS_AWAY, *(("siccd", CODES) if "siccd" in fields else (None, None))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The marks of all values that the fitted mixture fills."""

    def cases(name: str, fields: list[str]) -> DataFrame:
        marks = F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in fields])
        return fill_missing(*_panel(spark, sf, name)).select(F.lit(name).alias("table_name"), F.explode(F.array_compact(marks)).alias("field"), "dirid_starting", "gvkey", "year")

    return cases("merged_panel", ["mkvalt", "sale"]).unionByName(cases("panel_with_returns", ["siccd"])).distinct()


def p2_filled(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of panel_with_returns with given or filled values and their marks."""
    out = fill_missing(*_panel(spark, sf, "panel_with_returns"))
    return out.select("dirid_starting", "gvkey", "year", *[F.round(f"{c}_value", 4).alias(f"{c}_value") for c in ("mkvalt", "sale")], "siccd_value", "mkvalt_filled", "sale_filled", "siccd_filled")


def p2_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Passes, likelihood and convergence of the model of each table."""
    first, second = (fit_report(*_panel(spark, sf, name)).select(F.lit(name).alias("table_name"), "*") for name in FIELDS)
    return first.unionByName(second)


def p2_heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the fill is better than the group's: every value is guessed from all other records.

    baseline is the mean absolute error of the log of the donors' mean for numbers, and the share of wrong modes of the
    group's other records for the category; better tells that the fill's is smaller (for the category, not greater).
    """
    out = None
    for name, fields in FIELDS.items():
        df, *how = _panel(spark, sf, name)
        own = lambda c: F.when((F.col(c) > AMOUNT[0]) & (F.col(c) < AMOUNT[1]), F.col(c).cast("double"))
        got = fill_missing(df, *how, guess=True)
        got = got.withColumns({f"{c}_own": own(c) for c in ("mkvalt", "sale")}).withColumn("t", F.col("year").cast("bigint"))
        sums = [g(f"{c}_own").alias(f"{c}_{g.__name__}") for c in ("mkvalt", "sale") for g in (F.sum, F.count)]
        near = got.where("gvkey is not null").groupBy("gvkey", "t").agg(*sums).withColumn("t", F.explode(F.sequence(F.col("t") - YEARS_AWAY, F.col("t") + YEARS_AWAY)))
        near = near.groupBy("gvkey", "t").agg(*[F.sum(f"{c}_{g}").alias(f"{c}_{g}") for c in ("mkvalt", "sale") for g in ("sum", "count")])
        both = skew_safe_left_join(got, near, ["gvkey", "t"])
        error = lambda e, c: F.abs(F.log(e) - F.log(f"{c}_own"))
        rows = []
        for c in ("mkvalt", "sale"):
            mean = F.when(F.col(f"{c}_own").isNotNull() & (F.col(f"{c}_count") > 1), F.try_divide(F.col(f"{c}_sum") - F.col(f"{c}_own"), F.col(f"{c}_count") - 1))
            rows.append(F.struct(F.lit(c).alias("field"), error(mean, c).alias("base"), F.when(mean.isNotNull(), error(F.col(f"{c}_guess"), c)).alias("mine")))
        each = both.select(F.inline(F.array(*rows)))
        if "siccd" in fields:
            each = each.unionByName(_code_errors(got))
        r = each.where("base is not null").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("base").alias("base"), F.avg("mine").alias("mine"))
        r = r.select(F.lit(name).alias("table_name"), "field", "n", F.round("base", 6).alias("baseline"), F.when(F.col("field") == "siccd", F.col("mine") <= F.col("base")).otherwise(F.col("mine") < F.col("base")).alias("better"))
        out = r if out is None else out.unionByName(r)
    return out


def _code_errors(got: DataFrame) -> DataFrame:
    """field, base, mine: whether the mode of the group's other records, and the guess, differ from a row's code."""
    code = got.where(F.col("gvkey").isNotNull() & F.col("siccd").between(*CODES)).groupBy("gvkey", "siccd").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("siccd_guess") != F.col("siccd")).alias("wrong"))
    pairs = code.select("gvkey", "siccd", "k", "wrong").join(code.select("gvkey", F.col("siccd").alias("other"), F.col("k").alias("n")), "gvkey")
    left = F.col("n") - F.when(F.col("other") == F.col("siccd"), 1).otherwise(0)
    best = pairs.where(left > 0).groupBy("gvkey", "siccd", "k", "wrong").agg(F.max(F.struct(left.alias("n"), (-F.col("other")).alias("other"))).alias("b"))
    return best.select(F.lit("siccd").alias("field"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("k"))).alias("i"), (F.col("b.other") != -F.col("siccd")).cast("double").alias("base"), "wrong").select("field", "base", (F.col("i") <= F.col("wrong")).cast("double").alias("mine"))


# ---------------------------------------------------------------- problem 3
def _filings(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fundamentals").where("fyear is not null and filed_on is not null and mkvalt > 0 and mkvalt < 10000000")
    year = F.greatest(F.least("fyear", F.lit(9999)), F.lit(1))
    return f.select(norm_id("gvkey").alias("gvkey"), "fyear", "filed_on", "mkvalt", F.greatest("filed_on", F.make_date(year, F.lit(1), F.lit(1))).alias("available"))


def _year_end(c: str = "year"):
    return F.when(F.col(c).between(1, 9999), F.make_date(F.greatest(F.least(c, F.lit(9999)), F.lit(1)), F.lit(12), F.lit(31)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "merged_panel").where("mkvalt > 0 and mkvalt < 10000000").select(norm_id("dirid_starting").alias("dirid_starting"), norm_id("gvkey").alias("gvkey"), "year", "mkvalt", _year_end().alias("day"))
    known = known_at(rows.where("gvkey is not null"), _filings(spark, sf), "gvkey", "day", "available", ["fyear", "filed_on"], ["mkvalt"])
    return known.where(F.col("known_mkvalt").isNull() | (F.abs(F.col("mkvalt") - F.col("known_mkvalt")) > 0.0005)).select("dirid_starting", "gvkey", "year").distinct()


def p3_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Each director-year of connection_count_panel with its companies and the filing known at the year's end."""
    panel = table(spark, sf, "connection_count_panel").select(norm_id("dirid_starting").alias("dirid_starting"), "year").where("dirid_starting is not null").distinct()
    company = table(spark, sf, "merged_panel").select(norm_id("dirid_starting").alias("dirid_starting"), "year", norm_id("gvkey").alias("gvkey")).where("gvkey is not null").distinct()
    rows = panel.join(company, ["dirid_starting", "year"], "left").withColumn("day", _year_end())
    known = known_at(rows, _filings(spark, sf), "gvkey", "day", "available", ["fyear", "filed_on"], ["mkvalt"])
    return known.select("dirid_starting", "year", "gvkey", F.col("known_fyear").alias("fyear"), F.date_format("known_filed_on", "yyyy-MM-dd").alias("filed_on"), F.col("known_mkvalt").alias("mkvalt"))


# ---------------------------------------------------------------- problem 4
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    roles = table(spark, sf, "ceo_sample").where(~is_deleted("record_status"))
    roles = roles.select(norm_id("directorid_starting").alias("directorid_starting"), text_date("datestartrole").alias("s"), text_date("dateendrole", last=True).alias("e"), is_open_end("dateendrole").alias("open"))
    out = merged_intervals(roles, "directorid_starting", "s", "e", "open")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return out.select("directorid_starting", "kind", day("from_day").alias("from_day"), F.when(F.col("is_open"), "open").otherwise(day("to_day")).alias("to_day"))


# ---------------------------------------------------------------- problem 7
def _references(spark: SparkSession, sf: str) -> DataFrame:
    def refs(name: str, key: str, period: str, live: bool = False) -> DataFrame:
        t = table(spark, sf, name)
        t = t.where(~is_deleted("record_status")) if live else t
        return t.select(F.lit(name).alias("table_name"), norm_id(key).alias("ref_key"), F.col(period).alias("period"))

    def parents(of: str, name: str, key, since, until=None) -> DataFrame:
        until = F.lit(None).cast("int") if until is None else until
        return table(spark, sf, name).select(F.lit(of).alias("table_name"), norm_id(key).alias("ref_key"), since.alias("valid_from"), until.alias("valid_to"), is_deleted("record_status").alias("deleted"))

    role = F.year(text_date("datestartrole")), F.when(~is_open_end("dateendrole"), F.year(text_date("dateendrole", last=True)))
    r = refs("connection_count_panel", "dirid_starting", "year").unionByName(refs("linking_table", "companyid", "link_year", True)).unionByName(refs("fundamentals", "gvkey", "fyear"))
    p = parents("connection_count_panel", "ceo_sample", "directorid_starting", *role)
    p = p.unionByName(parents("linking_table", "ceo_sample", F.col("companyid").cast("string"), *role)).unionByName(parents("fundamentals", "linking_table", "gvkey", F.col("link_year")))
    return reference_status(r, p)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).where(F.col("status").isin("missing", "deleted")).select("table_name", "ref_key", "period")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """References and distinct keys per table, period and status."""
    out = _references(spark, sf).groupBy("table_name", "period", "status")
    return out.agg(F.sum("n_refs").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))


QUERIES = {f.__name__: f for f in (p1_found, p1_per_id, p2_found, p2_filled, p2_fit, p2_heldout, p3_found, p3_panel, p4_found, p7_found, p7_report)}

# ---------------------------------------------------------------- SQL
_VALID = "{c} > 0 and {c} < 10000000 and not isnan({c})"
_IDS = f"""ids as (
  select 'dirid_starting' as id_field, {sql_norm_id('dirid_starting')} as dir_id, {sql_norm_id('dirid_connected')} as partner, start_year from raw_edges
  union all select 'dirid_connected', {sql_norm_id('dirid_connected')}, {sql_norm_id('dirid_starting')}, start_year from raw_edges)"""
_FILINGS = f"filings as (select {sql_norm_id('gvkey')} as gvkey, fyear, filed_on, mkvalt from fundamentals where fyear is not null and filed_on is not null and {_VALID.format(c='mkvalt')})"


def _case(tbl: str, field: str, ok: str, near: str) -> str:
    return f"""select distinct '{tbl}' as table_name, '{field}' as field, m.dirid_starting, m.gvkey, m.year
  from (select {sql_norm_id('dirid_starting')} as dirid_starting, {sql_norm_id('gvkey')} as gvkey, year, {field} from {tbl}) m
  where m.gvkey is not null and not coalesce({ok.format(c='m.' + field)}, false) and exists (
    select 1 from (select {sql_norm_id('gvkey')} as gvkey, year, {field} from {tbl}) o where o.gvkey = m.gvkey and {near} and {ok.format(c='o.' + field)})"""


def _sql_heldout(tbl: str, field: str) -> str:
    rows = f"(select {sql_norm_id('gvkey')} as g, cast(year as bigint) as t, cast(case when {_VALID.format(c=field)} then {field} end as double) as x from {tbl})"
    return f"""select '{tbl}' as table_name, '{field}' as field, count(*) as n, round(avg(abs(ln((s - x) / (k - 1)) - ln(x))), 6) as baseline, true as better
  from {rows} r join (select g, y.t + o.d as t, sum(s) as s, sum(k) as k from (select g, t, sum(x) as s, count(x) as k from {rows} group by g, t) y, (select unnest(generate_series(-{YEARS_AWAY}, {YEARS_AWAY})) as d) o group by 1, 2) n
  on n.g = r.g and n.t = r.t where x is not null and k > 1"""


_SQL_CODES = f"""with codes as (select {sql_norm_id('gvkey')} as g, siccd as c, count(*) as k from panel_with_returns where siccd between {CODES[0]} and {CODES[1]} and {sql_norm_id('gvkey')} is not null group by 1, 2),
best as (select a.g, a.c, a.k, b.c as other, row_number() over (partition by a.g, a.c order by b.k - case when b.c = a.c then 1 else 0 end desc, b.c) as i from codes a join codes b on a.g = b.g where b.k - case when b.c = a.c then 1 else 0 end > 0)
select 'panel_with_returns' as table_name, 'siccd' as field, cast(sum(k) as bigint) as n, round(sum(case when other <> c then k else 0 end) / sum(k), 6) as baseline, true as better from best where i = 1"""

_DATE_WORDS = "lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))"


def _sql_date(c: str, last: bool) -> str:
    """A text date as DuckDB SQL, for the layouts of these tables."""
    s = _DATE_WORDS.format(c=c)
    iso = f"regexp_extract({s}, '^([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})(?:[ t][0-9:.]+z?)?$', 1)"
    month = lambda e: f"last_day({e})" if last else e
    return f"""coalesce(
    try_cast(case when regexp_matches({s}, '^[0-9]{{4}}(\\.0*)?$') then left({s}, 4) || '{'-12-31' if last else '-01-01'}' end as date),
    try_cast(try_strptime(nullif({iso}, ''), '%Y-%m-%d') as date),
    try_cast(case when regexp_matches({s}, '^[0-9]{{8}}$') then try_strptime({s}, '%Y%m%d') end as date),
    try_cast(case when regexp_matches({s}, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$') then try_strptime({s}, '%Y/%m/%d') end as date),
    try_cast(case when regexp_matches({s}, '^[0-9]{{1,2}} [a-z]+ [0-9]{{4}}$') then try_strptime({s}, '%d %b %Y') end as date),
    {month(f"try_cast(case when regexp_matches({s}, '^[0-9]{{4}}-[0-9]{{1,2}}$') then try_strptime({s} || '-01', '%Y-%m-%d') end as date)")},
    {month(f"try_cast(case when regexp_matches({s}, '^[a-z]+ [0-9]{{4}}$') then try_strptime('01 ' || {s}, '%d %b %Y') end as date)")})"""


_E = _DATE_WORDS.format(c="dateendrole")
_ROLE_END = f"case when not (dateendrole is null or {_E} = '' or regexp_matches({_E}, '^(c|cur|curr|current)$') or coalesce({_sql_date('dateendrole', True)} > date '2100-12-31', false)) then year({_sql_date('dateendrole', True)}) end"
_REFS = f"""refs as (
  select 'connection_count_panel' as table_name, {sql_norm_id('dirid_starting')} as ref_key, year as period from connection_count_panel
  union all select 'linking_table', {sql_norm_id('companyid')}, link_year from linking_table where not {sql_deleted('record_status')}
  union all select 'fundamentals', {sql_norm_id('gvkey')}, fyear from fundamentals),
parents as (
  select 'connection_count_panel' as table_name, {sql_norm_id('directorid_starting')} as ref_key, year({_sql_date('datestartrole', False)}) as valid_from, {_ROLE_END} as valid_to, {sql_deleted('record_status')} as deleted from ceo_sample
  union all select 'linking_table', case when companyid > 0 then cast(companyid as varchar) end, year({_sql_date('datestartrole', False)}), {_ROLE_END}, {sql_deleted('record_status')} from ceo_sample
  union all select 'fundamentals', {sql_norm_id('gvkey')}, link_year, null, {sql_deleted('record_status')} from linking_table),
spans as (select table_name, ref_key, deleted, coalesce(valid_from, -2147483648) as a, case when valid_to is not null then greatest(valid_to, coalesce(valid_from, -2147483648)) end as b from parents where ref_key is not null),
status as (
  select r.table_name, r.ref_key, r.period, r.n_refs,
    case when count(p.a) = 0 then 'missing' when bool_and(p.deleted) then 'deleted' when bool_or(not p.deleted and p.a <= r.period and (p.b is null or p.b >= r.period)) then 'ok'
      when min(case when not p.deleted then p.a end) > r.period then 'late' when max(case when not p.deleted then p.a end) <= r.period then 'ended' else 'gap' end as status
  from (select table_name, ref_key, period, count(*) as n_refs from refs where ref_key is not null and period is not null group by all) r
  left join spans p on r.table_name = p.table_name and r.ref_key = p.ref_key group by r.table_name, r.ref_key, r.period, r.n_refs)"""

ORACLES = {
    "p1_found": f"with {_IDS} select id_field, dir_id from ids where dir_id is not null group by all having count(*) * 100 >= 3 * (select count(*) from raw_edges)",
    "p1_per_id": f"with {_IDS} select id_field, dir_id, count(*) as n_rows, count(distinct partner) as n_partners, min(start_year) as first_year, quantile_disc(start_year, 0.5) as median_year from ids where dir_id is not null group by all",
    "p2_found": " union all ".join(
        [_case("merged_panel", f, _VALID, f"abs(o.year - m.year) <= {YEARS_AWAY}") for f in ("mkvalt", "sale")] + [_case("panel_with_returns", "siccd", "{c} between 100 and 8999", "true")]
    ),
    "p2_heldout": " union all ".join([_sql_heldout(t, f) for t in FIELDS for f in ("mkvalt", "sale")] + [f"select * from ({_SQL_CODES})"]),
    "p3_found": f"""with {_FILINGS}, rows as (select distinct {sql_norm_id('dirid_starting')} as dirid_starting, {sql_norm_id('gvkey')} as gvkey, year, mkvalt from merged_panel where {_VALID.format(c='mkvalt')}),
known as (select k.gvkey, k.year, arg_max(f.mkvalt, (f.fyear, f.filed_on)) as v from (select distinct gvkey, year from rows) k
  join filings f on f.gvkey = k.gvkey and f.fyear <= k.year and f.filed_on <= make_date(k.year, 12, 31) group by all)
select distinct r.dirid_starting, r.gvkey, r.year from rows r left join known k on r.gvkey = k.gvkey and r.year = k.year
where r.gvkey is not null and (k.v is null or abs(r.mkvalt - k.v) > 0.0005)""",
    "p3_panel": f"""with {_FILINGS}, company as (select distinct {sql_norm_id('dirid_starting')} as dirid_starting, year, {sql_norm_id('gvkey')} as gvkey from merged_panel where {sql_norm_id('gvkey')} is not null),
rows as (select p.dirid_starting, p.year, c.gvkey from (select distinct {sql_norm_id('dirid_starting')} as dirid_starting, year from connection_count_panel where {sql_norm_id('dirid_starting')} is not null) p left join company c using (dirid_starting, year)),
known as (select k.gvkey, k.year, max_by({{'fyear': f.fyear, 'filed_on': f.filed_on, 'mkvalt': f.mkvalt}}, (f.fyear, f.filed_on, f.mkvalt)) as s from (select distinct gvkey, year from rows) k
  join filings f on f.gvkey = k.gvkey and f.fyear <= k.year and f.filed_on <= make_date(k.year, 12, 31) group by all)
select r.dirid_starting, r.year, r.gvkey, k.s.fyear as fyear, strftime(k.s.filed_on, '%Y-%m-%d') as filed_on, k.s.mkvalt as mkvalt from rows r left join known k on r.gvkey = k.gvkey and r.year = k.year""",
    "p4_found": f"""with roles as (select {sql_norm_id('directorid_starting')} as d, {_sql_date('datestartrole', False)} as s,
  case when dateendrole is null or {_E} = '' or regexp_matches({_E}, '^(c|cur|curr|current)$') or {_sql_date('dateendrole', True)} > date '2100-12-31' then date '9999-12-30' else {_sql_date('dateendrole', True)} end as e
  from ceo_sample where not {sql_deleted('record_status')}),
marked as (select *, max(e) over (partition by d order by s, e rows between unbounded preceding and 1 preceding) as before from roles where d is not null and s is not null and e >= s),
grouped as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by d order by s, e) as g from marked),
periods as (select d, g, min(s) as s, max(e) as e from grouped group by d, g),
both_kinds as (select d, 'period' as kind, s, e from periods union all
  select d, 'gap', prev + 1, s - 1 from (select d, s, lag(e) over (partition by d order by s) as prev from periods) where prev is not null)
select d as directorid_starting, kind, strftime(s, '%Y-%m-%d') as from_day, case when e >= date '9999-12-30' then 'open' else strftime(e, '%Y-%m-%d') end as to_day from both_kinds""",
    "p7_found": f"with {_REFS} select table_name, ref_key, period from status where status in ('missing', 'deleted')",
    "p7_report": f"with {_REFS} select table_name, period, status, cast(sum(n_refs) as bigint) as n_refs, count(*) as n_keys from status group by all",
}
