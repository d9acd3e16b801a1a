"""Relational stages: role and link filters, year panels, returns, date-effective joins, nested buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ids import norm_id
from tidewheel.functions.stats import clean, quantile_bucket
from tidewheel.operators import huge_groups
from tidewheel.operators.features import is_large


def matches_any(c: Column | str, keywords: list[str], excluded: list[str] = ()) -> Column:
    """Text that contains one of the keywords and none of the excluded words, in any case; null doesn't match."""
    c = F.col(c) if isinstance(c, str) else c
    has = F.lit(False)
    for k in keywords:
        has = has | c.ilike(f"%{k}%")
    for k in excluded:
        has = has & ~c.ilike(f"%{k}%")
    return F.coalesce(has, F.lit(False))


def members(df: DataFrame, index: str, value: str, columns: dict[str, str], required: list[str] = ()) -> DataFrame:
    """Rows of one index, with `columns` (name -> new name) and without those that lack a required one; the filter reaches the scan."""
    rows = df.where(F.col(index) == value).dropna(subset=list(required)) if required else df.where(F.col(index) == value)
    return rows.select(*[F.col(c).alias(n) for c, n in columns.items()])


def roles_of(roles: DataFrame, ids: DataFrame, key: str, role: str, keywords: list[str], excluded: list[str] = ()) -> DataFrame:
    """Roles by keyword whose key occurs in `ids`: a semi join instead of a list of ids."""
    return roles.where(matches_any(role, keywords, excluded)).join(ids.select(key).distinct(), key, "left_semi")


def overlaps(start: str, end: str, low: int, high: int) -> Column:
    """Text years: start is a number up to `high`; end is null, 'curr' in any case, or a number from `low`."""
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c)).try_cast("int")
    return F.coalesce((number(start) <= high) & (F.col(end).isNull() | (F.lower(end) == "curr") | (number(end) >= low)), F.lit(False))


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """Usable ids in normal form, each once."""
    return df.select(norm_id(F.col(col).cast("string")).alias(col)).dropna().distinct()


def explode_years(df: DataFrame, start: Column, end: Column, out: str = "year") -> DataFrame:
    """One row per year start..end; none where the end is before the start or either is null."""
    return df.withColumn("__a", start).withColumn("__b", end).where("__a <= __b").withColumn(out, F.explode(F.sequence("__a", "__b"))).drop("__a", "__b")


def merge_panel(connections: DataFrame, roles: DataFrame, links: DataFrame, fundamentals: DataFrame, entity: str = "dirid_starting", year: str = "year") -> DataFrame:
    """connections x yearly roles x links (companyid) x fundamentals (gvkey, year), left joins that may fan out."""
    return connections.join(roles, [entity, year], "left").join(links, "companyid", "left").join(fundamentals, ["gvkey", year], "left")


def latest_per_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Last non-null value of every column by `order`, per key."""
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def annual_returns(monthly: DataFrame, key: str, date: str, ret: str, least: int = 6, extra: dict[str, Column] | None = None) -> DataFrame:
    """key, year, annual_return (product of 1 + r, less 1), n_months; years with fewer than `least` returns are left out."""
    r = clean(ret)
    out = monthly.where(r.isNotNull()).groupBy(key, F.year(date).alias("year")).agg((F.product(1 + r) - 1).alias("annual_return"), F.count(F.lit(1)).alias("n_months"), *[c.alias(k) for k, c in (extra or {}).items()])
    return out.where(F.col("n_months") >= least)


def forward_returns(annual: DataFrame, key: str) -> DataFrame:
    """Adds forward_return: the annual return of the key's next available year."""
    return annual.withColumn("forward_return", F.lead("annual_return").over(Window.partitionBy(key).orderBy("year")))


def date_effective_join(left: DataFrame, links: DataFrame, key: str, date: str, begin: str, end: str) -> DataFrame:
    """Rows with the links of the same key valid at their date (open where the end is null)."""
    l2 = links.withColumnRenamed(key, "__key")
    on = (left[key] == l2["__key"]) & (l2[begin] <= left[date]) & (l2[end].isNull() | (left[date] <= l2[end]))
    return left.join(l2, on).drop("__key")


def previous_date(events: DataFrame, dates: DataFrame, key: str, date: str, other: str) -> DataFrame:
    """Adds prev_date: the latest `other` of the same key strictly before the event's date. One ordered pass per key."""
    both = events.select(key, F.col(date).alias("__t"), F.lit(0).alias("__is")).distinct().unionByName(dates.select(key, F.col(other).alias("__t"), F.lit(1).alias("__is")).distinct())
    w = Window.partitionBy(key).orderBy("__t", "__is").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("prev_date", F.max(F.when(F.col("__is") == 1, F.col("__t"))).over(w)).where("__is = 0").select(key, F.col("__t").alias(date), "prev_date")
    return events.join(found, [key, date], "left")


def nested_buckets(df: DataFrame, cols: list[str], by: list[str], n: int = 5, large: bool | None = None) -> DataFrame:
    """0-based quantile bucket q_<col> of every column within the groups; all columns share one window where no group is large."""
    if is_large(df, by, large):
        for c in cols:
            df = huge_groups.quantile_buckets(df, c, f"q_{c}", by, n, 0)
        return df
    w = Window.partitionBy(*by)
    return df.select("*", *[(quantile_bucket(clean(c), n, w) - 1).alias(f"q_{c}") for c in cols])


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keyed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of key and seed; the same rows at every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def linked_returns(annual: DataFrame, links: DataFrame, key: str, other: str) -> DataFrame:
    """Returns of `key` under every `other` that a link gives it; returns without a link are left out, several links fan out."""
    return annual.join(links.select(key, other).distinct(), key).drop(key)


def merge_returns(panel: DataFrame, returns: DataFrame, key: str, year: str) -> DataFrame:
    """Panel rows with the returns of their key and year; rows without stay, several returns fan out."""
    return panel.join(returns, [key, year], "left")
