"""Queries of the problems on training data, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.ids import id_order, norm_id, sql_norm_id, trimmed
from tidewheel.llm import bpe, mixing, pages, sketch, topn
from tidewheel.session import checkpoint

#: Problem 5: precision of the per-director sketches and of the others; standard errors that decide without an exact check.
DIRECTOR_PRECISION, PRECISION, CERTAIN = 14, 12, 6.0
#: Problem 5: slices in which the partners of a director with open keys are counted.
SLICES = 32
#: Problem 6: items per year.
TOP = 25


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- problem 5
def _wrong(n: str, true: str):
    """More than 10 % away from the true count; any positive count where that is 0."""
    return F.abs(F.col(n) - F.col(true)) * 10 > F.col(true)


def _director_edges(spark: SparkSession, sf: str) -> DataFrame:
    """d, c, y of raw_edges: partners of rows without a start year are null, years before 2000 are 1999."""
    return table(spark, sf, "raw_edges").select(norm_id("dirid_starting").alias("d"), F.when(F.col("start_year").isNotNull(), norm_id("dirid_connected")).alias("c"), F.greatest("start_year", F.lit(1999)).alias("y")).where("d is not null")


def _director_keys(spark: SparkSession, sf: str) -> DataFrame:
    """d, year, n of the panel with the estimate, whether it is exact, and what it decides: wrong, right or open.

    A director's count up to a year is |A| - |B|, where A are the partners of rows that start up to the year and B
    those of rows that start before 2000: both are unions of the director's yearly sketches, B within A.
    """
    panel = table(spark, sf, "connection_count_panel").where("n_unique_connected is not null and year is not null").select(norm_id("dirid_starting").alias("d"), "year", F.col("n_unique_connected").cast("bigint").alias("n")).where("d is not null").distinct()
    yearly = sketch.sketch(_director_edges(spark, sf), ["d", "y"], "c", DIRECTOR_PRECISION)
    up_to = sketch.running_counts(yearly, "d", "y", DIRECTOR_PRECISION)
    both = up_to.select("d", "y", "estimate", "exact", F.lit(None).cast("bigint").alias("n")).unionByName(panel.select("d", F.col("year").alias("y"), F.lit(None).cast("double").alias("estimate"), F.lit(None).cast("boolean").alias("exact"), "n"))
    whole = Window.partitionBy("d")
    run = whole.orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    keys = both.withColumns({
        "a": F.coalesce(F.last("estimate", ignorenulls=True).over(run), F.lit(0.0)), "sure": F.coalesce(F.last("exact", ignorenulls=True).over(run), F.lit(True)),
        "b": F.coalesce(F.max(F.when(F.col("y") == 1999, F.col("estimate"))).over(whole), F.lit(0.0)), "here": F.count("estimate").over(whole),
    }).where("n is not null and here > 0")
    off = F.when(F.col("sure"), 0.0).otherwise(CERTAIN * sketch.relative_error(DIRECTOR_PRECISION) * (F.col("a") + F.col("b")) + 4)
    keys = keys.withColumn("mid", F.greatest(F.col("a") - F.col("b"), F.lit(0.0)))
    low, high = F.greatest(F.col("mid") - off, F.lit(0.0)), F.col("mid") + off
    n = F.col("n") * 10
    wrong = (n > 11 * high) | (n < 9 * low)
    right = (n <= 11 * low) & (n >= 9 * high)
    return keys.select("d", F.col("y").alias("year"), "n", "sure", F.when(wrong, "wrong").when(right, "right").otherwise("open").alias("verdict"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Panel counts that are wrong.

    Sparse sketches decide exactly, registers where the count is clear at CERTAIN standard errors. What they leave
    open is counted: the partners of those directors only, in slices, so that no task has a frequent director.
    """
    keys = checkpoint(_director_keys(spark, sf))
    left = keys.where("verdict = 'open'")
    piece = lambda c: F.pmod(F.xxhash64(c), F.lit(SLICES)).cast("int").alias("piece")
    asked = left.select("d").distinct().select("d", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("piece"))
    pairs = _director_edges(spark, sf).where("c is not null").select("d", "c", "y", piece("c")).join(asked, ["d", "piece"], "left_semi")
    new = pairs.groupBy("d", "piece", "c").agg(F.min("y").alias("y")).where("y >= 2000").groupBy("d", "y").agg(F.count(F.lit(1)).alias("k"))
    both = new.select("d", F.col("y").alias("year"), "k", F.lit(None).cast("bigint").alias("n")).unionByName(left.select("d", "year", F.lit(0).cast("bigint").alias("k"), "n"))
    run = Window.partitionBy("d").orderBy("year").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("true", F.sum("k").over(run)).where(F.col("n").isNotNull() & _wrong("n", "true"))
    out = keys.where("verdict = 'wrong'").select("d", "year").unionByName(counted.select("d", "year"))
    return out.select(F.col("d").alias("dirid_starting"), "year").distinct()


def p5_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """How many panel keys of p5_found each form of the sketch decides, and how many are left to be counted."""
    form = F.when(F.col("verdict") == "open", "counted").when(F.col("sure"), "sparse").otherwise("registers")
    return _director_keys(spark, sf).groupBy(form.alias("decided_by")).agg(F.countDistinct("d").alias("n_directors"), F.count(F.lit(1)).alias("n_keys"))


def _loads(spark: SparkSession, sf: str) -> DataFrame:
    kind = lambda c: F.coalesce(F.nullif(F.lower(trimmed(c)), F.lit("")), F.lit("(none)")).alias(c)
    day = F.coalesce(F.date_format("loaded_at", "yyyy-MM-dd"), F.lit("(none)")).alias("day")
    e = table(spark, sf, "raw_edges").select(day, kind("orgtype"), kind("associationtype"), norm_id("dirid_connected").alias("c"), norm_id("dirid_starting").alias("s"))
    side = lambda name, c: F.struct(F.lit(name).alias("id_field"), F.col(c).alias("id"))
    return e.select("day", "orgtype", "associationtype", F.inline(F.array(side("dirid_connected", "c"), side("dirid_starting", "s")))).where("id is not null")


def p5_days(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids per load day, with bounds of three standard errors."""
    parts = sketch.sketch(_loads(spark, sf), ["id_field", "day"], "id", PRECISION)
    return sketch.estimate(parts, ["id_field", "day"], PRECISION)


_KINDS = ["day", "orgtype", "associationtype"]


def _every(fine: DataFrame, dims: list[str]) -> DataFrame:
    """Sketches of all combinations of `dims` with '(all)', merged from the finest ones; each dimension doubles what moves once."""
    for c in dims:
        rolled = fine.withColumn(c, F.explode(F.array(F.col(c), F.lit("(all)"))))
        fine = sketch.merge(rolled, ["id_field", *[k for k in _KINDS if k in fine.columns]], PRECISION)
    return fine


def p5_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids per orgtype, associationtype, their combinations and in all ('(all)'), merged from one set of sketches."""
    keys = ["id_field", "orgtype", "associationtype"]
    fine = sketch.sketch(_loads(spark, sf), keys, "id", PRECISION)
    return sketch.estimate(_every(fine, keys[1:]), keys, PRECISION)


def p5_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids per load day, orgtype, associationtype and every combination of these, '(all)' where one is left out."""
    keys = ["id_field", *_KINDS]
    fine = sketch.sketch(_loads(spark, sf), keys, "id", PRECISION)
    return sketch.estimate(_every(fine, _KINDS), keys, PRECISION)


def _bounds(estimates: DataFrame, exact: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the exact count and whether it lies within the estimate's bounds."""
    return estimates.join(exact, keys, "full").select(*keys, "n", F.coalesce(F.col("n").between(F.floor("low"), F.ceil("high")), F.lit(False)).alias("within"))


def p5_days_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the true counts per load day lie within four standard errors."""
    rows, keys = _loads(spark, sf), ["id_field", "day"]
    parts = sketch.sketch(rows, keys, "id", PRECISION)
    return _bounds(sketch.estimate(parts, keys, PRECISION, 4.0), rows.groupBy(*keys).agg(F.countDistinct("id").alias("n")), keys)


def p5_kinds_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the true counts of every combination of orgtype and associationtype lie within four standard errors."""
    rows, keys = _loads(spark, sf), ["id_field", "orgtype", "associationtype"]
    each = lambda c: F.explode(F.array(F.col(c), F.lit("(all)"))).alias(c)
    cube = rows.select("id_field", each("orgtype"), "associationtype", "id").select("id_field", "orgtype", each("associationtype"), "id")
    got = sketch.estimate(_every(sketch.sketch(rows, keys, "id", PRECISION), keys[1:]), keys, PRECISION, 4.0)
    return _bounds(got, cube.groupBy(*keys).agg(F.countDistinct("id").alias("n")), keys)


# ---------------------------------------------------------------- problem 6
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "panel_with_returns").where("n_unique_connected_rank > 0 and n_unique_connected_rank <= 1 and year is not null")
    rows = rows.select("year", norm_id("dirid_starting").alias("dirid_starting"), norm_id("gvkey").alias("gvkey"), "n_unique_connected_rank", F.when(~F.isnan("forward_return"), F.col("forward_return")).alias("forward_return")).where("gvkey is not null and dirid_starting is not null")
    order = [F.col("n_unique_connected_rank").desc(), F.col("forward_return").desc_nulls_last(), *id_order("dirid_starting"), *id_order("gvkey")]
    return topn.top_n(rows, ["year"], order, ["dirid_starting", "gvkey"], TOP).select("year", "dirid_starting", "gvkey")


# ---------------------------------------------------------------- problem 8
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(bpe.distinct_documents(table(spark, sf, "documents")))


# ---------------------------------------------------------------- problem 9
def _mixed(spark: SparkSession, sf: str):
    docs = table(spark, sf, "documents")
    counts = docs.select("doc_id", F.struct("doc_id", "source").alias("k"), "text")
    sized = checkpoint(bpe.count_tokens(counts, "k").select("k.doc_id", "k.source", "n_tokens"))
    return mixing.mix(sized, table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of the mixed corpus with their documents."""
    return _mixed(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares wanted and reached of each source."""
    return _mixed(spark, sf)[1]


# ---------------------------------------------------------------- problem 10
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return pages.spam_pages(table(spark, sf, "documents")).where("spam").select("doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_evidence, p5_days, p5_kinds, p5_combinations, p5_days_bounds, p5_kinds_bounds, p6_found, p8_ids, p9_mix, p9_shares, p10_found)}

_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
_KIND = "coalesce(nullif(lower(trim({c}, " + _BLANK + ")), ''), '(none)') as {c}"
_LOADS = f"""loads as (select * from (
  select 'dirid_connected' as id_field, {sql_norm_id('dirid_connected')} as id, coalesce(strftime(loaded_at, '%Y-%m-%d'), '(none)') as day, {_KIND.format(c='orgtype')}, {_KIND.format(c='associationtype')} from raw_edges
  union all select 'dirid_starting', {sql_norm_id('dirid_starting')}, coalesce(strftime(loaded_at, '%Y-%m-%d'), '(none)'), {_KIND.format(c='orgtype')}, {_KIND.format(c='associationtype')} from raw_edges) where id is not null)"""

ORACLES = {
    "p5_days_bounds": f"with {_LOADS} select id_field, day, count(distinct id) as n, true as within from loads group by all",
    "p5_kinds_bounds": f"""with {_LOADS} select id_field, case when grouping(orgtype) = 1 then '(all)' else orgtype end as orgtype, case when grouping(associationtype) = 1 then '(all)' else associationtype end as associationtype, count(distinct id) as n, true as within
from loads group by grouping sets ((id_field, orgtype, associationtype), (id_field, orgtype), (id_field, associationtype), (id_field))""",
    "p5_found": f"""with edges as (select {sql_norm_id('dirid_starting')} as d, {sql_norm_id('dirid_connected')} as c, start_year from raw_edges),
pairs as (select d, c, min(start_year) as y from edges where d is not null and c is not null group by d, c),
panel as (select distinct {sql_norm_id('dirid_starting')} as d, year, n_unique_connected as n from connection_count_panel where n_unique_connected is not null and year is not null),
counts as (select k.d, k.year, k.n, count(p.c) as t from panel k left join pairs p on p.d = k.d and p.y between 2000 and k.year
  where k.d in (select d from edges where d is not null) group by all)
select distinct d as dirid_starting, year from counts where abs(n - t) * 10 > t""",
    "p6_found": f"""with rows as (select year, {sql_norm_id('dirid_starting')} as d, {sql_norm_id('gvkey')} as g, n_unique_connected_rank as r, case when not isnan(forward_return) then forward_return end as f from panel_with_returns
  where n_unique_connected_rank > 0 and n_unique_connected_rank <= 1 and year is not null),
best as (select *, row_number() over (partition by year, d, g order by r desc, f desc nulls last) as again from rows where d is not null and g is not null)
select year, d as dirid_starting, g as gvkey from best where again = 1
qualify row_number() over (partition by year order by r desc, f desc nulls last, length(d), d, length(g), g) <= {TOP}""",
}
