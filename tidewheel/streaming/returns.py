"""Annual returns and month-end dates kept up to date from a stream of dated returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.stats import clean


def streaming_annual_returns(stream: DataFrame, key: str, ts: str, ret: str, delay: str = "400 days") -> DataFrame:
    """key, year, annual_return, n from a stream, for output mode update or complete.

    Sums of log(1 + r) are the state, so the state of a key and year is two numbers. Returns of -100 % or less have
    no logarithm and don't count.
    """
    r = clean(ret)
    s = stream.withWatermark(ts, delay).where(r > -1)
    out = s.groupBy(F.col(key), F.year(ts).alias("year")).agg(F.sum(F.log1p(r)).alias("__log"), F.count(F.lit(1)).alias("n"))
    return out.select(key, "year", F.expm1("__log").alias("annual_return"), "n")


def streaming_month_ends(stream: DataFrame, ts: str, delay: str = "40 days") -> DataFrame:
    """month, last_day that occurred in it, as a stream."""
    s = stream.withWatermark(ts, delay)
    return s.groupBy(F.date_trunc("month", ts).alias("month")).agg(F.max(F.to_date(ts)).alias("rebalance_date"))
