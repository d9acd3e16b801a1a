"""Attributes as known at event time (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.skew import skew_safe_left_join


def known_at(events: DataFrame, changes: DataFrame, entity: str, event_time: str, available: str, priority: list[str], values: list[str], bucket: Column | None = None) -> DataFrame:
    """Each event row with the entity's best attribute change that was available by the event's time.

    Of the changes of the same `entity` with `available` <= `event_time`, the one with the greatest tuple of
    `priority` columns wins, then the greatest tuple of `values`; it is carried forward until a better one
    becomes available. Event columns of those names are replaced. At the same time changes come before events. Result: the columns of `events` and, named
    `known_<column>`, those of priority and values; null where nothing was known. Events without entity or
    time stay, with nulls; changes without entity, time or any priority column are never known. Repeated
    changes alter nothing; repeated events each keep their row; an empty side is allowed.

    Both sides are unioned, sorted by (entity, time, changes first) and scanned once. Equal events are merged
    before, and time is cut into buckets (calendar years by default) whose carried-in state comes from one
    row per entity and bucket, so that no task holds all of a frequent entity.
    """
    keep = [*priority, *values]
    events = events.drop(*[f"known_{c}" for c in keep])
    state = F.struct(*[F.col(c).alias(f"known_{c}") for c in keep])
    t = "__t"
    cut = (lambda c: bucket(c)) if callable(bucket) else (lambda c: F.year(c))
    ch = changes.where(F.col(entity).isNotNull() & F.col(available).isNotNull())
    for c in priority:
        ch = ch.where(F.col(c).isNotNull())
    ch = ch.groupBy(F.col(entity).alias("__k"), F.col(available).alias(t)).agg(F.max(state).alias("__state"))
    ev = events.where(F.col(entity).isNotNull() & F.col(event_time).isNotNull()).select(F.col(entity).alias("__k"), F.col(event_time).alias(t)).distinct()
    ch, ev = ch.withColumn("__b", cut(F.col(t))), ev.withColumn("__b", cut(F.col(t)))
    # state carried into each bucket: one row per entity and bucket that has a change or an event
    per = ch.groupBy("__k", "__b").agg(F.max("__state").alias("__state")).unionByName(ev.select("__k", "__b").distinct().withColumn("__state", F.lit(None)), allowMissingColumns=True)
    per = per.groupBy("__k", "__b").agg(F.max("__state").alias("__state"))
    carry = per.select("__k", "__b", F.max("__state").over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__state"))
    lane = lambda df, order: df.withColumn("__order", F.lit(order))
    both = lane(carry.where("__state is not null").withColumn(t, F.lit(None)), 0).unionByName(lane(ch, 1)).unionByName(lane(ev.withColumn("__state", F.lit(None)), 2))
    run = Window.partitionBy("__k", "__b").orderBy(F.col(t).asc_nulls_first(), "__order").rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("__known", F.max("__state").over(run)).where("__order = 2").select(F.col("__k").alias(entity), F.col(t).alias(event_time), "__known")
    out = skew_safe_left_join(events, known, [entity, event_time])
    return out.select(*[F.col(c) for c in events.columns], *[F.col(f"__known.known_{c}").alias(f"known_{c}") for c in keep])
