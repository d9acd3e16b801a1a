"""References to records that do not exist (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Period from which a parent without beginning is valid.
ALWAYS = -(2**31)


def reference_status(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Status of every distinct reference: table_name, ref_key, period, n_refs, status, valid_from.

    `refs` has table_name, ref_key, period; `parents` has table_name (of the referring table), ref_key, valid_from and
    deleted, and may have valid_to: first and last period of the parent row. A row without valid_from is valid from
    ever, one without valid_to for ever; one that ends before it begins is valid in its first period. Status is 'ok' (a live
    parent is valid in the period), 'late' (all live parents begin after it), 'ended' (all ended before), 'gap' (some ended
    before, others begin after), 'deleted' (only deleted parents) or 'missing' (no parent). valid_from is the first
    period of the live parents, null if that is from ever. References without key or period don't count. Repeated rows
    add to n_refs; other columns are ignored; either side may be empty.

    References and the beginnings and ends of parents become events, merged map-side to one row per key and period, so
    a frequent key moves as few rows as it has periods. They are co-partitioned by (table, key), sorted by
    period, and merged in one linear pass that counts the parents that are open.
    """
    keys = ["table_name", "ref_key"]
    null, no = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    r = refs.where("ref_key is not null and period is not null").select(*keys, F.col("period").cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("n_refs"), no.alias("begun"), no.alias("moved"), F.lit(False).alias("deleted"))
    live = ~F.coalesce(F.col("deleted"), F.lit(False))
    begin = F.coalesce(F.col("valid_from").cast("bigint"), F.lit(ALWAYS))
    end = F.greatest(F.col("valid_to").cast("bigint"), begin) + 1 if "valid_to" in parents.columns else null
    event = lambda at, begun, moved, gone: F.struct(at.alias("at"), F.lit(begun).cast("bigint").alias("begun"), F.lit(moved).cast("bigint").alias("moved"), F.lit(gone).alias("deleted"))
    open_end = F.col("valid_to").isNull() if "valid_to" in parents.columns else F.lit(True)
    events = F.when(~live, F.array(event(F.lit(ALWAYS).cast("bigint"), 0, 0, True))).when(open_end, F.array(event(begin, 1, 1, False))).otherwise(F.array(event(begin, 1, 1, False), event(end, 0, -1, False)))
    p = parents.where("ref_key is not null").select(*keys, F.inline(events)).withColumn("n_refs", no).select(*r.columns)
    per = r.unionByName(p).groupBy(*keys, "at").agg(*[F.sum(c).alias(c) for c in ("n_refs", "begun", "moved")], F.max("deleted").alias("deleted"))
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    s = per.withColumns({
        "open": F.sum("moved").over(run), "so_far": F.sum("begun").over(run), "in_all": F.sum("begun").over(whole),
        "gone": F.max("deleted").over(whole), "first": F.min(F.when(F.col("begun") > 0, F.col("at"))).over(whole),
    }).where("n_refs > 0")
    status = (
        F.when(F.col("open") > 0, "ok").when((F.col("in_all") == 0) & F.col("gone"), "deleted").when(F.col("in_all") == 0, "missing")
        .when(F.col("so_far") == 0, "late").when(F.col("so_far") == F.col("in_all"), "ended").otherwise("gap")
    )
    return s.select(*keys, F.col("at").cast(refs.schema["period"].dataType).alias("period"), "n_refs", status.alias("status"), F.nullif(F.col("first"), F.lit(ALWAYS).cast("bigint")).cast("int").alias("valid_from"))
