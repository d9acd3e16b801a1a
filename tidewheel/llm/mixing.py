"""Mixing sources to target weights (problem 9).

A low-discrepancy schedule: slot i belongs to the source into whose part of the unit interval (parts as wide as
the weights) the i-th van der Corput point falls, so every stretch of the schedule is close to the weights. The
documents of a source, shuffled anew in every pass, are cut into blocks of equal tokens; the r-th block of a
source takes its r-th slot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.skew import prefix_sums

#: Tokens of a block.
BLOCK = 4096
#: Documents of a source that one task orders at once.
PIECE = 20_000


def source_name(c: str):
    """Source names are equal after trimming and lower-casing; blank is null."""
    return F.nullif(F.lower(F.btrim(F.col(c), F.lit(" \t\n\r\x0b\x0c "))), F.lit(""))


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], block: int = 1) -> dict[str, dict]:
    """Quota of each source: the greatest mix in which every source with tokens has its weight within its passes.

    Weights of sources without tokens (or without weight, or that can't fill one block) are shared out in proportion.
    """
    here = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and tokens.get(s, 0) * t[1] >= max(1, block)}
    weight = sum(t[0] for t in here.values())
    if not here:
        return {}
    total = min(tokens[s] * t[1] * weight / t[0] for s, t in here.items())
    return {s: {"weight": t[0] / weight, "quota": total * t[0] / weight, "tokens": tokens[s], "passes": min(t[1], math.ceil(total * t[0] / weight / tokens[s] - 1e-9))} for s, t in here.items()}


def _schedule(spark, weights: dict[str, float], slots: int) -> DataFrame:
    """slot, source, block of slots 0..slots - 1: the source by the slot's van der Corput point, numbered within it."""
    names = sorted(weights)
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), 48, "0")), 2, 10).cast("double") / float(2**48)
    edge, edges = 0.0, []
    for s in names:
        edge += weights[s]
        edges.append((edge, s))
    part = F.lit(names[-1])
    for e, s in reversed(edges[:-1]):
        part = F.when(F.col("__u") < e, s).otherwise(part)
    rows = spark.range(slots).select(F.col("id").alias("slot")).withColumn("__u", point).select("slot", part.alias("source"), F.shiftright("slot", 14).alias("__chunk"), F.lit(1).cast("bigint").alias("__one"))
    return prefix_sums(rows, ["source"], "__chunk", ["slot"], "__one", "block").select("slot", "source", "block")


def mix(docs: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mix, shares) of `docs` (doc_id, source, n_tokens) and `targets` (source, target_share, max_repeats).

    mix: slot, position, source, doc_id, pass, from_token, n_tokens, block; ordered by (slot, position) it is the sequence to
    read: n_tokens tokens of the document from from_token on. Every slot from 0 on holds exactly `block` tokens of one
    source. A token is used at most once a pass and at most max_repeats times. shares: source, target_share, wanted
    (the share among sources that have tokens), docs_in, tokens_in, tokens_out, unused (tokens that occur in no slot),
    share, most_repeats; one row per target. The mix ends where a source's next block would not be full within its
    repeats, so a small source with a large share leaves tokens of the others unused; a source that can't fill one block is
    left out. Documents without source, with one not in targets, or without tokens are left out; rows of the same
    doc_id count as one (the least source, then the fewest tokens). Targets that repeat a source add up their
    shares and take the greatest max_repeats; null shares or repeats count as 0. `docs` is read several times, so
    hand in a materialised table.
    """
    spark = docs.sparkSession
    t = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    t = t.groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    goal = {r[0]: (float(r[1]), int(r[2])) for r in t.orderBy("source").collect()}  # a row per source, as the targets have
    small = F.broadcast(t.select("source"))
    d = docs.where("n_tokens > 0 and doc_id is not null").select("doc_id", source_name("source").alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")).join(small, "source", "left_semi")
    d = d.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*")
    sizes = {r["source"]: (r["tokens"], r["docs"]) for r in d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
    quotas = plan({s: x[0] for s, x in sizes.items()}, goal, block)
    schema = "slot bigint, position int, source string, doc_id bigint, pass int, from_token bigint, n_tokens bigint, block bigint"
    out = spark.createDataFrame([], schema)
    if quotas:
        # a source has as many blocks as its tokens fill within its repeats; the schedule ends before the first slot beyond
        most = {s: sizes[s][0] * goal[s][1] // block for s in quotas}
        slots = math.ceil(sum(x["quota"] for x in quotas.values()) / block) + len(quotas)
        slot_rows = _schedule(spark, {s: x["weight"] for s, x in quotas.items()}, slots)
        limits = F.broadcast(spark.createDataFrame([(s, most[s]) for s in quotas], "source string, most bigint"))
        end = slot_rows.join(limits, "source").agg(F.min(F.when(F.col("block") >= F.col("most"), F.col("slot")))).first()[0]
        slot_rows = slot_rows.where(F.col("slot") < (slots if end is None else end))
        used = {r["source"]: r["blocks"] for r in slot_rows.groupBy("source").agg(F.count(F.lit(1)).alias("blocks")).collect()}
        q = F.broadcast(spark.createDataFrame([(s, math.ceil(k * block / sizes[s][0]), k * block, sizes[s][0]) for s, k in used.items()], "source string, passes int, quota bigint, tokens bigint"))
        bits = max(0, math.ceil(math.log2(max(1.0, max(x[1] for x in sizes.values()) / PIECE))))
        rows = d.join(q, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        rows = rows.withColumn("__h", F.xxhash64("doc_id", "pass", F.lit(seed))).withColumn("__chunk", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("bigint"))
        # the order of hashes is the order of their unsigned pieces, then of the signed rest within a piece
        rows = prefix_sums(rows, ["source", "pass"], "__chunk", ["__h", "doc_id"], "n_tokens", "__at")
        rows = rows.withColumn("__at", F.col("__at") + F.col("pass") * F.col("tokens")).where("__at < quota").withColumn("__end", F.least(F.col("__at") + F.col("n_tokens"), F.col("quota")))
        rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("__at") / block), F.floor((F.col("__end") - 1) / block))))
        begin, stop = F.greatest(F.col("__at"), F.col("block") * block), F.least(F.col("__end"), (F.col("block") + 1) * block)
        rows = rows.select("source", "block", "doc_id", "pass", (begin - F.col("block") * block).cast("int").alias("position"), (begin - F.col("__at")).alias("from_token"), (stop - begin).alias("n_tokens"))
        out = rows.join(slot_rows, ["source", "block"]).select("slot", "position", "source", "doc_id", "pass", "from_token", "n_tokens", "block")
    got = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens_out"), (F.max("pass") + 1).alias("most_repeats"))
    known = spark.createDataFrame([(s, g[0], g[1], float(quotas.get(s, {}).get("weight", 0.0)), *sizes.get(s, (0, 0))) for s, g in goal.items()], "source string, target_share double, max_repeats int, wanted double, tokens_in bigint, docs_in bigint")
    shares = known.join(got, "source", "left").withColumn("tokens_out", F.coalesce("tokens_out", F.lit(0)))
    whole = got.agg(F.sum("tokens_out").alias("__all"))
    shares = shares.join(F.broadcast(whole), F.lit(True), "left")
    # a pass begins only when the one before has used every token
    unused = F.greatest(F.col("tokens_in") - F.col("tokens_out"), F.lit(0)).alias("unused")
    return out, shares.select("source", "target_share", "max_repeats", "wanted", "docs_in", "tokens_in", "tokens_out", unused, F.coalesce(F.col("tokens_out") / F.col("__all"), F.lit(0.0)).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
