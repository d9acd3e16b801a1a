"""Temporal graph operators: as-of snapshots, local metrics of all years in one plan, and iterative metrics.

An edge list has a source, a target (strings), a start year and an end year (null: still running). Snapshots are
undirected simple graphs; metrics carry a snapshot column (year) through every join, so 27 years are one job.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.ids import norm_id
from tidewheel.session import checkpoint, drop_checkpoint, shared_dir


def edges_core(raw: DataFrame, source: str, target: str, start: str, end: str) -> DataFrame:
    """Narrow edges with ids in normal form and bigint years; rows without source, target or start are dropped."""
    e = raw.select(norm_id(F.col(source).cast("string")).alias(source), norm_id(F.col(target).cast("string")).alias(target), F.col(start).try_cast("bigint").alias(start), F.col(end).try_cast("bigint").alias(end))
    return e.dropna(subset=[source, target, start])


def asof_edges(edges: DataFrame, year: int, mode: str, source: str, target: str, start: str, end: str) -> DataFrame:
    """Distinct (source, target) as of a year: all begun by it (cumulative) or also not yet ended (active)."""
    if mode not in ("cumulative", "active"):
        raise ValueError(f"unknown mode {mode!r}")
    e = edges.where(F.col(start) <= year)
    if mode == "active":
        e = e.where(F.col(end).isNull() | (F.col(end) >= year))
    return e.select(source, target).distinct()


def _undirected(edges: DataFrame, source: str, target: str, **rest: str) -> DataFrame:
    return edges.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), *[F.col(c).alias(name) for name, c in rest.items()])


def yearly_pairs(edges: DataFrame, mode: str, first: int, last: int, source: str, target: str, start: str, end: str) -> DataFrame:
    """Distinct undirected pairs (year, a, b) of every year first..last, self-loops included.

    Cumulative pairs are merged to their least start before they are repeated per year; active rows are repeated
    over their own years only.
    """
    if mode == "cumulative":
        p = _undirected(edges, source, target, begun=start).groupBy("a", "b").agg(F.min("begun").alias("s")).where(F.col("s") <= last)
        return p.select(F.explode(F.sequence(F.greatest(F.col("s"), F.lit(first)).cast("int"), F.lit(last))).alias("year"), "a", "b")
    if mode != "active":
        raise ValueError(f"unknown mode {mode!r}")
    lo, hi = F.greatest(F.col("begun"), F.lit(first)).cast("int"), F.least(F.coalesce("ended", F.lit(last)), F.lit(last)).cast("int")
    p = _undirected(edges, source, target, begun=start, ended=end).select("a", "b", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").distinct()
    return p.select(F.explode(F.sequence("lo", "hi")).alias("year"), "a", "b").distinct()


#: Years of one bit mask.
MASK_YEARS = 60


def yearly_masks(edges: DataFrame, mode: str, first: int, last: int, source: str, target: str, start: str, end: str) -> DataFrame:
    """a, b, mask: distinct undirected pairs with a bit for every year first..last in which they are there (bit 0 is `first`).

    The same pairs as yearly_pairs, but a pair is one row for all years; self-loops included. At most MASK_YEARS years.
    """
    if mode not in ("cumulative", "active"):
        raise ValueError(f"unknown mode {mode!r}")
    if not 0 <= last - first < MASK_YEARS:
        raise ValueError(f"{first}..{last}: a mask holds 1 to {MASK_YEARS} years")
    begun = F.greatest(F.col("begun"), F.lit(first)).cast("int")
    ended = F.lit(last) if mode == "cumulative" else F.least(F.coalesce("ended", F.lit(last)), F.lit(last)).cast("int")
    p = _undirected(edges, source, target, begun=start, ended=end).select("a", "b", begun.alias("lo"), ended.alias("hi")).where("lo <= hi")
    below = lambda n: F.call_function("shiftleft", F.expr("1L"), n) - 1
    years = below(F.col("hi") - first + 1).bitwiseXOR(below(F.col("lo") - first))
    return p.groupBy("a", "b").agg(F.bit_or(years).alias("mask"))


def adjacency(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Symmetric (by, i, j) without loops from distinct pairs."""
    p = pairs.where("a <> b")
    return p.select(*by, F.inline(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))))


def nodes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """All endpoints, those with only a self-loop included."""
    return pairs.select(*by, F.explode(F.array("a", "b")).alias("i")).distinct()


def degrees(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, node_id, degree, degree_centrality = degree / (nodes - 1), 0 in a graph of one node."""
    d = adjacency(pairs, by).groupBy(*by, "i").agg(F.count(F.lit(1)).alias("degree"))
    n = nodes(pairs, by).join(d, [*by, "i"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    size = n.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    n = n.join(size, by) if by else n.crossJoin(F.broadcast(size))
    return n.select(*by, F.col("i").alias("node_id"), "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"))


def triangles(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, i, j, k of each triangle once, edges oriented from lower to higher degree (then id).

    A node has at most sqrt(2 x edges) out-neighbours in that order, which bounds the wedges at hubs.
    """
    adj = adjacency(pairs, by)
    d = adj.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("d"))
    p = pairs.where("a <> b").distinct()
    p = p.join(d.select(*by, F.col("i").alias("a"), F.col("d").alias("da")), [*by, "a"]).join(d.select(*by, F.col("i").alias("b"), F.col("d").alias("db")), [*by, "b"])
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    out = p.select(*by, F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"))
    left, right = out.select(*by, "u", F.col("v").alias("v")), out.select(*by, "u", F.col("v").alias("w"))
    # closing edges are looked up in id order
    wedge = left.join(right, [*by, "u"]).where("v < w")
    close = pairs.where("a <> b").select(*by, F.col("a").alias("v"), F.col("b").alias("w")).distinct()
    return wedge.join(close, [*by, "v", "w"]).select(*by, F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("k"))


def local_metrics(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, node_id, degree, degree_centrality, clustering, effective_size, network_constraint, brokerage.

    clustering is 2 t / (d (d - 1)), 0 below degree 2; effective size d - 2 t / d, d below degree 2; constraint sums
    (p_ij + sum_q p_iq p_qj)^2 over the neighbours j with p = 1 / degree, null without neighbours; brokerage is its
    reciprocal.
    """
    deg = degrees(pairs, by).persist()  # both are used several times; what is lost is computed again
    t3 = triangles(pairs, by).persist()
    n = t3.select(*by, F.explode(F.array("i", "j", "k")).alias("node_id")).groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("t"))
    d = deg.select(*by, F.col("node_id").alias("x"), "degree")
    adj = adjacency(pairs, by).distinct()
    # sum over common neighbours q of 1 / (d_i d_q), from the triangles: each gives six ordered (i, j, q)
    six = t3.select(*by, F.inline(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j"), F.col(c).alias("q")) for a, b, c in (("i", "j", "k"), ("i", "k", "j"), ("j", "i", "k"), ("j", "k", "i"), ("k", "i", "j"), ("k", "j", "i"))])))
    via = six.join(d.select(*by, F.col("x").alias("q"), F.col("degree").alias("dq")), [*by, "q"]).groupBy(*by, "i", "j").agg(F.sum(1 / F.col("dq")).alias("via"))
    c = adj.join(via, [*by, "i", "j"], "left").join(d.select(*by, F.col("x").alias("i"), F.col("degree").alias("di")), [*by, "i"])
    share = (1 + F.coalesce("via", F.lit(0.0))) / F.col("di")
    cons = c.groupBy(*by, F.col("i").alias("node_id")).agg(F.sum(share * share).alias("network_constraint"))
    out = deg.join(n, [*by, "node_id"], "left").join(cons, [*by, "node_id"], "left")
    t, k = F.coalesce("t", F.lit(0)), F.col("degree")
    return out.select(
        *by, "node_id", "degree", "degree_centrality",
        F.when(k >= 2, 2 * t / (k * (k - 1))).otherwise(0.0).alias("clustering"),
        F.when(k >= 2, k - 2 * t / k).otherwise(k.cast("double")).alias("effective_size"),
        "network_constraint", F.try_divide(F.lit(1.0), F.col("network_constraint")).alias("brokerage"),
    )


def local_metrics_of_years(masks: DataFrame, first: int, last: int) -> DataFrame:
    """year, node_id and the columns of local_metrics for every year first..last, from the pairs of yearly_masks.

    Every triangle is found once for all years: it is there in the years that its three pairs share. Degrees, triangles
    and constraints are summed with one column per year, so no table is repeated by year but the result.
    """
    span = range(last - first + 1)
    there = lambda m, k: F.getbit(m, F.lit(k)).cast("int")
    array = lambda name: F.array(*[F.col(f"{name}{k}") for k in span]).alias(name)
    per_year = lambda df, keys, name, value: df.groupBy(*keys).agg(*[F.sum(value(k)).alias(f"{name}{k}") for k in span]).select(*keys, array(name))
    masks = masks.persist()
    links = masks.where("a <> b")
    both = links.select("mask", F.inline(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))))
    d = per_year(both, ["i"], "d", lambda k: there(F.col("mask"), k)).persist()
    # a node is there in the years of any of its pairs, self-loops included
    node = masks.select("mask", F.explode(F.array("a", "b")).alias("i")).groupBy("i").agg(F.bit_or("mask").alias("node_mask"))
    size = d.sparkSession.createDataFrame([tuple(node.agg(*[F.coalesce(F.sum(there(F.col("node_mask"), k)), F.lit(0)) for k in span]).first())], ", ".join(f"n{k} bigint" for k in span)).select(array("n"))
    # orientation by the number of neighbours of all years bounds the wedges at hubs
    t3 = triangles(links.select("a", "b"), [])
    of = lambda x, y, name: links.select(F.col("a").alias(x), F.col("b").alias(y), F.col("mask").alias(name))
    ends = t3.select(F.array_sort(F.array("i", "j", "k")).alias("t")).select(F.col("t")[0].alias("i"), F.col("t")[1].alias("j"), F.col("t")[2].alias("k"))
    tri = ends.join(of("i", "j", "m1"), ["i", "j"]).join(of("j", "k", "m2"), ["j", "k"]).join(of("i", "k", "m3"), ["i", "k"])
    tri = tri.select("i", "j", "k", F.col("m1").bitwiseAND(F.col("m2")).bitwiseAND(F.col("m3")).alias("mask")).where("mask <> 0").persist()
    t = per_year(tri.select("mask", F.explode(F.array("i", "j", "k")).alias("i")), ["i"], "t", lambda k: there(F.col("mask"), k))
    # sum over common neighbours q of 1 / d_q of the year; each triangle gives six ordered (i, j, q)
    six = tri.select("mask", F.inline(F.array(*[F.struct(F.col(x).alias("i"), F.col(y).alias("j"), F.col(z).alias("q")) for x, y, z in (("i", "j", "k"), ("i", "k", "j"), ("j", "i", "k"), ("j", "k", "i"), ("k", "i", "j"), ("k", "j", "i"))])))
    via = per_year(six.join(d.select(F.col("i").alias("q"), "d"), "q"), ["i", "j"], "v", lambda k: F.when(there(F.col("mask"), k) == 1, F.try_divide(F.lit(1.0), F.col("d")[k])))
    share = lambda k: F.when(there(F.col("mask"), k) == 1, (1 + F.coalesce(F.col("v")[k], F.lit(0.0))) / F.col("d")[k])
    con = per_year(both.join(via, ["i", "j"], "left").join(d, "i"), ["i"], "c", lambda k: share(k) * share(k))
    out = node.join(d, "i", "left").join(t, "i", "left").join(con, "i", "left").join(F.broadcast(size), F.lit(True))
    years = F.explode(F.filter(F.sequence(F.lit(0), F.lit(last - first)), lambda k: F.getbit("node_mask", k) == 1)).alias("k")
    at = lambda name: F.col(name)[F.col("k")]
    rows = out.select("i", "node_mask", "d", "t", "c", "n", years).select(F.col("i").alias("node_id"), (F.col("k") + first).alias("year"), F.coalesce(at("d"), F.lit(0)).alias("d"), F.coalesce(at("t"), F.lit(0)).alias("t"), at("c").alias("c"), at("n").alias("n"))
    k, t = F.col("d"), F.col("t")
    return rows.select(
        "year", "node_id", k.alias("degree"), F.when(F.col("n") > 1, k / (F.col("n") - 1)).otherwise(0.0).alias("degree_centrality"),
        F.when(k >= 2, 2 * t / (k * (k - 1))).otherwise(0.0).alias("clustering"),
        F.when(k >= 2, k - 2 * t / k).otherwise(k.cast("double")).alias("effective_size"),
        F.when(k > 0, F.col("c")).alias("network_constraint"), F.try_divide(F.lit(1.0), F.when(k > 0, F.col("c"))).alias("brokerage"),
    )


def _weighted(pairs: DataFrame, by: list[str], weight: str | None) -> DataFrame:
    """Symmetric (by, i, j, w) without loops; w is 1 without a weight column."""
    w = F.col(weight).cast("double").alias("w") if weight else F.lit(1.0).alias("w")
    p = pairs.where("a <> b").select(*by, "a", "b", w)
    return p.select(*by, F.inline(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"), "w"), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), "w"))))


def pagerank(pairs: DataFrame, by: list[str], damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-10, every: int = 4, weight: str | None = None) -> DataFrame:
    """by, node_id, pagerank of each snapshot: uniform teleport, dangling mass spread evenly, sums to 1.

    With a positive `weight` of the pairs, a node gives to its neighbours in proportion to it.

    Solves x = 1 + damping x P'x by Chebyshev's iteration (P of an undirected graph has real eigenvalues in -1..1) and
    scales x to sum 1, which spreads the dangling mass. The residual bounds the summed error: rounds go on until that
    is below the tolerance in every snapshot; more than 1,000 are an error. With a number of iterations it stops there,
    and warns if that isn't met. Each round's table (a narrow row per node) is written to the shared checkpoint folder.
    """
    adj = _weighted(pairs, by, weight)
    deg = adj.groupBy(*by, "i").agg(F.sum("w").alias("d"))
    # kept partitioned by the key of every round's join
    out = adj.join(deg, [*by, "i"]).select(*by, "i", "j", (F.col("w") / F.col("d")).alias("p")).repartition(*by, "i").persist()
    x = checkpoint(nodes(pairs, by).join(deg, [*by, "i"], "left").select(*by, "i", F.when(F.col("d").isNull(), 1.0).otherwise(1 / (1 - damping)).alias("x")).withColumns({"was": F.col("x"), "plain": F.col("x")}))
    omega, step, met, error = 1.0, 0, False, None
    while not met and step != iterations:
        step += 1
        gain = out.join(x.select(*by, "i", "x"), [*by, "i"]).groupBy(*by, F.col("j").alias("i")).agg(F.sum(F.col("x") * F.col("p")).alias("g"))
        new = x.drop("plain").join(gain, [*by, "i"], "left").withColumn("plain", 1 + damping * F.coalesce("g", F.lit(0.0)))
        omega = 1.0 if step == 1 else 1 / (1 - damping**2 / 2) if step == 2 else 1 / (1 - damping**2 * omega / 4)
        new = checkpoint(new.select(*by, "i", (F.lit(omega) * (F.col("plain") - F.col("was")) + F.col("was")).alias("x"), F.col("x").alias("was"), "plain"))
        drop_checkpoint(x)
        x = new
        if step % every == 0 or step == iterations:
            error = x.groupBy(*by).agg((F.sum(F.abs(F.col("plain") - F.col("was"))) / F.sum("was") / (1 - damping)).alias("e")).agg(F.max("e")).first()[0] or 0.0
            met = error < tolerance
            if not met and iterations is None and step >= 1000:
                raise ArithmeticError(f"PageRank may still be off by {error:.1e} after {step} rounds")
    if not met:
        warnings.warn(f"PageRank stopped after {step} rounds; it may be off by {error}", RuntimeWarning, stacklevel=2)
    out.unpersist()
    total = x.groupBy(*by).agg(F.sum("plain").alias("total"))
    x = x.join(F.broadcast(total), by) if by else x.crossJoin(F.broadcast(total))
    return x.select(*by, F.col("i").alias("node_id"), (F.col("plain") / F.col("total")).alias("pagerank"))


def _ritz(gram, image, keep: int):
    """The greatest Ritz values and their combinations (a column each) of vectors with these products S'S and S'AS; dependent vectors are left out."""
    import numpy as np

    length = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    w, v = np.linalg.eigh(gram / length[:, None] / length)
    basis = v[:, w > 1e-13 * w[-1]] / np.sqrt(w[w > 1e-13 * w[-1]])
    values, u = np.linalg.eigh(basis.T @ (image / length[:, None] / length) @ basis)
    got = (basis @ u[:, ::-1][:, :keep]) / length[:, None]
    return values[::-1][:keep], np.pad(got, ((0, 0), (0, keep - got.shape[1])))


def eigenvector(pairs: DataFrame, by: list[str], norm: str = "max", iterations: int | None = None, tolerance: float = 1e-9, weight: str | None = None) -> DataFrame:
    """by, node_id, eigenvector_centrality, the greatest eigenvalue's vector of A; scaled to maximum 1 ('max') or length 1 ('l2').

    A holds the positive `weight` of the pairs, or ones.

    Rayleigh-Ritz over four vectors: the two best so far, the last direction and the residual. All come from powers of A
    on ones, so components with the same eigenvalue keep the shares they have in power iteration. Rounds go on until
    |Av - lv| < tolerance x l with the maximum of v 1, in every snapshot; more than 1,000 are an error. With a number of
    iterations it stops there, and warns if that isn't met. A row of 21 sums per snapshot comes to the driver each round.
    """
    import numpy as np

    keep, m = 2, 4
    adj = _weighted(pairs, by, weight).repartition(*by, "j").persist()
    vectors, images = [f"s{k}" for k in range(m)], [f"t{k}" for k in range(m)]
    zero = F.lit(0.0)

    def with_image(df: DataFrame) -> DataFrame:
        gain = adj.join(df.select(*by, F.col("i").alias("j"), F.col(vectors[-1]).alias("v")), [*by, "j"]).groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("w")).alias("g"))
        return df.join(gain, [*by, "i"], "left").withColumn(images[-1], F.coalesce("g", zero)).drop("g")

    # ones go in where later rounds have the residual
    state = checkpoint(with_image(nodes(pairs, by).select(*by, "i", *[zero.alias(c) for c in (*vectors[:-1], *images[:-1])], F.lit(1.0).alias(vectors[-1]))))
    upper = [(a, b) for a in range(m) for b in range(a, m)]
    step, best = 0, {}
    while True:
        sums = state.groupBy(*by).agg(
            F.array(*[F.sum(F.col(vectors[a]) * F.col(vectors[b])) for a, b in upper]).alias("g"),
            F.array(*[F.sum(F.col(vectors[a]) * F.col(images[b])) for a, b in upper]).alias("h"),
            F.max(F.abs(vectors[0])).alias("top"),
        ).collect()
        rows, error = [], 0.0
        for r in sums:
            if r["g"][0] is None:
                continue
            gram, image = np.zeros((m, m)), np.zeros((m, m))
            for (a, b), g, h in zip(upper, r["g"], r["h"]):
                gram[a, b] = gram[b, a] = g
                image[a, b] = image[b, a] = h
            key = tuple(r[c] for c in by)
            if step and best[key] > 0:
                error = max(error, gram[-1, -1] ** 0.5 / r["top"] / best[key])
            values, c = _ritz(gram, image, keep)
            best[key] = float(values[0])
            rows.append((*key, float(values[0]), [float(x) for x in c.T.ravel()]))
        met = not rows or step > 0 and error < tolerance
        if met or step > 0 and step == iterations:
            break
        if iterations is None and step >= 1000:
            raise ArithmeticError(f"eigenvector centrality has a residual of {error:.1e} after {step} rounds")
        step += 1
        mix = F.broadcast(state.sparkSession.createDataFrame(rows, state.select(*by, zero.alias("value"), F.array(zero).alias("c")).schema))
        old = state.join(mix, by) if by else state.crossJoin(mix)
        part = lambda cols, q, first=0: sum((F.col("c")[q * m + k] * F.col(cols[k]) for k in range(first, m)), zero)
        new = old.select(*by, "i", "value", *[part(cols, q).alias(cols[q]) for cols in (vectors, images) for q in range(keep)], *[part(cols, 0, 1).alias(cols[keep]) for cols in (vectors, images)])
        new = checkpoint(with_image(new.withColumn(vectors[-1], F.col(images[0]) - F.col("value") * F.col(vectors[0])).drop("value")))
        drop_checkpoint(state)
        state = new
    if not met:
        warnings.warn(f"eigenvector centrality stopped after {step} rounds with a residual of {error:.1e}", RuntimeWarning, stacklevel=2)
    adj.unpersist()
    v = state.select(*by, "i", F.abs(vectors[0]).alias("v"))
    size = v.groupBy(*by).agg((F.sqrt(F.sum(F.col("v") * F.col("v"))) if norm == "l2" else F.max("v")).alias("size"))
    v = v.join(F.broadcast(size), by) if by else v.crossJoin(F.broadcast(size))
    return v.select(*by, F.col("i").alias("node_id"), (F.col("v") / F.col("size")).alias("eigenvector_centrality"))


#: Entries (sources x (nodes + directed edges)) that a task's arrays hold at once.
_ENTRIES = 4_000_000


def _search(start, adj, sources, weight):
    """Breadth-first search from a block of sources over neighbours adj[start[v]:start[v + 1]]: summed weights of the nodes that every source reaches, itself included, and summed dependencies of every node, the ends of paths counted by weight."""
    import numpy as np

    n, k = len(start) - 1, len(sources)
    # the entry of (source b, node v) is b * n + v
    dist, at, sigma = np.full(k * n, -1, np.int32), np.empty(k * n, np.int64), np.zeros(k * n)
    front = np.arange(k) * n + sources
    dist[front], sigma[front] = 0, 1.0
    size, level, levels = np.zeros(k), 0, []
    while len(front):
        level += 1
        v = front % n
        size += np.bincount(front // n, weights=weight[v], minlength=k)
        deg = start[v + 1] - start[v]
        of = np.repeat(np.arange(len(front)), deg)
        t = adj[np.arange(len(of)) + np.repeat(start[v] - (np.cumsum(deg) - deg), deg)] + np.repeat(front - v, deg)
        new = dist[t] < 0
        of, t = of[new], t[new]
        dist[t] = level
        np.add.at(sigma, t, sigma[front[of]])
        levels.append((front, of, t))
        at[t] = np.arange(len(t))
        front = t[at[t] == np.arange(len(t))]  # every entry once
    total, delta = np.zeros(n), np.zeros(k * n)
    for front, of, t in levels[:0:-1]:
        delta[front] = sigma[front] * np.bincount(of, weights=(weight[t % n] + delta[t]) / sigma[t], minlength=len(front))
        total += np.bincount(front % n, weights=delta[front] * weight[sources][front // n], minlength=n)
    return size, total


def _search_weighted(start, adj, length, source: int):
    """Summed dependencies of every node on the shortest weighted paths from one source."""
    import heapq

    import numpy as np

    n = len(start) - 1
    dist, sigma, before, order = np.full(n, np.inf), np.zeros(n), [[] for _ in range(n)], []
    dist[source], sigma[source] = 0.0, 1.0
    done, heap = np.zeros(n, bool), [(0.0, source)]
    while heap:
        far, v = heapq.heappop(heap)
        if done[v]:
            continue
        done[v] = True
        order.append(v)
        for e in range(start[v], start[v + 1]):
            w, new = adj[e], far + length[e]
            if new < dist[w]:
                dist[w], sigma[w], before[w] = new, sigma[v], [v]
                heapq.heappush(heap, (new, w))
            elif new == dist[w] and not done[w]:
                sigma[w] += sigma[v]
                before[w].append(v)
    delta = np.zeros(n)
    for w in reversed(order):
        for v in before[w]:
            delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
    delta[source] = 0.0
    return delta


def _shared_links(pairs: DataFrame, weight: str | None = None) -> tuple[DataFrame, int, str]:
    """Numbered nodes (i, id), how many they are, and a shared folder with the links as pairs of numbers (x, y, w)."""
    spark = pairs.sparkSession
    pairs = pairs.persist()
    named = checkpoint(nodes(pairs, []).select("i", F.monotonically_increasing_id().alias("id")))
    n = named.count()
    side = lambda c, name: named.select(F.col("i").alias(c), F.col("id").alias(name))
    links = pairs.where("a <> b").select("a", "b", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).distinct()
    edges = links.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y", "w")
    folder = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    edges.write.parquet(folder)
    pairs.unpersist()
    return named, n, folder


def _read_links(folder: str, columns: list[str], kind: str = "float64") -> list:
    """Columns of the links in a shared folder, as arrays; `kind` is that of w."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    table = ds.dataset(folder, schema=pa.schema([("x", pa.int64()), ("y", pa.int64()), ("w", pa.type_for_alias(kind))]), format="parquet").to_table(columns=columns)
    return [table.column(c).to_numpy() for c in columns]


def _drop_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _distances(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (node_id, reached, far) of every node, and the node count.

    Nodes of one neighbour are as far from all others as that neighbour, and 1 more; only the rest is searched, and every
    task sums the distances of all nodes to its own. A task holds the graph and the rows of a block of searches.
    """
    spark = pairs.sparkSession
    named, n, folder = _shared_links(pairs)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewheel.operators.graph_arrays import BitSearch, Folded

        own = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not own:
            return
        g = Folded(*_read_links(folder, ["x", "y"]))
        mine = g.nodes(np.concatenate(own))
        searched, leaves = g.place[mine[g.on[mine] < 0]], mine[g.on[mine] >= 0]
        names = ["id", "at", "reached", "far"]
        if len(searched):
            found, reached, far = BitSearch(g.start, g.adj).distances(searched, g.weight)
            # the leaves of a source are 1 farther than it
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[g.core]), pa.nulls(len(g.core), pa.int64()), pa.array(reached), pa.array(far + reached - found)], names=names)
        if len(leaves):
            yield pa.RecordBatch.from_arrays([pa.array(g.ids[leaves]), pa.array(g.ids[g.on[leaves]]), *[pa.nulls(len(leaves), pa.int64())] * 2], names=names)

    got = checkpoint(named.select("id").repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "id bigint, at bigint, reached bigint, far bigint"))
    core = got.where("at is null").groupBy("id").agg((F.sum("reached") - 1).alias("reached"), F.sum("far").alias("far"))
    leaves = got.where("at is not null").select("id", "at").join(core.withColumnRenamed("id", "at"), "at").select("id", "reached", (F.col("far") + F.col("reached") - 1).alias("far"))
    out = checkpoint(named.join(core.unionByName(leaves), "id", "left").drop("id").withColumnRenamed("i", "node_id"))
    drop_checkpoint(got)
    _drop_folder(spark, folder)
    return out, n


def _dependencies(pairs: DataFrame, weight: str | None = None) -> tuple[DataFrame, int]:
    """Rows (node_id, delta), dependencies of all searches on each node, and the node count.

    The sources are spread over the tasks, which take them in blocks; every task reads all edges, as pairs of numbers,
    from the shared folder. So a task holds the graph (some 50 bytes an edge while it is read) but never all pairs of nodes.
    """
    spark = pairs.sparkSession
    named, n, folder = _shared_links(pairs, weight)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tidewheel.operators.graph_arrays import Folded, csr

        own = [b.column(0).to_numpy() for b in batches if b.num_rows]
        if not own:
            return
        x, y, *w = _read_links(folder, ["x", "y", "w"] if weight else ["x", "y"])
        if weight:
            ids, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
            start, adj = csr(ends[: len(x)], ends[len(x) :], len(ids))
            length = np.tile(w[0], 2)[np.argsort(ends, kind="stable")]
            total = np.zeros(len(ids))
            for source in np.flatnonzero(np.isin(ids, np.concatenate(own))):
                total += _search_weighted(start, adj, length, source)
        else:
            g = Folded(x, y)
            ids, total = g.ids, np.zeros(len(g.ids))
            mine = g.nodes(np.concatenate(own))
            mine = g.place[mine[g.on[mine] < 0]]
            block, size = max(1, _ENTRIES // max(1, len(g.core) + len(g.adj))), np.zeros(len(g.core))
            for part in (mine[k : k + block] for k in range(0, len(mine), block)):
                size[part], delta = _search(g.start, g.adj, part, g.weight)
                total[g.core] += delta
            # all paths of a node's leaves lead over it
            leaves = g.weight[mine] - 1
            total[g.core[mine]] += 2.0 * leaves * (size[mine] - 2) - leaves * (leaves - 1.0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["id", "delta"])

    got = named.select("id").repartition((4 if weight else 2) * spark.sparkContext.defaultParallelism).mapInArrow(run, "id bigint, delta double")
    got = got.groupBy("id").agg(F.sum("delta").alias("delta"))
    out = checkpoint(named.join(got, "id", "left").drop("id").withColumnRenamed("i", "node_id"))
    _drop_folder(spark, folder)
    return out, n


def _refuse(pairs: DataFrame, limit: int | None) -> None:
    if limit is not None and (n := nodes(pairs, []).count()) > limit:
        raise ValueError(f"{n} nodes; path metrics are limited to {limit}")


def closeness(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """node_id, closeness: (r - 1) / sum of distances x (r - 1) / (n - 1), r the nodes reached with itself.

    Searches from every node: time grows as nodes x edges. With a limit, greater graphs are refused.
    """
    _refuse(pairs, limit)
    got, n = _distances(pairs)
    return got.select("node_id", F.coalesce(F.try_divide(F.col("reached") * F.col("reached"), F.col("far") * F.lit(float(max(n - 1, 1)))), F.lit(0.0)).alias("closeness"))


def betweenness(pairs: DataFrame, limit: int | None = None, weight: str | None = None) -> DataFrame:
    """node_id, betweenness, normalised by 2 / ((n - 1)(n - 2)): dependencies are carried back level by level.

    With a positive `weight` of the pairs, paths are as long as the sum of their weights (one search at a time).
    Searches from every node: time grows as nodes x edges. With a limit, greater graphs are refused.
    """
    _refuse(pairs, limit)
    got, n = _dependencies(pairs, weight)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0  # each undirected pair occurs from both ends
    return got.select("node_id", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def simple_graph(edges: DataFrame, source: str, target: str, weight: str | None = None, order: str | None = None) -> DataFrame:
    """Distinct undirected pairs (a, b) of any edge list; rows without an end are dropped.

    With `weight`, also `weight`: of the last of a pair's rows by `order`, without one the greatest; null counts as 1.
    """
    rows = edges.dropna(subset=[source, target])
    if weight is None:
        return _undirected(rows, source, target).distinct()
    rest = {"w": weight} | ({"o": order} if order else {})
    w = F.coalesce(F.col("w").cast("double"), F.lit(1.0))
    return _undirected(rows, source, target, **rest).groupBy("a", "b").agg((F.max(F.struct("o", w.alias("w")))["w"] if order else F.max(w)).alias("weight"))


def all_metrics(edges: DataFrame, source: str, target: str, limit: int | None = None, weight: str | None = None, order: str | None = None) -> DataFrame:
    """Every metric of one graph: local ones, PageRank, eigenvector ('l2'), closeness and betweenness.

    PageRank, the eigenvector and betweenness (as lengths) use the `weight` of the edges where one is named; the others count edges.
    """
    pairs = simple_graph(edges, source, target, weight, order).persist()
    w = "weight" if weight else None
    plain = pairs.select("a", "b")
    out = local_metrics(plain, [])
    for part in (pagerank(pairs, [], weight=w), eigenvector(pairs, [], "l2", weight=w), closeness(plain, limit), betweenness(pairs, limit, w)):
        out = out.join(part, "node_id")
    return out


#: Pairs up to which all metrics of a year are found in one task's arrays (some 100 bytes a pair).
MOST_PAIRS = 5_000_000


def _panel_in_arrays(masks: DataFrame, first: int, last: int, damping: float = 0.85, tolerances: tuple[float, float] = (1e-10, 1e-9)) -> DataFrame:
    """network_panel from the pairs of yearly_masks: the years are spread over the tasks, and nothing is shuffled by year.

    A task reads all pairs and names from the shared folder, where they stay since the result is lazy, and holds the graph of
    one year at a time. Triangles are found once a task.
    """
    spark = masks.sparkSession
    named = checkpoint(nodes(masks, []).select("i", F.monotonically_increasing_id().alias("id")))
    side = lambda c, name: named.select(F.col("i").alias(c), F.col("id").alias(name))
    folder = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    masks.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y", F.col("mask").alias("w")).write.parquet(f"{folder}/links")
    named.write.parquet(f"{folder}/names")
    drop_checkpoint(named)
    tasks = max(1, min(last - first + 1, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.dataset as ds

        from tidewheel.operators.graph_arrays import YearlyGraph

        for k in [int(k) for b in batches for k in b.column(0).to_numpy()]:
            names = ds.dataset(f"{folder}/names", schema=pa.schema([("i", pa.string()), ("id", pa.int64())]), format="parquet").to_table().sort_by("id")
            ids, names = names.column("id").to_numpy(), names.column("i").combine_chunks()
            x, y, mask = _read_links(f"{folder}/links", ["x", "y", "w"], "int64")
            g = YearlyGraph(np.searchsorted(ids, x), np.searchsorted(ids, y), mask, len(ids))
            for year in range(k, last - first + 1, tasks):
                node, *values = g.metrics(year, damping, *tolerances)
                for at in range(0, len(node), 20_000):
                    part = slice(at, at + 20_000)
                    columns = [pa.array(np.full(len(node[part]), first + year, np.int32)), names.take(pa.array(node[part])), *[pa.array(v[part], from_pandas=True) for v in values]]
                    yield pa.RecordBatch.from_arrays(columns, names=["year", "node_id", *_PANEL])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "year int, node_id string, " + ", ".join(f"{c} {'bigint' if c == 'degree' else 'double'}" for c in _PANEL))


_PANEL = ("degree", "degree_centrality", "clustering", "effective_size", "network_constraint", "brokerage", "pagerank", "eigenvector_centrality")


def network_panel(edges: DataFrame, mode: str, first: int, last: int, source: str, target: str, start: str, end: str, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """All metrics that scale for every year first..last: local ones, PageRank and eigenvector centrality.

    Up to most_pairs distinct pairs, a year is found in one task's arrays; beyond, in joins over all years.
    """
    where = (mode, first, last, source, target, start, end)
    masks = yearly_masks(edges, *where).persist()
    if masks.count() <= most_pairs:
        out = _panel_in_arrays(masks, first, last)
        masks.unpersist()
        return out
    pairs = yearly_pairs(edges, *where).persist()
    out = local_metrics_of_years(masks, first, last)
    for part in (pagerank(pairs, ["year"]), eigenvector(pairs, ["year"])):
        out = out.join(part, ["year", "node_id"])
    return out


def connection_panel(edges: DataFrame, source: str, target: str, start: str, first: int, last: int, include_prior: bool = False) -> DataFrame:
    """source, year, n_unique_connected: distinct targets first met in first..year, for every source and year.

    Counts of new targets are summed along the years; the pairs are never repeated per year. Targets first met
    before `first` don't count, unless include_prior is set.
    """
    pairs = edges.groupBy(source, target).agg(F.min(start).alias("y"))
    if include_prior:
        pairs = pairs.withColumn("y", F.greatest("y", F.lit(first)))
    new = pairs.where(F.col("y").between(first, last)).groupBy(source, F.col("y").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("k"))
    grid = edges.select(source).distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    run = Window.partitionBy(source).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(new, [source, "year"], "left").select(source, "year", F.sum(F.coalesce("k", F.lit(0))).over(run).alias("n_unique_connected"))
