"""The operators of problems 1, 2, 3, 4 and 7: brute force, and the cases that data of any kind may hold."""

import datetime as dt
import math
import os
import pickle
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewheel.operators.asof import known_at
from tidewheel.operators.intervals import merged_intervals
from tidewheel.operators.keyed_selection import frequent_values, per_key_profile, per_key_quantiles
from tidewheel.operators.mixture_fill import MOST_CODES, Model, fill_missing, fit, fit_report, mark_missing
from tidewheel.operators.orphans import reference_status
from tidewheel.operators.skew import prefix_sums, skew_safe_left_join

D = dt.date


# ---------------------------------------------------------------- problem 1
@pytest.mark.parametrize("kind", ["bigint", "double", "date"])
def test_quantiles_hot_and_cold(spark, kind):
    rng = random.Random(3)
    draw = {"bigint": lambda: rng.choice([-(2**62), rng.randint(-50, 50), 2**62]), "double": lambda: rng.choice([-1.5, 0.0, -0.0, rng.gauss(0, 1e6), 1e-300]), "date": lambda: D(2000, 1, 1) + dt.timedelta(rng.randint(-9000, 9000))}[kind]
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, draw(), draw(), draw()])) for _ in range(1500)]
    rows += [("nan", float("nan"))] if kind == "double" else []
    df = spark.createDataFrame(rows, f"k string, v {kind}").withColumn("__u", F.lit(1)).withColumn("n", F.lit("x"))
    got = {(r["k"], r["prob"]): (r["v"], r["n"], r["n_equal"]) for r in per_key_quantiles(df, ["k"], "v", [0.0, 0.5, 0.9, 1.0], least=300).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        x = sorted(v for kk, v in rows if kk == k and v is not None and v == v)
        for p in (0.0, 0.5, 0.9, 1.0):
            if x:
                v = x[max(1, math.ceil(p * len(x) - 1e-9)) - 1]
                want[(k, p)] = (v, len(x), x.count(v))
    assert got == want


def test_quantiles_empty(spark):
    assert per_key_quantiles(spark.createDataFrame([], "k string, v int"), ["k"], "v", [0.5]).count() == 0


def test_frequent_values(spark):
    rng = random.Random(5)
    rows = [("f" if i % 3 else "g", rng.choice([7, 7, 7, 9, *range(1000, 3000)][: rng.choice([4, 2000])])) for i in range(4000)] + [("f", None)] * 10
    df = spark.createDataFrame(rows, "k string, v int")
    need = 0.03 * len(rows)
    want = {(k, v, n) for (k, v), n in Counter(rows).items() if v is not None and n >= need}
    assert set(frequent_values(df, ["k"], "v", 0.03)) == want and len(want) >= 2
    assert frequent_values(df.limit(0), ["k"], "v", 0.03) == []


def test_profile(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "x", 1), ("a", None, None), (None, "x", 1)], "k string, p string, w int")
    assert [tuple(r) for r in per_key_profile(df, "k", "p", "w", "k").collect()] == [("a", 3, 1, 1)]


def test_skew_safe_join_keeps_everything(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 3 == 0, (F.col("id") % 50).cast("string")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k string, id bigint"))
    small = big.select("k").distinct().withColumn("v", F.concat(F.coalesce("k", F.lit("")), F.lit("!")))
    out = skew_safe_left_join(big, small, ["k"], least=500)
    assert out.count() == 3001 and out.where("k is not null and (v is null or v <> concat(k, '!'))").count() == 0 and out.where("k is null and v is null").count() == 1


def test_skew_safe_join_counts_another_table(spark):
    """Hot keys come from `counted`, so the larger table isn't run once more for that."""
    own = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = own.select("k").distinct().withColumn("v", F.concat("k", F.lit("!")))
    ran = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            ran.add(len(f))
            yield f

    big = own.mapInPandas(seen, own.schema)
    out = skew_safe_left_join(big, small, ["k"], total=1000, least=500, counted=own).collect()
    assert ran.value == 1000
    assert sorted(r["id"] for r in out) == list(range(1000)) and all(r["v"] == r["k"] + "!" for r in out)


def test_prefix_sums(spark):
    df = spark.createDataFrame([("s", i % 5, i, i + 1) for i in range(40)], "k string, c int, o int, v int")
    got = {r["o"]: r["b"] for r in prefix_sums(df, ["k"], "c", ["o"], "v", "b").collect()}
    total = 0
    for c, o in sorted((i % 5, i) for i in range(40)):
        assert got[o] == total
        total += o + 1


# ---------------------------------------------------------------- problem 2
def test_fill_masks_and_values(spark):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        level = rng.uniform(2, 9)
        for y in range(2000, 2012):
            rows.append((f"g{g}", y, math.exp(level + rng.gauss(0, 0.1)), math.exp(level - 1 + rng.gauss(0, 0.1)), 1000 + g % 5))
    truth = {}
    data = []
    for i, (g, y, a, b, c) in enumerate(rows):
        if i % 7 == 0:
            truth[(g, y)] = a
            a = rng.choice([None, -1.0, 0.0, float("nan"), 1e8])
        data.append((g, y, a, b, c if i % 5 else None, "keep"))
    data += [("alone", 2000, None, None, None, "keep"), (None, 2000, None, 5.0, None, "keep"), ("far", 2000, None, 1.0, 1, "keep"), ("far", 2003, 3.0, 1.0, 1, "keep"), ("tie", 2000, 1.0, 1.0, 1001, "keep"), ("tie", 2001, 1.0, 1.0, 1002, "keep"), ("tie", 2002, 1.0, 1.0, None, "keep")]
    df = spark.createDataFrame(data, "g string, y int, a double, b double, c int, a_value string")
    out = fill_missing(df, "g", "y", {"a": (0.0, 1e7), "b": (0.0, 1e7)}, 2, "c", (100, 8999))
    got = {(r["g"], r["y"]): r for r in out.collect()}
    assert out.count() == len(data)
    errors = []
    for key, a in truth.items():
        assert got[key]["a_filled"]
        errors.append(abs(math.log(got[key]["a_value"]) - math.log(a)))
    assert sum(errors) / len(errors) < 0.15  # deviation of the noise is 0.1; without groups it would be near 2
    assert not got[("alone", 2000)]["a_filled"] and got[("alone", 2000)]["a_value"] is None
    assert not got[("far", 2000)]["a_filled"] and got[("far", 2003)]["a_value"] == 3.0
    assert not got[(None, 2000)]["a_filled"] and got[(None, 2000)]["b_value"] == 5.0
    assert got[("tie", 2002)]["c_filled"] and got[("tie", 2002)]["c_value"] in (1001, 1002)
    filled = [r for r in got.values() if r["c_filled"] and r["g"].startswith("g")]
    assert filled and all(r["c_value"] == 1000 + int(r["g"][1:]) % 5 for r in filled)
    assert all(r["b_value"] == r["b"] for r in got.values() if r["b"] is not None)
    marks = mark_missing(df, "g", "y", {"a": (0.0, 1e7), "b": (0.0, 1e7)}, 2, "c", (100, 8999))
    assert marks.columns == [*df.columns, "a_filled", "b_filled", "c_filled"]
    flags = lambda rows: sorted((str(r["g"]), r["y"], r["a_filled"], r["b_filled"], r["c_filled"]) for r in rows)
    assert flags(marks.collect()) == flags(got.values())
    report = fit_report(df, "g", "y", {"a": (0.0, 1e7), "b": (0.0, 1e7)}, 2, "c", (100, 8999)).first()
    assert report["converged"] and report["n_rows"] == len(data) and report["steps"] >= 2
    with pytest.raises(ValueError):
        mark_missing(df, "g", "y", {}, 2, "c", (0, MOST_CODES))


def test_fill_finds_a_known_mixture(spark):
    """Two classes with different slopes: parameters are found again, and the fill is the conditional expectation."""
    import numpy as np

    rng = np.random.default_rng(7)
    n = 4000
    k = rng.random(n) < 0.3
    x = np.where(k, rng.normal(4, 0.5, n), rng.normal(0, 1, n))
    y = np.where(k, 1 - x, 2 * x) + rng.normal(0, 0.3, n)
    seen = rng.random(n) < 0.8
    rows = spark.createDataFrame([(float(a), float(b) if s else None, int(c) if s else None) for a, b, c, s in zip(x, y, k, seen)], "__x0 double, __x1 double, __cat bigint")
    with pytest.warns(RuntimeWarning):
        assert not fit(rows, 2, 2, 2, 1e-9).converged
    model = fit(rows, 2, 2, 400, 1e-6)
    assert model.converged
    j = int(np.argmax(model.mean[:, 0]))
    assert model.weight[j] == pytest.approx(0.3, abs=0.03) and model.mean[j] == pytest.approx([4, -3], abs=0.15) and model.mean[1 - j] == pytest.approx([0, 0], abs=0.15)
    assert model.cov[1 - j][0, 1] == pytest.approx(2, abs=0.2) and model.table[j, model.cats[1]] > 0.95
    again = model.of(model.vector())
    assert isinstance(again, Model) and np.allclose(again.cov, model.cov) and np.allclose(again.table, model.table) and np.allclose(again.weight, model.weight)


def test_fit_plans_no_query_a_pass(spark):
    """The driver keeps every query's plan, so passes that are queries fill its memory."""
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.gauss(6 * (i % 2), 1), rng.gauss(0, 1) if i % 3 else None, i % 2) for i in range(400)], "__x0 double, __x1 double, __cat bigint")
    bus, queries = spark._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore().executionsCount
    bus.waitUntilEmpty(30_000)
    before = queries()
    model = fit(rows, 2, 2, 400, 1e-7)
    bus.waitUntilEmpty(30_000)
    assert model.converged and model.steps >= 6 and queries() - before <= 2


def test_sums_of_a_pass_over_blocks(spark):
    """Against the expectations row by row, for all patterns of missing numbers, negative codes and weights; any number of partitions."""
    import numpy as np
    import pandas as pd

    from tidewheel.operators.mixture_fill import _pack, _statistics, _summed, expect

    rng = np.random.default_rng(2)
    n, d, k = 900, 3, 2
    x = rng.normal(2, 1, (n, d))
    x[rng.random((n, d)) < 0.4] = np.nan
    cat = rng.integers(-3, 2, n).astype(float)
    cat[rng.random(n) < 0.2] = np.nan
    w = rng.integers(1, 5, n).astype(float)
    low = rng.normal(0, 1, (k, d, d))
    table = rng.random((k, 5))
    model = Model(np.array([0.3, 0.7]), rng.normal(2, 1, (k, d)), low @ low.transpose(0, 2, 1) + np.eye(d), {c: c + 3 for c in range(-3, 2)}, table / table.sum(axis=1, keepdims=True))
    frame = pd.DataFrame({f"__x{i}": x[:, i] for i in range(d)} | {"__cat": cat, "__w": w})
    rows = spark.createDataFrame([(*(None if math.isnan(v) else v for v in a), None if math.isnan(c) else int(c), int(v)) for a, c, v in zip(x.tolist(), cat, w)], "__x0 double, __x1 double, __x2 double, __cat bigint, __w bigint")
    got = []
    for parts in (1, 40):
        blocks = rows.repartition(parts).mapInPandas(lambda fs: _pack(fs, d), "block binary").rdd.map(lambda r: pickle.loads(r[0]))
        assert blocks.getNumPartitions() == parts
        got.append(_summed(blocks, lambda bs: _statistics(bs, model), np.add))
    assert np.allclose(got[0], got[1], rtol=1e-9)
    r, filled, extra, like = expect(model, x, np.where(np.isnan(cat), -1, cat + 3).astype("int64"))
    size = 1 + d + d * d
    assert got[0][k * size] == pytest.approx(w @ like)
    for j in range(k):
        own, dev = r[:, j] * w, filled[j] - model.mean[j]
        second = (dev * own[:, None]).T @ dev + sum(own[at].sum() * covs[j] for at, covs in extra)
        assert np.allclose(got[0][j * size : (j + 1) * size], [own.sum(), *(own @ dev), *second.ravel()])
        assert np.allclose(got[0][k * size + 1 :].reshape(k, -1)[j], [own[cat == c].sum() for c in model.cats])
    assert len(list(_pack(iter([frame, frame.head(0)]), d))) == 1 and not list(_pack(iter([frame.head(0)]), d))


def test_guesses_beat_the_group_mean(spark):
    """Held out: values follow the year of their group more than the group."""
    rng = random.Random(3)
    data = []
    for g in range(60):
        for y in range(2000, 2010):
            level = 5 + g % 7 + rng.gauss(0, 0.8)
            data += [(f"g{g}", y, math.exp(level + rng.gauss(0, 0.05)), 7 if g % 2 else 8) for _ in range(rng.randint(1, 3))]
    df = spark.createDataFrame(data, "g string, y int, a double, c int")
    got = fill_missing(df, "g", "y", {"a": (0.0, 1e7)}, 2, "c", (1, 9), guess=True).where("a_guess is not null").collect()
    mine = sum(abs(math.log(r["a_guess"] / r["a"])) for r in got) / len(got)
    base = 0.0
    for r in got:
        rest = [a for g, y, a, _ in data if g == r["g"] and abs(y - r["y"]) <= 2]
        base += abs(math.log((sum(rest) - r["a"]) / (len(rest) - 1) / r["a"])) / len(got)
    assert mine < 0.8 * base and all(r["c_guess"] == r["c"] for r in got)
    assert all(r["a_value"] == r["a"] and not r["a_filled"] for r in got)


def test_fill_empty(spark):
    df = spark.createDataFrame([], "g string, y int, a double")
    out = fill_missing(df, "g", "y", {"a": (0.0, 1e7)}, 2)
    assert out.count() == 0 and out.columns == ["g", "y", "a", "a_value", "a_filled"]


# ---------------------------------------------------------------- problem 3
def test_known_at(spark):
    rng = random.Random(2)
    ch = [(rng.choice("ab"), D(2000, 1, 1) + dt.timedelta(rng.randint(0, 1500)), rng.randint(1998, 2004), rng.random()) for _ in range(80)] + [("a", None, 2000, 1.0), (None, D(2000, 1, 1), 2000, 1.0), ("a", D(2001, 1, 1), None, 1.0)]
    ev = [(rng.choice(["a", "b", "c"]), D(2000, 6, 1) + dt.timedelta(rng.randint(-400, 1500)), i) for i in range(100)] + [(None, D(2001, 1, 1), 1000), ("a", None, 1001)] + [("a", D(2002, 2, 2), 7)] * 2
    e, c = spark.createDataFrame(ev, "k string, t date, __b int"), spark.createDataFrame(ch, "k string, t date, y int, v double")
    out = known_at(e, c, "k", "t", "t", ["y"], ["v"])
    assert known_at(e.withColumn("known_v", F.lit("x")), c, "k", "t", "t", ["y"], ["v"]).columns == out.columns
    assert out.columns == ["k", "t", "__b", "known_y", "known_v"] and out.count() == len(ev)
    for r in out.collect():
        best = max(((y, v) for k, t, y, v in ch if r["k"] and r["t"] and k == r["k"] and t and y is not None and t <= r["t"]), default=(None, None))
        assert (r["known_y"], r["known_v"]) == best
    assert known_at(e, c.limit(0), "k", "t", "t", ["y"], ["v"]).where("known_v is not null").count() == 0
    assert known_at(e.limit(0), c, "k", "t", "t", ["y"], ["v"]).count() == 0


# ---------------------------------------------------------------- problem 4
def test_intervals_match_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a = D(1995, 1, 1) + dt.timedelta(rng.randint(0, 700))
        rows.append((rng.choice(["x", "x", "y", "z"]), a, rng.choice([None, a + dt.timedelta(rng.randint(-3, 12)), a]), rng.random() < 0.01))
    rows += [(None, D(2000, 1, 1), D(2000, 1, 2), False), ("w", None, D(2000, 1, 2), True), ("v", D(2000, 1, 1), None, True)]
    rows += rows[:20]
    got = {tuple(r) for r in merged_intervals(spark.createDataFrame(rows, "k string, s date, e date, o boolean"), "k", "s", "e", "o").collect()}
    want = set()
    for k in "xyzv":
        days, opened = set(), None
        for kk, a, b, o in rows:
            if kk == k and a and o:
                opened = min(opened or a, a)
            elif kk == k and a and b and b >= a:
                days |= {a + dt.timedelta(i) for i in range((b - a).days + 1)}
        if opened:
            days = {d for d in days if d < opened} | {opened}
        runs = []
        for d in sorted(days):
            if runs and d - runs[-1][1] <= dt.timedelta(1):
                runs[-1][1] = d
            else:
                runs.append([d, d])
        for i, (a, b) in enumerate(runs):
            last = opened is not None and i == len(runs) - 1
            want.add((k, "period", a, None if last else b, last))
            if i:
                want.add((k, "gap", runs[i - 1][1] + dt.timedelta(1), a - dt.timedelta(1), False))
    assert got == want
    assert merged_intervals(spark.createDataFrame([], "k string, s date, e date"), "k", "s", "e").count() == 0


# ---------------------------------------------------------------- problem 7
def test_reference_status(spark):
    rng = random.Random(6)
    refs = [(rng.choice("tu"), rng.choice(["1", "2", "3", "4", "5", "6", None]), rng.choice([None, *range(1995, 2011)])) for _ in range(600)]
    span = lambda k: (rng.choice("tu"), k, rng.choice([None, rng.randint(1994, 2012)]) if rng.random() < 0.1 else rng.randint(1994, 2012), rng.choice([None, 1999, 2004, 2008]), rng.choice([True, False, None]))
    parents = [span(rng.choice(["1", "2", "3", None])) for _ in range(14)] + [(a, "4", 1990, None, True) for a in "tu"] + [("t", "6", 2000, 2001, False), ("t", "6", 2005, 2004, None), ("t", "6", 2008, None, False), ("t", "6", 1990, None, True)]
    r = spark.createDataFrame(refs + refs[:50], "table_name string, ref_key string, period int")
    p = spark.createDataFrame(parents + parents[:3], "table_name string, ref_key string, valid_from int, valid_to int, deleted boolean").withColumn("status", F.lit("x")).withColumn("at", F.lit(1))
    want = {}
    for t, k, y in refs + refs[:50]:
        if k is None or y is None:
            continue
        mine = [(-(2**31) if a is None else a, b, d) for tt, kk, a, b, d in parents if (tt, kk) == (t, k)]
        live = [(a, max(a, b) if b is not None else 9999) for a, b, d in mine if not d]
        if not mine:
            status = "missing"
        elif not live:
            status = "deleted"
        elif any(a <= y <= b for a, b in live):
            status = "ok"
        else:
            status = "late" if all(a > y for a, _ in live) else "ended" if all(a <= y for a, _ in live) else "gap"
        want[(t, k, y)] = (want.get((t, k, y), (0,))[0] + 1, status)
    got = {(x["table_name"], x["ref_key"], x["period"]): (x["n_refs"], x["status"]) for x in reference_status(r, p).collect()}
    assert got == want and {s for _, s in want.values()} == {"ok", "late", "ended", "gap", "deleted", "missing"}
    assert reference_status(r.limit(0), p).count() == 0
    assert {x["status"] for x in reference_status(r, p.limit(0)).collect()} == {"missing"}
    assert {x["status"] for x in reference_status(r, p.drop("valid_to").where("ref_key = '6' and valid_from = 1990 or ref_key = '4'")).collect()} == {"missing", "deleted"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_p2_found_has_the_marks_of_the_fitted_mixture(spark, monkeypatch):
    from tidewheel.operators import mixture_fill
    from tidewheel.plans import records

    sf, fit, models = "/root/testdata/sf0.001", mixture_fill.fit, []
    monkeypatch.setattr(mixture_fill, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = {tuple(r) for r in records.p2_found(spark, sf).collect()}
    assert len(models) == 2 and all(m.converged for m in models)
    marked = mixture_fill.mark_missing(*records._panel(spark, sf, "panel_with_returns")).where("siccd_filled")
    assert {r[2:] for r in got if r[1] == "siccd"} == {tuple(r) for r in marked.select("dirid_starting", "gvkey", "year").collect()}
