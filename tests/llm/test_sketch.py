import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import sketch


def _reference_registers(hashes, precision):
    """Plain integers, one hash after the other."""
    seen = {}
    for h in hashes:
        h &= 2**64 - 1
        rest = h << precision & 2**64 - 1
        seen.setdefault(h >> 64 - precision, set()).add(min(65 - rest.bit_length(), 65 - precision))
    return {i: 4 * max(r) + 2 * (max(r) - 1 in r) + (max(r) - 2 in r) for i, r in seen.items()}


@pytest.mark.parametrize("precision", [4, 12, 14])
def test_registers(precision):
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 900):
        h = np.concatenate([rng.integers(-(2**63), 2**63, n, dtype="int64"), np.array([0, -1, 1, 2**63 - 1, -(2**63)][: n % 7], "int64")])
        got = sketch.registers(h, precision)
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == _reference_registers(h.tolist(), precision)
        a, b = sketch.registers(h[: n // 2], precision), sketch.registers(h[n // 3 :], precision)
        assert (sketch.union(a, b) == got).all() and (sketch.union(b, a) == got).all() and (sketch.union(got, got) == got).all()


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 60000])
def test_error_is_within_bound(spark, n):
    df = spark.range(n).select((F.col("id") * 7919).cast("string").alias("x"), F.lit("g").alias("g"))
    out = sketch.estimate(sketch.sketch(df, ["g"], "x", 12), ["g"], 12).collect()
    if n == 0:
        assert out == []
    else:
        assert out[0]["low"] <= n <= out[0]["high"]
        assert abs(out[0]["estimate"] / n - 1) < 4 * sketch.relative_error(12)


def test_mean_error_matches_theory():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        h = rng.integers(0, 2**63, 5000, dtype="int64").astype("uint64") * 2 + rng.integers(0, 2, 5000).astype("uint64")
        idx, rest = (h >> np.uint64(56)).astype(int), [int(x) & (2**56 - 1) for x in h]
        regs = {}
        for i, x in zip(idx, rest):
            regs[i] = regs.get(i, 0) | 1 << min(56 - x.bit_length(), 56)
        counts = np.zeros((1, 256))
        for b in regs.values():
            top = b.bit_length()
            counts[0, top * 4 + (b >> (top - 2) & 1 if top > 1 else 0) * 2 + (b >> (top - 3) & 1 if top > 2 else 0)] += 1
        errors.append(sketch.likelihood_estimate(counts, 8)[0] / 5000 - 1)
    assert np.std(errors) < 1.35 * sketch.relative_error(8) and abs(np.mean(errors)) < 0.02


def _content(df, keys):
    return sorted((*[str(r[k]) for k in keys], tuple(r["sparse"] or ()), bytes(r["dense"] or b"")) for r in df.collect())


@pytest.mark.parametrize("batch", [3, 10_000])
def test_merge_is_the_sketch_of_the_union(spark, batch):
    """Sparse and dense groups of any size, cut anywhere into parts and batches."""
    rng = np.random.default_rng(2)
    rows = [(g, f"{g}{x}", k) for g, n in (("a", 1), ("b", 100), ("c", 128), ("d", 129), ("e", 5000), (None, 300), ("f", 0)) for x in range(n) for k in range(1 + x % 2)] + [("f", None, 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r[0], r[1], int(r[2])) for r in rows], "g string, x string, k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        whole = _content(sketch.sketch(df.repartition(5), ["g"], "x"), ["g"])
        one, two = sketch.sketch(df.where("k = 0"), ["g"], "x"), sketch.sketch(df.where("k = 1 or g = 'b'"), ["g"], "x")
        assert _content(sketch.merge(one.unionByName(two).unionByName(one), ["g"]), ["g"]) == whole
        fine = sketch.sketch(df, ["g", "k"], "x")
        assert _content(sketch.merge(fine, ["g"]), ["g"]) == whole
        stored = {r["g"]: r for r in sketch.estimate(sketch.sketch(df, ["g"], "x"), ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == 7 and {g for g, r in stored.items() if r["exact"]} == {"a", "b", "c", "f"}
    assert [stored[g]["estimate"] for g in ("a", "b", "c", "f")] == [1, 100, 128, 0] and stored["e"]["low"] <= 5000 <= stored["e"]["high"]
    everything = sketch.estimate(sketch.merge(fine, []), []).collect()
    assert len(everything) == 1 and everything[0]["low"] <= 5658 <= everything[0]["high"]


def test_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a", 1), ("g", None, 1), ("g", "b", 1), ("g", "b", 2), ("h", None, 1)], "g string, x string, sparse int")
    got = {r["g"]: r["estimate"] for r in sketch.estimate(sketch.sketch(df, ["g"], "x"), ["g"]).collect()}
    assert got == {None: 1, "g": 1, "h": 0}
    assert sketch.sketch(df.limit(0), ["g"], "x").count() == 0


def test_running_counts(spark):
    rows = [("a", 2000 + i % 5, f"i{i % 700}") for i in range(3000)] + [("b", 2003, "x"), ("b", 2003, None), ("b", 2004, "x"), ("b", 2004, "y"), (None, 2001, "z")]
    df = spark.createDataFrame(rows, "g string, y int, x string")
    got = {(r["g"], r["y"]): r for r in sketch.running_counts(sketch.sketch(df, ["g", "y"], "x", 12), "g", "y", 12).collect()}
    assert set(got) == {(g, y) for g, y, _ in rows}
    for (g, y), r in got.items():
        true = len({x for gg, yy, x in rows if gg == g and yy <= y and x})
        assert r["estimate"] == (true if r["exact"] else pytest.approx(true, rel=0.06, abs=0.5)) and r["exact"] == (g != "a")
