import random

import pytest

from tidewheel.llm.mixing import mix, plan


def make(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, rng.choice([0, 5, 80, 400])))
            i += 1
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_shares_and_repeats(spark):
    rows, docs = make(spark, {" A ": 300, "a": 50, "B": 40, "c": 20, "other": 9, None: 3})
    targets = spark.createDataFrame([("a", 0.4, 1), ("B", 0.3, 3), ("C", 0.2, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    out, shares = mix(docs, targets, block=256)
    got = out.collect()
    s = {r["source"]: r for r in shares.collect()}
    limit, length = {"a": 1, "b": 3, "c": 4}, {i: n for i, _, n in rows}
    used = {}
    for r in got:
        assert 0 <= r["from_token"] and r["from_token"] + r["n_tokens"] <= length[r["doc_id"]] and r["n_tokens"] > 0
        for k in range(r["from_token"], r["from_token"] + r["n_tokens"]):
            used.setdefault((r["source"], r["doc_id"], k), []).append(r["pass"])
    assert all(len(p) == len(set(p)) <= limit[source] for (source, _, _), p in used.items())
    slots = {}
    for r in sorted(got, key=lambda r: (r["slot"], r["position"])):
        slots.setdefault(r["slot"], []).append(r)
    assert sorted(slots) == list(range(len(slots))) and len(slots) > 40
    for spans in slots.values():  # full, without holes, of one source
        assert [r["position"] for r in spans] == [sum(q["n_tokens"] for q in spans[:i]) for i in range(len(spans))]
        assert sum(r["n_tokens"] for r in spans) == 256 and len({(r["source"], r["block"]) for r in spans}) == 1
    for name, want in (("a", 4 / 9), ("b", 3 / 9), ("c", 2 / 9)):
        assert s[name]["wanted"] == pytest.approx(want) and s[name]["share"] == pytest.approx(want, abs=0.02)
        assert s[name]["tokens_out"] == sum(r["n_tokens"] for r in got if r["source"] == name)
        assert s[name]["unused"] == s[name]["tokens_in"] - len({k for k in used if k[0] == name})
    assert s["gone"]["share"] == 0 and s["gone"]["tokens_in"] == 0
    assert {r["doc_id"] for r in got} <= {i for i, src, n in rows if n and src not in ("other", None)}
    # every stretch of the schedule is near the weights
    half = [slots[i][0]["source"] for i in range(len(slots) // 2)]
    assert abs(half.count("a") / len(half) - 4 / 9) < 0.12


def test_long_document_fills_many_slots(spark):
    docs = spark.createDataFrame([(1, "a", 1000), (2, "b", 30)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 2)], "source string, target_share double, max_repeats int")
    out, shares = mix(docs, targets, block=10)
    got = out.collect()
    assert {r["source"]: r["n_tokens"] for r in got} == {"a": 10, "b": 10} and sorted(r["slot"] for r in got) == list(range(len(got)))
    assert {r["source"]: r["share"] for r in shares.collect()}["b"] == pytest.approx(0.1, abs=0.03)


def test_is_repeatable_and_whole(spark):
    _, docs = make(spark, {"a": 100, "b": 100})
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    one, two = (sorted(mix(d, targets)[0].collect()) for d in (docs, docs.repartition(3)))
    assert one == two


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1), ("b", None, None)], "source string, target_share double, max_repeats int")
    out, shares = mix(docs, targets)
    assert out.count() == 0 and {r["source"]: r["share"] for r in shares.collect()} == {"a": 0.0, "b": 0.0}


def test_plan():
    p = plan({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 4), "c": (1.0, 1)})
    assert p["a"]["quota"] == pytest.approx(40) and p["b"]["passes"] == 4 and plan({}, {"a": (1.0, 1)}) == {}
