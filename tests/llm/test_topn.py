import random

from pyspark.sql import functions as F

from tidewheel.llm.topn import top_n

def order():
    return [F.col("s").desc_nulls_last(), F.col("i"), F.col("j")]


def brute(rows, n):
    out = {}
    for g, s, i, j, e in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] or "", r[3])):
        kept = out.setdefault(g, [])
        if len(kept) < n and (i, j) not in kept:
            kept.append((i, j))
    return {(g, *x) for g, v in out.items() for x in v}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None, ""]), rng.choice([None, 1.0, 2.0, rng.random()]), rng.choice("pqrst"), rng.randint(0, 9), "x") for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, s double, i string, j int, seen string").repartition(7)
    for n in (1, 5, 1000):
        out = top_n(df, ["g"], order(), ["i", "j"], n)
        got = [(r["g"], r["i"], r["j"]) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, n) and out.columns == df.columns


def test_empty_and_none(spark):
    df = spark.createDataFrame([], "g string, s double, i string, j int")
    assert top_n(df, ["g"], order(), ["i", "j"], 3).count() == 0
    one = spark.createDataFrame([("a", 1.0, "p", 1)], "g string, s double, i string, j int")
    assert top_n(one, ["g"], order(), ["i", "j"], 0).count() == 0


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(f"g{i % 4}", float(i), "p", i, "x") for i in range(60)]
        got = {(r["g"], r["i"], r["j"]) for r in top_n(spark.createDataFrame(rows, "g string, s double, i string, j int, e string"), ["g"], order(), ["i", "j"], 4).collect()}
        assert got == brute(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_any_batch_size(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.choice([None, float(rng.randint(0, 4))]), rng.choice(["p", "q", None]), rng.randint(0, 3), "x") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, s double, i string, j int, e string").repartition(3)
    want = {}
    for g, s, i, j, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is not None, r[2] or "", r[3])):
        kept = want.setdefault(g, [])
        if len(kept) < 5 and (i, j) not in kept:
            kept.append((i, j))
    for size in ("1", "2", "7", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = sorted((str(r["g"]), str(r["i"]), r["j"]) for r in top_n(df, ["g"], order(), ["i", "j"], 5).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted((str(g), str(i), j) for g, v in want.items() for i, j in v)
