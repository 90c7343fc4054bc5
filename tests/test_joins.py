from pyspark.sql import functions as F

from gleanframe.operators.joins import is_small, join_unique


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    rows = spark.range(5000).select(
        "id", F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id")).alias("k")
    )
    unique = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        plain = rows.join(unique, "k", how).select("id", "k", "v")
        salted = join_unique(rows, unique, ["k"], how, hot_rows=100, salts=8).select("id", "k", "v")
        assert sorted(salted.collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)


def test_is_small(spark):
    assert is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)


def test_as_of_against_a_plain_loop(spark):
    import random

    from gleanframe.operators.joins import as_of

    rnd = random.Random(5)
    left = [(i, rnd.choice(["a", "b", "c", None]), rnd.randint(0, 20)) for i in range(200)]
    right = [(rnd.choice(["a", "b", "d", None]), rnd.randint(0, 20), rnd.choice(["x", "y", None]), rnd.randint(0, 3)) for _ in range(60)]
    l_df = spark.createDataFrame(left, "id int, k string, t int")
    r_df = spark.createDataFrame(right, "k string, at int, v string, w int")
    got = {r.id: (r.v, r.w) for r in as_of(l_df, r_df, ["k"], "t", "at", ["v", "w"]).collect()}
    want = {}
    for i, k, t in left:
        earlier = [(at, v, w) for rk, at, v, w in right if rk == k and k is not None and at <= t]
        if not earlier:
            want[i] = (None, None)
        else:
            newest = max(at for at, _, _ in earlier)
            best = max(((v is not None, v or ""), w, v) for at, v, w in earlier if at == newest)
            want[i] = (best[2], best[1])
    assert got == want
