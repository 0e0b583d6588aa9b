"""Places, rolling windows and quota samples against the plain window, and what their tasks hold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewright.operators import rollouts as RO
from scorewright.operators import sampling as S
from scorewright.operators.ordered import placed, rolling


def steps(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["tool", "view", "view", "view", None]), k, rng.random() if rng.random() < 0.9 else None, rng.random() / 20) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "reward string, step long, mean double, std double")


def test_places(spark):
    df = steps(spark, 500).repartition(7)
    got = sorted(map(tuple, placed(df, ["reward"], ["step"]).select("reward", "step", "pos").collect()), key=repr)
    order = Window.partitionBy("reward").orderBy("step")
    assert got == sorted(map(tuple, df.select("reward", "step", F.row_number().over(order).cast("long") - 1).collect()), key=repr)
    same = spark.createDataFrame([("a", 1)] * 300, "k string, v int")
    assert sorted(r["pos"] for r in placed(same, ["k"], ["v"]).collect()) == list(range(300))
    assert placed(same.limit(0), ["k"], ["v"]).collect() == []


@pytest.mark.parametrize("width", [49, 50, 70, 100_000])
def test_rolling_stats(spark, width):
    df = steps(spark, 600)
    order = Window.partitionBy("reward").orderBy("step")
    last = order.rowsBetween(-49, 0)
    flag = RO.saturated("mean", "std", F.when(F.col("reward") == "tool", 1.0).otherwise(0.0))
    rows = df.withColumns({"k": F.row_number().over(order).cast("double"), "flag": flag})
    n = F.count("mean").over(last)
    slope = F.when(n >= 5, F.coalesce(F.regr_slope("mean", "k").over(last), F.lit(0.0))).otherwise(0.0)
    want = rows.select("reward", "step", F.avg("mean").over(last), F.avg("std").over(last), F.avg("flag").over(last), slope, n)
    got = RO.rolling_stats(df, width=width).select("reward", "step", "rolling_mean", "rolling_std", "saturation", "slope", "n")
    plain = lambda f: sorted(([x if not isinstance(x, float) else round(x, 9) for x in r] for r in f.collect()), key=repr)
    assert plain(got) == plain(want)


def test_a_hot_key_is_many_partitions(spark):
    """Ten times the rows of three keys make no window partition larger."""

    def most(n):
        df = spark.range(n).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
        rows = rolling(df, ["k"], ["v"], 50, lambda w: {"held": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}, 1000)
        return rows.agg(F.max("held"), F.count("*")).first()

    assert most(9_000) == most(90_000)[:1] + (9_000,) == (1049, 9_000)


def ranked(df, by, limits, draw):
    rows = df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(draw, "id")))
    same = [rows[c].eqNullSafe(limits[c]) for c in by]
    return sorted((r["id"] for r in rows.join(limits, same).where("rn <= quota").select("id").collect()))


def test_quota_samples_have_the_members_of_a_ranking(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(k, rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y", None])) for k in range(3000)], "id long, kind string, source string")
    limits = spark.createDataFrame([("a", "x", 100), ("a", "y", 10_000), ("b", None, 7), (None, "x", 1), ("c", "x", 5), ("b", "y", 0)], "kind string, source string, quota long")
    for draw in (F.xxhash64(F.lit(1), "id"), F.lit(0).cast("long"), (F.xxhash64("id") % 5) * (1 << 60)):
        found = S.quota_sample(df, ["kind", "source"], limits, draw, "id")
        assert found.columns == df.columns
        assert sorted(r["id"] for r in found.collect()) == ranked(df, ["kind", "source"], limits, draw)
    assert S.quota_sample(df.limit(0), ["kind", "source"], limits, F.lit(0).cast("long"), "id").collect() == []


def test_no_window_sees_a_stratum(spark):
    """The rows that are ranked are those of one cell, a square root of the stratum."""
    df = spark.range(1 << 16).select("id", F.lit("a").alias("kind"))
    found = S.quota_sample(df, ["kind"], spark.createDataFrame([("a", 30_000)], "kind string, quota long"), F.xxhash64("id"), "id")
    cell = df.withColumn("c", F.shiftright(F.xxhash64("id"), 64 - 8)).groupBy("c").count().agg(F.max("count")).first()[0]
    assert cell < 400 and found.count() == 30_000
