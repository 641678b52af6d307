import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import skew
from graphloom.operators.skew import hot_keys, is_blank, neighbour, ranked, with_hot


def test_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" \t\n",), ("　",), ("a",), (" a ",)], "x string")
    assert [r[0] for r in df.select(is_blank(F.col("x"))).collect()] == [True, True, True, True, False, False]


def test_hot_keys(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"))
    assert hot_keys(df, ["k"]) is None
    hot = hot_keys(df, ["k"], hot_rows=100)
    assert [r[0] for r in hot.collect()] == [None]
    marked = with_hot(df, hot, ["k"], F.lit(7))
    assert marked.where("slice = 7").count() == df.where("k is null").count()
    assert marked.where("slice is null").count() == df.where("k is not null").count()


def test_limit_is_absolute(spark):
    df = spark.range(40_000).select((F.col("id") % 200).alias("k"), "id")
    assert hot_keys(df, ["k"], hot_rows=150).count() == 200 and hot_keys(df, ["k"], hot_rows=200) is None


def test_many_hot_keys_are_salted(spark, monkeypatch):
    df = spark.range(3_000).select((F.col("id") % 30).alias("k"), "id")
    right = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    want = sorted((k, i, k * 7) for i in range(3_000) if (k := i % 30) < 20)
    for limit in (10_000, 5):
        monkeypatch.setattr(skew, "MOST_BROADCAST", limit)
        hot = hot_keys(df.where("k < 15 or id < 1500"), ["k"], hot_rows=60)
        assert hot.count() == 15
        assert with_hot(df, hot, ["k"], F.lit(1)).where("slice = 1").count() == 1_500
        assert sorted(map(tuple, skew.looked_up(df, right, ["k"], hot).select("k", "id", "v").collect())) == want
        assert skew.looked_up(df, right, ["k"], hot, "left").where("v is null").count() == 1_000


def test_ranked_large_groups(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("v"))
        want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("v")))
        for hot_rows in (10, 1_000_000):
            got = ranked(df, ["k"], [F.col("v").asc()], "got", hot_rows)
            assert got.join(want, ["k", "v"]).where("got <> want").count() == 0 and got.count() == 20_000
        assert sorted(r.r for r in ranked(df, [], [F.col("v").desc()], "r").collect()) == [*range(1, 20_001)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_neighbour_over_months(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(900), minutes=i), f"v{i}") for i in range(300)] + [("a", None, "none")]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, v string")
    for back, hot_rows in ((True, 10**6), (False, 10**6), (True, 5), (False, 5)):
        got = {r.v: r.near for r in neighbour(df, ["k"], ["at", "v"], "v", "near", back, hot_rows).collect()}
        for k in ("a", "b", None):
            line = [v for kk, at, v in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])) if kk == k]
            for i, v in enumerate(line):
                want = (line[i - 1] if i else None) if back else (line[i + 1] if i + 1 < len(line) else None)
                assert got[v] == want
        assert got["none"] is None
