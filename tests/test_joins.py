import collections

import pytest
from pyspark.sql import functions as F

from fillgauge.operators import joins
from fillgauge.operators.joins import attach, few, hot_key_hashes, is_small, outer_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has key 5, a third NULL, the rest its own key."""
    key = F.when(F.col("id") % 3 == 1, 5).when(F.col("id") % 3 == 2, F.col("id"))
    return spark.range(9000).withColumns({"k": key.cast("long"), "g": F.when(F.col("id") < 8000, "a")})


@pytest.mark.parametrize("on", [["k"], ["k", "g"]])
@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_salted_join_equals_broadcast_join(skewed, on, how, null_safe):
    table = skewed.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or k < 4000 or k is null")
    a = attach(skewed, table, on, how=how, null_safe=null_safe)
    b = attach(skewed, table, on, how=how, null_safe=null_safe, max_broadcast_rows=0)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    if how == "left":
        assert b.count() == 9000


def test_key_types_may_differ(spark, skewed):
    table = spark.createDataFrame([(5, "five")], "k int, name string")
    assert attach(skewed, table, ["k"], max_broadcast_rows=0).filter("name = 'five'").count() == 3001  # id 5 itself


def test_hot_keys_are_found(skewed):
    assert len(hot_key_hashes(skewed, ["k"])) == 2


def test_large_tables_are_not_broadcast(skewed):
    table = skewed.groupBy("k").count()
    plan = attach(skewed, table, ["k"], max_broadcast_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan and "__slice" in plan
    plan = attach(skewed, table, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_wide_tables_are_not_broadcast(spark, monkeypatch):
    table = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"),
                                   F.array(F.lit(1), F.lit(2)).alias("list"))
    assert is_small(table) and not is_small(table, 9) and few(200_000) and not few(200_001)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 5000)
    assert not is_small(table)


def test_how_is_checked(skewed):
    with pytest.raises(ValueError):
        attach(skewed, skewed, ["k"], how="outer")


def test_hot_keys_with_empty_tasks(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else i,) for i in range(4000)], "k int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = hot_key_hashes(rows.repartition(3), ["k"])
        none = hot_key_hashes(rows.limit(0), ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = {r[0] for r in rows.filter("k < 3").select(F.xxhash64("k")).distinct().collect()}
    assert hot <= set(found) and none == []


def brute_outer(left, right, how):
    keys = collections.defaultdict(lambda: ([], []))
    for side, rows in enumerate((left, right)):
        for key, value in rows:
            keys[key][side].append(value)
    out = []
    for key, (a, b) in keys.items():
        out += [(key, x, y) for x in (a or [None]) for y in (b or [None]) if b or how == "outer"]
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["right", "outer"])
@pytest.mark.parametrize("share", [0.005, 0.2, 2.0])
def test_outer_join_with_hot_keys(spark, monkeypatch, how, share):
    """Keys hot on the left, on the right, on both sides, on one side only, NULL on both sides, and cold ones."""
    monkeypatch.setattr(joins, "HOT_SHARE", share)
    left = [(1, i) for i in range(300)] + [(2, 1000 + i) for i in range(5)] + [(None, 2000 + i) for i in range(40)]
    left += [(3, 3000 + i) for i in range(30)] + [(10 + i, 4000 + i) for i in range(60)] + [(4, 5000 + i) for i in range(90)]
    right = [(1, -1), (1, -2)] + [(2, -100 - i) for i in range(200)] + [(None, -400 - i) for i in range(30)]
    right += [(3, -500 - i) for i in range(25)] + [(40 + i, -600 - i) for i in range(60)] + [(5, -700 - i) for i in range(80)]
    a = spark.createDataFrame(left, "k int, a int").repartition(4)
    b = spark.createDataFrame([(b, k) for k, b in right], "b int, k long").repartition(3)
    got = outer_join(a, b, ["k"], how)
    assert got.columns == ["k", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_outer(left, right, how)
    assert sorted(map(tuple, outer_join(a.limit(0), b, ["k"], how).collect()), key=str) == brute_outer([], right, how)


def test_outer_join_spreads_a_hot_key(spark):
    """One key owns half of the rows: no task has more than about twice the usual number."""
    a = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    b = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["n"] for r in outer_join(a, b, ["k"]).filter("k = 7").groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 20_001 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
