"""What operators promise beyond their results: whole files, exact counts, NaN, bounds."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fillgauge.functions.values import md5_key
from fillgauge.operators import aggregate, derive, joins, robust, sampling
from fillgauge.operators.cumulative import percentiles
from fillgauge.plans.metrics import group_metrics
from fillgauge.session import fresh_path
from fillgauge.sources.documents import read_json, write_json
from fillgauge.sources.records import keep_max_status, load_input_data, save_csv


def breaks(df):
    """A table whose computation fails in its last row."""
    return df.withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.lit(1)))


def test_a_failed_job_leaves_the_old_file(spark):
    path = fresh_path(spark, "csv")
    save_csv(spark.range(5), path)
    with pytest.raises(PySparkException):
        save_csv(breaks(spark.range(100)), path)
    assert spark.read.csv(path, header=True).count() == 5
    save_csv(spark.range(7), path)
    assert spark.read.csv(path, header=True).count() == 7


def test_documents_are_replaced(spark):
    path = fresh_path(spark, "json")
    write_json(spark, {"a": 1}, path)
    write_json(spark, {"a": 2}, path)
    assert read_json(spark, path) == {"a": 2}


def test_a_table_can_be_written_onto_its_own_source(spark):
    path = fresh_path(spark, "base")
    spark.range(10).select("id", F.lit(1).alias("status_zapisa")).write.parquet(path)
    base = spark.read.parquet(path)
    edits = base.filter("id < 3").withColumn("status_zapisa", F.lit(7))
    out = load_input_data(base, edits, 7, id_col="id", parquet_path=path)
    assert out.filter("status_zapisa = 7").count() == 3 and out.count() == 10


def test_keep_max_status_by_many_keys(spark):
    df = spark.range(6000).select((F.col("id") % 2000).alias("k"), (F.col("id") / 2000).cast("int").alias("s"))
    got = keep_max_status(df, "s", by=["k"])
    assert got.count() == 2000 and got.agg(F.min("s")).first()[0] == 2


def test_keys_of_different_ids_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("", "c"), ("-", "c")], "p string, q string")
    assert df.select(md5_key(["p", "q"], 1)).distinct().count() == 5


def test_exact_draws_under_repeated_and_null_ids(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("id"), F.col("id").alias("other"))
    nulls = spark.range(7).select(F.when(F.col("id") == 0, 1).alias("id"), F.col("id").alias("other"))
    for k in range(1, 8):
        assert sampling.sample_exact(df, ["id"], k, 1).count() == k
        assert sampling.sample_exact(nulls, ["id"], k, 1).count() == k
        assert sampling.sample_weighted(df, ["id"], F.lit(1.0), k, 1).count() == k
    assert sampling.sample_per_group(df, ["id"], ["id"], 2, 1).count() == 4
    assert sampling.sample_per_group(df, ["id"], ["id"], 2, 1, max_group_rows=1).count() == 4
    with pytest.raises(ValueError, match="alike"):
        sampling.sample_exact(df.select("id"), ["id"], 3, 1).count()


def test_strata_give_the_same_folds_both_ways(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("s"))
    ways = [sampling.stratified_folds(df, "s", ["id"], 4, 9, max_group_rows=n).orderBy("id").collect() for n in (1, 1000)]
    assert ways[0] == ways[1]


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 1.5), ("a", 3.0, nan), ("a", nan, 2.0), ("a", 2.0, 2.0)],
                               "g string, y_true double, y_pred double")
    for operation, want in (("mean", 2.0), ("sum", 6.0), ("min", 1.0), ("max", 3.0), ("std", 1.0), ("count", 3),
                            ("median", 2.0), ("nunique", 3)):
        assert aggregate.group_table(df, ["g"], "v", "y_true", operation).first()["v"] == want, operation
    for limit in (1, 1000):
        assert percentiles(df, ["g"], "y_true", {"q": 0.5}, max_group_rows=limit).first()["q"] == 2.0
        row = group_metrics(df, ["g"], max_group_rows=limit).first()
        assert row["n"] == 2 and row["mae"] == 0.25 and row["iqr_true"] == 0.5
    clipped = robust.winsorize(df, ["g"], "y_true").collect()
    assert sorted(r["winsorized"] for r in clipped if r["winsorized"] is not None) == pytest.approx([1.1, 2.0, 2.9])
    with pytest.raises(ValueError):
        sampling.sample_weighted(df, ["y_pred"], F.col("y_true"), 4, 1)


@pytest.mark.parametrize("condition, want", [
    ("s = O", [0, 2]), ("s = 'O'", [0, 2]), ("s = 'O' AND p > 1", [2]), ("p = 1", [1]), ("s = t", [2]), ("p = -1", [])])
def test_conditions(spark, condition, want):
    df = spark.createDataFrame([(0, "O", 1.0 - 1, "x"), (1, "F", 1.0, "x"), (2, "O", 2.0, "O")],
                               "id int, s string, p double, t string")
    df = df.withColumn("p", F.col("p").cast("int"))
    out = derive.derive_variable(df, "v", "1", condition=condition)
    assert sorted(r["id"] for r in out.collect() if r["v"] == 1) == want


def test_a_map_has_one_type(spark, monkeypatch):
    df = spark.range(5).select(F.col("id").cast("int").alias("v"))
    kinds = set()
    for limit in (200, 1):
        monkeypatch.setattr(derive, "LITERAL_MAP_ENTRIES", limit)
        kinds.add(derive._mapped(df, "v", {1: 10, 2: 20, 3: 30}).dtypes[0][1])
    assert kinds == {"int"}


def test_hot_keys_by_rows_and_broadcasts_by_bytes(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 333 == 0, -1).otherwise(F.col("id")).alias("k"))
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    assert len(joins.hot_key_hashes(rows, ["k"])) == 1
    table = rows.distinct().withColumn("v", F.col("k") * 2)
    out = joins.attach(rows, table, ["k"], max_broadcast_rows=10)
    assert out.count() == 20_000 and out.filter("v <> 2 * k or v is null").count() == 0
    assert joins.few(1000, 10_000_000) and not joins.few(1000, 100_000_000) and not joins.few(300_000)
