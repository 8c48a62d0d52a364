import os

import pyarrow.parquet as pq

from fillgauge.session import clear_work, fresh_path, settle, together, work_folder


def test_work_folder_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert work_folder(spark) == (named or spark.sparkContext.getCheckpointDir())


def groups(file):
    meta = pq.read_metadata(file.removeprefix("file://"))
    return [meta.row_group(i) for i in range(meta.num_row_groups)]


def test_settle(spark):
    df = spark.range(10).selectExpr("id", "id / 3 AS x")
    out = settle(df)
    assert out.dtypes == df.dtypes and out.exceptAll(df).isEmpty() and out.count() == 10
    assert settle(df.filter("id < 0")).count() == 0
    cut = settle(spark.range(0, 30000, 1, 1).selectExpr("id", "repeat(uuid(), 9) AS x"), **{"parquet.block.size": 1 << 20})
    assert max(g.total_byte_size for f in cut.inputFiles() for g in groups(f)) < 4 << 20
    assert "Range" not in out._jdf.queryExecution().executedPlan().toString()


def test_together_keeps_the_order(spark):
    assert together(spark, [lambda i=i: spark.range(i).count() for i in range(5)]) == list(range(5))
    assert together(spark, [lambda: 1]) == [1]


def test_paths_are_fresh_and_below_the_work_folder(spark):
    a, b = fresh_path(spark, "x"), fresh_path(spark, "x")
    assert a != b and a.startswith(work_folder(spark))


def test_clear_work_removes_only_the_own_folder(spark):
    settle(spark.range(3))
    own = os.path.dirname(fresh_path(spark, "x")).removeprefix("file:")
    assert os.path.isdir(own)
    clear_work(spark)
    assert not os.path.exists(own)
