"""Changes in one commit: readers see all of one generation."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.session import fresh_path, together
from fillgauge.sources import documents
from fillgauge.sources import records as R
from fillgauge.sources.generations import Hadoop, commit, current, generations


@pytest.fixture
def table(spark):
    path = fresh_path(spark, "versions")
    rows = [(i, v, float(i)) for v in (1, 2, 3) for i in range(4)]
    spark.createDataFrame(rows, "id long, status int, x double").write.partitionBy("status").parquet(path)
    return path


def read(spark, path, generation=None):
    return sorted((r["status"], r["id"], r["x"]) for r in R.read_output(spark, path, generation).collect())


def versions(spark, *numbers, x=9.0):
    return spark.createDataFrame([(7, v, x) for v in numbers], "id long, status int, x double")


def save(df, path):
    return R.save_output_data(df, path, delete_before_insert=True, status_col="status")


def test_a_killed_job_leaves_all_versions_old(spark, table, monkeypatch):
    before = read(spark, table)

    @F.udf(T.DoubleType())
    def dies(status):
        if status == 3:
            raise RuntimeError("killed")
        return 5.0

    half = versions(spark, 2, 3).repartition(2, "status").withColumn("x", dies("status"))
    with pytest.raises(Exception, match="killed"):
        save(half, table)
    assert read(spark, table) == before and not Hadoop(spark, table).names("_data")
    # all is written, but the job dies before it commits
    with monkeypatch.context() as m:
        m.setattr(R, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            save(versions(spark, 2, 3), table)
    assert read(spark, table) == before
    save(versions(spark, 2, 3), table)
    assert read(spark, table) == [r for r in before if r[0] == 1] + [(2, 7, 9.0), (3, 7, 9.0)]
    R.vacuum_output(spark, table, keep=1)
    assert len(Hadoop(spark, table).names("_data")) == 1 and len(read(spark, table)) == 6


def test_a_reader_keeps_its_generation(spark, table):
    before = read(spark, table)
    save(versions(spark, 2), table)
    reader = R.read_output(spark, table)
    save(R.read_output(spark, table).withColumn("x", F.col("x") + 1), table)  # computed from the table itself
    assert reader.filter("status = 2").first()["x"] == 9.0
    assert R.read_output(spark, table).filter("status = 2").first()["x"] == 10.0
    assert read(spark, table, 0) == [r for r in before if r[0] != 2][:4] + [(2, 7, 9.0)] + [r for r in before if r[0] == 3]
    with pytest.raises(ValueError):
        R.read_output(spark, table, 17)


def test_appends_are_commits_too(spark, table):
    save(versions(spark, 3), table)
    R.save_output_data(versions(spark, 3, 4, x=1.0).withColumn("more", F.lit(1)), table, status_col="status")
    assert [r for r in read(spark, table) if r[0] > 2] == [(3, 7, 1.0), (3, 7, 9.0), (4, 7, 1.0)]
    assert R.read_output(spark, table).columns == ["id", "x", "status"]


def test_of_two_writers_none_is_lost(spark, table):
    before = read(spark, table)
    together(spark, [lambda v=v: save(versions(spark, v, x=float(v)), table) for v in (2, 3, 5, 6)])
    assert read(spark, table) == [r for r in before if r[0] == 1] + [(v, 7, float(v)) for v in (2, 3, 5, 6)]
    assert generations(spark, table) == [0, 1, 2, 3]


def test_nothing_replaced_and_everything_replaced(spark, table):
    before = read(spark, table)
    save(versions(spark, 1).limit(0), table)
    assert read(spark, table) == before
    save(versions(spark, 1, 2, 3), table)
    assert read(spark, table) == [(v, 7, 9.0) for v in (1, 2, 3)]


def test_numbers_are_taken_once(spark):
    root = fresh_path(spark, "manifests")
    files = Hadoop(spark, root)
    assert files.put_if_absent("a", "x") and not files.put_if_absent("b", "x") and files.text("x") == "a"
    assert files.names() == ["x"] or files.names() == [".x.crc", "x"]
    seen = []

    def change(before):
        seen.append(before)
        if len(seen) == 1:  # another writer is first
            commit(spark, root, lambda _: {"by": "other"})
        return {"by": "me", "after": before}

    assert commit(spark, root, change) == 1
    assert seen[0] is None and current(spark, root) == {"by": "me", "after": {"by": "other"}}


def test_parameters_change_with_their_model(spark):
    folder = fresh_path(spark, "params")
    documents.save_best_params(spark, {"a": 1}, folder)
    assert documents.load_best_params(spark, folder) == {"a": 1}
    root = documents.model_root(folder, "GBM")
    documents.write_json(spark, {"a": 2}, f"{root}/model-x/params")
    commit(spark, root, lambda _: {"model": "model-x", "params": "model-x/params"})
    assert documents.load_best_params(spark, folder) == {"a": 2}
    documents.save_best_params(spark, {"a": 3}, folder)
    assert documents.load_best_params(spark, folder) == {"a": 3} and current(spark, root)["model"] == "model-x"
