import random

import pytest
from pyspark.sql import functions as F

from fillgauge.plans import model as M
from fillgauge.session import fresh_path

ID = ["id"]
FAST = {"maxIter": 3, "maxDepth": 3, "maxBins": 16}


@pytest.fixture(scope="module")
def df(spark):
    kind = F.element_at(F.array(*map(F.lit, ["a", "b", "c", "rare"])),
                        F.when(F.col("id") % 100 == 7, 4).otherwise((F.col("id") % 3 + 1)).cast("int"))
    x = (F.col("id") * 37 % 101).cast("double")
    return spark.range(600).select(
        "id", F.when(F.col("id") % 11 != 0, x).alias("x"), kind.alias("kind"), (F.col("id") % 4).alias("code"),
        F.exp(1 + x / 50 + (F.col("id") % 3) / 3.0).alias("y"),
        (x > 50).cast("int").alias("two"), F.when(x < 30, 0).when(x < 60, 1).otherwise(2).alias("three"))


def test_regression(spark, df):
    folder = fresh_path(spark, "m")
    m = M.train_final(df, "y", ["x", "kind", "code"], id_cols=ID, params=FAST, cv_nfold=2, rare_threshold=20,
                      target_transform={"method": "log"}, force_cat_cols=["code"], folder=folder,
                      reg_stratify={"enabled": True, "n_bins": 4})
    assert m.train_metrics["r2"] > 0.4 and m.target_info["smear"] > 0
    assert 1 < m.cv_metrics["best_iter"] <= 3 and len(m.cv_results) == 2 and "rmse_orig-mean" in m.cv_metrics
    assert {r["value"] for r in m.rare_map.filter("is_rare").collect()} == {"rare"}
    gains = M.feature_importance(m).collect()
    assert gains[0]["feature"] == "x" and abs(sum(r["gain"] for r in gains) - 1) < 1e-9

    back = M.load_trained_model(spark, folder)
    new = df.withColumn("kind", F.when(F.col("id") == 5, "never seen").otherwise(F.col("kind")))
    a = {r["id"]: r["prediction"] for r in m.predict(new).collect()}
    assert a == {r["id"]: r["prediction"] for r in back.predict(new).collect()} and len(a) == 600
    assert back.params["maxIter"] == m.cv_metrics["best_iter"]
    assert new.exceptAll(m.predict(new).drop("prediction")).isEmpty()

    one = {r["id"]: r["prediction"] for r in m.predict(df, num_iteration=1).collect()}
    many = {r["id"]: r["prediction"] for r in m.predict(df, num_iteration=99).collect()}
    whole = {r["id"]: r["prediction"] for r in m.predict(df).collect()}
    assert one != whole or m.cv_metrics["best_iter"] == 1
    assert all(abs(many[i] - whole[i]) < 1e-9 * abs(whole[i]) for i in whole)

    holes = df.withColumn("y", F.when(F.col("id") % 5 != 0, F.col("y")))
    filled = {r["id"]: r["y"] for r in M.impute(holes, "y", m).collect()}
    known = {r["id"]: r["y"] for r in df.collect()}
    assert all(filled[i] == known[i] for i in known if i % 5) and all(v > 0 for v in filled.values())
    with pytest.raises(FileNotFoundError):
        M.load_trained_model(spark, folder, "OTHER")


@pytest.mark.parametrize("target,objective,metric", [("two", "binary", "binary_logloss"), ("three", "multiclass", "multi_logloss")])
def test_classification(df, target, objective, metric):
    m = M.train_final(df, target, ["x", "kind"], id_cols=ID, task="classification", cv_nfold=2,
                      params={"maxIter": 2, "maxDepth": 2})
    assert m.meta["objective"] == objective and f"{metric}-mean" in m.cv_metrics
    assert m.train_metrics["accuracy"] > 0.8
    out = m.predict(df, probability="p")
    assert out.agg(F.avg((F.col("prediction") == F.col(target)).cast("int"))).first()[0] > 0.8
    rows = out.select("prediction", "p").collect()
    assert all(abs(sum(r["p"]) - 1) < 1e-9 and r["p"][int(r["prediction"])] == max(r["p"]) for r in rows)
    one = {r["id"]: r["p"] for r in m.predict(df, num_iteration=1, probability="p").collect()}
    assert all(0 < x < 1 for p in one.values() for x in p)
    assert abs(sum(r["gain"] for r in M.feature_importance(m).collect()) - 1) < 1e-9


def test_rounds_are_chosen_by_the_smallest_error(df):
    assert M.best_round([5, 4, 3, 2.5, 2.6, 2.7]) == 4 and M.best_round([1, 2, 3]) == 1
    assert M.best_round([5, 4, 4.1, 4.2, 3], patience=2) == 2 and M.best_round([5, 4, 4.1, 4.2, 3], patience=None) == 5
    options = dict(id_cols=ID, cv_nfold=2, params={"maxIter": 15, "maxDepth": 2, "stepSize": 0.3})
    many = M.train_final(df, "y", ["x", "kind"], **options)
    one = M.train_final(df, "y", ["x", "kind"], **{**options, "params": {"maxIter": 1, "maxDepth": 2}})
    assert many.cv_metrics["best_iter"] > 1
    assert many.cv_metrics["rmse-mean"] < 0.8 * one.cv_metrics["rmse-mean"]
    given = M.train_final(df, "y", ["x", "kind"], rounds=4, **options)
    assert given.model.rounds == 4 and given.cv_results == []


def test_many_categories_and_nan_targets(df):
    wide = df.withColumn("own", F.concat(F.lit("c"), F.col("id").cast("string"))).withColumn(
        "y", F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    m = M.train_final(wide, "y", ["own", "x"], id_cols=ID, params=FAST, cv_nfold=2)
    assert m.codes.table.count() == 600 - 86
    filled = M.impute(wide, "y", m)
    assert filled.filter(F.col("y").isNull() | F.isnan("y")).count() == 0


def test_tuning(spark, df):
    folder = fresh_path(spark, "t")
    space = {"maxDepth": [2, 3], "stepSize": [0.1, 0.3], "maxIter": [2], "minInstancesPerNode": [5]}
    opts = dict(id_cols=ID, n_trials=2, space=space, cv_nfold=2, sweep={"maxBins": [8, 16]}, seed=3)
    t = M.tune(df, "y", ["x", "kind"], folder=folder, subsample_n=300, rare_fraction=0.01, **opts)
    assert len(t.trials) == 2 and len(t.sweep) == 2
    assert t.params["maxBins"] in (8, 16) and t.params["objective"] == "regression"
    assert t.model.train_metrics["rmse"] > 0
    from fillgauge.sources.documents import load_best_params
    assert load_best_params(spark, folder) == t.params
    again = M.tune(df, "y", ["x", "kind"], subsample_n=300, rare_fraction=0.01, final_fit=False, **opts)
    assert [x["params"] for x in again.trials] == [x["params"] for x in t.trials]
    late = M.tune(df, "two", ["x"], task="classification", subsample_n=300, timeout=0.0, final_fit=False, **opts)
    assert [x["skipped"] for x in late.trials] == [None, "timeout"] and late.trials[1]["score"] is None
    assert t.model.model.rounds == t.params["best_iter"]
    gains = spark.read.csv(f"{M.stored_model_path(spark, folder)}/importance", header=True).collect()
    assert {r["feature"] for r in gains} == {"x", "kind"}


def test_rules():
    assert M.tuning_folds(49_999, 3) == 5 and M.tuning_folds(50_000, 3) == 3
    assert M.leaf_sizes(200_000)[0] == 50 and M.leaf_sizes(200_001)[0] == 100 and M.leaf_sizes(10**9)[-1] == 2000


def test_arguments(df):
    with pytest.raises(ValueError):
        M.train_final(df, "y", ["x"], id_cols=ID, task="ranking")
    with pytest.raises(KeyError):
        M.train_final(df, "y", ["absent"], id_cols=ID)
    regression = M.train_final(df, "y", ["x"], id_cols=ID, rounds=1)
    with pytest.raises(ValueError):
        regression.predict(df, probability="p")


def test_classification_scores(spark):
    rows = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 3)]
    df = spark.createDataFrame(rows, "l int, p int")
    r = M.classification_metrics(df, "l", "p").first()
    assert r["accuracy"] == pytest.approx(0.4)
    assert r["precision"] == pytest.approx((1 + 1 / 3 + 0 + 0) / 4)
    assert r["recall"] == pytest.approx((0.5 + 1 + 0 + 0) / 4)
    assert r["f1"] == pytest.approx((2 / 3 + 0.5 + 0 + 0) / 4)
    none = spark.createDataFrame([(0, 0), (0, 0)], "l int, p int")
    r = M.classification_metrics(none, "l", "p").first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_boosting_stops_where_the_full_cap_would(df):
    """The same rounds and errors as with the cap in one go, and the same first trees."""
    rows, info = M.transform_target(df.filter("y is not null"), "y", None, name="__label")
    rows = M.settle(M.with_folds(rows, "__label", ID, 2, 3, None))
    folds = M._fold_frames(rows, M.FeatureSpec.of(rows, ["x", "kind"]), 0, 2, None, None)
    params = {"maxIter": 24, "maxDepth": 2, "stepSize": 0.9, "minInstancesPerNode": 5}
    long = M.Boosted.fit(folds[0].filter("not __valid"), 0, params, 3).errors(folds[0])
    short = M.Boosted.fit(folds[0].filter("not __valid"), 0, {**params, "maxIter": 4}, 3).errors(folds[0])
    assert short == pytest.approx(long[:4])
    first, M.FIRST_ROUNDS = M.FIRST_ROUNDS, 2
    try:
        doubled = M._cross_validate(folds, 0, params, info, 3, 3)
        M.FIRST_ROUNDS = 1000
        whole = M._cross_validate(folds, 0, params, info, 3, 3)
    finally:
        M.FIRST_ROUNDS = first
    assert doubled[1] == whole[1] and doubled[0] == pytest.approx(whole[0])


def test_a_feature_of_unique_labels_tells_nothing(spark):
    """A category that occurs once is not its own answer."""
    rng = random.Random(2)
    rows = [(i, f"only {i}", rng.choice("ab"), rng.gauss(0, 1)) for i in range(400)]
    rows = [(i, u, k, y + 3 * (k == "a")) for i, u, k, y in rows]
    df = spark.createDataFrame(rows, "id long, u string, kind string, y double")
    gains = {r["feature"]: r["gain"] for r in M.feature_importance(M.train_final(
        df, "y", ["u", "kind"], id_cols=["id"], rounds=1, params={"maxDepth": 3, "minInstancesPerNode": 1})).collect()}
    assert gains["kind"] > 0.95 and gains["u"] < 0.05
