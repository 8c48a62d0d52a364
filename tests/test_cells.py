"""Boosting over cells: the trees of MLlib, from rows counted once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillgauge.plans import cells as C
from fillgauge.plans import model as M

ID = ["id"]
LOG = {"method": "log"}


@pytest.fixture(scope="module")
def df(spark):
    """``x`` is above 0: its lowest cut and its missing flag part all rows alike, so that tie changes no prediction."""
    x = (F.col("id") * 37 % 101 + 1).cast("double")
    return spark.range(900).select(
        "id", F.when(F.col("id") % 11 != 0, x).alias("x"), (F.sin("id") * 10).alias("w"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        F.exp(1 + x / 50 + F.sin("id") / 3 + F.cos(F.col("id") * 7) / 5 + (F.col("id") % 3) / 3.0).alias("y"))


@pytest.fixture(scope="module")
def known(df):
    rows, info = M.transform_target(df, "y", LOG, name="__label")
    rows = M.settle(M.with_folds(rows, "__label", ID, 2, 3, None))
    return M._fold_frames(rows, M.FeatureSpec.of(rows, ["x", "w", "kind"]), 0, 2, None, None), info


@pytest.mark.parametrize("more", [
    {"maxDepth": 3, "maxBins": 16}, {"maxDepth": 5, "maxBins": 64, "minInstancesPerNode": 9},
    {"maxDepth": 4, "maxBins": 32, "minInfoGain": 0.01}])
def test_trees_are_those_of_mllib(known, more):
    folds, info = known
    params = {"maxIter": 6, "stepSize": 0.3, **more}
    for fold in folds:
        cells = C.Cells(fold, info, 5)
        grid = cells.grid(params["maxBins"])
        said = list(cells.boosted(grid, params))
        model, valid = M.Boosted.fit(fold.filter("not __valid"), 0, params, 5), fold.filter("__valid")
        assert [grid.error(p) for p in said] == pytest.approx(model.errors(valid))
        assert grid.score(said[3]) == pytest.approx(M._score(model.first(4).transform(valid), 0, info))
        assert grid.counts["n"].sum() == fold.filter("not __valid").count() and grid.counts["valid"].sum() == valid.count()


def test_tuning_counts_the_rows_once_for_all_settings(df, monkeypatch):
    """No setting of numbers boosts row by row, and settings that differ in their trees alone read nothing again."""
    def never(*args):
        raise AssertionError("boosted row by row")

    passes = []
    monkeypatch.setattr(M.Boosted, "fit", never)
    monkeypatch.setattr(C, "_binned", lambda *args, f=C._binned: passes.append(1) or f(*args), raising=False)
    space = {"maxDepth": [2, 3, 4], "stepSize": [0.1, 0.3], "maxIter": [4], "minInstancesPerNode": [5, 20],
             "subsamplingRate": [0.8], "maxBins": [32]}
    found = M.tune(df, "y", ["x", "w", "kind"], id_cols=ID, n_trials=6, space=space, cv_nfold=2, target_transform=LOG,
                   sweep={"maxBins": [16, 32]}, final_fit=False, parallelism=2)
    assert all(t["skipped"] is None and t["score"] > 0 for t in found.trials) and len(found.sweep) == 2
    assert len({t["score"] for t in found.trials}) > 1
    kept = next(t for t in found.sweep if t["value"] == 32)
    assert kept["score"] == pytest.approx(min(t["score"] for t in found.trials))
    assert len(passes) == 2 * 2 * 2  # folds, numbers of bins, and once for the cells and once for the draws


def test_equal_splits_go_to_the_first_feature():
    """Rounding does not decide between features that part the training rows alike."""
    n, s = np.array([3.0, 3.0, 0.0]), np.array([0.3, 2.1, 0.0])
    for noise in (0.0, 1e-15, -1e-15):
        bins = np.array([[0, 1, 0], [1, 0, 0]])
        assert C.grown(bins, [2, 2], n, s * (1 + noise), 1, 1, 0.0) == pytest.approx([0.1, 0.7, 0.1])


def test_every_round_draws_anew(known):
    folds, info = known
    cells = C.Cells(folds[0], info, 5)
    grid = cells.grid(64)
    first = list(cells._rounds(grid, 64, 0.6, 20))  # more than one block
    again = list(C.Cells(folds[0], info, 5)._rounds(grid, 64, 0.6, 20))
    assert all((a[0] == b[0]).all() for a, b in zip(first, again))
    drawn = np.array([n.sum() for n, _ in first]) / grid.counts["n"].sum()
    assert abs(drawn.mean() - 0.6) < 0.03 and len({n.tobytes() for n, _ in first}) == 20
    assert all((n <= grid.counts["n"]).all() for n, _ in first)
    other = next(C.Cells(folds[0], info, 6)._rounds(grid, 64, 0.6, 1))
    assert (other[0] != first[0][0]).any()


def test_rows_alike_in_all_columns_are_drawn_one_by_one(spark):
    rows = spark.range(1000).select(F.lit(None).cast("long").alias("id"), F.lit(1.0).alias("__num_x"), F.lit(2.0).alias("__label"),
                                    (F.col("id") % 2 == 0).alias("__valid"), F.monotonically_increasing_id().alias("__row"))
    cells = C.Cells(M.settle(rows), {"enabled": False}, 1)
    [(n, s)] = cells._rounds(cells.grid(8), 8, 0.5, 1)
    assert 200 < n.sum() < 300 and s.sum() == 2 * n.sum()


def test_many_cells_and_unknown_parameters_go_row_by_row(known, monkeypatch):
    folds, info = known
    params = {"maxIter": 3, "maxDepth": 3, "maxBins": 16, "stepSize": 0.3}
    few = M._cross_validate(folds, 0, params, info, 3, 10)
    monkeypatch.setattr(C, "MAX_CELLS", 3)
    assert C.Cells(folds[0], info, 3).grid(16) is None
    many = M._cross_validate(folds, 0, params, info, 3, 10)
    assert many[1] == few[1] and many[0] == pytest.approx(few[0])
    for other in ({"lossType": "absolute"}, {"featureSubsetStrategy": "0.5"}, {"maxBins": 1}, {"subsamplingRate": 0.0}):
        assert not C.handles({**M.DEFAULTS, **other})
    assert C.handles({**M.DEFAULTS, "featureSubsetStrategy": "all"})
