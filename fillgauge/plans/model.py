"""Gradient-boosted trees on MLlib: tuning, cross-validated training, imputation."""

from __future__ import annotations

import random
import statistics
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fillgauge.functions.values import null_if_nan, nulls_for_nans, require_columns
from fillgauge.operators.categories import (apply_rare_map_train, apply_rare_map_valid,
                                            categorical_columns, fit_rare_map,
                                            resolve_rare_threshold)
from fillgauge.operators.sampling import (kfold, sample_exact, stratified_folds,
                                          subsample_stratified)
from fillgauge.operators.target import (bin_target, inverse_target, rmse_original_scale,
                                        smearing_factor, transform_target)
from fillgauge.operators.joins import attach, is_small
from fillgauge.plans.cells import Cells, handles
from fillgauge.session import settle, together
from fillgauge.sources.documents import model_root, read_json, save_best_params, write_json
from fillgauge.sources.generations import Hadoop, commit, current
from fillgauge.sources.records import save_csv

# Bounds on best_iter / maxIter outside of which the cap is remarked on.
CAP_HIGH, CAP_LOW = 0.9, 0.2

#: Parameters of the trees; ``maxIter`` caps the rounds, of which cross-validation picks the best.
DEFAULTS: dict[str, Any] = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "maxBins": 64}
#: Rounds without a smaller validation error after which later rounds are not looked at.
PATIENCE = 10
#: Rounds a fold is boosted for at first.
FIRST_ROUNDS = 16
#: Slices of the training rows whose targets do not meet in their own encoding.
ENCODING_SLICES = 5
#: Rows of average target that each category's mean is pulled towards, so rare ones do not stand out.
SMOOTHING = 20.0


@dataclass
class FeatureSpec:
    """Which columns are features and how each is treated."""
    numeric: list[str]
    categorical: list[str]

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], force: Sequence[str] = ()) -> FeatureSpec:
        cats = categorical_columns(df, features, force)
        return cls([c for c in features if c not in cats], cats)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Add the model's input columns; a missing number is 0 plus a flag."""
        cols: dict[str, Column] = {}
        for c in self.numeric:
            x = null_if_nan(F.col(c).cast("double"))
            cols[f"__num_{c}"] = F.coalesce(x, F.lit(0.0))
            cols[f"__gap_{c}"] = x.isNull().cast("double")
        for c in self.categorical:
            cols[f"__txt_{c}"] = F.col(c).cast("string")
        return df.withColumns(cols) if cols else df

    def encoded(self, c: str, outputs: int) -> list[str]:
        return [f"__enc{j}_{c}" for j in range(outputs)]

    def inputs(self, codes: Encoding) -> list[str]:
        """The model's input columns."""
        out = [f"__num_{c}" for c in self.numeric] + [f"__gap_{c}" for c in self.numeric]
        for c in self.categorical:
            out += self.encoded(c, len(codes.means))
        return out

    def assembled(self, df: DataFrame, codes: Encoding, taught: Column | None = None) -> DataFrame:
        """``df`` with the vector of features; ``taught`` marks rows that the encoding was fitted on."""
        return self.vector(codes.apply(self.prepared(df), self, taught), codes)

    def vector(self, rows: DataFrame, codes: Encoding) -> DataFrame:
        return VectorAssembler(inputCols=self.inputs(codes), outputCol="__features").transform(rows)


@dataclass
class Encoding:
    """Categories by the mean target of their training rows.

    Splits on it are splits of the categories ordered by that mean.  The table has one row
    per category and is joined, so neither the driver nor a tree holds a list of
    categories, however many there are.  With more than two classes there is one share
    per class.  A category that was not seen has the overall mean.

    A row that taught the encoding gets its category's mean over the other slices of the training rows, so
    its own target does not tell on it; without that a rare category would be its own answer in training
    and nothing at all in validation.
    """
    table: DataFrame | None
    means: list[float]
    #: means without each slice, for training only
    apart: DataFrame | None = None

    @classmethod
    def fit(cls, train: DataFrame, spec: FeatureSpec, classes: int) -> Encoding:
        y = F.col("__label").cast("double")
        targets = [(y == k).cast("double") for k in range(classes)] if classes > 2 else [y]
        if not spec.categorical:
            return cls(None, [0.0] * len(targets))
        means = [float(m or 0.0) for m in train.agg(*[F.avg(t) for t in targets]).first()]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__txt_{c}").alias("value"))
                                    for c in spec.categorical])).alias("cell")
        outputs = range(len(targets))
        sums = settle(
            spec.prepared(train).select(_slice(spec).alias("slice"), cells, *[t.alias(f"t{j}") for j, t in enumerate(targets)])
            .groupBy("cell.column", "cell.value", "slice").agg(
                F.count(F.lit(1)).alias("n"), *[F.sum(f"t{j}").alias(f"t{j}") for j in outputs]))
        whole = Window.partitionBy("column", "value")  # at most one row per slice
        apart = sums.select("column", "value", "slice", *[
            ((F.sum(f"t{j}").over(whole) - F.col(f"t{j}") + F.lit(SMOOTHING * m))
             / (F.sum("n").over(whole) - F.col("n") + F.lit(SMOOTHING))).alias(f"e{j}") for j, m in enumerate(means)])
        table = sums.groupBy("column", "value").agg(*[
            ((F.sum(f"t{j}") + F.lit(SMOOTHING * m)) / (F.sum("n") + F.lit(SMOOTHING))).alias(f"e{j}")
            for j, m in enumerate(means)])
        return cls(settle(table), means, settle(apart))

    def apply(self, rows: DataFrame, spec: FeatureSpec, taught: Column | None = None) -> DataFrame:
        if not spec.categorical:
            return rows
        small = is_small(self.table)
        if taught is not None:
            rows = rows.withColumn("__slice_of", F.when(taught, _slice(spec)))
            small_apart = is_small(self.apart)
        for c in spec.categorical:
            names, text = spec.encoded(c, len(self.means)), f"__txt_{c}"

            def part(table: DataFrame, mark: str, *more: Column, c: str = c) -> DataFrame:
                return table.filter(F.col("column") == c).select(
                    F.col("value").alias(f"__txt_{c}"), *more,
                    *[F.col(f"e{j}").alias(f"{mark}{n}") for j, n in enumerate(spec.encoded(c, len(self.means)))])

            rows = attach(rows, part(self.table, ""), [text], null_safe=True, settled=True, small=small)
            best = {n: [F.col(n)] for n in names}
            if taught is not None:
                rows = attach(rows, part(self.apart, "__apart", F.col("slice").alias("__slice_of")), [text, "__slice_of"],
                              null_safe=True, settled=True, small=small_apart)
                best = {n: [F.col(f"__apart{n}"), F.col(n)] for n in names}
            rows = rows.withColumns({n: F.coalesce(*best[n], F.lit(m)) for n, m in zip(names, self.means)})
            rows = rows.drop(*[f"__apart{n}" for n in names])
        return rows.drop("__slice_of")


def _slice(spec: FeatureSpec) -> Column:
    """Slice of a training row, by all its values: rows alike in everything lie in one."""
    return F.pmod(F.xxhash64("__label", *[f"__num_{c}" for c in spec.numeric], *[f"__txt_{c}" for c in spec.categorical]),
                  F.lit(ENCODING_SLICES)).cast("int")


# ---------------------------------------------------------------- boosting

@dataclass
class Boosted:
    """Boosted trees: one model, or one per class if there are more than two."""
    models: list[Any]
    classes: int

    @classmethod
    def fit(cls, ready: DataFrame, classes: int, params: Mapping[str, Any], seed: int) -> Boosted:
        options = {**DEFAULTS, **{k: v for k, v in params.items() if k not in ("best_iter", "seed", "objective")}}
        options |= {"featuresCol": "__features", "labelCol": "__label", "seed": seed}
        if classes == 0:
            return cls([GBTRegressor(**options).fit(ready)], classes)
        return cls([GBTClassifier(**options).fit(rows) for rows in _per_class(ready, classes)], classes)

    @property
    def rounds(self) -> int:
        return min(m.getNumTrees for m in self.models)

    def errors(self, rows: DataFrame) -> list[float]:
        """Error on ``rows`` after each round: squared error, or logistic loss summed over the classes."""
        if self.classes == 0:
            return list(self.models[0].evaluateEachIteration(rows, "squared"))
        parts = [m.evaluateEachIteration(r) for m, r in zip(self.models, _per_class(rows, self.classes))]
        return [sum(e) for e in zip(*parts)]

    def first(self, rounds: int) -> Boosted:
        """The model after ``rounds`` rounds."""
        return Boosted([_first_trees(m, rounds) for m in self.models], self.classes)

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classes, ``__probability`` (an array by class)."""
        if self.classes == 0:
            return self.models[0].transform(rows)
        if len(self.models) == 1:
            return (self.models[0].transform(rows).withColumn("__probability", vector_to_array("probability"))
                    .drop("rawPrediction", "probability"))
        shares = []
        for k, m in enumerate(self.models):
            m.setPredictionCol(f"__p{k}")
            m.setProbabilityCol(f"__s{k}")
            m.setRawPredictionCol(f"__r{k}")
            rows = m.transform(rows)
            shares.append(vector_to_array(F.col(f"__s{k}"))[1])
        total = sum(shares[1:], shares[0])
        rows = rows.withColumn("__probability", F.array(*[s / total for s in shares]))
        rows = rows.drop(*[f"__{x}{k}" for x in "psr" for k in range(len(self.models))])
        best = F.array_position("__probability", F.array_max("__probability")) - 1
        return rows.withColumn("prediction", best.cast("double"))

    def importances(self) -> list[float]:
        """Gain per slot of the feature vector, averaged over the models."""
        parts = [m.featureImportances.toArray() for m in self.models]
        return (sum(parts[1:], parts[0]) / len(parts)).tolist()


def _per_class(rows: DataFrame, classes: int) -> list[DataFrame]:
    if classes <= 2:
        return [rows]
    return [rows.withColumn("__label", (F.col("__label") == k).cast("double")) for k in range(classes)]


def _first_trees(model: Any, rounds: int) -> Any:
    kind = type(model)
    trees = list(model._java_obj.trees())[:max(1, rounds)]
    gateway = SparkContext._active_spark_context._gateway  # folds run in threads without a session of their own
    held = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    weights = gateway.new_array(gateway.jvm.double, len(trees))
    for i, tree in enumerate(trees):
        held[i], weights[i] = tree, float(model.treeWeights[i])
    package = "regression" if kind is GBTRegressionModel else "classification"
    made = getattr(getattr(gateway.jvm.org.apache.spark.ml, package), kind.__name__)(model.uid, held, weights)
    cut = kind(made)
    cut._resetUid(model.uid)
    cut.setFeaturesCol("__features")
    return cut


def best_round(errors: Sequence[float], patience: int | None = PATIENCE) -> int:
    """Round (from 1) with the smallest error, looking no further than ``patience`` rounds without a smaller one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif patience is not None and i - best >= patience:
            break
    return best + 1


def objective_of(df: DataFrame, target: str, task: str) -> tuple[str, int]:
    """(objective, number of classes) by task and distinct target values."""
    if task == "regression":
        return "regression", 0
    if task != "classification":
        raise ValueError("task must be 'regression' or 'classification'")
    n = df.agg(F.count_distinct(target)).first()[0]
    return ("multiclass" if n > 2 else "binary"), n


# ---------------------------------------------------------------- metrics

def regression_metrics(df: DataFrame, truth: str, prediction: str,
                       smeared: str | None = None) -> DataFrame:
    """(rmse, mae, r2[, rmse_infer_smearing]) over complete rows."""
    y, r = F.col(truth), F.col(prediction) - F.col(truth)
    y = F.when(r.isNotNull(), y)
    out = df.agg(F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"),
                 (F.lit(1.0) - F.try_divide(F.avg(r * r), F.nullif(F.var_pop(y), F.lit(0.0)))).alias("r2"),
                 *([] if smeared is None else [F.sqrt(F.avg(
                     (F.col(smeared) - F.col(truth)) * (F.col(smeared) - F.col(truth))
                 )).alias("rmse_infer_smearing")]))
    return out


def classification_metrics(df: DataFrame, label: str, prediction: str,
                           average: str | None = None) -> DataFrame:
    """(accuracy, precision, recall, f1): class 1 for two classes, else the plain class mean.

    A ratio without cases counts as 0.
    """
    if average is None:
        average = "macro" if df.agg(F.count_distinct(label)).first()[0] > 2 else "binary"
    cells = df.groupBy(F.col(label).cast("double").alias("l"),
                       F.col(prediction).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.explode(F.array(
        F.struct(F.col("l").alias("c"), hit.alias("tp"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("real"),
                 F.col("n").alias("said"))))
    per = cells.select(sides.alias("s")).groupBy("s.c").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.real").alias("real"), F.sum("s.said").alias("said"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))

    tp, real, said = F.col("tp"), F.col("real"), F.col("said")
    per = per.select("c", "tp", "real", ratio(tp, said).alias("pr"), ratio(tp, real).alias("re"),
                     ratio(2 * tp, real + said).alias("f"))

    def mean(c: str) -> Column:
        if average == "macro":
            return F.avg(c)
        return F.coalesce(F.max(F.when(F.col("c") == 1, F.col(c))), F.lit(0.0))

    return per.agg(F.try_divide(F.sum("tp"), F.sum("real")).alias("accuracy"), mean("pr").alias("precision"),
                   mean("re").alias("recall"), mean("f").alias("f1"))


def _logloss(label: Column, probability: Column) -> Column:
    p = F.least(F.greatest(probability, F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.when(label == 1, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p)))


def _score(scored: DataFrame, classes: int, info: Mapping[str, Any]) -> float:
    """Validation error: smaller is better."""
    y = F.col("__label")
    if classes == 0:
        return scored.agg(rmse_original_scale(y, F.col("prediction"), info)).first()[0]
    if classes <= 2:
        return scored.agg(_logloss(y, F.col("__probability")[1])).first()[0]
    own = F.element_at("__probability", (y + 1).cast("int"))
    return scored.agg(-F.avg(F.ln(F.greatest(own, F.lit(1e-15))))).first()[0]


def metric_name(task: str, classes: int, info: Mapping[str, Any]) -> str:
    if task == "regression":
        return "rmse_orig" if info.get("enabled") else "rmse"
    return "binary_logloss" if classes <= 2 else "multi_logloss"


# ---------------------------------------------------------------- folds

def with_folds(df: DataFrame, target: str, id_cols: Sequence[str], k: int, seed: int,
               reg_stratify: Mapping[str, Any] | None) -> DataFrame:
    """Add ``fold``; stratified by target bins if asked for."""
    if reg_stratify and reg_stratify.get("enabled"):
        binned = bin_target(df, target, reg_stratify.get("strategy", "quantiles"),
                            int(reg_stratify.get("n_bins", 10)), name="__bin")
        return stratified_folds(binned, "__bin", id_cols, k,
                                int(reg_stratify.get("random_state", seed))).drop("__bin")
    return kfold(df, id_cols, k, seed)


def _fold_frames(df: DataFrame, spec: FeatureSpec, classes: int, k: int, rare_threshold, rare_fraction
                 ) -> list[DataFrame]:
    """Per fold, stored: input columns, label, validation mark and a number of its own for each row.

    Categories are counted and encoded on the training part of the fold only.  The vector of
    features is put together as it is read.
    """
    out = []
    for i in range(k):
        part = df.withColumn("__valid", F.col("fold") == i)
        train, valid = part.filter("not __valid"), part.filter("__valid")
        if spec.categorical and (rare_threshold or rare_fraction):
            limit = resolve_rare_threshold(train.count(), rare_threshold, rare_fraction)
            rare = settle(fit_rare_map(train, spec.categorical, limit))
            train, valid = (
                apply_rare_map_train(train, rare, spec.categorical, settled=True),
                apply_rare_map_valid(valid, rare, spec.categorical, settled=True))
            part = train.unionByName(valid)
        codes = Encoding.fit(train, spec, classes)
        ready = codes.apply(spec.prepared(part), spec, ~F.col("__valid"))
        ready = ready.select(*spec.inputs(codes), "__label", "__valid", F.monotonically_increasing_id().alias("__row"))
        out.append(spec.vector(settle(ready), codes))
    return out


def _cross_validate(folds: Sequence[DataFrame], classes: int, params: Mapping[str, Any],
                    info: Mapping[str, Any], seed: int, patience: int | None,
                    counted: Sequence[Cells] | None = None) -> tuple[list[float], list[int]]:
    """Per fold the validation error after the best number of rounds, and that number.

    Numbers are boosted over the cells of a fold (:mod:`fillgauge.plans.cells`) where there are few of them;
    ``counted`` has them if other settings were tried on the same folds.  Else a fold is boosted row by row for
    a few rounds, and for twice as many as long as the best round lies within
    ``patience`` of the end: the result of boosting up to the cap, for about twice the rounds it needs.
    """
    options = {**DEFAULTS, **params}
    cap = int(options["maxIter"])
    counted = counted or [Cells(fold, info, seed) for fold in folds]

    def by_cells(cells: Cells) -> tuple[float, int] | None:
        grid = cells.grid(int(options["maxBins"])) if classes == 0 and handles(options) else None
        if grid is None:
            return None
        errors: list[float] = []
        for said in cells.boosted(grid, options):
            errors.append(grid.error(said))
            rounds = best_round(errors, patience)
            if rounds == len(errors):
                best = said
            if patience is not None and rounds + patience <= len(errors):
                break
        return grid.score(best), rounds

    def run(ready: DataFrame, cells: Cells) -> tuple[float, int]:
        found = by_cells(cells)
        if found is not None:
            return found
        train, valid = ready.filter("not __valid"), ready.filter("__valid")
        tried = cap if patience is None else min(cap, FIRST_ROUNDS)
        while True:
            whole = Boosted.fit(train, classes, {**params, "maxIter": tried}, seed)
            rounds = best_round(whole.errors(valid), patience)
            # the same seed grows the same first trees, so more rounds cannot change what was decided
            if tried >= cap or rounds + patience <= tried:
                return _score(whole.first(rounds).transform(valid), classes, info), rounds
            tried = min(cap, 2 * tried)

    done = together(folds[0].sparkSession, [partial(run, *job) for job in zip(folds, counted)])
    return [score for score, _ in done], [rounds for _, rounds in done]


# ---------------------------------------------------------------- training

@dataclass
class TrainedModel:
    """A fitted model with all it needs to predict on the original scale."""
    codes: Encoding
    model: Boosted
    spec: FeatureSpec
    rare_map: DataFrame | None
    target_info: dict[str, Any]
    params: dict[str, Any]
    meta: dict[str, Any]
    train_metrics: dict[str, float] = field(default_factory=dict)
    cv_metrics: dict[str, Any] = field(default_factory=dict)
    cv_results: list[dict[str, Any]] = field(default_factory=list)

    def raw_predictions(self, df: DataFrame, num_iteration: int | None = None) -> DataFrame:
        """``df`` plus the model's columns, on the transformed scale, after so many rounds."""
        rows = df
        if self.rare_map is not None:
            hidden = {c: f"__orig_{c}" for c in self.spec.categorical}
            rows = rows.withColumns({h: F.col(c) for c, h in hidden.items()})
            rows = apply_rare_map_valid(rows, self.rare_map, self.spec.categorical, settled=True)
        rows = self.spec.assembled(rows, self.codes)
        if self.rare_map is not None:
            rows = rows.withColumns({c: F.col(h) for c, h in hidden.items()}).drop(*hidden.values())
        model = self.model
        if num_iteration is not None and num_iteration < model.rounds:
            model = model.first(num_iteration)
        return model.transform(rows)

    def predict(self, df: DataFrame, name: str = "prediction", num_iteration: int | None = None,
                smear: float | None = None, probability: str | None = None) -> DataFrame:
        """``df`` plus predictions on the original scale (with smearing, unless given).

        For classes the prediction is the likeliest class; ``probability`` names a column
        for the probabilities, an array by class.
        """
        if probability is not None and not self.model.classes:
            raise ValueError("only classes have probabilities")
        raw = self.raw_predictions(df, num_iteration)
        value = inverse_target(F.col("prediction"), self.target_info, smear)
        kept = [c for c in df.columns if c not in (name, probability)]
        more = [] if probability is None else [F.col("__probability").alias(probability)]
        return raw.select(*kept, value.alias(name), *more)


def train_final(df: DataFrame, target: str, features: Sequence[str], *, id_cols: Sequence[str],
                task: str = "regression", params: Mapping[str, Any] | None = None,
                target_transform: Mapping[str, Any] | None = None,
                force_cat_cols: Sequence[str] = (), rare_threshold: int | None = None,
                rare_fraction: float | None = None, cv_nfold: int = 5,
                reg_stratify: Mapping[str, Any] | None = None, random_state: int = 42,
                patience: int | None = PATIENCE, rounds: int | None = None,
                folder: str | None = None, prefix: str = "GBM") -> TrainedModel:
    """Cross-validate to find the number of trees, then refit on all rows with a known target.

    Each fold is boosted up to ``maxIter`` rounds and keeps the round with the smallest
    validation error; the final model has the median of these.  ``rounds`` gives the
    number instead, without cross-validation.  A target that is NULL or NaN is unknown.
    Classes are numbered from 0.  Rare categories are counted per fold on its training
    part, and once more on all rows for the final model, which keeps that count for
    prediction.  With ``folder`` the model, its parameters, metadata and importances are
    stored there.
    """
    require_columns(df, [target, *features, *id_cols])
    params = dict(params or {})
    spec = FeatureSpec.of(df, features, force_cat_cols)
    objective, classes = objective_of(df, target, task)
    rows = nulls_for_nans(df.select(*dict.fromkeys([*id_cols, *features, target]))).filter(F.col(target).isNotNull())
    rows, info = transform_target(rows, target, target_transform if task == "regression" else None,
                                  name="__label")
    cap = int(params.get("maxIter", DEFAULTS["maxIter"]))
    cv_metrics: dict[str, Any] = {}
    cv_results: list[dict[str, Any]] = []
    if rounds is None:
        rows = settle(with_folds(rows, "__label", id_cols, cv_nfold, random_state,
                                 reg_stratify if task == "regression" else None))
        folds = _fold_frames(rows, spec, classes, cv_nfold, rare_threshold, rare_fraction)
        scores, trees = _cross_validate(folds, classes, params, info, random_state, patience)
        best_iter = int(statistics.median(trees))
        name = metric_name(task, classes, info)
        ratio = best_iter / cap
        cv_metrics = {f"{name}-mean": statistics.fmean(scores), f"{name}-std": statistics.pstdev(scores),
                      "best_iter": best_iter, "cap": cap, "cap_ratio": ratio,
                      "cap_note": "raise maxIter" if ratio > CAP_HIGH else
                                  "maxIter could be lower" if ratio < CAP_LOW else "ok"}
        sizes = [fold.filter("__valid").count() for fold in folds]
        cv_results = [{"fold": i, "metric": name, "score": s, "best_iter": t, "rows": n}
                      for i, (s, t, n) in enumerate(zip(scores, trees, sizes))]
    else:
        rows, best_iter = settle(rows), rounds

    rare_map, ready = None, rows
    if spec.categorical and (rare_threshold or rare_fraction):
        limit = resolve_rare_threshold(rows.count(), rare_threshold, rare_fraction)
        rare_map = settle(fit_rare_map(rows, spec.categorical, limit))
        ready = apply_rare_map_train(rows, rare_map, spec.categorical, settled=True)
    codes = Encoding.fit(ready, spec, classes)
    ready = settle(spec.assembled(ready, codes, F.lit(True)).select(*rows.columns, "__features"))
    final_params = {**params, "maxIter": max(1, best_iter)}
    model = Boosted.fit(ready, classes, final_params, random_state)

    scored = model.transform(ready)
    z, zhat = F.col("__label"), F.col("prediction")
    if task == "regression":
        if info["enabled"] and info["smearing"]:
            info["smear"] = float(scored.agg(smearing_factor(z, zhat)).first()[0])
        elif info["enabled"]:
            info["smear"] = 1.0
        back = scored.select(F.col(target).cast("double").alias("y"),
                             inverse_target(zhat, info, 1.0).alias("fair"),
                             inverse_target(zhat, info).alias("live"))
        train_metrics = regression_metrics(back, "y", "fair", "live").first().asDict()
    else:
        train_metrics = classification_metrics(scored, "__label", "prediction",
                                               "macro" if classes > 2 else "binary").first().asDict()
    meta = {"task": task, "objective": objective, "features": list(features), "target_col": target,
            "force_cat_cols": list(force_cat_cols), "cv_nfold": cv_nfold, "best_iter": best_iter,
            "target_transform_info": info, "rare_threshold": rare_threshold,
            "rare_fraction": rare_fraction, "id_cols": list(id_cols), "random_state": random_state,
            "numeric": spec.numeric, "categorical": spec.categorical, "classes": classes,
            "encoding_means": codes.means}
    out = TrainedModel(codes, model, spec, rare_map, info, final_params, meta,
                       train_metrics, cv_metrics, cv_results)
    if folder:
        save_model_and_params(out, folder, prefix)
    return out


def impute(df: DataFrame, target: str, trained: TrainedModel) -> DataFrame:
    """Fill the missing values of ``target`` with predictions; known values stay."""
    out = trained.predict(df, "__filled")
    known = null_if_nan(F.col(target)) if dict(df.dtypes)[target] in ("double", "float") else F.col(target)
    return out.withColumn(target, F.coalesce(known, F.col("__filled"))).drop("__filled")


def feature_importance(trained: TrainedModel) -> DataFrame:
    """(feature, gain), largest first; a feature's missing flag and class shares count with it."""
    spec = trained.spec
    per = len(trained.codes.means)
    slots = [*spec.numeric, *spec.numeric, *[c for c in spec.categorical for _ in range(per)]]
    gains = trained.model.importances()
    spark = SparkSession.getActiveSession()
    return (spark.createDataFrame(list(zip(slots, gains)), "feature string, gain double")
            .groupBy("feature").agg(F.sum("gain").alias("gain"))
            .orderBy(F.desc("gain"), "feature"))


# ---------------------------------------------------------------- tuning

# Smallest leaf sizes to try up to a number of rows, and folds for small tables.
LEAF_SIZES = [
    (200_000, [50, 100, 200, 400, 800]),
    (700_000, [100, 200, 400, 800, 1200]),
    (float("inf"), [200, 400, 800, 1200, 2000]),
]
SMALL_TABLE_ROWS, SMALL_TABLE_FOLDS = 50_000, 5


def leaf_sizes(n: int) -> list[int]:
    """Leaf sizes for a search on ``n`` rows, for callers who want them to follow the table."""
    return next(sizes for top, sizes in LEAF_SIZES if n <= top)


def tuning_folds(n: int, cv_nfold: int) -> int:
    """Folds for a search on ``n`` rows, for callers who want more of them for small tables."""
    return SMALL_TABLE_FOLDS if n < SMALL_TABLE_ROWS else cv_nfold


#: Values the random search draws from, unless the caller gives others; the same for every table.
SEARCH_SPACE: dict[str, list] = {
    "stepSize": [0.05, 0.1, 0.2], "maxDepth": [3, 5, 7], "minInstancesPerNode": [20, 100, 500],
    "minInfoGain": [0.0, 0.01], "subsamplingRate": [0.6, 0.8, 1.0], "featureSubsetStrategy": ["0.5", "0.75", "all"]}


@dataclass
class Tuned:
    params: dict[str, Any]
    trials: list[dict[str, Any]]
    sweep: list[dict[str, Any]]
    model: TrainedModel | None = None


def sweep_parameter(folds: Sequence[DataFrame], base: Mapping[str, Any], name: str,
                    candidates: Sequence[Any], *, classes: int, info: Mapping[str, Any], seed: int,
                    patience: int | None = PATIENCE, counted: Sequence[Cells] | None = None
                    ) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """Vary one parameter, all others frozen, and keep the value with the smallest error."""
    tried = []
    for value in candidates:
        scores, trees = _cross_validate(folds, classes, {**base, name: value}, info, seed, patience, counted)
        tried.append({"parameter": name, "value": value, "score": statistics.fmean(scores),
                      "best_iter": int(statistics.median(trees))})
    best = min(tried, key=lambda t: t["score"])
    return {**base, name: best["value"], "best_iter": best["best_iter"]}, tried


def tune(df: DataFrame, target: str, features: Sequence[str], *, id_cols: Sequence[str],
         task: str = "regression", target_transform: Mapping[str, Any] | None = None,
         subsample_n: int | None = None, cv_nfold: int = 3, n_trials: int = 100,
         space: Mapping[str, Sequence] | None = None, max_iter: int = DEFAULTS["maxIter"],
         rare_threshold: int | None = None, rare_fraction: float | None = None,
         reg_stratify: Mapping[str, Any] | None = None,
         sweep: Mapping[str, Sequence] | None = None, seed: int = 42, timeout: float | None = None,
         parallelism: int = 1, patience: int | None = PATIENCE, final_fit: bool = True,
         folder: str | None = None, prefix: str = "GBM") -> Tuned:
    """Seeded random search with cross-validation, then a one-parameter sweep.

    All rows with a known target take part, unless ``subsample_n`` asks for a sample of
    that size to search on; it is stratified by class, or by target bins if ``reg_stratify``
    asks for it.  The final model is fitted on all of them in any case, with the best
    parameters and their number of rounds.  With a ``timeout`` no trial starts after so
    many seconds; each one left out is in ``trials`` with the reason.
    """
    require_columns(df, [target, *features, *id_cols])
    whole = settle(nulls_for_nans(df.select(*dict.fromkeys([*id_cols, *features, target])))
                   .filter(F.col(target).isNotNull()))
    objective, classes = objective_of(whole, target, task)
    rows = whole
    if subsample_n is not None and whole.count() > subsample_n:
        if task == "classification":
            rows = subsample_stratified(rows, target, id_cols, subsample_n, seed)
        elif reg_stratify and reg_stratify.get("enabled"):
            rows = bin_target(rows, target, reg_stratify.get("strategy", "quantiles"),
                              int(reg_stratify.get("n_bins", 10)), name="__bin")
            rows = subsample_stratified(rows, "__bin", id_cols, subsample_n, seed).drop("__bin")
        else:
            rows = sample_exact(rows, id_cols, subsample_n, seed, "tune")
    rows, info = transform_target(rows, target, target_transform if task == "regression" else None,
                                  name="__label")
    rows = settle(with_folds(rows, "__label", id_cols, cv_nfold, seed,
                             reg_stratify if task == "regression" else None))
    spec = FeatureSpec.of(rows, features)
    folds = _fold_frames(rows, spec, classes, cv_nfold, rare_threshold, rare_fraction)
    counted = [Cells(fold, info, seed) for fold in folds]

    space = {"maxIter": [max_iter], **(SEARCH_SPACE if space is None else space)}
    draw = random.Random(seed)
    settings = [{p: draw.choice(list(v)) for p, v in space.items()} for _ in range(n_trials)]
    end = None if timeout is None else time.monotonic() + timeout

    def run(job: tuple[int, dict]) -> dict[str, Any]:
        number, p = job
        if number and end is not None and time.monotonic() > end:
            return {"trial": number, "score": None, "best_iter": None, "params": p, "skipped": "timeout"}
        scores, trees = _cross_validate(folds, classes, p, info, seed, patience, counted)
        return {"trial": number, "score": statistics.fmean(scores),
                "best_iter": int(statistics.median(trees)), "params": p, "skipped": None}

    trials = together(df.sparkSession, [partial(run, job) for job in enumerate(settings)], parallelism)
    best = min((t for t in trials if t["skipped"] is None), key=lambda t: t["score"])
    params = {**best["params"], "best_iter": best["best_iter"]}
    swept: list[dict[str, Any]] = []
    for name, candidates in (sweep if sweep is not None else {"maxBins": [32, 64, 128]}).items():
        params, tried = sweep_parameter(folds, params, name, candidates, classes=classes, info=info,
                                        seed=seed, patience=patience, counted=counted)
        swept += tried
    params["objective"] = objective
    out = Tuned(params, trials, swept)
    if final_fit:
        fit = {p: v for p, v in params.items() if p not in ("best_iter", "objective")}
        out.model = train_final(whole, target, features, id_cols=id_cols, task=task, params=fit,
                                target_transform=target_transform, reg_stratify=reg_stratify,
                                rare_threshold=rare_threshold, rare_fraction=rare_fraction,
                                random_state=seed, rounds=max(1, params["best_iter"]),
                                folder=folder, prefix=prefix)
    if folder:
        save_best_params(df.sparkSession, params, folder, prefix)
    return out


# ---------------------------------------------------------------- storage

def save_model_and_params(trained: TrainedModel, folder: str, prefix: str = "GBM") -> None:
    """Store model, encoding, parameters, metadata and importances below ``folder``/model.

    The parts are written to a new folder, and one commit makes it the model and its
    parameters those that :func:`load_best_params` gives; a job that fails leaves the old ones.
    The importances are CSV.
    """
    spark = SparkSession.getActiveSession()
    root, own = model_root(folder, prefix), f"model-{uuid.uuid4().hex}"
    path = f"{root}/{own}"
    try:
        for k, model in enumerate(trained.model.models):
            PipelineModel([model]).write().save(f"{path}/model_{k}")
        if trained.codes.table is not None:
            trained.codes.table.write.parquet(f"{path}/codes")
        if trained.rare_map is not None:
            trained.rare_map.write.parquet(f"{path}/rare")
        write_json(spark, trained.params, f"{path}/params")
        write_json(spark, trained.meta, f"{path}/meta")
        save_csv(feature_importance(trained).coalesce(1), f"{path}/importance")
    except BaseException:
        Hadoop(spark, root).drop(own)
        raise
    commit(spark, root, lambda before: {"model": own, "params": f"{own}/params"})


def stored_model_path(spark: SparkSession, folder: str, prefix: str = "GBM") -> str:
    """The folder of the model committed last; ``FileNotFoundError`` if there is none."""
    root = model_root(folder, prefix)
    own = (current(spark, root) or {}).get("model")
    if own is None:
        raise FileNotFoundError(f"no model stored below {root}")
    return f"{root}/{own}"


def load_trained_model(spark: SparkSession, folder: str, prefix: str = "GBM") -> TrainedModel:
    """The stored model."""
    base = stored_model_path(spark, folder, prefix)
    meta = read_json(spark, f"{base}/meta")
    params = read_json(spark, f"{base}/params")
    count = meta["classes"] if meta["classes"] > 2 else 1
    try:
        models = [PipelineModel.load(f"{base}/model_{k}").stages[0] for k in range(count)]
    except (AnalysisException, Py4JJavaError) as exc:
        raise FileNotFoundError(f"no model stored below {base}") from exc
    spec = FeatureSpec(meta["numeric"], meta["categorical"])
    codes = Encoding(spark.read.parquet(f"{base}/codes") if spec.categorical else None, meta["encoding_means"])
    rare = None
    if spec.categorical and (meta["rare_threshold"] or meta["rare_fraction"]):
        rare = spark.read.parquet(f"{base}/rare")
    return TrainedModel(codes, Boosted(models, meta["classes"]), spec, rare, meta["target_transform_info"],
                        params, meta)
