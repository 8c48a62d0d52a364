"""The metric table: errors, bias, spread and distribution distance per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.functions.values import clip, present
from fillgauge.operators.cumulative import GroupSizes, percentiles
from fillgauge.operators.joins import attach
from fillgauge.operators.robust import ks_two_sample
from fillgauge.session import settle, together

EPS = 1e-12

# The names of the metrics.
METRICS = [
    "rmse", "mae", "r2", "mape_pct", "smape_pct", "rmsle", "nrmse_mean", "nmae_mean",
    "resid_std", "resid_var", "n",
    "mean_true", "mean_imp", "mean_diff", "mean_bias", "abs_mean_bias", "rel_mean_bias_pct",
    "abs_rel_mean_bias_pct", "smd", "abs_smd",
    "var_true", "var_imp", "var_ratio",
    "iqr_true", "iqr_imp", "iqr_ratio", "mad_true", "mad_imp", "mad_ratio",
    "p95p5_true", "p95p5_imp", "p95p5_ratio",
    "var_winsor_true", "var_winsor_imp", "var_winsor_ratio", "ks_stat", "ks_p",
]

# The names used in printed reports where they differ in more than
# the first letter from the names above.
REPORT_NAMES = {
    "rmse": "RMSE", "mae": "MAE", "r2": "R2", "mape_pct": "MAPE_%", "smape_pct": "SMAPE_%",
    "rmsle": "RMSLE", "nrmse_mean": "NRMSE_mean", "nmae_mean": "NMAE_mean",
    "resid_std": "Resid_std", "resid_var": "Resid_var", "mean_true": "Mean_true",
    "mean_imp": "Mean_imp", "mean_diff": "Mean_diff", "rel_mean_bias_pct": "rel_mean_bias_%",
    "abs_rel_mean_bias_pct": "abs_rel_mean_bias_%", "smd": "SMD", "abs_smd": "AbsSMD",
    "var_true": "Var_true", "var_imp": "Var_imp", "var_ratio": "Var_ratio",
    "iqr_true": "IQR_true", "iqr_imp": "IQR_imp", "iqr_ratio": "IQR_ratio",
    "mad_true": "MAD_true", "mad_imp": "MAD_imp", "mad_ratio": "MAD_ratio",
    "p95p5_true": "P95P5_true", "p95p5_imp": "P95P5_imp", "p95p5_ratio": "P95P5_ratio",
    "var_winsor_true": "Var_winsor_true", "var_winsor_imp": "Var_winsor_imp",
    "var_winsor_ratio": "Var_winsor_ratio", "ks_stat": "KS_stat", "ks_p": "KS_p",
}


def report_names(summary: DataFrame) -> DataFrame:
    """The metric table under its report names."""
    return summary.withColumnsRenamed({k: v for k, v in REPORT_NAMES.items()
                                       if k in summary.columns})


def moment_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every metric that needs sums only; one pass with partial aggregation.

    ``rows`` holds ``y_true`` and ``y_pred``; incomplete pairs do not count, but
    their group stays in the result.
    """
    rows = rows.withColumns({c: present(rows, c) for c in ("y_true", "y_pred")})
    pair = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    y = F.when(pair, F.col("y_true"))
    p = F.when(pair, F.col("y_pred"))
    r = p - y
    size = F.abs(y)
    safe = F.when(size < EPS, F.lit(EPS)).otherwise(size)
    logs = F.log1p(F.when(y >= 0, y)) - F.log1p(F.when(p >= 0, p))
    a = rows.groupBy(*keys).agg(
        F.count(r).alias("n"), F.avg(r * r).alias("__mse"), F.avg(F.abs(r)).alias("mae"),
        F.avg(F.abs(r) / safe).alias("__ape"),
        F.avg(2 * F.abs(r) / (size + F.abs(p) + F.lit(EPS))).alias("__sape"),
        F.min(F.least(y, p)).alias("__min"), F.avg(logs * logs).alias("__msle"),
        F.avg(size).alias("__size"), F.var_samp(r).alias("resid_var"),
        F.avg(y).alias("mean_true"), F.avg(p).alias("mean_imp"),
        F.var_pop(y).alias("__vp"), F.var_samp(y).alias("var_true"),
        F.var_samp(p).alias("var_imp"))
    c = F.col
    bias = c("mean_imp") - c("mean_true")
    rel = F.lit(100.0) * bias / (F.abs(c("mean_true")) + F.lit(EPS))
    pooled = F.sqrt((c("var_true") + c("var_imp")) / 2)
    smd = F.try_divide(bias, F.nullif(pooled, F.lit(0.0)))
    mean_size = c("__size") + F.lit(EPS)
    return a.select(
        *keys, "n", F.sqrt("__mse").alias("rmse"), "mae",
        (F.lit(1.0) - F.try_divide(c("__mse"), F.nullif(c("__vp"), F.lit(0.0)))).alias("r2"),
        (c("__ape") * 100).alias("mape_pct"), (c("__sape") * 100).alias("smape_pct"),
        F.when(c("__min") >= 0, F.sqrt("__msle")).alias("rmsle"),
        (F.sqrt("__mse") / mean_size).alias("nrmse_mean"), (c("mae") / mean_size).alias("nmae_mean"),
        F.sqrt("resid_var").alias("resid_std"), "resid_var",
        "mean_true", "mean_imp", bias.alias("mean_diff"), bias.alias("mean_bias"),
        F.abs(bias).alias("abs_mean_bias"), rel.alias("rel_mean_bias_pct"),
        F.abs(rel).alias("abs_rel_mean_bias_pct"), smd.alias("smd"), F.abs(smd).alias("abs_smd"),
        "var_true", "var_imp", _ratio("var_imp", "var_true").alias("var_ratio"))


def _ratio(imp: str, true: str) -> Column:
    return F.try_divide(F.col(imp), F.nullif(F.col(true), F.lit(0.0)))


def spread_metrics(rows: DataFrame, keys: Sequence[str], winsor_p: float = 5.0, *,
                   settled: bool = False, max_group_rows: int | None = None) -> DataFrame:
    """Percentile-based spread, winsorized variance and distribution distance per group.

    The complete pairs are read several times, so they are written out first
    unless ``rows`` is a stored table already (``settled``).
    """
    keys = list(keys)
    pairs = rows.select(*keys, *[present(rows, c).alias(c) for c in ("y_true", "y_pred")])
    pairs = pairs.filter("y_true is not null and y_pred is not null")
    pairs = pairs if settled else settle(pairs)
    series = F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(c).cast("double").alias("value"))
                                 for s, c in (("true", "y_true"), ("imp", "y_pred"))]))
    tall = pairs.select(*keys, series.alias("s")).select(*keys, "s.*")
    by = [*keys, "series"]
    sizes = GroupSizes(tall, by)
    known = {"null_safe": True, "settled": True, "small": sizes.few()}
    options = {"sizes": sizes, "max_group_rows": max_group_rows}
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "p5": 0.05, "p95": 0.95,
             "wlo": winsor_p / 100, "whi": 1 - winsor_p / 100}
    q = settle(percentiles(tall, by, "value", marks, **options))

    def deviation_and_winsor() -> DataFrame:
        seen = attach(tall, q.select(*by, "q50", "wlo", "whi"), by, **known)
        away = seen.select(*by, F.abs(F.col("value") - F.col("q50")).alias("value"))
        mad = percentiles(away, by, "value", {"mad": 0.5}, **options)
        clipped = clip(F.col("value"), F.col("wlo"), F.col("whi"))
        winsor = seen.groupBy(*by).agg(F.var_samp(clipped).alias("var_winsor"))
        return attach(attach(q, mad, by, **known), winsor, by, **known)

    spread, ks = together(rows.sparkSession, [
        deviation_and_winsor,
        lambda: ks_two_sample(pairs, keys, "y_true", "y_pred", max_group_rows=max_group_rows)])
    spread = spread.withColumns({"iqr": F.col("q75") - F.col("q25"), "p95p5": F.col("p95") - F.col("p5")})
    names = ("iqr", "mad", "p95p5", "var_winsor")
    out = spread.groupBy(*keys).agg(*[
        F.max(F.when(F.col("series") == s, F.col(m))).alias(f"{m}_{s}")
        for m in names for s in ("true", "imp")])
    out = out.withColumns({f"{m}_ratio": _ratio(f"{m}_imp", f"{m}_true") for m in names})
    out = attach(out, ks.select(*keys, "ks_stat", "ks_p"), keys, **known)
    return out.select(*keys, *[f"{m}_{s}" for m in names for s in ("true", "imp", "ratio")],
                      "ks_stat", "ks_p")


def group_metrics(rows: DataFrame, keys: Sequence[str], winsor_p: float = 5.0, *,
                  settled: bool = False, max_group_rows: int | None = None) -> DataFrame:
    """One row per group with all metrics; undefined ones are NULL."""
    keys = list(keys)
    narrow = rows.select(*keys, "y_true", "y_pred")
    narrow = narrow if settled else settle(narrow)
    spread = spread_metrics(narrow, keys, winsor_p, settled=True, max_group_rows=max_group_rows)
    out = attach(moment_metrics(narrow, keys), spread, keys, null_safe=True)
    return out.select(*keys, *METRICS)
