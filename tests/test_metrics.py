"""The metric table and group contrasts against plain numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fillgauge.plans import evaluate as E
from fillgauge.plans.metrics import METRICS, REPORT_NAMES, group_metrics, report_names


def expected(y, p, w=5.0):
    y, p = np.asarray(y, float), np.asarray(p, float)
    ok = ~np.isnan(y) & ~np.isnan(p)
    y, p = y[ok], p[ok]
    out = dict.fromkeys(METRICS)
    out["n"] = n = len(y)
    if n == 0:
        return out
    r, e = p - y, 1e-12

    def per(a, q):
        return float(np.percentile(a, q))

    def var(a):
        return float(np.var(a, ddof=1)) if n > 1 else None

    def div(a, b):
        return None if a is None or not b else a / b

    out |= {"rmse": np.sqrt(np.mean(r**2)), "mae": np.mean(abs(r)),
            "mape_pct": 100 * np.mean(abs(r) / np.where(abs(y) < e, e, abs(y))),
            "smape_pct": 100 * np.mean(2 * abs(r) / (abs(y) + abs(p) + e)),
            "resid_var": var(r), "resid_std": None if n == 1 else np.sqrt(var(r)),
            "mean_true": y.mean(), "mean_imp": p.mean(), "var_true": var(y), "var_imp": var(p)}
    out["r2"] = None if np.sum((y - y.mean()) ** 2) == 0 else 1 - np.sum(r**2) / np.sum((y - y.mean())**2)
    if (y >= 0).all() and (p >= 0).all():
        out["rmsle"] = np.sqrt(np.mean((np.log1p(y) - np.log1p(p)) ** 2))
    out["nrmse_mean"] = out["rmse"] / (np.mean(abs(y)) + e)
    out["nmae_mean"] = out["mae"] / (np.mean(abs(y)) + e)
    bias = p.mean() - y.mean()
    out["mean_diff"] = out["mean_bias"] = bias
    out["abs_mean_bias"] = abs(bias)
    out["rel_mean_bias_pct"] = 100 * bias / (abs(y.mean()) + e)
    out["abs_rel_mean_bias_pct"] = abs(out["rel_mean_bias_pct"])
    if n > 1:
        out["smd"] = div(bias, np.sqrt((var(y) + var(p)) / 2))
        out["abs_smd"] = None if out["smd"] is None else abs(out["smd"])
    for s, a in (("true", y), ("imp", p)):
        out[f"iqr_{s}"] = per(a, 75) - per(a, 25)
        out[f"p95p5_{s}"] = per(a, 95) - per(a, 5)
        out[f"mad_{s}"] = float(np.median(abs(a - np.median(a))))
        out[f"var_winsor_{s}"] = var(np.clip(a, per(a, w), per(a, 100 - w)))
    for m in ("var", "iqr", "mad", "p95p5", "var_winsor"):
        out[f"{m}_ratio"] = div(out[f"{m}_imp"], out[f"{m}_true"])
    gaps = [0.0]
    for v in np.unique(np.concatenate([y, p])):
        a, b0, b1 = (y <= v).mean(), (p < v).mean(), (p <= v).mean()
        gaps += [abs(a - b1)] + ([abs(a - b0)] if (y == v).any() else [])
    d = out["ks_stat"] = max(gaps)
    en = np.sqrt(n / 2)
    lam, k = (en + 0.12 + 0.11 / en) * d, np.arange(1, 101)
    out["ks_p"] = min(1.0, max(0.0, np.sum(2 * (-1.0) ** (k - 1) * np.exp(-2 * k**2 * lam**2))))
    return out


def cases():
    rng = np.random.default_rng(0)
    y = np.round(rng.lognormal(7, 1, 400), 2)
    y[:130] = 1000.0
    return {
        "random": (y, np.round(y * rng.normal(1, 0.2, 400), 2)),
        "same": (y, y), "constant": ([5.0] * 4, [5.0, 6.0, 7.0, 8.0]),
        "flat": ([5.0] * 3, [5.0] * 3), "zeros": ([0.0, 0.0, 1.0, 2.0], [0.0, 1.0, 1.0, 3.0]),
        "negative": ([-1.0, 2.0, 3.0], [1.0, 2.0, -3.0]), "one": ([3.0], [4.0]),
        "gaps": ([1.0, np.nan, 3.0, 9.0], [1.0, 2.0, np.nan, 7.0]),
        "none": ([np.nan, 1.0], [1.0, np.nan]), None: ([1.0, 2.0], [2.0, 2.0]),
    }


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b))
            for k, (y, p) in cases().items() for a, b in zip(y, p)]
    return spark.createDataFrame(data, "k string, y_true double, y_pred double").repartition(5)


@pytest.mark.parametrize("limit", [None, 20])
def test_all_metrics(rows, limit):
    got = {r["k"]: r.asDict() for r in group_metrics(rows, ["k"], max_group_rows=limit).collect()}
    assert got.keys() == cases().keys()
    for k, (y, p) in cases().items():
        for m, want in expected(y, p).items():
            have = got[k][m]
            if want is None:
                assert have is None, (k, m, have)
            else:
                assert have is not None and np.isclose(have, want, rtol=1e-9, atol=1e-9), (k, m, have, want)


def test_perfect_imputation(rows):
    r = group_metrics(rows.filter("k = 'same'"), ["k"]).first()
    assert r["rmse"] == 0 and r["r2"] == 1 and r["var_ratio"] == 1 and r["smd"] == 0


def test_other_winsorization(rows):
    r = group_metrics(rows.filter("k = 'random'"), ["k"], winsor_p=20.0).first()
    assert np.isclose(r["var_winsor_imp"], expected(*cases()["random"], w=20)["var_winsor_imp"])


def test_report_names(rows):
    out = report_names(group_metrics(rows, ["k"]))
    assert len(METRICS) == 37 and {"RMSE", "MAPE_%", "KS_p", "AbsSMD"} <= set(out.columns)
    assert set(REPORT_NAMES) <= set(METRICS)


# ---------------------------------------------------------------- versions

REGISTRY = "Status_zapisa int, Method string, MissMech string, MissRate string"


@pytest.fixture(scope="module")
def versions(spark):
    original = spark.createDataFrame(
        [(1, 10.0, 1.0), (2, 20.0, 2.0), (3, 30.0, None), (4, 40.0, 4.0)], "id long, a double, b double")
    frames = {2: spark.createDataFrame([(1, "11", 1.5, 2), (3, "x", 3.5, 2)], "id long, a2 string, b double, STATUS_ZAPISA int"),
              3: spark.createDataFrame([(9, "5", 2.5, 3)], "id long, a2 string, b double, STATUS_ZAPISA int"),
              4: None}
    registry = spark.createDataFrame([(2, "m", "MCAR", "5%")], REGISTRY)
    return registry, frames, original


def long(versions, how):
    registry, frames, original = versions
    out = E.long_rows(registry, frames, original, id_col="id", target_cols=["a", "b"],
                      imputed_map={"a": "a2"}, how_join_original=how)
    return sorted(((r["variable"], r["id"], r["STATUS_ZAPISA"], r["Method"], r["y_pred"], r["y_true"],
                    r["residual"]) for r in out.collect()), key=str)


def test_long_rows(versions):
    assert long(versions, "left") == sorted([
        ("a", 1, 2, "m", 11.0, 10.0, 1.0), ("a", 3, 2, "m", None, 30.0, None),
        ("a", 9, 3, None, 5.0, None, None), ("b", 1, 2, "m", 1.5, 1.0, 0.5),
        ("b", 3, 2, "m", 3.5, None, None), ("b", 9, 3, None, 2.5, None, None)], key=str)
    assert [r for r in long(versions, "inner") if r[1] == 9] == []
    # each version keeps the originals it does not cover
    assert len(long(versions, "right")) == 2 * (4 + 4)
    assert len(long(versions, "outer")) == 2 * (4 + 5)


def test_evaluation(versions):
    registry, frames, original = versions
    rows, summary = E.evaluate_imputations_from_methods(
        registry, frames, original, id_col="id", target_cols=["a", "b"], imputed_map={"a": "a2"})
    got = {(r["STATUS_ZAPISA"], r["variable"]): r for r in summary.collect()}
    assert len(got) == 4 and got[2, "a"]["n"] == 1 and got[2, "a"]["rmse"] == 1.0
    assert got[3, "a"]["n"] == 0 and got[3, "a"]["Method"] is None and got[3, "a"]["rmse"] is None
    with pytest.raises(ValueError):
        E.long_rows(registry, {1: None}, original, id_col="id", target_cols=["a"])


@pytest.fixture(scope="module")
def contrasts(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"variable": rng.choice(["u", "v"], n), "Method": rng.choice(["LGBM", "HD"], n),
                        "sector": rng.choice(["B", "A", "C"], n, p=[0.6, 0.3, 0.1]),
                        "y_true": rng.normal(5, 2, n), "y_pred": rng.normal(6, 2, n)})
    pdf.loc[:9, "y_pred"] = np.nan
    pdf.loc[len(pdf)] = ["u", "LGBM", "D", 1.0, 2.0]  # group of one row
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    return pdf, df


@pytest.mark.parametrize("rule,value", [("population", None), ("most_frequent", None), ("first", None), ("value", "C")])
def test_group_contrasts(contrasts, rule, value):
    pdf, df = contrasts
    got = {(r["Method"], r["variable"], r["group"]): r for r in E.smd_by_group(
        df, "sector", by_keys=["Method"], ref_rule=rule, ref_value=value).collect()}
    seen = 0
    for (method, var), part in pdf.groupby(["Method", "variable"]):
        g = part.groupby("sector").agg(n=("y_true", "size"), mt=("y_true", "mean"), mi=("y_pred", "mean"),
                                       vt=("y_true", "var"), vi=("y_pred", "var"))
        s_all = np.sqrt((part["y_true"].var() + part["y_pred"].var()) / 2)
        s_in = np.sqrt((g["vt"].mean() + g["vi"].mean()) / 2)
        label = {"population": "POPULATION", "most_frequent": g["n"].idxmax(), "first": min(g.index),
                 "value": "C"}[rule]
        ref = (part["y_true"].mean(), part["y_pred"].mean()) if rule == "population" else (
            g.loc[label, "mt"], g.loc[label, "mi"])
        for sector, row in g.iterrows():
            r = got[method, var, sector]
            err = (row["mi"] - ref[1]) - (row["mt"] - ref[0])
            assert r["ref"] == label and r["group_col"] == "sector"
            assert np.isclose(r["SMD_global"], err / s_all) and np.isclose(r["SMD_within"], err / s_in)
            seen += 1
    assert seen == len(got)


def test_contrast_arguments(contrasts):
    _, df = contrasts
    assert E.smd_by_group(df, "sector").count() == 7
    nulls = df.withColumn("sector", F.when(F.col("sector") != "A", F.col("sector")))
    assert {r["ref"] for r in E.smd_by_group(nulls, "sector", ref_rule="first").collect()} == {"B"}
    for bad in ({"ref_rule": "x"}, {"ref_rule": "value"}, {"ref_rule": "value", "ref_value": "Z"}):
        with pytest.raises(ValueError):
            E.smd_by_group(df, "sector", **bad)
    with pytest.raises(KeyError):
        E.smd_by_group(df, "absent")
    with pytest.raises(KeyError):
        E.summarize_by_group(df, "absent")


def test_group_summary(contrasts):
    pdf, df = contrasts
    out = E.summarize_by_group(df, "sector", by_keys=["Method"], winsor_p=10.0).collect()
    for r in out:
        part = pdf[(pdf["Method"] == r["Method"]) & (pdf["variable"] == r["variable"]) & (pdf["sector"] == r["group"])]
        want = expected(part["y_true"], part["y_pred"], 10.0)
        assert r["n"] == want["n"] and np.isclose(r["rmse"], want["rmse"])
        assert want["var_winsor_true"] is None or np.isclose(r["var_winsor_true"], want["var_winsor_true"])
