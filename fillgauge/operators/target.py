"""Target transforms, their inverse, and binning of a continuous target."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.operators.cumulative import percentiles

OFF: dict[str, Any] = {"enabled": False}


def transform_target(df: DataFrame, target: str, spec: Mapping[str, Any] | None,
                     name: str = "z") -> tuple[DataFrame, dict[str, Any]]:
    """Add the transformed target ``name``; values outside the domain are an error."""
    if not spec:
        return df.withColumn(name, F.col(target).cast("double")), dict(OFF)
    method, eps = spec.get("method", "log"), float(spec.get("eps", 0.0))
    y = F.col(target).cast("double")
    if method == "log":
        outside, z = y + F.lit(eps) <= 0, F.ln(y + F.lit(eps))
        message = "log needs every y + eps above 0"
    elif method == "log1p":
        outside, z = y < 0, F.log1p(y)
        message = "log1p needs every y at or above 0"
    else:
        raise ValueError("method must be 'log' or 'log1p'")
    if not df.filter(outside).isEmpty():
        raise ValueError(message)
    info = {"enabled": True, "method": method, "eps": eps,
            "smearing": bool(spec.get("smearing", True))}
    return df.withColumn(name, z), info


def inverse_target(z: Column, info: Mapping[str, Any] | None, smear: float | None = None) -> Column:
    """Back to the original scale; the stored smearing factor applies unless one is given."""
    if not info or not info.get("enabled"):
        return z
    factor = F.lit(float(info.get("smear", 1.0) if smear is None else smear))
    if info["method"] == "log":
        return F.exp(z) * factor - F.lit(float(info.get("eps", 0.0)))
    return F.expm1(z) * factor


def inverse_number(z: np.ndarray, info: Mapping[str, Any] | None) -> np.ndarray:
    """:func:`inverse_target` of plain numbers, without smearing."""
    if not info or not info.get("enabled"):
        return z
    return np.exp(z) - float(info.get("eps", 0.0)) if info["method"] == "log" else np.expm1(z)


def smearing_factor(z_true: Column, z_hat: Column) -> Column:
    """Mean of exp(residual) on the transformed scale (Duan 1983); an aggregate."""
    return F.avg(F.exp(z_true - z_hat))


def rmse_original_scale(z_true: Column, z_hat: Column, info: Mapping[str, Any]) -> Column:
    """Root mean squared error after undoing the transform, without smearing; an aggregate."""
    diff = inverse_target(z_true, info, 1.0) - inverse_target(z_hat, info, 1.0)
    return F.sqrt(F.avg(diff * diff))


def bin_edges(df: DataFrame, target: str, n_bins: int) -> list[float]:
    """Distinct inner quantile edges, rounded so that equal edges compare equal."""
    wanted = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    row = percentiles(df, [], target, wanted).first()
    if row is None or row["e0"] is None:
        return []
    edges = sorted({round(row[f"e{i}"], 9) for i in range(n_bins + 1)})
    return edges[1:-1]


def bin_target(df: DataFrame, target: str, strategy: str = "quantiles", n_bins: int = 10,
               name: str = "bin") -> DataFrame:
    """Integer bins of a continuous target: the number of inner edges below the value."""
    if strategy not in ("quantiles", "deciles", "fixed"):
        raise ValueError("strategy must be 'quantiles', 'deciles' or 'fixed'")
    edges = bin_edges(df, target, 10 if strategy == "deciles" else n_bins)
    y = F.col(target).cast("double")
    label = F.lit(0)
    for edge in edges:
        label = label + (y > F.lit(edge)).cast("int")
    return df.withColumn(name, F.when(y.isNotNull(), label))
