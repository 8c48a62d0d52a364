"""Selections of result rows and the tables behind line and bar charts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillgauge.functions.values import parse_rate, require_columns

# The bounds drawn into charts of standardized differences.
SMD_BOUNDS = (0.1, 0.2)


def _listed(x) -> list | None:
    if x is None:
        return None
    return list(x) if isinstance(x, Iterable) and not isinstance(x, (str, bytes)) else [x]


def filter_selection(df: DataFrame, variables=None, mechs=None, methods=None,
                     missrates=None) -> DataFrame:
    """Rows of the chosen variables, mechanisms, methods and rates; None keeps all.

    A single value may be given bare.  A choice of mechanism or rate is ignored
    where the table has no such column.
    """
    for column, chosen, optional in (("variable", variables, False), ("MissMech", mechs, True),
                                     ("Method", methods, False), ("MissRate", missrates, True)):
        chosen = _listed(chosen)
        if chosen is None or (optional and column not in df.columns):
            continue
        df = df.filter(F.col(column).isin(chosen))
    return df


def metric_lines(summary: DataFrame, metric: str = "rmse", **selection) -> DataFrame:
    """(variable, MissMech, Method, rate, rate_label, value), in drawing order."""
    require_columns(summary, ["variable", "Method", metric])
    df = filter_selection(summary, **selection)
    mech = F.col("MissMech") if "MissMech" in df.columns else F.lit("_")
    label = F.col("MissRate").cast("string") if "MissRate" in df.columns else F.lit(None).cast("string")
    rows = df.select("variable", mech.alias("MissMech"), "Method", parse_rate(label).alias("rate"),
                     label.alias("text"), F.col(metric).alias("value"))
    rows = rows.filter("variable is not null and MissMech is not null and Method is not null")
    labels = rows.groupBy(F.col("variable").alias("v"), F.col("MissMech").alias("m"),
                          F.col("rate").alias("r")).agg(F.min("text").alias("rate_label"))
    same = ((F.col("variable") == F.col("v")) & (F.col("MissMech") == F.col("m"))
            & F.col("rate").eqNullSafe(F.col("r")))
    out = rows.join(labels, same, "left")
    out = out.select("variable", "MissMech", "Method", "rate", "rate_label", "value")
    return out.orderBy("variable", "MissMech", "Method", "rate")


def grouped_bars(summary: DataFrame, value_col: str = "mean_diff", group: str = "Method",
                 hue: str = "MissRate", **selection) -> DataFrame:
    """(variable, MissMech, group, hue, value, band): the mean of a metric per bar.

    ``band`` says between which bounds a standardized difference lies and is NULL
    for other metrics.
    """
    require_columns(summary, ["variable", group, value_col])
    df = filter_selection(summary, **selection)
    mech = F.col("MissMech") if "MissMech" in df.columns else F.lit("_")
    shade = F.col(hue).cast("string") if hue in df.columns else F.lit("_no_hue_")
    rows = df.select("variable", mech.alias("MissMech"), F.col(group).cast("string").alias("group"),
                     shade.alias("hue"), F.col(value_col).alias("x"))
    rows = rows.filter("variable is not null and MissMech is not null")
    out = rows.groupBy("variable", "MissMech", "group", "hue").agg(F.avg("x").alias("value"))
    size = F.abs(F.col("value"))
    band = (F.when(size < SMD_BOUNDS[0], F.lit("small")).when(size < SMD_BOUNDS[1], F.lit("medium"))
            .when(size.isNotNull(), F.lit("large")))
    is_smd = value_col.lower() == "smd"
    return out.withColumn("band", band if is_smd else F.lit(None).cast("string")).orderBy(
        "variable", "MissMech", "group", "hue")
