"""Controlled missingness: mask an exact number of known values by a known mechanism.

The number of rows to hit is settled by small aggregates.  The hit itself is a
comparison of each row's random key with a cut, so masking never moves the rows;
only the company mechanism looks up the drawn companies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.functions.values import md5_key, null_if_nan, require_columns, uniform_from_md5
from fillgauge.operators.cumulative import percentiles
from fillgauge.operators.joins import attach
from fillgauge.operators.rankcuts import as_literal, md5_levels, rank_cuts, smallest, weighted_levels
from fillgauge.operators.sampling import weighted_pick
from fillgauge.session import settle, together

STATUS = "STATUS_ZAPISA"


def rows_to_hit(n: int, fraction: float | None, k: int | None, rounding: str = "floor") -> int:
    """Number of rows to mask out of ``n``; ``k`` wins over ``fraction``."""
    if k is None:
        if fraction is None:
            raise ValueError("give target_missing_fraction or k")
        rules = {"floor": int, "ceil": math.ceil, "round": round}
        if rounding not in rules:
            raise ValueError("rounding must be 'floor', 'ceil' or 'round'")
        k = int(rules[rounding](float(fraction) * n))
    return max(0, min(int(k), n))


def _value(df: DataFrame, column: str) -> Column:
    """The column, with NaN as NULL where it is a floating-point column."""
    floating = df.schema[column].dataType.simpleString() in ("double", "float")
    return null_if_nan(F.col(column)) if floating else F.col(column)


def _mask(df: DataFrame, hits: dict[str, Column], new_status: int, status_col: str) -> DataFrame:
    touched = F.lit(False)
    for hit in hits.values():
        touched = touched | hit
    status = F.col(status_col) if status_col in df.columns else F.lit(None).cast("int")
    return df.withColumns({
        **{c: F.when(~hit, F.col(c)) for c, hit in hits.items()},
        status_col: F.when(touched, F.lit(new_status)).otherwise(status)})


def mcar_missing(df: DataFrame, columns: str | Sequence[str], target_missing_fraction: float,
                 new_status: int, *, id_cols: Sequence[str], random_state: int = 0,
                 status_col: str = STATUS) -> DataFrame:
    """Completely at random: each column on its own loses an exact share of all rows."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    require_columns(df, [*columns, status_col, *id_cols])
    share = F.lit(min(1.0, max(0.0, float(target_missing_fraction))))

    def hit(c: str) -> Column:
        key = md5_key(id_cols, c, random_state)
        return smallest(df, key, md5_levels(key), lambda n: F.floor(share * n))

    hits = together(df.sparkSession, [partial(hit, c) for c in columns])
    return _mask(df, dict(zip(columns, hits)), new_status, status_col)


def mar_missing(df: DataFrame, target_column: str, related_column: str, new_status: int,
                target_missing_fraction: float | None = None, k: int | None = None,
                type: str = "max", *, id_cols: Sequence[str], random_state: int = 0,
                exclude_existing_nas: bool = True, status_col: str = STATUS,
                rounding: str = "floor") -> DataFrame:
    """Depending on another column: weights rise (``max``) or fall (``min``) with it.

    Rows without a related value cannot be drawn.
    """
    require_columns(df, [target_column, related_column, status_col, *id_cols])
    if type not in ("max", "min"):
        raise ValueError("type must be 'max' or 'min'")
    related = _value(df, related_column).cast("double")
    eligible = related.isNotNull()
    if exclude_existing_nas:
        eligible = eligible & _value(df, target_column).isNotNull()
    pool = df.filter(eligible)
    n, low, high = pool.agg(F.count(F.lit(1)), F.min(related), F.max(related)).first()
    k = rows_to_hit(n, target_missing_fraction, k, rounding)
    if n == 0 or k == 0:
        return df
    if low == high or not math.isfinite(low) or not math.isfinite(high):
        weight = F.lit(1.0)
    elif type == "max":
        weight = (related - F.lit(low)) / F.lit(high - low)
    else:
        weight = (F.lit(high) - related) / F.lit(high - low)
    hit = weighted_pick(df, id_cols, F.when(eligible, weight), k, random_state, target_column)
    return _mask(df, {target_column: hit}, new_status, status_col)


def mnar_missing(df: DataFrame, col: str, target_missing_fraction: float, new_status: int,
                 top_frac: float = 0.01, beta: float = 1.0, type: str = "max", *,
                 id_cols: Sequence[str], random_state: int = 0,
                 status_col: str = STATUS) -> DataFrame:
    """Depending on the value itself: logistic weights of the standardised value.

    The uppermost ``top_frac`` of the values always has weight 1.  Missing values
    count in the share to mask but cannot be drawn.
    """
    require_columns(df, [col, status_col, *id_cols])
    if type not in ("max", "min"):
        raise ValueError("type must be 'max' or 'min'")
    x = _value(df, col).cast("double")
    n, mean, sd = df.agg(F.count(F.lit(1)), F.avg(x), F.stddev_pop(x)).first()
    k = rows_to_hit(n, target_missing_fraction, None)
    if k == 0:
        return df
    if not sd or math.isnan(sd):
        weight = F.when(x.isNotNull(), F.lit(1.0))
    else:
        slope = float(beta) if type == "max" else -float(beta)
        z = (x - F.lit(mean)) / F.lit(sd)
        weight = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-slope) * z)) + F.lit(1e-12)
        if 0 < top_frac < 1:
            values = df.select(x.alias("x"))
            cutoff = percentiles(values, [], "x", {"q": 1 - top_frac}).first()["q"]
            weight = F.when(x >= F.lit(cutoff), F.lit(1.0)).otherwise(weight)
    hit = weighted_pick(df, id_cols, F.when(x.isNotNull(), weight), k, random_state, col)
    return _mask(df, {col: hit}, new_status, status_col)


def mar_company_missing(df: DataFrame, company_col: str, target_column: str, new_status: int,
                        target_missing_fraction: float | None = None, k: int | None = None,
                        alpha: float = 1.0, *, id_cols: Sequence[str], random_state: int = 0,
                        exclude_existing_nas: bool = True, status_col: str = STATUS,
                        rounding: str = "floor") -> tuple[DataFrame, DataFrame]:
    """By whole companies, small ones first: weight (1/size)^alpha, drawn one by one.

    Companies are drawn until the count is reached; of the last one only as many
    rows as needed are masked.  ``alpha=0`` draws companies uniformly.  Returns the
    masked table and one row of diagnostics.
    """
    require_columns(df, [company_col, target_column, *id_cols])
    target = _value(df, target_column)
    eligible = target.isNotNull() if exclude_existing_nas else F.lit(True)
    n, n_all, in_company = df.agg(
        F.count_if(eligible), F.count(F.lit(1)),
        F.count_if(eligible & F.col(company_col).isNotNull())).first()
    k = rows_to_hit(n, target_missing_fraction, k, rounding)
    reach = min(k, in_company)
    pool = df.filter(eligible & F.col(company_col).isNotNull())

    hit = F.lit(False)
    out = df
    if reach > 0:
        companies = settle(pool.groupBy(company_col).agg(F.count(F.lit(1)).alias("__size")))
        text = md5_key([company_col], "company", random_state)
        wait = -F.ln(uniform_from_md5(text)) * F.pow(F.col("__size").cast("double"), F.lit(float(alpha)))
        companies = companies.withColumn("__key", F.struct(wait.alias("e"), text.alias("t")))
        key = F.col("__key")
        last = rank_cuts(companies, [], key, weighted_levels(key),
                         lambda size: F.array(F.lit(reach)), weight=F.col("__size")).first()
        cut = as_literal(last["cut"])
        need = reach - last["before"]
        drawn = companies.filter((key <= cut) if need == last["size"] else (key < cut))
        out = attach(df, drawn.select(company_col, F.lit(True).alias("__drawn")), [company_col])
        hit = F.coalesce(F.col("__drawn"), F.lit(False)) & eligible
        if need < last["size"]:
            split = companies.filter(key == cut).first()[company_col]
            of_last = eligible & F.col(company_col).eqNullSafe(F.lit(split))
            row_key = md5_key(id_cols, target_column, random_state)
            of_last = of_last & smallest(pool.filter(F.col(company_col) == F.lit(split)),
                                         row_key, md5_levels(row_key), need)
            hit = hit | of_last
    masked = _mask(out, {target_column: hit}, new_status, status_col).drop("__drawn")
    denominator = n if exclude_existing_nas else n_all
    asked = target_missing_fraction
    if asked is None:
        asked = k / denominator if denominator else 0.0
    diagnostics = df.sparkSession.createDataFrame(
        [(f"MAR_by_company_size(alpha={alpha})", reach,
          reach / denominator if denominator else 0.0, float(asked),
          "eligible_non_na" if exclude_existing_nas else "all_rows")],
        "mechanism string, actual_k long, actual_fraction double, target_fraction double, "
        "denominator string")
    return masked, diagnostics
