"""Imputed versions against the truth: pairs, summaries, group contrasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.functions.values import present, require_columns, to_number
from fillgauge.operators.joins import attach, is_small, outer_join
from fillgauge.plans.metrics import group_metrics
from fillgauge.session import settle

STATUS = "STATUS_ZAPISA"
METHOD_KEYS = ["Method", "MissMech", "MissRate"]
SUMMARY_KEYS = [*METHOD_KEYS, STATUS, "variable"]


def join_methods(frames: DataFrame, methods: DataFrame, status_col: str = STATUS) -> DataFrame:
    """Add method, mechanism and rate of each row's version."""
    registry = methods.select(F.col("Status_zapisa").alias(status_col), *METHOD_KEYS)
    kept = [c for c in frames.columns if c not in METHOD_KEYS]
    return attach(frames.select(*kept), registry, [status_col], null_safe=True)


def join_truth(imputed: DataFrame, original: DataFrame, id_col: str,
               truths: Mapping[str, str], how: str = "left", per: str | None = None) -> DataFrame:
    """Add the true values (``truths``: column to new name) by id; NULL ids match each other.

    With a right or outer join the originals without a match are kept, once for every
    value of the column ``per`` that occurs.  NULL ids of both sides make all pairs, as asked
    for; they and other ids with very many rows are spread over slices.
    """
    if how in ("left", "inner"):
        truth = original.select(id_col, *[F.col(c).alias(n) for c, n in truths.items()])
        return attach(imputed, truth, [id_col], how=how, null_safe=True)
    truth, on = original.select(id_col, *[F.col(c).alias(n) for c, n in truths.items()]), [id_col]
    if per is not None:
        found = [r[0] for r in imputed.select(per).distinct().collect()]  # one per imputed version
        versions = F.array(*[F.lit(x) for x in found]) if found else F.array()
        truth = truth.withColumn(per, F.explode(versions.cast(f"array<{dict(imputed.dtypes)[per]}>")))
        on.append(per)
    return outer_join(imputed, truth, on, how)


def long_rows(methods: DataFrame, frames: Mapping[int, DataFrame], original: DataFrame, *,
              id_col: str, target_cols: Sequence[str], imputed_map: Mapping[str, str] | None = None,
              how_join_original: str = "left") -> DataFrame:
    """(id, y_pred, version, method keys, y_true, variable, residual) for every version.

    The truth is joined once for all target columns, before they are stacked.
    """
    predictions = {c: (imputed_map or {}).get(c, c) for c in target_cols}
    picked = [f.select(id_col, F.col(STATUS).cast("long").alias(STATUS),
                       *[F.col(p).alias(f"__p_{c}") for c, p in predictions.items()])
              for f in frames.values() if f is not None]
    if not picked:
        raise ValueError("no imputed versions given")
    truths = {c: f"__t_{c}" for c in target_cols}
    # an outer join keeps the unmatched originals once per version that has rows
    stacked = reduce(DataFrame.unionByName, [f.withColumn("__frame", F.lit(i)) for i, f in enumerate(picked)])
    wide = join_truth(join_methods(stacked, methods), original, id_col, truths, how_join_original, per="__frame")
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), to_number(F.col(f"__p_{c}").cast("string")).alias("y_pred")
                 if dict(wide.dtypes)[f"__p_{c}"] == "string" else
                 to_number(F.col(f"__p_{c}")).alias("y_pred"),
                 to_number(F.col(f"__t_{c}")).alias("y_true")) for c in target_cols]))
    rows = wide.select(id_col, STATUS, *METHOD_KEYS, cells.alias("c"))
    return rows.select(id_col, "c.y_pred", STATUS, *METHOD_KEYS, "c.y_true", "c.variable",
                       (F.col("c.y_pred") - F.col("c.y_true")).alias("residual"))


def evaluate_imputations_from_methods(
        methods: DataFrame, frames: Mapping[int, DataFrame], original: DataFrame, *, id_col: str,
        target_cols: Sequence[str], imputed_map: Mapping[str, str] | None = None,
        how_join_original: str = "left") -> tuple[DataFrame, DataFrame]:
    """All pairs, written once, and the metrics per method, mechanism, rate, version, variable."""
    rows = settle(long_rows(methods, frames, original, id_col=id_col, target_cols=target_cols,
                            imputed_map=imputed_map, how_join_original=how_join_original))
    return rows, group_metrics(rows, SUMMARY_KEYS, settled=True)


def summarize_by_group(rows: DataFrame, group_col: str, *, by_keys: Sequence[str] | None = None,
                       winsor_p: float = 5.0, settled: bool = False) -> DataFrame:
    """The metrics per variable and value of ``group_col``, optionally per ``by_keys``.

    ``settled`` says that ``rows`` is a stored table, which need not be written again.
    """
    by = list(by_keys or [])
    require_columns(rows, ["variable", "y_true", "y_pred", group_col, *by])
    out = group_metrics(rows, [*by, "variable", group_col], winsor_p, settled=settled)
    metrics = out.columns[len(by) + 2:]
    return out.select(*by, "variable", F.lit(group_col).alias("group_col"),
                      F.col(group_col).alias("group"), *metrics)


def smd_by_group(rows: DataFrame, group_col: str, *, ref_rule: str = "population",
                 ref_value: str | None = None, by_keys: Sequence[str] | None = None) -> DataFrame:
    """Standardized error of each group's contrast to a reference.

    One pass makes the group moments; everything else is computed from them.
    Missing values are skipped per column, rows with a NULL key in ``by_keys`` are
    left out, and a NULL group cannot be a reference.
    """
    by = list(by_keys or [])
    require_columns(rows, ["variable", "y_true", "y_pred", group_col, *by])
    if ref_rule not in ("population", "most_frequent", "first", "value"):
        raise ValueError("ref_rule must be population, most_frequent, first or value")
    if ref_rule == "value" and ref_value is None:
        raise ValueError("ref_rule='value' needs ref_value")
    for c in by:
        rows = rows.filter(F.col(c).isNotNull())
    keys = [*by, "variable"]
    y, p = present(rows, "y_true"), present(rows, "y_pred")
    groups = settle(rows.groupBy(*keys, F.col(group_col).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count(y).alias("n_true"), F.count(p).alias("n_imp"),
        F.avg(y).alias("mean_true"), F.avg(p).alias("mean_imp"),
        F.var_samp(y).alias("var_true"), F.var_samp(p).alias("var_imp")))

    def whole_mean(s: str) -> Column:
        return F.try_divide(F.sum(F.col(f"mean_{s}") * F.col(f"n_{s}")), F.sum(f"n_{s}"))

    label = F.col("group").cast("string")
    order = {"most_frequent": F.when(label.isNotNull(), F.struct((-F.col("n")).alias("o"), label.alias("l"))),
             "first": F.when(label.isNotNull(), F.struct(label.alias("o"), label.alias("l"))),
             "value": F.when(label == F.lit(str(ref_value)), F.struct(label.alias("o"), label.alias("l"))),
             }.get(ref_rule)
    means = F.struct(label.alias("ref"), F.col("mean_true").alias("t"), F.col("mean_imp").alias("i"))
    picked = [] if order is None else [F.min_by(means, order).alias("__ref")]
    whole = groups.groupBy(*keys).agg(
        whole_mean("true").alias("__mt"), whole_mean("imp").alias("__mi"),
        F.avg("var_true").alias("__vt"), F.avg("var_imp").alias("__vi"), *picked)
    if ref_rule == "value" and not whole.filter("__ref is null").isEmpty():
        raise ValueError(f"reference '{ref_value}' is not a group")
    known = {"null_safe": True, "settled": True, "small": is_small(whole)}
    out = attach(groups, whole, keys, **known)

    def total_variance(s: str, centre: str) -> Column:
        gap = F.col(f"mean_{s}") - F.col(centre)
        inside = F.coalesce(F.col(f"var_{s}"), F.lit(0.0)) * (F.col(f"n_{s}") - 1)
        between = F.col(f"n_{s}") * gap * gap
        n = F.sum(f"n_{s}")
        squares = F.sum(F.when(F.col(f"n_{s}") > 0, inside + between))
        return F.try_divide(squares, F.nullif(n - 1, F.lit(0)))

    spread = out.groupBy(*keys).agg(total_variance("true", "__mt").alias("__at"),
                                    total_variance("imp", "__mi").alias("__ai"))
    out = attach(out, spread, keys, **known)
    if ref_rule == "population":
        ref, ref_true, ref_imp = F.lit("POPULATION"), F.col("__mt"), F.col("__mi")
    else:
        ref, ref_true, ref_imp = (F.col(f"__ref.{x}") for x in ("ref", "t", "i"))
    error = (F.col("mean_imp") - ref_imp) - (F.col("mean_true") - ref_true)
    s_global = F.sqrt((F.col("__at") + F.col("__ai")) / 2)
    s_within = F.sqrt((F.col("__vt") + F.col("__vi")) / 2)
    return out.select(
        *by, "variable", F.lit(group_col).alias("group_col"), "group", ref.alias("ref"),
        F.try_divide(error, F.nullif(s_global, F.lit(0.0))).alias("SMD_global"),
        F.try_divide(error, F.nullif(s_within, F.lit(0.0))).alias("SMD_within"))
