"""Group aggregates written back onto every row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.functions.values import null_if_nan, present
from fillgauge.operators.cumulative import GroupSizes, modes, percentiles
from fillgauge.operators.joins import attach


def _variance(x: Column, ddof: int) -> Column:
    n = F.count(x)
    return F.when(n > ddof, F.var_pop(x) * n / (n - ddof))


def _skewness(x: Column) -> Column:
    """Bias-adjusted skewness, 0 for constant data, NULL below three values."""
    n = F.count(x)
    spread = F.var_pop(x)
    adjusted = F.sqrt((n * (n - 1)).cast("double")) / (n - 2) * F.skewness(x)
    return F.when(n < 3, F.lit(None)).when(spread == 0, F.lit(0.0)).otherwise(adjusted)


def aggregate_expression(operation: str, rule: str, data_type: T.DataType, *, ddof: int = 1,
                         min_count: int = 0, order_by: Sequence[str] = ()) -> Column:
    """Column expression of a named aggregate over the non-missing values of ``rule``."""
    x = null_if_nan(F.col(rule)) if isinstance(data_type, (T.DoubleType, T.FloatType)) else F.col(rule)
    n = F.count(x)
    truth = x.cast("boolean") if not isinstance(data_type, T.StringType) else F.length(x) > 0
    if operation == "count":
        return n
    if operation == "size":
        return F.count(F.lit(1))
    if operation == "sum":
        return F.when(n >= min_count, F.coalesce(F.sum(x), F.lit(0).cast(data_type)))
    if operation in ("prod", "product"):
        return F.when(n >= min_count, F.coalesce(F.product(x), F.lit(1.0)))
    if operation in ("mean", "avg"):
        return F.avg(x)
    if operation == "min":
        return F.min(x)
    if operation == "max":
        return F.max(x)
    if operation == "var":
        return _variance(x, ddof)
    if operation == "std":
        return F.sqrt(_variance(x, ddof))
    if operation == "sem":
        return F.sqrt(_variance(x, ddof) / n)
    if operation == "skew":
        return _skewness(x)
    if operation == "any":
        return F.coalesce(F.bool_or(truth), F.lit(False))
    if operation == "all":
        return F.coalesce(F.bool_and(truth), F.lit(True))
    if operation in ("first", "last"):
        if not order_by:
            raise ValueError(f"'{operation}' needs order_by: a table has no row order")
        age = F.when(x.isNotNull(), F.struct(*[F.col(c) for c in order_by]))
        return F.min_by(x, age) if operation == "first" else F.max_by(x, age)
    raise ValueError(f"unknown operation '{operation}'")


def group_table(df: DataFrame, groups: Sequence[str], name: str, rule: str | None,
                operation: str | Callable[[Column], Column], *, percentile_value: float = 0.5,
                interpolation: str = "linear", dropna: bool = True, sizes: GroupSizes | None = None,
                **options) -> DataFrame:
    """One row per group with the aggregate in column ``name``."""
    groups = list(groups)
    if rule is not None and rule not in groups:
        df = df.withColumn(rule, present(df, rule))
    if callable(operation):
        return df.groupBy(*groups).agg(operation(F.col(rule)).alias(name))
    op = operation.lower()
    if op == "count":
        if groups:
            return df.groupBy(*groups).agg(F.count(rule or df.columns[0]).alias(name))
        return df.agg(F.count(F.lit(1)).alias(name))
    if rule is None:
        raise ValueError(f"'{operation}' needs rule, the column to aggregate")
    if op in ("count distinct", "nunique"):
        out = F.count_distinct(F.col(rule))
        if not dropna:
            out = out + F.max(F.col(rule).isNull().cast("long"))
        return df.groupBy(*groups).agg(out.alias(name))
    if op == "mode":
        return modes(df, groups, rule, name)
    if op in ("median", "percentile"):
        p = 0.5 if op == "median" else percentile_value
        return percentiles(df, groups, rule, {name: p}, interpolation=interpolation, sizes=sizes)
    expr = aggregate_expression(op, rule, df.schema[rule].dataType, **options)
    return df.groupBy(*groups).agg(expr.alias(name))


def aggregate_variable(df: DataFrame, new_var: str, group_by_var: str | Sequence[str] | None = None,
                       rule: str | None = None, operation: str | Callable[[Column], Column] = "sum",
                       condition: str | Column | None = None, percentile_value: float = 0.5,
                       **options) -> DataFrame:
    """All rows of ``df`` plus ``new_var``, the aggregate of the row's group.

    ``condition`` limits the rows that are aggregated, not the rows that receive
    the result.  Rows with a NULL or absent group receive NULL.
    """
    groups = [group_by_var] if isinstance(group_by_var, str) else list(group_by_var or [])
    source = df
    if condition is not None:
        source = df.filter(F.expr(condition) if isinstance(condition, str) else condition)
    kept = [c for c in df.columns if c != new_var]
    if groups and rule is not None and not callable(operation) and operation.lower() in ("median", "percentile"):
        # the number of groups is known with their sizes, so their table need not be stored and measured
        sizes = GroupSizes(source.filter(present(source, rule).cast("double").isNotNull()), groups)
        table = group_table(source, groups, new_var, rule, operation, percentile_value=percentile_value, sizes=sizes,
                            **options)
        return attach(df.select(*kept), table, groups, settled=True, small=sizes.few()).select(*kept, new_var)
    table = group_table(source, groups, new_var, rule, operation,
                        percentile_value=percentile_value, **options)
    if not groups:
        kind = table.schema[new_var].dataType
        row = table.first()
        value = row[0] if row else None
        return df.select(*kept, F.lit(value).cast(kind).alias(new_var))
    return attach(df.select(*kept), table, groups).select(*kept, new_var)


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """(value, n)"""
    rows = df.filter(F.col(column).isNotNull()) if dropna else df
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
