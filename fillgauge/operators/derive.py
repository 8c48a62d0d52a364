"""Horizontal rules across the columns of a record, and variable types."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.operators.joins import attach


def condition_column(df: DataFrame, condition: str | Column | None) -> Column:
    """``"var=value"`` (text equality with a bare word or number), a SQL condition, or a Column."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, Column):
        return condition
    var, sep, value = condition.partition("=")
    bare = re.fullmatch(r"[+-]?[\w.]+(-[\w.]+)*", value.strip())
    if sep and var.strip() in df.columns and bare and value.strip() not in df.columns:
        return F.col(var.strip()).cast("string") == F.lit(value.strip())
    return F.expr(condition)


def derive_variable(df: DataFrame, new_var: str, rule: str, var_type: str = "numeric",
                    length: int | None = None, condition: str | Column | None = None) -> DataFrame:
    """Add ``new_var`` from a SQL expression; NULL where the condition does not hold.

    Rule and condition both see the old values of a column that is overwritten.
    """
    cond = condition_column(df, condition)
    if var_type == "numeric":
        value = F.expr(rule).cast("double")
    elif var_type == "character":
        value = F.expr(rule).cast("string")
        value = F.substring(value, 1, length) if length else value
    else:
        raise ValueError("var_type must be 'numeric' or 'character'")
    return df.withColumn(new_var, F.when(cond, value))


#: Mappings up to this size become a literal map, larger ones a lookup table.
LITERAL_MAP_ENTRIES = 200


def _mapped(df: DataFrame, var: str, mapping: Mapping) -> DataFrame:
    if not mapping:
        return df.withColumn(var, F.lit(None).cast("double"))
    table = df.sparkSession.createDataFrame(list(mapping.items()), [var, "__rank"])
    if all(type(v) is int and -2**31 <= v < 2**31 for v in mapping.values()):
        table = table.withColumn("__rank", F.col("__rank").cast("int"))
    if len(mapping) <= LITERAL_MAP_ENTRIES:
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        value = F.create_map(*pairs)[F.col(var)]
        return df.withColumn(var, value.cast(table.schema["__rank"].dataType))
    table = table.withColumn(var, F.col(var).cast(df.schema[var].dataType))
    cols = [F.col("__rank").alias(c) if c == var else F.col(c) for c in df.columns]
    return attach(df, table, [var]).select(*cols)


def _numeric_if_possible(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn text columns into numbers, each only if every one of its values is a number."""
    text = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return df
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c)
                   for c in text]).first()
    good = {c: F.col(c).cast("double") for c in text if bad[c] == 0}
    return df.withColumns(good) if good else df


def transform_var(df: DataFrame, var_types: Mapping[str, tuple] | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """Map or retype variables; returns the table and (variable, var_type).

    ``var_types`` maps a name to (class, conversion): a dict of ranks, a type name
    or None.  An ordinal text variable without conversion becomes numeric if all of
    its values allow it.  Without ``var_types`` the classes follow the schema.
    """
    if var_types is None:
        numeric = (T.NumericType, T.BooleanType)
        var_types = {f.name: ("numerical" if isinstance(f.dataType, numeric) else "nominal", None)
                     for f in df.schema}
    else:
        probe = []
        for var, (vtype, conv) in var_types.items():
            if var not in df.columns:
                raise ValueError(f"variable '{var}' is not in the table")
            if conv is None:
                if vtype == "ordinal":
                    probe.append(var)
            elif isinstance(conv, Mapping):
                df = _mapped(df, var, conv)
            elif isinstance(conv, str):
                df = df.withColumn(var, F.col(var).cast(conv))
            else:
                raise ValueError(f"variable '{var}': conversion must be a dict or a type name")
        df = _numeric_if_possible(df, probe)
    types = df.sparkSession.createDataFrame(
        [(v, t) for v, (t, _) in var_types.items()], "variable string, var_type string")
    return df, types


def _hashes(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Two independent hashes of a value; equal values, also 0.0 and -0.0, have equal ones."""
    value = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(value == 0, F.lit(0.0)).otherwise(value)
    return F.xxhash64(value), F.xxhash64(F.lit(1), value)


def distinct_counts(df: DataFrame) -> list[int]:
    """Exact number of distinct values of every column, NULL not counted, with one shuffle for all.

    Each row gives one small cell (column, hash, second hash) per column; a task folds equal cells, so
    what is shuffled are the distinct values of each task, 28 bytes each, however wide they are.  Where
    values with different second hashes meet in one first hash, the values themselves are counted.
    """
    hashes = [_hashes(df, c) for c in df.columns]
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("c"), h.alias("h"), g.alias("g")))
                      for i, (c, (h, g)) in enumerate(zip(df.columns, hashes))])
    folded = (df.select(F.explode(cells).alias("cell")).filter("cell is not null").groupBy("cell.c", "cell.h")
              .agg(F.min("cell.g").alias("lo"), F.max("cell.g").alias("hi")))
    meet = F.col("lo") != F.col("hi")
    found = {r["c"]: r for r in folded.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(meet).alias("meet")).collect()}
    out = [found[i]["n"] if i in found else 0 for i in range(len(df.columns))]
    for i, r in found.items():
        if r["meet"]:
            shared = folded.filter(meet & (F.col("c") == i)).select(F.col("h").alias("__h"))
            values = df.select(F.col(df.columns[i]).alias("v"), hashes[i][0].alias("__h")).filter("v is not null")
            out[i] += attach(values, shared, ["__h"], how="inner").select("v").distinct().count() - r["meet"]
    return out


def profile_columns(df: DataFrame, low_cardinality: float = 0.5, exact: bool = True) -> DataFrame:
    """(variable, type, n, n_distinct, ratio, is_low_cardinality) for every column.

    A text column with few distinct values per row counts as a category.
    """
    if exact:
        n, counts = df.count(), distinct_counts(df)
    else:
        n, *counts = df.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.col(c)) for c in df.columns]).first()
    rows = []
    for f, d in zip(df.schema, counts):
        ratio = d / n if n else None
        low = isinstance(f.dataType, T.StringType) and ratio is not None and ratio < low_cardinality
        rows.append((f.name, f.dataType.simpleString(), n, d, ratio, low))
    return df.sparkSession.createDataFrame(
        rows, "variable string, type string, n long, n_distinct long, ratio double, is_low_cardinality boolean")
