"""Rare categories: counted on the training part, replaced in training and validation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.operators.joins import attach, few
from fillgauge.session import settle

# The marks put in place of replaced categories.
RARE = "__RARE__"
UNSEEN = "__UNSEEN__"
OTHER = "Other"

#: A column with at most so many categories, and bytes in them, is looked up in sets instead of a join.
SET_ROWS = 5_000
SET_BYTES = 256 * 1024


def categorical_columns(df: DataFrame, features: Sequence[str],
                        force: Sequence[str] = ()) -> list[str]:
    """Text features plus the forced ones."""
    absent = [c for c in force if c not in features]
    if absent:
        raise ValueError(f"forced categorical columns are not features: {absent}")
    text = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    return text + [c for c in force if c not in text]


def resolve_rare_threshold(n_train: int, threshold: float | None = None,
                           fraction: float | None = None) -> int:
    """Count below which a category is rare; 0 switches the replacement off."""
    if threshold and threshold > 0 and float(threshold) != int(threshold):
        raise ValueError("the threshold is a count; use fraction for a share of the rows")
    absolute = int(threshold) if threshold and threshold > 0 else 0
    relative = math.ceil(float(fraction) * n_train) if fraction and fraction > 0 else 0
    return max(absolute, relative)


def fit_rare_map(train: DataFrame, columns: Sequence[str], threshold: int) -> DataFrame:
    """(column, value, n, is_rare); missing counts as a value."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("cell")
    return (train.select(cells).groupBy("cell.column", "cell.value")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("is_rare", F.col("n") < threshold))


def _marks(df: DataFrame, rare_map: DataFrame, columns: Sequence[str], settled: bool) -> DataFrame:
    """Add ``__mark_<column>``: true rare, false kept, NULL never seen.

    Columns with few categories are looked up in sets that travel with the plan: no join at all,
    however many such columns there are.  Only a column with more is joined.
    """
    if not columns:
        return df
    rare_map = rare_map if settled else settle(rare_map)
    sizes = {r["column"]: r for r in rare_map.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes")).collect()}
    sets = [c for c in columns if c not in sizes or (sizes[c]["n"] <= SET_ROWS and sizes[c]["bytes"] <= SET_BYTES)]
    known: dict[str, list] = {c: [] for c in sets}
    for r in rare_map.filter(F.col("column").isin(sets)).select("column", "value", "is_rare").collect() if sets else []:
        known[r["column"]].append((r["value"], r["is_rare"]))
    marks = {}
    for c in sets:
        text, mark = F.col(c).cast("string"), F.lit(None).cast("boolean")
        for is_rare in (True, False):
            values = [v for v, rare in known[c] if rare == is_rare]
            hit = F.coalesce(text.isin([v for v in values if v is not None]), F.lit(False))
            hit = hit | text.isNull() if None in values else hit
            mark = F.when(hit, F.lit(is_rare)).otherwise(mark)
        marks[f"__mark_{c}"] = mark
    df = df.withColumns(marks) if marks else df
    for c in columns:
        if f"__mark_{c}" in marks:
            continue
        table = rare_map.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("is_rare").alias(f"__mark_{c}"))
        df = attach(df.withColumn("__value", F.col(c).cast("string")), table, ["__value"], null_safe=True, settled=True,
                    small=few(sizes[c]["n"], sizes[c]["bytes"])).drop("__value")
    return df


def apply_rare_map_train(df: DataFrame, rare_map: DataFrame, columns: Sequence[str], *,
                         settled: bool = False) -> DataFrame:
    """Rare categories become ``__RARE__``."""
    out = _marks(df, rare_map, columns, settled)
    new = {c: F.when(F.col(f"__mark_{c}"), F.lit(RARE)).otherwise(F.col(c).cast("string"))
           for c in columns}
    return out.withColumns(new).select(*df.columns)


def apply_rare_map_valid(df: DataFrame, rare_map: DataFrame, columns: Sequence[str], *,
                         use_unseen: bool = True, strict_reference: bool = False,
                         settled: bool = False) -> DataFrame:
    """Categories that training did not keep are replaced.

    Known rare ones become ``__RARE__`` as in training, never seen ones
    ``__UNSEEN__``.  ``strict_reference`` calls both ``__UNSEEN__``; without
    ``use_unseen`` both are called ``__RARE__``.
    """
    out = _marks(df, rare_map, columns, settled)
    unseen = UNSEEN if use_unseen else RARE
    rare = unseen if strict_reference else RARE

    def pick(c: str) -> Column:
        mark, text = F.col(f"__mark_{c}"), F.col(c).cast("string")
        return (F.when(F.coalesce(text == RARE, F.lit(False)), text)
                .when(mark, F.lit(rare)).when(mark.isNull(), F.lit(unseen)).otherwise(text))

    return out.withColumns({c: pick(c) for c in columns}).select(*df.columns)


def collapse_rare(df: DataFrame, columns: Sequence[str], threshold: int) -> DataFrame:
    """Categories with fewer than ``threshold`` rows become ``Other``; missing stays missing."""
    if threshold <= 0:
        return df
    out = _marks(df, fit_rare_map(df, columns, threshold), columns, False)
    new = {c: F.when(F.col(f"__mark_{c}") & F.col(c).isNotNull(), F.lit(OTHER))
           .otherwise(F.col(c).cast("string")) for c in columns}
    return out.withColumns(new).select(*df.columns)


def category_order(df: DataFrame, column: str) -> DataFrame:
    """The categories in order, ``Other`` last."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.orderBy(F.col("value") == OTHER, "value")
