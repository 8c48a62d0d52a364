"""Column helpers: missing values, numbers, text, random keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_if_nan(c: Column) -> Column:
    """NaN becomes NULL, the only missing value the operators know."""
    return F.when(~F.isnan(c), c)


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """Apply :func:`null_if_nan` to every floating-point column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(F.col(c)) for c in floats}) if floats else df


def present(df: DataFrame, name: str) -> Column:
    """The column, with NaN as NULL where it is a floating-point column."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return null_if_nan(F.col(name)) if floating else F.col(name)


def known_number(c: Column) -> Column:
    """The column as a double, with NaN as NULL."""
    return null_if_nan(c.cast("double"))


def to_number(c: Column) -> Column:
    """Double, or NULL where the text is no number."""
    return null_if_nan(c.try_cast("double"))


def parse_rate(c: Column) -> Column:
    """Number behind texts such as ``10%`` or ``0,1``."""
    text = F.replace(F.replace(c.cast("string"), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    return to_number(text)


def round_half_up(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Round every floating-point column half away from zero on its decimal text."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, decimals) for c in floats}) if floats else df


def padded_id(c: Column) -> Column:
    """Id as text with at least nine digits; longer ids are kept whole."""
    return F.when(c.isNotNull(), F.format_string("%09d", c.cast("long")))


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def resolve_column(df: DataFrame, name: str) -> str:
    """The column called ``name`` in any letter case."""
    for c in df.columns:
        if c.lower() == name.lower():
            return c
    raise KeyError(f"column '{name}' is missing; available: {df.columns}")


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = sorted(set(names) - set(df.columns))
    if absent:
        raise KeyError(f"missing columns: {absent}; available: {df.columns}")


def md5_key(id_cols: Sequence[str], *salt: object) -> Column:
    """Reproducible random order of rows: md5 of the id and a salt.

    Every part is preceded by its length, and NULL is a part of its own, so different
    ids never share a key.
    """
    parts = [F.col(c).cast("string") for c in id_cols] + [F.lit(str(s)) for s in salt]
    return F.md5(F.concat_ws("|", *[
        F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def uniform_from_md5(key: Column) -> Column:
    """Uniform number strictly between 0 and 1 from the first 52 bits of an md5 text."""
    bits = F.conv(F.substring(key, 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))
