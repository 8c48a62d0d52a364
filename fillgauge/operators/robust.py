"""Robust statistics per group and the two-sample distance between distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge.functions.values import clip, known_number
from fillgauge.operators.cumulative import MAX_GROUP_ROWS, GroupSizes, percentiles
from fillgauge.operators.joins import attach, few, key_bytes
from fillgauge.operators.rankcuts import value_levels
from fillgauge.session import settle


def winsorize(df: DataFrame, groups: Sequence[str], value: str, p: float = 5.0,
              name: str = "winsorized") -> DataFrame:
    """Clip ``value`` at the p-th and (100-p)-th percentile of its group."""
    rows = df.filter(known_number(F.col(value)).isNotNull())
    sizes = GroupSizes(rows, groups) if groups else None
    bounds = percentiles(df, groups, value, {"__lo": p / 100, "__hi": 1 - p / 100}, sizes=sizes)
    if sizes:
        out = attach(df, bounds, groups, null_safe=True, settled=True, small=sizes.few())
    else:
        lo, hi = bounds.first() or (None, None)
        out = df.withColumns({"__lo": F.lit(lo).cast("double"), "__hi": F.lit(hi).cast("double")})
    return out.withColumn(name, clip(known_number(F.col(value)), F.col("__lo"), F.col("__hi"))
                          ).drop("__lo", "__hi")


def mad(df: DataFrame, groups: Sequence[str], value: str, name: str = "mad") -> DataFrame:
    """Unscaled median absolute deviation per group."""
    keys = list(groups) or ["__all"]
    rows = df.withColumn("__all", F.lit(0)).select(*keys, known_number(F.col(value)).alias("value"))
    rows = rows.filter("value is not null")
    sizes = GroupSizes(rows, keys)
    centre = percentiles(rows, keys, "value", {"__med": 0.5}, sizes=sizes)
    away = attach(rows, centre, keys, null_safe=True, settled=True, small=sizes.few())
    away = away.select(*keys, F.abs(F.col("value") - F.col("__med")).alias("value"))
    return percentiles(away, keys, "value", {name: 0.5}, sizes=sizes).select(*groups, name)


def iqr(df: DataFrame, groups: Sequence[str], value: str, name: str = "iqr") -> DataFrame:
    """Distance between the quartiles per group."""
    q = percentiles(df, groups, value, {"__a": 0.25, "__b": 0.75})
    return q.select(*groups, (F.col("__b") - F.col("__a")).alias(name))


def p95_p5(df: DataFrame, groups: Sequence[str], value: str, name: str = "p95p5") -> DataFrame:
    """Distance between the 5th and 95th percentile per group."""
    q = percentiles(df, groups, value, {"__a": 0.05, "__b": 0.95})
    return q.select(*groups, (F.col("__b") - F.col("__a")).alias(name))


def stack_pairs(df: DataFrame, groups: Sequence[str], first: str, second: str) -> DataFrame:
    """(groups, value, a, b): both columns in one, marked by a = 1 or b = 1; NULLs left out."""
    pair = F.explode(F.array(
        F.struct(known_number(F.col(first)).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(known_number(F.col(second)).alias("value"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return df.select(*groups, pair.alias("p")).select(*groups, "p.*").filter("value is not null")


def paired_distribution(df: DataFrame, groups: Sequence[str], first: str, second: str) -> DataFrame:
    """(groups, value, n_true, n_imp): copies of each value in two columns."""
    return stack_pairs(df, groups, first, second).groupBy(*groups, "value").agg(
        F.sum("a").alias("n_true"), F.sum("b").alias("n_imp"))


def ks_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p-value of the two-sample distance ``d``: the alternating series, 100 terms."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    en = F.sqrt(n1 * n2 / F.nullif(n1 + n2, F.lit(0.0)))
    lam = (en + F.lit(0.12) + F.try_divide(F.lit(0.11), en)) * d

    def add(total: Column, k: Column) -> Column:
        sign = F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0))
        return total + sign * F.exp(F.lit(-2.0) * k * k * lam * lam)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), add)
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _share(part: Column, whole: str) -> Column:
    return F.try_divide(part, F.nullif(F.col(whole), F.lit(0)))


def _gap(ties: str) -> Column:
    """Distance of the two running shares after (``standard``) or also inside a tie.

    ``sequential`` lets the first sample move first inside a tie.
    """
    after = F.abs(_share(F.col("ca"), "n1") - _share(F.col("cb"), "n2"))
    if ties == "standard":
        return after
    if ties != "sequential":
        raise ValueError("ties must be 'sequential' or 'standard'")
    inside = F.abs(_share(F.col("ca"), "n1") - _share(F.col("cb") - F.col("b"), "n2"))
    return F.when(F.col("a") > 0, F.greatest(after, inside)).otherwise(after)


def _ks_small(rows: DataFrame, keys: list[str], ties: str) -> DataFrame:
    """(keys, d): each group ordered in one task."""
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run = rows.groupBy(*keys, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = run.withColumns({"ca": F.sum("a").over(upto), "cb": F.sum("b").over(upto),
                           "n1": F.sum("a").over(whole), "n2": F.sum("b").over(whole)})
    return run.groupBy(*keys).agg(F.max(_gap(ties)).alias("d"))


def _ks_large(rows: DataFrame, sizes: DataFrame, keys: list[str], ties: str, limit: int) -> DataFrame:
    """(keys, d) by bounding: only buckets that can still hold the maximum are refined.

    At the end of a bucket the distance is known; inside it, it cannot exceed what
    moving only one of the two samples through the bucket would give.
    """
    levels = value_levels(F.col("value"))
    rows = rows.withColumns({"__b": F.lit(0), **{f"__l{i}": lv for i, lv in enumerate(levels)}})
    group = [*keys, "__b"]
    state = ["n1", "n2", "a0", "b0"]
    places = settle(sizes.filter("n1 > 0 and n2 > 0").select(
        *keys, F.lit(0).alias("__b"), "n1", "n2", F.lit(0).cast("long").alias("a0"),
        F.lit(0).cast("long").alias("b0")))
    number, size = places.agg(F.count(F.lit(1)), F.sum(key_bytes(places, keys))).first()
    groups = small = few(number, size)
    best = None

    def running(df: DataFrame, order: str) -> DataFrame:
        upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({"ca": F.col("a0") + F.sum("a").over(upto),
                               "cb": F.col("b0") + F.sum("b").over(upto)})

    def better(found: DataFrame) -> DataFrame:
        both = found if best is None else found.unionByName(best)
        return both.groupBy(*keys).agg(F.max("d").alias("d"))

    for level in range(len(levels)):
        fine = f"__l{level}"
        near = rows if level == 0 else attach(rows, places.select(*group), group, how="inner",
                                              null_safe=True, settled=True, small=small)
        hist = near.groupBy(*group, fine).agg(F.sum("a").alias("a"), F.sum("b").alias("b"),
                                              F.count(F.lit(1)).alias("m"))
        hist = attach(hist, places.select(*group, *state), group, how="inner", null_safe=True,
                      settled=True, small=small)
        hist = running(hist, fine)
        up = _share(F.col("ca"), "n1") - _share(F.col("cb") - F.col("b"), "n2")
        down = _share(F.col("cb"), "n2") - _share(F.col("ca") - F.col("a"), "n1")
        hist = settle(hist.withColumns({"d": _gap("standard"), "most": F.greatest(up, down)}))
        best = settle(better(hist.groupBy(*keys).agg(F.max("d").alias("d"))))
        still = attach(hist.drop("d"), best, keys, null_safe=True, settled=True, small=groups)
        places = settle(still.filter("most > d").select(
            *keys, F.col(fine).alias("__b"), "n1", "n2", (F.col("ca") - F.col("a")).alias("a0"),
            (F.col("cb") - F.col("b")).alias("b0"), "m"))
        crowd, number, size = places.agg(F.max("m"), F.count(F.lit(1)), F.sum(key_bytes(places, keys))).first()
        small = few(number, size)
        rows = rows.withColumn("__b", F.col(fine))
        if (crowd or 0) <= limit:
            break
    near = attach(rows, places.select(*group, *state), group, how="inner", null_safe=True,
                  settled=True, small=small)
    # copies of one value are folded before the last, bounded ordering
    exact = near.groupBy(*group, *state, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return better(running(exact, "value").groupBy(*keys).agg(F.max(_gap(ties)).alias("d")))


def ks_two_sample(df: DataFrame, groups: Sequence[str], first: str, second: str, *,
                  ties: str = "sequential", max_group_rows: int | None = None) -> DataFrame:
    """(groups, n_true, n_imp, ks_stat, ks_p) of two columns, NULLs dropped per column."""
    limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    _gap(ties)
    keys = list(groups) or ["__all"]
    rows = stack_pairs(df.withColumn("__all", F.lit(0)), keys, first, second)
    sizes = settle(rows.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")))
    biggest, number, size = sizes.agg(F.max(F.col("n1") + F.col("n2")), F.count(F.lit(1)),
                                      F.sum(key_bytes(sizes, keys))).first()
    found = (_ks_small(rows, keys, ties) if (biggest or 0) <= limit else
             _ks_large(rows, sizes, keys, ties, limit))
    out = attach(sizes, found, keys, null_safe=True, settled=True, small=few(number, size))
    d = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("d"))
    return out.select(*groups, F.col("n1").alias("n_true"), F.col("n2").alias("n_imp"),
                      d.alias("ks_stat"), ks_pvalue(d, F.col("n1"), F.col("n2")).alias("ks_p"))
