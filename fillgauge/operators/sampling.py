"""Exact-size draws, strata and folds from reproducible random keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge.functions.values import known_number, md5_key
from fillgauge.operators.joins import attach
from fillgauge.operators.rankcuts import (MAX_BUCKET_ROWS, md5_levels, rank_cuts, smallest, weighted_key,
                                          weighted_levels)


def sample_exact(df: DataFrame, id_cols: Sequence[str], k: int, seed: int,
                 label: str = "sample") -> DataFrame:
    """Exactly ``k`` rows without replacement; see :func:`smallest` for ids that repeat."""
    key = md5_key(id_cols, label, seed)
    return df.filter(smallest(df, key, md5_levels(key), k))


def weighted_pick(df: DataFrame, id_cols: Sequence[str], weight: Column, k: int, seed: int,
                  label: str) -> Column:
    """Predicate for a weighted draw of ``k`` rows; only positive, finite weights can be drawn."""
    if k <= 0:
        return F.lit(False)
    weight = known_number(weight)
    positive = F.coalesce((weight > 0) & (weight < float("inf")), F.lit(False))
    key = weighted_key(id_cols, F.when(positive, weight), label, seed)
    picked = smallest(df.filter(positive), key, weighted_levels(key), k, number=key["e"])
    return positive & picked


def sample_weighted(df: DataFrame, id_cols: Sequence[str], weight: Column, k: int, seed: int,
                    label: str = "sample") -> DataFrame:
    """Exactly ``k`` rows drawn one after the other with probability proportional to ``weight``."""
    return df.filter(weighted_pick(df, id_cols, weight, k, seed, label))


def sample_per_group(df: DataFrame, groups: Sequence[str], id_cols: Sequence[str], n: int,
                     seed: int, label: str = "group", max_group_rows: int | None = None) -> DataFrame:
    """At most ``n`` rows of every group: an exact draw where the group is larger.

    Rows of equal id count one by one, in the order of their contents.  Groups that fit
    a task are ranked there, in one shuffle; if any does not, the keys to draw are looked
    up by histograms, and only rows up to them are ranked.
    """
    key = md5_key(id_cols, label, seed)
    limit = MAX_BUCKET_ROWS if max_group_rows is None else max_group_rows
    biggest = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rows = df
    if biggest > limit:
        cuts = rank_cuts(df, groups, key, md5_levels(key),
                         lambda size: F.array(F.least(size, F.lit(int(n))))).select(*groups, "cut")
        rows = attach(df, cuts, groups, null_safe=True).filter(key <= F.col("cut")).drop("cut")
    content = F.xxhash64(*[F.col(c) for c in df.columns])
    order = Window.partitionBy(*groups).orderBy(key, content)
    return rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


def subsample_stratified(df: DataFrame, stratum: str, id_cols: Sequence[str], n: int,
                         seed: int, label: str = "stratum") -> DataFrame:
    """About ``n`` rows, every stratum in proportion and with at least one row."""
    total = df.count()
    if total <= n:
        return df
    key = md5_key(id_cols, label, seed)

    def quota(size: Column) -> Column:
        share = F.floor(size.cast("double") * F.lit(float(n)) / F.lit(float(total)))
        return F.array(F.greatest(F.lit(1), share))

    cuts = rank_cuts(df, [stratum], key, md5_levels(key), quota).select(stratum, "cut")
    out = attach(df, cuts, [stratum], null_safe=True)
    return out.filter(key <= F.col("cut")).drop("cut")


def _fold_bounds(n: Column, k: int) -> Column:
    """Number of rows in the first 1, 2, ... k-1 folds."""
    return F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.floor(i * n / F.lit(k)))


def kfold(df: DataFrame, id_cols: Sequence[str], k: int, seed: int, name: str = "fold") -> DataFrame:
    """Shuffled folds 0..k-1 whose sizes differ by at most one."""
    key = md5_key(id_cols, "fold", seed)
    cuts = rank_cuts(df, [], key, md5_levels(key), lambda n: _fold_bounds(n, k)).collect()
    n = cuts[0]["n"] if cuts else 0
    empty = sum(1 for i in range(1, k) if i * n // k == 0)
    by_rank = {r["rank"]: r["cut"] for r in cuts}
    fold = F.lit(empty)
    for i in range(1, k):  # k - 1 cuts
        rank = i * n // k
        if rank > 0:
            fold = fold + (key > F.lit(by_rank[rank])).cast("int")
    return df.withColumn(name, fold)


def stratified_folds(df: DataFrame, stratum: str, id_cols: Sequence[str], k: int, seed: int,
                     name: str = "fold", max_group_rows: int | None = None) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one inside every stratum.

    Strata that fit a task are ranked there, in one shuffle; the bounds of larger ones are
    looked up by histograms.
    """
    key = md5_key(id_cols, "fold", seed)
    limit = MAX_BUCKET_ROWS if max_group_rows is None else max_group_rows
    biggest = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest <= limit:
        whole = Window.partitionBy(stratum)
        rank, n = F.row_number().over(whole.orderBy(key)), F.count(F.lit(1)).over(whole)
        ranked = df.withColumns({"__rank": rank, "__n": n})
        passed = F.filter(_fold_bounds(F.col("__n"), k), lambda r: r < F.col("__rank"))
        return ranked.withColumn(name, F.size(passed).cast("int")).drop("__rank", "__n")
    cuts = rank_cuts(df, [stratum], key, md5_levels(key), lambda n: _fold_bounds(n, k))
    table = cuts.groupBy(stratum).agg(
        F.max("n").alias("__n"),
        F.map_from_entries(F.collect_list(F.struct("rank", "cut"))).alias("__cuts"))
    out = attach(df.withColumn("__key", key), table, [stratum], null_safe=True)
    passed = F.filter(_fold_bounds(F.col("__n"), k), lambda r: (
        (r == 0) | (F.col("__cuts")[r] < F.col("__key"))))
    # a stratum smaller than any bound has no cuts: all of its rows are in the last fold
    fold = F.when(F.col("__n").isNull(), F.lit(k - 1)).otherwise(F.size(passed))
    return out.withColumn(name, fold.cast("int")).drop("__key", "__n", "__cuts")
