"""Exact grouped distributions: percentiles, running counts, modes.

Percentiles of groups of a checked, bounded size come from ordering each group
inside one task.  Larger groups are never gathered: a quantile sketch brackets the wanted
ranks, and only the values inside the brackets are ordered, after those below were
counted (see :mod:`fillgauge.operators.rankcuts`).

Running counts, needed where every value is part of the result, fold a group to
one row per distinct value.  If any group has too many, the table is
range-partitioned by (group, value), so that a group spans many tasks, and each
task starts from the totals of the tasks before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fillgauge.functions.values import known_number, present
from fillgauge.operators.joins import attach, few, key_bytes
from fillgauge.operators.rankcuts import sketched_cuts, value_levels
from fillgauge.session import settle

#: Largest number of values of one group that a single task may order.
MAX_GROUP_ROWS = 1_000_000
#: Ranges of the table of running counts, at most, or four per core if that is more.
MOST_RANGES = 10_000
#: Beyond this many groups, small and large groups are handled apart.
MANY_GROUPS = 100_000


def distribution(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, cnt): how often each non-missing value occurs."""
    return (df.filter(present(df, value).isNotNull())
            .groupBy(*groups, F.col(value).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def running_counts(dist: DataFrame, groups: Sequence[str], counts: Sequence[str] = ("cnt",), *,
                   settled: bool = False, max_group_rows: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` (running sum in value order) and ``tot_<c>`` per group.

    ``dist`` has one row per (groups, value).
    """
    groups = list(groups)
    limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    dist = dist if settled else settle(dist)
    sizes = dist.groupBy(*groups).count()
    biggest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (biggest or 0) <= limit:
        whole = Window.partitionBy(*groups)
        upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        return dist.withColumns(
            {f"cum_{c}": F.sum(c).over(upto) for c in counts}
        ).withColumns({f"tot_{c}": F.sum(c).over(whole) for c in counts})

    # windows spill, so beyond a few tasks per core larger ranges do no harm
    parts = min(max(2, math.ceil(2 * total / max(1, limit))),
                max(MOST_RANGES, 4 * dist.sparkSession.sparkContext.defaultParallelism))
    ranged = settle(dist.repartitionByRange(parts, *groups, "value")
                    .withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*groups, "__part").agg(*[F.sum(c).alias(f"__s_{c}") for c in counts])
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *groups, "__part",
        *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in counts],
        *[F.sum(f"__s_{c}").over(whole).alias(f"tot_{c}") for c in counts])
    inside = (Window.partitionBy(*groups, "__part").orderBy("value")
              .rowsBetween(Window.unboundedPreceding, 0))
    local = ranged.withColumns({f"__c_{c}": F.sum(c).over(inside) for c in counts})
    out = attach(local, offsets, [*groups, "__part"], null_safe=True)
    out = out.withColumns({f"cum_{c}": F.col(f"__c_{c}") + F.col(f"__b_{c}") for c in counts})
    return out.select(*dist.columns, *[f"cum_{c}" for c in counts], *[f"tot_{c}" for c in counts])


def rank_of(p: float, total: Column, interpolation: str = "linear") -> tuple[Column, Column, Column]:
    """Zero-based lower and upper rank of percentile ``p`` and the weight of the upper one."""
    h = (total - 1) * F.lit(float(p))
    low, high = F.floor(h), F.ceil(h)
    if interpolation == "linear":
        return low, high, h - low
    if interpolation == "lower":
        return low, low, F.lit(0.0)
    if interpolation == "higher":
        return high, high, F.lit(0.0)
    if interpolation == "midpoint":
        return low, high, F.when(low == high, F.lit(0.0)).otherwise(F.lit(0.5))
    if interpolation == "nearest":
        near = F.rint(h).cast("long")
        return near, near, F.lit(0.0)
    raise ValueError(f"unknown interpolation '{interpolation}'")


class GroupSizes:
    """Size of the largest group and number of groups, from one small job."""

    def __init__(self, rows: DataFrame, groups: Sequence[str]):
        self.groups = list(groups)
        self.table = rows.groupBy(*self.groups).agg(F.count(F.lit(1)).alias("n"))
        biggest, self.number, size = self.table.agg(
            F.max("n"), F.count(F.lit(1)), F.sum(key_bytes(rows, self.groups))).first()
        self.biggest, self.bytes = biggest or 0, size or 0

    def few(self, per_group: int = 1) -> bool:
        """Whether a table of so many rows per group may be broadcast."""
        return few(per_group * self.number, per_group * self.bytes)

    def larger_than(self, limit: int) -> DataFrame:
        """The groups with more rows; at most (all rows / limit) of them."""
        return self.table.filter(F.col("n") > limit).select(*self.groups)


def percentiles(df: DataFrame, groups: Sequence[str], value: str, wanted: Mapping[str, float], *,
                interpolation: str = "linear", sizes: GroupSizes | None = None,
                max_group_rows: int | None = None) -> DataFrame:
    """Exact percentiles: one row per group, one column per entry of ``wanted``.

    ``sizes`` may give the number of non-missing values per group if it is known.
    """
    limit = MAX_GROUP_ROWS if max_group_rows is None else max_group_rows
    keys = list(groups) or ["__all"]
    rows = df if groups else df.withColumn("__all", F.lit(0))
    rows = rows.select(*keys, known_number(F.col(value)).alias("value")).filter("value is not null")
    sizes = GroupSizes(rows, keys) if sizes is None else sizes
    if sizes.biggest <= limit:
        out = _small_groups(rows, keys, wanted, interpolation)
    elif sizes.number <= MANY_GROUPS:
        out = _large_groups(rows, keys, wanted, interpolation)
    else:
        large = sizes.larger_than(limit).withColumn("__large", F.lit(True))
        rows = attach(rows, large, keys, null_safe=True)
        out = _small_groups(rows.filter("__large is null"), keys, wanted, interpolation).unionByName(
            _large_groups(rows.filter("__large"), keys, wanted, interpolation))
    return out.select(*groups, *wanted)


def _between(name: str, share: Column) -> Column:
    lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
    return (lo + (hi - lo) * share).alias(name)


def _small_groups(rows: DataFrame, keys: list[str], wanted: Mapping[str, float],
                  interpolation: str) -> DataFrame:
    """The value at rank r is the smallest value whose running count exceeds r: a plain min."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = distribution(rows, keys, "value").withColumns(
        {"cum": F.sum("cnt").over(upto), "n": F.sum("cnt").over(whole)})
    aggs = []
    for name, p in wanted.items():
        low, high, _share = rank_of(p, F.col("n"), interpolation)
        aggs += [F.min(F.when(F.col("cum") > low, F.col("value"))).alias(f"__lo_{name}"),
                 F.min(F.when(F.col("cum") > high, F.col("value"))).alias(f"__hi_{name}")]
    out = run.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    return out.select(*keys, *[_between(name, rank_of(p, F.col("n"), interpolation)[2])
                               for name, p in wanted.items()])


def ordered_cuts(rows: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """(keys, n, rank, cut) for groups that fit a task: at which value each of many ranks is reached."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = distribution(rows, keys, value).withColumns({"cum": F.sum("cnt").over(upto), "n": F.sum("cnt").over(whole)})
    hits = F.filter(ranks(F.col("n")), lambda r: (r > F.col("cum") - F.col("cnt")) & (r <= F.col("cum")))
    return run.select(*keys, "n", F.explode(F.array_distinct(hits)).alias("rank"), F.col("value").alias("cut"))


def _large_groups(rows: DataFrame, keys: list[str], wanted: Mapping[str, float],
                  interpolation: str) -> DataFrame:
    """The wanted ranks bracketed by sketches and counted exactly."""
    def ranks(n: Column) -> Column:
        return F.array(*[r + 1 for p in wanted.values() for r in rank_of(p, n, interpolation)[:2]])

    x = F.col("value")
    strata = [] if keys == ["__all"] else keys  # a constant is no key to join by
    cuts = sketched_cuts(rows, strata, x, x, value_levels, ranks)
    cuts = cuts if strata else cuts.withColumn("__all", F.lit(0))
    aggs = []
    for name, p in wanted.items():
        low, high, _share = rank_of(p, F.col("n"), interpolation)
        aggs += [F.max(F.when(F.col("rank") == low + 1, F.col("cut"))).alias(f"__lo_{name}"),
                 F.max(F.when(F.col("rank") == high + 1, F.col("cut"))).alias(f"__hi_{name}")]
    out = cuts.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    return out.select(*keys, *[_between(name, rank_of(p, F.col("n"), interpolation)[2])
                               for name, p in wanted.items()])


def modes(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Most frequent value per group, the smallest one on ties."""
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("best")
    return distribution(df, groups, value).groupBy(*groups).agg(best).select(
        *groups, F.col("best.value").alias(name))
