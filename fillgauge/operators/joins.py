"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.session import settle

#: A table is broadcast only when it was measured and stays within both bounds.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
#: A key is hot if it has more rows than one task should take, or this share of all rows.
HOT_ROWS = 1_000_000
HOT_SHARE = 0.005
#: Most hot keys that are told apart; with more than HOT_ROWS times as many rows the bound rises.
HOT_KEYS = 20_000
#: Number of slices a hot key is cut into.
HOT_SLICES = 256


def _same(left: Sequence[Column], right: Sequence[Column], null_safe: bool) -> Column:
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & (a.eqNullSafe(b) if null_safe else a == b)
    return cond


def few(rows: int, size: int | None = 0) -> bool:
    """Whether a table of so many rows, with so many bytes in its keys, may be broadcast."""
    return rows <= MAX_BROADCAST_ROWS and (size or 0) + 64 * rows <= MAX_BROADCAST_BYTES


def key_bytes(table: DataFrame, keys: Sequence[str]) -> Column:
    """Bytes of a row's text and binary keys."""
    size = F.lit(0).cast("long")
    for c in keys:
        if isinstance(table.schema[c].dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return size


def is_small(table: DataFrame, max_rows: int | None = None) -> bool:
    """Whether ``table`` may be broadcast, by its rows and the bytes in them."""
    width = F.lit(8 * len(table.columns)).cast("long")
    for f in table.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            width = width + F.coalesce(F.size(f.name), F.lit(0)) * 64
    rows, size = table.agg(F.count(F.lit(1)), F.sum(width)).first()
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    return rows <= limit and (size or 0) <= MAX_BROADCAST_BYTES


def attach(rows: DataFrame, table: DataFrame, on: Sequence[str], *, how: str = "left",
           null_safe: bool = False, settled: bool = False,
           small: bool | None = None, max_broadcast_rows: int | None = None) -> DataFrame:
    """Join ``table`` (one row per key) to ``rows``; ``how`` is ``left`` or ``inner``.

    The table is written out and measured, unless it is ``settled`` already and known
    to be ``small`` or not.  A small one is broadcast, so the rows
    do not move.  Otherwise the rows are shuffled, and rows of hot or NULL keys
    are spread over slices, with the few matching table rows repeated per slice.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    on = list(on)
    table = table if settled else settle(table)
    names = {c: f"__key_{i}" for i, c in enumerate(on)}
    table = table.withColumnsRenamed(names)
    keys = list(names.values())
    if small is None:
        small = is_small(table, max_broadcast_rows)
    if small:
        cond = _same([F.col(c) for c in on], [F.col(k) for k in keys], null_safe)
        return rows.join(F.broadcast(table), cond, how).drop(*keys)

    # equal keys hash alike only if their types agree
    types = dict(rows.dtypes)
    hot = hot_key_hashes(rows, on)
    has_null = F.lit(False)
    for c in on:
        has_null = has_null | F.col(c).isNull()
    spread = F.xxhash64(*[F.col(c) for c in on]).isin(hot)
    repeat = F.xxhash64(*[F.col(k).cast(types[c]) for c, k in names.items()]).isin(hot)
    if not null_safe:
        spread = spread | has_null
    row_slice = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(HOT_SLICES)).cast("int")
    left = rows.withColumn("__slice", F.when(spread, row_slice).otherwise(F.lit(0)))
    slices = F.when(repeat, F.sequence(F.lit(0), F.lit(HOT_SLICES - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("__table_slice", F.explode(slices))
    cond = _same([F.col(c) for c in on], [F.col(k) for k in keys], null_safe)
    cond = cond & (F.col("__slice") == F.col("__table_slice"))
    return left.join(right, cond, how).drop("__slice", "__table_slice", *keys)


def outer_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "outer") -> DataFrame:
    """All pairs of equal keys, NULL equal to NULL, and each unmatched row of the kept sides once.

    ``how`` is ``right`` or ``outer``; other columns of the two sides have different names.  Keys
    with very many rows on a side are cut: a row of that side lies in one slice, and rows of the
    other side are repeated in all slices, so no task has the whole key; if both sides have many,
    slices form a grid, in which each pair still meets once.  Copies must not come out as
    unmatched, so of these keys the unmatched rows are found apart, by the few keys
    of the other side.
    """
    if how not in ("right", "outer"):
        raise ValueError("how must be 'right' or 'outer'")
    on = list(on)
    types = dict(left.dtypes)
    names = {c: f"__key_{i}" for i, c in enumerate(on)}
    right = right.withColumns({c: F.col(c).cast(types[c]) for c in on if dict(right.dtypes)[c] != types[c]})
    hot = [hot_key_hashes(side, on) for side in (left, right)]
    own = F.xxhash64(*[F.col(c) for c in on])
    many = [own.isin(h) for h in hot]
    others = right.withColumnsRenamed(names)
    same = _same([F.col(c) for c in on], [F.col(k) for k in names.values()], True)

    def shown(df: DataFrame) -> DataFrame:
        keys = [F.coalesce(F.col(c), F.col(k)).alias(c) for c, k in names.items()]
        return df.select(*keys, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on])

    if not hot[0] and not hot[1]:
        return shown(left.join(others, same, how))
    cold = left.filter(~(many[0] | many[1])).join(
        right.filter(~(many[0] | many[1])).withColumnsRenamed(names), same, how)
    side = math.isqrt(HOT_SLICES)
    cut = [F.when(many[0] & many[1], side).when(many[i], HOT_SLICES).otherwise(1) for i in (0, 1)]
    hot_rows = [df.filter(many[0] | many[1]) for df in (left, right)]

    def sliced(df: DataFrame, mine: int) -> DataFrame:
        at = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), cut[mine]).cast("int")
        every = F.explode(F.sequence(F.lit(0), cut[1 - mine].cast("int") - 1))
        held = df.withColumns({f"__s{mine}": at})
        return held.withColumn(f"__s{1 - mine}", every)

    a = sliced(hot_rows[0], 0)
    b = sliced(hot_rows[1], 1).withColumnsRenamed({**names, "__s0": "__t0", "__s1": "__t1"})
    meet = (F.col("__s0") == F.col("__t0")) & (F.col("__s1") == F.col("__t1"))
    matched = a.join(b, same & meet).drop("__s0", "__s1", "__t0", "__t1")
    # at most as many keys as are told apart as hot
    keys = [df.select(*on).distinct() for df in hot_rows]
    empty_left = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes]
    alone = hot_rows[1].withColumnsRenamed(names).join(F.broadcast(keys[0]), same, "left_anti")
    parts = [shown(cold), shown(matched), shown(alone.select(*empty_left, *alone.columns))]
    if how == "outer":
        rest = hot_rows[0].join(F.broadcast(keys[1].withColumnsRenamed(names)), same, "left_anti")
        empty_right = [F.lit(None).cast(t).alias(names.get(c, c)) for c, t in right.dtypes]
        parts.append(shown(rest.select(*rest.columns, *empty_right)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hot_key_hashes(rows: DataFrame, on: Sequence[str]) -> list[int]:
    """Hashes of the keys with ``HOT_ROWS`` rows or ``HOT_SHARE`` of all.

    Found by mergeable frequent-item sketches, sized by the number of rows, first per
    slice of the tasks and then over all.  The answer only steers how rows are spread,
    never the result.
    """
    total = rows.count()
    if not total:
        return []
    bound = max(1, min(HOT_SHARE * total, HOT_ROWS), total // HOT_KEYS)
    items = max(1, min(HOT_KEYS, math.ceil(total / bound)))
    h = F.xxhash64(*[F.col(c) for c in on]).alias("h")
    parts = (rows.select(h, F.pmod(F.spark_partition_id(), F.lit(256)).alias("p")).groupBy("p")
             .agg(F.expr(f"approx_top_k_accumulate(h, {10 * items})").alias("sketch"),
                  F.count(F.lit(1)).alias("n")))
    # grouped by a constant, since without groups a task that got no sketch cannot combine
    top = parts.groupBy(F.lit(0).alias("all")).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {10 * items}), {items})").alias("top")).first()["top"]
    return [t["item"] for t in top or [] if t["count"] >= bound]
