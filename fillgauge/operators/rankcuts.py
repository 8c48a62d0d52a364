"""Exact order statistics of a row key without sorting the table.

A draw of exactly k rows is "the k smallest random keys".  Instead of a global
sort, rows are counted by a coarse monotone bucket of the key; only the bucket
that holds rank k is looked at again, with a finer bucket, until few enough
distinct keys are left to order.  The result is a cut: picking the rows is then a
plain comparison, with no shuffle and no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fillgauge.functions.values import md5_key, uniform_from_md5
from fillgauge.operators.joins import attach, few, key_bytes
from fillgauge.session import settle

#: Largest number of rows of one bucket that are ordered inside one task.
MAX_BUCKET_ROWS = 1_000_000
#: Size of the quantile sketches; their ranks err by about a third of ``SKETCH_ERROR`` of all rows.
SKETCH_SIZE = 4096
SKETCH_ERROR = 0.004
#: Steps between the quantiles that are read from a sketch.
SKETCH_STEPS = 500
#: Most brackets that are kept on the driver.
FEW_BRACKETS = 1_000


def md5_levels(key: Column) -> list[Column]:
    """Ever finer buckets of an md5 text: 3, 7 and 11 hexadecimal digits."""
    return [F.substring(key, 1, n) for n in (3, 7, 11)]


def weighted_levels(key: Column) -> list[Column]:
    """Ever finer buckets of a weighted key, on the logarithmic scale."""
    log = F.ln(key["e"])
    return [F.floor(log * F.lit(float(2**n))) for n in (9, 24, 38)]


def value_levels(x: Column) -> list[Column]:
    """Ever finer buckets of a number, of equal relative width.

    ln|x| lies between -745 and 710, so the shift keeps the sign of every nonzero
    number and the order of all numbers.
    """
    scale = F.signum(x) * F.when(x == 0, F.lit(0.0)).otherwise(F.ln(F.abs(x)) + F.lit(800.0))
    return [F.floor(scale * F.lit(float(2**n))) for n in (9, 24, 38)]


def weighted_key(id_cols: Sequence[str], weight: Column, *salt: object) -> Column:
    """Key whose k smallest values are k successive weighted draws (Efraimidis, Spirakis 2006)."""
    text = md5_key(id_cols, *salt)
    return F.struct((-F.ln(uniform_from_md5(text)) / weight).alias("e"), text.alias("t"))


def rank_cuts(df: DataFrame, strata: Sequence[str], key: Column, levels: list[Column],
              ranks: Callable[[Column], Column], weight: Column | None = None, *,
              max_bucket_rows: int | None = None) -> DataFrame:
    """(strata, n, rank, cut, before, size): the key at which each wanted rank is reached.

    ``ranks`` maps the total weight of a stratum to an array of wanted ranks
    (from 1); ranks outside the stratum give no row.  ``before`` is the weight of
    all smaller keys, ``size`` the weight at the cut itself.
    """
    limit = MAX_BUCKET_ROWS if max_bucket_rows is None else max_bucket_rows
    strata = list(strata)
    weight = F.lit(1) if weight is None else weight
    depth = len(levels)
    rows = df.select(*strata, F.lit(0).alias("__b"), key.alias("__key"),
                     weight.cast("long").alias("__w"),
                     *[lv.alias(f"__l{i}") for i, lv in enumerate(levels)])
    group = [*strata, "__b"]

    def running(by: list[str], order: str) -> Window:
        return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    hist = rows.groupBy(*group, "__l0").agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("m"))
    hist = hist.withColumns({"cum": F.sum("w").over(running(group, "__l0")),
                             "n": F.sum("w").over(Window.partitionBy(*group))})
    hits = F.filter(ranks(F.col("n")).cast("array<bigint>"), lambda r: (
        (r >= 1) & (r > F.col("cum") - F.col("w")) & (r <= F.col("cum"))))
    wanted = settle(hist.withColumn("rank", F.explode(F.array_distinct(hits))).select(
        *strata, "n", "rank", (F.col("cum") - F.col("w")).alias("before"),
        F.col("__l0").alias("__b"), "m"))
    rows = rows.withColumn("__b", F.col("__l0"))
    level = 0
    crowd, small = _crowd(wanted, group)
    while level + 1 < depth and (crowd or 0) > limit:
        level += 1
        fine = f"__l{level}"
        near = attach(rows, wanted.select(*group).distinct(), group, how="inner", null_safe=True,
                      settled=True, small=small)
        hist = near.groupBy(*group, fine).agg(F.sum("__w").alias("w"), F.count(F.lit(1)).alias("m2"))
        hist = hist.withColumn("cum", F.sum("w").over(running(group, fine)))
        wanted = _reached(hist, wanted, group)
        wanted = settle(wanted.select(
            *strata, "n", "rank", (F.col("before") + F.col("cum") - F.col("w")).alias("before"),
            F.col(fine).alias("__b"), F.col("m2").alias("m")))
        rows = rows.withColumn("__b", F.col(fine))
        crowd, small = _crowd(wanted, group)

    near = attach(rows, wanted.select(*group).distinct(), group, how="inner", null_safe=True,
                  settled=True, small=small)
    # copies of one key are folded before the last, bounded ordering
    keys = near.groupBy(*group, "__key").agg(F.sum("__w").alias("w"))
    keys = keys.withColumn("cum", F.sum("w").over(running(group, "__key")))
    done = _reached(keys, wanted, group)
    return done.select(*strata, "n", "rank", F.col("__key").alias("cut"),
                       (F.col("before") + F.col("cum") - F.col("w")).alias("before"),
                       F.col("w").alias("size"))


def sketched_cuts(df: DataFrame, strata: Sequence[str], key: Column, number: Column,
                  levels: Callable[[Column], list[Column]], ranks: Callable[[Column], Column], *,
                  max_bucket_rows: int | None = None) -> DataFrame:
    """The table of :func:`rank_cuts`, in two passes over rows of any distribution.

    ``number`` does not fall as ``key`` rises; rows without one are left out.  A mergeable quantile
    sketch per stratum brackets every wanted rank; a second pass counts the rows below each
    bracket exactly and orders those inside.  Where the count shows that a rank lies outside its
    bracket, the rank is looked up by histograms (``levels``), so a sketch can only cost time.
    Brackets with too many rows for one task are searched by histograms too, and so are
    strata too many to be bracketed.
    """
    limit = MAX_BUCKET_ROWS if max_bucket_rows is None else max_bucket_rows
    strata, df = list(strata), df.filter(number.isNotNull())
    brackets = _brackets(df, strata, number, ranks)
    held = brackets.limit(FEW_BRACKETS + 1).collect()
    if len(held) > FEW_BRACKETS:
        return rank_cuts(df, strata, key, levels(key), ranks, max_bucket_rows=limit)
    rows = df.select(*strata, key.alias("__key"), number.alias("__x"))
    below, inside = F.col("__x") < F.col("lo"), (F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi"))
    by = [*strata, "n", "rank", "lo", "hi"]
    near = _in_brackets(rows, held, brackets.schema, strata, below | inside)
    most = max((r["n"] for r in held), default=0) * (2 * SKETCH_ERROR + 3 / SKETCH_STEPS)
    if most <= limit:
        keys = near.groupBy(*by, F.when(inside, F.col("__key")).alias("cut")).agg(F.count(F.lit(1)).alias("size"))
        order = Window.partitionBy(*by).orderBy(F.col("cut").asc_nulls_first())
        upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
        cuts = keys.withColumn("before", upto - F.col("size")).filter(
            "cut is not null and rank > before and rank <= before + size")
        cuts = cuts.select(*strata, "n", "rank", "cut", "before", "size")
    else:
        counts = near.groupBy(*by).agg(F.count_if(below).alias("below"))
        known = counts.collect()
        inner = _in_brackets(rows, known, counts.schema, strata, inside).withColumnsRenamed({"n": "__n", "rank": "__rank"})
        found = rank_cuts(inner, [*strata, "__n", "__rank", "below"], F.col("__key"), levels(F.col("__key")),
                          lambda n: F.array(F.col("__rank") - F.col("below")), max_bucket_rows=limit)
        cuts = found.select(*strata, F.col("__n").alias("n"), F.col("__rank").alias("rank"), "cut",
                            (F.col("before") + F.col("below")).alias("before"), "size")
    done = cuts.collect()  # one row per bracket at most
    out = df.sparkSession.createDataFrame(done, cuts.schema)
    reached = {(*[r[c] for c in strata], r["rank"]) for r in done}
    missed = [r for r in held if (*[r[c] for c in strata], r["rank"]) not in reached]
    if missed:
        again = rank_cuts(df, strata, key, levels(key), ranks, max_bucket_rows=limit)
        wanted = _in_brackets(again.withColumnRenamed("rank", "__r").drop("n"), missed, brackets.schema, strata,
                              F.col("__r") == F.col("rank"))
        out = out.unionByName(wanted.select(*out.columns))
    return out


def _brackets(df: DataFrame, strata: list[str], number: Column, ranks: Callable[[Column], Column]) -> DataFrame:
    """(strata, n, rank, lo, hi): between which numbers each wanted rank should lie, by a sketch per stratum."""
    shares = ", ".join(f"{i / SKETCH_STEPS!r}D" for i in range(SKETCH_STEPS + 1))
    seen = df.select(*strata, number.alias("__x")).groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"kll_sketch_agg_double(__x, {SKETCH_SIZE})").alias("sketch")).filter("n > 0")
    asked = F.filter(F.array_distinct(ranks(F.col("n")).cast("array<bigint>")), lambda r: (r >= 1) & (r <= F.col("n")))
    seen = seen.select(*strata, "n", F.expr(f"kll_sketch_get_quantile_double(sketch, array({shares}))").alias("grid"),
                       F.explode(asked).alias("rank"))
    low = F.floor(((F.col("rank") - 1) / F.col("n") - SKETCH_ERROR) * SKETCH_STEPS).cast("int")
    high = F.ceil((F.col("rank") / F.col("n") + SKETCH_ERROR) * SKETCH_STEPS).cast("int")
    return seen.select(*strata, "n", "rank",
                       F.when(low <= 0, F.lit(float("-inf"))).otherwise(F.get("grid", low)).alias("lo"),
                       F.when(high >= SKETCH_STEPS, F.lit(float("inf"))).otherwise(F.get("grid", high)).alias("hi"))


def _in_brackets(rows: DataFrame, held: list[Row], schema: T.StructType, strata: list[str], where: Column) -> DataFrame:
    """Rows with each bracket of their stratum for which ``where`` holds; there are few brackets."""
    if not strata:  # no key to join by: the brackets travel with the plan
        kinds = {f.name: f.dataType for f in schema}
        cells = [F.struct(*[F.lit(r[c]).cast(k).alias(c) for c, k in kinds.items()]) for r in held]
        cells = F.array(*cells) if cells else F.array().cast(T.ArrayType(schema))
        return rows.withColumn("__at", F.explode(cells)).select("*", "__at.*").drop("__at").filter(where)
    names = {c: f"__s_{i}" for i, c in enumerate(strata)}
    small = rows.sparkSession.createDataFrame(held, schema).withColumnsRenamed(names)
    cond = where
    for c, k in names.items():
        cond = cond & F.col(c).eqNullSafe(F.col(k))
    return rows.join(F.broadcast(small), cond).drop(*names.values())


def _crowd(wanted: DataFrame, group: list[str]) -> tuple[int | None, bool]:
    """Most rows in one wanted bucket, and whether the wanted buckets are few and narrow."""
    crowd, places, size = wanted.agg(F.max("m"), F.count(F.lit(1)), F.sum(key_bytes(wanted, group))).first()
    return crowd, few(places, size)


def _reached(running: DataFrame, wanted: DataFrame, group: list[str]) -> DataFrame:
    """Running rows at which a wanted rank is reached."""
    names = {c: f"__w_{i}" for i, c in enumerate(group)}
    targets = wanted.withColumnsRenamed(names)
    cond = (F.col("rank") > F.col("before") + F.col("cum") - F.col("w")) & (
        F.col("rank") <= F.col("before") + F.col("cum"))
    for a, b in names.items():
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return running.join(targets, cond, "inner").drop(*names.values())


def as_literal(value: object) -> Column:
    """Literal for a key taken from :func:`rank_cuts`."""
    if isinstance(value, Row):
        return F.struct(*[F.lit(value[f]).alias(f) for f in value.__fields__])
    return F.lit(value)


def smallest(df: DataFrame, key: Column, levels: list[Column], k: int | Callable[[Column], Column], *,
             number: Column | None = None) -> Column:
    """Predicate that is true for exactly the ``k`` rows with the smallest keys.

    ``k`` may be computed from the number of rows.  Where the last one falls among rows of
    equal key (their ids repeat), the contents of these rows decide.  Rows that are
    equal in every column cannot be told apart: if it falls among such rows, this is an
    error.  Weighted keys are found by a sketch of their ``number``.
    """
    if isinstance(k, int) and k <= 0:
        return F.lit(False)
    wanted = k if callable(k) else lambda n: F.lit(k)
    if number is None:
        cut = rank_cuts(df, [], key, levels, lambda n: F.array(wanted(n))).first()
    else:
        cut = sketched_cuts(df, [], key, number, weighted_levels, lambda n: F.array(wanted(n))).first()
    if cut is None:
        if callable(k):
            return F.lit(False)
        raise ValueError(f"fewer than {k} rows to draw from")
    last = as_literal(cut["cut"])
    need = cut["rank"] - cut["before"]
    if need == cut["size"]:
        return F.coalesce(key <= last, F.lit(False))
    content = F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    tied = rank_cuts(df.filter(key == last), [], content, md5_levels(content), lambda n: F.array(F.lit(need))).first()
    if tied["before"] + tied["size"] != need:
        raise ValueError(f"{tied['size']} rows are alike in every column: exactly {cut['rank']} cannot be drawn")
    chosen = (key < last) | (key == last) & (content <= F.lit(tied["cut"]))
    return F.coalesce(chosen, F.lit(False))
