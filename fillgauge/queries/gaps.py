"""Operators on inputs with NaN, with ids that repeat, and on all mechanisms at once."""

from pyspark.sql import functions as F

from fillgauge.operators import aggregate, robust
from fillgauge.operators.missing import (mar_company_missing, mar_missing, mcar_missing, mnar_missing)
from fillgauge.operators.sampling import sample_exact, sample_weighted
from fillgauge.plans import evaluate as E
from fillgauge.plans.metrics import group_metrics
from fillgauge.queries.base import query, rounded, table


def holed(spark, d):
    """Orders whose price is NaN in one order out of seven."""
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", price.alias("price"))


#: SQL twin of :func:`holed`; what is NaN there is NULL here.
HOLED = ("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders")


def _aggregated(operation, sql, digits):
    @query(f"agg_{operation}_nan", f"""
SELECT o_orderpriority, round({sql}, {digits}) AS value FROM ({HOLED}) GROUP BY 1""")
    def _(spark, d):
        out = aggregate.group_table(holed(spark, d), ["o_orderpriority"], "value", "price", operation)
        return rounded(out, value=digits)


_aggregated("mean", "avg(price)", 4)
_aggregated("median", "median(price)", 4)


@query("winsorize_nan", f"""
WITH b AS (SELECT o_orderpriority, quantile_cont(price, 0.05) AS lo, quantile_cont(price, 0.95) AS hi
  FROM ({HOLED}) GROUP BY 1)
SELECT o_orderkey, round(least(greatest(price, lo), hi), 4) AS price
FROM ({HOLED}) h JOIN b ON h.o_orderpriority = b.o_orderpriority WHERE price IS NOT NULL""")
def _(spark, d):
    out = robust.winsorize(holed(spark, d), ["o_orderpriority"], "price")
    return out.filter("winsorized is not null").select("o_orderkey", F.round("winsorized", 4).alias("price"))


def _pairs(spark, d):
    """Price against 1.1 times the price; NaN in one of the two now and then."""
    wrong = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") * 1.1)
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderpriority", price.alias("y_true"), wrong.alias("y_pred"),
                                            F.lit("price").alias("variable"))


_PAIRS = ("SELECT o_orderpriority, o_totalprice AS y, o_totalprice * 1.1::DOUBLE AS p FROM orders "
          "WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0")
_SUMS = """count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(avg(p), 4) AS mean_imp,
  round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 4) AS iqr_imp"""
_DIGITS = dict(mae=4, mean_imp=4, iqr_imp=4)


@query("metrics_nan", f"SELECT o_orderpriority, {_SUMS} FROM ({_PAIRS}) GROUP BY 1")
def _(spark, d):
    out = group_metrics(_pairs(spark, d), ["o_orderpriority"])
    return rounded(out.select("o_orderpriority", "n", *_DIGITS), **_DIGITS)


@query("eval_by_group_nan", f"""SELECT 'price' AS variable, o_orderpriority AS "group", {_SUMS} FROM ({_PAIRS}) GROUP BY 2""")
def _(spark, d):
    out = E.summarize_by_group(_pairs(spark, d), "o_orderpriority")
    return rounded(out.select("variable", "group", "n", *_DIGITS), **_DIGITS)


@query("sample_weighted_nan", "SELECT 100::BIGINT AS n, 100::BIGINT AS n_drawable, 100::BIGINT AS n_distinct")
def _(spark, d):
    out = sample_weighted(holed(spark, d), ["o_orderkey"], F.col("price"), 100, 3)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("price")).alias("n_drawable"),
                   F.count_distinct("o_orderkey").alias("n_distinct"))


@query("sample_repeated_ids", """
SELECT unnest([1, 10, 101, 1000]) AS k, unnest([1, 10, 101, 1000])::BIGINT AS n""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    parts = [sample_exact(lines, ["l_orderkey", "l_linenumber"], k, 5).agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(k).alias("k"), "n") for k in (1, 10, 101, 1000)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("sample_null_ids", "SELECT 25::BIGINT AS n")
def _(spark, d):
    rows = table(spark, d, "orders").withColumn("id", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")))
    return sample_exact(rows, ["id"], 25, 8).agg(F.count(F.lit(1)).alias("n"))


_TARGETS = ["price", "debt"]


def _mechanisms(spark, d):
    """Two columns masked by all four mechanisms and refilled by the mean of all known values."""
    base = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"),
        (F.col("o_totalprice") / 10 + F.col("o_orderkey") % 100).alias("debt"),
        F.lit(1).alias("STATUS_ZAPISA"))
    ids = {"id_cols": ["o_orderkey"]}
    masked = {
        101: mcar_missing(base, "price", 0.1, 101, random_state=1, **ids),
        102: mar_missing(base, "price", "debt", 102, 0.1, random_state=2, **ids),
        103: mar_company_missing(base, "o_custkey", "price", 103, 0.1, random_state=3, **ids)[0],
        104: mnar_missing(base, "price", 0.1, 104, random_state=4, **ids)}
    means = base.agg(*[F.avg(c) for c in _TARGETS]).first()
    frames = {s: m.filter(F.col("STATUS_ZAPISA") == s).withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in zip(_TARGETS, means)}) for s, m in masked.items()}
    registry = spark.createDataFrame(
        [(s, "mean", name, "10%") for s, name in zip(masked, ("MCAR", "MAR", "COMPANY", "MNAR"))],
        "Status_zapisa int, Method string, MissMech string, MissRate string")
    return base, registry, frames


@query("eval_all_mechanisms", """
WITH c AS (SELECT count(*) AS all_rows FROM orders)
SELECT m AS "MissMech", v AS variable, CAST(floor(all_rows * 0.1) AS BIGINT) AS n, v = 'debt' AS exact
FROM c, (SELECT unnest(['MCAR', 'MAR', 'COMPANY', 'MNAR']) AS m), (SELECT unnest(['price', 'debt']) AS v)""")
def _(spark, d):
    base, registry, frames = _mechanisms(spark, d)
    _, summary = E.evaluate_imputations_from_methods(registry, frames, base, id_col="o_orderkey", target_cols=_TARGETS)
    return summary.select("MissMech", "variable", "n", (F.col("rmse") == 0).alias("exact"))


@query("eval_outer_mechanisms", """
WITH c AS (SELECT count(*) AS n FROM orders)
SELECT v AS variable, 4 * n AS n_rows, 4 * CAST(floor(n * 0.1) AS BIGINT) AS n_pairs
FROM c, (SELECT unnest(['price', 'debt']) AS v)""")
def _(spark, d):
    base, registry, frames = _mechanisms(spark, d)
    rows = E.long_rows(registry, frames, base, id_col="o_orderkey", target_cols=_TARGETS, how_join_original="outer")
    return rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n_rows"), F.count("residual").alias("n_pairs"))
