"""Queries on group aggregates, robust statistics and distribution distance."""

from pyspark.sql import functions as F

from fillgauge.operators import robust
from fillgauge.operators.aggregate import aggregate_variable, value_counts
from fillgauge.queries.base import GAPPY, PAIRS, gappy, pairs, query, rounded, table


def _by_group(name: str, operation: str, sql: str, *, group: str = "act", rule: str = "pay",
              digits: int | None = 4, **options) -> None:
    """Register one aggregate of ``pay`` per group, written back onto every row."""
    body = sql if digits is None else f"round({sql}, {digits})"
    oracle = (f"WITH g AS ({GAPPY}), a AS (SELECT {group} AS k, {body} AS value FROM g "
              f"WHERE {group} IS NOT NULL GROUP BY {group}) "
              f"SELECT o_orderkey, value FROM g LEFT JOIN a ON {group} = k")

    @query(name, oracle)
    def _(spark, d):
        out = aggregate_variable(gappy(spark, d), "value", group, rule, operation, **options)
        out = out.select("o_orderkey", "value")
        return out if digits is None else rounded(out, value=digits)


_by_group("agg_count", "count", "count(pay)", digits=None)
_by_group("agg_count_distinct", "count distinct", "count(DISTINCT o_custkey)", rule="o_custkey",
          digits=None)
_by_group("agg_median", "median", "quantile_cont(pay, 0.5)")
_by_group("agg_percentile", "percentile", "quantile_cont(pay, 0.9)", group="o_custkey",
          percentile_value=0.9)
_by_group("agg_sum", "sum", "coalesce(sum(pay), 0)", group="o_custkey", digits=2)
_by_group("agg_mean", "mean", "avg(pay)", digits=6)
_by_group("agg_min", "min", "min(pay)", digits=None)
_by_group("agg_max", "max", "max(pay)", group="o_custkey", digits=None)
_by_group("agg_std", "std", "stddev_samp(pay)", digits=3)
_by_group("agg_var", "var", "var_samp(pay)", group="o_custkey", digits=-2)
_by_group("agg_sem", "sem", "stddev_samp(pay) / sqrt(count(pay))", group="o_custkey", digits=3)
_by_group("agg_size", "size", "count(*)", digits=None)
_by_group("agg_skew", "skew",
          "CASE WHEN count(pay) >= 3 THEN CASE WHEN var_pop(pay) = 0 THEN 0 ELSE "
          "sqrt(count(pay) * (count(pay) - 1)) / (count(pay) - 2) * "
          "(avg(pay*pay*pay/1e15) - 3*avg(pay/1e5)*avg(pay*pay/1e10) + 2*pow(avg(pay/1e5), 3)) "
          "/ pow(var_pop(pay/1e5), 1.5) END END", digits=5)


@query("agg_product", """
WITH g AS (SELECT l_orderkey, l_linenumber, l_orderkey AS k, 1 - l_discount AS rest FROM lineitem),
a AS (SELECT k, round(product(rest), 9) AS value FROM g GROUP BY k)
SELECT l_orderkey, l_linenumber, value FROM g JOIN a USING (k)""")
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                            (1 - F.col("l_discount")).alias("rest"))
    out = aggregate_variable(df, "value", "l_orderkey", "rest", "prod")
    return rounded(out.select("l_orderkey", "l_linenumber", "value"), value=9)


@query("agg_bool", f"""
WITH g AS (SELECT *, pay > 480000 AS rich FROM ({GAPPY})),
a AS (SELECT o_custkey AS k, coalesce(bool_or(rich), false) AS has_any, coalesce(bool_and(rich), true) AS has_all
      FROM g GROUP BY o_custkey)
SELECT o_orderkey, has_any, has_all FROM g JOIN a ON o_custkey = k""")
def _(spark, d):
    df = gappy(spark, d).withColumn("rich", F.col("pay") > 480000)
    df = aggregate_variable(df, "has_any", "o_custkey", "rich", "any")
    df = aggregate_variable(df, "has_all", "o_custkey", "rich", "all")
    return df.select("o_orderkey", "has_any", "has_all")


@query("agg_first_last", f"""
WITH g AS ({GAPPY}), a AS (SELECT o_custkey AS k, min_by(pay, o_orderkey) FILTER (pay IS NOT NULL) AS first_pay,
  max_by(pay, o_orderkey) FILTER (pay IS NOT NULL) AS last_pay FROM g GROUP BY o_custkey)
SELECT o_orderkey, first_pay, last_pay FROM g JOIN a ON o_custkey = k""")
def _(spark, d):
    df = gappy(spark, d)
    for op in ("first", "last"):
        df = aggregate_variable(df, f"{op}_pay", "o_custkey", "pay", op, order_by=["o_orderkey"])
    return df.select("o_orderkey", "first_pay", "last_pay")


@query("agg_mode", f"""
WITH g AS ({GAPPY}), c AS (SELECT o_custkey AS k, act, count(*) AS n FROM g WHERE act IS NOT NULL GROUP BY ALL),
a AS (SELECT k, act AS value FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, act) = 1)
SELECT o_orderkey, value FROM g LEFT JOIN a ON o_custkey = k""")
def _(spark, d):
    return aggregate_variable(gappy(spark, d), "value", "o_custkey", "act", "mode").select(
        "o_orderkey", "value")


@query("agg_multi_key", f"""
WITH g AS ({GAPPY}), a AS (SELECT act AS k1, o_orderstatus AS k2, round(avg(pay), 6) AS value FROM g
  WHERE pay > 100000 AND act IS NOT NULL GROUP BY act, o_orderstatus)
SELECT o_orderkey, value FROM g LEFT JOIN a ON act = k1 AND o_orderstatus = k2""")
def _(spark, d):
    out = aggregate_variable(gappy(spark, d), "value", ["act", "o_orderstatus"], "pay", "mean",
                             condition="pay > 100000")
    return rounded(out.select("o_orderkey", "value"), value=6)


@query("agg_global", f"""
WITH g AS ({GAPPY}), m AS (SELECT round(quantile_cont(pay, 0.5), 4) AS middle, count(*) AS n FROM g),
t AS (SELECT act FROM g WHERE act IS NOT NULL GROUP BY act ORDER BY count(*) DESC, act LIMIT 1)
SELECT o_orderkey, middle, n, t.act AS usual FROM g, m, t""")
def _(spark, d):
    df = aggregate_variable(gappy(spark, d), "middle", None, "pay", "median")
    df = aggregate_variable(df, "n", None, None, "count")
    df = aggregate_variable(df, "usual", None, "act", "mode")
    return rounded(df.select("o_orderkey", "middle", "n", "usual"), middle=4)


@query("agg_conditional", f"""
WITH g AS ({GAPPY}), a AS (SELECT o_custkey AS k, round(sum(pay), 2) AS value FROM g
  WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT o_orderkey, value FROM g LEFT JOIN a ON o_custkey = k""")
def _(spark, d):
    out = aggregate_variable(gappy(spark, d), "value", "o_custkey", "pay", "sum",
                             condition=F.col("o_orderstatus") == "F")
    return rounded(out.select("o_orderkey", "value"), value=2)


@query("agg_callable", f"""
WITH g AS ({GAPPY}), a AS (SELECT act AS k, max(pay) - min(pay) AS value FROM g WHERE act IS NOT NULL GROUP BY act)
SELECT o_orderkey, value FROM g LEFT JOIN a ON act = k""")
def _(spark, d):
    return aggregate_variable(gappy(spark, d), "value", "act", "pay",
                              lambda c: F.max(c) - F.min(c)).select("o_orderkey", "value")


@query("value_counts", f"SELECT act AS value, count(*) AS n FROM ({GAPPY}) GROUP BY act")
def _(spark, d):
    return value_counts(gappy(spark, d), "act", dropna=False)


@query("winsorize", f"""
WITH g AS ({GAPPY}), q AS (SELECT act, quantile_cont(pay, [0.05, 0.95]) AS q FROM g GROUP BY act)
SELECT o_orderkey, round(CASE WHEN pay IS NOT NULL THEN least(greatest(pay, q[1]), q[2]) END, 4) AS winsorized
FROM g JOIN q ON g.act IS NOT DISTINCT FROM q.act""")
def _(spark, d):
    out = robust.winsorize(gappy(spark, d), ["act"], "pay")
    return rounded(out.select("o_orderkey", "winsorized"), winsorized=4)


@query("mad", f"""
WITH g AS ({GAPPY}), m AS (SELECT act, quantile_cont(pay, 0.5) AS m FROM g GROUP BY act)
SELECT g.act, round(quantile_cont(abs(pay - m), 0.5), 4) AS mad FROM g JOIN m ON g.act IS NOT DISTINCT FROM m.act
GROUP BY g.act""")
def _(spark, d):
    return rounded(robust.mad(gappy(spark, d), ["act"], "pay"), mad=4)


@query("iqr", f"""
SELECT o_custkey, round(quantile_cont(pay, 0.75) - quantile_cont(pay, 0.25), 4) AS iqr
FROM ({GAPPY}) WHERE pay IS NOT NULL GROUP BY o_custkey""")
def _(spark, d):
    return rounded(robust.iqr(gappy(spark, d), ["o_custkey"], "pay"), iqr=4)


@query("p95_p5", f"""
SELECT act, round(quantile_cont(pay, 0.95) - quantile_cont(pay, 0.05), 4) AS p95p5 FROM ({GAPPY}) GROUP BY act""")
def _(spark, d):
    return rounded(robust.p95_p5(gappy(spark, d), ["act"], "pay"), p95p5=4)


def ks_sql(source: str, keys: list[str], ties: str = "sequential") -> str:
    """SQL for (keys, n1, n2, d) of columns y_true and y_pred of ``source``."""
    k = ", ".join(keys)
    gap = "abs(c1 / n1 - c2 / n2)"
    if ties == "sequential":
        gap = f"greatest({gap}, CASE WHEN a > 0 THEN abs(c1 / n1 - (c2 - b) / n2) ELSE 0 END)"
    return f"""SELECT {k}, max(n1) AS n1, max(n2) AS n2, max({gap}) AS d FROM (
  SELECT {k}, v, a, b, sum(a) OVER (PARTITION BY {k} ORDER BY v) AS c1,
    sum(b) OVER (PARTITION BY {k} ORDER BY v) AS c2,
    sum(a) OVER (PARTITION BY {k}) AS n1, sum(b) OVER (PARTITION BY {k}) AS n2 FROM (
    SELECT {k}, v, sum(a) AS a, sum(b) AS b FROM (
      SELECT {k}, y_true AS v, 1 AS a, 0 AS b FROM {source} WHERE y_true IS NOT NULL
      UNION ALL SELECT {k}, y_pred, 0, 1 FROM {source} WHERE y_pred IS NOT NULL) GROUP BY {k}, v))
GROUP BY {k}"""


def ks_p_sql(d: str, n1: str, n2: str) -> str:
    lam = (f"((sqrt({n1} * {n2} / ({n1} + {n2})) + 0.12::DOUBLE + 0.11::DOUBLE / "
           f"sqrt({n1} * {n2} / ({n1} + {n2}))) * {d})")
    return (f"greatest(0::DOUBLE, least(1::DOUBLE, list_sum(list_transform(range(1, 101), "
            f"lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2::DOUBLE * k * k * {lam} * {lam})))))")


@query("ks_stat", f"""
WITH p AS ({PAIRS}), k AS ({ks_sql('p', ['act'])}), s AS ({ks_sql('p', ['act'], 'standard')})
SELECT act, CAST(k.n1 AS BIGINT) AS n_true, CAST(k.n2 AS BIGINT) AS n_imp, round(k.d, 9) AS ks_stat,
  round(s.d, 9) AS ks_standard FROM k JOIN s USING (act)""")
def _(spark, d):
    df = pairs(spark, d)
    a = robust.ks_two_sample(df, ["act"], "y_true", "y_pred")
    b = robust.ks_two_sample(df, ["act"], "y_true", "y_pred", ties="standard")
    out = a.join(b.select("act", F.col("ks_stat").alias("ks_standard")), "act")
    return rounded(out.select("act", "n_true", "n_imp", "ks_stat", "ks_standard"),
                   ks_stat=9, ks_standard=9)


@query("ks_pvalue", f"""
WITH p AS (SELECT act, status, y_true, y_true + 1500 AS y_pred FROM ({PAIRS})),
k AS ({ks_sql('p', ['act', 'status'])})
SELECT act, status, round({ks_p_sql('d', 'n1', 'n2')}, 7) AS ks_p FROM k""")
def _(spark, d):
    df = pairs(spark, d).withColumn("y_pred", F.col("y_true") + 1500)
    out = robust.ks_two_sample(df, ["act", "status"], "y_true", "y_pred")
    return rounded(out.select("act", "status", "ks_p"), ks_p=7)
