"""Queries on single columns: rounding, texts, derived variables, types, selections."""

from pyspark.sql import functions as F

from fillgauge.functions import values as V
from fillgauge.operators import derive
from fillgauge.plans import evaluate, reports
from fillgauge.queries.base import RECORDS, query, records, table
from fillgauge.sources.records import keep_max_status


@query("round_half_up", """
SELECT l_orderkey, l_linenumber, CAST(round(CAST(CAST(
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS charge
FROM lineitem""")
def _(spark, d):
    charge = F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"))
    return V.round_half_up(df, 2)


@query("ident_pad", """
SELECT o_orderkey, format('{:09d}', o_orderkey) AS ident,
  CASE WHEN o_orderstatus <> 'P' THEN format('{:09d}', o_orderkey * 1000000007 + 42) END AS wide_ident
FROM orders""")
def _(spark, d):
    wide = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") * 1000000007 + 42)
    return table(spark, d, "orders").select(
        "o_orderkey", V.padded_id(F.col("o_orderkey")).alias("ident"),
        V.padded_id(wide).alias("wide_ident"))


@query("keep_max_status", """
SELECT o_orderkey, o_totalprice, "STATUS_ZAPISA" FROM (
  SELECT o_orderkey, o_totalprice, '7' AS "STATUS_ZAPISA" FROM orders
  UNION ALL SELECT o_orderkey, o_totalprice * 1.1::DOUBLE, '41' FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT o_orderkey, o_totalprice, 'x' FROM orders WHERE o_orderstatus = 'O')
WHERE TRY_CAST("STATUS_ZAPISA" AS DOUBLE) = 41""")
def _(spark, d):
    base = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows = (base.withColumn("STATUS_ZAPISA", F.lit("7"))
            .unionByName(base.filter("o_orderstatus = 'F'").withColumns(
                {"o_totalprice": F.col("o_totalprice") * 1.1, "STATUS_ZAPISA": F.lit("41")}))
            .unionByName(base.filter("o_orderstatus = 'O'").withColumn("STATUS_ZAPISA", F.lit("x"))))
    return keep_max_status(rows).select("o_orderkey", "o_totalprice", "STATUS_ZAPISA")


@query("derive_numeric", """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1 - l_discount) END, 4) AS net
FROM lineitem""")
def _(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_discount")
    df = derive.derive_variable(df, "net", "l_extendedprice * (1 - l_discount)",
                                condition="l_returnflag=R")
    return df.select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net"))


@query("derive_character", """
SELECT o_orderkey, substr(o_orderpriority || '/' || o_orderstatus, 1, 7) AS code FROM orders""")
def _(spark, d):
    df = derive.derive_variable(records(spark, d), "code", "concat(o_orderpriority, '/', o_orderstatus)",
                                var_type="character", length=7)
    return df.select("o_orderkey", "code")


@query("derive_condition", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 END AS o_totalprice,
  CASE WHEN o_totalprice > 250000 AND o_orderstatus = 'O' THEN 1::DOUBLE END AS flag,
  CASE WHEN o_orderstatus = 'O' THEN 2::DOUBLE END AS quoted,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice > 90000 THEN 3::DOUBLE END AS compound FROM orders""")
def _(spark, d):
    df = derive.derive_variable(records(spark, d), "flag", "1",
                                condition="o_totalprice > 250000 AND o_orderstatus = 'O'")
    df = derive.derive_variable(df, "quoted", "2", condition="o_orderstatus = 'O'")
    df = derive.derive_variable(df, "compound", "3", condition="o_orderstatus = 'O' AND o_totalprice > 90000")
    df = derive.derive_variable(df, "o_totalprice", "o_totalprice * 2", condition=" o_orderstatus = F ")
    return df.select("o_orderkey", "o_totalprice", "flag", "quoted", "compound")


RANKS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


@query("ordinal_map", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2
  WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS o_orderpriority FROM orders""")
def _(spark, d):
    out, _types = derive.transform_var(records(spark, d), {"o_orderpriority": ("ordinal", RANKS)})
    return out.select("o_orderkey", "o_orderpriority")


@query("ordinal_to_numeric", """
SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS grade,
  CASE WHEN o_orderstatus = 'F' THEN '1' ELSE o_orderstatus END AS mixed FROM orders""")
def _(spark, d):
    df = records(spark, d).select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("grade"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise(F.col("o_orderstatus")).alias("mixed"))
    out, _types = derive.transform_var(df, {"grade": ("ordinal", None), "mixed": ("ordinal", None)})
    return out


@query("retype_cast", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice FROM orders""")
def _(spark, d):
    out, _types = derive.transform_var(records(spark, d), {
        "o_custkey": ("nominal", "string"), "o_totalprice": ("numerical", "bigint")})
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query("infer_var_types", """
SELECT 'o_orderkey' AS variable, 'numerical' AS var_type, count(DISTINCT o_orderkey) AS n_distinct FROM orders
UNION ALL SELECT 'o_custkey', 'numerical', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', 'nominal', count(DISTINCT o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'numerical', count(DISTINCT o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'nominal', count(DISTINCT o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', 'nominal', count(DISTINCT o_orderpriority) FROM orders""")
def _(spark, d):
    orders = table(spark, d, "orders")
    _df, types = derive.transform_var(orders)
    return types.join(derive.profile_columns(orders), "variable").select(
        "variable", "var_type", "n_distinct")


def _profile_sql(column: str, kind: str, text: bool) -> str:
    low = f"count(DISTINCT {column}) / count(*) < 0.5" if text else "false"
    return (f"SELECT '{column}' AS variable, '{kind}' AS type, count(*) AS n, "
            f"count(DISTINCT {column}) AS n_distinct, "
            f"round(count(DISTINCT {column}) / count(*), 6) AS ratio, {low} AS is_low_cardinality "
            "FROM customer")


@query("profile_columns", " UNION ALL ".join(_profile_sql(*c) for c in (
    ("c_custkey", "bigint", False), ("c_name", "string", True), ("c_nationkey", "int", False),
    ("c_acctbal", "double", False), ("c_mktsegment", "string", True))))
def _(spark, d):
    return derive.profile_columns(table(spark, d, "customer")).withColumn("ratio", F.round("ratio", 6))


@query("coerce_numeric", """
SELECT event_id, TRY_CAST(CASE event_type WHEN 'click' THEN event_type ELSE CAST(value AS VARCHAR) END
  AS DOUBLE) AS number FROM events""")
def _(spark, d):
    text = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(
        F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", V.to_number(text).alias("number"))


@query("parse_rate", """
SELECT l_orderkey, l_linenumber, CAST(CAST(round(l_discount * 100) AS INTEGER) AS DOUBLE) AS percent, l_tax AS share
FROM lineitem""")
def _(spark, d):
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    share = F.replace(F.col("l_tax").cast("string"), F.lit("."), F.lit(","))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", V.parse_rate(percent).alias("percent"),
        V.parse_rate(share).alias("share"))


@query("filter_selection", """
SELECT event_id, event_type AS "Method", 'value' AS variable, CAST(user_id AS VARCHAR) AS "MissRate"
FROM events WHERE event_type IN ('click', 'view')""")
def _(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("Method"), F.lit("value").alias("variable"),
        F.col("user_id").cast("string").alias("MissRate"))
    return reports.filter_selection(rows, variables="value", mechs=["MCAR"], methods=["click", "view"])


@query("join_methods", f"""
WITH rec AS ({RECORDS}), reg("s", "Method", "MissMech", "MissRate") AS (VALUES
  (101, 'median', 'MCAR', '5%'), (102, 'mean', 'MAR', '10%'), (NULL, 'none', 'NONE', '0%'))
SELECT o_orderkey, v."STATUS_ZAPISA", reg."Method", reg."MissMech", reg."MissRate" FROM (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 101 WHEN 'O' THEN 103 END AS "STATUS_ZAPISA" FROM rec) v
LEFT JOIN reg ON v."STATUS_ZAPISA" IS NOT DISTINCT FROM reg.s""")
def _(spark, d):
    registry = spark.createDataFrame(
        [(101, "median", "MCAR", "5%"), (102, "mean", "MAR", "10%"), (None, "none", "NONE", "0%")],
        "Status_zapisa int, Method string, MissMech string, MissRate string")
    version = F.when(F.col("o_orderstatus") == "F", 101).when(F.col("o_orderstatus") == "O", 103)
    frames = records(spark, d).select("o_orderkey", version.alias("STATUS_ZAPISA"))
    return evaluate.join_methods(frames, registry)


@query("join_truth", """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, y_pred, y_true FROM
  (SELECT o_orderkey, o_totalprice * 0.5::DOUBLE AS y_pred FROM orders WHERE o_orderstatus <> 'O') a
FULL JOIN (SELECT o_orderkey, o_totalprice AS y_true FROM orders WHERE o_orderpriority <> '5-LOW') b
ON a.o_orderkey = b.o_orderkey""")
def _(spark, d):
    rec = records(spark, d)
    imputed = rec.filter("o_orderstatus <> 'O'").select(
        "o_orderkey", (F.col("o_totalprice") * 0.5).alias("y_pred"))
    original = rec.filter("o_orderpriority <> '5-LOW'")
    return evaluate.join_truth(imputed, original, "o_orderkey", {"o_totalprice": "y_true"}, "outer")


@query("join_truth_inner", """
SELECT a.o_orderkey, y_pred, y_true FROM
  (SELECT o_orderkey, o_totalprice * 0.5::DOUBLE AS y_pred FROM orders WHERE o_orderstatus <> 'O') a
JOIN (SELECT o_orderkey, o_totalprice AS y_true FROM orders WHERE o_orderpriority <> '5-LOW') b
ON a.o_orderkey = b.o_orderkey""")
def _(spark, d):
    rec = records(spark, d)
    imputed = rec.filter("o_orderstatus <> 'O'").select(
        "o_orderkey", (F.col("o_totalprice") * 0.5).alias("y_pred"))
    original = rec.filter("o_orderpriority <> '5-LOW'")
    return evaluate.join_truth(imputed, original, "o_orderkey", {"o_totalprice": "y_true"}, "inner")
