"""Registry of queries and shared inputs, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame and its SQL twin."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as person records: id, company, activity, earnings, version 1."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.lit(1).alias("STATUS_ZAPISA"))


#: SQL twin of :func:`records`.
RECORDS = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, "
           "CAST(1 AS INTEGER) AS \"STATUS_ZAPISA\" FROM orders")


def gappy(spark: SparkSession, folder: str) -> DataFrame:
    """Records with missing earnings (status P) and missing activity (priority 5)."""
    pay = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    act = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return records(spark, folder).withColumns({"pay": pay, "act": act}).drop(
        "o_totalprice", "o_orderpriority")


#: SQL twin of :func:`gappy`.
GAPPY = ("SELECT o_orderkey, o_custkey, o_orderstatus, "
         "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS pay, "
         "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS act FROM orders")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(o_orderkey, activity, status, y_true, y_pred): order price against the sum of its lines."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("y_pred"))
    orders = table(spark, folder, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        "o_orderkey", F.col("o_orderpriority").alias("act"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("y_true"), "y_pred")


#: SQL twin of :func:`pairs`.
PAIRS = ("SELECT o_orderkey, o_orderpriority AS act, o_orderstatus AS status, "
         "o_totalprice AS y_true, y_pred FROM orders LEFT JOIN (SELECT l_orderkey, "
         "round(sum(l_extendedprice), 2) AS y_pred FROM lineitem GROUP BY l_orderkey) l "
         "ON o_orderkey = l_orderkey")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def col_when(cond: str, value: str) -> Column:
    return F.when(F.expr(cond), F.expr(value))


def md5_sql(*parts: str) -> str:
    """SQL twin of the random key; parts are SQL expressions."""
    texts = [f"CAST({p} AS VARCHAR)" for p in parts]
    return "md5(concat_ws('|', " + ", ".join(f"coalesce(length({t}) || ':' || {t}, '-')" for t in texts) + "))"


def uniform_sql(key: str) -> str:
    """SQL twin of the uniform number behind a key."""
    return f"((('0x' || substr({key}, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def wait_sql(key: str, weight: str) -> str:
    """SQL twin of the weighted key."""
    return f"(-ln({uniform_sql(key)}) / ({weight}))"
