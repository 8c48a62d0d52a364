"""Queries on reading record versions and writing them back."""

from pyspark.sql import functions as F

from fillgauge.operators.categories import resolve_rare_threshold
from fillgauge.plans.model import leaf_sizes
from fillgauge.queries.base import query, table
from fillgauge.session import fresh_path
from fillgauge.sources import documents, records as R


def _base(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("status_zapisa"))


def _edits(spark, d):
    """Version 2 raises finished orders, version 3 lowers urgent ones."""
    orders = table(spark, d, "orders")
    up = orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 1.1).alias("o_totalprice"),
        F.lit(2).alias("status_zapisa"))
    down = orders.filter("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", "o_orderstatus", (F.col("o_totalprice") * 0.9).alias("o_totalprice"),
        F.lit(3).alias("status_zapisa"))
    return up.unionByName(down)


HALF_UP = "CAST(round(CAST(CAST({} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"
BASE = "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(1 AS INTEGER) AS status_zapisa FROM orders"
EDITS = ("SELECT o_orderkey, o_orderstatus, o_totalprice * 1.1::DOUBLE AS o_totalprice, "
         "CAST(2 AS INTEGER) AS status_zapisa FROM orders WHERE o_orderstatus = 'F' UNION ALL "
         "SELECT o_orderkey, o_orderstatus, o_totalprice * 0.9::DOUBLE, 3 FROM orders "
         "WHERE o_orderpriority = '1-URGENT'")


def _latest_sql(status: int) -> str:
    return f"""SELECT o_orderkey, o_orderstatus, {HALF_UP.format('o_totalprice')} AS o_totalprice, status_zapisa,
  CAST(1 AS INTEGER) AS rn, format('{{:09d}}', o_orderkey) AS ident FROM (
  SELECT * FROM ({BASE}) UNION ALL SELECT * FROM ({EDITS}) WHERE status_zapisa = {status})
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY status_zapisa DESC) = 1"""


@query("load_latest_version", _latest_sql(3))
def _(spark, d):
    path = fresh_path(spark, "loaded")
    return R.load_input_data(_base(spark, d), _edits(spark, d), 3, id_col="o_orderkey", base_status=1,
                             tie_cols=["o_totalprice"], parquet_path=path)


@query("load_versions", f"""
SELECT CAST(2 AS INTEGER) AS requested_status, * FROM ({_latest_sql(2)})
UNION ALL SELECT 3, * FROM ({_latest_sql(3)})""")
def _(spark, d):
    return R.load_versions(_base(spark, d), _edits(spark, d), [2, 3], id_col="o_orderkey",
                           tie_cols=["o_totalprice"])


@query("load_versions_max", f"""
SELECT CAST(2 AS INTEGER) AS requested_status, * FROM ({_latest_sql(2)}) WHERE status_zapisa = 2
UNION ALL SELECT 3, * FROM ({_latest_sql(3)}) WHERE status_zapisa = 3""")
def _(spark, d):
    return R.load_versions(_base(spark, d), _edits(spark, d), [2, 3], id_col="o_orderkey",
                           tie_cols=["o_totalprice"], keep_only_max_status=True)


def _stored(spark, d, label):
    path = fresh_path(spark, label)
    _base(spark, d).select("o_orderkey", "o_totalprice", "status_zapisa").write.partitionBy(
        "status_zapisa").parquet(path)
    return path


@query("sink_aligned_append", f"""
SELECT o_orderkey, o_totalprice, status_zapisa FROM ({BASE})
UNION ALL SELECT o_orderkey, round(o_totalprice, 0), status_zapisa FROM ({EDITS})""")
def _(spark, d):
    path = _stored(spark, d, "append")
    # the extra column is dropped, earnings are cast by the sink
    edits = _edits(spark, d).withColumn("o_totalprice", F.round("o_totalprice", 0).cast("string"))
    R.save_output_data(edits, path, dtype={"o_totalprice": "double"})
    return spark.read.parquet(path)


@query("sink_replace_versions", f"""
SELECT o_orderkey, o_totalprice, status_zapisa FROM ({BASE})
UNION ALL SELECT o_orderkey, o_totalprice, status_zapisa FROM ({EDITS}) WHERE status_zapisa = 3
UNION ALL SELECT o_orderkey, o_totalprice * 2, 2 FROM orders WHERE o_orderstatus = 'O'""")
def _(spark, d):
    path = _stored(spark, d, "replace")
    R.save_output_data(_edits(spark, d), path)
    # the new version 2 is computed from the very table it goes into
    new = R.read_output(spark, path).filter("status_zapisa = 1").join(
        table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey")
    new = new.withColumns({"o_totalprice": F.col("o_totalprice") * 2, "status_zapisa": F.lit(2)})
    R.save_output_data(new, path, delete_before_insert=True)
    return R.read_output(spark, path)


@query("csv_roundtrip", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    path = fresh_path(spark, "csv")
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    R.save_csv(df, path)
    return spark.read.schema(df.schema).csv(path, header=True)


@query("params_roundtrip", """
SELECT count(*) AS n, greatest(20, CAST(ceil(0.004::DOUBLE * count(*)) AS BIGINT)) AS rare_count,
  50::BIGINT AS smallest_leaf, max(o_totalprice) AS largest FROM orders""")
def _(spark, d):
    n, largest = table(spark, d, "orders").agg(F.count(F.lit(1)), F.max("o_totalprice")).first()
    folder = fresh_path(spark, "params")
    documents.save_best_params(spark, {
        "n": n, "rare_count": resolve_rare_threshold(n, 20, 0.004), "smallest_leaf": leaf_sizes(n)[0],
        "largest": largest}, folder)
    back = documents.load_best_params(spark, folder)
    return spark.createDataFrame([back], "n long, rare_count long, smallest_leaf long, largest double")
