import math

import pytest
from pyspark.sql import functions as F

from fillgauge.functions import values as V


def test_round_half_up(spark):
    rows = [(1, 2.675), (2, 1.005), (3, -2.675), (4, 0.125), (5, None), (6, float("inf")), (7, float("nan"))]
    df = V.round_half_up(V.nulls_for_nans(spark.createDataFrame(rows, "i int, x double")), 2)
    got = {r["i"]: r["x"] for r in df.collect()}
    assert got == {1: 2.68, 2: 1.01, 3: -2.68, 4: 0.13, 5: None, 6: math.inf, 7: None}


def test_padded_id(spark):
    df = spark.createDataFrame([(42,), (1234567890,), (None,)], "i long")
    got = [r[0] for r in df.select(V.padded_id(F.col("i"))).collect()]
    assert got == ["000000042", "1234567890", None]


def test_parse_rate(spark):
    df = spark.createDataFrame([("10%",), ("0,1",), ("x",), (None,), ("7",)], "s string")
    assert [r[0] for r in df.select(V.parse_rate(F.col("s"))).collect()] == [10.0, 0.1, None, None, 7.0]


def test_columns_are_found_in_any_case(spark):
    df = spark.createDataFrame([(1,)], "Status_Zapisa int")
    assert V.resolve_column(df, "STATUS_ZAPISA") == "Status_Zapisa"
    with pytest.raises(KeyError, match="available"):
        V.resolve_column(df, "other")
    with pytest.raises(KeyError):
        V.require_columns(df, ["a"])
