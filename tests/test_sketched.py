"""Ranks bracketed by sketches, proved by counts."""

import random

import pytest
from pyspark.sql import functions as F

from fillgauge.operators import rankcuts as K


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [("g", rng.gauss(0, 1)) for _ in range(4000)] + [("ties", float(rng.randrange(5))) for _ in range(3000)]
    rows += [(None, rng.expovariate(1e-6) * 10 ** rng.randrange(-9, 9)) for _ in range(2000)] + [("one", 3.0), ("one", None)]
    return spark.createDataFrame(rows, "k string, x double").repartition(5).cache()


def wanted(n):
    return F.array(F.lit(1), F.floor(n / 3), n, n + 1, F.lit(0), F.floor(n * 0.99))


def brute(values):
    groups = {}
    for r in values.collect():
        if r["x"] is not None:
            groups.setdefault(r["k"], []).append(r["x"])
    out = set()
    for k, xs in groups.items():
        xs.sort()
        n = len(xs)
        for r in {1, n // 3, n, int(n * 0.99)} - {0}:
            cut = xs[r - 1]
            out.add((k, n, r, cut, sum(x < cut for x in xs), xs.count(cut)))
    return out


def found(values, **options):
    x = F.col("x")
    rows = K.sketched_cuts(values, ["k"], x, x, K.value_levels, wanted, **options).collect()
    return {(r["k"], r["n"], r["rank"], r["cut"], r["before"], r["size"]) for r in rows}


def test_two_passes_give_exact_ranks(values):
    assert found(values) == brute(values)


def test_brackets_too_large_for_a_task(values):
    assert found(values, max_bucket_rows=10) == brute(values)


def test_too_many_strata(values, monkeypatch):
    monkeypatch.setattr(K, "FEW_BRACKETS", 3)
    assert found(values) == brute(values)


def test_a_wrong_sketch_costs_only_time(values, monkeypatch):
    """Brackets that miss some ranks, or all."""
    right = K._brackets

    def wrong(*args):
        return right(*args).withColumns({"lo": F.when(F.col("rank") > 1, F.col("lo") + 2.5).otherwise(F.col("lo")),
                                         "hi": F.when(F.col("rank") > 1, F.col("hi") + 2.5).otherwise(F.col("hi"))})

    monkeypatch.setattr(K, "_brackets", wrong)
    assert found(values) == brute(values)
    monkeypatch.setattr(K, "_brackets", lambda *args: right(*args).withColumn("hi", F.lit(-1e300)))
    assert found(values, max_bucket_rows=10) == brute(values)


def test_no_strata_and_no_rows(values):
    x = F.col("x")
    xs = sorted(r["x"] for r in values.collect() if r["x"] is not None)
    row = K.sketched_cuts(values, [], x, x, K.value_levels, lambda n: F.array(F.lit(777))).collect()
    assert [(r["n"], r["cut"]) for r in row] == [(len(xs), xs[776])]
    assert K.sketched_cuts(values.limit(0), [], x, x, K.value_levels, lambda n: F.array(F.lit(1))).count() == 0

