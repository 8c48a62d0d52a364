"""Grouped order statistics against numpy, on both the one-task and the split path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillgauge.operators import cumulative as C
from fillgauge.operators import rankcuts as K
from fillgauge.operators import robust


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    groups = rng.choice(["hot", "b", None, "c"], size=3000, p=[0.7, 0.1, 0.1, 0.1])
    values = np.where(rng.random(3000) < 0.34, 100.0, np.round(rng.lognormal(3, 1, 3000), 1))
    return [(g, float(v), None if i % 50 == 0 else float(v + i % 7)) for i, (g, v) in
            enumerate(zip(groups, values))] + [("empty", None, None)]


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "g string, x double, y double").repartition(5)


def split(data, g, i=1):
    return np.array([r[i] for r in data if r[0] == g and r[i] is not None])


@pytest.mark.parametrize("limit", [None, 40])
@pytest.mark.parametrize("interpolation", ["linear", "lower", "higher", "midpoint"])
def test_percentiles(df, data, monkeypatch, limit, interpolation):
    monkeypatch.setattr(K, "MAX_BUCKET_ROWS", limit or K.MAX_BUCKET_ROWS)
    ps = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.77, "e": 1.0}
    got = C.percentiles(df, ["g"], "x", ps, max_group_rows=limit, interpolation=interpolation).collect()
    assert {r["g"] for r in got} == {"hot", "b", None, "c"}
    for r in got:
        want = np.percentile(split(data, r["g"]), [100 * p for p in ps.values()], method=interpolation)
        assert np.allclose([r[n] for n in ps], want)


@pytest.mark.parametrize("limit", [None, 40])
def test_running_counts(df, data, limit):
    run = C.running_counts(C.distribution(df, ["g"], "x"), ["g"], max_group_rows=limit).collect()
    for r in run:
        v = split(data, r["g"])
        assert r["cum_cnt"] == (v <= r["value"]).sum() and r["tot_cnt"] == len(v)
        assert r["cnt"] == (v == r["value"]).sum()
    assert len(run) == sum(len(set(split(data, g))) for g in ("hot", "b", None, "c"))


def test_percentile_of_whole_table_and_of_nothing(df, data):
    v = np.array([r[1] for r in data if r[1] is not None])
    assert C.percentiles(df, [], "x", {"m": 0.5}).first()["m"] == np.median(v)
    assert C.percentiles(df.filter("x < 0"), [], "x", {"m": 0.5}).first() is None


def test_modes(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 2), ("a", 2), ("b", 3), ("b", None), (None, 9), ("c", None), ("d", 5), ("d", 4)],
        "g string, v int")
    got = {r["g"]: r["m"] for r in C.modes(df, ["g"], "v", "m").collect()}
    assert got == {"a": 2, "b": 3, None: 9, "d": 4}


def test_robust_statistics(df, data):
    mads = {r["g"]: r["mad"] for r in robust.mad(df, ["g"], "x").collect()}
    iqrs = {r["g"]: r["iqr"] for r in robust.iqr(df, ["g"], "x").collect()}
    spans = {r["g"]: r["p95p5"] for r in robust.p95_p5(df, ["g"], "x").collect()}
    for g in ("hot", "b", None, "c"):
        v = split(data, g)
        assert np.isclose(mads[g], np.median(np.abs(v - np.median(v))))
        assert np.isclose(iqrs[g], np.subtract(*np.percentile(v, [75, 25])))
        assert np.isclose(spans[g], np.subtract(*np.percentile(v, [95, 5])))
    whole = robust.winsorize(df, [], "x").agg(F.min("winsorized"), F.max("winsorized")).first()
    v = np.array([r[1] for r in data if r[1] is not None])
    assert np.allclose(list(whole), np.percentile(v, [5, 95]))


def walk(x, y):
    """The distance as found by stepping through both sorted samples, first sample first on ties."""
    events = sorted([(v, 0) for v in x] + [(v, 1) for v in y])
    i = j = 0
    worst = 0.0
    for _v, which in events:
        i, j = i + (which == 0), j + (which == 1)
        worst = max(worst, abs(i / len(x) - j / len(y)))
    return worst


@pytest.mark.parametrize("limit", [None, 60, 3])
def test_ks_sequential_ties(df, data, limit):
    for r in robust.ks_two_sample(df, ["g"], "x", "y", max_group_rows=limit).collect():
        if r["g"] == "empty":
            continue
        x, y = split(data, r["g"], 1), split(data, r["g"], 2)
        assert (r["n_true"], r["n_imp"]) == (len(x), len(y))
        # one sample of a tie after the other: only the ends of the runs can be extreme
        assert np.isclose(r["ks_stat"], walk(x, y))
        assert 0 <= r["ks_p"] <= 1


@pytest.mark.parametrize("x,y,seq,std", [
    ([1, 1, 1], [1, 1, 1], 1.0, 0.0), ([1, 2], [3, 4], 1.0, 1.0), ([1, 2, 2, 3], [2, 2, 3, 3], 0.75, 0.25)])
@pytest.mark.parametrize("limit", [None, 1])
def test_ks_small(spark, x, y, seq, std, limit):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    for ties, want in (("sequential", seq), ("standard", std)):
        got = robust.ks_two_sample(df, [], "x", "y", ties=ties, max_group_rows=limit).first()
        assert np.isclose(got["ks_stat"], want)


def test_mixed_group_sizes(df, data, monkeypatch):
    """Large groups by histogram, small ones in one task, in one result."""
    monkeypatch.setattr(C, "MANY_GROUPS", 2)
    for r in C.percentiles(df, ["g"], "x", {"m": 0.5, "h": 0.9}, max_group_rows=500).collect():
        assert np.allclose([r["m"], r["h"]], np.percentile(split(data, r["g"]), [50, 90]))


def test_value_buckets_keep_the_order(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 300), rng.normal(0, 1e-300, 50), 1e9 + rng.normal(0, 1, 300),
                        [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324], -rng.lognormal(20, 9, 100)])
    df = spark.createDataFrame([(float(x),) for x in v], "x double").orderBy("x")
    for level in K.value_levels(F.col("x")):
        b = [r[0] for r in df.select(level).collect()]
        assert b == sorted(b)


def test_ks_pvalue(spark):
    def series(d, n1, n2):
        en = np.sqrt(n1 * n2 / (n1 + n2))
        lam = (en + 0.12 + 0.11 / en) * d
        k = np.arange(1, 101)
        return min(1.0, max(0.0, float(np.sum(2 * (-1.0) ** (k - 1) * np.exp(-2 * k**2 * lam**2)))))

    rows = [(0.0, 5, 7), (0.1, 100, 80), (0.3, 40, 40), (1.0, 3, 3), (0.02, 1000, 1000)]
    df = spark.createDataFrame(rows, "d double, a long, b long")
    got = [r[0] for r in df.select(robust.ks_pvalue(F.col("d"), F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got, [series(*r) for r in rows])
