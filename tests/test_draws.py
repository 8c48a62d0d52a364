"""Draws, strata and folds against a plain sort of the same random keys."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fillgauge.functions.values import md5_key
from fillgauge.operators import rankcuts as K
from fillgauge.operators import sampling as S

N = 2000


def key(i, *salt):
    return hashlib.md5("|".join(f"{len(str(x))}:{x}" for x in (i, *salt)).encode()).hexdigest()


def uniform(text):
    return (int(text[:13], 16) + 0.5) / 2**52


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(N).withColumns({
        "g": F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(
            (F.col("id") % 7).cast("string")),
        "w": (F.col("id") % 13).cast("double")}).repartition(6)


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


@pytest.mark.parametrize("limit", [1, 10, 10**6])
@pytest.mark.parametrize("k", [1, 37, N - 1, N])
def test_uniform_draw(df, monkeypatch, limit, k):
    monkeypatch.setattr(K, "MAX_BUCKET_ROWS", limit)
    want = set(sorted(range(N), key=lambda i: key(i, "sample", 5))[:k])
    assert ids(S.sample_exact(df, ["id"], k, 5)) == want


@pytest.mark.parametrize("limit", [1, 10**6])
def test_weighted_draw(df, monkeypatch, limit):
    monkeypatch.setattr(K, "MAX_BUCKET_ROWS", limit)
    wait = {i: -math.log(uniform(key(i, "sample", 9))) / (i % 13) for i in range(N) if i % 13}
    want = set(sorted(wait, key=wait.get)[:150])
    assert ids(S.sample_weighted(df, ["id"], F.col("w"), 150, 9)) == want
    assert not any(i % 13 == 0 for i in want)


def test_draws_do_not_depend_on_partitioning(df):
    a = ids(S.sample_exact(df.repartition(1), ["id"], 100, 1))
    assert a == ids(S.sample_exact(df.repartition(13, "w"), ["id"], 100, 1))
    assert a != ids(S.sample_exact(df, ["id"], 100, 2))


def test_draw_of_nothing_and_of_too_much(df):
    assert ids(S.sample_exact(df, ["id"], 0, 1)) == set()
    with pytest.raises(ValueError):
        S.sample_exact(df, ["id"], N + 1, 1)
    with pytest.raises(ValueError):
        S.sample_weighted(df, ["id"], F.when(F.col("id") < 5, 1.0), 6, 1)


def test_weighted_draws_favour_large_weights(df):
    drawn = S.sample_weighted(df, ["id"], F.col("w"), 500, 3)
    assert drawn.agg(F.avg("w")).first()[0] > df.agg(F.avg("w")).first()[0] + 0.5


@pytest.mark.parametrize("limit", [5, 10**6])
def test_weighted_rank(df, limit):
    text = md5_key(["id"], "r")
    got = K.rank_cuts(df, [], text, K.md5_levels(text), lambda n: F.array(F.lit(500), F.lit(4000)),
                      weight=F.col("w"), max_bucket_rows=limit).collect()
    order = sorted(range(N), key=lambda i: key(i, "r"))
    for r in got:
        total = 0
        for i in order:
            if total + i % 13 >= r["rank"]:
                break
            total += i % 13
        assert (r["cut"], r["before"], r["size"]) == (key(i, "r"), total, i % 13)
    assert len(got) == 2


def groups(df):
    out = {}
    for r in df.select("id", "g").collect():
        out.setdefault(r["g"], []).append(r["id"])
    return out


def test_sample_per_group(df):
    drawn = groups(S.sample_per_group(df, ["g"], ["id"], 20, 4))
    for g, members in groups(df).items():
        assert set(drawn[g]) == set(sorted(members, key=lambda i: key(i, "group", 4))[:20])


@pytest.mark.parametrize("limit", [3, 10**6])
def test_stratified_subsample(df, monkeypatch, limit):
    monkeypatch.setattr(K, "MAX_BUCKET_ROWS", limit)
    drawn = groups(S.subsample_stratified(df, "g", ["id"], 300, 4))
    for g, members in groups(df).items():
        quota = max(1, int(len(members) * 300 / N))
        assert set(drawn[g]) == set(sorted(members, key=lambda i: key(i, "stratum", 4))[:quota])
    assert S.subsample_stratified(df, "g", ["id"], N, 4).count() == N


def test_kfold_sizes(df):
    sizes = Counter(r["fold"] for r in S.kfold(df, ["id"], 7, 1).collect())
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    few = Counter(r["fold"] for r in S.kfold(df.filter("id < 3"), ["id"], 5, 1).collect())
    assert sum(few.values()) == 3 and max(few.values()) == 1


def test_stratified_fold_sizes(df):
    rows = S.stratified_folds(df.filter("id < 1500 or id = 1501"), "g", ["id"], 4, 1)
    sizes = Counter((r["g"], r["fold"]) for r in rows.collect())
    for g in {g for g, _ in sizes}:
        per = [sizes[(g, f)] for f in range(4)]
        assert max(per) - min(per) <= 1
    lone = S.stratified_folds(df.filter("id = 1"), "g", ["id"], 4, 1).first()["fold"]
    assert lone in range(4)


def test_draws_do_not_move_rows(df):
    text = md5_key(["id"], "x")
    plan = df.withColumn("hit", K.smallest(df, text, K.md5_levels(text), 50)).filter("hit")
    tail = plan._jdf.queryExecution().executedPlan().toString()
    assert tail.count("Exchange") == 1  # the repartition of the fixture
