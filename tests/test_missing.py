import pytest
from pyspark.sql import functions as F

from fillgauge.operators import missing as M

ID = ["id"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(1000).select(
        "id", F.col("id").cast("double").alias("pay"), (1000 - F.col("id")).cast("double").alias("rel"),
        F.when(F.col("id") < 400, F.lit("big")).when(F.col("id") < 980, (F.col("id") % 97).cast("string"))
        .alias("firm"), F.lit(1).alias("STATUS_ZAPISA")).repartition(4)


def hits(out, column="pay"):
    return {r["id"] for r in out.filter(F.col(column).isNull()).collect()}


def stamped(out, status):
    return {r["id"] for r in out.filter(F.col("STATUS_ZAPISA") == status).collect()}


@pytest.mark.parametrize("n,f,k,rule,want", [
    (100, 0.29, None, "floor", 28), (100, 0.291, None, "ceil", 30), (10, 0.25, None, "round", 2),
    (10, 0.35, None, "round", 4), (10, 2.0, None, "floor", 10), (10, None, 3, "floor", 3),
    (10, 0.5, 99, "floor", 10), (10, -1.0, None, "floor", 0)])
def test_rows_to_hit(n, f, k, rule, want):
    assert M.rows_to_hit(n, f, k, rule) == want


def test_rows_to_hit_needs_a_size():
    with pytest.raises(ValueError):
        M.rows_to_hit(10, None, None)
    with pytest.raises(ValueError):
        M.rows_to_hit(10, 0.1, None, "up")


def test_mcar(df):
    out = M.mcar_missing(df, ["pay", "rel"], 0.29, 7, id_cols=ID, random_state=3)
    a, b = hits(out), hits(out, "rel")
    assert len(a) == len(b) == 290 and a != b and stamped(out, 7) == a | b
    kept = out.filter("pay is not null")
    assert kept.filter("pay <> id").count() == 0 and out.count() == 1000
    again = M.mcar_missing(df.repartition(9), ["pay"], 0.29, 7, id_cols=ID, random_state=3)
    assert hits(again) == a
    assert hits(M.mcar_missing(df, "pay", 0.0, 7, id_cols=ID)) == set()
    assert len(hits(M.mcar_missing(df, "pay", 1.0, 7, id_cols=ID))) == 1000
    with pytest.raises(KeyError):
        M.mcar_missing(df, "other", 0.1, 7, id_cols=ID)


def test_mar_direction_and_size(df):
    up = M.mar_missing(df, "pay", "rel", 7, 0.2, id_cols=ID)
    down = M.mar_missing(df, "pay", "rel", 7, 0.2, type="min", id_cols=ID)
    assert len(hits(up)) == len(hits(down)) == 200 == len(stamped(up, 7))
    mean = lambda s: sum(1000 - i for i in s) / len(s)
    assert mean(hits(up)) > 550 and mean(hits(down)) < 450


def test_mar_special_cases(df):
    holes = df.withColumn("pay", F.when(F.col("id") >= 100, F.col("pay")))
    out = M.mar_missing(holes, "pay", "rel", 7, k=50, id_cols=ID)
    assert len(hits(out)) == 150 and len(stamped(out, 7)) == 50 and not stamped(out, 7) & set(range(100))
    nan = df.withColumn("rel", F.when(F.col("id") < 500, F.lit(float("nan"))).otherwise(F.col("rel")))
    assert min(hits(M.mar_missing(nan, "pay", "rel", 7, k=20, id_cols=ID))) >= 500
    same = M.mar_missing(df.withColumn("rel", F.lit(1)), "pay", "rel", 7, k=20, id_cols=ID)
    assert len(hits(same)) == 20
    # the row with the smallest value has weight 0 and cannot be drawn
    with pytest.raises(ValueError):
        M.mar_missing(df, "pay", "rel", 7, k=1000, id_cols=ID)
    assert M.mar_missing(df.filter("id < 0"), "pay", "rel", 7, 0.5, id_cols=ID).count() == 0
    for bad in ({"type": "up"}, {"rounding": "up"}):
        with pytest.raises(ValueError):
            M.mar_missing(df, "pay", "rel", 7, 0.5, id_cols=ID, **bad)


def test_mnar(df):
    up = M.mnar_missing(df, "pay", 0.2, 7, id_cols=ID)
    down = M.mnar_missing(df, "pay", 0.2, 7, type="min", beta=3.0, id_cols=ID)
    assert len(hits(up)) == len(hits(down)) == 200
    assert sum(hits(up)) / 200 > 540 and sum(hits(down)) / 200 < 400
    holes = df.withColumn("pay", F.when(F.col("id") >= 100, F.col("pay")))
    out = M.mnar_missing(holes, "pay", 0.2, 7, id_cols=ID)
    assert len(stamped(out, 7)) == 200 and not stamped(out, 7) & set(range(100))
    flat = M.mnar_missing(df.withColumn("pay", F.lit(3.0)), "pay", 0.1, 7, id_cols=ID)
    assert len(hits(flat)) == 100


def sizes(df):
    return {r["firm"]: r["count"] for r in df.groupBy("firm").count().collect()}


@pytest.mark.parametrize("k", [1, 40, 700, 980])
def test_companies(df, k):
    out, diag = M.mar_company_missing(df, "firm", "pay", 7, k=k, id_cols=ID, random_state=2)
    gone = sizes(out.filter("pay is null"))
    assert sum(gone.values()) == k and None not in gone and stamped(out, 7) == hits(out)
    full = sizes(df)
    assert sum(1 for f, n in gone.items() if n < full[f]) <= 1
    d = diag.first()
    assert d["actual_k"] == k and d["denominator"] == "eligible_non_na"
    assert d["actual_fraction"] == d["target_fraction"] == k / 1000


def test_companies_run_out(df):
    out, diag = M.mar_company_missing(df, "firm", "pay", 7, 1.0, id_cols=ID)
    assert diag.first()["actual_k"] == 980 and len(hits(out)) == 980
    out, diag = M.mar_company_missing(df.filter("firm is null"), "firm", "pay", 7, 0.5, id_cols=ID)
    assert diag.first()["actual_k"] == 0 and out.count() == 20


def test_company_mask_creates_the_version_column_and_splits_a_hot_company(df):
    bare = df.filter("firm = 'big'").drop("STATUS_ZAPISA")
    out, _ = M.mar_company_missing(bare, "firm", "pay", 7, 0.33, id_cols=ID)
    assert len(hits(out)) == 132 == len(stamped(out, 7))
    assert out.filter("STATUS_ZAPISA is null").count() == 268


def test_small_companies_come_first(df):
    def mean_size(alpha):
        got = 0.0
        for seed in range(6):
            out, _ = M.mar_company_missing(df, "firm", "pay", 7, k=150, alpha=alpha, id_cols=ID,
                                           random_state=seed)
            gone = sizes(out.filter("pay is null"))
            got += max(gone.values()) / 6
        return got
    assert mean_size(3.0) < mean_size(-3.0)


def test_masking_does_not_move_rows(df, orders):
    base = orders.withColumn("STATUS_ZAPISA", F.lit(1))
    out = M.mcar_missing(base, "o_totalprice", 0.1, 2, id_cols=["o_orderkey"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    out = M.mnar_missing(base, "o_totalprice", 0.1, 2, id_cols=["o_orderkey"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
