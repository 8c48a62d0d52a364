"""Derived variables, aggregates, categories, target transforms, records, figure tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fillgauge.operators import categories as C
from fillgauge.operators import derive as D
from fillgauge.operators import target as T
from fillgauge.operators.aggregate import aggregate_variable, value_counts
from fillgauge.plans import distributions as X
from fillgauge.plans import reports as P
from fillgauge.session import fresh_path, settle
from fillgauge.sources import documents, records as R


# ---------------------------------------------------------------- derive

@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [("a", 1, 2.0), ("a", 2, None), ("b", 3, 4.0), (None, 4, 8.0)], "g string, i int, x double")


def col(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_derive(small):
    assert col(D.derive_variable(small, "n", "x * 2 + i"), "n") == [5.0, None, 11.0, 20.0]
    assert col(D.derive_variable(small, "x", "x + 1", condition="g=a"), "x") == [3.0, None, None, None]
    assert col(D.derive_variable(small, "c", "concat(g, i)", "character", length=1), "c") == ["a", "a", "b", None]
    assert col(D.derive_variable(small, "c", "i", "character", condition="i >= 2"), "c") == [None, "2", "3", "4"]
    assert col(D.derive_variable(small, "c", "i", condition=F.col("x") > 3), "c") == [None, None, 3.0, 4.0]
    with pytest.raises(ValueError):
        D.derive_variable(small, "c", "i", "date")


def test_retype(small):
    out, types = D.transform_var(small, {"g": ("ordinal", {"a": 1, "b": 2}), "i": ("nominal", "string")})
    assert col(out, "g") == [1, 1, 2, None] and col(out, "i") == ["1", "2", "3", "4"]
    assert {tuple(r) for r in types.collect()} == {("g", "ordinal"), ("i", "nominal")}
    big = {f"v{i}": i for i in range(300)} | {"a": -1}
    assert col(D.transform_var(small, {"g": ("ordinal", big)})[0], "g") == [-1, -1, None, None]
    for bad in ({"q": ("nominal", None)}, {"g": ("nominal", 5)}):
        with pytest.raises(ValueError):
            D.transform_var(small, bad)


def test_text_becomes_numeric_only_as_a_whole(spark):
    df = spark.createDataFrame([(1, "1", "1"), (2, "2", "x"), (3, None, None)], "i int, a string, b string")
    out, _ = D.transform_var(df, {"a": ("ordinal", None), "b": ("ordinal", None)})
    assert dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["b"] == "string"
    assert col(out, "a") == [1.0, 2.0, None]


def test_inferred_types(spark):
    _, types = D.transform_var(spark.createDataFrame([(1, True, "s", 1.5)], "a int, b boolean, c string, d double"))
    assert {r["variable"]: r["var_type"] for r in types.collect()} == {
        "a": "numerical", "b": "numerical", "c": "nominal", "d": "numerical"}


def test_profile(small):
    got = {r["variable"]: r for r in D.profile_columns(small).collect()}
    assert got["g"]["n_distinct"] == 2 and got["g"]["ratio"] == 0.5 and not got["g"]["is_low_cardinality"]
    assert D.profile_columns(small, exact=False).count() == 3


def test_distinct_counts_in_one_shuffle(spark, monkeypatch):
    rows = [(i % 7, None if i % 3 else f"t{i % 50}", [0.0, -0.0, float("nan"), 1.5, None][i % 5], i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d long").repartition(4)
    want = list(df.agg(*[F.count_distinct(c) for c in df.columns]).first())
    assert D.distinct_counts(df) == want == [7, 50, 3, 500]
    assert D.distinct_counts(df.limit(0)) == [0, 0, 0, 0]
    # hashes that meet: the values decide
    whole = D._hashes
    monkeypatch.setattr(D, "_hashes", lambda df, name: (F.pmod(whole(df, name)[0], F.lit(3)), whole(df, name)[1]))
    assert D.distinct_counts(df) == want


# ---------------------------------------------------------------- aggregate

@pytest.mark.parametrize("op,want", [
    ("sum", [2.0, 2.0, 4.0, None]), ("mean", [2.0, 2.0, 4.0, None]), ("count", [1, 1, 1, None]),
    ("size", [2, 2, 1, None]), ("std", [None] * 4), ("nunique", [1, 1, 1, None]),
    ("median", [2.0, 2.0, 4.0, None]), ("mode", [2.0, 2.0, 4.0, None]), ("prod", [2.0, 2.0, 4.0, None]),
    ("any", [True, True, True, None]), ("skew", [None] * 4)])
def test_group_aggregates(small, op, want):
    assert col(aggregate_variable(small, "v", "g", "x", op), "v") == want


def test_missing_groups_and_values(spark):
    df = spark.createDataFrame([("c", 1, None), ("d", 2, 1.0), ("d", 3, 3.0)], "g string, i int, x double")
    assert col(aggregate_variable(df, "v", "g", "x", "sum"), "v") == [0.0, 4.0, 4.0]
    assert col(aggregate_variable(df, "v", "g", "x", "sum", min_count=1), "v") == [None, 4.0, 4.0]
    for op in ("median", "mode", "mean", "min"):
        assert col(aggregate_variable(df, "v", "g", "x", op), "v")[0] is None
    assert col(aggregate_variable(df, "v", "g", "x", "std", ddof=0), "v") == [None, 1.0, 1.0]
    assert col(aggregate_variable(df, "v", "g", "x", "all"), "v") == [True, True, True]
    assert col(aggregate_variable(df, "v", "g", "x", "sum", condition="x > 1"), "v") == [None, 3.0, 3.0]
    assert col(aggregate_variable(df, "x", ["g", "i"], "x", "max"), "x") == [None, 1.0, 3.0]
    assert col(aggregate_variable(df, "v", "g", "x", "percentile", percentile_value=0.5,
                                  interpolation="lower"), "v") == [None, 1.0, 1.0]
    assert col(aggregate_variable(df, "v", None, "x", "nunique", dropna=False), "v") == [3, 3, 3]
    assert col(aggregate_variable(df, "v", None, "x", "last", order_by=["i"]), "v") == [3.0] * 3
    assert col(aggregate_variable(df, "v", None, "x", "mean", condition="x > 9"), "v") == [None] * 3
    assert col(aggregate_variable(df, "v", None, "x", "median", condition="x > 9"), "v") == [None] * 3
    assert col(aggregate_variable(df, "v", None, None, "count"), "v") == [3] * 3
    for bad in ({"rule": None, "operation": "nunique"}, {"rule": "x", "operation": "first"},
                {"rule": "x", "operation": "nonsense"}):
        with pytest.raises(ValueError):
            aggregate_variable(df, "v", "g", **bad)


def test_skew(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 2, 9])] + [(9, None)], "i int, x double")
    x = np.array([1, 2, 2, 9.0])
    g1 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert np.isclose(col(aggregate_variable(df, "v", None, "x", "skew"), "v")[0], math.sqrt(12) / 2 * g1)
    flat = df.withColumn("x", F.lit(2.0))
    assert col(aggregate_variable(flat, "v", None, "x", "skew"), "v")[0] == 0.0


def test_value_counts(small):
    assert {tuple(r) for r in value_counts(small, "g").collect()} == {("a", 2), ("b", 1)}


# ---------------------------------------------------------------- categories

def test_rare_threshold():
    assert C.resolve_rare_threshold(1000, 20, 0.05) == 50
    assert C.resolve_rare_threshold(1000, 20, 0.001) == 20
    assert C.resolve_rare_threshold(1001, None, 0.01) == 11
    assert C.resolve_rare_threshold(1000) == 0 == C.resolve_rare_threshold(1000, 0, 0.0)
    with pytest.raises(ValueError):
        C.resolve_rare_threshold(1000, 0.5)


def test_many_columns_need_no_join(spark, monkeypatch):
    rows = [tuple(None if (i * k) % 11 == 3 else f"v{(i * k) % (5 + k)}" for k in range(1, 31)) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(30))).repartition(3)
    rare = settle(C.fit_rare_map(df.limit(200), df.columns, 9))
    valid = C.apply_rare_map_valid(df, rare, df.columns, settled=True)
    above_input = valid._jdf.queryExecution().executedPlan().toString().split("RoundRobinPartitioning")[0]
    assert "Join" not in above_input and above_input.count("Exchange") <= 1
    sets = sorted(map(tuple, valid.collect()), key=str), sorted(map(tuple, C.collapse_rare(df, df.columns, 9).collect()), key=str)
    monkeypatch.setattr(C, "SET_ROWS", 0)
    joined = C.apply_rare_map_valid(df.select("c0", "c4"), rare, ["c0", "c4"], settled=True)
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, joined.collect()), key=str) == sorted([(r[0], r[4]) for r in sets[0]], key=str)


def test_rare_maps(spark):
    train = spark.createDataFrame([(v,) for v in "a" * 5 + "b" * 2 + "c"] + [(None,)], "v string")
    rare = C.fit_rare_map(train, ["v"], 3)
    assert {(r["value"], r["n"], r["is_rare"]) for r in rare.collect()} == {
        ("a", 5, False), ("b", 2, True), ("c", 1, True), (None, 1, True)}
    count = lambda df: {r["v"]: r["count"] for r in df.groupBy("v").count().collect()}
    assert count(C.apply_rare_map_train(train, rare, ["v"])) == {"a": 5, C.RARE: 4}
    valid = spark.createDataFrame([("a",), ("b",), ("z",), (C.RARE,)], "v string")
    assert count(C.apply_rare_map_valid(valid, rare, ["v"])) == {"a": 1, C.RARE: 2, C.UNSEEN: 1}
    assert count(C.apply_rare_map_valid(valid, rare, ["v"], strict_reference=True)) == {"a": 1, C.RARE: 1, C.UNSEEN: 2}
    assert count(C.apply_rare_map_valid(valid, rare, ["v"], use_unseen=False)) == {"a": 1, C.RARE: 3}
    out = C.collapse_rare(train, ["v"], 3)
    assert count(out) == {"a": 5, C.OTHER: 3, None: 1}
    zed = out.unionByName(spark.createDataFrame([("z",)], "v string"))
    assert [r[0] for r in C.category_order(zed, "v").collect()] == ["a", "z", C.OTHER]
    assert C.collapse_rare(train, ["v"], 0) is train
    with pytest.raises(ValueError):
        C.categorical_columns(train, ["v"], ["w"])


# ---------------------------------------------------------------- target

def test_transform_and_inverse(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (100.0,)], "y double")
    for spec in ({"method": "log", "eps": 0.5}, {"method": "log1p"}, None):
        out, info = T.transform_target(df, "y", spec)
        back = out.select("y", T.inverse_target(F.col("z"), info).alias("b")).collect()
        assert all(math.isclose(r["y"], r["b"], abs_tol=1e-9) for r in back)
        assert out.agg(T.smearing_factor(F.col("z"), F.col("z"))).first()[0] == 1.0
    low = spark.createDataFrame([(-1.0,)], "y double")
    for bad in ({"method": "log"}, {"method": "log1p"}, {"method": "sqrt"}):
        with pytest.raises(ValueError):
            T.transform_target(low, "y", bad)


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 1, 2, 3, 4, 5, 6, 9)], "y double")
    got = [r["bin"] for r in T.bin_target(df, "y", "quantiles", 4).orderBy("y").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2]
    flat = spark.createDataFrame([(2.0,), (2.0,), (None,)], "y double")
    assert {r["bin"] for r in T.bin_target(flat, "y").collect()} == {0, None}
    with pytest.raises(ValueError):
        T.bin_target(df, "y", "other")


# ---------------------------------------------------------------- records

@pytest.fixture(scope="module")
def base_and_edits(spark):
    s = "id long, STATUS_ZAPISA int, x double, stamp int"
    base = spark.createDataFrame([(1, 1, 1.005, 0), (2, 1, 2.0, 0), (4, 5, 9.0, 0)], s)
    edits = spark.createDataFrame([(1, 2, 1.2, 0), (1, 3, 1.3, 1), (1, 3, 1.4, 2), (3, 2, 3.2, 0)], s)
    return base, edits


def test_latest_version(base_and_edits):
    base, edits = base_and_edits
    opts = {"id_col": "id", "tie_cols": ["stamp"], "status_col": "status_zapisa"}
    got = {r["id"]: r for r in R.load_input_data(base, edits, 3, **opts).collect()}
    assert {i: r["x"] for i, r in got.items()} == {1: 1.4, 2: 2.0, 4: 9.0}
    assert got[1]["ident"] == "000000001" and got[1]["rn"] == 1
    got = R.load_input_data(base, edits, 2, base_status=1, **opts).collect()
    assert {r["id"]: r["x"] for r in got} == {1: 1.2, 2: 2.0, 3: 3.2}
    plan = R.load_input_data(base, edits, 2, **opts)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_several_versions(base_and_edits):
    base, edits = base_and_edits
    opts = {"id_col": "id", "tie_cols": ["stamp"], "status_col": "status_zapisa"}
    out = R.load_versions(base, edits, [3, 2, 7], **opts)
    frames = R.versions_as_dict(out, [2, 3, 7])
    assert {s: {r["id"]: r["x"] for r in f.collect()} for s, f in frames.items()} == {
        2: {1: 1.2, 2: 2.0, 3: 3.2}, 3: {1: 1.4, 2: 2.0}, 7: {1: 1.01, 2: 2.0}}
    # the same as one load per version
    for s in (2, 3, 7):
        single = R.load_input_data(base, edits, s, base_status=1, **opts)
        assert single.select(frames[s].columns).exceptAll(frames[s]).isEmpty()
    top = R.load_versions(base, edits, [2, 7], keep_only_max_status=True, **opts)
    assert {(r["requested_status"], r["id"]) for r in top.collect()} == {(2, 1), (2, 3), (7, 1), (7, 2)}


def test_largest_version_is_numeric(spark):
    df = spark.createDataFrame([("7", 1), ("41", 2), ("x", 3), (None, 4)], "Status_Zapisa string, i int")
    assert [r["i"] for r in R.keep_max_status(df).collect()] == [2]


def test_saving_versions(spark, base_and_edits):
    base, edits = base_and_edits
    path = fresh_path(spark, "t")
    base.drop("stamp").write.partitionBy("STATUS_ZAPISA").parquet(path)
    R.save_output_data(edits, path)
    read = lambda: sorted((r["STATUS_ZAPISA"], r["id"], r["x"]) for r in R.read_output(spark, path).collect())
    before = read()
    assert len(before) == 7 and spark.read.parquet(path).columns == ["id", "x", "STATUS_ZAPISA"]
    new = spark.createDataFrame([(8, 3, 8.0)], "id long, STATUS_ZAPISA int, x double")
    R.save_output_data(new, path, delete_before_insert=True)
    assert read() == sorted([r for r in before if r[0] != 3] + [(3, 8, 8.0)])
    with pytest.raises(ValueError):
        R.save_output_data(new.drop("STATUS_ZAPISA"), path)
    with pytest.raises(ValueError):
        R.save_output_data(new.withColumn("STATUS_ZAPISA", F.lit(None).cast("int")), path, delete_before_insert=True)
    assert R.align_to_target(new, base, {"x": "string"}).dtypes == [
        ("id", "bigint"), ("STATUS_ZAPISA", "int"), ("x", "string")]


def test_stored_tables(spark, base_and_edits):
    folder = fresh_path(spark, "db")
    base_and_edits[0].write.parquet(f"{folder}/pay")
    base_and_edits[1].write.parquet(f"{folder}/pay_edi")
    base, edits = R.read_tables(spark, folder, "pay")
    out = R.load_input_data(base, edits, 3, id_col="id", status_col="status_zapisa", tie_cols=["stamp"],
                            parquet_path=f"{folder}/copy")
    assert out.count() == 3 and spark.read.parquet(f"{folder}/copy").count() == 3


def test_documents(spark):
    folder = fresh_path(spark, "docs")
    with pytest.raises(FileNotFoundError):
        documents.load_best_params(spark, folder)
    documents.write_json(spark, {"a": 1, "b": [1.5, "č"]}, documents.params_path(folder, "GBM"))
    documents.write_json(spark, {"a": 2, "b": [1.5, "č"]}, documents.params_path(folder, "GBM"))
    assert documents.load_best_params(spark, folder) == {"a": 2, "b": [1.5, "č"]}


# ---------------------------------------------------------------- figures

@pytest.fixture(scope="module")
def figure(spark):
    rng = np.random.default_rng(2)
    y, p = np.round(rng.lognormal(2, 1, 500), 1), np.round(rng.lognormal(2.1, 0.8, 500), 1)
    p[:170] = 7.0
    rows = [(i, "v", "MCAR", "m", "5%", float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    df = spark.createDataFrame(rows, "id int, variable string, MissMech string, Method string, MissRate string, "
                                     "y_true double, y_pred double")
    return y, p, df


def test_histogram(figure):
    y, p, df = figure
    both = np.concatenate([y, p])
    lo, hi = np.quantile(both, [0.0, 0.99])
    kept = both[(both >= lo) & (both <= hi)]
    iqr = np.subtract(*np.percentile(kept, [75, 25]))
    bins = int(np.clip(np.ceil((kept.max() - kept.min()) / (2 * iqr * len(kept) ** (-1 / 3))), 10, 200))
    out = X.hist_table(df).orderBy("series", "bin").collect()
    for name, a in (("true", y), ("imp", p)):
        counts, edges = np.histogram(a[(a >= lo) & (a <= hi)], bins=bins)
        got = [r for r in out if r["series"] == name]
        assert [r["n"] for r in got] == counts.tolist()
        assert np.allclose([r["left"] for r in got], edges[:-1])
        assert np.isclose(sum(r["height"] * (r["right"] - r["left"]) for r in got), 1.0)
    fixed = X.hist_table(df, bins=7, x_clip=None, density=False).filter("series = 'true'").orderBy("bin").collect()
    assert [r["height"] for r in fixed] == np.histogram(y, bins=7)[0].tolist()
    flat = X.hist_table(df.withColumn("y_pred", F.lit(3.0)), bins=4, x_clip=None).filter("series = 'imp'")
    assert flat.filter("n > 0").first()["n"] == 500


def test_bin_count_rules(spark):
    rows = [(1, 0.0, 0.0, 0.0, 10), (100, 0.0, 0.0, 5.0, 10), (100, 1.0, 0.0, 1e9, 200), (100, 9.0, 0.0, 9.0, 10)]
    df = spark.createDataFrame(rows, "n long, iqr double, lo double, hi double, want int")
    got = df.select(X.fd_bin_count(F.col("n"), F.col("iqr"), F.col("lo"), F.col("hi")).alias("b"), "want")
    assert all(r["b"] == r["want"] for r in got.collect())


def test_ecdf_qq_box(figure):
    y, p, df = figure
    for r in X.ecdf_table(df).collect():
        a = y if r["series"] == "true" else p
        assert np.isclose(r["F"], (a <= r["x"]).mean())
    for points in (101, 5):
        qq = X.qq_table(df, q_points=points).orderBy("point").collect()
        qs = np.linspace(0.01, 0.99, points)
        assert [r["point"] for r in qq] == list(range(points))
        assert np.allclose([r["q_true"] for r in qq], np.quantile(y, qs))
        assert np.allclose([r["q_imp"] for r in qq], np.quantile(p, qs))
    one = X.qq_table(df.limit(1)).collect()
    assert len(one) == 101 and len({r["q_true"] for r in one}) == 1
    for r in X.box_table(df).collect():
        a = y if r["series"] == "true" else p
        q1, q3 = np.percentile(a, [25, 75])
        inside = a[(a >= q1 - 1.5 * (q3 - q1)) & (a <= q3 + 1.5 * (q3 - q1))]
        assert np.allclose([r["q1"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"], r["n"]],
                           [q1, q3, min(inside.min(), q1), max(inside.max(), q3), len(a) - len(inside), len(a)])


def test_selected_rows(figure):
    df = figure[2]
    assert X.selected_rows(df, sample_n=20, id_cols=["id"]).count() == 20
    assert X.selected_rows(df, sample_n=900, id_cols=["id"]).count() == 500
    assert X.selected_rows(df, variables=["w"]).count() == 0


def test_reports(spark):
    df = spark.createDataFrame([("v", "MCAR", "a", "10%", 0.05), ("v", "MCAR", "a", "5%", 0.15),
                                ("v", "MAR", "b", "0,5", -0.3), ("w", "MAR", "b", "5%", None)],
                               "variable string, MissMech string, Method string, MissRate string, smd double")
    lines = [(r["rate"], r["rate_label"], r["value"]) for r in
             P.metric_lines(df, "smd", variables="v", mechs=["MCAR"]).collect()]
    assert lines == [(5.0, "5%", 0.15), (10.0, "10%", 0.05)]
    bars = {(r["group"], r["hue"], r["variable"]): (r["value"], r["band"]) for r in P.grouped_bars(df, "smd").collect()}
    assert bars["a", "10%", "v"] == (0.05, "small") and bars["a", "5%", "v"] == (0.15, "medium")
    assert bars["b", "0,5", "v"] == (-0.3, "large") and bars["b", "5%", "w"] == (None, None)
    bare = df.drop("MissMech", "MissRate")
    assert P.filter_selection(bare, mechs="MAR", missrates="5%", methods="a").count() == 2
    assert P.grouped_bars(bare, "smd").count() == 3 and P.metric_lines(bare, "smd").count() == 4
    with pytest.raises(KeyError):
        P.metric_lines(df, "rmse")
