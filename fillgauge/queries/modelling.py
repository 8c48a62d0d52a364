"""Queries on boosted trees: one record per order, its total predicted from its lines."""

from pyspark.sql import functions as F

from fillgauge.plans import model as M
from fillgauge.queries.base import PAIRS, pairs, query, rounded, table
from fillgauge.queries.masking import mcar_sql
from fillgauge.operators.missing import mcar_missing
from fillgauge.session import fresh_path, settle

ID = ["l_orderkey"]
FEATURES = ["n_lines", "quantity", "discount", "flag"]
SMALL = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1, "maxBins": 32}

#: SQL twin of the target of :func:`baskets`.
TOTALS = "SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_orderkey"


def baskets(spark, d):
    """One row per order: total price, number of lines, quantity, mean discount, a return flag."""
    return settle(table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
        F.max("l_returnflag").alias("flag")).withColumn("STATUS_ZAPISA", F.lit(1)))


def trained(df, folder=None, **options):
    return M.train_final(df, "total", FEATURES, id_cols=ID, params=SMALL, cv_nfold=2,
                         target_transform={"method": "log"}, folder=folder, **options)


@query("train_metrics_regression", f"""
WITH p AS (SELECT *, y_pred * 1.01::DOUBLE AS live FROM ({PAIRS}) WHERE y_pred IS NOT NULL)
SELECT round(sqrt(avg(pow(y_pred - y_true, 2))), 3) AS rmse, round(avg(abs(y_pred - y_true)), 6) AS mae,
  round(1 - avg(pow(y_pred - y_true, 2)) / var_pop(y_true), 8) AS r2,
  round(sqrt(avg(pow(live - y_true, 2))), 3) AS rmse_infer_smearing FROM p""")
def _(spark, d):
    df = pairs(spark, d).withColumn("live", F.col("y_pred") * 1.01)
    return rounded(M.regression_metrics(df, "y_true", "y_pred", "live"), rmse=3, mae=6, r2=8,
                   rmse_infer_smearing=3)


def _class_sql(source: str, macro: bool) -> str:
    pick = "avg({})" if macro else "coalesce(max({}) FILTER (c = 1), 0)"
    pr, re, f = (pick.format(x) for x in ("coalesce(tp / nullif(said, 0), 0)",
                                          "coalesce(tp / nullif(really, 0), 0)",
                                          "coalesce(2 * tp / nullif(said + really, 0), 0)"))
    return f"""WITH s AS ({source}), c AS (SELECT l AS c FROM s UNION SELECT p FROM s),
m AS (SELECT c, (SELECT count(*) FROM s WHERE l = c AND p = c) AS tp, (SELECT count(*) FROM s WHERE p = c) AS said,
  (SELECT count(*) FROM s WHERE l = c) AS really FROM c)
SELECT round(sum(tp) / sum(really), 9) AS accuracy, round({pr}, 9) AS precision, round({re}, 9) AS recall,
  round({f}, 9) AS f1 FROM m"""


_FOUR = dict(accuracy=9, precision=9, recall=9, f1=9)


@query("classification_metrics", _class_sql(
    "SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS l, "
    "CAST(1 + floor(o_totalprice / 80000) AS INTEGER) AS p FROM orders", True))
def _(spark, d):
    df = table(spark, d, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("l"),
        (1 + F.floor(F.col("o_totalprice") / 80000)).cast("int").alias("p"))
    return rounded(M.classification_metrics(df, "l", "p"), **_FOUR)


@query("classification_binary", _class_sql("SELECT quality AS l, toxic AS p FROM labels", False))
def _(spark, d):
    return rounded(M.classification_metrics(table(spark, d, "labels"), "quality", "toxic"), **_FOUR)


def spread(df):
    """Error of the constant prediction."""
    return df.agg(F.stddev_pop("total")).first()[0]


@query("train_cv", f"""
WITH t AS ({TOTALS}), n AS (SELECT count(*) AS n, round(stddev_pop(total), 1) AS spread FROM t)
SELECT CAST(i AS INTEGER) AS fold, 'rmse_orig' AS metric, n * (i + 1) // 3 - n * i // 3 AS n_valid,
  spread AS constant_rmse, TRUE AS several_rounds, TRUE AS better FROM n, range(3) r(i)""")
def _(spark, d):
    df = baskets(spark, d)
    m = M.train_final(df, "total", FEATURES, id_cols=ID, params=SMALL, cv_nfold=3, rare_fraction=0.001,
                      target_transform={"method": "log"})
    constant = spread(df)
    rows = [(r["fold"], r["metric"], r["rows"], 2 <= r["best_iter"] <= SMALL["maxIter"], r["score"] < constant)
            for r in m.cv_results]
    out = spark.createDataFrame(rows, "fold int, metric string, n_valid long, several_rounds boolean, better boolean")
    return out.withColumn("constant_rmse", F.round(F.lit(constant), 1))


@query("predict_inverse", f"SELECT l_orderkey, total, TRUE AS positive, TRUE AS better FROM ({TOTALS})")
def _(spark, d):
    df = baskets(spark, d)
    out = settle(trained(df).predict(df, "predicted").select("l_orderkey", "total", "predicted"))
    error = out.agg(F.sqrt(F.avg(F.pow(F.col("predicted") - F.col("total"), F.lit(2))))).first()[0]
    return out.select("l_orderkey", "total", (F.col("predicted") > 0).alias("positive"),
                      F.lit(error < 0.8 * spread(df)).alias("better"))


@query("feature_importance", """
SELECT unnest(['n_lines', 'quantity', 'discount', 'flag']) AS feature, TRUE AS a_share, 1.0::DOUBLE AS total""")
def _(spark, d):
    gains = M.feature_importance(trained(baskets(spark, d))).collect()
    total = round(sum(r["gain"] for r in gains), 9)
    return spark.createDataFrame([(r["feature"], 0 <= r["gain"] <= 1, total) for r in gains],
                                 "feature string, a_share boolean, total double")


@query("model_roundtrip", f"""
SELECT count(*) AS n, count(*) AS n_equal, TRUE AS varied, TRUE AS better FROM ({TOTALS})""")
def _(spark, d):
    df, folder = baskets(spark, d), fresh_path(spark, "model")
    fitted = trained(df, folder, rare_fraction=0.001)
    loaded = M.load_trained_model(spark, folder)
    both = loaded.predict(fitted.predict(df, "a"), "b")
    error = F.sqrt(F.avg(F.pow(F.col("b") - F.col("total"), F.lit(2))))
    return both.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-6).alias("n_equal"),
                    (F.count_distinct(F.round("b", 3)) > 20).alias("varied"),
                    (error < 0.8 * F.stddev_pop("total")).alias("better"))


@query("impute_with_model", f"""
WITH b AS (SELECT l_orderkey AS o_orderkey, total FROM ({TOTALS})),
h AS ({mcar_sql('total', 0.1, 21, 'b')})
SELECT CASE WHEN h.o_orderkey IS NULL THEN 1 ELSE 105 END AS "STATUS_ZAPISA", count(*) AS n, count(*) AS n_filled,
  round(sum(CASE WHEN h.o_orderkey IS NULL THEN total END), 0) AS kept, TRUE AS close
FROM b LEFT JOIN h ON b.o_orderkey = h.o_orderkey GROUP BY 1""")
def _(spark, d):
    df = baskets(spark, d)
    masked = mcar_missing(df, "total", 0.1, 105, id_cols=ID, random_state=21)
    out = M.impute(masked, "total", trained(masked)).join(df.select("l_orderkey", F.col("total").alias("truth")), ID)
    error = F.sqrt(F.avg(F.pow(F.col("total") - F.col("truth"), F.lit(2))))
    return out.groupBy("STATUS_ZAPISA").agg(
        F.count(F.lit(1)).alias("n"), F.count("total").alias("n_filled"),
        F.round(F.sum(F.when(F.col("STATUS_ZAPISA") == 1, F.col("total"))), 0).alias("kept"),
        (error < 0.8 * F.stddev_pop("truth")).alias("close"))


def _classified(spark, d, bounds):
    """Counts per class, and whether the trained classes are told apart better than by the commonest."""
    df = baskets(spark, d)
    df = df.withColumn("class", sum(((F.col("total") > b).cast("int") for b in bounds), F.lit(0)))
    m = M.train_final(df, "class", FEATURES[:3], id_cols=ID, task="classification", cv_nfold=2,
                      params={"maxIter": 6, "maxDepth": 4, "stepSize": 0.3, "maxBins": 32})
    out = settle(m.predict(df, "said", probability="p").select("class", "said", "p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    hit, most = out.agg(F.avg((F.col("class") == F.col("said")).cast("int"))).first()[0], (
        out.groupBy("class").count().agg(F.max("count") / F.sum("count")).first()[0])
    return out.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), (F.max(F.abs(total - 1)) < 1e-9).alias("adds_up"),
        F.bool_and(F.size("p") == len(bounds) + 1).alias("all_classes")).withColumn("better", F.lit(hit > most + 0.05))


def _classes_sql(bounds):
    number = " + ".join(f"CAST(total > {b} AS INTEGER)" for b in bounds)
    return (f"SELECT {number} AS class, count(*) AS n, TRUE AS adds_up, TRUE AS all_classes, TRUE AS better "
            f"FROM ({TOTALS}) GROUP BY 1")


@query("train_classifier_binary", _classes_sql([100_000]))
def _(spark, d):
    return _classified(spark, d, [100_000])


@query("train_classifier_multi", _classes_sql([60_000, 120_000]))
def _(spark, d):
    return _classified(spark, d, [60_000, 120_000])


_SPACE = {"stepSize": [0.1, 0.3], "maxDepth": [2, 3, 4], "minInstancesPerNode": [5, 20], "maxIter": [8],
          "subsamplingRate": [0.8, 1.0], "maxBins": [32]}


def _tuned(df):
    return M.tune(df, "total", FEATURES, id_cols=ID, n_trials=4, space=_SPACE, cv_nfold=2,
                  target_transform={"method": "log"}, sweep={"maxBins": [16, 32]}, final_fit=False,
                  parallelism=2)


@query("tune_random_search", f"""
SELECT CAST(i AS INTEGER) AS trial, '{",".join(sorted(_SPACE))}' AS parameters, TRUE AS in_space, TRUE AS scored,
  TRUE AS best_is_kept, TRUE AS better FROM range(4) r(i)""")
def _(spark, d):
    df = baskets(spark, d)
    found = _tuned(df)
    constant, best = spread(df), min(found.trials, key=lambda t: t["score"])
    kept = all(found.params[p] == v for p, v in best["params"].items() if p != "maxBins")
    rows = [(t["trial"], ",".join(sorted(t["params"])), all(v in _SPACE[p] for p, v in t["params"].items()),
             t["skipped"] is None and t["score"] > 0, kept, t["score"] < constant) for t in found.trials]
    return spark.createDataFrame(rows, "trial int, parameters string, in_space boolean, scored boolean, "
                                       "best_is_kept boolean, better boolean")


@query("tune_sweep", """
SELECT 'maxBins' AS parameter, unnest(['16', '32']) AS value, TRUE AS in_rounds, TRUE AS smallest_is_kept""")
def _(spark, d):
    found = _tuned(baskets(spark, d))
    best = min(found.sweep, key=lambda t: t["score"])
    rows = [(t["parameter"], str(t["value"]), 1 <= t["best_iter"] <= 8, found.params["maxBins"] == best["value"])
            for t in found.sweep]
    return spark.createDataFrame(rows, "parameter string, value string, in_rounds boolean, smallest_is_kept boolean")


# ---------------------------------------------------------------- one tree that SQL can grow too

_COUNTS = ["n_lines", "n_flags"]
_ROWS_SQL = ("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS y, count(*) AS n_lines, "
             "count(DISTINCT l_returnflag) AS n_flags FROM lineitem GROUP BY l_orderkey")


def _split_sql(rows: str) -> str:
    """The best split of every ``node`` of ``rows``, by prefix sums over each feature's values."""
    return f"""SELECT node, arg_max(f, drop) AS f, arg_max(cut, drop) AS cut, max(drop) AS drop FROM (
  SELECT node, f, (x + lead(x) OVER w) / 2 AS cut, (tq - ts * ts / tn) - (sum(q) OVER w - pow(sum(s) OVER w, 2) / sum(n) OVER w)
    - (tq - sum(q) OVER w - pow(ts - sum(s) OVER w, 2) / nullif(tn - sum(n) OVER w, 0)) AS drop
  FROM (SELECT *, sum(n) OVER p AS tn, sum(s) OVER p AS ts, sum(q) OVER p AS tq FROM (
    SELECT node, f, x, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM (
      SELECT node, y, unnest(['n_lines', 'n_flags']) AS f, unnest([n_lines, n_flags]) AS x FROM {rows}) GROUP BY node, f, x)
    WINDOW p AS (PARTITION BY node, f))
  WINDOW w AS (PARTITION BY node, f ORDER BY x)) WHERE cut IS NOT NULL GROUP BY node"""


_TREE_SQL = f"""WITH r0 AS (SELECT *, 0 AS node FROM ({_ROWS_SQL})), s0 AS ({_split_sql('r0')}),
r1 AS (SELECT l_orderkey, y, n_lines, n_flags,
  1 + CAST(CASE f WHEN 'n_lines' THEN n_lines ELSE n_flags END > cut AS INTEGER) AS node FROM r0 JOIN s0 USING (node)),
s1 AS ({_split_sql('r1')}),
r2 AS (SELECT l_orderkey, y, 3 + 2 * r1.node + CAST(CASE f WHEN 'n_lines' THEN n_lines ELSE n_flags END > cut AS INTEGER) AS leaf
  FROM r1 LEFT JOIN s1 USING (node))"""


def _one_tree(df):
    """One round of depth 2; every distinct value may be split at."""
    return M.train_final(df, "total", _COUNTS, id_cols=ID, rounds=1,
                         params={"maxIter": 1, "maxDepth": 2, "maxBins": 32, "minInstancesPerNode": 1, "subsamplingRate": 1.0})


def _counts(spark, d):
    return settle(table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("l_returnflag").alias("n_flags")))


@query("predict_one_tree", f"""{_TREE_SQL}
SELECT l_orderkey, round(avg(y) OVER (PARTITION BY leaf), 3) AS predicted FROM r2""")
def _(spark, d):
    df = _counts(spark, d)
    return rounded(_one_tree(df).predict(df, "predicted").select("l_orderkey", "predicted"), predicted=3)


@query("gains_one_tree", f"""{_TREE_SQL}, g AS (SELECT f, drop FROM s0 UNION ALL SELECT f, drop FROM s1)
SELECT feature, round(coalesce(sum(drop), 0) / (SELECT sum(drop) FROM g), 7) AS gain
FROM (SELECT unnest(['n_lines', 'n_flags']) AS feature) LEFT JOIN g ON f = feature GROUP BY feature""")
def _(spark, d):
    return rounded(M.feature_importance(_one_tree(_counts(spark, d))).select("feature", "gain"), gain=7)
