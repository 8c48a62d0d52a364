"""Queries on draws, masks, folds and strata."""

from pyspark.sql import functions as F

from fillgauge.operators import categories, missing, sampling, target
from fillgauge.operators.aggregate import aggregate_variable
from fillgauge.queries.base import (GAPPY, RECORDS, gappy, md5_sql, query, records, rounded, table,
                                    wait_sql, uniform_sql)

ID = ["o_orderkey"]


def _key(label: str, seed: int) -> str:
    return md5_sql("o_orderkey", f"'{label}'", f"'{seed}'")


@query("sample_exact_k", f"SELECT o_orderkey FROM orders ORDER BY {_key('sample', 7)} LIMIT 1234")
def _(spark, d):
    return sampling.sample_exact(table(spark, d, "orders"), ID, 1234, 7).select("o_orderkey")


@query("sample_weighted_k", f"""
SELECT o_orderkey FROM orders ORDER BY {wait_sql(_key('sample', 7), 'o_totalprice')} LIMIT 1234""")
def _(spark, d):
    return sampling.sample_weighted(table(spark, d, "orders"), ID, F.col("o_totalprice"), 1234, 7
                                    ).select("o_orderkey")


@query("sample_per_group", f"""
SELECT o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('group', 3)}) <= 5""")
def _(spark, d):
    return sampling.sample_per_group(records(spark, d), ["o_custkey"], ID, 5, 3).select(
        "o_orderkey", "o_custkey")


def mcar_sql(column: str, fraction: float, seed: int, source: str = "rec") -> str:
    """SQL for the ids a random mask hits."""
    return (f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_key(column, seed)}) AS rn, "
            f"count(*) OVER () AS n FROM {source}) WHERE rn <= floor({fraction}::DOUBLE * n)")


def masked_sql(hits: str, column: str, status: int, source: str = "rec") -> str:
    """SQL for the masked table, given SQL for the ids hit."""
    return f"""SELECT s.o_orderkey, CASE WHEN h.o_orderkey IS NULL THEN s.{column} END AS {column},
  CASE WHEN h.o_orderkey IS NULL THEN s."STATUS_ZAPISA" ELSE {status} END AS "STATUS_ZAPISA"
FROM {source} s LEFT JOIN ({hits}) h ON s.o_orderkey = h.o_orderkey"""


def _shown(df, column="o_totalprice"):
    return df.select("o_orderkey", column, "STATUS_ZAPISA")


@query("missing_mcar", f"WITH rec AS ({RECORDS}) {masked_sql(mcar_sql('o_totalprice', 0.29, 5), 'o_totalprice', 101)}")
def _(spark, d):
    return _shown(missing.mcar_missing(records(spark, d), "o_totalprice", 0.29, 101, id_cols=ID,
                                       random_state=5))


@query("missing_mcar_multi", f"""
WITH rec AS ({RECORDS}), a AS ({mcar_sql('o_totalprice', 0.1, 6)}), b AS ({mcar_sql('o_custkey', 0.1, 6)})
SELECT rec.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN o_totalprice END AS o_totalprice,
  CASE WHEN b.o_orderkey IS NULL THEN o_custkey END AS o_custkey,
  CASE WHEN a.o_orderkey IS NULL AND b.o_orderkey IS NULL THEN 1 ELSE 101 END AS "STATUS_ZAPISA"
FROM rec LEFT JOIN a ON rec.o_orderkey = a.o_orderkey LEFT JOIN b ON rec.o_orderkey = b.o_orderkey""")
def _(spark, d):
    out = missing.mcar_missing(records(spark, d), ["o_totalprice", "o_custkey"], 0.1, 101, id_cols=ID,
                               random_state=6)
    return out.select("o_orderkey", "o_totalprice", "o_custkey", "STATUS_ZAPISA")


def _with_balance(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    rec = records(spark, d)
    return rec.join(people, rec["o_custkey"] == people["c_custkey"], "left").drop("c_custkey")


BALANCE = f"SELECT r.*, c_acctbal FROM ({RECORDS}) r LEFT JOIN customer ON o_custkey = c_custkey"


def _mar_sql(kind: str, count: str, seed: int) -> str:
    weight = "c_acctbal - lo" if kind == "max" else "hi - c_acctbal"
    wait = wait_sql(_key("o_totalprice", seed), f"({weight}) / (hi - lo)")
    hits = f"""SELECT o_orderkey FROM (SELECT o_orderkey, n, row_number() OVER (ORDER BY {wait}) AS rn FROM (
  SELECT *, min(c_acctbal) OVER () AS lo, max(c_acctbal) OVER () AS hi, count(*) OVER () AS n FROM rec
  WHERE c_acctbal IS NOT NULL AND o_totalprice IS NOT NULL) WHERE {weight} > 0) WHERE rn <= {count}"""
    return f"WITH rec AS ({BALANCE}) {masked_sql(hits, 'o_totalprice', 102)}"


@query("missing_mar_max", _mar_sql("max", "floor(0.1::DOUBLE * n)", 8))
def _(spark, d):
    return _shown(missing.mar_missing(_with_balance(spark, d), "o_totalprice", "c_acctbal", 102, 0.1,
                                      id_cols=ID, random_state=8))


@query("missing_mar_min", _mar_sql("min", "ceil(0.0333::DOUBLE * n)", 9))
def _(spark, d):
    return _shown(missing.mar_missing(_with_balance(spark, d), "o_totalprice", "c_acctbal", 102, 0.0333,
                                      type="min", id_cols=ID, random_state=9, rounding="ceil"))


def _company_hits(share: float, alpha: float, seed: int) -> str:
    key = md5_sql("o_custkey", "'company'", f"'{seed}'")
    wait = f"-ln({uniform_sql(key)}) * pow(size::DOUBLE, {alpha}::DOUBLE)"
    return f"""WITH rec AS ({RECORDS}), want AS (SELECT floor({share}::DOUBLE * count(*)) AS k FROM rec),
firms AS (SELECT o_custkey, size, sum(size) OVER (ORDER BY {wait} ROWS UNBOUNDED PRECEDING) AS cum FROM (
  SELECT o_custkey, count(*) AS size FROM rec GROUP BY o_custkey)),
ranked AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('o_totalprice', seed)}) AS rn,
  cum - size AS before, k FROM rec JOIN firms USING (o_custkey), want),
hits AS (SELECT o_orderkey FROM ranked WHERE before < k AND rn <= k - before)"""


@query("missing_company", f"{_company_hits(0.1, 1.0, 4)} {masked_sql('SELECT * FROM hits', 'o_totalprice', 103)}")
def _(spark, d):
    out, _diag = missing.mar_company_missing(records(spark, d), "o_custkey", "o_totalprice", 103, 0.1,
                                             id_cols=ID, random_state=4)
    return _shown(out)


@query("missing_company_uniform", f"""
{_company_hits(0.07, 0.0, 5)} {masked_sql('SELECT * FROM hits', 'o_totalprice', 103)}""")
def _(spark, d):
    out, _diag = missing.mar_company_missing(records(spark, d), "o_custkey", "o_totalprice", 103, 0.07,
                                             alpha=0.0, id_cols=ID, random_state=5)
    return _shown(out)


@query("missing_company_diag", f"""
{_company_hits(0.1, 1.0, 4)} SELECT 'MAR_by_company_size(alpha=1.0)' AS mechanism, (SELECT count(*) FROM hits) AS actual_k,
  round((SELECT count(*) FROM hits) / (SELECT count(*) FROM rec), 9) AS actual_fraction,
  0.1::DOUBLE AS target_fraction, 'eligible_non_na' AS denominator""")
def _(spark, d):
    _out, diag = missing.mar_company_missing(records(spark, d), "o_custkey", "o_totalprice", 103, 0.1,
                                             id_cols=ID, random_state=4)
    return rounded(diag, actual_fraction=9)


def _mnar_sql(kind: str, beta: float, seed: int) -> str:
    slope = beta if kind == "max" else -beta
    weight = (f"CASE WHEN x >= cut THEN 1::DOUBLE ELSE "
              f"1 / (1 + exp(-({slope}::DOUBLE) * (x - mu) / sd)) + 1e-12 END")
    hits = f"""SELECT o_orderkey FROM (SELECT o_orderkey, n, row_number() OVER (
  ORDER BY {wait_sql(_key('o_totalprice', seed), weight)}) AS rn FROM (
  SELECT o_orderkey, o_totalprice AS x, (SELECT count(*) FROM rec) AS n, (SELECT avg(o_totalprice) FROM rec) AS mu,
    (SELECT stddev_pop(o_totalprice) FROM rec) AS sd, (SELECT quantile_cont(o_totalprice, 0.99) FROM rec) AS cut
  FROM rec)) WHERE rn <= floor(0.1::DOUBLE * n)"""
    return f"WITH rec AS ({RECORDS}) {masked_sql(hits, 'o_totalprice', 104)}"


@query("missing_mnar_max", _mnar_sql("max", 1.0, 2))
def _(spark, d):
    return _shown(missing.mnar_missing(records(spark, d), "o_totalprice", 0.1, 104, id_cols=ID,
                                       random_state=2))


@query("missing_mnar_min", _mnar_sql("min", 2.5, 3))
def _(spark, d):
    return _shown(missing.mnar_missing(records(spark, d), "o_totalprice", 0.1, 104, beta=2.5, type="min",
                                       id_cols=ID, random_state=3))


@query("impute_group_median", f"""
WITH rec AS ({RECORDS}), m AS (SELECT rec.*, h.o_orderkey IS NOT NULL AS hit FROM rec LEFT JOIN (
  {mcar_sql('o_totalprice', 0.1, 1)}) h ON rec.o_orderkey = h.o_orderkey),
g AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS middle FROM m WHERE NOT hit GROUP BY o_orderpriority)
SELECT o_orderkey, round(CASE WHEN hit THEN middle ELSE o_totalprice END, 4) AS o_totalprice
FROM m JOIN g USING (o_orderpriority)""")
def _(spark, d):
    out = missing.mcar_missing(records(spark, d), "o_totalprice", 0.1, 101, id_cols=ID, random_state=1)
    out = aggregate_variable(out, "middle", "o_orderpriority", "o_totalprice", "median")
    filled = F.coalesce("o_totalprice", "middle")
    return out.select("o_orderkey", F.round(filled, 4).alias("o_totalprice"))


# ---------------------------------------------------------------- folds and strata

def _fold_sql(rn: str, n: str, k: int) -> str:
    return " + ".join(f"CAST({rn} > {i} * {n} // {k} AS INTEGER)" for i in range(1, k))


@query("folds_kfold", f"""
SELECT o_orderkey, {_fold_sql('rn', 'n', 5)} AS fold FROM (SELECT o_orderkey, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {_key('fold', 42)}) AS rn FROM orders)""")
def _(spark, d):
    return sampling.kfold(table(spark, d, "orders"), ID, 5, 42).select("o_orderkey", "fold")


@query("folds_stratified", f"""
SELECT o_orderkey, o_custkey, {_fold_sql('rn', 'n', 4)} AS fold FROM (SELECT o_orderkey, o_custkey,
  count(*) OVER (PARTITION BY o_custkey) AS n,
  row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('fold', 42)}) AS rn FROM orders)""")
def _(spark, d):
    return sampling.stratified_folds(table(spark, d, "orders"), "o_custkey", ID, 4, 42).select(
        "o_orderkey", "o_custkey", "fold")


def _bins_sql(y: str, n_bins: int, source: str) -> str:
    shares = ", ".join(f"{i / n_bins!r}::DOUBLE" for i in range(n_bins + 1))
    return (f"WITH e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont({y}, [{shares}]), "
            f"lambda q: round(q, 9)))) AS e FROM {source}) SELECT *, len(list_filter(e[2:len(e) - 1], "
            f"lambda q: q < {y})) AS bin FROM {source}, e")


@query("target_bins_quantile", f"""
SELECT o_orderkey, CAST(bin AS INTEGER) AS bin FROM ({_bins_sql('o_totalprice', 10, 'orders')})""")
def _(spark, d):
    return target.bin_target(table(spark, d, "orders"), "o_totalprice", "deciles").select("o_orderkey", "bin")


@query("target_bins_fixed", f"""
SELECT l_orderkey, l_linenumber, l_quantity, CAST(bin AS INTEGER) AS bin
FROM ({_bins_sql('l_quantity', 7, 'lineitem')})""")
def _(spark, d):
    return target.bin_target(table(spark, d, "lineitem"), "l_quantity", "fixed", 7).select(
        "l_orderkey", "l_linenumber", "l_quantity", "bin")


@query("subsample_stratified", f"""
WITH b AS ({_bins_sql('o_totalprice', 10, 'orders')})
SELECT o_orderkey, CAST(bin AS INTEGER) AS bin FROM (SELECT o_orderkey, bin,
  row_number() OVER (PARTITION BY bin ORDER BY {_key('stratum', 42)}) AS rn,
  greatest(1, floor(count(*) OVER (PARTITION BY bin)::DOUBLE * 1000 / count(*) OVER ())) AS quota FROM b)
WHERE rn <= quota""")
def _(spark, d):
    rows = target.bin_target(table(spark, d, "orders"), "o_totalprice")
    return sampling.subsample_stratified(rows, "bin", ID, 1000, 42).select("o_orderkey", "bin")


@query("subsample_class", f"""
SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_key('stratum', 42)}) AS rn,
  greatest(1, floor(count(*) OVER (PARTITION BY o_orderstatus)::DOUBLE * 700 / count(*) OVER ())) AS quota
  FROM orders) WHERE rn <= quota""")
def _(spark, d):
    return sampling.subsample_stratified(table(spark, d, "orders"), "o_orderstatus", ID, 700, 42).select(
        "o_orderkey", "o_orderstatus")


# ---------------------------------------------------------------- categories

_TRAIN = "SELECT * FROM orders WHERE o_orderstatus <> 'F'"
_VALID = "SELECT * FROM orders WHERE o_orderstatus = 'F'"
_MAP = ("SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n, count(*) < 6 AS is_rare "
        f"FROM ({_TRAIN}) GROUP BY o_custkey")


def _parts(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    train, valid = orders.filter("o_orderstatus <> 'F'"), orders.filter("o_orderstatus = 'F'")
    return train, valid, categories.fit_rare_map(train, ["o_custkey"], 6)


@query("rare_map", f"""
WITH g AS ({GAPPY}), c AS (SELECT 'act' AS "column", act AS value, count(*) AS n FROM g GROUP BY act
UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM g GROUP BY o_custkey)
SELECT *, n < 9 AS is_rare FROM c""")
def _(spark, d):
    return categories.fit_rare_map(gappy(spark, d), ["act", "o_custkey"], 9)


@query("rare_apply_train", f"""
SELECT o_orderkey, CASE WHEN is_rare THEN '__RARE__' ELSE value END AS o_custkey
FROM ({_TRAIN}) t JOIN ({_MAP}) m ON CAST(o_custkey AS VARCHAR) = value""")
def _(spark, d):
    train, _valid, rare = _parts(spark, d)
    return categories.apply_rare_map_train(train, rare, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("rare_apply_valid", f"""
SELECT o_orderkey, CASE WHEN is_rare IS NULL THEN '__UNSEEN__' WHEN is_rare THEN '__RARE__' ELSE value END AS o_custkey,
  CASE WHEN is_rare IS NULL OR is_rare THEN '__UNSEEN__' ELSE value END AS strict
FROM ({_VALID}) t LEFT JOIN ({_MAP}) m ON CAST(o_custkey AS VARCHAR) = value""")
def _(spark, d):
    _train, valid, rare = _parts(spark, d)
    valid = valid.withColumn("strict", F.col("o_custkey"))
    strict = rare.withColumn("column", F.lit("strict"))
    out = categories.apply_rare_map_valid(valid, rare, ["o_custkey"])
    out = categories.apply_rare_map_valid(out, strict, ["strict"], strict_reference=True)
    return out.select("o_orderkey", "o_custkey", "strict")


@query("rare_to_other", """
SELECT o_orderkey, CASE WHEN n < 10 THEN 'Other' ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey
FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) USING (o_custkey)""")
def _(spark, d):
    return categories.collapse_rare(records(spark, d), ["o_custkey"], 10).select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- target transforms

@query("target_log", "SELECT o_orderkey, round(ln(o_totalprice + 1.5), 9) AS z FROM orders")
def _(spark, d):
    out, _info = target.transform_target(table(spark, d, "orders"), "o_totalprice",
                                         {"method": "log", "eps": 1.5})
    return rounded(out.select("o_orderkey", "z"), z=9)


@query("target_log1p", "SELECT event_id, round(ln(1 + value), 9) AS z FROM events")
def _(spark, d):
    out, _info = target.transform_target(table(spark, d, "events"), "value", {"method": "log1p"})
    return rounded(out.select("event_id", "z"), z=9)


_HAT = "ln(o_totalprice + 1.5) + (CASE o_orderstatus WHEN 'F' THEN 0.1 WHEN 'O' THEN -0.2 ELSE 0.05 END)"


def _with_hat(spark, d):
    out, info = target.transform_target(table(spark, d, "orders"), "o_totalprice",
                                        {"method": "log", "eps": 1.5})
    shift = F.when(F.col("o_orderstatus") == "F", 0.1).when(F.col("o_orderstatus") == "O", -0.2).otherwise(0.05)
    return out.withColumn("zhat", F.col("z") + shift), info


@query("smearing_factor", f"""
SELECT round(avg(exp(ln(o_totalprice + 1.5) - ({_HAT}))), 9) AS smear FROM orders""")
def _(spark, d):
    df, _info = _with_hat(spark, d)
    return df.agg(F.round(target.smearing_factor(F.col("z"), F.col("zhat")), 9).alias("smear"))


@query("target_inverse", f"""
WITH h AS (SELECT o_orderkey, ln(o_totalprice + 1.5) AS z, {_HAT} AS zhat FROM orders)
SELECT o_orderkey, round(exp(zhat) * (SELECT avg(exp(z - zhat)) FROM h) - 1.5, 3) AS y FROM h""")
def _(spark, d):
    df, info = _with_hat(spark, d)
    info["smear"] = df.agg(target.smearing_factor(F.col("z"), F.col("zhat"))).first()[0]
    return df.select("o_orderkey", F.round(target.inverse_target(F.col("zhat"), info), 3).alias("y"))


@query("rmse_original_scale", f"""
SELECT o_orderpriority, round(sqrt(avg(pow(o_totalprice - (exp({_HAT}) - 1.5), 2))), 3) AS rmse FROM orders
GROUP BY o_orderpriority""")
def _(spark, d):
    df, info = _with_hat(spark, d)
    rmse = target.rmse_original_scale(F.col("z"), F.col("zhat"), info)
    return df.groupBy("o_orderpriority").agg(F.round(rmse, 3).alias("rmse"))
