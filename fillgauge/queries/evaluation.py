"""Queries on imputed versions against the truth, and the tables behind the figures."""

from functools import partial

from pyspark.sql import functions as F

from fillgauge.operators.aggregate import aggregate_variable
from fillgauge.operators.missing import mcar_missing
from fillgauge.plans import distributions, evaluate, reports
from fillgauge.plans.metrics import group_metrics, moment_metrics, spread_metrics
from fillgauge.queries.aggregates import ks_p_sql, ks_sql
from fillgauge.queries.base import PAIRS, pairs, query, records
from fillgauge.queries.masking import mcar_sql
from fillgauge.session import settle, together

#: Digits after the decimal point at which metrics are compared.
DIGITS = {
    "rmse": 3, "mae": 6, "r2": 8, "mape_pct": 5, "smape_pct": 6, "rmsle": 8, "nrmse_mean": 8,
    "nmae_mean": 8, "resid_std": 3, "resid_var": -2, "mean_true": 6, "mean_imp": 6, "mean_diff": 6,
    "mean_bias": 6, "abs_mean_bias": 6, "rel_mean_bias_pct": 6, "abs_rel_mean_bias_pct": 6, "smd": 8,
    "abs_smd": 8, "var_true": -2, "var_imp": -2, "var_ratio": 8, "iqr_true": 4, "iqr_imp": 4,
    "iqr_ratio": 7, "mad_true": 4, "mad_imp": 4, "mad_ratio": 7, "p95p5_true": 4, "p95p5_imp": 4,
    "p95p5_ratio": 7, "var_winsor_true": -2, "var_winsor_imp": -2, "var_winsor_ratio": 7,
    "ks_stat": 9, "ks_p": 7,
}
CORE = ["n", "rmse", "mae", "r2", "mape_pct", "smape_pct", "rmsle", "nrmse_mean", "nmae_mean",
        "resid_std", "resid_var"]
BIAS = ["mean_true", "mean_imp", "mean_diff", "mean_bias", "abs_mean_bias", "rel_mean_bias_pct",
        "abs_rel_mean_bias_pct", "smd", "abs_smd", "var_true", "var_imp", "var_ratio"]
SPREAD = [f"{m}_{s}" for m in ("iqr", "mad", "p95p5", "var_winsor") for s in ("true", "imp", "ratio")
          ] + ["ks_stat", "ks_p"]


def _shown(df, keys, metrics):
    return df.select(*keys, *[F.round(m, DIGITS[m]).alias(m) if m in DIGITS else F.col(m)
                              for m in metrics])


def metrics_sql(source: str, keys: list[str], metrics: list[str]) -> str:
    """SQL twin of the metric table over ``source`` (keys, y_true, y_pred)."""
    k = ", ".join(keys)
    on = f"USING ({k})"
    r = "(p - y)"
    formulas = {
        "n": "count(y)", "rmse": f"sqrt(avg({r} * {r}))", "mae": f"avg(abs({r}))",
        "r2": f"1 - avg({r} * {r}) / nullif(var_pop(y), 0)",
        "mape_pct": f"100 * avg(abs({r}) / CASE WHEN abs(y) < 1e-12 THEN 1e-12 ELSE abs(y) END)",
        "smape_pct": f"100 * avg(2 * abs({r}) / (abs(y) + abs(p) + 1e-12))",
        "rmsle": "CASE WHEN min(least(y, p)) >= 0 THEN sqrt(avg(pow(ln(1 + CASE WHEN y >= 0 THEN y END) "
                 "- ln(1 + CASE WHEN p >= 0 THEN p END), 2))) END",
        "nrmse_mean": f"sqrt(avg({r} * {r})) / (avg(abs(y)) + 1e-12)",
        "nmae_mean": f"avg(abs({r})) / (avg(abs(y)) + 1e-12)",
        "resid_std": f"stddev_samp({r})", "resid_var": f"var_samp({r})",
        "mean_true": "avg(y)", "mean_imp": "avg(p)", "mean_diff": "avg(p) - avg(y)",
        "mean_bias": "avg(p) - avg(y)", "abs_mean_bias": "abs(avg(p) - avg(y))",
        "rel_mean_bias_pct": "100 * (avg(p) - avg(y)) / (abs(avg(y)) + 1e-12)",
        "abs_rel_mean_bias_pct": "abs(100 * (avg(p) - avg(y)) / (abs(avg(y)) + 1e-12))",
        "smd": "(avg(p) - avg(y)) / nullif(sqrt((var_samp(y) + var_samp(p)) / 2), 0)",
        "abs_smd": "abs((avg(p) - avg(y)) / nullif(sqrt((var_samp(y) + var_samp(p)) / 2), 0))",
        "var_true": "var_samp(y)", "var_imp": "var_samp(p)",
        "var_ratio": "var_samp(p) / nullif(var_samp(y), 0)",
    }
    qs = "[0.25, 0.5, 0.75, 0.05, 0.95]"
    spread = {}
    for s, c in (("true", "qy"), ("imp", "qp")):
        spread |= {f"iqr_{s}": f"any_value({c}[3] - {c}[1])", f"p95p5_{s}": f"any_value({c}[5] - {c}[4])"}
    for s, v, c in (("true", "y", "qy"), ("imp", "p", "qp")):
        spread |= {f"mad_{s}": f"quantile_cont(abs({v} - {c}[2]), 0.5)",
                   f"var_winsor_{s}": f"var_samp(CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, {c}[4]), {c}[5]) END)"}
    for m in ("iqr", "mad", "p95p5", "var_winsor"):
        spread[f"{m}_ratio"] = f"({spread[f'{m}_imp']}) / nullif({spread[f'{m}_true']}, 0)"
    spread |= {"ks_stat": "any_value(ks_d)", "ks_p": "any_value(ks_pv)"}
    formulas |= spread
    out = ", ".join(f"round({formulas[m]}, {DIGITS[m]}) AS {m}" if m in DIGITS
                    else f"{formulas[m]} AS {m}" for m in metrics)
    return f"""SELECT {k}, {out} FROM (
  SELECT {k}, CASE WHEN y_pred IS NOT NULL THEN y_true END AS y, CASE WHEN y_true IS NOT NULL THEN y_pred END AS p
  FROM {source}) LEFT JOIN (
  SELECT {k}, quantile_cont(y_true, {qs}) AS qy, quantile_cont(y_pred, {qs}) AS qp FROM {source}
  WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY {k}) {on} LEFT JOIN (
  SELECT {k}, d AS ks_d, {ks_p_sql('d', 'n1', 'n2')} AS ks_pv FROM (
    {ks_sql(f'(SELECT * FROM {source} WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)', keys)})) {on}
GROUP BY {k}"""


@query("metrics_core", f"WITH src AS ({PAIRS}) {metrics_sql('src', ['act', 'status'], CORE)}")
def _(spark, d):
    return _shown(moment_metrics(pairs(spark, d), ["act", "status"]), ["act", "status"], CORE)


@query("metrics_bias", f"WITH src AS ({PAIRS}) {metrics_sql('src', ['act'], BIAS)}")
def _(spark, d):
    return _shown(moment_metrics(pairs(spark, d), ["act"]), ["act"], BIAS)


@query("metrics_spread", f"WITH src AS ({PAIRS}) {metrics_sql('src', ['act', 'status'], SPREAD)}")
def _(spark, d):
    return _shown(spread_metrics(pairs(spark, d), ["act", "status"]), ["act", "status"], SPREAD)


@query("metrics_all", f"WITH src AS ({PAIRS}) {metrics_sql('src', ['status'], CORE + BIAS + SPREAD)}")
def _(spark, d):
    return _shown(group_metrics(pairs(spark, d), ["status"]), ["status"], CORE + BIAS + SPREAD)


# ---------------------------------------------------------------- evaluation of versions

#: version, method, mechanism, rate as written, share, seed, aggregate
VERSIONS = [(101, "group_median", "MCAR", "5%", 0.05, 11, "median"),
            (102, "group_mean", "MCAR", "5%", 0.05, 12, "mean"),
            (103, "group_median", "MCAR", "12,5%", 0.125, 13, "median"),
            (104, "group_mean", "MCAR", "12,5%", 0.125, 14, "mean")]
REGISTRY = [v[:4] for v in VERSIONS]


def imputed_versions(spark, d):
    """Frames of masked and refilled records by version, and the original table."""
    rec = records(spark, d)

    def frame(version, _method, _mech, _rate, share, seed, op):
        masked = mcar_missing(rec, "o_totalprice", share, version, id_cols=["o_orderkey"],
                              random_state=seed)
        filled = aggregate_variable(masked, "pay_filled", "o_orderpriority", "o_totalprice", op)
        return filled.filter(F.col("STATUS_ZAPISA") == version)

    made = together(spark, [partial(frame, *v) for v in VERSIONS])
    return dict(zip((v[0] for v in VERSIONS), made)), rec


def evaluated(spark, d):
    frames, original = imputed_versions(spark, d)
    registry = spark.createDataFrame(
        REGISTRY, "Status_zapisa int, Method string, MissMech string, MissRate string")
    return evaluate.evaluate_imputations_from_methods(
        registry, frames, original, id_col="o_orderkey", target_cols=["o_totalprice"],
        imputed_map={"o_totalprice": "pay_filled"})


def rows_long(spark, d):
    frames, original = imputed_versions(spark, d)
    registry = spark.createDataFrame(
        REGISTRY, "Status_zapisa int, Method string, MissMech string, MissRate string")
    return settle(evaluate.long_rows(registry, frames, original, id_col="o_orderkey",
                                     target_cols=["o_totalprice"],
                                     imputed_map={"o_totalprice": "pay_filled"}))


def _version_sql(version, method, mech, rate, share, seed, op):
    fill = "quantile_cont(o_totalprice, 0.5)" if op == "median" else "avg(o_totalprice)"
    hits = mcar_sql("o_totalprice", share, seed, "orders")
    return f"""SELECT o.o_orderkey, g.fill AS y_pred, CAST({version} AS BIGINT) AS "STATUS_ZAPISA",
  '{method}' AS "Method", '{mech}' AS "MissMech", '{rate}' AS "MissRate", o.o_totalprice AS y_true,
  'o_totalprice' AS variable, g.fill - o.o_totalprice AS residual, o.o_orderstatus AS sector
FROM orders o JOIN ({hits}) h ON o.o_orderkey = h.o_orderkey
JOIN (SELECT o_orderpriority, {fill} AS fill FROM orders WHERE o_orderkey NOT IN ({hits}) GROUP BY o_orderpriority) g
  ON o.o_orderpriority = g.o_orderpriority"""


ROWS = "WITH rows_long AS (" + " UNION ALL ".join(_version_sql(*v) for v in VERSIONS) + ")"
KEYS_SQL = ['"Method"', '"MissMech"', '"MissRate"', '"STATUS_ZAPISA"', "variable"]
KEYS = evaluate.SUMMARY_KEYS
ALL = CORE + BIAS + SPREAD


@query("eval_rows_long", f"""{ROWS} SELECT o_orderkey, round(y_pred, 6) AS y_pred, "STATUS_ZAPISA", "Method",
  "MissMech", "MissRate", y_true, variable, round(residual, 6) AS residual FROM rows_long""")
def _(spark, d):
    return rows_long(spark, d).withColumns({"y_pred": F.round("y_pred", 6),
                                            "residual": F.round("residual", 6)})


@query("eval_summary", f"{ROWS} {metrics_sql('rows_long', KEYS_SQL, ALL)}")
def _(spark, d):
    return _shown(evaluated(spark, d)[1], KEYS, ALL)


def _with_sector(spark, d):
    return settle(evaluate.join_truth(rows_long(spark, d), records(spark, d), "o_orderkey",
                                      {"o_orderstatus": "sector"}))


def _grouped_sql(keys, metrics):
    """Metrics per group with the group column under its public name."""
    return (metrics_sql("rows_long", keys, metrics).replace(f"SELECT {', '.join(keys)},",
            f"SELECT {', '.join(keys[:-1])}, 'sector' AS group_col, sector AS \"group\",", 1))


@query("eval_by_group", f"{ROWS} {_grouped_sql([KEYS_SQL[0], 'variable', 'sector'], ALL)}")
def _(spark, d):
    out = evaluate.summarize_by_group(_with_sector(spark, d), "sector", by_keys=["Method"], settled=True)
    return _shown(out, ["Method", "variable", "group_col", "group"], ALL)


def smd_sql(ref: str) -> str:
    """SQL twin of the group contrasts; ``ref`` picks label and means of the reference."""
    return f"""{ROWS}, g AS (SELECT "Method", variable, sector, count(*) AS n, avg(y_true) AS mt, avg(y_pred) AS mi,
  var_samp(y_true) AS vt, var_samp(y_pred) AS vi FROM rows_long GROUP BY ALL),
a AS (SELECT "Method", variable, avg(y_true) AS mt, avg(y_pred) AS mi,
  sqrt((var_samp(y_true) + var_samp(y_pred)) / 2) AS sg FROM rows_long GROUP BY ALL),
w AS (SELECT "Method", variable, sqrt((avg(vt) + avg(vi)) / 2) AS sw FROM g GROUP BY ALL),
r AS ({ref})
SELECT "Method", variable, 'sector' AS group_col, sector AS "group", r.label AS ref,
  round(((g.mi - r.mi) - (g.mt - r.mt)) / sg, 8) AS "SMD_global",
  round(((g.mi - r.mi) - (g.mt - r.mt)) / sw, 8) AS "SMD_within"
FROM g JOIN a USING ("Method", variable) JOIN w USING ("Method", variable) JOIN r USING ("Method", variable)"""


def _smd(name, ref, **options):
    @query(name, smd_sql(ref))
    def _(spark, d):
        out = evaluate.smd_by_group(_with_sector(spark, d), "sector", by_keys=["Method"], **options)
        return out.withColumns({c: F.round(c, 8) for c in ("SMD_global", "SMD_within")})


_smd("smd_population", """SELECT "Method", variable, 'POPULATION' AS label, mt, mi FROM a""")
_smd("smd_most_frequent", """SELECT "Method", variable, sector AS label, mt, mi FROM g
  QUALIFY row_number() OVER (PARTITION BY "Method", variable ORDER BY n DESC, sector) = 1""",
     ref_rule="most_frequent")
_smd("smd_first", """SELECT "Method", variable, sector AS label, mt, mi FROM g
  QUALIFY row_number() OVER (PARTITION BY "Method", variable ORDER BY sector) = 1""", ref_rule="first")
_smd("smd_value", """SELECT "Method", variable, sector AS label, mt, mi FROM g WHERE sector = 'O'""",
     ref_rule="value", ref_value="O")


# ---------------------------------------------------------------- figures

FIG = '"MissMech", "Method", "MissRate", variable'


def _both(x: str = "{}") -> str:
    """Both series stacked, transformed by ``x``."""
    return (f"SELECT {FIG}, 'true' AS series, {x.format('y_true')} AS v FROM rows_long WHERE y_true IS NOT NULL "
            f"UNION ALL SELECT {FIG}, 'imp', {x.format('y_pred')} FROM rows_long WHERE y_pred IS NOT NULL")


FD = """CASE WHEN n < 2 THEN 10 WHEN iqr <= 0 THEN floor(sqrt(n))
  ELSE greatest(10, least(200, ceil((hi - lo) / (2 * iqr * pow(n::DOUBLE, -1.0::DOUBLE / 3))))) END"""


@query("fd_bins", f"""{ROWS}, s AS ({_both()}), q AS (SELECT {FIG}, count(*) AS n, min(v) AS lo, max(v) AS hi,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM s GROUP BY {FIG})
SELECT {FIG}, n, CAST({FD} AS INTEGER) AS bins FROM q""")
def _(spark, d):
    return distributions.fd_bins(rows_long(spark, d), settled=True)


#: Moves bin edges off the grid of halves, so that rounding does not hang on the last bit.
OFF_GRID = 1.234567e-5


def hist_sql(x: str, low: float, high: float, digits: int) -> str:
    return f"""{ROWS}, s0 AS ({_both(x)}),
c AS (SELECT {FIG}, quantile_cont(v, {low}) AS c0, quantile_cont(v, {high}) AS c1 FROM s0 GROUP BY {FIG}),
s AS (SELECT s0.* FROM s0 JOIN c USING ({FIG}) WHERE v BETWEEN c0 AND c1),
q AS (SELECT {FIG}, count(*) AS n, min(v) AS lo, max(v) AS hi,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM s GROUP BY {FIG}),
b AS (SELECT {FIG}, CAST({FD} AS INTEGER) AS bins FROM q),
f AS (SELECT {FIG}, series, count(*) AS total, bins, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / bins AS width
  FROM s JOIN b USING ({FIG}) GROUP BY {FIG}, series, bins),
h AS (SELECT {FIG}, series, CAST(least(floor((v - lo) / width), bins - 1) AS INTEGER) AS bin, count(*) AS n
  FROM s JOIN f USING ({FIG}, series) GROUP BY ALL),
slots AS (SELECT *, unnest(range(bins)) AS bin FROM f)
SELECT {FIG}, series, CAST(bin AS INTEGER) AS bin, round(lo + bin * width + {OFF_GRID}, {digits}) AS "left",
  round(lo + bin * width + width + {OFF_GRID}, {digits}) AS "right", coalesce(h.n, 0) AS n,
  round(coalesce(h.n, 0) / (total * width), 10) AS height
FROM slots LEFT JOIN h USING ({FIG}, series, bin)"""


def _hist(out, digits):
    return out.withColumns({"left": F.round(F.col("left") + OFF_GRID, digits),
                            "right": F.round(F.col("right") + OFF_GRID, digits),
                            "height": F.round("height", 10)})


@query("hist_table", hist_sql("{}", 0.0, 0.99, 3))
def _(spark, d):
    return _hist(distributions.hist_table(rows_long(spark, d), settled=True), 3)


@query("hist_log1p", hist_sql("ln(1 + {})", 0.01, 0.98, 8))
def _(spark, d):
    out = distributions.hist_table(rows_long(spark, d), settled=True, x_transform="log1p", x_clip=(0.01, 0.98))
    return _hist(out, 8)


@query("ecdf_table", f"""{ROWS}, s AS ({_both('round({}, 6)')})
SELECT {FIG}, series, x, n, round(sum(n) OVER (PARTITION BY {FIG}, series ORDER BY x) / sum(n) OVER (
  PARTITION BY {FIG}, series), 10) AS "F" FROM (SELECT {FIG}, series, v AS x, count(*) AS n FROM s GROUP BY ALL)""")
def _(spark, d):
    rows = rows_long(spark, d).withColumn("y_pred", F.round("y_pred", 6))
    return distributions.ecdf_table(rows).withColumn("F", F.round("F", 10))


QQ_STEP = (0.99 - 0.01) / 100
_QQ = "[" + ", ".join(f"{0.01 + QQ_STEP * i!r}::DOUBLE" for i in range(101)) + "]"


@query("qq_table", f"""{ROWS}, q AS (SELECT {FIG}, quantile_cont(y_true, {_QQ}) AS a, quantile_cont(y_pred, {_QQ}) AS b
  FROM rows_long GROUP BY {FIG})
SELECT {FIG}, CAST(i AS INTEGER) AS point, round({_QQ}[i + 1], 6) AS p, round(a[i + 1], 6) AS q_true,
  round(b[i + 1], 6) AS q_imp FROM (SELECT *, unnest(range(101)) AS i FROM q)""")
def _(spark, d):
    return distributions.qq_table(rows_long(spark, d), settled=True).withColumns(
        {"p": F.round("p", 6), "q_true": F.round("q_true", 6), "q_imp": F.round("q_imp", 6)})


@query("box_table", f"""{ROWS}, s AS ({_both()}),
q AS (SELECT {FIG}, series, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM s GROUP BY {FIG}, series)
SELECT {FIG}, series, count(*) AS n, round(any_value(q[1]), 4) AS q1, round(any_value(q[2]), 4) AS median,
  round(any_value(q[3]), 4) AS q3,
  round(least(any_value(q[1]), min(v) FILTER (v >= q[1] - 1.5 * (q[3] - q[1]))), 4) AS whisker_low,
  round(greatest(any_value(q[3]), max(v) FILTER (v <= q[3] + 1.5 * (q[3] - q[1]))), 4) AS whisker_high,
  count(*) FILTER (v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1])) AS outliers
FROM s JOIN q USING ({FIG}, series) GROUP BY {FIG}, series""")
def _(spark, d):
    out = distributions.box_table(rows_long(spark, d), settled=True)
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query("metric_lines", f"""{ROWS}, s AS ({metrics_sql('rows_long', KEYS_SQL, ['rmse'])})
SELECT variable, "MissMech", "Method", CAST(replace(replace("MissRate", '%', ''), ',', '.') AS DOUBLE) AS rate,
  "MissRate" AS rate_label, rmse AS value FROM s""")
def _(spark, d):
    summary = moment_metrics(rows_long(spark, d), KEYS)
    return reports.metric_lines(summary, "rmse", mechs="MCAR").withColumn("value", F.round("value", 3))


@query("grouped_bars", f"""{ROWS}, s AS ({metrics_sql('rows_long', KEYS_SQL, ['smd'])})
SELECT variable, "MissMech", "Method" AS "group", "MissRate" AS hue, round(avg(smd), 6) AS value,
  CASE WHEN abs(avg(smd)) < 0.1 THEN 'small' WHEN abs(avg(smd)) < 0.2 THEN 'medium' ELSE 'large' END AS band
FROM s GROUP BY ALL""")
def _(spark, d):
    summary = moment_metrics(rows_long(spark, d), KEYS)
    return reports.grouped_bars(summary, "smd").withColumn("value", F.round("value", 6))
