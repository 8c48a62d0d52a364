"""Tables behind the distribution figures: histogram, ECDF, QQ, box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.operators import cumulative
from fillgauge.operators.cumulative import GroupSizes, ordered_cuts, percentiles, running_counts
from fillgauge.functions.values import known_number
from fillgauge.operators.joins import attach
from fillgauge.operators.rankcuts import rank_cuts, value_levels
from fillgauge.operators.robust import paired_distribution
from fillgauge.operators.sampling import sample_per_group
from fillgauge.plans.reports import filter_selection
from fillgauge.session import settle

# The bin counts of the histogram rule.
BINS_SMALL, BINS_MIN, BINS_MAX = 10, 10, 200


def figure_keys(rows: DataFrame) -> list[str]:
    """One figure per variable, mechanism, method and rate, as far as present."""
    return [c for c in ("variable", "MissMech", "Method", "MissRate") if c in rows.columns]


def selected_rows(rows: DataFrame, *, sample_n: int | None = None,
                  id_cols: Sequence[str] = (), seed: int = 0, **selection) -> DataFrame:
    """The rows of the chosen figures, optionally an exact draw of ``sample_n`` per figure."""
    rows = filter_selection(rows, **selection)
    if sample_n:
        rows = sample_per_group(rows, figure_keys(rows), id_cols, sample_n, seed)
    return rows


def fd_bin_count(n: Column, iqr: Column, low: Column, high: Column) -> Column:
    """Number of bins after Freedman and Diaconis (1981), between 10 and 200."""
    width = F.lit(2.0) * iqr * F.pow(n.cast("double"), F.lit(-1.0 / 3.0))
    bins = F.least(F.ceil(F.try_divide(high - low, F.nullif(width, F.lit(0.0)))), F.lit(BINS_MAX))
    return (F.when(n < 2, F.lit(BINS_SMALL))
            .when((iqr <= 0) | (width <= 0), F.floor(F.sqrt(n.cast("double"))))
            .otherwise(F.greatest(bins, F.lit(BINS_MIN))).cast("int"))


def _series(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, series, value): true and imputed values below each other."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"), known_number(F.col(c)).alias("value"))
        for name, c in (("true", "y_true"), ("imp", "y_pred"))]))
    out = rows.select(*keys, cells.alias("s")).select(*keys, "s.*")
    return out.filter("value is not null")


def _stored(rows: DataFrame, selection: dict) -> tuple[DataFrame, list[str]]:
    """The chosen rows, written out because every table reads them more than once.

    ``settled`` among the options says that ``rows`` is a stored table, which need not be
    written again.
    """
    options = {k: v for k, v in selection.items() if k != "settled"}
    keys = figure_keys(rows)
    chosen = selected_rows(rows, **options).select(*keys, "y_true", "y_pred")
    return chosen if selection.get("settled") and not options.get("sample_n") else settle(chosen), keys


def _bin_counts(tall: DataFrame, frame: DataFrame, keys: Sequence[str], sizes: GroupSizes,
                known: dict) -> DataFrame:
    """(keys, n, bins) of both series together, given their sizes and ends."""
    both = frame.groupBy(*keys).agg(F.sum("total").alias("n"), F.min("lo").alias("low"),
                                    F.max("hi").alias("high"))
    q = percentiles(tall, keys, "value", {"q25": 0.25, "q75": 0.75}, sizes=sizes)
    both = attach(both, q, keys, **known)
    bins = fd_bin_count(F.col("n"), F.col("q75") - F.col("q25"), F.col("low"), F.col("high"))
    return both.select(*keys, "n", bins.alias("bins"))


def _frame(tall: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ends and size of every series."""
    return settle(tall.groupBy(*keys, "series").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("total")))


def _known(sizes: GroupSizes, rows_per_figure: int = 2) -> dict:
    """Options for joins with a table of so many rows per figure."""
    return {"null_safe": True, "settled": True, "small": sizes.few(rows_per_figure)}


def fd_bins(rows: DataFrame, **selection) -> DataFrame:
    """(keys, n, bins) for both series of every figure together."""
    rows, keys = _stored(rows, selection)
    tall = _series(rows, keys)
    sizes = GroupSizes(tall, keys)
    return _bin_counts(tall, _frame(tall, keys), keys, sizes, _known(sizes))


def hist_table(rows: DataFrame, *, bins: str | int = "fd", density: bool = True,
               x_clip: tuple[float, float] | None = (0.0, 0.99), x_transform: str | None = None,
               **selection) -> DataFrame:
    """(keys, series, bin, left, right, n, height) of true and imputed values.

    Both series are clipped at percentiles of the combined data and share the bin
    count; each has its own equal-width edges.  Empty bins are listed with 0.
    """
    if x_transform not in (None, "log1p"):
        raise ValueError("x_transform must be None or 'log1p'")
    rows, keys = _stored(rows, selection)
    tall = _series(rows, keys)
    if x_transform:
        tall = tall.filter("value > -1").withColumn("value", F.log1p("value"))
    # clipping only shrinks the groups, so their sizes stay valid bounds
    sizes = GroupSizes(tall, keys)
    known = _known(sizes)
    if x_clip is not None:
        ends = settle(percentiles(tall, keys, "value", {"c_lo": x_clip[0], "c_hi": x_clip[1]}, sizes=sizes))
        tall = attach(tall, ends, keys, **known).filter(
            (F.col("value") >= F.col("c_lo")) & (F.col("value") <= F.col("c_hi"))).drop("c_lo", "c_hi")
    by = [*keys, "series"]
    frame = _frame(tall, keys)
    if bins == "fd":
        frame = attach(frame, _bin_counts(tall, frame, keys, sizes, known).drop("n"), keys, **known)
    else:
        frame = frame.withColumn("bins", F.lit(int(bins)))
    flat = F.col("lo") == F.col("hi")
    frame = frame.withColumns({
        "lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
        "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    frame = settle(frame.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins")))
    placed = attach(tall, frame.select(*by, "lo", "width", "bins"), by, **known)
    bin_no = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.col("bins") - 1)
    filled = placed.groupBy(*by, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # at most 200 bins (or the asked number) per figure and series
    slots = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    most_bins = 2 * (BINS_MAX if bins == "fd" else int(bins))
    out = attach(slots, filled, [*by, "bin"], **_known(sizes, most_bins))
    n = F.coalesce(F.col("n"), F.lit(0))
    height = n / (F.col("total") * F.col("width")) if density else n.cast("double")
    left = F.col("lo") + F.col("bin") * F.col("width")
    return out.select(*by, "bin", left.alias("left"), (left + F.col("width")).alias("right"),
                      n.alias("n"), height.alias("height"))


def _per_series(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, series, value, cnt, cum, tot) from paired running counts."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"), F.col(f"n_{name}").alias("cnt"),
                 F.col(f"cum_n_{name}").alias("cum"), F.col(f"tot_n_{name}").alias("tot"))
        for name in ("true", "imp")]))
    return run.select(*keys, "value", parts.alias("p")).select(*keys, "value", "p.*").filter("cnt > 0")


def _running(rows: DataFrame, keys: list[str]) -> DataFrame:
    dist = paired_distribution(rows, keys, "y_true", "y_pred")
    return running_counts(dist, keys, ("n_true", "n_imp"))


def ecdf_table(rows: DataFrame, **selection) -> DataFrame:
    """(keys, series, x, n, F): the step function, one row per distinct value."""
    rows = selected_rows(rows, **selection)
    keys = figure_keys(rows)
    tall = _per_series(_running(rows, keys), keys)
    return tall.select(*keys, "series", F.col("value").alias("x"), F.col("cnt").alias("n"),
                       (F.col("cum") / F.col("tot")).alias("F"))


def qq_table(rows: DataFrame, q_points: int = 101, **selection) -> DataFrame:
    """(keys, point, p, q_true, q_imp) at ``q_points`` evenly spaced shares from 0.01 to 0.99."""
    rows, keys = _stored(rows, selection)
    step = (0.99 - 0.01) / (q_points - 1) if q_points > 1 else 0.0
    shares = [0.01 + step * i for i in range(q_points)]
    table = F.array(*[F.lit(p) for p in shares])
    by = [*keys, "series"]
    x = F.col("value")

    def ranks(n: Column) -> Column:
        low = F.transform(table, lambda p: F.floor((n - 1) * p) + 1)
        return F.concat(low, F.transform(table, lambda p: F.ceil((n - 1) * p) + 1))

    tall = _series(rows, keys)
    if GroupSizes(tall, by).biggest <= cumulative.MAX_GROUP_ROWS:
        cuts = ordered_cuts(tall, by, "value", ranks)
    else:
        cuts = rank_cuts(tall, by, x, value_levels(x), ranks)
    # at most two cuts per share
    found = cuts.groupBy(*by).agg(
        F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "cut"))).alias("at"))
    points = found.select(*by, "n", "at", F.posexplode(table).alias("point", "p"))
    h = (F.col("n") - 1) * F.col("p")
    low, high = F.col("at")[F.floor(h) + 1], F.col("at")[F.ceil(h) + 1]
    points = points.withColumn("q", low + (high - low) * (h - F.floor(h)))
    return points.groupBy(*keys, "point", "p").agg(*[
        F.max(F.when(F.col("series") == s, F.col("q"))).alias(f"q_{s}") for s in ("true", "imp")])


def box_table(rows: DataFrame, **selection) -> DataFrame:
    """(keys, series, n, q1, median, q3, whisker_low, whisker_high, outliers).

    Whiskers end at the outermost values within 1.5 box lengths of the box, and
    never start inside it.
    """
    rows, keys = _stored(rows, selection)
    tall, by = _series(rows, keys), [*keys, "series"]
    sizes = GroupSizes(tall, by)
    known = _known(sizes, 1)
    box = settle(percentiles(tall, by, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, sizes=sizes))
    seen = attach(tall, box.drop("median"), by, **known)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    ends = seen.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("value"))).alias("w_lo"),
        F.max(F.when(inside, F.col("value"))).alias("w_hi"), F.count_if(~inside).alias("outliers"))
    out = attach(box, ends, by, **known)
    return out.select(*by, "n", "q1", "median", "q3", F.least("w_lo", "q1").alias("whisker_low"),
                      F.greatest("w_hi", "q3").alias("whisker_high"), "outliers")
