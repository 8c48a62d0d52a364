"""Boosting of squared error over cells: the rows that share the bin of every feature.

A tree sees no more of a row than its bins, so rows of one cell meet in one leaf in every round, and have the
same prediction.  How many of them a round draws and the sum of their labels is all that growing a tree asks of
them; that is counted for many rounds in one pass, and the trees are grown from the counts.  The rules are those
of MLlib: candidate splits, gains, smallest nodes, pseudo-residuals, and rows drawn anew for every round.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fillgauge.operators.target import inverse_number, inverse_target
from fillgauge.session import settle

#: Most cells that are grown from; tables with more are boosted row by row.
MAX_CELLS = 500_000
#: Rounds whose draws are counted in one pass, and most (cell, round) counts that the driver holds of them.
BLOCK_ROUNDS, BLOCK_COUNTS = 16, 4_000_000
#: Rows that candidate splits are taken from are the square of the bins, and so many at least (as in MLlib).
SPLIT_ROWS = 10_000
#: Marks of the input columns of a fold.
INPUTS = ("__num_", "__gap_", "__enc")
#: Parameters that the growing of trees knows; with any other a fold is boosted row by row.
KNOWN = {"maxIter", "maxDepth", "stepSize", "maxBins", "minInstancesPerNode", "minInfoGain", "subsamplingRate",
         "featureSubsetStrategy", "best_iter", "seed", "objective"}

#: Splits whose gains differ by no more than this share are equal; the first feature and cut is taken.
TIE = 1e-9

_BITS = 52  # of a row's hash that decide whether it is drawn


def handles(params: Mapping[str, Any]) -> bool:
    """Whether the trees of ``params`` are grown from counts; what MLlib would refuse is left to it."""
    if not set(params) <= KNOWN or params.get("featureSubsetStrategy", "all") not in ("all", "auto"):
        return False
    return (params["maxIter"] >= 1 and params["maxDepth"] >= 0 and params["maxBins"] >= 2 and 0 < params["stepSize"] <= 1
            and params.get("minInstancesPerNode", 1) >= 1 and params.get("minInfoGain", 0.0) >= 0
            and 0 < params.get("subsamplingRate", 1.0) <= 1)


def candidates(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between the values: all midpoints, or those nearest to equal shares of the rows."""
    x, n = np.unique(values, return_counts=True)
    middle = (x[1:] + x[:-1]) / 2
    if len(x) <= bins:
        return np.unique(middle)
    passed, stride, wanted, out = np.cumsum(n), len(values) / bins, len(values) / bins, []
    for i in range(1, len(x)):
        if abs(passed[i - 1] - wanted) < abs(passed[i] - wanted):
            out.append(middle[i - 1])
            wanted += stride
    return np.unique(out)


def grown(bins: np.ndarray, widths: Sequence[int], n: np.ndarray, s: np.ndarray, depth: int, min_rows: int,
          min_gain: float) -> np.ndarray:
    """What a regression tree over the cells predicts for each of them.

    ``bins`` has a row per feature, ``n`` the rows of a cell and ``s`` the sum of their labels.
    """
    mean = s.sum() / n.sum() if n.sum() else 0.0
    said, s = np.full(len(n), mean), s - n * mean
    cells, node, nodes = np.arange(len(n)), np.zeros(len(n), dtype=np.int64), 1  # the cells of open nodes
    for _ in range(depth):
        cn, cs = n[cells], s[cells]
        tn, ts = np.bincount(node, cn, nodes)[:, None], np.bincount(node, cs, nodes)[:, None]
        best, feature, cut = np.zeros(nodes), np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
        for f, width in enumerate(widths):
            if width < 2:
                continue
            place = node * width + bins[f, cells]
            ln = np.bincount(place, cn, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
            ls = np.bincount(place, cs, nodes * width).reshape(nodes, width).cumsum(axis=1)[:, :-1]
            rn, rs = tn - ln, ts - ls
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (ls * ls / ln + rs * rs / rn - ts * ts / tn) / tn
            gain = np.where((ln >= min_rows) & (rn >= min_rows) & (gain >= min_gain), gain, 0.0)
            at = (gain >= gain.max(axis=1, keepdims=True) * (1 - TIE)).argmax(axis=1)
            gain = gain[np.arange(nodes), at]
            better = gain > best * (1 + TIE)
            best[better], feature[better], cut[better] = gain[better], f, at[better]
        split = best > 0
        kept = split[node]
        cells, node = cells[kept], node[kept]
        if not len(cells):
            break
        right = bins[feature[node], cells] > cut[node]
        node, nodes = 2 * (np.cumsum(split) - 1)[node] + right, 2 * int(split.sum())
        said[cells] = mean + (np.bincount(node, s[cells], nodes) / np.bincount(node, n[cells], nodes))[node]
    return said


@dataclass
class Grid:
    """The cells of a fold at one number of bins: the training rows, and what the validation rows are compared by."""
    names: list[str]
    cuts: list[np.ndarray]
    cell: np.ndarray
    counts: dict[str, np.ndarray]
    info: Mapping[str, Any]

    @property
    def widths(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    @property
    def bins(self) -> np.ndarray:
        """The bin of each cell (columns) in each feature (rows)."""
        out, rest = np.empty((len(self.cuts), len(self.cell)), dtype=np.int64), self.cell.copy()
        for f in reversed(range(len(self.cuts))):
            rest, out[f] = np.divmod(rest, self.widths[f])
        return out

    def error(self, said: np.ndarray) -> float:
        """Squared error on the validation rows."""
        return self._apart(said, "z")

    def score(self, said: np.ndarray) -> float:
        """Root of the mean squared error on the original scale."""
        return float(np.sqrt(self._apart(inverse_number(said, self.info), "y")))

    def _apart(self, said: np.ndarray, scale: str) -> float:
        c, some = self.counts, self.counts["valid"] > 0
        off = c[f"mean_{scale}"][some] - said[some]
        return float((c["valid"][some] * (off * off + c[f"var_{scale}"][some])).sum() / c["valid"].sum())


def _binned(rows: DataFrame, names: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Add ``cell``, a number for the bins of a row; a value at a threshold lies below it."""
    used = [(name, c) for name, c in zip(names, cuts) if len(c)]
    if used:
        rows = Bucketizer(
            inputCols=[name for name, _ in used], outputCols=[f"__bin{name}" for name, _ in used],
            splitsArray=[[float("-inf"), *np.nextafter(c, np.inf).tolist(), float("inf")] for _, c in used]).transform(rows)
    cell = F.lit(0).cast("long")
    for name, c in used:
        cell = cell * F.lit(len(c) + 1) + F.col(f"__bin{name}").cast("long")
    return rows.withColumn("cell", cell)


def _drawn(share: float, *marks: Any) -> Column:
    """True for about that share of the rows, drawn anew for other marks."""
    return F.xxhash64("__row", *map(F.lit, marks)).bitwiseAND(F.lit((1 << _BITS) - 1)) < F.lit(int(share * (1 << _BITS)))


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    table = df.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


class Cells:
    """A fold, counted by cell once for each number of bins and each rate of drawing, for all settings tried on it."""

    def __init__(self, fold: DataFrame, info: Mapping[str, Any], seed: int):
        self.names = [c for c in fold.columns if c.startswith(INPUTS)]
        self.usable = "__row" in fold.columns and bool(self.names)
        self.fold, self.info, self.seed = fold, info, seed
        self._grids: dict[int, Grid | None] = {}
        self._draws: dict[tuple, DataFrame] = {}
        self._rows: int | None = None
        self._lock = threading.Lock()

    def grid(self, max_bins: int) -> Grid | None:
        """The cells at so many bins per feature; None if the fold cannot be boosted by them."""
        if not self.usable:
            return None
        with self._lock:
            if max_bins not in self._grids:
                self._grids[max_bins] = self._grid(max_bins)
            return self._grids[max_bins]

    def _grid(self, max_bins: int) -> Grid | None:
        rows = self.fold.select(*self.names, "__label", "__valid", "__row")
        train = rows.filter("not __valid")
        if self._rows is None:
            self._rows = train.count()
        if not self._rows:
            return None
        bins = min(max_bins, self._rows)
        share = min(1.0, max(bins * bins, SPLIT_ROWS) / self._rows)
        seen = _arrays((train if share == 1 else train.filter(_drawn(share, self.seed, -1))).select(*self.names))
        cuts = [candidates(seen[c], bins) for c in self.names]
        possible = 1
        for c in cuts:
            possible *= len(c) + 1
        if possible >= 1 << 62 or not all(np.isfinite(c).all() for c in cuts):
            return None
        rows = _binned(rows, self.names, cuts)
        if possible > MAX_CELLS and rows.agg(F.approx_count_distinct("cell")).first()[0] > MAX_CELLS:
            return None
        valid, z = F.col("__valid"), F.col("__label")
        y = inverse_target(z, self.info, 1.0)
        found = _arrays(rows.groupBy("cell").agg(
            F.count_if(~valid).cast("double").alias("n"), F.coalesce(F.sum(F.when(~valid, z)), F.lit(0.0)).alias("s"),
            F.count_if(valid).cast("double").alias("valid"),
            *[f(F.when(valid, x)).alias(f"{mark}_{scale}") for scale, x in (("z", z), ("y", y))
              for mark, f in (("mean", F.avg), ("var", F.var_pop))]).orderBy("cell"))
        counts = {c: v for c, v in found.items() if c != "cell"}
        some = counts["valid"] > 0
        if not some.any() or not all(np.isfinite(v if c in ("n", "s", "valid") else v[some]).all() for c, v in counts.items()):
            return None
        used = [i for i, c in enumerate(cuts) if len(c)]
        return Grid([self.names[i] for i in used], [cuts[i] for i in used], found["cell"], counts, self.info)

    def _block(self, grid: Grid, max_bins: int, rate: float, first: int, last: int) -> DataFrame:
        """Per cell the rows drawn in the rounds from ``first`` to before ``last`` and the sum of their labels, stored."""
        key, rounds = (max_bins, rate, first, last), range(first, last)
        with self._lock:
            if key not in self._draws:
                rows = _binned(self.fold.filter("not __valid").select(*grid.names, "__label", "__row"), grid.names, grid.cuts)
                rows = rows.withColumns({f"__in{r}": _drawn(rate, self.seed, r) for r in rounds})
                self._draws[key] = settle(rows.groupBy("cell").agg(*[x for r in rounds for x in (
                    F.count_if(F.col(f"__in{r}")).cast("double").alias(f"n{r}"),
                    F.coalesce(F.sum(F.when(F.col(f"__in{r}"), F.col("__label"))), F.lit(0.0)).alias(f"s{r}"))]))
            return self._draws[key]

    def _rounds(self, grid: Grid, max_bins: int, rate: float, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per round the rows drawn from each cell and the sum of their labels."""
        if rate >= 1:
            for _ in range(cap):
                yield grid.counts["n"], grid.counts["s"]
            return
        step = max(1, min(BLOCK_ROUNDS, BLOCK_COUNTS // len(grid.cell)))
        for first in range(0, cap, step):
            last = min(cap, first + step)
            found = _arrays(self._block(grid, max_bins, rate, first, last))
            place = np.searchsorted(grid.cell, found["cell"])
            for r in range(first, last):
                n, s = np.zeros(len(grid.cell)), np.zeros(len(grid.cell))
                n[place], s[place] = found[f"n{r}"], found[f"s{r}"]
                yield n, s

    def boosted(self, grid: Grid, params: Mapping[str, Any]) -> Iterator[np.ndarray]:
        """What the trees predict for each cell after 1, 2, ... rounds, up to the cap."""
        bins, said = grid.bins, np.zeros(len(grid.cell))
        drawn = self._rounds(grid, int(params["maxBins"]), float(params.get("subsamplingRate", 1.0)), int(params["maxIter"]))
        for r, (n, s) in enumerate(drawn):
            # the first tree learns the labels, each further one twice what is left of them
            tree = grown(bins, grid.widths, n, 2 * (s - n * said) if r else s, int(params["maxDepth"]),
                         params.get("minInstancesPerNode", 1), params.get("minInfoGain", 0.0))
            said = said + (params["stepSize"] * tree if r else tree)
            yield said
