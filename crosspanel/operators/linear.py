"""Elastic Net over walk-forward folds from per-date sufficient statistics.

One pass over the rows yields, per date, the sums that determine every
least-squares fit. Any training set is a set of dates, so each fold, inner fold
and grid point is solved from summed statistics without reading rows again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.numeric import beside
from crosspanel.operators.evaluation import rank_ic
from crosspanel.operators.features import RANKS, TARGET, feature_tags
from crosspanel.operators.folds import date_index, fold_dates, inner_folds, walk_forward
from crosspanel.operators.groups import fits
from crosspanel.operators.order_stats import average_ranks
from crosspanel.session import bounded_like, stage

# The default fit and the search grid.
DEFAULT_CONFIG = [(0, 1e-3, 0.5)]
ENET_GRID = [(3 * i + j, a, r) for i, a in enumerate([1e-7, 1e-6, 1e-5, 1e-4, 1e-3])
             for j, r in enumerate([0.1, 0.5, 0.9])]
BOOSTING_GRID_SIZE = 4
MIN_TRAIN_ROWS = 200


def prepare(features: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a target; missing ranks take the neutral 0.5."""
    columns = columns or RANKS
    filled = [F.coalesce(F.col(c), F.lit(0.5)).alias(c) for c in columns]
    return bounded_like(features.where(F.col(TARGET).isNotNull()).select(
        "week_ending_friday", "ticker", TARGET, *filled), features)


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def date_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per date: count, sums and cross-products of the columns and the target."""
    x, y = [F.col(c) for c in columns], F.col(TARGET)
    total = lambda e: F.sum(e)                                  # noqa: E731
    return rows.groupBy("week_ending_friday").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"),
        F.array(*[total(a) for a in x]).alias("sx"),
        F.array(*[total(a * y) for a in x]).alias("sxy"),
        F.array(*[total(x[i] * x[j]) for i, j in _pairs(len(x))]).alias("sxx"))


def train_moments(moments: DataFrame, folds: DataFrame, dates: DataFrame, k: int) -> DataFrame:
    """Moments summed over each fold's training dates, folds under 200 rows dropped."""
    keys = [c for c in folds.columns if c in ("fold", "inner")]
    days = fold_dates(folds, dates, "train").join(moments, "week_ending_friday")

    def add(c: str, size: int) -> Column:
        return F.array(*[F.sum(F.col(c)[i]) for i in range(size)]).alias(c)
    return (days.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), add("sx", k),
                                    add("sxy", k), add("sxx", len(_pairs(k))))
            .where(F.col("n") >= MIN_TRAIN_ROWS))


def coordinate_descent(gram: np.ndarray, corr: np.ndarray, alpha: float, l1_ratio: float,
                       tol: float = 1e-13, max_iter: int = 20000) -> np.ndarray:
    """Minimize half the mean squared error plus the elastic-net penalty."""
    w = np.zeros(len(corr))
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    for _ in range(max_iter):
        biggest = 0.0
        for j in range(len(w)):
            if gram[j, j] == 0.0:
                continue
            pull = corr[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (gram[j, j] + l2)
            biggest = max(biggest, abs(new - w[j]))
            w[j] = new
        if biggest < tol:
            break
    return w


def fit(train: DataFrame, k: int, grid: list[tuple[int, float, float]] | None = None) -> DataFrame:
    """One row per fold and grid point.

    ``coef`` is on standardized columns (population deviation of the training
    rows); ``slope`` and ``const`` apply to raw columns.
    """
    grid = grid or DEFAULT_CONFIG
    keys = [c for c in train.columns if c in ("fold", "inner")]
    schema = ", ".join([f"{c} int" for c in keys] + [
        "config int", "alpha double", "l1_ratio double", "n long", "coef array<double>",
        "slope array<double>", "const double"])
    upper = _pairs(k)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, mean = float(row.n), np.asarray(row.sx) / row.n
                cross = np.zeros((k, k))
                for (i, j), v in zip(upper, row.sxx):
                    cross[i, j] = cross[j, i] = v / n
                cov = cross - np.outer(mean, mean)
                scale = np.sqrt(np.clip(np.diag(cov), 0.0, None))
                scale[scale < 1e-12] = 1.0
                gram = cov / np.outer(scale, scale)
                y_mean = row.sy / n
                corr = (np.asarray(row.sxy) / n - mean * y_mean) / scale
                for config, alpha, ratio in grid:
                    w = coordinate_descent(gram, corr, alpha, ratio)
                    slope = w / scale
                    out.append(tuple(getattr(row, c) for c in keys) + (
                        config, alpha, ratio, int(n), w.tolist(), slope.tolist(),
                        float(y_mean - slope @ mean)))
            yield pd.DataFrame(out, columns=keys + [
                "config", "alpha", "l1_ratio", "n", "coef", "slope", "const"])

    # A handful of rows, each with many solves: spread them over the cores.
    return train.repartition(train.sparkSession.sparkContext.defaultParallelism).mapInPandas(solve, schema)


def linear_prediction(columns: list[str]) -> Column:
    out = F.col("const")
    for i, c in enumerate(columns):
        out = out + F.col("slope")[i] * F.col(c)
    return out


def predict(rows: DataFrame, coefs: DataFrame, folds: DataFrame, dates: DataFrame,
            columns: list[str], name: str = "pred_enet") -> DataFrame:
    """Out-of-sample predictions; models reach rows through their test dates."""
    keys = [c for c in folds.columns if c in ("fold", "inner")]
    models = fold_dates(folds, dates, "test").join(coefs, keys)
    return rows.join(models, "week_ending_friday").select(
        "week_ending_friday", "ticker", TARGET, linear_prediction(columns).alias(name),
        *keys, "config")


def walk_forward_enet(features: DataFrame, n_folds: int = 8, min_train: int = 104, purge: int = 1,
                      embargo: int = 1, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, coefficients) of the plain walk-forward Elastic Net."""
    columns = columns or RANKS
    rows = prepare(features, columns)
    dates = date_index(rows)
    folds = walk_forward(dates, n_folds, min_train, purge, embargo)
    coefs = fit(train_moments(date_moments(rows, columns), folds, dates, len(columns)), len(columns))
    return predict(rows, coefs, folds, dates, columns).drop("config"), coefs


def nested_enet(features: DataFrame, n_folds: int = 6, n_inner: int = 3, min_train: int = 104,
                purge: int = 1, embargo: int = 1, grid: list | None = None,
                columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, chosen coefficients): configs picked on inner folds only.

    The config with the best mean inner rank correlation wins, the earlier one
    on ties; without any inner score the first config is used.
    """
    columns, grid = columns or RANKS, grid or ENET_GRID
    k = len(columns)
    rows = prepare(features, columns)
    dates = stage(date_index(rows), "dates")
    moments = stage(date_moments(rows, columns), "moments")
    outer = walk_forward(dates, n_folds, min_train, purge, embargo)
    inner = inner_folds(outer, n_inner, purge, embargo)

    trials = stage(fit(train_moments(moments, inner, dates, k), k, grid), "trials")
    ic = _inner_scores(rows, trials, inner, dates, columns)
    scores = (ic.groupBy("fold", "inner", "config").agg(F.avg("ic").alias("ic"))
              .groupBy("fold", "config").agg(F.avg("ic").alias("score")))
    # Neighbouring penalties often rank alike; rounding keeps such ties ties,
    # whatever order their dates were averaged in.
    best = scores.groupBy("fold").agg(
        F.min(F.struct((-F.round("score", 12)).alias("loss"), "config")).alias("b")
    ).select("fold", F.col("b.config").alias("_best"))

    refits = fit(train_moments(moments, outer, dates, k), k, grid)
    chosen = stage(refits.join(best, "fold", "left")
                   .where(F.col("config") == F.coalesce("_best", F.lit(grid[0][0]))).drop("_best"),
                   "chosen-models")
    return predict(rows, chosen, outer, dates, columns), chosen


def _inner_scores(rows: DataFrame, trials: DataFrame, inner: DataFrame, dates: DataFrame,
                  columns: list[str]) -> DataFrame:
    """Rank correlation of every (fold, inner, config, date).

    Dates that fit a task are scored there whole. Beyond that rows multiply by
    the grid and the ranking spreads them.
    """
    if fits(rows, ["week_ending_friday"]):
        return _scores_by_date(rows, trials, inner, dates, columns)
    ranked = average_ranks(rows, ["week_ending_friday"], [TARGET], pct=False, small=False)
    models = trials.groupBy("fold", "inner").agg(
        F.collect_list(F.struct("config", "slope", "const")).alias("_models"))
    tested = ranked.join(F.broadcast(fold_dates(inner, dates, "test")), "week_ending_friday")
    tried = (tested
             .join(F.broadcast(models), ["fold", "inner"])
             .select("fold", "inner", "week_ending_friday", TARGET, TARGET + "_rank", *columns,
                     F.inline("_models"))
             .select("fold", "inner", "config", "week_ending_friday", TARGET, TARGET + "_rank",
                     linear_prediction(columns).alias("pred")))
    return rank_ic(stage(tried, "inner-predictions"), "pred", ["fold", "inner", "config"],
                   target_rank=TARGET + "_rank", small=False)


MIN_PAIRS = 5       # dates with fewer rows have no rank correlation


def ranks_of(x: np.ndarray) -> np.ndarray:
    """Average ranks within each column, from 1."""
    order = np.argsort(x, axis=0, kind="stable")
    out = np.empty(x.shape)
    for c in range(x.shape[1]):
        at = order[:, c]
        starts = np.flatnonzero(np.r_[True, np.diff(x[at, c]) != 0])
        counts = np.diff(np.r_[starts, len(at)])
        out[at, c] = np.repeat(starts + (counts + 1) / 2, counts)
    return out


def rank_correlations(predicted: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rank correlation of each column with ``target``; NaN where either has one value only."""
    n = len(target)
    p, y = ranks_of(predicted) - (n + 1) / 2, ranks_of(target[:, None])[:, 0] - (n + 1) / 2
    size = np.sqrt((p * p).sum(axis=0) * (y * y).sum())
    return np.where(size > 0, (p * y[:, None]).sum(axis=0) / np.where(size > 0, size, 1.0), np.nan)


def _scores_by_date(rows: DataFrame, trials: DataFrame, inner: DataFrame, dates: DataFrame,
                    columns: list[str]) -> DataFrame:
    """Every model that a date tests, as columns of one matrix in that date's task.

    Models and test dates are as many as grid points and the calendar. Columns
    are summed feature by feature, so that equal rows predict alike wherever
    they stand; slopes that are a positive multiple of another's rank alike and
    are ranked once.
    """
    models: dict = {}
    for m in trials.select("fold", "inner", "config", "slope", "const").collect():
        models.setdefault((m["fold"], m["inner"]), []).append((m["config"], m["slope"], m["const"]))
    tested: dict = {}
    for t in fold_dates(inner, dates, "test").collect():
        tested.setdefault(t["week_ending_friday"], []).append((t["fold"], t["inner"]))

    def score(key, table):
        n = table.num_rows
        cells = [(*span, *model) for span in tested.get(key[0].as_py(), []) for model in models.get(span, [])]
        if n < MIN_PAIRS or not cells:
            return _SCORES.empty_table()
        slopes, consts = np.array([c[3] for c in cells]), np.array([c[4] for c in cells])
        norm = np.abs(slopes).max(axis=1, keepdims=True)
        _, first, same = np.unique(np.round(slopes / np.where(norm > 0, norm, 1.0), 13), axis=0, return_index=True, return_inverse=True)
        predicted = np.tile(consts[first], (n, 1))
        for j, c in enumerate(columns):
            predicted += table.column(c).to_numpy()[:, None] * slopes[first, j]
        ic = rank_correlations(predicted, table.column(TARGET).to_numpy())[same.ravel()]
        kept = [(*c[:3], key[0].as_py(), float(v)) for c, v in zip(cells, ic) if np.isfinite(v)]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*kept), _SCORES)], schema=_SCORES) if kept else _SCORES.empty_table()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    wanted = fold_dates(inner, dates, "test").select("week_ending_friday").distinct()
    return (rows.join(F.broadcast(wanted), "week_ending_friday", "left_semi")
            .select("week_ending_friday", TARGET, *columns).repartition(tasks, "week_ending_friday")
            .groupBy("week_ending_friday").applyInArrow(
                score, "fold int, inner int, config int, week_ending_friday date, ic double"))


_SCORES = pa.schema([("fold", pa.int32()), ("inner", pa.int32()), ("config", pa.int32()),
                     ("week_ending_friday", pa.date32()), ("ic", pa.float64())])


def coefficient_table(coefs: DataFrame) -> DataFrame:
    """Mean standardized coefficient per feature over the folds."""
    tags = feature_tags(coefs.sparkSession)
    mean = (coefs.select(F.posexplode("coef").alias("ordinal", "coef"))
            .groupBy("ordinal").agg(F.avg("coef").alias("coef")))
    return mean.join(tags, "ordinal").select(
        "feature", F.concat_ws("/", "origin", "bucket").alias("category"), "coef")


def nested_summary(coefs: DataFrame, n_inner: int = 3, grid_size: int = len(ENET_GRID),
                   boosting_grid: int = BOOSTING_GRID_SIZE) -> DataFrame:
    """Total fits, non-zero mean coefficients and external features retained."""
    table = coefficient_table(coefs)
    alive = F.abs("coef") > 1e-12
    kept = table.agg(
        F.count_if(alive).alias("nonzero_coefficients"),
        F.count_if(alive & F.col("category").startswith("external")).alias("external_retained"))
    fits = coefs.agg((F.count_distinct("fold") * (grid_size + boosting_grid) * n_inner).alias("total_fits"))
    return beside(kept, fits)
