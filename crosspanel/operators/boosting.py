"""Gradient-boosted trees over walk-forward folds: one histogram learner for every fit.

Rank features are binned into bytes once. A tree grows level by level from
histograms (rows and summed residuals per node, feature and bin); the best
splits come first until the leaves are used up. Leaves are regularized, rows
and columns of each tree are drawn by a hash of the tree and the row's key, and
residuals are whole multiples of a power of two, so that sums do not hang on
the order of rows: however rows are dealt, or a task is repeated, the same
trees come out.

Fits whose training rows fit a task train side by side, a task per fit. Beyond
that all fits advance in lockstep: each pass sums the histograms of the open
nodes of all models at once, map side first, picks splits in tasks by model and
returns nothing but splits; predictions so far ride along with the rows and are
written anew every few trees. So jobs grow with trees times depth, not with
fits. Ensembles are node tables, as large as trees times leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.evaluation import rank_ic
from crosspanel.operators.features import FEATURE_TAGS, RANKS, TARGET
from crosspanel.operators.folds import date_index, inner_folds, walk_forward
from crosspanel.operators.linear import MIN_TRAIN_ROWS, prepare
from crosspanel.session import stage, unstage

# Fixed values: (leaves, learning rate, least rows of a leaf) of the default fit and of the grid.
DEFAULT_CONFIG = (15, 0.03, 50)
BOOSTING_GRID = [(leaves, 0.03, rows) for leaves in (7, 31) for rows in (50, 150)]
TREES = 300
ROW_SHARE, COLUMN_SHARE, LEAF_PENALTY = 0.8, 0.8, 1.0

BINS = 255
ROWS_PER_TASK = 1_000_000      # training rows of a fit that one task holds: some 30 MB
TREES_PER_STAGE = 10           # in lockstep, trees that rows are run through again before they are written anew
PRECISION = 24                 # bits below the largest residual

NODES = ("model int, tree int, node int, feature int, cut int, child int, value double, gain double, base double")


@dataclass(frozen=True)
class Fit:
    """A model to fit: dates before ``train_n`` train it."""
    model: int
    train_n: int
    leaves: int
    rate: float
    min_rows: int
    base: float = 0.0

    @property
    def depth(self) -> int:
        return math.ceil(math.log2(self.leaves))


# --- one tree -----------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_rows(keys: np.ndarray, tree: int) -> np.ndarray:
    """Which rows a tree sees, by hash of the tree and the row's key."""
    salt = np.uint64(0x9E3779B97F4A7C15 * (tree + 1) % 2**64)
    salted = _mixed(keys.astype(np.int64).view(np.uint64) + salt)
    return salted < np.uint64(int(ROW_SHARE * 2**64))


def drawn_columns(n: int, tree: int) -> np.ndarray:
    """Which columns a tree may split on, by hash of the tree and the column."""
    order = np.argsort(_mixed(np.arange(n, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(tree + 1)))
    return np.sort(order[: max(1, int(COLUMN_SHARE * n))])


class Tree:
    """Nodes in order of birth; a split node's children are ``child`` and the next."""

    def __init__(self):
        self.feature, self.cut, self.child, self.value, self.gain = [-1], [0], [0], [0.0], [0.0]
        self.open, self.leaves = [0], 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in so far."""
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = feature[node[rows]]
            rows = rows[f >= 0]
            if not len(rows):
                return node
            at = node[rows]
            node[rows] = child[at] + (bins[rows, feature[at]] > cut[at])

    def split(self, found: list[tuple], fit: Fit) -> None:
        """Take ``found`` (gain, feature, cut, left value, right value per open node), best first, while leaves last."""
        order = sorted((-gain, place) for place, (gain, *_) in enumerate(found) if gain > 0)
        opened = []
        for _, place in order[: fit.leaves - self.leaves]:
            gain, feature, cut, left, right = found[place]
            node = self.open[place]
            self.feature[node], self.cut[node], self.gain[node], self.child[node] = feature, cut, gain, len(self.feature)
            for value in (left, right):
                opened.append(len(self.feature))
                for column, x in zip((self.feature, self.cut, self.child, self.value, self.gain), (-1, 0, 0, value, 0.0)):
                    column.append(x)
        self.leaves += len(opened) // 2
        self.open = sorted(opened) if self.leaves < fit.leaves else []


def histograms(bins: np.ndarray, grads: np.ndarray, node: np.ndarray, nodes: list[int],
               columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, summed residuals) by (open node, column, bin) of rows in ``nodes``."""
    place = np.full(max(int(node.max(initial=0)), max(nodes)) + 1, -1)
    place[nodes] = np.arange(len(nodes))
    at = place[node]
    there = at >= 0
    at, bins, grads = at[there] * BINS, bins[there], grads[there]
    size = len(nodes) * BINS
    count, total = np.empty((len(columns), size), np.int64), np.empty((len(columns), size), np.int64)
    for k, c in enumerate(columns):
        cell = at + bins[:, c]
        count[k] = np.bincount(cell, minlength=size)
        total[k] = np.bincount(cell, grads, minlength=size)         # whole numbers, exact in a double
    shape = (len(columns), len(nodes), BINS)
    return count.reshape(shape).swapaxes(0, 1), total.reshape(shape).swapaxes(0, 1)


def best_splits(count: np.ndarray, total: np.ndarray, columns: np.ndarray, fit: Fit, unit: float) -> list[tuple]:
    """Per open node (gain, feature, cut, left value, right value); gain 0 where nothing may be split."""
    n, g = count.cumsum(axis=2), total.cumsum(axis=2) * unit
    all_n, all_g = n[:, :, -1:], g[:, :, -1:]
    right_n, right_g = all_n - n, all_g - g
    score = lambda s, m: s * s / (m + LEAF_PENALTY)
    gain = score(g, n) + score(right_g, right_n) - score(all_g, all_n)
    gain = np.where((n >= fit.min_rows) & (right_n >= fit.min_rows), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    out = []
    for i, b in enumerate(best):
        c, cut = divmod(int(b), BINS)
        leaf = lambda s, m: float(fit.rate * s[i, c, cut] / (m[i, c, cut] + LEAF_PENALTY))
        out.append((float(flat[i, b]), int(columns[c]), cut, leaf(g, n), leaf(right_g, right_n)))
    return out


def unit_of(largest: float) -> float:
    """The power of two that residuals are multiples of."""
    return 2.0 ** (math.ceil(math.log2(largest)) - PRECISION) if largest > 0 else 1.0


def residuals(y: np.ndarray, predicted: np.ndarray, unit: float) -> np.ndarray:
    return np.rint((y - predicted) / unit)


def grow(bins: np.ndarray, y: np.ndarray, keys: np.ndarray, fit: Fit, trees: int, unit: float) -> list[Tree]:
    """All trees of one fit, its training rows at hand."""
    made, predicted = [], np.full(len(y), fit.base)
    for t in range(trees):
        columns, seen = drawn_columns(bins.shape[1], t), drawn_rows(keys, t)
        b, grads, tree = bins[seen], residuals(y[seen], predicted[seen], unit), Tree()
        for _ in range(fit.depth):
            if not tree.open:
                break
            count, total = histograms(b, grads, tree.place(b), tree.open, columns)
            tree.split(best_splits(count, total, columns, fit, unit), fit)
        predicted += np.array(tree.value)[tree.place(bins)]
        made.append(tree)
    return made


def node_rows(model: int, first: int, made: list[Tree], base: float) -> pd.DataFrame:
    parts = [(np.full(len(t.feature), first + i), np.arange(len(t.feature)), t.feature, t.cut, t.child, t.value, t.gain)
             for i, t in enumerate(made)]
    names = ("tree", "node", "feature", "cut", "child", "value", "gain")
    return pd.DataFrame({"model": model, **{n: np.concatenate(c) for n, c in zip(names, zip(*parts))}, "base": base}).astype(
        {c: "int32" for c in ("model", "tree", "node", "feature", "cut", "child")})


# --- rows and fits ------------------------------------------------------------

def binned(features: DataFrame, columns: list[str]) -> DataFrame:
    """Staged (week_ending_friday, ticker, target, key, bins): ranks in (0, 1] as bytes, missing ones in the middle."""
    one = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.ceil(F.col(c) * BINS) - 1))
    packed = F.concat(*[F.unhex(F.lpad(F.hex(one(c).cast("long")), 2, "0")) for c in columns])
    return stage(prepare(features, columns).select(
        "week_ending_friday", "ticker", F.col(TARGET).cast("double").alias(TARGET),
        F.xxhash64("week_ending_friday", "ticker").alias("key"), packed.alias("bins")), "binned")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def _fits(rows: DataFrame, dates: DataFrame, folds: DataFrame, configs: dict) -> tuple[list[Fit], list[tuple]]:
    """Fits of every fold with enough training rows and any test row, and their (fold[, inner], config place) keys.

    ``configs`` gives the configs to fit by fold number; folds and dates are as small as the calendar.
    """
    keys = [c for c in folds.columns if c in ("fold", "inner")]
    by_date = (rows.groupBy("week_ending_friday").agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET).alias("y"))
               .join(dates, "week_ending_friday").orderBy("d").collect())
    n, y = np.array([r["n"] for r in by_date]), np.array([r["y"] for r in by_date])
    fits, names = [], []
    for f in folds.orderBy(*keys).collect():
        size = n[: f["train_n"]].sum()
        if size < MIN_TRAIN_ROWS or n[f["test_lo"] : f["test_hi"]].sum() == 0:
            continue
        for place, (leaves, rate, least) in configs[f["fold"]]:
            names.append((*[f[k] for k in keys], place, f["test_lo"], f["test_hi"]))
            fits.append(Fit(len(fits), f["train_n"], leaves, rate, least, round(float(y[: f["train_n"]].sum() / size), 12)))
    return fits, names


def train(rows: DataFrame, dates: DataFrame, fits: list[Fit], trees: int = TREES, width: int = len(RANKS),
          rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The staged node table (NODES) of all ``fits`` over ``rows`` as ``binned`` makes them."""
    rows = rows.join(F.broadcast(dates), "week_ending_friday")
    last = max((f.train_n for f in fits), default=0)
    rows = rows.where(F.col("d") < last)
    largest, n = rows.agg(F.max(F.abs(TARGET)), F.count(F.lit(1))).first()
    unit = unit_of(largest or 0.0)
    way = _train_in_tasks if n <= rows_per_task else _train_in_lockstep
    return way(rows, fits, trees, width, unit)


def _train_in_tasks(rows: DataFrame, fits: list[Fit], trees: int, width: int, unit: float) -> DataFrame:
    """A task per fit; a row goes to every fit that its date trains."""
    def run(key, table):
        fit = fits[key[0].as_py()]
        made = grow(_matrix(table.column("bins"), width), table.column(TARGET).to_numpy(),
                    table.column("key").to_numpy(), fit, trees, unit)
        return pa.Table.from_pandas(node_rows(fit.model, 0, made, fit.base), schema=_NODE_SCHEMA, preserve_index=False)

    spans = F.array(*[F.struct(F.lit(f.model).alias("model"), F.lit(f.train_n).alias("n")) for f in fits])
    dealt = rows.select(TARGET, "key", "bins", F.explode(
        F.transform(F.filter(spans, lambda s: s.n > F.col("d")), lambda s: s.model)).alias("model"))
    # Fits on the most rows come last; neighbours in cost land in different partitions.
    return stage(dealt.repartition(max(1, len(fits)), "model").groupBy("model").applyInArrow(run, NODES), "trees")


_NODE_SCHEMA = pa.schema([(n, {"int": pa.int32(), "double": pa.float64()}[k])
                          for n, k in (part.split() for part in NODES.split(", "))])


def _train_in_lockstep(rows: DataFrame, fits: list[Fit], trees: int, width: int, unit: float) -> DataFrame:
    """All fits level by level, a pass over the rows for each level of each tree."""
    spark = rows.sparkSession
    kept = rows.select("d", "key", TARGET, "bins", F.lit(None).cast("binary").alias("so_far"))
    state, done, late = stage(kept, "boosting-rows"), [], []          # late: trees not yet in so_far

    def arrays(batch, late):
        """(dates, keys, target, bins, predictions by model) of a batch, after the trees in ``late``."""
        bins = _matrix(batch.column("bins"), width)
        before = batch.column("so_far")
        if before.null_count:
            predicted = np.tile([f.base for f in fits], (len(bins), 1))
        else:
            predicted = np.frombuffer(b"".join(before.to_pylist()), float).reshape(-1, len(fits)).copy()
        for made in late:
            for m, tree in enumerate(made):
                predicted[:, m] += np.array(tree.value)[tree.place(bins)]
        return batch.column("d").to_numpy(), batch.column("key").to_numpy(), batch.column(TARGET).to_numpy(), bins, predicted

    def passed(t, now):
        """New splits of every open node: {model: found}."""
        columns, behind = drawn_columns(width, t), list(late)

        def count(batches):
            sums = {}
            for batch in batches:
                d, keys, y, bins, predicted = arrays(batch, behind)
                seen = drawn_rows(keys, t)
                for m, tree in enumerate(now):
                    mine = seen & (d < fits[m].train_n)
                    if tree.open and mine.any():
                        b = bins[mine]
                        part = histograms(b, residuals(y[mine], predicted[mine, m], unit), tree.place(b), tree.open, columns)
                        sums[m] = tuple(a + x for a, x in zip(sums[m], part)) if m in sums else part
            for m, (n, g) in sums.items():
                yield pa.RecordBatch.from_pydict(
                    {"model": pa.array([m], pa.int32()), "n": pa.array([np.ascontiguousarray(n).tobytes()]),
                     "g": pa.array([np.ascontiguousarray(g).tobytes()])})

        def pick(key, table):
            m = key[0].as_py()
            shape = (len(now[m].open), len(columns), BINS)
            n, g = (sum(np.frombuffer(x, np.int64).reshape(shape) for x in table.column(c).to_pylist()) for c in ("n", "g"))
            found = best_splits(n, g, columns, fits[m], unit)
            return pa.table({"model": pa.array([m] * len(found), pa.int32()), "place": pa.array(range(len(found)), pa.int32()),
                             **{c: pa.array(x) for c, x in zip(("gain", "feature", "cut", "left", "right"), zip(*found))}})

        out = (state.mapInArrow(count, "model int, n binary, g binary").groupBy("model")
               .applyInArrow(pick, "model int, place int, gain double, feature long, cut long, left double, right double"))
        found = {}
        for r in out.orderBy("model", "place").collect():              # a row per model and open node
            found.setdefault(r["model"], []).append((r["gain"], r["feature"], r["cut"], r["left"], r["right"]))
        return found

    for t in range(trees):
        now = [Tree() for _ in fits]
        for level in range(max(f.depth for f in fits)):
            for fit, tree in zip(fits, now):
                if level >= fit.depth:
                    tree.open = []
            if not any(tree.open for tree in now):
                break
            found = passed(t, now)
            for m, tree in enumerate(now):
                if tree.open:
                    tree.split(found.get(m) or [(0.0,) * 5] * len(tree.open), fits[m])
        done.append(now)
        late.append(now)
        if len(late) == TREES_PER_STAGE and t + 1 < trees:
            behind = list(late)

            def carried(batches):
                for batch in batches:
                    predicted = arrays(batch, behind)[-1]
                    at = batch.schema.get_field_index("so_far")
                    yield batch.set_column(at, "so_far", pa.array([row.tobytes() for row in predicted], pa.binary()))
            before, state = state, stage(state.mapInArrow(carried, state.schema), "boosting-rows")
            unstage(before)
            late.clear()
    unstage(state)
    parts = [node_rows(f.model, 0, [made[m] for made in done], f.base) for m, f in enumerate(fits)]
    return stage(spark.createDataFrame(pd.concat(parts), NODES), "trees")


def _ensembles(nodes: DataFrame) -> dict[int, tuple]:
    """(base, trees) of every model, each tree its arrays; as large as trees times leaves."""
    pdf = nodes.toPandas().sort_values(["model", "tree", "node"])
    out = {}
    for model, part in pdf.groupby("model"):
        trees = []
        for _, t in part.groupby("tree", sort=True):
            tree = Tree()
            tree.feature, tree.cut, tree.child, tree.value = (t[c].to_numpy() for c in ("feature", "cut", "child", "value"))
            trees.append(tree)
        out[int(model)] = (float(part["base"].iloc[0]), trees)
    return out


def predict(rows: DataFrame, dates: DataFrame, nodes: DataFrame, names: list[tuple], keys: list[str],
            width: int = len(RANKS)) -> DataFrame:
    """Out-of-sample predictions (week_ending_friday, ticker, target, pred_gbt, keys...) of every model's test rows.

    ``names[model]`` ends with the first test date and the one behind the last.
    """
    ensembles = rows.sparkSession.sparkContext.broadcast(_ensembles(nodes))
    kinds = {"pred_gbt": pa.float64(), **{k: pa.int32() for k in keys}}

    def run(batches):
        for batch in batches:
            d, bins = batch.column("d").to_numpy(), _matrix(batch.column("bins"), width)
            for m, name in enumerate(names):
                mine = np.flatnonzero((d >= name[-2]) & (d < name[-1]))
                if not len(mine):
                    continue
                base, trees = ensembles.value[m]
                predicted, b = np.full(len(mine), base), bins[mine]
                for tree in trees:
                    predicted += np.asarray(tree.value)[tree.place(b)]
                kept = batch.select(["week_ending_friday", "ticker", TARGET]).take(pa.array(mine))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *[pa.array(x, kinds[c]) for c, x in
                                      [("pred_gbt", predicted), *[(k, np.full(len(mine), v)) for k, v in zip(keys, name)]]]],
                    names=["week_ending_friday", "ticker", TARGET, *kinds])
    schema = f"week_ending_friday date, ticker string, {TARGET} double, pred_gbt double, " + ", ".join(f"{k} int" for k in keys)
    lows, highs = [n[-2] for n in names], [n[-1] for n in names]
    tested = rows.join(F.broadcast(dates), "week_ending_friday").where(
        F.col("d").between(min(lows, default=0), max(highs, default=0) - 1))
    return stage(tested.mapInArrow(run, schema), "boosted-predictions")


# --- walk-forward -------------------------------------------------------------

def walk_forward_gbt(features: DataFrame, n_folds: int = 8, min_train: int = 104, purge: int = 1,
                     embargo: int = 1, trees: int = TREES, columns: list[str] | None = None,
                     config: tuple = DEFAULT_CONFIG, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(predictions, node table with fold numbers) of the plain walk-forward fits.

    ``columns`` are cross-sectional ranks in (0, 1].
    """
    columns = columns or RANKS
    rows = binned(features, columns)
    dates = stage(date_index(rows), "dates")
    folds = stage(walk_forward(dates, n_folds, min_train, purge, embargo), "folds")
    fits, names = _fits(rows, dates, folds, {f: [(0, config)] for f in range(1, n_folds + 1)})
    nodes = train(rows, dates, fits, trees, len(columns), rows_per_task)
    preds = predict(rows, dates, nodes, names, ["fold"], len(columns))
    by_fold = F.create_map(*[x for f, n in zip(fits, names) for x in (F.lit(f.model), F.lit(n[0]))]) if fits else None
    numbered = nodes.withColumn("fold", by_fold[F.col("model")] if fits else F.lit(None).cast("int"))
    return preds, numbered


def nested_gbt(features: DataFrame, n_folds: int = 6, n_inner: int = 3, min_train: int = 104,
               purge: int = 1, embargo: int = 1, trees: int = TREES, grid: list | None = None,
               columns: list[str] | None = None, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, list]:
    """(predictions, chosen configs): the grid is scored on inner folds only.

    The config with the best mean inner rank correlation wins, the earlier one
    on ties; without any inner score the first config is used.
    """
    columns, grid = columns or RANKS, grid or BOOSTING_GRID
    rows = binned(features, columns)
    dates = stage(date_index(rows), "dates")
    outer = stage(walk_forward(dates, n_folds, min_train, purge, embargo), "folds")
    inner = stage(inner_folds(outer, n_inner, purge, embargo), "inner-folds")
    every = {f: list(enumerate(grid)) for f in range(1, n_folds + 1)}
    fits, names = _fits(rows, dates, inner, every)
    best: dict[int, int] = {}
    if fits:
        tried = predict(rows, dates, train(rows, dates, fits, trees, len(columns), rows_per_task), names,
                        ["fold", "inner", "config"], len(columns))
        scores = (rank_ic(tried, "pred_gbt", ["fold", "inner", "config"])
                  .groupBy("fold", "inner", "config").agg(F.avg("ic").alias("ic"))
                  .groupBy("fold", "config").agg(F.avg("ic").alias("score"))
                  .groupBy("fold").agg(F.min(F.struct((-F.round("score", 12)).alias("loss"), "config")).alias("b")))
        best = {r["fold"]: r["b"]["config"] for r in scores.collect()}   # a row per fold
    chosen = {f: [(best.get(f, 0), grid[best.get(f, 0)])] for f in every}
    fits, names = _fits(rows, dates, outer, chosen)
    nodes = train(rows, dates, fits, trees, len(columns), rows_per_task)
    preds = predict(rows, dates, nodes, names, ["fold"], len(columns))
    return preds, [(n[0], *chosen[n[0]][0][1]) for n in names]


def importance_table(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, category, gain_pct): gain summed over all splits, mean over the folds, as shares of 100.

    Every fold's ensemble counts with its total gain, once normalised at the end.
    """
    columns = columns or RANKS
    names = [c.removesuffix("_rank") for c in columns]
    tags = nodes.sparkSession.createDataFrame(
        [(i, f, "/".join(FEATURE_TAGS.get(f, ("", "")))) for i, f in enumerate(names)],
        "feature int, name string, category string")
    gains = nodes.where("feature >= 0").groupBy("feature").agg(F.sum("gain").alias("gain"))
    total = gains.agg(F.sum("gain").alias("total")).scalar()
    share = F.coalesce(100 * F.col("gain") / F.nullif(total, F.lit(0.0)), F.lit(0.0))
    return tags.join(gains, "feature", "left").select(F.col("name").alias("feature"), "category", share.alias("gain_pct"))
