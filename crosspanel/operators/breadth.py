"""Pairwise-complete correlations and the effective number of independent bets.

Entities are dealt into blocks and every pair of blocks is one task: products
of masked matrices give, for all its pairs at once, the shared weeks, their
sums, squares and cross-products, hence each pair's correlation over the weeks
that both have. No pair is joined row by row and no entity meets more than a
block of others in one task.

Over unequal weeks the correlation matrix can have negative eigenvalues, which
do not count as bets. Where every entity has the same weeks, sum and square sum
of the eigenvalues are the trace and the squared norm. Otherwise up to
``EIGEN_NAMES`` entities are decomposed in one task, and more by block Jacobi
rotations over the staged blocks: each round pairs the blocks, diagonalizes
every pair's own square in a task and turns all squares of pairs by those
rotations. The off-diagonal norm falls with every round and bounds the error of
the diagonal, which in the end holds the eigenvalues.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.numeric import beside, ratio
from crosspanel.session import stage, unstage

DATE = "week_ending_friday"
PAIR_BLOCK = 512                # entities per side of a task
EIGEN_NAMES = 4096              # entities whose matrix one task decomposes: 128 MB
MOST_ROUNDS = 100               # sweeps of block rotations before giving up


def entity_series(panel: DataFrame, value: str = "weekly_return") -> DataFrame:
    """(ticker, days, values, n): one bounded array pair per entity with any value."""
    dates = (panel.select(DATE).distinct()
             .withColumn("_d", (F.row_number().over(Window.orderBy(DATE)) - 1).cast("int")))
    return (panel.where(F.col(value).isNotNull()).join(dates, DATE).groupBy("ticker").agg(
        F.collect_list(F.struct("_d", F.col(value).alias("_v"))).alias("_s"))
        .select("ticker", F.col("_s._d").alias("days"), F.col("_s._v").alias("values"),
                F.size("_s").alias("n")))


def correlate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared columns, correlation over them) of every row of ``x`` with every row of ``y``.

    NaN marks what is missing. Rows are centred and scaled first, which changes
    no correlation and keeps the sums apart. A pair without variation on its
    shared columns has correlation 0.
    """
    def parts(a):
        there = np.isfinite(a)
        n = np.maximum(there.sum(axis=1, keepdims=True), 1)
        filled = np.where(there, a, 0.0)
        a = np.where(there, filled - filled.sum(axis=1, keepdims=True) / n, 0.0)
        size = np.sqrt((a * a).sum(axis=1, keepdims=True) / n)
        largest = np.abs(filled).max(axis=1, keepdims=True)
        varies = size > 1e-14 * largest
        return there.astype(float), np.where(varies, a / np.where(varies, size, 1.0), 0.0)

    (mx, zx), (my, zy) = parts(x), parts(y)
    n = mx @ my.T
    some = np.maximum(n, 1.0)
    sx, sy = zx @ my.T, mx @ zy.T
    xx, yy = (zx * zx) @ my.T, mx @ (zy * zy).T
    vx, vy = xx - sx * sx / some, yy - sy * sy / some
    moves = (n > 1) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy)
    size = np.sqrt(np.where(moves, vx * vy, 1.0))
    return n.astype(np.int64), np.where(moves, np.clip((zx @ zy.T - sx * sy / some) / size, -1.0, 1.0), 0.0)


def _matrix(pdf: pd.DataFrame, n_dates: int) -> np.ndarray:
    x = np.full((len(pdf), n_dates), np.nan)
    for i, (days, values) in enumerate(zip(pdf["days"], pdf["values"])):
        x[i, np.asarray(days)] = np.asarray(values)
    return x


def _block(n_blocks: int) -> Column:
    return F.pmod(F.xxhash64("ticker"), F.lit(n_blocks)).cast("int")


def _in_blocks(series: DataFrame, n_blocks: int, n_dates: int, kernel, schema: str) -> DataFrame:
    """``kernel(bi, bj, names i, names j, shared, correlation)`` over every pair of blocks, bi <= bj.

    Names are (ticker, own weeks) in the order of tickers.
    """
    dealt = series.withColumn("_b", _block(n_blocks)).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(
        F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), "_b", "ticker", "days", "values")

    def run(key, pdf):
        bi, bj = (int(k) for k in key)
        pdf = pdf.sort_values("ticker")
        left, right = pdf[pdf["_b"] == bi], pdf[pdf["_b"] == bj]
        n, r = correlate(_matrix(left, n_dates), _matrix(right, n_dates))
        names = lambda side: (side["ticker"].to_numpy(), side["days"].map(len).to_numpy(np.int64))
        return kernel(bi, bj, names(left), names(right), n, r)
    return dealt.groupBy("bi", "bj").applyInPandas(run, schema)


def _dealt(panel: DataFrame, value: str, block: int) -> tuple[DataFrame, int, int, int]:
    """Staged series, their number, the number of blocks and of dates."""
    series = stage(entity_series(panel, value), "entity-series")
    n_names = series.count()
    return series, n_names, max(1, -(-n_names // block)), panel.select(DATE).distinct().count()


def pairwise_correlations(panel: DataFrame, value: str = "weekly_return", block: int = PAIR_BLOCK) -> DataFrame:
    """(ticker_a, ticker_b, n_shared, correlation) of every pair of entities with any value, a before b.

    Only weeks that both have count; without variation on them the correlation
    is 0.
    """
    series, _, n_blocks, n_dates = _dealt(panel, value, block)

    def kernel(bi, bj, left, right, n, r):
        a, b = left[0], right[0]
        i, j = np.triu_indices(len(a), 1) if bi == bj else (x.ravel() for x in np.indices(r.shape))
        first = a[i] < b[j]
        return pd.DataFrame({"ticker_a": np.where(first, a[i], b[j]), "ticker_b": np.where(first, b[j], a[i]),
                             "n_shared": n[i, j], "correlation": r[i, j]})
    return _in_blocks(series, n_blocks, n_dates, kernel,
                      "ticker_a string, ticker_b string, n_shared long, correlation double")


MATRIX = "bi int, bj int, i int, r array<double>"


def correlation_matrix(series: DataFrame, n_blocks: int, n_dates: int) -> DataFrame:
    """A row per entity and block of others at or behind its own: correlations and counts of incomplete pairs.

    ``i`` is the entity's place in its block, in the order of names; the block
    on the diagonal is whole.
    """
    def kernel(bi, bj, left, right, n, r):
        unequal = (n != left[1][:, None]) | (n != right[1][None, :])
        same = bi == bj
        return pd.DataFrame({
            "bi": bi, "bj": bj, "i": np.arange(len(r)), "r": list(r),
            "gaps": unequal.sum(axis=1) * (0.5 if same else 1.0), "one": np.diag(r) if same else 0.0})
    return _in_blocks(series, n_blocks, n_dates, kernel, MATRIX + ", gaps double, one double")


def _positive_in_task(matrix: DataFrame) -> DataFrame:
    """(positive, positive_squares) by one decomposition of the gathered matrix."""
    def run(pdf):
        sizes = pdf[pdf["bi"] == pdf["bj"]].groupby("bi").size().sort_index()
        first = dict(zip(sizes.index, np.concatenate([[0], np.cumsum(sizes)])))
        c = np.zeros((int(sizes.sum()),) * 2)
        for bi, bj, i, r in zip(pdf["bi"], pdf["bj"], pdf["i"], pdf["r"]):
            at, to = first[bi] + i, first[bj]
            c[at, to : to + len(r)] = r
            c[to : to + len(r), at] = r
        eig = np.linalg.eigvalsh(c)
        eig = eig[eig > 0]
        return pd.DataFrame({"positive": [eig.sum()], "positive_squares": [(eig * eig).sum()]})
    return matrix.groupBy().applyInPandas(run, "positive double, positive_squares double")


def tournament(n: int) -> list[list[tuple[int, int]]]:
    """Rounds in which every two of ``n`` blocks meet once; with odd ``n`` one of each round stays alone."""
    ring = [*range(n), *([n] if n % 2 else [])]
    rounds = []
    for _ in range(len(ring) - 1):
        rounds.append([(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], reversed(ring))])
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def _square(pdf: pd.DataFrame, rows: tuple, cols: tuple, sizes: dict) -> np.ndarray:
    """The square of the blocks ``rows`` against ``cols`` from matrix rows stored on either side of the diagonal."""
    top = {b: o for b, o in zip(rows, np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in rows])]))}
    left = {b: o for b, o in zip(cols, np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in cols])]))}
    c = np.zeros((sum(sizes.get(b, 0) for b in rows), sum(sizes.get(b, 0) for b in cols)))
    for bi, bj, i, r in zip(pdf["bi"], pdf["bj"], pdf["i"], pdf["r"]):
        if bi in top and bj in left:
            c[top[bi] + i, left[bj] : left[bj] + len(r)] = r
        if bj in top and bi in left:
            c[top[bj] : top[bj] + len(r), left[bi] + i] = r
    return c


def _rotate(matrix: DataFrame, pairs: list[tuple[int, int]], sizes: dict) -> DataFrame:
    """``matrix`` after every pair of blocks has been diagonalized within itself."""
    of = {b: k for k, pair in enumerate(pairs) for b in pair}
    team = F.create_map(*[x for b, k in of.items() for x in (F.lit(b), F.lit(k))])
    k, last = len(pairs), F.lit(len(pairs) - 1)
    placed = matrix.select("bi", "bj", "i", "r", team[F.col("bi")].alias("_a"), team[F.col("bj")].alias("_b")).select(
        "bi", "bj", "i", "r", F.least("_a", "_b").alias("k"), F.greatest("_a", "_b").alias("l"))

    def diagonalize(key, pdf):
        pair = pairs[int(key[0])]
        _, u = np.linalg.eigh(_square(pdf, pair, pair, sizes))
        return pd.DataFrame({"t": int(key[0]), "i": np.arange(len(u)), "r": list(u[:, ::-1])})
    turns = stage(placed.where("k = l").groupBy("k").applyInPandas(diagonalize, "t int, i int, r array<double>"), "turns")

    # Every square of two pairs meets the rotations of both.
    sent = lambda side, ks, ls: turns.select(
        F.lit(side).alias("bi"), F.lit(side).alias("bj"), "i", "r", ks, ls)
    t, other = F.col("t"), lambda a, b: F.explode(F.sequence(a, b))
    parts = placed.unionByName(sent(-1, t.alias("k"), other(t, last).alias("l"))).unionByName(
        sent(-2, other(F.lit(0), t).alias("k"), t.alias("l")))

    def turn(key, pdf):
        a, b = pairs[int(key[0])], pairs[int(key[1])]
        sides = [pdf[pdf["bi"] == side].sort_values("i")["r"].to_list() for side in (-1, -2)]
        if not all(sides):          # a pair of blocks without entities
            return pd.DataFrame(columns=["bi", "bj", "i", "r", "one", "off"])
        u, v = (np.stack(side) for side in sides)
        c = u.T @ _square(pdf[pdf["bi"] >= 0], a, b, sizes) @ v
        out, top = [], 0
        for x in a:
            left = 0
            for y in b:
                part = c[top : top + sizes.get(x, 0), left : left + sizes.get(y, 0)]
                left += sizes.get(y, 0)
                if not part.size or (a == b and x > y):
                    continue
                part, p, q = (part, x, y) if x <= y else (part.T, y, x)
                diagonal = np.diag(part) if p == q else np.zeros(len(part))
                squares = (part * part).sum(axis=1) - diagonal ** 2
                out.append(pd.DataFrame({"bi": p, "bj": q, "i": np.arange(len(part)), "r": list(part),
                                         "one": diagonal, "off": squares * (1.0 if p == q else 2.0)}))
            top += sizes.get(x, 0)
        return pd.concat(out)
    return parts.groupBy("k", "l").applyInPandas(turn, MATRIX + ", one double, off double")


def _positive_by_blocks(matrix: DataFrame, n_blocks: int, squares: float, tolerance: float) -> DataFrame:
    """(positive, positive_squares) by block rotations, all in tasks of two pairs of blocks."""
    sizes = {r["bi"]: r["n"] for r in matrix.where("bi = bj").groupBy("bi").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = None
    for _ in range(MOST_ROUNDS):
        for pairs in tournament(n_blocks):
            after = stage(_rotate(matrix, pairs, sizes), "rotated")
            if before is not None:
                unstage(before)
            matrix = before = after
        if (matrix.agg(F.sum("off")).first()[0] or 0.0) <= tolerance ** 2 * squares:
            kept = F.when((F.col("bi") == F.col("bj")) & (F.col("one") > 0), F.col("one"))
            return matrix.agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias("positive"),
                              F.coalesce(F.sum(kept * kept), F.lit(0.0)).alias("positive_squares"))
    raise RuntimeError(f"block rotations have not settled in {MOST_ROUNDS} sweeps")


def effective_breadth(panel: DataFrame, value: str = "weekly_return", block: int = PAIR_BLOCK,
                      eigen_names: int = EIGEN_NAMES, tolerance: float = 1e-9) -> DataFrame:
    """One row: names, pairs, pairs with unequal weeks, mean correlation, effective bets.

    Effective bets are the squared sum over the square sum of the positive
    eigenvalues of the pairwise-complete correlation matrix. An entity that
    never varies has zeros in its row. No entities give nulls.
    """
    series, n_names, n_blocks, n_dates = _dealt(panel.where(F.col(value).isNotNull()), value, block)
    matrix = stage(correlation_matrix(series, n_blocks, n_dates), "correlations")
    square = F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x)
    total = F.aggregate("r", F.lit(0.0), lambda s, x: s + x)
    twice = F.when(F.col("bi") == F.col("bj"), 1.0).otherwise(2.0)
    sums = stage(matrix.agg(
        F.sum("one").alias("trace"), F.sum(total * twice).alias("entries"), F.sum(square * twice).alias("squares"),
        F.sum("gaps").cast("long").alias("n_incomplete")), "breadth-sums")
    row = sums.first()
    if not row["n_incomplete"]:
        positive = sums.select(F.col("trace").alias("positive"), F.col("squares").alias("positive_squares"))
    elif n_names <= eigen_names:
        positive = _positive_in_task(matrix)
    else:
        positive = _positive_by_blocks(matrix, n_blocks, row["squares"], tolerance)
    pairs = n_names * (n_names - 1) // 2
    return beside(sums, positive).select(
        F.lit(n_names).cast("long").alias("n_names"), F.lit(pairs).cast("long").alias("n_pairs"),
        F.coalesce("n_incomplete", F.lit(0)).cast("long").alias("n_incomplete"),
        ratio((F.col("entries") - F.col("trace")) / 2, F.lit(float(pairs))).alias("mean_correlation"),
        ratio(F.col("positive") * F.col("positive"), F.col("positive_squares")).alias("effective_bets"))


def fundamental_law(breadth: DataFrame, mean_ic: DataFrame, per_year: int = 52) -> DataFrame:
    """Implied and naive information ratio from effective and plain headcount."""
    ic = F.col("mean_rank_ic")
    return beside(breadth, mean_ic.select("mean_rank_ic")).select(
        "mean_rank_ic", F.col("effective_bets").alias("effective_names"),
        (F.col("effective_bets") * per_year).alias("breadth"),
        (ic * F.sqrt(F.col("effective_bets") * per_year)).alias("implied_ir"),
        (ic * F.sqrt(F.col("n_names") * F.lit(float(per_year)))).alias("naive_ir"))
