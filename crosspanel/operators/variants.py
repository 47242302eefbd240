"""Turnover-aware books: signal smoothing, weight blending, no-trade band.

A held book depends on yesterday's, and the rescale couples all names of a
date. But two numbers per date carry that coupling: the mean of the mixed
weights and their absolute sum around it. Given both for every date, each name's
path is its own recursion over its own dates. So names spread over all tasks,
and only the two numbers per book and date are unknown. They are found by
Newton's method in time: a pass evaluates all paths, the date sums they imply,
and how these hang on the numbers of earlier dates; the driver solves one
triangular system of the calendar's size per book. Every round settles at least
the first date that was open, so the rounds end although the band jumps. Books
of any policies and parameters go through the same rounds.

Names spread over tasks of at most ``CELLS_PER_TASK`` name-dates. Where a task
finds that it holds all names of a book, it needs no rounds: the sums over its
names are the book's, date by date.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.portfolio import DATE, build_weights
from crosspanel.session import bounded_like, stage

VARIANTS = ("baseline", "signal_smooth", "weight_blend", "no_trade_band")
POLICIES = ("weight_blend", "no_trade_band")
SPAN, BAND_SPAN = 256, 32      # dates that one round solves for at most; a band that jumps settles few at once
SETTLED = 1e-13                # of a date's absolute sum
CELLS_PER_TASK = 2_000_000     # names times dates of a task: 16 MB of targets
STRIDE = 0.3                   # longest step of a size's logarithm, and of a mean in mean sizes


def smooth_signal(df: DataFrame, pred: str, k: int = 4) -> DataFrame:
    """Mean of the last ``k`` rows of each entity, this one included; nulls skipped."""
    frame = Window.partitionBy("ticker").orderBy(DATE).rowsBetween(-(k - 1), 0)
    return df.withColumn(pred, F.avg(pred).over(frame))


class Book:
    """One book's policy, and the mean and absolute sum per date as far as they are known."""

    def __init__(self, policy: str, blend: float, band: float, gross: float, n_dates: int, n_names: int = 0):
        self.n_names, self.policy, self.blend, self.band, self.gross = n_names, policy, blend, band, gross
        self.mean, self.size = np.zeros(n_dates), np.full(n_dates, gross)
        self.settled = 1       # the first date's holdings are its targets

    @property
    def end(self) -> int:
        return min(len(self.mean), self.settled + (SPAN if self.policy == "weight_blend" else BAND_SPAN))

    def mix(self, target: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mixed weights, how they move with yesterday's)."""
        if self.policy == "weight_blend":
            return self.blend * target + (1.0 - self.blend) * before, np.full(len(target), 1.0 - self.blend)
        keeps = np.abs(target - before) <= self.band
        return np.where(keeps, before, target), keeps.astype(float)

    def hold(self, mixed: np.ndarray, t: int) -> np.ndarray:
        held = mixed - self.mean[t]
        return held / self.size[t] * self.gross if self.size[t] > 0 else held

    def paths(self, targets: np.ndarray) -> np.ndarray:
        """Holdings of every name (rows) and date; NaN where a name is absent."""
        held = targets.copy()
        for t in range(1, targets.shape[1]):
            mixed, _ = self.mix(targets[:, t], np.nan_to_num(held[:, t - 1]))
            held[:, t] = self.hold(mixed, t)
        return held

    def settle(self, targets: np.ndarray) -> None:
        """All dates one after another, the book's names being at hand."""
        before = np.nan_to_num(targets[:, 0])
        for t in range(1, len(self.mean)):
            there = np.isfinite(targets[:, t])
            mixed = self.mix(np.where(there, targets[:, t], 0.0), before)[0][there]
            self.mean[t] = mixed.mean() if len(mixed) else 0.0
            self.size[t] = np.abs(mixed - self.mean[t]).sum()
            before = np.zeros(len(targets))
            before[there] = self.hold(mixed, t)
        self.settled = len(self.mean)

    def sums(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Date sums over names, and their slopes in earlier dates' (mean, size), of the dates being solved.

        The first has rows (names, mixed, absolute, signs); the second is
        (slope of mixed or absolute sum, of mean or size, date, earlier date).
        """
        low, high = self.settled, self.end
        span = high - low
        out, slopes = np.zeros((4, span)), np.zeros((2, 2, span, span))
        before, moves = np.zeros(len(targets)), np.zeros((2, len(targets), span))
        for t in range(high):
            there = np.isfinite(targets[:, t])
            if t == 0:
                before = np.where(there, targets[:, t], 0.0)
                continue
            mixed, keeps = self.mix(targets[:, t], before)
            mixed = np.where(there, mixed, 0.0)
            before = np.where(there, self.hold(mixed, t), 0.0)
            if t < low:
                continue
            k = t - low
            sign = np.where(there, np.sign(mixed - self.mean[t]), 0.0)
            out[:, k] = there.sum(), mixed.sum(), (np.abs(mixed - self.mean[t]) * there).sum(), sign.sum()
            moved = moves[:, :, :k] * (keeps * there)[None, :, None]
            slopes[0, :, k, :k], slopes[1, :, k, :k] = moved.sum(axis=1), np.einsum("n,xnj->xj", sign, moved)
            scale = self.gross / self.size[t] if self.size[t] > 0 else 1.0
            moves[:, :, :k] = moved * scale
            moves[0, :, k] = -scale * there
            moves[1, :, k] = -before / self.size[t] if self.size[t] > 0 else 0.0
        return out, slopes

    def advance(self, out: np.ndarray, slopes: np.ndarray) -> None:
        """One Newton step from the summed parts; moves the settled prefix on."""
        n, mixed, absolute, signs = out
        low, high, span = self.settled, self.end, out.shape[1]
        n, now = np.maximum(n, 1.0), self.size[low:high]
        off = mixed / n - self.mean[low:high]
        near = np.maximum(n * np.abs(off), np.abs(absolute - now)) <= SETTLED * absolute
        done = int(np.argmin(near)) if not near.all() else span
        # Sizes move by their logarithms, so they stay positive; steps beyond where slopes hold are cut short.
        live = (absolute > 0) & (now > 0)
        size, per = np.where(live, now, 1.0), np.where(live, absolute, 1.0)
        gap = np.concatenate([off, np.where(live, np.log(per / size), 0.0)])
        system = np.eye(2 * span)
        for block, unit in ((0, np.ones(span)), (1, size)):
            at = slice(block * span, (block + 1) * span)
            system[:span, at] -= slopes[0, block] / n[:, None] * unit
            system[span:, at] -= np.where(live[:, None], slopes[1, block] / per[:, None] * unit, 0.0)
        system[span:, :span] += np.diag(np.where(live, signs / per, 0.0))
        step = np.linalg.solve(system, gap)
        mean = self.mean[low:high] + np.clip(step[:span], -STRIDE * absolute / n, STRIDE * absolute / n)
        if done < span:         # all before this date stands, so its own mean is exact
            mean[done] = mixed[done] / n[done]
        self.mean[low:high] = mean
        self.size[low:high] = np.where(live, size * np.exp(np.clip(step[span:], -STRIDE, STRIDE)), absolute)
        self.settled = low + done
        last = self.size[self.settled - 1] if self.settled > 1 else self.gross
        self.size[max(high, self.settled) :] = last if last > 0 else self.gross


def _targets(column: pa.Array, days: pa.Array, n_dates: int) -> np.ndarray:
    """Names by dates from arrays of weights and of date numbers."""
    out = np.full((len(column), n_dates), np.nan)
    counts = np.diff(days.offsets.to_numpy())
    out[np.repeat(np.arange(len(days)), counts), days.flatten().to_numpy()] = column.flatten().to_numpy()
    return out


def _by_book(batches, books):
    """(book, batch, targets of its names), a part of a batch at a time."""
    for batch in batches:
        names = batch.column("book").to_numpy(zero_copy_only=False)
        for book in np.unique(names):
            part = batch.filter(pa.array(names == book))
            # An absent weight column entry is no target: build_weights gives none.
            yield book, part, _targets(part.column("weights"), part.column("days"), len(books[book].mean))


SUMS, WHOLE = -1, -2           # rows of a date's sums, of a whole book's means and sizes; others are slopes


def _round(series: DataFrame, books: dict[str, Book]) -> None:
    """One pass over all names; moves every open book on."""
    live = {b: book for b, book in books.items() if book.settled < len(book.mean)}

    def run(batches):
        held = {}
        for book, _, targets in _by_book(batches, live):
            held.setdefault(book, []).append(targets)
        for book, parts in held.items():
            whole, targets = live[book], np.concatenate(parts)
            if len(targets) == whole.n_names:
                whole.settle(targets)
                t, j = np.arange(len(whole.mean)), np.full(len(whole.mean), WHOLE)
                values = [whole.mean, whole.size, np.zeros(len(t)), np.zeros(len(t))]
            else:
                out, slopes = whole.sums(targets)
                span = out.shape[1]
                later, earlier = np.tril_indices(span, -1)
                t, j = np.concatenate([np.arange(span), later]), np.concatenate([np.full(span, SUMS), earlier])
                values = [np.concatenate([out[k], slopes[k // 2, k % 2][later, earlier]]) for k in range(4)]
            yield from pa.table({"book": pa.array([book] * len(t)), "t": pa.array(t, pa.int32()), "j": pa.array(j, pa.int32()),
                                 **dict(zip("abcd", map(pa.array, values)))}).to_batches()
    found = (series.where(F.col("book").isin(*live)).select("book", "days", "weights")
             .mapInArrow(run, "book string, t int, j int, a double, b double, c double, d double")
             .groupBy("book", "t", "j").agg(*[F.sum(c).alias(c) for c in "abcd"]).toArrow())
    names = found.column("book").to_numpy()
    for book in live:
        part = found.filter(pa.array(names == book))
        t, j = part.column("t").to_numpy(), part.column("j").to_numpy()
        if (j == WHOLE).any():
            live[book].mean[t], live[book].size[t] = part.column("a").to_numpy(), part.column("b").to_numpy()
            live[book].settled = len(live[book].mean)
            continue
        span = live[book].end - live[book].settled
        out, slopes = np.zeros((4, span)), np.zeros((2, 2, span, span))
        for k, c in enumerate("abcd"):
            values = part.column(c).to_numpy()
            out[k, t[j < 0]] = values[j < 0]
            slopes[k // 2, k % 2][t[j >= 0], j[j >= 0]] = values[j >= 0]
        live[book].advance(out, slopes)


def apply_policy(targets: DataFrame, blend: float = 0.4, band: float = 0.004, gross: float = 2.0,
                 rounds: list[int] | None = None, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """Holdings under each book's ``policy``, and its ``blend`` or ``band`` where ``targets`` has such columns.

    A name's holdings of the book's previous date count if it had any then; the
    first date holds its targets. ``rounds`` takes the number of rounds.
    """
    own = lambda c, default: F.col(c) if c in targets.columns else F.lit(float(default)).alias(c)
    targets = stage(targets.select("book", "policy", DATE, "ticker", "fwd_return", "weight", own("blend", blend), own("band", band)),
                    "policy-targets")
    dates = targets.select("book", DATE).distinct().withColumn(
        "day", (F.row_number().over(Window.partitionBy("book").orderBy(DATE)) - 1).cast("int"))
    # A row per book and name; its arrays are bounded by the calendar.
    series = stage(targets.join(F.broadcast(dates), ["book", DATE]).groupBy("book", "ticker").agg(
        F.sort_array(F.collect_list(F.struct("day", DATE, "weight", "fwd_return"))).alias("s")).select(
        "book", "ticker", F.col("s.day").alias("days"), F.col("s.weight").alias("weights"),
        F.col(f"s.{DATE}").alias("dates"), F.col("s.fwd_return").alias("forward")), "policy-series")
    rules = targets.groupBy("book").agg(
        F.count_distinct(DATE).alias("n"), F.count_distinct("ticker").alias("names"),
        *[F.first(c).alias(c) for c in ("policy", "blend", "band")])
    books = {r["book"]: Book(r["policy"], r["blend"], r["band"], gross, r["n"], r["names"]) for r in rules.collect()}
    if all(len(b.mean) * b.n_names <= cells_per_task for b in books.values()):
        series = series.repartition(max(1, len(books)), "book")
    made = 0
    while any(b.settled < len(b.mean) for b in books.values()):
        _round(series, books)
        made += 1
    if rounds is not None:
        rounds.append(made)

    def run(batches):
        for book, part, days in _by_book(batches, books):
            held = books[book].paths(days)
            there = part.column("days")
            counts = np.diff(there.offsets.to_numpy())
            flat = held[np.repeat(np.arange(len(there)), counts), there.flatten().to_numpy()]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("book"), part.column("ticker"), part.column("dates"), part.column("forward"),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["book", "ticker", "dates", "forward", "held"])
    held = series.mapInArrow(run, "book string, ticker string, dates array<date>, forward array<double>, held array<double>")
    return held.select("book", "ticker", F.inline(F.arrays_zip("dates", "forward", "held"))).select(
        "book", F.col("dates").alias(DATE), "ticker", F.col("forward").alias("fwd_return"), F.col("held").alias("weight"))


def build_variant(df: DataFrame, pred: str, variant: str, smooth_k: int = 4, blend: float = 0.4,
                  band: float = 0.004, gross: float = 2.0, **limits) -> DataFrame:
    """Weights of one model under one turnover policy, book ``{pred}:{variant}``."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    rows = smooth_signal(df, pred, smooth_k) if variant == "signal_smooth" else df
    rows = bounded_like(rows.withColumn("book", F.lit(f"{pred}:{variant}")), df)
    weights = build_weights(rows, pred, gross=gross, **limits)
    if variant not in POLICIES:
        return weights
    return apply_policy(weights.withColumn("policy", F.lit(variant)), blend, band, gross)


def _grid(values) -> list[float]:
    return [float(v) for v in values] if isinstance(values, (list, tuple)) else [float(values)]


def sweep(df: DataFrame, preds: list[str], variants: tuple[str, ...] = VARIANTS, smooth_k: int = 4,
          blend: float | list[float] = 0.4, band: float | list[float] = 0.004, gross: float = 2.0, **limits) -> DataFrame:
    """Every model under every variant, all books in the same jobs and rounds.

    Lists for ``blend`` or ``band`` give a book for each value, named
    ``{pred}:{variant}:{value}``.
    """
    unknown = [v for v in variants if v not in VARIANTS]
    if unknown:
        raise ValueError(f"unknown variant: {unknown[0]}")
    parts = []
    for pred in preds:
        beta = ["beta"] if "beta" in df.columns else []
        plain = df.select(DATE, "ticker", "fwd_return", "sector", *beta, F.col(pred).alias("_signal"))
        if "baseline" in variants or set(variants) & set(POLICIES):
            parts.append(plain.withColumn("book", F.lit(f"{pred}:baseline")))
        if "signal_smooth" in variants:
            parts.append(smooth_signal(plain, "_signal", smooth_k)
                         .withColumn("book", F.lit(f"{pred}:signal_smooth")))
    signals = stage(reduce(DataFrame.unionByName, parts), "signals")
    base = stage(build_weights(signals, "_signal", gross=gross, **limits), "base-books")
    wanted = [f"{p}:{v}" for p in preds for v in variants if v not in POLICIES]
    out = base.where(F.col("book").isin(wanted))
    rules = []
    for policy, values in (("weight_blend", _grid(blend)), ("no_trade_band", _grid(band))):
        for v in values if policy in variants else ():
            name = policy if len(values) == 1 else f"{policy}:{v:g}"
            b, c = (v, 0.0) if policy == "weight_blend" else (0.0, v)
            rules.append(F.struct(F.lit(name).alias("name"), F.lit(policy).alias("policy"), F.lit(b).alias("blend"), F.lit(c).alias("band")))
    if rules:
        # Every policy and parameter starts from the same baseline targets.
        targets = (base.where(F.col("book").endswith(":baseline")).select("*", F.inline(F.array(*rules)))
                   .withColumn("book", F.concat(F.regexp_replace("book", "baseline$", ""), "name")).drop("name"))
        out = out.unionByName(apply_policy(targets, gross=gross))
    return out
