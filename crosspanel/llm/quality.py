"""Quality scores by an additive model with pairwise interactions (operator 9).

Cyclic boosting: shallow trees on one binned feature at a time, round after
round, then on pairs of features, each adding to look-up tables over bins. A
score is the logistic of an intercept plus one table entry for each feature and
pair, so whole batches are scored by additions of gathered bins.

The model is fitted from at most ``SAMPLE`` labelled documents, those with the
smallest hashes of doc_id; scoring covers every row. Features come from the text
alone. A null text is scored like an empty one. Without labelled rows every
score is 0.5; with labels of one kind only, every score leans to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import LOWER, byte_rows, free_name

SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 60, 30, 0.15

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "spaces", "stops", "pipes", "symbols",
    "high_bytes", "byte_entropy", "distinct_words", "top_word", "next_repeat", "distinct_lines", "line_words",
    "words_with_symbols", "long_words", "longest_run")

_SYMBOLS = b"#$%&*@<>{}[]\\^~=_/+"
_CLASS = np.zeros((256, 8), np.float32)
for _k, _set in enumerate((
        [*range(65, 91), *range(97, 123), *range(128, 256)], range(65, 91), range(48, 58), (32, 9, 10, 11, 12, 13),
        b".,;:!?", b"|", _SYMBOLS, range(128, 256))):
    _CLASS[list(_set), _k] = 1
#: Lower-cased, every symbol as the zero byte.
_PLAIN = bytes(0 if k in _SYMBOLS else int(LOWER[k]) for k in range(256))


def features(text: bytes) -> np.ndarray:
    """The feature vector of a whole text."""
    n = len(text)
    if not n:
        return np.zeros(len(FEATURES), np.float32)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    shares = counts @ _CLASS / n
    p = counts[counts > 0] / n
    words = text.translate(_PLAIN).split()
    m = max(1, len(words))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    same = np.flatnonzero(np.diff(data))
    run = int(np.diff(same, prepend=-1, append=n - 1).max())
    return np.array([
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, *shares, -(p * np.log2(p)).sum(),
        len(tally) / m, max(tally.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))),
        sum(b"\0" in w for w in words) / m, sum(len(w) > 20 for w in words) / m, np.log1p(run)], np.float32)


def feature_rows(column: pa.Array) -> np.ndarray:
    rows = [features(x) for x in byte_rows(column)]
    return np.stack(rows) if rows else np.zeros((0, len(FEATURES)), np.float32)


def _tree(gain: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Step values of a small tree over ordered bins: best splits by squared gradient over weight."""
    cuts = [0, len(gain)]
    g, w = np.concatenate([[0], np.cumsum(gain)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            k = np.arange(a + 1, b)
            if len(k):
                better = value(a, k) + value(k, b) - value(a, b)
                if better.max() > best[0]:
                    best = (better.max(), int(k[better.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gain))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _quadrants(gain: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut on each axis over a grid, and its four steps."""
    def corners(x):
        s = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
        s[1:, 1:] = x.cumsum(0).cumsum(1)
        inner = s[1:-1, 1:-1]
        left, top, full = s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return np.stack([inner, left - inner, top - inner, full - left - top + inner])
    g, w = corners(gain), corners(weight)
    value = (g ** 2 / (w + 1.0)).sum(0)
    i, j = np.unravel_index(value.argmax(), value.shape)
    step = g[:, i, j] / (w[:, i, j] + 1.0)
    out = np.empty(gain.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = step
    return float(value[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Bin edges, one table for each feature, tables for the strongest pairs, an intercept."""
    n, width = x.shape
    model = {"edges": [], "tables": [], "pairs": [], "base": 0.0}
    if not n:
        return model
    rate = np.clip(y.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
    model["base"] = float(np.log(rate / (1 - rate)))
    model["edges"] = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model["edges"])]
    model["tables"] = [np.zeros(len(e) + 1) for e in model["edges"]]
    at = np.full(n, model["base"])

    def slopes():
        p = 1 / (1 + np.exp(-at))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, w = slopes()
            size = len(model["tables"][f])
            step = RATE * _tree(np.bincount(bins[f], g, size), np.bincount(bins[f], w, size), 3)
            model["tables"][f] += step
            at += step[bins[f]]
    coarse = [np.arange(len(t)) * PAIR_BINS // max(len(t), 1) for t in model["tables"]]
    g, w = slopes()
    grid = lambda i, j, v: np.bincount(
        coarse[i][bins[i]] * PAIR_BINS + coarse[j][bins[j]], v, PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS)
    found = sorted(((_quadrants(grid(i, j, g), grid(i, j, w))[0], i, j)
                    for i in range(width) for j in range(i)), reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((PAIR_BINS, PAIR_BINS)) for _, i, j in found}
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in tables.items():
            g, w = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, w))[1]
            table += step
            at += step[coarse[i][bins[i]], coarse[j][bins[j]]]
    model["pairs"] = [(i, j, coarse[i], coarse[j], t) for (i, j), t in tables.items()]
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of feature rows: sums of gathered table entries through the logistic."""
    at = np.full(len(x), model["base"])
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model["edges"])]
    for f, table in enumerate(model["tables"]):
        at += table[bins[f]]
    for i, j, a, b, table in model["pairs"]:
        at += table[a[bins[i]], b[bins[j]]]
    return 1 / (1 + np.exp(-at))


def fold(doc_id: str = "doc_id", of: int = 3) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string")) % of


def _measure(batches):
    for batch in batches:
        x = feature_rows(batch.column(0))
        yield pa.RecordBatch.from_arrays([
            batch.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 1) -> dict:
    """Fit on labelled rows whose fold is not ``held_out``; a doc_id labelled twice counts by its majority."""
    known = labels.where(F.col("quality").isNotNull() & (fold() != held_out)).groupBy("doc_id").agg(
        (F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # As many rows as the sample: doc_ids that repeat among the documents add no more.
    got = rows.select("text", "y").mapInArrow(_measure, "y double, x array<float>").limit(sample).toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy())


def with_quality(docs: DataFrame, model: dict, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            made = scores(sent.value, feature_rows(column))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], [*batch.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{into}` double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` scored at ``least`` or more by a model trained on their own labels, columns unchanged, whatever their names."""
    into = free_name(docs, "quality_score")
    return with_quality(docs, train(docs, labels), into=into).where(
        F.col(into) >= least).select(*(f"`{c}`" for c in docs.columns))
