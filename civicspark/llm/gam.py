"""A generalised additive model with pairwise interactions, and a quality score by it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import _slices, held_out, share_package, utf8
from civicspark.llm.shingles import IS_SPACE, LOWER, span_hashes, words

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 12_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "rare_marks", "marked_words",
    "non_ascii", "line_words", "short_lines", "lines_ended", "distinct_words", "top_word", "distinct_lines",
    "one_letter", "log_chars",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = ~(_LETTER | _DIGIT | IS_SPACE)
_RARE = _MARK.copy()
_RARE[list(b".,;:'\"-()")] = False


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text. Nothing but the text counts; an empty one has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, ends, at = words(data, offsets)
    count = np.diff(at)

    def total(flags: np.ndarray, borders: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[borders[1:]] - sums[borders[:-1]]

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    length = ends - starts
    last_mark = _MARK[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    rare_end = _RARE[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    breaks = data == 10
    lines = total(breaks, offsets) + (size > 0)
    hashes = span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)

    # Lines: their borders, within texts.
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:][breaks] = True
    line_start = np.flatnonzero(cut[:-1]) if len(data) else np.zeros(0, np.int64)
    line_at = np.searchsorted(line_start, offsets)
    line_end = np.r_[line_start[1:], len(data)] if len(line_start) else line_start
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    line_hash = span_hashes(data, line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
    final = np.maximum(line_end - 1 - (breaks[line_end - 1] if len(data) else 0), line_start) if len(data) else line_start
    ended = np.isin(data[final], np.frombuffer(b".!?", np.uint8)) if len(data) else np.zeros(0, bool)

    distinct, most, distinct_lines = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if count[i]:
            _, seen = np.unique(hashes[at[i] : at[i + 1]], return_counts=True)
            distinct[i], most[i] = len(seen), seen.max()
            distinct_lines[i] = len(np.unique(line_hash[line_at[i] : line_at[i + 1]]))
    return np.column_stack(
        [
            np.log1p(count), share(total(length, at), count), share(total(length > 14, at), count),
            share(total(_UPPER[data], offsets), size), share(total(_DIGIT[data], offsets), size),
            share(total(_MARK[data], offsets), size), share(total(_RARE[data], offsets), size),
            share(total(rare_end & last_mark, at), count), share(total(data > 127, offsets), size),
            np.log1p(share(count, lines)), share(total(line_words < 4, line_at), lines), share(total(ended, line_at), lines),
            share(distinct, count), share(most, count), share(distinct_lines, lines),
            share(total(length == 1, at), count), np.log1p(size),
        ]
    )


class AdditiveModel:
    """Lookup tables for single features and for pairs, learnt by cyclic boosting of shallow trees.

    In each round every feature in turn gets a tree of three leaves over its own bins, fitted
    to the gradient that all tables leave; the tree is added to the feature's table. The pairs
    whose residual gradient a grid explains best follow in the same way, with trees of four
    leaves. A score is the sum of one entry from each table.
    """

    def __init__(self, rounds: int = 60, rate: float = 0.15, ridge: float = 5.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        y = np.asarray(y, float)
        columns = x.shape[1] if x.ndim == 2 else 0
        quantile = np.linspace(0, 1, BINS + 1)[1:-1]
        coarse = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        some = len(y) > 0
        self.edges = [np.unique(np.quantile(x[:, j], quantile)) if some else np.zeros(0) for j in range(columns)]
        self.coarse = [np.unique(np.quantile(x[:, j], coarse)) if some else np.zeros(0) for j in range(columns)]
        rate = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(BINS) for _ in range(columns)]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if not some:
            return self
        bins = self._bins(x, self.edges)
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            for j in range(columns):
                step = self._steps(*self._sums(bins[j], BINS, score, y))
                self.tables[j] += step
                score += step[bins[j]]
        rough = self._bins(x, self.coarse)
        gains = []
        for a, b in combinations(range(columns), 2):
            g, h = self._sums(rough[a] * PAIR_BINS + rough[b], PAIR_BINS**2, score, y)
            gains.append((float((g * g / (h + self.ridge)).sum()), a, b))
        for _, a, b in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((a, b))
            self.grids.append(np.zeros((PAIR_BINS, PAIR_BINS)))
        for _ in range(self.rounds):
            for (a, b), grid in zip(self.pairs, self.grids, strict=True):
                cell = rough[a] * PAIR_BINS + rough[b]
                g, h = (s.reshape(PAIR_BINS, PAIR_BINS) for s in self._sums(cell, PAIR_BINS**2, score, y))
                step = self._cross(g, h)
                grid += step
                score += step.ravel()[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row."""
        total = np.full(len(x), self.start)
        for table, bins in zip(self.tables, self._bins(x, self.edges), strict=True):
            total += table[bins]
        if self.pairs:
            rough = self._bins(x, self.coarse)
            for (a, b), grid in zip(self.pairs, self.grids, strict=True):
                total += grid[rough[a], rough[b]]
        return 1 / (1 + np.exp(-total))

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]

    @staticmethod
    def _sums(bins: np.ndarray, size: int, score: np.ndarray, y: np.ndarray):
        p = 1 / (1 + np.exp(-score))
        return np.bincount(bins, y - p, size), np.bincount(bins, p * (1 - p), size)

    def _leaf(self, g, h):
        return self.rate * g / (h + self.ridge)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best split of a row of bins."""
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + self.ridge) + right_g**2 / (right_h + self.ridge)
        if not len(gain):
            return 0.0, len(g)
        k = int(np.argmax(gain))
        return float(gain[k] - g.sum() ** 2 / (h.sum() + self.ridge)), k + 1

    def _steps(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        _, first = self._cut(g, h)
        gain_l, left = self._cut(g[:first], h[:first])
        gain_r, right = self._cut(g[first:], h[first:])
        cuts = [0, left, first, len(g)] if gain_l >= gain_r else [0, first, first + right, len(g)]
        out = np.zeros(len(g))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = self._leaf(g[a:b].sum(), h[a:b].sum())
        return out

    def _cross(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree that splits one feature and each side by the other, the better way round."""
        best, out = -np.inf, np.zeros_like(g)
        for turned in (False, True):
            gg, hh = (g.T, h.T) if turned else (g, h)
            for first in range(1, len(gg)):
                step, gain = np.zeros_like(gg), 0.0
                for side in (slice(0, first), slice(first, None)):
                    a, b = gg[side].sum(0), hh[side].sum(0)
                    _, cut = self._cut(a, b)
                    for part in (slice(0, cut), slice(cut, None)):
                        s, t = a[part].sum(), b[part].sum()
                        gain += s * s / (t + self.ridge)
                        step[side, part] = self._leaf(s, t)
                if gain > best:
                    best, out = gain, step.T if turned else step
        return out


def _measured(batches):
    for batch in batches:
        for part in _slices(batch, "text"):
            rows = features(*utf8(part.column("text")))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "x"])


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fifth.

    The rows are those with the least hash of their id, so the choice is the same each time. Where
    documents share an id, the text with the least hash stands for them.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out("_id"))
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # At most ``rows`` pairs of numbers, however many documents there are.
    found = texts.join(F.broadcast(chosen), "_id")
    one = found.groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one"))
    return one.select("one.text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """A model of ``label`` from a bounded number of rows; only their features reach the driver."""
    share_package(docs.sparkSession)
    found = learning_rows(docs, labels, label, rows).mapInArrow(_measured, "label int, x array<double>").toArrow()
    y = found.column("label").to_numpy()
    x = np.array(found.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the sums of floats come out alike each time
    return AdditiveModel().fit(x[order], y[order])


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (or other ``names``); every other column is kept.

    A null text is scored as an empty one. Without labelled rows every
    score is 0.5. Repeated rows are scored alike. Columns of ``docs`` with
    those names are replaced.
    """
    share_package(docs.sparkSession)
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True)], names=["text"])
        parts = [model.score(features(*utf8(p.column("text")))) for p in _slices(batch, "text")]
        return pd.Series(np.concatenate([np.zeros(0), *parts]))

    scored = docs.withColumn(names[0], score(F.col("text").cast("string")))
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
