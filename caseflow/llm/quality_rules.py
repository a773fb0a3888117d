"""Quality rules by gradient-boosted trees over document statistics.

Trees are grown on a bounded sample of labelled rows (all, or some ``SAMPLE`` of them
drawn by hash if there are more): features are binned at quantiles, and each level's best
splits come from histograms of the logistic loss's gradients. For the features in
``FALLING`` the score may only fall as they rise: splits that would raise it are
refused, and both sides are bounded by the middle of the split from there on.

The trees are flattened into numpy node arrays; scoring moves all rows of a batch
down one level at a time.

Defined results: null and empty texts have zero counts and fail the base rule
(fewer than ten words). Labels that are null are not learned from. Without any
labelled row the trees are empty and keep what passes the base rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import cut, draw
from caseflow.llm.quality_classifier import held_out
from caseflow.llm.text_stats import COUNTS, FEATURES, features_of, text_counts

SAMPLE = 20_000
SEED = 23
TREES = 40
LEVELS = 3
BINS = 32
RATE = 0.2
SMOOTH = 1.0
LEAST_WEIGHT = 2.0
KEEP_FROM = 0.3
#: Features in which the score never rises.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "bars_per_word", "same_as_last_share")

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass
class Forest:
    """Complete binary trees of LEVELS levels, one row per tree."""

    start: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # go left if the feature is at most this
    value: np.ndarray  # (trees, leaves)

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _leaf(g, h):
    return -g / (h + SMOOTH)


def _gain(g, h):
    return g * g / (h + SMOOTH)


def _best_split(g_hist, h_hist, low, high, signs):
    """(gain, feature, bin, left value, right value) of the best allowed split of one node."""
    gl, hl = np.cumsum(g_hist, axis=1)[:, :-1], np.cumsum(h_hist, axis=1)[:, :-1]
    g, h = g_hist.sum(axis=1, keepdims=True), h_hist.sum(axis=1, keepdims=True)
    left, right = np.clip(_leaf(gl, hl), low, high), np.clip(_leaf(g - gl, h - hl), low, high)
    gain = _gain(gl, hl) + _gain(g - gl, h - hl) - _gain(g, h)
    allowed = (hl >= LEAST_WEIGHT) & (h - hl >= LEAST_WEIGHT) & (signs[:, None] * (right - left) >= 0)
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return gain[f, b], f, b, left[f, b], right[f, b]


def _grow(bins, edges, g, h, signs):
    """One tree: features, thresholds, leaf values, and each row's leaf value."""
    inner = 2**LEVELS - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    bounds = {0: (-np.inf, np.inf)}
    values = {0: _leaf(g.sum(), h.sum())}
    node = np.zeros(len(g), np.int64)
    for k in range(inner):
        own = np.flatnonzero(node == k)
        low, high = bounds[k]
        found = None
        if len(own):
            flat = (bins[own] + np.arange(bins.shape[1]) * BINS).ravel()
            hist = [np.bincount(flat, np.repeat(w[own], bins.shape[1]), bins.shape[1] * BINS).reshape(-1, BINS) for w in (g, h)]
            found = _best_split(*hist, low, high, signs)
        if found is not None and found[0] > 1e-6:
            _, f, b, left, right = found
            feature[k], threshold[k] = f, edges[f][b]
            node[own] = 2 * k + 1 + (bins[own, f] > b)
            middle = (left + right) / 2
            values[2 * k + 1], values[2 * k + 2] = left, right
            bounds[2 * k + 1] = (low, middle) if signs[f] > 0 else (middle, high) if signs[f] < 0 else (low, high)
            bounds[2 * k + 2] = (middle, high) if signs[f] > 0 else (low, middle) if signs[f] < 0 else (low, high)
        else:
            node[own] = 2 * k + 1
            for child in (2 * k + 1, 2 * k + 2):
                values[child], bounds[child] = values[k], bounds[k]
    leaves = RATE * np.array([values[inner + i] for i in range(2**LEVELS)])
    return feature, threshold, leaves, leaves[node - inner]


def grow_forest(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for 0/1 labels."""
    inner, none = 2**LEVELS - 1, np.zeros((0, 0))
    if not len(y):
        return Forest(10.0, none.reshape(0, inner).astype(np.int64), none.reshape(0, inner), none.reshape(0, inner + 1))
    signs = np.array([-1 if name in FALLING else 0 for name in FEATURES])
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
    edges = [np.concatenate((c, np.full(BINS - 1 - len(c), np.inf))) for c in cuts]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], axis=1)
    rate = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(rate / (1 - rate)))
    margin, parts = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        *tree, moved = _grow(bins, edges, p - y, p * (1 - p), signs)
        margin += moved
        parts.append(tree)
    return Forest(start, *(np.stack(part) for part in zip(*parts)))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Rows whose id's checksum marks them as held out are not learned from.
    """
    counts = cut(text_counts(docs, id_col, text_col))
    marked = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("double").alias("label"))
    train = counts.where(~held_out(F.col("id"))).join(marked.where("label is not null"), "id")
    share = SAMPLE / max(1, train.count())
    sample = train.where(draw(SEED, F.col("id"), F.col("n_words")) < share).select("label", *COUNTS).collect()
    table = np.array(sorted(sample), np.float64).reshape(len(sample), 1 + len(COUNTS))
    forest = grow_forest(features_of(table[:, 1:]), table[:, 0])

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.scores(features_of(np.stack([c.to_numpy() for c in columns], axis=1))))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counts.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        score(*COUNTS).alias("score"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP_FROM))
