"""Quality scores by kernel ridge regression in random Fourier features, calibrated.

Document statistics are standardised and mapped to ``FOURIER`` cosines whose inner
products approximate a Gaussian kernel. Every partition sums its share of the
normal equations over its labelled rows; the sums, whose size depends on
``FOURIER`` only, are added up and solved on the driver. Raw scores of the same rows, grouped into
at most ``BINS`` steps, give an isotonic (pool adjacent violators) calibration.

All labelled rows of the training folds are used: nothing is sampled.

Defined results: null and empty texts are scored like any other (all statistics are
zero). Rows without a label, or with a null one, only get scores; repeated labels
count as often as they occur. Without any training row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import cut
from caseflow.llm.text_stats import COUNTS, FEATURES, features_of, text_counts

FOURIER = 160
BANDWIDTH = 3.0
RIDGE = 1.0
BINS = 2000
FOLDS = 5
KEEP_FROM = 0.3
SEED = 11


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text leaves no rest by FOLDS."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Kernel:
    """Standardisation and the cosines."""

    means: np.ndarray
    scales: np.ndarray

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.directions = rng.normal(0, 1 / BANDWIDTH, (len(FEATURES), FOURIER))
        self.phases = rng.uniform(0, 2 * np.pi, FOURIER)

    def cosines(self, features: np.ndarray) -> np.ndarray:
        scaled = np.clip((features - self.means) / self.scales, -8, 8)
        waves = np.sqrt(2 / FOURIER) * np.cos(scaled @ self.directions + self.phases)
        return np.concatenate((waves, np.ones((len(waves), 1))), axis=1)


@dataclass
class Model:
    kernel: Kernel | None
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def raw(self, features: np.ndarray) -> np.ndarray:
        return self.kernel.cosines(features) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(features), 0.5)
        return np.clip(np.interp(self.raw(features), self.steps, self.levels), 0, 1)


def _by_counts(function, returns: str = "double") -> Column:
    """``function`` of the feature matrix as a column, on Arrow batches of the counts."""

    @F.pandas_udf(returns)
    def applied(*columns: pd.Series) -> pd.Series:
        return pd.Series(function(features_of(np.stack([c.to_numpy() for c in columns], axis=1))))

    return applied(*[F.col(c) for c in COUNTS])


def _moments(rows: DataFrame) -> DataFrame:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = features_of(batch[list(COUNTS)].to_numpy())
            yield pd.DataFrame({"at": range(len(FEATURES)), "n": len(x), "s": x.sum(0), "q": (x * x).sum(0)})

    return rows.mapInPandas(sums, "at int, n long, s double, q double").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )


def _normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """The matrix [Z'Z, Z'y]: summed within partitions, then over them, one row of it at a time."""
    size = FOURIER + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = kernel.cosines(features_of(batch[list(COUNTS)].to_numpy()))
            total += z.T @ np.concatenate((z, batch[["label"]].to_numpy(np.float64)), axis=1)
        yield pd.DataFrame({"at": range(size), "part": list(total)})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": parts["at"][:1], "part": [np.sum(np.stack(parts["part"]), axis=0)]})

    schema = "at int, part array<double>"
    summed = rows.mapInPandas(partial, schema).groupBy("at").applyInPandas(add, schema)
    return np.array([r["part"] for r in summed.orderBy("at").collect()])


def isotonic(steps: np.ndarray, means: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the non-decreasing level at the centre of each pooled block."""
    blocks: list[list[float]] = []
    for step, mean, weight in zip(steps, means, weights):
        blocks.append([mean, weight, step * weight])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean_b, weight_b, step_b = blocks.pop()
            mean_a, weight_a, step_a = blocks[-1]
            blocks[-1] = [(mean_a * weight_a + mean_b * weight_b) / (weight_a + weight_b), weight_a + weight_b, step_a + step_b]
    pooled = np.array(blocks)
    return pooled[:, 2] / pooled[:, 1], pooled[:, 0]


def fit(rows: DataFrame) -> Model:
    """The model of rows with COUNTS and a 0/1 ``label``."""
    moments = {r["at"]: r for r in _moments(rows).collect()}
    if not moments or not moments[0]["n"]:
        return Model(None, np.zeros(0), np.zeros(0), np.zeros(0))
    ordered = [moments[i] for i in range(len(FEATURES))]
    means = np.array([m["s"] / m["n"] for m in ordered])
    spread = np.array([m["q"] / m["n"] for m in ordered]) - means**2
    kernel = Kernel(means, np.sqrt(np.maximum(spread, 1e-6)))
    system = _normal_equations(rows, kernel)
    penalty = RIDGE * np.eye(FOURIER + 1)
    penalty[-1, -1] = 1e-6
    model = Model(kernel, np.linalg.solve(system[:, :-1] + penalty, system[:, -1]), np.zeros(0), np.zeros(0))
    step = F.round(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)) / (BINS / 2)
    bins = rows.withColumn("raw", _by_counts(model.raw)).groupBy(step.alias("step"))
    bins = bins.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).orderBy("step").collect()
    model.steps, model.levels = isotonic(*(np.array([b[c] for b in bins], float) for c in ("step", "mean", "n")))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, held_out, score (0 to 1), predicted.

    ``labels`` has the id and a 0/1 column ``quality``. Only statistics of labelled
    rows are joined, on the id.
    """
    counts = cut(text_counts(docs, id_col, text_col).withColumn("held_out", held_out(F.col("id"))))
    marked = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("double").alias("label"))
    train = counts.where("not held_out").join(marked.where("label is not null"), "id").drop("id", "held_out")
    train = cut(train, marked.count())
    model = fit(train)
    score = _by_counts(lambda x: np.round(model.scores(x), 9))
    scored = counts.select(F.col("id").alias(id_col), "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))
