"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token sums per cell, one
grouped aggregation over all documents, are raked until the shares of every source,
language and topic meet their targets. Cell weights become probabilities by which
documents are sampled: calibrated so that the expected tokens meet the budget,
with probabilities capped at 1 and the excess spread over the other cells.

Every value of every margin is raked, however rare. Up to ``DRIVER_CELLS`` cells,
counted, are raked as arrays on the driver. More stay Spark tables: every step of a
round is a grouped sum over the cells and a join of the margin's factors, and only
single numbers (the largest deviation, the scale of the calibration) reach the driver.
Both ways follow the same steps. Probabilities are joined back by cell; the cells are
broadcast only if counted and at most ``BROADCAST_ROWS``.

A document's draw is a hash of seed, id and text: the sample does not depend on
partitions, and grows with the budget without losing anyone.

Defined results: null values of source or language are the value ``OTHER``; null
and empty texts have no tokens and count as one token each, so that they have a
cell. Repeated rows share their draw. An empty table gives an empty result. Targets
that no document can meet are dropped and the rest scaled up; if a margin has no other,
all weights and probabilities are 0 and nothing is kept. Margins that contradict each
other cannot all be met: raking then ends after ``ROUNDS`` rounds with a warning that
names the largest deviation.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import BROADCAST_ROWS, SPACES, cut, draw, text_key, words

OTHER = "(other)"
DRIVER_CELLS = 100_000
FLATTEN = 0.7
BUDGET = 0.9
SEED = 17
ROUNDS = 200
TOLERANCE = 1e-9
MARGINS = ("source", "lang", "topic")


def token_count(text: Column) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.size(words(F.coalesce(text, F.lit("")), SPACES)), F.lit(1)).cast("long")


def text_topic(text: Column) -> Column:
    """A plain topic of a text by its form: empty, table, markup, loud, note, article or long read."""
    text = F.coalesce(text, F.lit(""))
    length = F.char_length(text)

    def share(characters: str) -> Column:
        return 1 - F.char_length(F.translate(text, characters, "")) / length

    return (
        F.when(length == 0, "empty")
        .when(share("|") > 0.05, "table")
        .when(share("#$%&*<>") > 0.1, "markup")
        .when(share("!") > 0.1, "loud")
        .when(length < 600, "note")
        .when(length < 6000, "article")
        .otherwise("long read")
    )


def rake(tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Weights with the given shares on every axis, as close to ``tokens`` as possible."""
    places = np.indices(tokens.shape).reshape(tokens.ndim, -1)
    return rake_cells(tokens.ravel(), list(places), targets).reshape(tokens.shape)


def rake_cells(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """``rake`` for listed cells; ``places`` has the cells' values on each axis."""
    fitted = tokens / tokens.sum()
    for _ in range(ROUNDS):
        off = 0.0
        for place, target in zip(places, targets):
            margin = np.bincount(place, fitted, len(target))
            ratio = np.divide(target, margin, out=np.zeros_like(target), where=margin > 0)
            off = max(off, float(np.abs(margin - target).max()))
            fitted = fitted * ratio[place]
        if off < TOLERANCE or not fitted.any():
            break
    return _whole(fitted, off)


def _whole(fitted: np.ndarray, off: float) -> np.ndarray:
    """The fitted weights as shares of 1, or zeros if nothing is left."""
    _announce(off, float(fitted.sum()))
    return fitted / fitted.sum() if fitted.any() else np.zeros_like(fitted)


def _announce(off: float, mass: float) -> None:
    if mass > 0 and off > 1000 * TOLERANCE:
        warnings.warn(f"raking ended after {ROUNDS} rounds with a margin off by {off:.2g}", stacklevel=3)


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities proportional to weight over tokens, 1 at most, that expect ``budget`` tokens."""
    wanted = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    full = np.zeros(tokens.shape, bool)
    while True:
        free = (wanted > 0) & ~full
        left = budget - tokens[full].sum()
        mass = (wanted * tokens)[free].sum()
        scale = max(left, 0.0) / mass if mass > 0 else 0.0
        over = free & (wanted * scale > 1)
        if not over.any():
            return np.where(full, 1.0, np.where(free, wanted * scale, 0.0))
        full |= over


def _targets(seen: Mapping[str, float], stated: Mapping[str, float] | None) -> dict[str, float]:
    """Shares per value: as stated, or the seen shares flattened by the power FLATTEN."""
    raw = {k: v for k, v in stated.items() if seen.get(k)} if stated else {k: v**FLATTEN for k, v in seen.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else {}


def judge(
    df: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The verdict on each row of ``df``, without its text.

    Columns: ``__id``, ``__key`` (of the text), ``__source``, ``__lang``, ``__topic``,
    ``__tokens``, ``__weight`` (of the cell), ``__probability`` and ``__kept``. ``targets``
    may state shares for "source", "lang" and "topic"; a margin that it leaves out keeps
    its shares, flattened. ``budget`` is a share of all tokens. Values that a stated
    margin does not name have no target and leave the mix. Texts are read once.
    """
    targets = targets or {}
    rows = cut(
        df.select(
            F.col(id_col).alias("__id"),
            text_key(F.col(text_col)).alias("__key"),
            draw(seed, F.col(id_col), F.col(text_col)).alias("__draw"),
            F.col(source_col).cast("string").alias("__source"),
            F.col(lang_col).cast("string").alias("__lang"),
            F.coalesce(text_topic(F.col(text_col)) if topic is None else topic.cast("string"), F.lit(OTHER)).alias("__topic"),
            token_count(F.col(text_col)).alias("__tokens"),
        )
    )
    places = [F.coalesce(F.col(f"__{m}"), F.lit(OTHER)) for m in MARGINS]
    sums = rows.groupBy(*[p.alias(f"__{m}") for p, m in zip(places, MARGINS)]).agg(F.sum("__tokens").cast("double").alias("tokens"))
    cells = cut(sums.toDF("__s", "__l", "__t", "tokens"), rows.count())
    n_cells = cells.count()
    if n_cells <= DRIVER_CELLS:
        schema = "__s string, __l string, __t string, __weight double, __probability double"
        looked_up = df.sparkSession.createDataFrame(_probabilities(cells.collect(), targets, budget), schema)
    else:
        looked_up = _calibrated_table(_raked_table(cells, targets, n_cells), budget)
    if n_cells <= BROADCAST_ROWS:
        looked_up = F.broadcast(looked_up)
    on = (places[0] == F.col("__s")) & (places[1] == F.col("__l")) & (places[2] == F.col("__t"))
    judged = rows.join(looked_up, on, "left").withColumn("__kept", F.col("__draw") < F.col("__probability"))
    return judged.select("__id", "__key", "__source", "__lang", "__topic", "__tokens", "__weight", "__probability", "__kept")


def _same_row(df: DataFrame, options: Mapping) -> Column:
    """Whether a row of ``df`` is one that a verdict (columns renamed to ``v_...``) is about; nulls match nulls."""
    source, lang = (F.col(options.get(c, d)).cast("string") for c, d in (("source_col", "source"), ("lang_col", "lang")))
    same = F.col(options.get("id_col", "doc_id")).eqNullSafe(F.col("v_id"))
    same = same & (text_key(F.col(options.get("text_col", "text"))) == F.col("v_key"))
    same = same & source.eqNullSafe(F.col("v_source")) & lang.eqNullSafe(F.col("v_lang"))
    if options.get("topic") is not None:
        same = same & (F.coalesce(options["topic"].cast("string"), F.lit(OTHER)) == F.col("v_topic"))
    return same


_KEYS = ("__id", "__key", "__source", "__lang", "__topic")


def mix(df: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, **options) -> DataFrame:
    """``df`` with ``__topic``, ``__tokens``, ``__weight`` (of the cell), ``__probability`` and ``__kept``.

    For options see ``judge``, whose verdict is joined to the rows by id and text.
    """
    judged = judge(df, targets, budget, **options).dropDuplicates(list(_KEYS))
    judged = judged.withColumnsRenamed({c: f"v{c[1:]}" for c in _KEYS})
    added = [F.col("v_topic").alias("__topic"), "__tokens", "__weight", "__probability", "__kept"]
    return df.join(judged, _same_row(df, options), "left").select(*df.columns, *added)


def _probabilities(cells: list, targets: Mapping, budget: float) -> list[tuple]:
    """(source, language, topic, weight, probability) of all cells, by arrays."""
    if not cells:
        return []
    tokens = np.array([c["tokens"] for c in cells])
    places, wanted = [], []
    for i, margin in enumerate(MARGINS):
        axis = sorted({c[i] for c in cells})
        at = {v: k for k, v in enumerate(axis)}
        place = np.array([at[c[i]] for c in cells])
        sums = np.bincount(place, tokens, len(axis))
        shares = _targets(dict(zip(axis, (sums / sums.sum()).tolist())), targets.get(margin))
        places.append(place)
        wanted.append(np.array([shares.get(v, 0.0) for v in axis]))
    weights = rake_cells(tokens, places, wanted)
    chances = calibrate(tokens, weights, budget * tokens.sum())
    return [(*c[:3], w, p) for c, w, p in zip(cells, weights.tolist(), chances.tolist())]


def _target_table(cells: DataFrame, column: str, stated: Mapping[str, float] | None) -> DataFrame:
    """(value, target) of all values of a margin: ``_targets`` as a table."""
    seen = cells.groupBy(column).agg(F.sum("tokens").alias("seen"))
    if stated:
        named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in stated.items()], "value string, raw double")
        seen = seen.join(F.broadcast(named), F.col(column) == F.col("value"), "left")
        seen = seen.select(column, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    else:
        seen = seen.select(column, F.pow("seen", F.lit(FLATTEN)).alias("raw"))
    seen = cut(seen)
    total = seen.agg(F.sum("raw")).first()[0] or 1.0
    return seen.select(F.col(column).alias("value"), (F.col("raw") / total).alias("target"))


def _raked_table(cells: DataFrame, targets: Mapping, n_cells: int) -> DataFrame:
    """``rake`` over a table of cells (__s, __l, __t, tokens), with the result as ``__weight``."""
    axes = ["__s", "__l", "__t"]
    wanted = [cut(_target_table(cells, a, targets.get(m)), n_cells) for a, m in zip(axes, MARGINS)]
    total = cells.agg(F.sum("tokens")).first()[0]
    fitted = cells.withColumn("__weight", F.col("tokens") / total)
    for _ in range(ROUNDS):
        off = 0.0
        for axis, target in zip(axes, wanted):
            margin = fitted.groupBy(F.col(axis).alias("value")).agg(F.sum("__weight").alias("margin"))
            ratio = F.when(F.col("margin") > 0, F.col("target") / F.col("margin")).otherwise(0.0)
            ratios = cut(margin.join(target, "value").withColumn("ratio", ratio), n_cells)
            off = max(off, ratios.agg(F.max(F.abs(F.col("margin") - F.col("target")))).first()[0])
            joined = fitted.join(ratios.select("value", "ratio"), F.col(axis) == F.col("value"))
            fitted = joined.select(*axes, "tokens", (F.col("__weight") * F.col("ratio")).alias("__weight"))
        fitted = cut(fitted, n_cells)
        if off < TOLERANCE or fitted.where("__weight > 0").isEmpty():
            break
    mass = fitted.agg(F.sum("__weight")).first()[0]
    _announce(off, mass)
    return fitted.withColumn("__weight", F.col("__weight") / mass if mass > 0 else F.lit(0.0))


def _calibrated_table(cells: DataFrame, budget: float) -> DataFrame:
    """``calibrate`` over a table of cells: (__s, __l, __t, __weight, __probability)."""
    wanted = F.col("__weight") / F.col("tokens")
    left, scale, full = budget * cells.agg(F.sum("tokens")).first()[0], 0.0, -1
    while True:
        over = wanted * scale > 1
        count, taken, mass = cells.agg(
            F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(over, F.col("tokens"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("__weight"))), F.lit(0.0)),
        ).first()
        if count == full:
            break
        full, scale = count, max(left - taken, 0.0) / mass if mass > 0 else scale
    chance = F.least(wanted * scale, F.lit(1.0))
    return cells.select("__s", "__l", "__t", "__weight", chance.alias("__probability"))


def sample(df: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, **options) -> DataFrame:
    """The rows of ``df`` that the mix keeps.

    Keys of dropped rows are broadcast only if counted and few; otherwise both sides
    are shuffled.
    """
    judged = judge(df, targets, budget, **options)
    dropped = cut(judged.where("not coalesce(__kept, false)").select(*_KEYS).distinct())
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    dropped = dropped.withColumnsRenamed({c: f"v{c[1:]}" for c in _KEYS})
    return df.join(dropped, _same_row(df, options), "left_anti")
