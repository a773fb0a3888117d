from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import mixing, queries
from tests.llm.frames import ODD, SF, docs

KIND = "doc_id long, text string, lang string, source string"


def test_raking_meets_all_margins():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 1000, (4, 3, 5)).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in tokens.shape]
    weights = mixing.rake(tokens, targets)
    for axis, target in enumerate(targets):
        assert np.allclose(weights.sum(axis=tuple(a for a in range(3) if a != axis)), target, atol=1e-7)
    ratio = weights / tokens  # odds ratios of the seed stay
    assert np.isclose(ratio[0, 0, 0] * ratio[1, 1, 0], ratio[0, 1, 0] * ratio[1, 0, 0])


def test_calibration_meets_the_budget_with_caps():
    tokens, weights = np.array([100.0, 1000.0, 10.0, 0.0]), np.array([0.5, 0.4, 0.1, 0.0])
    chances = mixing.calibrate(tokens, weights, 400)
    assert np.isclose((chances * tokens).sum(), 400) and chances[0] == chances[2] == 1 and chances[3] == 0
    assert np.allclose(mixing.calibrate(tokens, weights, 2000)[:3], 1)


def test_whole_table_by_brute_force(spark):
    rows = queries.op7_mixing(spark, SF).toPandas()
    assert len(rows) == 200
    sums = rows.groupby(["source", "lang", "topic"])["n_tokens"].sum()
    axes = [sorted(sums.index.unique(i)) for i in range(3)]
    tokens = np.zeros([len(a) for a in axes])
    for key, n in sums.items():
        tokens[tuple(a.index(v) for a, v in zip(axes, key))] = n
    wanted = []
    for i in range(3):
        seen = tokens.sum(axis=tuple(a for a in range(3) if a != i)) / tokens.sum()
        wanted.append(seen**mixing.FLATTEN / (seen**mixing.FLATTEN).sum())
    chances = mixing.calibrate(tokens, mixing.rake(tokens, wanted), mixing.BUDGET * tokens.sum())
    for r in rows.itertuples():
        at = tuple(a.index(v) for a, v in zip(axes, (r.source, r.lang, r.topic)))
        assert np.isclose(r.probability, chances[at])
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    assert texts.where(mixing.token_count(F.col("text")) != F.size(F.split(F.trim("text"), r"\s+"))).count() == 0


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [sorted(r.doc_id for r in mixing.sample(df.repartition(n)).select("doc_id").collect()) for n in (1, 6)]
    smaller = {r.doc_id for r in mixing.sample(df, budget=0.5).select("doc_id").collect()}
    assert kept[0] == kept[1] and smaller < set(kept[0]) and mixing.sample(df).columns == df.columns


def test_stated_targets(spark):
    rows = [(i, "one two three four", "en" if i % 4 else "de", f"s{i % 3}") for i in range(4000)]
    df = docs(spark, rows, KIND, clash=False)
    targets = {"lang": {"en": 0.5, "de": 0.5, "xx": 0.3}, "source": {"s0": 1.0}}
    kept = mixing.mix(df, targets, budget=0.1).where("__kept")
    by = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    assert kept.where("source <> 's0'").count() == 0
    assert abs(by["en"] - 200) < 60 and abs(by["de"] - 200) < 60


def test_equal_sources_have_equal_weights(spark):
    rows = [(i, "a b c", "en", f"rare{i}") for i in range(400)] + [(1000 + i, "a b c", "en", "big") for i in range(600)]
    result = mixing.mix(docs(spark, rows, KIND, clash=False))
    assert result.select("source", "__weight").distinct().select("__weight").distinct().count() == 2
    assert result.where("source = 'big'").select("__probability").distinct().count() == 1


def test_odd_rows_and_empty_table(spark):
    rows = [(*r, None if i % 2 else "en", None if i % 3 else "s") for i, r in enumerate(ODD)]
    df = docs(spark, rows, KIND)
    result = mixing.mix(df, budget=1.0)
    assert result.count() == len(ODD) and result.where("__kept").count() == len(ODD)
    assert mixing.sample(df).columns == df.columns
    assert mixing.mix(docs(spark, [], KIND)).count() == 0


def test_many_small_sources_keep_their_own_margin(spark):
    rows = [(i, "a b c", "en", f"small{i % 500}") for i in range(2000)] + [(5000 + i, "a b c", "en", "hot") for i in range(1000)]
    result = mixing.mix(docs(spark, rows, KIND, clash=False))
    found = {r.hot: (r.w, r.p) for r in result.groupBy((F.col("source") == "hot").alias("hot")).agg(F.max("__weight").alias("w"), F.max("__probability").alias("p")).collect()}
    hot, small = (1 / 3) ** mixing.FLATTEN, (2 / 3 / 500) ** mixing.FLATTEN
    assert np.isclose(found[True][0], hot / (hot + 500 * small)) and np.isclose(found[False][1], 1.0)
    assert np.isclose(found[True][1], 0.7)  # the budget of 0.9 less the 2/3 of the small, over 1/3


def test_tables_follow_the_steps_of_the_arrays(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["a " * int(n) for n in rng.integers(1, 30, 600)]
    rows = [(i, w, f"l{rng.integers(0, 3)}", f"s{int(rng.exponential(4))}") for i, w in enumerate(words)]
    df = docs(spark, rows, KIND, clash=False)
    stated = {"source": {"s0": 0.5, "s1": 0.3, "none": 0.2}}
    for targets, budget in ((None, 0.9), (stated, 0.1)):
        columns = ["doc_id", "__weight", "__probability"]
        with monkeypatch.context() as patch:
            patch.setattr(mixing, "DRIVER_CELLS", 0)
            patch.setattr(mixing, "ROUNDS", 5)
            tables = mixing.mix(df, targets, budget).select(columns).orderBy("doc_id").toPandas()
            patch.setattr(mixing, "DRIVER_CELLS", 100_000)
            arrays = mixing.mix(df, targets, budget).select(columns).orderBy("doc_id").toPandas()
        assert len(tables) == len(rows) and np.allclose(arrays, tables, rtol=1e-9)


def plain_topic(text):
    """The topic by counting characters one by one."""
    text = text or ""
    share = lambda marks: sum(c in marks for c in text) / len(text)
    if not text:
        return "empty"
    for marks, least, name in (("|", 0.05, "table"), ("#$%&*<>", 0.1, "markup"), ("!", 0.1, "loud")):
        if share(marks) > least:
            return name
    return "note" if len(text) < 600 else "article" if len(text) < 6000 else "long read"


def test_topics_and_weights_by_plain_loops(spark):
    """Words, topics, raking and calibration without the module's own functions."""
    texts = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for i, r in texts.items()}
    cell = {i: (r.source, r.lang, plain_topic(r.text)) for i, r in texts.items()}
    total, sums = sum(tokens.values()), {}
    for i, c in cell.items():
        sums[c] = sums.get(c, 0) + tokens[i]
    targets = []
    for axis in range(3):
        seen = {}
        for c, n in sums.items():
            seen[c[axis]] = seen.get(c[axis], 0) + n / total
        flat = {v: s**mixing.FLATTEN for v, s in seen.items()}
        targets.append({v: s / sum(flat.values()) for v, s in flat.items()})
    weight = {c: n / total for c, n in sums.items()}
    for _ in range(mixing.ROUNDS):
        for axis, target in enumerate(targets):
            margin = {}
            for c, w in weight.items():
                margin[c[axis]] = margin.get(c[axis], 0) + w
            weight = {c: w * target[c[axis]] / margin[c[axis]] for c, w in weight.items()}
    chance, low, high = {}, 0.0, 1e12
    for _ in range(200):  # the scale by halving: expected tokens grow with it
        scale = (low + high) / 2
        chance = {c: min(1.0, scale * w / sums[c]) for c, w in weight.items()}
        low, high = (scale, high) if sum(chance[c] * n for c, n in sums.items()) < mixing.BUDGET * total else (low, scale)
    for r in queries.op7_mixing(spark, SF).collect():
        assert (r.source, r.lang, r.topic) == cell[r.doc_id] and r.n_tokens == tokens[r.doc_id]
        assert np.isclose(r.cell_weight, weight[cell[r.doc_id]]) and np.isclose(r.probability, chance[cell[r.doc_id]])


@pytest.mark.parametrize("cells", [0, 100_000])
def test_targets_that_no_row_meets(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    df = docs(spark, [(i, "a b c", "en", f"s{i % 3}") for i in range(30)], KIND)
    result = mixing.mix(df, {"lang": {"fr": 1.0}}).collect()
    assert len(result) == 30 and {(r["__weight"], r["__probability"], r["__kept"]) for r in result} == {(0.0, 0.0, False)}
    assert mixing.sample(df, {"lang": {"fr": 1.0}}).count() == 0


@pytest.mark.parametrize("cells", [0, 100_000])
def test_contradicting_margins_are_announced(spark, monkeypatch, cells):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", cells)
    monkeypatch.setattr(mixing, "ROUNDS", 4)
    df = docs(spark, [(i, "a b c", "en" if i % 2 else "de", "s1" if i % 2 else "s2") for i in range(30)], KIND, clash=False)
    with pytest.warns(UserWarning, match="off by"):
        mixing.mix(df, {"lang": {"en": 0.9, "de": 0.1}, "source": {"s1": 0.1, "s2": 0.9}}).count()


def test_rows_that_share_id_and_text_keep_their_own_source(spark):
    rows = [(1, "a b c", "en", "s1"), (1, "a b c", "en", "s2"), (1, "a b c", None, None), (1, "a b c", None, None)] * 2
    df = docs(spark, rows, KIND)
    result = mixing.mix(df, {"source": {"s1": 1.0}}, budget=1.0)
    assert result.count() == len(rows) and result.where("__kept").select("source").distinct().collect() == [("s1",)]
    assert [r.source for r in mixing.sample(df, {"source": {"s1": 1.0}}, budget=1.0).collect()] == ["s1", "s1"]
