from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from caseflow.llm import queries
from caseflow.llm import quality_classifier as classifier
from caseflow.llm import quality_rules as rules
from caseflow.llm.text_stats import COUNTS, FEATURES, counts_of, features_of, text_counts
from caseflow.llm.word_arrays import groups
from tests.llm.frames import ODD, docs

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    *[t or "" for _, t in ODD], "a b c d e a b c d e f", "x x x x x x", "l1 w\nl1 w\n\nl1 w \nl1 w", "\n\n", "#*$%&|<> |", "ÄÖ 日本 🙂🙂",
    "a b c d e\na b c d e", "a b c d", "tab\tsep\x0b\x0cx\r\ny", "\na\n", "same\nsame", "a b c d",
]


def base_counts(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 5)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_counts_by_brute_force():
    found = np.concatenate([counts_of(g) for g in groups(pa.array([*TEXTS, None]))])
    assert [tuple(r[:5]) for r in found.tolist()] == [base_counts(t) for t in [*TEXTS, None]]
    shares = features_of(found)
    assert np.isfinite(shares).all() and shares.shape == (len(TEXTS) + 1, len(FEATURES))
    sliced = pa.array(["skip", *TEXTS])[1:]
    assert (np.concatenate([counts_of(g) for g in groups(sliced)]) == found[:-1]).all()


def test_rules_over_the_whole_table(spark):
    result = queries.op8_quality_rules(spark, SF).toPandas().set_index("doc_id")
    table = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(result) == len(table)
    for doc_id, text in zip(table.doc_id, table.text):
        r, want = result.loc[doc_id], base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(result.reset_index())
    judged = labels[~labels.base_failed]
    unseen = judged[[zlib.crc32(str(i).encode()) % 5 == 0 for i in judged.doc_id]]
    for part in (judged, unseen):
        assert (part.kept == (part.quality == 1)).mean() > 0.97
    assert judged[judged.quality == 1].kept.mean() > 0.98


def test_trees_obey_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (3000, len(FEATURES)))
    bumpy = (np.sin(9 * x[:, 0]) > 0) | (x[:, 5] > 0.8)  # neither rising nor falling in feature 0
    forest = rules.grow_forest(x, bumpy.astype(float))
    probe = np.repeat(rng.uniform(0, 1, (40, len(FEATURES))), 50, axis=0)
    for name in rules.FALLING:
        at = FEATURES.index(name)
        moved = probe.copy()
        moved[:, at] = np.tile(np.linspace(0, 1, 50), 40)
        assert (np.diff(forest.scores(moved).reshape(40, 50), axis=1) <= 1e-12).all()
    assert forest.feature.shape == (rules.TREES, 2**rules.LEVELS - 1)


def test_trees_without_constraints_fit():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (2000, len(FEATURES)))
    y = ((x[:, 5] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    assert ((rules.grow_forest(x, y).scores(x) > 0.5) == y).mean() > 0.95


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_and_missing_labels(spark):
    for rows in ([], [(1, None, 0)], [(2, 1, 0), (2, 1, 0), (8, 0, 1), (None, 1, 0), (77, 0, 0)]):
        marked = labels(spark, rows)
        kept = rules.apply_rules(docs(spark, ODD), marked)
        assert kept.count() == len(ODD) and kept.where("kept is null or base_failed is null").count() == 0
        scored = classifier.score_quality(docs(spark, ODD), marked)
        assert scored.count() == len(ODD) and scored.where("score between 0 and 1").count() == len(ODD)
    assert {r.score for r in classifier.score_quality(docs(spark, ODD), labels(spark, [])).collect()} == {0.5}
    assert rules.apply_rules(docs(spark, []), labels(spark, [])).count() == 0
    assert classifier.score_quality(docs(spark, []), labels(spark, [])).count() == 0


def test_classifier_on_held_out_rows(spark):
    result = queries.op2_quality_classifier(spark, SF).toPandas()
    assert len(result) == 1000
    for r in result.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)
    joined = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(result)
    unseen = joined[joined.held_out]
    assert len(unseen) > 50 and (unseen.predicted == unseen.quality).mean() > 0.97
    good, bad = (unseen[unseen.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_normal_equations_like_one_big_matrix(spark):
    rng = np.random.default_rng(5)
    table = rng.integers(0, 50, (300, len(COUNTS)))
    label = rng.integers(0, 2, 300)
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", label double"
    rows = spark.createDataFrame([(*map(int, t), float(y)) for t, y in zip(table, label)], schema).repartition(5)
    x = features_of(table)
    kernel = classifier.Kernel(x.mean(0), x.std(0) + 1e-3)
    z = kernel.cosines(x)
    want = np.concatenate((z.T @ z, (z.T @ label)[:, None]), axis=1)
    assert np.allclose(classifier._normal_equations(rows, kernel), want)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (30, len(FEATURES)))
    z = classifier.Kernel(np.zeros(len(FEATURES)), np.ones(len(FEATURES))).cosines(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / (2 * classifier.BANDWIDTH**2))).mean() < 0.08


def test_isotonic():
    steps, levels = classifier.isotonic(np.arange(6.0), np.array([0.1, 0.3, 0.2, 0.2, 0.9, 0.8]), np.array([1, 1, 1, 2, 1, 1.0]))
    assert (np.diff(levels) > 0).all() and np.isclose(levels[1], (0.3 + 0.2 + 0.4) / 4) and np.isclose(levels[-1], 0.85)
    assert (np.diff(steps) > 0).all()


def test_tree_scores_by_walking_every_node(spark, monkeypatch):
    grown, grow = [], rules.grow_forest
    monkeypatch.setattr(rules, "grow_forest", lambda x, y: grown.append(grow(x, y)) or grown[-1])
    found = {r.doc_id: r for r in queries.op8_quality_rules(spark, SF).collect()}
    (forest,) = grown
    counted = text_counts(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text").collect()
    assert len(found) == len(counted)
    for row in counted:
        x = features_of(np.array(row[1:]))[0]
        margin = forest.start
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            margin += value[node - len(feature)]
        score = 1 / (1 + np.exp(-margin))
        r = found[row.id]
        assert np.isclose(r.score, score, atol=1e-12) and r.kept == (not r.base_failed and r.score >= 0.3)


def test_scores_by_one_matrix(spark):
    """Kernel ridge and isotonic calibration as one system on the driver."""
    docs_table, marked = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    counted = {r.id: np.array(r[1:]) for r in text_counts(docs_table, "doc_id", "text").collect()}
    learnt = [(r.doc_id, r.quality) for r in marked.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    x, y = features_of(np.stack([counted[i] for i, _ in learnt])), np.array([q for _, q in learnt], float)
    base = classifier.Kernel(x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6)))

    def waves(features):
        scaled = np.clip((features - base.means) / base.scales, -8, 8)
        angles = np.einsum("ij,jk->ik", scaled, base.directions) + base.phases
        return np.hstack((np.cos(angles) * (2 / classifier.FOURIER) ** 0.5, np.ones((len(features), 1))))

    z = waves(x)
    ridge = np.diag([classifier.RIDGE] * classifier.FOURIER + [1e-6])
    weights = np.linalg.lstsq(z.T @ z + ridge, z.T @ y, rcond=None)[0]
    half = classifier.BINS / 2
    steps = np.floor(np.clip(z @ weights, -0.5, 1.5) * half + 0.5) / half
    places = np.unique(steps)
    n = np.array([(steps == p).sum() for p in places])
    total = np.array([y[steps == p].sum() for p in places])
    mean = lambda a, b: total[a : b + 1].sum() / n[a : b + 1].sum()
    size = range(len(places))
    levels = np.array([max(min(mean(a, b) for b in size[i:]) for a in size[: i + 1]) for i in size])  # max-min form
    blocks = np.cumsum(np.concatenate(([0], ~np.isclose(levels[1:], levels[:-1], atol=1e-12))))
    centres = np.bincount(blocks, places * n) / np.bincount(blocks, n)
    heights = np.array([levels[blocks == k][0] for k in range(blocks[-1] + 1)])
    for r in queries.op2_quality_classifier(spark, SF).collect():
        raw = (waves(features_of(counted[r.doc_id])) @ weights)[0]
        assert np.isclose(r.score, np.interp(raw, centres, heights), atol=1e-5)
