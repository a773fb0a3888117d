from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from caseflow.llm import toxicity as tox
from tests.llm.frames import ODD, docs

M = 1 << 64


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def brute_counts(text):
    """Counts of buckets by plain loops over the words."""
    counts = np.zeros(tox.BUCKETS, int)
    word, words = "", []
    for c in (text or "").lower() + " ":
        if tox._ends_words(np.array([ord(c)], np.uint32))[0]:
            words += [word] if word else []
            word = ""
        else:
            word += c
    for word in words:
        codes = [2, *(ord(c) + 1 for c in word), 2]
        for n in tox.GRAMS:
            for i in range(len(codes) - n + 1):
                h = 0
                for k, c in enumerate(codes[i : i + n]):
                    h = c if k == 0 else (h * 0x100000001B3 + c) % M
                counts[mixed((h + n) % M) % tox.BUCKETS] += 1
    return counts


TEXTS = [None, "", " \n", "a", "ab, c", "You Idiot!", "ÄÖ ß x y", "ｗide 𝄞 emoji😀", "same same same", "«quoted» word", "a\x00b", "İstanbul"]


@pytest.mark.parametrize("piece", [4, 1 << 18])
def test_bags_by_brute_force(monkeypatch, piece):
    monkeypatch.setattr(tox, "PIECE", piece)
    texts = [*TEXTS, "word " * 300 + "end", "no" * 500]
    found = list(tox.bag_counts(texts))
    assert len(found) == len(texts)
    for text, counts in zip(texts, found):
        assert (counts == brute_counts(text)).all(), text


def test_scores_by_brute_force():
    rng = np.random.default_rng(1)
    model = tox.Subwords(rng.normal(size=(tox.BUCKETS, 4)), rng.normal(size=(4, 2)), rng.normal(size=2))
    for text, score in zip(TEXTS, model.scores(TEXTS)):
        roots = np.sqrt(brute_counts(text))
        average = sum(r * v for r, v in zip(roots, model.vectors) if r) / max(1, roots.sum())
        logits = tox.SCALE * np.asarray(average) @ model.weights + model.offsets if roots.any() else model.offsets
        assert np.isclose(score, np.exp(logits[1]) / np.exp(logits).sum())


def test_training_follows_the_slope():
    """A step of the trained loss by finite differences on a two-bucket problem."""
    bags = [(np.array([0, 1]), np.array([0.5, 0.5])), (np.array([1]), np.array([1.0]))] * 40
    labels = np.array([1, 0] * 40)
    model = tox.train(bags, labels)
    gains = model.gains()
    odds = lambda b: gains[b[0]] @ b[1] + model.offsets[1] - model.offsets[0]
    assert odds(bags[0]) > 2 and odds(bags[1]) < -2


BASE = ["idiot", "moron", "stupid", "worthless", "pathetic"]


def misspelt(rng, word):
    at = rng.randrange(1, len(word) - 1)
    return rng.choice((word[:at] + word[at] + word[at:], word[:at] + "*" + word[at + 1 :], word + rng.choice("szx"), word[:at] + word[at + 1 :]))


def corpus(seed, count, spoil):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abdeghklmnoprstu", k=rng.randint(2, 9))) for _ in range(2000)]
    rows, labels = [], []
    for i in range(count):
        words = rng.choices(vocabulary, k=rng.randint(30, 150))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 30)):
                words.insert(rng.randrange(len(words)), misspelt(rng, rng.choice(BASE)) if spoil(i) else rng.choice(BASE))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_unseen_misspellings_are_caught(spark):
    rows, labels = corpus(3, 2400, spoil=lambda i: held(i) or i % 8 == 0)  # whoever is held out has misspelt words only
    found = tox.score_toxicity(docs(spark, rows).repartition(5), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    toxic = dict(labels)
    assert len(found) == len(rows) and all(r.held_out == held(r.doc_id) for r in found)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.held_out]
    assert np.mean([r.predicted for r in unseen if toxic[r.doc_id]]) > 0.85
    assert np.mean([1 - r.predicted for r in unseen if not toxic[r.doc_id]]) > 0.97


def test_held_out_labels_are_never_learnt_from(spark):
    rows, labels = corpus(4, 200, spoil=lambda i: False)
    df = docs(spark, rows)
    own = tox.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    lies = [(i, 1 - t if held(i) else t) for i, t in labels] + [(None, 1), (3, None), (2, 7)]
    other = tox.score_toxicity(df.repartition(3), spark.createDataFrame(lies, "doc_id long, toxic int")).collect()
    assert sorted(own) == sorted(other)


def test_odd_rows_and_tables(spark):
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs(spark, ODD)
    assert {r.score for r in tox.score_toxicity(df, nothing).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0), (9, 1), (7, 1), (7, 0), (5, 1), (9, 1)], "doc_id long, toxic int")
    found = tox.score_toxicity(df, some).collect()
    assert len(found) == len(ODD) and not any(r.held_out for r in found if r.doc_id is None)
    empty = {r.score for r in found if r.doc_id in (5, 6, 7)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in found)
    assert tox.score_toxicity(df.limit(0), some).count() == 0


def test_bounded_sample(spark):
    rows, labels = corpus(5, 400, spoil=lambda i: False)
    seen = []
    keep = tox.train
    try:
        tox.train = lambda bags, marked: seen.append(len(bags)) or keep(bags, marked)
        tox.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=20)
    finally:
        tox.train = keep
    assert 15 < seen[0] < 80
