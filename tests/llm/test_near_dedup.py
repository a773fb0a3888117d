from __future__ import annotations

import random
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseflow.llm import near_dedup as near
from caseflow.llm.word_arrays import groups
from tests.llm.frames import ODD, docs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(
        ((d, len(sets[i]), least.get(root(i)) if sets[i] else d, d == (least.get(root(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)),
        key=repr,
    )


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, hub = [], fresh(400)
    rows.append((1000, " ".join(hub)))
    for i in range(150):  # a family around one text, whose members link with the text rather than each other
        words = list(hub)
        for at in rng.sample(range(400), rng.randint(1, 6)):
            words[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    shared = fresh(60)  # a passage that many share
    rows += [(2000 + i, " ".join(fresh(40) + shared + fresh(40))) for i in range(100)]
    chain = fresh(300)
    for i in range(12):  # each links with the next only
        chain = chain[12:] + fresh(12)
        rows.append((3000 + i, " ".join(chain)))
    rows += [(4000 + i, " ".join(fresh(rng.randint(1, 30)))) for i in range(100)]
    rows += [(5000 + i, "Some Exact copy of five words") for i in range(40)]
    return rows + ODD


def test_against_brute_force(spark):
    rows = corpus()
    result = near.near_duplicates(docs(spark, rows).repartition(7))
    assert sorted(map(tuple, result.collect()), key=repr) == brute(rows)


def test_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    rows = corpus(4)
    result = near.near_duplicates(docs(spark, rows, clash=False))
    assert sorted(map(tuple, result.collect()), key=repr) == brute(rows)


def test_kept_rows_keep_their_columns(spark):
    rows = corpus(5)
    df = docs(spark, rows)
    kept = near.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _, _, k in brute(rows) if k)


def test_empty_and_linkless_tables(spark):
    assert near.near_duplicates(docs(spark, [])).count() == 0
    assert near.near_duplicates(docs(spark, [(1, None), (2, "one")])).where("kept").count() == 2


def test_shingle_sets_of_bytes():
    texts = [None, "", "a b", "A B", "a b c d e", "a b c d e a b c d e", "é è", " x\x0by\x0c\tz \r\n"]
    sets = [s for g in groups(pa.array(texts)) for s in near.shingle_sets(g)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[2] == sets[3]).all() and not np.isin(sets[2], sets[4]).any()


@pytest.mark.parametrize("region", [2, 5, 64])
def test_cuts_cover_a_crowded_region(monkeypatch, region):
    monkeypatch.setattr(near, "REGION", region)
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 3, 200))[:, None] * np.ones((1, near.KEY), np.int64)
    keys[:, 5] = rng.integers(0, 2, 200)
    keys = keys[np.lexsort(keys.T[::-1])]
    cuts = list(near._cuts(keys, near.DEPTH, 0, len(keys)))
    assert cuts[0][0] == 0 and cuts[-1][1] == 200 and all(b - a <= region for a, b in cuts)
    assert all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 6), (7, 5)]
    found = near.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}


def halves_that_share(percent, seed):
    """Two texts whose shingle sets have the similarity ``percent``."""
    rng = random.Random(seed)
    words = [f"v{rng.random()}" for _ in range(400)]
    other = list(words)
    at = 0
    while True:
        both, one = shingles(" ".join(words)), shingles(" ".join(other))
        if 100 * len(both & one) < (percent + 1) * len(both | one):
            return " ".join(words), " ".join(other)
        other[-1 - at] = f"u{rng.random()}"
        at += 1


def test_threshold_is_a_parameter(spark):
    pairs = [halves_that_share(82, seed) for seed in range(20)]
    rows = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    df = docs(spark, rows, clash=False)
    assert near.near_duplicates(df).where("kept").count() == 20
    assert near.near_duplicates(df, percent=85).where("kept").count() == 40
    assert near.deduplicate(df).count() == 20 and near.deduplicate(df, percent=85).count() == 40


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_forest_loses_few_pairs_at_the_threshold(percent):
    forest, share = near.forest_for(percent), percent / 100
    assert (1 - share**near.DEPTH) ** forest.trees <= near.LOSS
    drawn = np.random.default_rng(2).binomial(forest.hashes, share, 1_000_000)
    assert (drawn < forest.agree).mean() < 5 * near.LOSS


def family(count, words=120, changes=4, seed=5):
    """Near copies of one text: each with some words of its own."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(count):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(1, changes)):
            own[at] = f"r{rng.random()}"
        rows.append((i, " ".join(own)))
    return rows


def nodes_of(spark, rows, forest):
    sketches = near.cut(near.sketch(docs(spark, rows, clash=False), "doc_id", "text", forest.hashes))
    return sketches, near.cut(sketches.where("node is not null").select("node", "signature", "low").distinct())


def test_links_contract_to_under_two_per_node(spark, monkeypatch):
    forest = near.forest_for(85)
    _, nodes = nodes_of(spark, family(2000, 200, 1), forest)
    links, made = near.cut(near.candidates(nodes, forest)), []

    def counted(df, rows=None):
        made.append((table := near_cut(df, rows)).count())
        return table

    near_cut = near.cut
    monkeypatch.setattr(near, "cut", counted)
    found = near.components(links)
    assert max(made) <= links.count() and made[-1] < 2 * nodes.count()
    assert all(b <= a for a, b in zip(made, made[1:]))
    assert {r.n for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()} == {nodes.count()}


def test_cells_of_a_large_family_are_even(spark, monkeypatch):
    forest = near.forest_for(85)
    sketches, nodes = nodes_of(spark, family(5000, 200, 1), forest)
    df, cells = docs(spark, family(5000, 200, 1), clash=False), []
    tested = near._tested
    monkeypatch.setattr(near, "_tested", lambda c, percent: cells.append(near.cut(c)) or tested(c, percent))
    sets = near.family_sets(df, sketches, near.cut(near.components(near.candidates(nodes, forest))), "doc_id", "text")
    assert near.confirm(sets, 85).select("component").distinct().count() == 1
    first = [r["count"] for r in cells[0].groupBy("component", "i", "j").count().collect()]
    assert len(first) > 5000 // near.BLOCK and max(first) < 2 * sum(first) / len(first)
    for later in cells[1:]:  # few classes, if any, are outside the largest part
        assert later.count() < 2 * cells[0].count()


def test_recall_of_crowded_regions(spark):
    rows = family(600, 80, 5, 9) + family(300, 90, 6, 10)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    forest = near.forest_for(85)
    small = near.Forest(forest.percent, forest.trees, forest.agree, region=8)
    frame = docs(spark, rows, clash=False).repartition(16)
    for forest in (small, near.Forest(forest.percent, forest.trees, forest.agree, region=32)):
        found = near.near_duplicates(frame, percent=85, forest=forest).collect()
        assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_parts_across_blocks_are_tested(spark, monkeypatch):
    """Families that candidates join but links do not: two blocks' worth of texts in several parts."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "ANCHORS", 1)
    rng = random.Random(8)
    rows = []
    for k in range(3):
        words = [f"k{k} {i}" for i in range(60)]
        for _ in range(30):  # a walk: only near steps of it link
            words[rng.randrange(60)] = f"s{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    frame = docs(spark, rows, clash=False)
    sketches = near.cut(near.sketch(frame, "doc_id", "text", 8))
    one = near.cut(sketches.select("node", F.lit(0).cast("long").alias("component")).distinct())
    parts = near.confirm(near.family_sets(frame, sketches, one, "doc_id", "text"), 85)
    names = sketches.select("id", "node").join(parts, "node", "left").select("id", F.coalesce("component", "node").alias("c"))
    groups_found = {}
    for r in names.collect():
        groups_found.setdefault(r.c, set()).add(r.id)
    wanted = {}
    for i, _, c, _ in brute(rows):
        wanted.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups_found.values())) == sorted(map(sorted, wanted.values()))
