from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from caseflow.llm import conversation_trie as trie
from caseflow.llm import queries
from tests.llm.frames import SF

KIND = "conv_id long, turn int, role string, text string"


def mark(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    """The trie by dictionaries of whole prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, mark(role, text), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(x[:-1] == m for x in members if x)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ended = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, sha))
    return out


def same(result, rows):
    assert sorted(map(tuple, result.collect()), key=repr) == sorted(brute(rows), key=repr)


def conversations(seed, count, depth):
    rng = random.Random(seed)
    texts = ["hi", "hello there", "éö", "", "ok, and then?"]
    rows = []
    for c in range(count):
        for turn in range(rng.randint(1, depth)):
            text = "hi" if turn < 2 and rng.random() < 0.7 else rng.choice(texts)
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    return rows


@pytest.mark.parametrize("band", [1, 2, 3, 32])
def test_by_brute_force(spark, band):
    rows = conversations(band, 120, 12)
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as conv", "2 as depth", "3 as rep", "4 as n", "'x' as path", "5 as mark")
    same(trie.prefix_trie(df.repartition(5), band=band), rows)


def test_long_and_common_conversations(spark):
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(160)]  # as many turns as all others together
    rows += [(c, t, "user", f"turn {t % 3}") for c in range(20, 60) for t in range(3)]
    rows += conversations(9, 12, 6)
    same(trie.prefix_trie(spark.createDataFrame(rows, KIND).repartition(8), band=4), rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no id"), (1, None, "user", "null turn first"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", None),
        (-3, 1, "user", "x"), (-3, 2, "us", "erx"), (-5, 1, "user", "x"), (6, 1, "a", "b"), (7, 1, "ab", ""), (8, 1, "", "ab"),
        (10, 5, "user", "long " * 20_000), (11, 5, "user", "long " * 20_000), (2**40, 3, "user", "far"), (2**40 + 4, 3, "user", "far"),
    ]
    df = spark.createDataFrame(rows, KIND)
    same(trie.prefix_trie(df), rows)
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id is null")).columns == trie.prefix_trie(df).columns
    # the only conversation takes its first turns from one that is absent
    lone = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    few = [(lone, 1, "user", "gone"), (lone, 2, "user", "gone too")]
    same(trie.prefix_trie(spark.createDataFrame(few, KIND)), few)


def test_many_equal_rows(spark):
    rows = [(5, 1, "user", "again")] * 90 + [(5, 2, "user", "end")]
    same(trie.prefix_trie(spark.createDataFrame(rows, KIND).repartition(8), band=8), rows)


def test_ends_of_a_common_node_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(-40, 400).selectExpr("id as conv", "if(id % 3 = 0, 1L, -2L) as rep", "id % 2 as depth").where("depth >= 0")
        found = {(r.rep, r.depth): r.ends_sha256 for r in trie.ends_digests(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in ends.orderBy("conv").collect():
        groups.setdefault((r.rep, r.depth), []).append(str(r.conv))
    assert found == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in groups.items()}


def test_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    same(queries.op13_conversation_trie(spark, SF), rows)
