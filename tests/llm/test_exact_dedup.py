from __future__ import annotations

import hashlib
import string
from collections import defaultdict

import pytest

from caseflow.llm import exact_dedup
from tests.llm.frames import ODD, docs, plan

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for doc_id, text in rows:
        plain = (text or "").translate(LOWER)
        ids = groups[plain]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pages", [None, 1])
def test_odd_rows(spark, monkeypatch, pages):
    if pages:  # a filter so small that most rows are taken for possible repeats
        monkeypatch.setattr(exact_dedup, "filter_pages", lambda rows: pages)
        monkeypatch.setattr(exact_dedup, "PAGE_BITS", 16)
    result = exact_dedup.exact_duplicates(docs(spark, ODD))
    assert sorted(map(tuple, result.collect()), key=repr) == brute(ODD)


def test_kept_rows_keep_their_columns(spark):
    df = docs(spark, ODD)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.sha) for r in kept.collect() if r.doc_id) == [
        (i, "own sha") for i in (2, 3, 4, 6, 7, 8, 9)
    ]
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    df = docs(spark, [])
    assert exact_dedup.exact_duplicates(df).count() == 0
    assert exact_dedup.deduplicate(df).count() == 0


def test_one_hot_group(spark):
    rows = [(i, "hot text") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(100)]
    result = exact_dedup.exact_duplicates(docs(spark, rows, clash=False))
    assert {(r.keep_id, r.group_size) for r in result.where("doc_id < 3000").collect()} == {(2999, 3000)}
    assert result.where("kept").count() == 101


def test_no_python_and_only_repeats_shuffle(spark):
    result = exact_dedup.exact_duplicates(docs(spark, ODD))
    assert "Python" not in plan(result) and "Arrow" not in plan(result)
    df = docs(spark, [(i, f"text {i}") for i in range(500)] + [(900, "text 1")])
    tested, _, _, _ = exact_dedup._tested_keys(df, "doc_id", "text")
    assert 2 <= tested.where("maybe").count() <= 20


def test_filter_size_is_bounded():
    assert exact_dedup.filter_pages(0) == 1
    assert exact_dedup.filter_pages(10**12) * exact_dedup.PAGE_BITS == exact_dedup.MAX_FILTER_BITS
