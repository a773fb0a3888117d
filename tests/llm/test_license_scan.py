from __future__ import annotations

import re

import pytest

from caseflow.llm import license_scan as scan
from tests.llm.frames import ODD, docs, plan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = scan.TEMPLATES["mit"]
TEXTS = [
    *ODD,
    (20, "Under CC-BY 4.0. All rights reserved; all Rights\nRESERVED."),
    (21, "by cc rights all reserved; cc\nby cc by"),
    (22, MIT.upper()),
    (23, " ".join(MIT.split()[4:])),
    (24, "filler " * 150 + "GNU General Public License " + "filler " * 500 + "general public license"),
    (25, "w " * 95 + "cc by " + "w " * 94 + "all rights reserved"),
    (26, "licens and the of to in"),
    (27, "all rights reservedé ccé by cc by"),
    (28, " ".join(reversed(scan.TEMPLATES["bsd"].split()))),
]


def fold(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(doc_id, text):
    words = WORD.findall(fold(text))
    places, score, labels = [], 0.0, set()
    for label, phrase in scan.PHRASES.items():
        phrase = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        places += [(i, label) for i in found]
    base = {label for _, label in places}
    for label, template in scan.TEMPLATES.items():
        tokens = set(template.split())
        for start in range(0, len(words), scan.STRIDE_WORDS):
            held = len(tokens & set(words[start : start + scan.BLOCK_WORDS])) / len(tokens)
            if held >= scan.THRESHOLD - 1e-9:
                labels.add(label)
                score = max(score, held)
    at = [i for i, _ in places]
    return (
        doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | labels)), 1.0 if base else score,
    )


def test_against_brute_force(spark):
    result = scan.scan(docs(spark, TEXTS))
    assert sorted(map(tuple, result.collect()), key=repr) == sorted((brute(*t) for t in TEXTS), key=repr)


def test_the_method_finds_its_labels(spark):
    found = {r.doc_id: r.labels for r in scan.scan(docs(spark, TEXTS, clash=False)).where("doc_id > 19").collect()}
    assert found[22] == "mit" and found[23] == "mit" and found[28] == "bsd" and found[20] == "cc-by,reserved"


def test_rare_order_changes_no_result(spark):
    common = [(100 + i, "granted permission software documentation") for i in range(50)]
    rows = TEXTS + common
    result = scan.scan(docs(spark, rows, clash=False))
    assert sorted(map(tuple, result.collect()), key=repr) == sorted((brute(*t) for t in rows), key=repr)


def test_letters_that_lower_into_ascii(spark):
    result = scan.scan(docs(spark, [(1, "all rights reserved Kelvin"), (2, "CC BY İ")], clash=False))
    assert {(r.doc_id, r.n_words, r.n_base) for r in result.collect()} == {(1, 4, 1), (2, 3, 1)}


def test_empty_table(spark):
    assert scan.scan(docs(spark, [])).count() == 0


def test_blocks_must_overlap(spark):
    with pytest.raises(ValueError):
        scan.scan(docs(spark, TEXTS), block_words=100, stride_words=99)


def test_no_python(spark):
    shown = plan(scan.scan(docs(spark, TEXTS)))
    assert "Python" not in shown and "Arrow" not in shown and "NestedLoop" not in shown and "Cartesian" not in shown
