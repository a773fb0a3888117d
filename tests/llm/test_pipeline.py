"""The pipeline against a replay of its stages by plain loops."""

from __future__ import annotations

import hashlib

import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from caseflow.llm import mixing
from caseflow.llm.queries import QUERIES, tokenizer_path
from caseflow.llm.oracles import ORACLES
from tests.compare import connect, differences
from tests.llm.frames import SF
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_near_dedup import brute as near


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_queries_match_sql(spark):
    connection = connect(SF)
    for name in ORACLES:
        assert differences(spark, connection, name, SF) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, SF))
        seen[name] = docs.collect()
        assert name == "sentencepiece" or docs.columns == columns
    texts = {name: [(r.doc_id, r.text) for r in rows] for name, rows in seen.items() if name != "sentencepiece"}
    start = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {i for i, _ in texts["language_id"]} == start  # all are clean in this respect
    after_exact = {i for i, _, _, kept, _ in exact(texts["language_id"]) if kept}
    assert {i for i, _ in texts["exact_dedup"]} == after_exact
    after_near = {i for i, _, _, kept in near(texts["exact_dedup"], 80) if kept}
    assert {i for i, _ in texts["near_dedup"]} == after_near
    again = mixing.mix(spark.createDataFrame(seen["near_dedup"])).collect()
    assert {i for i, _ in texts["mixing"]} == {r.doc_id for r in again if r["__kept"]}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = {
        (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        for i, t in texts["mixing"]
        for ids in [library.encode(t)]
    }
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in seen["sentencepiece"]} == want
    whole = pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in whole} == want
