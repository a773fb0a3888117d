"""Small inputs: odd rows, and frames whose other columns clash with the operators' names."""

from __future__ import annotations

from pyspark.sql import functions as F

CLASHING = (
    "id sha page bits cell hits maybe keep_id group_size row words block ranks token place label need tokens phrase"
    " size row_number shard slot n_shingles node signature low key tree a b component members values n_words held_out"
    " score encoded digest evidence means declared host prior domain looks topic"
).split()

SF = "/root/testdata/sf0.001"

ODD = [
    (1, "Same words here and there, again"),
    (2, "same WORDS here and there, again"),
    (3, "same words here and there, agaín"),
    (4, "SAME words here and there, agaÍn"),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (7, " \n\t "),
    (None, "no id at all"),
    (None, "no id at all"),
    (8, "x"),
    (9, "long " * 30_000 + "end."),
]


def docs(spark, rows, kind="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, kind)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clash else df


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
