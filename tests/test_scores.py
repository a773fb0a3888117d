from __future__ import annotations

import random

from pyspark.sql import functions as F

from caseflow.functions import scores


def test_percent_text_rounds_like_c(spark):
    chance = random.Random(3)
    rates = [0.0, 0.0005, 0.0025, 0.0035, 0.0625, 0.1875, 0.82, 0.999499, 0.9995, 1.0, 0.00049999]
    rates += [n / 2000 for n in range(2001)]
    rates += [chance.randint(0, b) / b for b in (chance.randint(1, 10**6) for _ in range(2000))]
    df = spark.createDataFrame([(r,) for r in rates], "r double")
    got = df.select("r", F.expr(scores.percent_text("r")).alias("text")).collect()
    assert [(r["r"], r["text"]) for r in got] == [(r["r"], f"{r['r']:.1%}") for r in got]


def test_bands(spark):
    df = spark.createDataFrame([(s,) for s in (0.75, 0.7499, 0.60, 0.5999, 0.45, 0.4499)], "s double")
    got = [r[0] for r in df.select(scores.ses_band(F.col("s"))).collect()]
    assert got == ["healthy", "watch", "watch", "needs_attention", "needs_attention", "critical"]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1,), (None,), (2,)], "d int")
    assert [r[0] for r in df.select(scores.non_negative(F.col("d"))).collect()] == [0, None, 2]
