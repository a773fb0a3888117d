"""License scan: an exact set-similarity join of text blocks with license templates.

Each text is cut into overlapping blocks of words. A block meets a template if it
holds at least the template's share (``threshold``; 1 for phrases) of its distinct
tokens. The join finds every such pair:

* tokens are ordered by how many documents of the corpus hold them, rarest first;
* prefix filter: a block that lacks all of a template's ``size - need + 1`` rarest
  tokens cannot hold ``need`` of them, so only blocks with a prefix token join;
* length filter: a block with fewer than ``need`` template tokens is out;
* positional filter: from the first common token on, both sides must have
  ``need`` tokens left in the order.

Survivors are verified on their full token sets. For phrases an exact check then
lists the places where the words stand consecutively; a place belongs to the block
in whose first ``stride`` words it starts, so overlaps count nothing twice.

The templates are parameters, so the joined index is small whatever the corpus.
Blocks stay on the task of their document; only one narrow row per document and
task is shuffled at the end.

Defined results: one row per input row, also for repeated rows. Null or empty texts
and texts without words give zeros, empty label texts and null places. Case folding
touches A-Z only: letters beyond ASCII never match a template token.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.8
BLOCK_WORDS = 192
STRIDE_WORDS = 96

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = {
    "cc-by": "cc by",
    "gpl": "general public license",
    "reserved": "all rights reserved",
}

#: Opening sentences of public license notices.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 you may not use this file except in"
        " compliance with the license you may obtain a copy of the license at"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are"
        " permitted provided that the following conditions are met"
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike international license"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of"
        " the gnu general public license as published by the free software foundation"
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files to deal in the software without restriction"
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0"
    ),
}


def text_words(text: Column) -> Column:
    """The words of a text, lower-cased as far as templates can tell; null gives none.

    ``lower`` maps one letter beyond ASCII, the Kelvin sign, into ASCII; it is
    replaced first. What else it changes stays outside ASCII.
    """
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ"))
    return words(F.lower(safe), SEPARATORS)


def _literal(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(df: DataFrame, text_col: str, vocabulary: Sequence[str]) -> list[str]:
    """The template tokens by their number of documents in the whole corpus, rarest first.

    The result is as long as the vocabulary of the templates.
    """
    held = F.array_intersect(text_words(F.col(text_col)), _literal(vocabulary))
    counts = df.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    seen = {r["token"]: r["n"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda token: (seen.get(token, 0), token))


def template_index(spark, order: Sequence[str], phrases: Mapping, templates: Mapping, threshold: float):
    """One row per template and prefix token: token, place, label, need, tokens, phrase."""
    rank = {token: i + 1 for i, token in enumerate(order)}
    rows = []
    for label, text, share, is_phrase in [
        *((k, v, 1.0, True) for k, v in phrases.items()),
        *((k, v, threshold, False) for k, v in templates.items()),
    ]:
        tokens = sorted({rank[t] for t in text.split()})
        need = ceil(share * len(tokens) - 1e-9)
        phrase = text.split() if is_phrase else None
        for place, token in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((token, place, label, need, tokens, phrase))
    schema = "token int, place int, label string, need int, tokens array<int>, phrase array<string>"
    return spark.createDataFrame(rows, schema)


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
    stride_words: int = STRIDE_WORDS,
) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of phrases; ``score`` is the largest share of a
    template that a block holds, 0 if none reaches the threshold.
    """
    longest = max(len(t.split()) for t in [*phrases.values(), *templates.values()])
    if block_words - stride_words < longest:
        raise ValueError("blocks must overlap by the longest template")
    vocabulary = sorted({t for text in [*phrases.values(), *templates.values()] for t in text.split()})
    order = token_order(df, text_col, vocabulary)
    index = template_index(df.sparkSession, order, phrases, templates, threshold)
    prefixes = sorted({r["token"] for r in index.select("token").collect()})

    texts = df.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        text_words(F.col(text_col)).alias("words"),
    )
    prefix_tokens = _literal([order[p - 1] for p in prefixes])
    candidate = F.size(F.array_intersect("words", prefix_tokens)) > 0
    starts = F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {stride_words}"))
    blocks = F.transform(starts, lambda i: F.slice("words", i * stride_words + 1, F.lit(block_words)))
    cut_up = texts.select(
        "id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.posexplode_outer(F.when(candidate, blocks)).alias("block", "block_words"),
    )
    ranks = F.array_sort(
        F.transform(
            F.array_intersect("block_words", _literal(order)),
            lambda t: F.array_position(_literal(order), t).cast("int"),
        )
    )
    probed = cut_up.withColumn("ranks", ranks).withColumn(
        "probe", F.explode_outer(F.array_intersect("ranks", _literal(prefixes)))
    )
    joined = probed.join(F.broadcast(index), F.col("probe") == F.col("token"), "left")

    before = F.slice("tokens", F.lit(1), F.col("place"))
    first_common = F.size(F.array_intersect("ranks", before)) == 0
    left_in_block = F.size("ranks") - F.array_position("ranks", F.col("probe")).cast("int") + 1
    long_enough = F.size("ranks") >= F.col("need")
    overlap = F.size(F.array_intersect("ranks", "tokens"))
    met = long_enough & first_common & (left_in_block >= F.col("need")) & (overlap >= F.col("need"))
    inside = F.filter(
        F.sequence(F.lit(0), F.least(F.size("block_words"), F.lit(stride_words)) - 1),
        lambda i: F.slice("block_words", i + 1, F.size("phrase")) == F.col("phrase"),
    )
    places = F.transform(F.when(F.col("met") & F.col("phrase").isNotNull(), inside), lambda i: F.col("block") * stride_words + i)
    verified = joined.withColumn("met", F.coalesce(met, F.lit(False))).select(
        "id",
        "row",
        "n_words",
        "label",
        F.col("phrase").isNotNull().alias("is_phrase"),
        F.when(F.col("met"), overlap / F.size("tokens")).alias("share"),
        places.alias("places"),
    )
    is_base = F.col("is_phrase") & (F.size("places") > 0)
    is_found = F.when(F.col("is_phrase"), is_base).otherwise(F.col("share").isNotNull())
    joined_labels = lambda found: F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",")
    result = verified.groupBy("id", "row", "n_words").agg(
        F.coalesce(F.sum(F.when(is_base, F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.array_min("places"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.array_max("places"))).cast("long").alias("last_word"),
        joined_labels(is_base).alias("base_labels"),
        joined_labels(is_found).alias("labels"),
        F.coalesce(F.max(F.when(is_found, F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return result.drop("row").withColumnRenamed("id", id_col)
