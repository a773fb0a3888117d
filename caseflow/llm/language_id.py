"""Language ID by Bayesian evidence fusion.

For every document the log posterior of each language adds up

* the text likelihood: byte trigrams, hashed to ``BUCKETS``, under one distribution
  per language, tempered because trigrams of one text depend on each other; numbers,
  addresses and keys (runs of ASCII characters with a digit, @ or =) are no language
  and left out, but never the letters beyond ASCII beside them;
* the declared language (of the markup, or of a column): how often texts that look
  like language l declare what this one declares, counted over all documents;
* the address suffix: a country suffix that names a known language speaks for it;
* the host's prior: the languages of the host's texts, smoothed towards those of its
  domain, which are smoothed towards all documents (hierarchical smoothing). The
  counts are grouped aggregations over all documents.

The text model is fitted on a bounded sample of declared documents (all, or some
``SAMPLE`` per language drawn by hash if there are more); languages are the declared values
of at least ``LEAST_TEXTS`` texts, the ``MOST_MODELS`` most frequent if there are more. A
language ``und`` (undetermined) spreads its likelihood evenly; it wins on texts without
known trigrams. Documents whose best language is ``und``, or less likely than
``ACCEPT_FROM``, are rejected.

Declared values of fewer than ``WELL_FITTED`` texts, or beyond the models, are rare: too
little is known of their texts to set them against a related language. A document that
declares one can also be of that language, for which its text speaks neither way: the
declared value and the host's prior (its share of rare declarations) decide.

Defined results: null and empty texts have no likelihood, and are always ``und``
and rejected. Null declared languages, hosts or suffixes add nothing (a null host
has the prior of all documents). Repeated rows are judged alike. Without any
declared document all are ``und``. A declared ``und`` or empty value counts as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import cut, draw, text_key, without_rows

UNKNOWN = "und"
NO_LANGUAGE = re.compile(r"[0-9@=]")
#: Runs within a word: of ASCII characters, or of others.
RUNS = re.compile(r"[\x00-\x7f]+|[^\x00-\x7f]+")
#: What joins the words of a text that has no white space, outside of addresses.
JOINTS = re.compile(r"[,;|<>()\[\]{}\"]+")
BUCKETS = 1 << 13
SAMPLE = 2_000
SEED = 29
LEAST_TEXTS = 3
WELL_FITTED = 20
MOST_MODELS = 300
#: How much likelier a wrong declaration names a common language than a rare one.
RARE_SLIP = 0.1
TEMPER = 0.2
MOST_TRIGRAMS = 400
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 50.0
DECLARED_WEIGHT = 5.0
SUFFIX_TRUST = 0.8
UNKNOWN_PRIOR = 0.001
ACCEPT_FROM = 0.5
#: Bytes of host priors up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of a prior's row beside its probabilities: the host's name and headers.
ROW_BYTES = 200


def _language_of_word(word: str) -> str:
    """A word without its numbers, addresses and keys."""
    kept = []
    for run in RUNS.findall(word):
        if not NO_LANGUAGE.search(run):
            kept.append(run)
        elif "://" not in run:
            kept.append(" ".join(p for p in JOINTS.split(run) if p and not NO_LANGUAGE.search(p)))
    return "".join(kept)


def language_of(text: str) -> str:
    """A text without its numbers, addresses and keys, in time linear in its length."""
    if not NO_LANGUAGE.search(text):
        return text
    words = (_language_of_word(w) if NO_LANGUAGE.search(w) else w for w in text.split())
    return " ".join(w for w in words if w)


def buckets(text: str) -> np.ndarray:
    """The hashed byte trigrams of a text without its numbers, addresses and keys."""
    text = language_of(text)
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        data = np.concatenate((data, np.full(3 - len(data), 32, np.uint32))) if len(data) else data
    if not len(data):
        return np.zeros(0, np.int64)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


# --- markup and addresses ------------------------------------------------------------


def markup_language(html: Column) -> Column:
    """The primary language that a page's html element declares, lower-cased; null if none."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)
    return F.when(found != "", F.lower(found))


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host with at least two."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


# --- text model ----------------------------------------------------------------------


def languages_of(rows: DataFrame) -> dict[str, int]:
    """Texts of the declared values that get a model."""
    counts = rows.where("declared is not null and text <> ''").groupBy("declared").agg(F.count("*").alias("n"))
    fitted = counts.where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "declared").limit(MOST_MODELS).collect()
    return {r["declared"]: r["n"] for r in sorted(fitted)}


def fit_text_model(rows: DataFrame, counts: Mapping[str, int]) -> np.ndarray:
    """Log probabilities of the buckets: one row per language, and one for UNKNOWN."""
    languages = list(counts)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(languages), BUCKETS))
        for batch in batches:
            for language, text in zip(batch["declared"], batch["text"]):
                total[languages.index(language)] += np.bincount(buckets(text), minlength=BUCKETS)
        seen = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame({"at": seen, "part": pd.Series(list(total[seen]), dtype=object)})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": parts["at"][:1], "part": [np.sum(np.stack(parts["part"]), axis=0)]})

    model = np.full((len(languages) + 1, BUCKETS), -np.log(BUCKETS))
    if languages:
        drawn = draw(SEED, F.col("id"), F.col("text"))
        shares = F.create_map(*[F.lit(x) for language, n in counts.items() for x in (language, SAMPLE / n)])
        chosen = drawn < F.try_element_at(shares, F.col("declared"))
        sample = rows.where(F.col("text").isNotNull() & chosen).select("declared", "text")
        parts = sample.mapInPandas(partial, "at int, part array<double>")
        summed = parts.groupBy("at").applyInPandas(add, "at int, part array<double>").collect()
        for at, part in summed:
            smooth = 0.5 + np.array(part)
            model[at] = np.log(smooth / smooth.sum())
    return model


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` with ``trigrams`` (their number) and ``means`` (mean log likelihood per language)."""

    by_bucket = np.ascontiguousarray(model.T)

    @F.pandas_udf("trigrams long, means array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for text in texts.fillna(""):
                uses = np.bincount(buckets(text), minlength=BUCKETS).astype(float)
                at = np.flatnonzero(uses)
                # few rows of the model are picked; beyond that one product with all of it is faster
                total = uses[at] @ by_bucket[at] if 16 * len(at) < BUCKETS else model @ uses
                out.append((int(uses.sum()), total / max(1, uses.sum())))
            yield pd.DataFrame(out, columns=["trigrams", "means"])

    return rows.withColumn("evidence", evidence("text")).select("*", "evidence.*").drop("evidence", "text")


# --- priors by grouped aggregation ---------------------------------------------------


def _counts_by(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """Counts of ``looks`` (a language's number) per key as an array."""
    sums = [F.count(F.when(F.col("looks") == i, 1)).cast("double") for i in range(size)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias(name))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: (n + weight * p) / (total + weight))


def host_priors(rows: DataFrame, size: int) -> tuple[DataFrame, list[float]]:
    """(host, prior) smoothed over domain and all documents, and the prior of all documents."""
    overall = _counts_by(rows, [], size, "counts").first()["counts"]
    shares = [(n + 1.0) / (sum(overall) + size) for n in overall]
    prior_of_all = F.array(*[F.lit(s) for s in shares])
    hosts = cut(_counts_by(rows.where("host is not null"), ["domain", "host"], size, "counts"), int(sum(overall)))
    adders = [F.sum(F.col("counts")[i]) for i in range(size)]
    domains = hosts.groupBy("domain").agg(F.array(*adders).alias("of_domain"))
    domains = domains.withColumn("domain_prior", _smoothed(F.col("of_domain"), prior_of_all, DOMAIN_WEIGHT))
    joined = hosts.join(domains, "domain")
    n_hosts = hosts.count()
    prior = _smoothed(F.col("counts"), F.col("domain_prior"), HOST_WEIGHT)
    return cut(joined.select(F.col("host").alias("__host"), prior.alias("prior")), n_hosts), shares


# --- fusion --------------------------------------------------------------------------


def _judged(
    df: DataFrame,
    id_col: str,
    text_col: str,
    declared: Column | None,
    host: Column | None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row of ``df``: id, text_key, language, probability, text_language, kept."""
    none = F.lit(None).cast("string")
    declared = none if declared is None else F.when(~declared.isin("", UNKNOWN), declared)
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        text_key(F.col(text_col)).alias("text_key"),
        declared.alias("declared"),
        (none if host is None else host).alias("host"),
    )
    counts = languages_of(rows)
    languages = list(counts)
    names = [*languages, UNKNOWN]
    size = len(names)
    known = [n for n in languages if counts[n] >= WELL_FITTED]
    rows = rows.withColumn("domain", F.coalesce(domain_of(F.col("host")), F.lit(""))).withColumn(
        "suffix", suffix_of(F.col("host"))
    )
    scored = text_evidence(rows, fit_text_model(rows, counts))
    best = F.array_position("means", F.array_max("means")).cast("int") - 1
    scored = scored.withColumn("text_looks", F.when(F.col("trigrams") > 0, best).otherwise(size - 1))
    rare = F.col("declared").isNotNull() & ~F.col("declared").isin(known) & (F.col("trigrams") > 0)
    scored = scored.withColumn("looks", F.when(rare, size).otherwise(F.col("text_looks")))
    scored = cut(scored)

    priors, prior_of_all = host_priors(scored, size + 1)
    confusion = scored.where(F.col("declared").isin(known) & (F.col("looks") < size)).groupBy("looks", "declared").agg(F.count("*").alias("n"))
    seen = np.zeros((size, len(languages)))
    for r in confusion.collect():
        seen[r["looks"], languages.index(r["declared"])] = r["n"]
    even = 1 / max(1, len(languages))
    declares = np.log((seen + DECLARED_WEIGHT * even) / (seen.sum(axis=1, keepdims=True) + DECLARED_WEIGHT))
    slips = RARE_SLIP * DECLARED_WEIGHT * even / (seen.sum(axis=1) + DECLARED_WEIGHT)
    says_suffix = np.log(np.full((size, len(languages)), (1 - SUFFIX_TRUST) * even))
    says_suffix[np.arange(len(languages)), np.arange(len(languages))] = np.log(SUFFIX_TRUST + (1 - SUFFIX_TRUST) * even)

    if priors.count() * (8 * (size + 1) + ROW_BYTES) <= broadcast_bytes:
        priors = F.broadcast(priors)
    else:
        priors = priors.hint("merge")
    joined = scored.join(priors, F.col("host") == F.col("__host"), "left")
    joined = joined.withColumn("prior", F.coalesce("prior", F.array(*[F.lit(p) for p in prior_of_all])))

    @F.pandas_udf("language string, probability double")
    def fuse(
        trigrams: pd.Series, means: pd.Series, declared: pd.Series, suffix: pd.Series, prior: pd.Series, looks: pd.Series
    ) -> pd.DataFrame:
        weight = TEMPER * np.minimum(trigrams.to_numpy(), MOST_TRIGRAMS)
        text = np.stack(means) * weight[:, None]
        prior = np.stack(prior)
        prior[:, size - 1] = np.minimum(prior[:, size - 1], UNKNOWN_PRIOR)
        log = text + np.log(prior[:, :size])
        rare = looks.to_numpy() == size
        for said, table in ((declared.mask(rare), declares), (suffix, says_suffix)):
            at = pd.Categorical(said, categories=languages).codes
            spoken = at >= 0
            log[spoken] += table[:, at[spoken]].T
        log[rare] += np.log(slips)
        own = np.where(rare, text.max(axis=1) + np.log(prior[:, size]), -np.inf)
        log = np.column_stack((log, own))
        log[trigrams.to_numpy() == 0] = np.where(np.arange(size + 1) == size - 1, 0.0, -50.0)
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        pick = odds.argmax(axis=1)
        language = np.where(pick == size, declared.to_numpy(object), np.array([*names, None], object)[pick])
        return pd.DataFrame({"language": language, "probability": np.round(odds.max(axis=1), 9)})

    named = F.array(*[F.lit(n) for n in names])
    fused = joined.select(
        "id",
        "text_key",
        fuse("trigrams", "means", "declared", "suffix", "prior", "looks").alias("fused"),
        named[F.col("text_looks")].alias("text_language"),
    )
    kept = (F.col("fused.language") != UNKNOWN) & (F.col("fused.probability") >= ACCEPT_FROM)
    return fused.select("id", "text_key", "fused.language", "fused.probability", "text_language", kept.alias("kept"))


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row of ``df``: id, language, probability, text_language, kept.

    ``declared`` and ``host`` are columns of ``df``; the suffix and domain follow
    from the host. Host priors of more than ``broadcast_bytes`` are not broadcast.
    """
    judged = _judged(df, id_col, text_col, declared, host, broadcast_bytes)
    return judged.drop("text_key").withColumnRenamed("id", id_col)


def identify_pages(pages: DataFrame, id_col: str = "page_id", text: str = "html", url: str = "url") -> DataFrame:
    """``identify`` for web pages: language declared by the markup, host of the address."""
    return identify(pages, id_col, text, markup_language(F.col(text)), host_of(F.col(url)))


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "lang", host: str = "source"):
    """The rows of ``df`` that are not rejected."""
    judged = _judged(df, id_col, text_col, F.col(declared), F.col(host))
    return without_rows(df, id_col, text_col, judged.where("not kept").select("id", "text_key"))
