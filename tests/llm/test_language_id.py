from __future__ import annotations

import math
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from caseflow.llm import language_id as lid
from caseflow.llm import queries
from tests.llm.frames import ODD, SF, docs

KIND = "doc_id long, text string, lang string, source string"


def test_whole_table(spark):
    rows = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    total, right, kept = rows.agg(
        F.count("*"), F.count(F.when(F.col("language") == F.col("lang"), 1)), F.count(F.when(F.col("kept"), 1))
    ).first()
    assert total == 200 and right >= 199 and kept >= 199


def test_text_alone_tells_most_languages(spark):
    rows = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert rows.where("text_language = lang").count() >= 195


def test_pages_by_markup_and_host(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = lid.identify_pages(pages).join(pages, "page_id")
    assert found.count() == pages.count()
    assert found.where(lid.markup_language(F.col("html")) == F.col("language")).count() >= 0.98 * pages.count()


def odd(spark):
    return docs(spark, [(*r, lang, "h") for r, lang in zip(ODD, ["en"] * 6 + [None] * 6)], KIND)


def test_odd_rows(spark):
    result = lid.identify(odd(spark), declared=F.col("lang"), host=F.col("source"))
    assert result.count() == len(ODD)
    empty = result.where("doc_id in (5, 6)").collect()
    assert all(r.language == lid.UNKNOWN and not r.kept for r in empty)
    df = odd(spark)
    kept = lid.accepted(df)
    assert kept.columns == df.columns and kept.where("doc_id = 9").count() == 1
    assert kept.where("doc_id in (5, 6)").count() == 0


def test_rows_that_share_an_id_are_judged_apart(spark):
    df = docs(spark, [(1, "the house and the garden are here", "en", "h"), (1, None, "en", "h")], KIND)
    assert [r.text for r in lid.accepted(df).collect()] == ["the house and the garden are here"]


def test_no_declared_language_and_empty_table(spark):
    df = docs(spark, [(1, "some words", None, None)], KIND)
    result = lid.identify(df, declared=F.col("lang"), host=F.col("source")).collect()
    assert [(r.language, r.kept) for r in result] == [(lid.UNKNOWN, False)]
    none = docs(spark, [], KIND)
    assert lid.identify(none, declared=F.col("lang"), host=F.col("source")).count() == 0


def test_evidence_settles_short_texts(spark):
    texts = [(i, "the cat sat on the mat with the dog " * 3, "en", "a.example.org") for i in range(60)]
    texts += [(100 + i, "die katze sitzt auf der matte mit dem hund " * 3, "de", "b.example.de") for i in range(60)]
    texts += [(200, "ok", "en", "a.example.org"), (201, "ok", "de", "b.example.de"), (202, "ok", None, "b.example.de")]
    result = lid.identify(docs(spark, texts, KIND), declared=F.col("lang"), host=F.col("source"))
    assert {r.doc_id: r.language for r in result.where("doc_id >= 200").collect()} == {200: "en", 201: "de", 202: "de"}


def test_priors_are_smoothed_step_by_step(spark):
    rows = [("a.x.org", "x.org", 0)] * 8 + [("b.x.org", "x.org", 1)] * 2 + [("c.y.org", "y.org", 1)] * 10
    priors, overall = lid.host_priors(spark.createDataFrame(rows, "host string, domain string, looks int"), 2)
    assert np.allclose(overall, [9 / 22, 13 / 22])
    domain = (8 + lid.DOMAIN_WEIGHT * 9 / 22) / (10 + lid.DOMAIN_WEIGHT)
    want = (0 + lid.HOST_WEIGHT * domain) / (2 + lid.HOST_WEIGHT)
    found = {r["__host"]: r["prior"] for r in priors.collect()}
    assert np.isclose(found["b.x.org"][0], want) and all(np.isclose(sum(p), 1) for p in found.values())


def test_addresses(spark):
    urls = ["http://u:p@Sub.Example.DE:80/x", "https://x/y", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(lid.host_of(F.col("u")).alias("h"))
    found = df.select("h", lid.domain_of(F.col("h")).alias("d"), lid.suffix_of(F.col("h")).alias("s")).collect()
    assert [tuple(r) for r in found] == [
        ("sub.example.de", "example.de", "de"), ("x", "x", None), (None, None, None), (None, None, None),
    ]


def test_numbers_leave_the_letters_beside_them():
    assert lid.language_of("2020年に東京で会議が3回開かれた。") == "年に東京で会議が回開かれた。"
    assert lid.language_of("ab1 see http://x.org/?q=1 or me@x.org k=v now") == "see or now"
    assert lid.language_of("one,two,2020,three") == "one two three"
    assert lid.language_of("plain  words") == "plain  words" and lid.language_of("12 a1") == ""


def test_long_runs_take_linear_time():
    start = time.perf_counter()
    assert len(lid.buckets("a" * 400_000 + " 1")) == 399_998
    assert time.perf_counter() - start < 5


def test_scripts_without_spaces_are_told(spark):
    texts = [(i, f"{2000 + i}年に東京で大きな会議が開かれ多くの人が集まった。", "ja", "h") for i in range(60)]
    texts += [(100 + i, f"in {2000 + i} the people of the town met in the house", "en", "h") for i in range(60)]
    result = lid.identify(docs(spark, texts, KIND), declared=F.col("lang"), host=F.col("source"))
    assert {(r.doc_id < 100, r.language, r.kept) for r in result.collect()} == {(True, "ja", True), (False, "en", True)}


def test_rare_languages_keep_their_documents(spark):
    texts = [(i, f"the people of the town number {i} met in the old house " * 3, "en", f"h{i % 3}") for i in range(3000)]
    texts += [(5000 + i, "люди города собрались в старом доме у реки " * 3, "ru", "h1") for i in range(25)]
    texts += [(6000 + i, "οι άνθρωποι της πόλης ήρθαν στο παλιό σπίτι " * 3, "el", "h2") for i in range(8)]
    texts += [(7000, "the folk o the toun met in the auld hoose " * 3, "sco", "h0"), (7001, "คนในเมืองมาพบกันที่บ้านเก่า" * 3, "th", "h0")]
    texts += [(7002, "the people met in the house " * 3, "und", "h0"), (7003, "the people met in the house " * 3, None, None)]
    result = lid.identify(docs(spark, texts, KIND), declared=F.col("lang"), host=F.col("source"))
    found = {r.doc_id: (r.language, r.kept) for r in result.collect()}
    want = {r[0]: (r[2] if r[2] not in (None, "und") else "en", True) for r in texts}
    assert found == want


def test_whole_table_of_pages(spark):
    """Every page of the table gets a language; texts that the markup declares agree with it."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = queries.language_id_pages(spark, SF)
    assert found.columns == ["page_id", "language", "probability", "text_language", "kept"]
    joined = found.join(pages, "page_id")
    assert found.count() == joined.count() == pages.count()
    assert joined.where(lid.suffix_of(lid.host_of(F.col("url"))).isNotNull()).count() > 0
    declared = joined.where(lid.markup_language(F.col("html")).isNotNull())
    assert declared.where(lid.markup_language(F.col("html")) == F.col("language")).count() >= 0.98 * declared.count() > 0


def plain_posteriors(rows):
    """The method in plain loops: {id: (language, probability)} of (id, text, declared, host) rows."""

    def trigrams(text):
        data = lid.language_of(text or "").lower().encode()
        data += b" " * (3 - len(data)) if 0 < len(data) < 3 else b""
        codes = (data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2))
        return Counter((c * 2654435761 % 2**32) >> 19 for c in codes)

    rows = [(i, trigrams(text), bool(text), None if said in (None, "", lid.UNKNOWN) else said, host) for i, text, said, host in rows]
    declared = Counter(said for _, _, text, said, _ in rows if said is not None and text)
    languages = sorted(v for v, n in declared.items() if n >= lid.LEAST_TEXTS)
    well = {v for v in languages if declared[v] >= lid.WELL_FITTED}
    assert max(declared.values()) <= lid.SAMPLE and len(languages) <= lid.MOST_MODELS
    names = [*languages, lid.UNKNOWN]
    logs = {lid.UNKNOWN: [-math.log(lid.BUCKETS)] * lid.BUCKETS}
    for name in languages:
        uses = Counter()
        for _, grams, _, said, _ in rows:
            if said == name:
                uses.update(grams)
        total = sum(uses.values()) + 0.5 * lid.BUCKETS
        logs[name] = [math.log((uses[b] + 0.5) / total) for b in range(lid.BUCKETS)]

    means, looks = {}, {}
    for at, (_, grams, _, said, _) in enumerate(rows):
        size = sum(grams.values())
        means[at] = {name: sum(n * logs[name][b] for b, n in grams.items()) / max(1, size) for name in names}
        looks[at] = max(names, key=means[at].get) if size else lid.UNKNOWN
        if said is not None and said not in well and size:
            looks[at] = "rare"

    def domain(host):
        return "" if host is None else ".".join(host.split(".")[-2:])

    slots = [*names, "rare"]
    of_all, of_domain, of_host = Counter(), defaultdict(Counter), defaultdict(Counter)
    said_by = defaultdict(Counter)
    for at, (_, _, _, said, host) in enumerate(rows):
        of_all[looks[at]] += 1
        if host is not None:
            of_domain[domain(host)][looks[at]] += 1
            of_host[host][looks[at]] += 1
        if said in well and looks[at] != "rare":
            said_by[looks[at]][said] += 1

    def prior(host, slot):
        share = (of_all[slot] + 1) / (len(rows) + len(slots))
        for counts, weight in ((of_domain[domain(host)], lid.DOMAIN_WEIGHT), (of_host[host], lid.HOST_WEIGHT)):
            if host is not None:
                share = (counts[slot] + weight * share) / (sum(counts.values()) + weight)
        return share

    even = 1 / max(1, len(languages))
    found = {}
    for at, (i, grams, _, said, host) in enumerate(rows):
        size = sum(grams.values())
        if not size:
            found[i] = (lid.UNKNOWN, 1.0)
            continue
        suffix = host.split(".")[-1] if host and "." in host else None
        log, likelihoods = {}, []
        for name in names:
            text = lid.TEMPER * min(size, lid.MOST_TRIGRAMS) * means[at][name]
            likelihoods.append(text)
            before = prior(host, name)
            log[name] = text + math.log(min(before, lid.UNKNOWN_PRIOR) if name == lid.UNKNOWN else before)
            weight = sum(said_by[name].values()) + lid.DECLARED_WEIGHT
            if looks[at] == "rare":
                log[name] += math.log(lid.RARE_SLIP * lid.DECLARED_WEIGHT * even / weight)
            elif said in languages:
                log[name] += math.log((said_by[name][said] + lid.DECLARED_WEIGHT * even) / weight)
            if suffix in languages:
                log[name] += math.log(lid.SUFFIX_TRUST * (suffix == name) + (1 - lid.SUFFIX_TRUST) * even)
        if looks[at] == "rare":
            log[("rare", said)] = max(likelihoods) + math.log(prior(host, "rare"))
        best = max(log, key=log.get)
        odds = sum(math.exp(v - log[best]) for v in log.values())
        found[i] = (best[1] if isinstance(best, tuple) else best, 1 / odds)
    return found


def same_posteriors(result, want):
    got = {r[0]: r for r in result.select(result.columns[0], "language", "probability", "kept").collect()}
    assert got.keys() == want.keys()
    for i, (language, probability) in want.items():
        assert got[i].language == language and abs(got[i].probability - probability) <= 2e-9
        assert got[i].kept == (language != lid.UNKNOWN and got[i].probability >= lid.ACCEPT_FROM)


def test_posteriors_of_whole_tables_by_plain_loops(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    same_posteriors(queries.op10_language_id(spark, SF), plain_posteriors([tuple(r) for r in documents.collect()]))
    html = F.col("html")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", html, lid.markup_language(html), lid.host_of(F.col("url")))
    same_posteriors(queries.language_id_pages(spark, SF), plain_posteriors([tuple(r) for r in pages.collect()]))


def untidy_rows():
    """Common, rare and undeclared languages, short and empty texts, hosts with and without a suffix."""
    town = {"en": "the people of the town met in the old house", "de": "die leute der stadt trafen sich im alten haus"}
    rows = [(i, town["en" if i % 3 else "de"] + f" {i} " * (i % 4), "en" if i % 3 else "de", f"{'ab'[i % 2]}.x.{'de' if i % 5 == 0 else 'org'}") for i in range(90)]
    rows += [(200 + i, "люди города собрались в доме", "ru", "c.y.ru" if i % 2 else None) for i in range(7)]
    rows += [(300, "folk o the toun", "sco", "a.x.org"), (301, "ok", None, "b.x.de"), (302, "a", "de", "src"), (303, "", "en", "a.x.org")]
    return rows + [(304, None, None, None), (305, "123 a1@b", "en", "a.x.org"), (306, town["de"], "en", "b.x.de"), (307, town["en"], "und", None)]


def test_posteriors_of_untidy_rows(spark):
    """Also without a broadcast: priors over the bound are joined by a shuffle, with the same result."""
    rows = untidy_rows()
    want = plain_posteriors(rows)
    df = docs(spark, rows, KIND)
    for most in (lid.BROADCAST_BYTES, 0):
        result = lid.identify(df, declared=F.col("lang"), host=F.col("source"), broadcast_bytes=most)
        same_posteriors(result, want)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (most > 0) and ("SortMergeJoin" in plan) == (most == 0)
