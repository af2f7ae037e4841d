import os
import random

import pytest
from pyspark.sql import functions as F

from tempaudit.llm.quality_classifier import classify

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = classify(docs, labels.filter(~held), F.col("source"), F.col("lang")).join(labels.filter(held), "doc_id").collect()
    assert len(got) > 100
    assert sum((r.p_quality >= 0.5) == (r.quality == 1) for r in got) >= 0.93 * len(got)
    clean = [r.kept for r in got if r.quality == 1 and r.toxic == 0]
    assert sum(clean) >= 0.95 * len(clean)
    assert sum(r.kept for r in got if r.quality == 0) <= 0.25 * sum(r.quality == 0 for r in got)


def test_sites_shrink_to_the_level_above(spark, docs):
    """One text everywhere: only the sites' records tell documents apart, and few documents tell less than many."""
    rng, texts, sources, labels = random.Random(2), [], [], []
    for source, n, good in (("bad", 300, 0.1), ("good", 300, 0.9), ("few", 3, 0.0)):
        for _ in range(n):
            labels.append((len(texts), int(rng.random() < good), 0))
            texts.append("the same plain words in all of them here")
            sources.append(source)
    got = {r.source: r for r in classify(docs(texts, sources), spark.createDataFrame(labels, LABELS), F.col("source"), F.col("lang")).join(
        docs(texts, sources).select("doc_id", "source"), "doc_id").dropDuplicates(["source"]).collect()}
    assert got["bad"].p_quality < 0.2 and got["good"].p_quality > 0.8
    assert got["bad"].host_quality < got["few"].host_quality < 0.5
    assert not got["bad"].kept and got["good"].kept


def test_odd_rows(spark, docs, odd_texts, empty_docs):
    labels = spark.createDataFrame([(0, None, None), (None, 1, 0), (5, 1, 0), (5, 0, 0), (10**9, 1, 1)], LABELS)
    sources = [None if i % 2 else "s" for i in range(len(odd_texts))]
    table = docs(odd_texts, sources).withColumn("kept", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.doc_id: r for r in classify(table, labels, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(odd_texts)
    assert all(got[i].kept == bool((t or "").strip(" \t\n\r\x0b\x0c")) for i, t in enumerate(odd_texts))
    assert classify(empty_docs, labels, F.col("source"), F.col("lang")).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert classify(table, none, F.col("source"), F.col("lang")).filter("kept").count() == sum(r.kept for r in got.values())


def test_shrunk_rates_against_plain_python(spark, docs):
    """Every document is labelled and has one text, so that rates and posteriors follow from counts alone."""
    import math
    from collections import defaultdict

    from tempaudit.llm.quality_classifier import WEIGHTS

    rng, rows = random.Random(6), []
    for h in range(12):
        for p in range(h % 4 + 1):
            rows += [(None if h == 3 else f"h{h}", None if p == 2 else f"p{p}", int(rng.random() < 0.15 + 0.06 * h + 0.05 * p)) for _ in range(rng.randint(1, 25))]
    table = docs(["the same plain words in all of them here"] * len(rows), [r[0] for r in rows])
    paths = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, path string")
    labels = spark.createDataFrame([(i, r[2], 0) for i, r in enumerate(rows)], LABELS)
    got = {r.doc_id: r for r in classify(table.join(paths, "doc_id"), labels, F.col("source"), F.col("path")).collect()}

    def sums(key):
        out = defaultdict(lambda: [0, 0])
        for r in rows:
            out[key(r)][0] += 1
            out[key(r)][1] += r[2]
        return out

    def weight(groups):
        n, nn, k = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups), len(groups)
        between = (sum(g[0] * (g[1] / g[0] - rate) ** 2 for g in groups) - (k - 1) * rate * (1 - rate)) / (n - nn / n)
        return min(max(rate * (1 - rate) / between - 1 if between > 0 else WEIGHTS[1], WEIGHTS[0]), WEIGHTS[1])

    rate, hosts, sites = sum(r[2] for r in rows) / len(rows), sums(lambda r: r[0]), sums(lambda r: r[:2])
    k_host, k_site = weight(list(hosts.values())), weight(list(sites.values()))
    logit = lambda x: math.log(x / (1 - x))
    texts = set()
    for i, r in enumerate(rows):
        host = (hosts[r[0]][1] + k_host * rate) / (hosts[r[0]][0] + k_host)
        site = (sites[r[:2]][1] + k_site * host) / (sites[r[:2]][0] + k_site)
        assert got[i].host_quality == pytest.approx(host) and got[i].path_quality == pytest.approx(site)
        texts.add(round(logit(got[i].p_quality) - logit(site) + logit(rate), 6))
    assert len(texts) == 1  # the text's own evidence, the same for all
