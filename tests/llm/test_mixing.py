import random
import re

import pytest
from pyspark.sql import functions as F

from tempaudit.llm import mixing
from tempaudit.llm.mixing import capped_targets, cycled, mix, mixed_rows, route


def test_targets_stop_at_the_cap_and_share_the_excess():
    assert capped_targets([100, 100, 100], [5, 2, 1], 450, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert capped_targets([10, 10], [1, 1], 100, 2) == [20, 20]
    assert capped_targets([0, 50], [3, 1], 60, 2) == [0, 60]
    assert capped_targets([], [], 0, 2) == []


def least_cost(patterns, quotas, repeats):
    """Best (met, -cost) over all integer routings of a tiny instance."""
    best = None
    choices = [[]]
    for sources, size in patterns:
        ways = [()]
        for _ in sources:
            ways = [w + (x,) for w in ways for x in range(size * repeats + 1) if sum(w) + x <= size * repeats]
        choices = [c + [w] for c in choices for w in ways]
    for choice in choices:
        got = [0] * len(quotas)
        for (sources, _), way in zip(patterns, choice):
            for s, x in zip(sources, way):
                got[s] += x
        if all(g <= q for g, q in zip(got, quotas)):
            cost = sum(sum(max(0, sum(way) - r * size) for r in range(1, repeats)) for (_, size), way in zip(patterns, choice))
            best = max(best or (-1, 0), (sum(got), -cost))
    return best


def test_flow_is_largest_and_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        k = rng.randint(1, 3)
        patterns = [(sorted(rng.sample(range(k), rng.randint(1, k))), rng.randint(0, 3)) for _ in range(rng.randint(1, 3))]
        quotas = [rng.randint(0, 6) for _ in range(k)]
        flow = route(patterns, quotas, 2)
        assert all(sum(f.values()) <= 2 * size and min(f.values()) >= 0 for f, (_, size) in zip(flow, patterns))
        got = [sum(f.get(s, 0) for f in flow) for s in range(k)]
        assert all(g <= q for g, q in zip(got, quotas))
        cost = sum(max(0, sum(f.values()) - size) for f, (_, size) in zip(flow, patterns))
        assert (sum(got), -cost) == least_cost(patterns, quotas, 2), (patterns, quotas, flow)


def test_overlapping_sources(docs, odd_texts, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    names = [None if i % 11 == 0 else "hot" if i % 2 else f"s{i % 4}" for i in range(len(odd_texts))]
    table = docs(odd_texts, names).withColumn("size", F.lit("clash"))
    sources = F.when(F.col("doc_id") % 5 == 0, F.array("source", F.lit("s2"))).otherwise(F.array("source"))
    got = mix(table, sources, cycled(5, 2, 1))
    rows = sorted(map(tuple, got.documents.select("doc_id", "size", "taken", F.to_json("shares")).collect()))
    again = sorted(map(tuple, mix(table.repartition(5), sources, cycled(5, 2, 1)).documents.select("doc_id", "size", "taken", F.to_json("shares")).collect()))
    assert rows == again and len(rows) == len(odd_texts)
    for i, size, taken, _ in rows:
        assert size == len(re.findall(r"[^\x20\x09-\x0D]+", odd_texts[i] or "")) and 0 <= taken <= 2 * size
    by_source = {r.source: r.words for r in got.documents.select(F.explode("shares").alias("p")).select("p.*").groupBy("source").agg(
        F.sum("words").alias("words")).collect()}
    for name, _, target, routed in got.sources:
        assert by_source.get(name, 0) == routed and routed <= target + 1
    assert sum(r[2] for r in rows) == sum(by_source.values())
    assert [s[0] for s in got.sources][-1] is None


def test_single_sources_meet_their_targets(docs, odd_texts, empty_docs):
    table = docs([" ".join(["w"] * (i % 40)) for i in range(400)], ["big" if i % 3 else f"s{i % 7}" for i in range(400)])
    got = mix(table, F.array("source"), cycled(5, 2, 1))
    for _, size, target, routed in got.sources:
        assert abs(routed - target) <= 1 and target <= 2 * size + 1e-6
    whole = mixed_rows(table, got)
    assert whole.columns == table.columns
    words = sum(len(r.text.split()) for r in whole.collect())
    assert abs(words - sum(s[3] for s in got.sources)) <= 20 * len(got.sources)
    none = mix(empty_docs, F.array("source"), cycled(1))
    assert none.documents.count() == 0 and none.sources == [] and mixed_rows(empty_docs, none).count() == 0
