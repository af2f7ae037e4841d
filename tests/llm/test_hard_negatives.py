import math

import numpy as np
import pytest

from tempaudit.llm import hard_negatives
from tempaudit.llm.hard_negatives import mine, moved_labels, usable


def brute(rows, every):
    good = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        good[i] = min(good.get(i, (label, q)), (label, q))
    good = {i: ((label + 1) % 10 if i % 7 == 0 else label, q) for i, (label, q) in good.items()}
    out = set()
    for a in (i for i in good if i % every == 0):
        score = {i: max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(good[a][1], q)))) for i, (_, q) in good.items() if i != a}
        ranked = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in ranked if good[i][0] == good[a][0]][:5]:
            fits = [i for i in ranked if good[i][0] != good[a][0] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(fits[:3], 1)}
    return out


def rows_of(rng, n, dim, spread):
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + rng.normal(size=dim) * spread).astype(np.float32).tolist(), int(rng.integers(0, 4)) if i % 3 else 1) for i in range(n)]


@pytest.mark.parametrize("block, spread", [(16, 0.05), (16, 0.6), (1024, 0.3)])
def test_against_all_pairs(spark, monkeypatch, block, spread):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    monkeypatch.setattr(hard_negatives, "ZONES", 7)
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 500, 12, spread)
    rows += [(500 + i, rows[10][1], 1) for i in range(200)]  # a very common vector
    rows += [rows[20], (20, rows[21][1], 9), (800, None, 1), (805, rows[1][1], None), (None, rows[1][1], 1), (810, [float("nan")] * 12, 1),
             (815, [None, 1.0], 2), (820, [float("inf")], 2), (825, [], 3), (830, [0.5, 0.25], 1), (840, [0.0] * 12, 2), (850, rows[2][1] + [1.5], 1)]
    df = spark.createDataFrame([(i, v, label, 0, 0) for i, v, label in rows], "vec_id long, embedding array<float>, label int, block int, score int")
    got = [tuple(r) for r in mine(moved_labels(usable(df, "embedding", "vec_id", "label"), 7, 10), 10).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, 10)


def test_huge_and_tiny_tables(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (i % 15)).astype(np.float32).tolist(), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in mine(moved_labels(usable(df, "embedding", "vec_id", "label"), 7, 10), 5).collect()]
    assert set(got) == brute(rows, 5) and len(got) == len(set(got))
    one = usable(df.filter("vec_id = 5"), "embedding", "vec_id", "label")
    assert mine(one, 5).count() == 0
    assert mine(one.filter("id < 0"), 5).count() == 0
    assert mine(one, 7).count() == 0


def test_zone_maps_bound_every_product():
    rng = np.random.default_rng(5)
    x, blocks = rng.integers(-300, 300, (20, 9)), rng.integers(-300, 300, (6, 15, 9))
    least, most = hard_negatives.bounds(x, blocks.min(1), blocks.max(1))
    scores = np.einsum("ad,brd->abr", x, blocks)
    assert (least <= scores.min(2)).all() and (most >= scores.max(2)).all()


def test_few_blocks_are_read_where_vectors_form_clusters(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 20)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    rng = np.random.default_rng(6)
    axes = np.eye(8)
    rows = [(i, (axes[i % 8] + rng.normal(size=8) * 0.02).tolist(), (i // 8) % 2) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = []
    monkeypatch.setattr(hard_negatives, "wanted_tiles", lambda *a, f=hard_negatives.wanted_tiles: seen.append((f(*a), a)) or seen[-1][0])
    got = {tuple(r) for r in mine(moved_labels(usable(df, "embedding", "vec_id", "label"), 7, 10), 50).collect()}
    assert got == brute(rows, 50)
    for tiles, (_, groups, candidates, *_) in seen:
        blocks = candidates.select("block").distinct().count()
        assert tiles.count() < 0.4 * groups * blocks
