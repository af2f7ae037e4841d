import numpy as np
import pytest

from tempaudit.llm import embedding_dedup, graph
from tempaudit.llm.embedding_dedup import links


def brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, np.float32).astype(float)
            good.setdefault(i, x / np.sqrt(x @ x))
    ids = sorted(good)
    near = {i: {j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold} for i in ids}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([root[i], *(root[j] for j in near[i])])
            changed, root[i] = changed or low != root[i], low
    return {i: (len(near.get(i, ())), root.get(i, i), i is not None and root.get(i, i) == i) for i, _ in rows}


@pytest.mark.parametrize("least", [16, 512])
def test_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(embedding_dedup, "BLOCK_LEAST", least)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] * rng.uniform(0.5, 3) + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.45])).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(250)] + [rows[3]]
    rows += [(600, None), (601, [0.0] * 24), (602, [float("nan")] * 24), (603, [None, 1.0]), (604, [1.0, float("inf")]), (605, []), (606, [1.0, 2.0]),
             (607, [2.0, 4.0]), (608, [1e-30, 2e-30]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, n_links int, rep int")
    got = links(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == want[r.vec_id], r
    assert links(df.filter("vec_id = -1")).count() == 0
    assert [tuple(r) for r in links(df.filter("vec_id = 600")).collect()] == [(600, 0, 600, True)]


def test_components_on_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 60)]
    loose = [tuple(map(int, p)) for p in rng.integers(200, 400, (120, 2))]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain + star + loose + [(5, 5), (900, 900)], "u long, v long")).collect()}
    a, b = np.array(chain + star + loose).T
    want = graph.local_roots(1000, a, b)
    assert all(want[n] == r for n, r in got.items())
    assert set(got) == {int(x) for p in chain + star + loose if p[0] != p[1] for x in p}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0
