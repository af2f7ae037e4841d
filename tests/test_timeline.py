"""Ordered operators against plain loops, with whole and with cut runs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempaudit.operators import curves, excursions, holds
from tempaudit.operators.timeline import (Timeline, following, last_seen, next_seen, position, prev, range_sums, run_max, run_sum)


def make_runs(seed, n_runs=4, lengths=(3, 60), gaps=(5, 60)):
    rng = random.Random(seed)
    runs = {}
    for run in range(n_runs):
        t, points = 0.0, []
        for _ in range(rng.randint(*lengths)):
            t += rng.randint(*gaps)
            points.append((t, round(rng.uniform(0, 20), 1)))
        runs[run] = points
    return runs


def by_run(df, *cols):
    return {row["run_id"]: tuple(row[c] for c in cols) if len(cols) > 1 else row[cols[0]] for row in df.collect()}


def test_scans_match_pandas(form, series):
    runs = make_runs(1)
    df = series(runs).withColumn("maybe", F.when(F.col("value") > 12, F.col("value")))
    tl = Timeline.open(df)
    assert tl.pieces == (form == "pieces")
    got = tl.scan(p=prev("maybe"), n=following("maybe"), last=last_seen("maybe"), nxt=next_seen("maybe"), total=run_sum("value"),
                  top=run_max("value"), pos=position()).rows().toPandas().sort_values(["run_id", "us"])
    for run, part in got.groupby("run_id"):
        v = pd.Series([x for _, x in runs[run]], index=part.index)
        m = v.where(v > 12)
        pd.testing.assert_series_equal(part["p"], m.shift(1), check_names=False)
        pd.testing.assert_series_equal(part["n"], m.shift(-1), check_names=False)
        pd.testing.assert_series_equal(part["last"], m.ffill(), check_names=False)
        pd.testing.assert_series_equal(part["nxt"], m.bfill(), check_names=False)
        np.testing.assert_allclose(part["total"], v.cumsum())
        np.testing.assert_allclose(part["top"], v.cummax())
        assert list(part["pos"]) == list(range(1, len(v) + 1))


def loop_latch(points, on, off):
    state, out = False, []
    for _, v in points:
        if not state and v >= on:
            state = True
        elif state and v < off:
            state = False
        out.append(state)
    return out


def stretches(points, flags):
    out, start = [], None
    for i, f in enumerate(list(flags) + [None]):
        if start is not None and (f is None or f != flags[start]):
            out.append((flags[start], points[start][0], points[i - 1][0]))
            start = None
        if start is None and f is not None:
            start = i
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_latched_hold(form, series, seed):
    runs = make_runs(seed)
    got = by_run(holds.latched_hold(Timeline.open(series(runs)), 11.0, 4.0), "hold_s", "hold_start_us")
    for run, points in runs.items():
        best, start = 0.0, None
        for on, a, b in stretches(points, loop_latch(points, 11.0, 7.0)):
            if on and b - a > best:
                best, start = b - a, a
        assert got[run] == (best, None if start is None else int(start * 1e6))


@pytest.mark.parametrize("budget", [0.0, 90.0, 400.0, 1e9])
def test_budgeted_hold(form, series, budget):
    runs = make_runs(4)
    got = by_run(holds.budget_hold(Timeline.open(series(runs)), 9.0, budget), "cumulative_s")
    for run, points in runs.items():
        used = total = 0.0
        for above, a, b in stretches(points, [v >= 9.0 for _, v in points]):
            if above:
                total += b - a
            elif used + (b - a) <= budget:
                used += b - a
            else:
                break
        assert got[run] == pytest.approx(total)


def test_crossing(form, series):
    runs = make_runs(5)
    got = by_run(curves.crossing(Timeline.open(series(runs)), 8.0), "cross_s")
    for run, points in runs.items():
        want = None
        for (t0, v0), (t1, v1) in zip(points, points[1:]):
            if v0 >= 8.0 >= v1:
                want = (t0 if v0 == v1 else t0 + (8.0 - v0) / (v1 - v0) * (t1 - t0)) - points[0][0]
                break
        assert got[run] == (None if want is None else pytest.approx(want))


def test_uniformity(form, series):
    runs = make_runs(6)
    got = by_run(curves.rolling_uniformity(Timeline.open(series(runs)), 100.0), "uniformity", "windows")
    for run, points in runs.items():
        t, v = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        stds = [np.std(v[m]) for x in t if (m := (t >= x - 100) & (t <= x + 100)).sum() >= 3]
        assert got[run][1] == len(stds)
        if stds:
            assert got[run][0] == pytest.approx(np.mean(stds), abs=1e-6)


def test_range_sums_open_start(form, series):
    points = [(0, 1.0), (10, 2.0), (20, 3.0), (20, 4.0), (30, 5.0)]
    got = range_sums(Timeline.open(series({1: points * 1})), 10_000_000, 0, {"s": F.col("value")}, open_start=True).collect()
    assert {(r["us"] // 10**6, r["seq"]): r["s"] for r in got} == {(0, 0): 1.0, (10, 1): 2.0, (20, 2): 7.0, (20, 3): 7.0, (30, 4): 5.0}


@pytest.mark.parametrize("step", [30, 7])
def test_resample_matches_pandas(form, series, step):
    runs = make_runs(7, gaps=(max(1, step // 2), step * 4))
    got = curves.resample(Timeline.open(series(runs)), step, force=True).toPandas()
    for run, points in runs.items():
        s = pd.Series([v for _, v in points], index=pd.to_datetime([t for t, _ in points], unit="s"))
        want = s.resample(f"{step}s").mean().ffill(limit=2).interpolate(method="time", limit_direction="both")
        part = got[got["run_id"] == run].sort_values("bucket_us")
        assert list(part["bucket_us"]) == [int(x.value // 1000) for x in want.index]
        np.testing.assert_allclose(part["value"], want.to_numpy(), atol=1e-9)


def test_closed_excursions(form, series):
    runs = make_runs(8)
    got = excursions.closed_excursions(Timeline.open(series(runs)), 6.0, 12.0, 20.0).collect()
    found = {(r["run_id"], r["start_us"]): (r["end_us"], r["severity"]) for r in got}
    want = {}
    for run, points in runs.items():
        cur = None
        for i, (t, v) in enumerate(points):
            out, dev = v < 6 or v > 12, max(v - 12, 6 - v, 0)
            if out and cur is None:
                cur = [t, "low"]
            elif out:
                cur[1] = "critical" if dev > 10 else "high" if dev > 5 else "medium" if dev > 2 else cur[1]
            elif cur is not None:
                if t - cur[0] >= 20:
                    want[(run, int(cur[0] * 1e6))] = (int(t * 1e6), cur[1])
                cur = None
        if cur is not None and points[-1][0] - cur[0] >= 20:
            want[(run, int(cur[0] * 1e6))] = (int(points[-1][0] * 1e6), cur[1])
    assert found == want


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9])
def test_quantile(form, series, p):
    runs = make_runs(9)
    got = by_run(Timeline.open(series(runs)).quantile("value", p, "q"), "q")
    for run, points in runs.items():
        assert got[run] == pytest.approx(np.quantile([v for _, v in points], p))


def test_one_run_holds_most_rows(spark, series):
    """A hot run is cut evenly, whatever its share; small runs keep their results."""
    from tempaudit.session import ROWS_PER_TASK

    rng = random.Random(10)
    runs = {0: [(i, rng.uniform(0, 20)) for i in range(600)], **{k: [(i, rng.uniform(0, 20)) for i in range(5)] for k in range(1, 9)}}
    plain = by_run(holds.latched_hold(Timeline.open(series(runs)), 5.0, 3.0), "hold_s", "hold_start_us", "hold_end_us")
    spark.conf.set(ROWS_PER_TASK, "50")
    try:
        tl = Timeline.open(series(runs))
        sizes = [r["count"] for r in tl.df.groupBy("run_id", "_piece").count().collect()]
        cut = by_run(holds.latched_hold(tl, 5.0, 3.0), "hold_s", "hold_start_us", "hold_end_us")
    finally:
        spark.conf.unset(ROWS_PER_TASK)
    assert max(sizes) <= 150 and cut == plain


def test_equal_instants_are_split_too(form, series):
    runs = {1: [(5, float(i)) for i in range(40)]}
    got = Timeline.open(series(runs)).scan(p=prev("value"), n=position()).rows().orderBy("seq").collect()
    assert [r["p"] for r in got] == [None] + [float(i) for i in range(39)]
    assert [r["n"] for r in got] == list(range(1, 41))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keyed_join_deals_out_hot_keys(spark, how):
    from tempaudit.operators.timeline import keyed_join

    big = spark.createDataFrame([(0 if i % 2 else i % 5, i) for i in range(200)], "k long, us long")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (9, "d")], "k long, w string")
    want = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    joined = keyed_join(big, small, "k", ["us"], how, limit=25)
    assert sorted(map(tuple, joined.collect()), key=str) == want
    assert sorted(map(tuple, keyed_join(big, small, "k", ["us"], how).collect()), key=str) == want


def test_join_run(form, series):
    runs = make_runs(11)
    tl = Timeline.open(series(runs)).scan(pos=position())
    means = tl.per_run(F.avg("value").alias("mean"))
    got = tl.join_run(means).rows().groupBy("run_id").agg(F.first("mean").alias("m"), F.count("*").alias("n")).collect()
    assert {r["run_id"]: r["n"] for r in got} == {k: len(v) for k, v in runs.items()}
    half = tl.join_run(means.filter("run_id < 2"), "left_semi").rows().select("run_id").distinct().collect()
    assert {r["run_id"] for r in half} == {0, 1}


def test_null_keys_in_both_forms(form, spark):
    rows = [(None, i * 10**6, i, float(i)) for i in range(40)] + [(1, i * 10**6, i, float(i)) for i in range(12)]
    line = Timeline.open(spark.createDataFrame(rows, "run_id long, us long, seq long, value double"))
    got = line.scan(n=position(), total=run_sum("value")).rows().collect()
    assert sorted((r.run_id or 0, r.n, r.total) for r in got) == sorted([(0, i + 1, i * (i + 1) / 2) for i in range(40)] + [(1, i + 1, i * (i + 1) / 2) for i in range(12)])
