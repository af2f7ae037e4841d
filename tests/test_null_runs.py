"""Rows without a run id are a run of their own, whether runs are whole or cut into pieces."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tempaudit.operators import curves, excursions, holds, sensors, stats, verdicts
from tempaudit.operators.timeline import Timeline


@pytest.fixture
def logs(spark):
    rng = random.Random(8)
    rows = [(run, 600_000_000 * i + rng.randint(0, 10**6), i, None if i % 13 == 5 else rng.uniform(0, 60), rng.uniform(0, 99), f"s{i % 3}")
            for run, n in ((None, 40), (1, 40), (2, 7), (3, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run_id long, us long, seq long, value double, k double, sensor string")


def values_of(rows, run, at=3):
    return [r[at] for r in rows if r[0] == run and r[at] is not None]


def test_quantiles_of_every_run(form, logs):
    rows, df = logs
    tl = Timeline.open(df)
    want = {run: median(values_of(rows, run)) for run in (None, 1, 2, 3)}
    got = {r["run_id"]: r["m"] for r in tl.quantile("value", 0.5, "m").collect()}
    assert got == pytest.approx(want)
    attached = {(r["run_id"], r["m"]) for r in tl.attach_quantile("value", 0.5, "m").rows().collect()}
    assert dict(attached) == pytest.approx(want) and len(attached) == 4
    none = tl.with_columns(value=F.when(F.col("run_id") == 1, F.col("value")))
    assert {r["run_id"]: r["m"] for r in none.quantile("value", 0.5, "m").collect()} == {None: None, 1: pytest.approx(want[1]), 2: None, 3: None}


def test_rows_meet_the_table_of_their_run(form, logs):
    _, df = logs
    table = df.sparkSession.createDataFrame([(None, "none"), (1, "one"), (9, "nine")], "run_id long, name string")
    count = lambda how: {(r["run_id"], r["name"]): r["count"] for r in Timeline.open(df).join_run(table, how).rows().groupBy("run_id", "name").count().collect()}
    assert count("inner") == {(None, "none"): 40, (1, "one"): 40}
    assert count("left") == {(None, "none"): 40, (1, "one"): 40, (2, None): 7, (3, None): 1}


def test_islands_statistics_and_sensors(form, logs):
    rows, df = logs
    tl = Timeline.open(df)
    ids = {None, 1, 2, 3}
    steps = {run: [b[1] - a[1] for a, b in zip(own, own[1:])] for run in ids for own in [[r for r in rows if r[0] == run]]}
    got = {r["run_id"]: r for r in stats.sampling_stats(tl).collect()}
    assert set(got) == ids
    for run in ids:
        assert got[run]["median_step_s"] == (pytest.approx(median(steps[run]) / 1e6) if steps[run] else None)
    both = {r["run_id"]: r["islands"] for r in holds.island_rows(holds.mask(tl, F.col("value") >= 30)).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("islands")).collect()}
    assert set(both) == ids and both[None] > 1
    instant = df.withColumn("us", F.expr("us div 3600000000"))
    middle = {(r["run_id"], r["us"]): r["combined"] for r in sensors.combine(instant, "median").collect()}
    for (run, us), found in middle.items():
        here = [r[3] for r in rows if r[0] == run and r[1] // 3_600_000_000 == us and r[3] is not None]
        want = None if not here else median(here) if len(here) >= 3 else sum(here) / len(here)
        assert found == (want if want is None else pytest.approx(want))
    assert None in {run for run, _ in middle}


@pytest.mark.parametrize("name, work", [
    ("phases", lambda tl: curves.gas_phases(tl, 10, 50)), ("cooling", lambda tl: curves.cooling_rate(tl, 40, 10)),
    ("uniformity", curves.rolling_uniformity), ("resample", lambda tl: curves.resample(tl, 300, force=True)),
    ("excursions", lambda tl: excursions.excursion_totals(tl, 10, 50, 10.0, reference_tail=True)),
    ("time", lambda tl: excursions.time_compliance(tl, 10, 50)), ("budget", lambda tl: holds.budget_hold(tl, 10, 3000)),
    ("day", lambda tl: stats.first_day_verdict(tl, 10, 50)), ("windows", lambda tl: stats.window_compliance(tl, 10, 50, 3600, 1800)),
    ("details", lambda tl: verdicts.coldchain_details(tl)), ("hard", lambda tl: verdicts.coldchain_verdict_independent(tl))])
def test_the_nameless_run_fares_as_a_named_one(form, logs, name, work):
    rows, df = logs
    tidy = lambda r: [round(x, 6) if isinstance(x, float) and math.isfinite(x) else str(x) for x in r[1:]]
    alone = sorted(map(tidy, work(Timeline.open(df.filter("run_id is null").withColumn("run_id", F.lit(7).cast("long")))).collect()), key=str)
    among = sorted(map(tidy, work(Timeline.open(df)).filter("run_id is null").collect()), key=str)
    assert alone and among == alone


def test_resampling_reads_its_samples_twice_at_most(spark, logs, tmp_path):
    logs[1].write.parquet(str(tmp_path / "s"))
    plan = curves.resample(Timeline.open(spark.read.parquet(str(tmp_path / "s"))), 300)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") <= 2 and "Join" not in plan
