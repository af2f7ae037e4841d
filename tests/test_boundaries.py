"""Boundaries: limits that are exact, ties, ends of data."""

import pytest
from pyspark.sql import functions as F

from tempaudit.operators import curves, excursions, holds, sensors, stats
from tempaudit.operators.normalize import normalize
from tempaudit.operators.timeline import Timeline


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("gap, flagged", [(59, 0), (60, 0), (60.5, 1)])
def test_gap_limit_is_strict(series, gap, flagged):
    q = one(curves.step_quality(Timeline.open(series({1: [(0, 1.0), (30, 1.0), (30 + gap, 1.0)]})), 300.0, 60.0))
    assert q["gaps"] == flagged and ("gaps" in q["issues"]) == bool(flagged)


def test_near_duplicates_against_previous_sorted_row(series):
    tl = Timeline.open(series({1: [(0, 1.0), (0.05, 2.0), (0.15, 3.0), (0.26, 4.0)]}))
    kept = [r["value"] for r in curves.drop_near_duplicates(tl).rows().orderBy("us").collect()]
    assert kept == [1.0, 4.0]  # 0.05 and 0.1 s after the row before are dropped, 0.11 is kept


def test_first_longest_hold_wins(series):
    pts = [(0, 5.0), (10, 5.0), (20, 0.0), (30, 5.0), (40, 5.0), (50, 0.0)]
    got = one(holds.latched_hold(Timeline.open(series({1: pts})), 5.0, 1.0))
    assert (got["hold_s"], got["hold_start_us"]) == (10.0, 0)


def test_hysteresis_keeps_state_between_levels(series):
    pts = [(0, 10.0), (10, 8.5), (20, 9.0), (30, 7.9), (40, 9.0), (50, 10.0)]
    got = one(holds.latched_hold(Timeline.open(series({1: pts})), 10.0, 2.0))
    assert got["hold_s"] == 20.0  # 8.5 and 9.0 keep it, 7.9 ends it, 9.0 does not start it again


def test_missing_values_keep_the_latch(series):
    got = one(holds.latched_hold(Timeline.open(series({1: [(0, 10.0), (10, None), (20, 10.0)]})), 10.0, 1.0))
    assert got["hold_s"] == 20.0


def test_trailing_excursion(series):
    tl = Timeline.open(series({1: [(0, 5.0), (10, 9.0), (20, 9.0), (30, 5.0), (40, 9.5), (90, 9.5)]}))
    whole = one(excursions.excursion_totals(tl, 2.0, 8.0, 30.0))
    tail = one(excursions.excursion_totals(tl, 2.0, 8.0, 30.0, reference_tail=True))
    assert (whole["events"], whole["total_s"], whole["max_s"], whole["above_s"], whole["alarm_events"]) == (2, 60.0, 50.0, 60.0, 1)
    assert (tail["events"], tail["total_s"], tail["max_s"], tail["above_s"]) == (2, 60.0, 10.0, 10.0)


def test_severity_follows_latest_and_skips_first(series):
    tl = Timeline.open(series({1: [(0, 30.0), (10, 14.0), (20, 11.0), (30, 9.0), (40, 5.0)]}))
    e = one(excursions.closed_excursions(tl, 2.0, 8.0))
    assert (e["severity"], e["severity_worst"], e["duration_s"]) == ("medium", "critical", 40.0)


def test_windows_are_closed_on_both_ends(series):
    df = Timeline.open(series({1: [(0, 1.0), (50, 1.0), (100, 1.0), (150, 1.0)]}))
    got = {(r["window_id"], r["us"] // 10**6) for r in stats.window_ids(df, 100, 50).collect()}
    assert got == {(0, 0), (0, 50), (0, 100), (1, 50), (1, 100), (1, 150)}


def test_day_boundary_is_utc_midnight(series):
    d = stats.daily_compliance(series({1: [(86_399, 5.0), (86_400, 9.0)]}), 2.0, 8.0).orderBy("day").collect()
    assert [(str(r["day"]), r["compliance_pct"]) for r in d] == [("1970-01-01", 100.0), ("1970-01-02", 0.0)]


def test_stability_counts_change_in_no_time_as_zero(series):
    s = one(stats.stability(Timeline.open(series({1: [(0, 1.0), (0, 9.0), (3600, 3.0)]}))))
    assert (s["max_rate_per_h"], s["mean_rate_per_h"], s["violations"]) == (6.0, 3.0, 1)


def test_resample_only_in_its_band(series):
    step = lambda s: [(i * s, 1.0) for i in range(6)]
    df = series({1: step(30), 2: step(40), 3: step(70)})
    assert {r["run_id"] for r in curves.resample(Timeline.open(df), 30).select("run_id").distinct().collect()} == {2}


def test_combine_modes(spark):
    rows = [(1, 0, "a", 1.0), (1, 0, "b", 5.0), (1, 0, "c", None), (1, 1, "a", 4.0), (1, 1, "b", 6.0), (1, 1, "c", 9.0)]
    df = spark.createDataFrame(rows, "run_id long, us long, sensor string, value double")
    get = lambda *a, **k: [r["combined"] for r in sensors.combine(df, *a, **k).orderBy("us").collect()]
    assert get("min") == [1.0, 4.0] and get("mean") == [3.0, pytest.approx(19 / 3)] and get("median") == [3.0, 6.0]
    assert get("majority", threshold=5.0) == [False, True]  # 1 of 2 is not a majority
    assert get("majority", threshold=5.0, require_at_least=1) == [True, True]
    bad = sensors.too_few_valid(sensors.combine(df, "min"), 3).collect()[0]
    assert bad["bad_samples"] == 1 and bad["error"]


def test_normalize_gate(spark):
    rows = [(1, t * 30_000_000, t, "temp_F", 212.0) for t in range(5)] + [(2, t * 400_000_000, t, "shelf", 20.0) for t in range(5)]
    df = spark.createDataFrame(rows, "run_id long, us long, seq long, sensor string, value double")
    clean, report = normalize(df)
    got = {r["run_id"]: r for r in report.collect()}
    assert got[1]["status"] == "OK" and "fahrenheit_converted" in got[1]["trace"]
    assert got[2]["issues"] == ["gaps", "period_too_long"] and got[2]["converted_rows"] == 0
    assert {(r["run_id"], r["value"]) for r in clean.collect()} == {(1, 100.0)}


def test_concrete_is_exempt_from_one_gap_limit(spark):
    rows = [(1, t * 900_000_000, t, "temp", 20.0) for t in range(5)]
    df = spark.createDataFrame(rows, "run_id long, us long, seq long, sensor string, value double")
    report = normalize(df, 3600.0, 300.0, None, industry=F.lit("concrete"))[1].collect()[0]
    assert report["gaps"] == 4 and report["status"] == "OK"
