"""Verdicts on series with known answers, under the rules' own limits."""

import pytest
from pyspark.sql import functions as F

from tempaudit.operators import specs, verdicts
from tempaudit.operators.timeline import Timeline
from tempaudit.operators.verdicts import F135

SPEC = {"target_temp": "180.0D", "uncertainty": "2.0D", "hold_time_s": "600L", "hysteresis": "2.0D", "continuous": "true", "max_dips_s": "0.0D",
        "max_ramp": "cast(null as double)", "max_time_to_threshold_s": "cast(null as long)"}


def cure(hold_s, peak=183.0):
    """Up in 5 minutes, hold, down; a sample every 30 s."""
    up = [(30.0 * i, 25.0 + (peak - 25.0) * i / 10) for i in range(10)]
    flat = [(300.0 + 30 * i, peak) for i in range(int(hold_s / 30) + 1)]
    down = [(flat[-1][0] + 30 * i, peak - 15.0 * i) for i in range(1, 11)]
    return up + flat + down


def status(df, *cols):
    return {r["run_id"]: (r["status"], set(r["codes"]), *[r[c] for c in cols]) for r in df.collect()}


def test_hold(form, series):
    dip = [(t, 170.0 if 500 <= t <= 560 else v) for t, v in cure(900)]
    runs = {1: cure(600), 2: cure(570), 3: cure(900, 181.0), 4: cure(600)[:12], 5: dip}
    got = status(verdicts.hold_verdict(series(runs, SPEC)), "hold_s")
    assert got[1] == ("PASS", {"hold_met"}, 600.0)
    assert got[2] == ("FAIL", {"hold_short"}, 570.0)
    assert got[3] == ("FAIL", {"never_reached"}, 0.0)
    assert got[4] == ("INDETERMINATE", {"too_few_points"}, 0.0)
    assert got[5] == ("PASS", {"hold_met"}, 630.0)  # the dip leaves a second, long enough stretch
    assert status(verdicts.powder_verdict(series(runs, SPEC)))[4][0] == "FAIL"


def test_hold_cumulative_and_preconditions(series):
    dip = [(t, 170.0 if 500 <= t <= 560 else v) for t, v in cure(900)]
    tail = {**SPEC, "continuous": "false", "max_dips_s": "700.0D"}
    got = status(verdicts.hold_verdict(series({5: dip}, tail)), "hold_s")
    assert got[5][0] == "PASS" and got[5][2] == 180.0 + 630.0
    fast = status(verdicts.hold_verdict(series({1: cure(600)}, {**SPEC, "max_ramp": "30.0D", "max_time_to_threshold_s": "200L"})))
    assert fast[1] == ("FAIL", {"ramp_too_high", "too_late", "hold_met"})


def test_cooling(series):
    line = lambda hours, start=60.0, end=4.0: [(i * 300.0, start + (end - start) * i / (hours * 12)) for i in range(int(hours * 12) + 1)]
    warm = line(2.5)
    runs = {1: warm, 2: line(8), 3: line(2, 50.0), 4: warm[:20] + [(warm[19][0] + 300, warm[19][1] + 5)], 5: line(2, F135 - 0.05)}
    got = status(verdicts.cooling_verdict(Timeline.open(series(runs))))
    assert got[1] == ("PASS", set())
    assert got[2] == ("FAIL", {"phase1_slow", "phase2_slow"})
    assert got[3] == ("FAIL", {"start_too_cold"})
    assert got[4][0] == "FAIL" and "heating" in got[4][1] and "phase2_missed" in got[4][1]
    assert got[5] == ("PASS", set())
    strict = {r["run_id"]: r["pass"] for r in verdicts.cooling_verdict_independent(Timeline.open(series(runs))).collect()}
    assert strict[1] and not strict[5]  # no start tolerance on the independent side


def test_autoclave(form, series):
    cycle = lambda hold, temp: [(0.0, 20.0), (60.0, 100.0)] + [(120.0 + 30 * i, temp) for i in range(int(hold / 30) + 1)] + [(150.0 + hold, 90.0)]
    runs = {1: cycle(1200, 121.5), 2: cycle(600, 121.5), 3: cycle(1200, 124.0), 4: cycle(1200, 121.5), 5: cycle(840, 123.0)}
    df = series(runs).withColumn("k", F.when((F.col("run_id") == 4) & (F.col("us") > 300_000_000) & (F.col("us") < 400_000_000), 10.0).otherwise(16.0))
    got = status(verdicts.autoclave_verdict(Timeline.open(df)), "pressure_unit")
    assert got[1] == ("PASS", set(), "psi")
    assert got[2][0] == "FAIL" and got[2][1] == {"f0_low", "hold_short"}
    assert got[3][1] == {"never_in_range", "too_hot"}
    assert "pressure_dropped" in got[4][1] and got[4][0] == "FAIL"
    assert got[5][1] <= {"hold_compensated", "hold_short"}
    no_pressure = verdicts.autoclave_verdict(Timeline.open(df.drop("k")), pressure=None, require_pressure=True)
    assert {r["status"] for r in no_pressure.collect()} == {"INDETERMINATE"}


def test_sterile(form, series):
    cycle = [(600.0 * i, 30.0 + 4 * i) for i in range(6)] + [(3600.0 + 600 * i, 55.0) for i in range(40)]
    df = series({1: cycle, 2: cycle, 3: cycle[:12]}).withColumns({
        "k": F.when((F.col("run_id") == 2) & (F.col("us") > 9_000_000_000), 90.0).otherwise(60.0),
        "gas": F.when(F.col("us") < 26_000_000_000, 500.0).otherwise(20.0)})
    got = status(verdicts.sterile_verdict(Timeline.open(df)), "phase_s")
    assert got[1][0] == "PASS" and got[1][2] == 23_400.0
    assert got[2][0] == "FAIL" and got[2][1] == {"humidity_out"}
    assert got[3][0] == "FAIL" and "time_short" in got[3][1]
    bare = Timeline.open(df.withColumn("k", F.lit(None).cast("double")))
    assert {r[0] for r in status(verdicts.sterile_verdict(bare, require_humidity=True), "phase_s").values()} == {"INDETERMINATE"}
    cold = df.withColumns({"value": F.lit(20.0), "k": F.when(F.col("seq") % 2 == 0, 60.0).otherwise(90.0)})  # no phase, humidity right half of the time
    assert "humidity_out" in status(verdicts.sterile_verdict(Timeline.open(cold)), "phase_s")[1][1]


def test_sterile_reads_its_samples_at_most_three_times(spark, tmp_path, series):
    series({1: [(600.0 * i, 55.0) for i in range(9)]}, {"k": "60.0", "gas": "500.0"}).write.parquet(str(tmp_path / "s"))
    verdict = verdicts.sterile_verdict(Timeline.open(spark.read.parquet(str(tmp_path / "s"))))
    assert str(verdict._jdf.queryExecution().executedPlan()).count("FileScan") <= 3


def six_kinds(series):
    waves = {r: [(900.0 * i, 20.0 + r + (i * (r + 3)) % 41 * (i % 7 > 2)) for i in range(97)] for r in range(12)}
    return series(waves | {12: [(0.0, 1.0)]}, {"k": "50.0 + seq % 40", "gas": "500.0 + seq % 11"})


def test_all_engines_together_judge_as_each_alone(form, series):
    day = six_kinds(series)
    names = list(verdicts.ENGINES)
    specs_ = day.select("run_id").distinct().withColumn("industry", F.element_at(F.array(*map(F.lit, names)), (F.col("run_id") % 6 + 1).cast("int")))
    got = {r["run_id"]: r for r in verdicts.judge_runs(day, specs_.filter("run_id <> 12")).collect()}
    assert set(got) == set(range(12))
    for i, name in enumerate(names):
        alone = verdicts.judge(Timeline.open(day.filter(F.col("run_id") % 6 == i)), verdicts.ENGINES[name]())
        for r in alone.filter("run_id <> 12").collect():
            both = got[r["run_id"]]
            assert both["industry"] == name
            assert (both["status"], both["pass"], both["codes"], both["reasons"]) == (r["status"], r["pass"], r["codes"], r["reasons"]), name
    unknown = verdicts.judge_runs(day, specs_.withColumn("industry", F.lit("ceramics"))).first()
    assert unknown["status"] == "ERROR" and unknown["codes"] == ["unknown_industry"]


def test_runs_without_an_id_are_judged_in_both_forms(form, series):
    day = six_kinds(series).withColumn("run_id", F.when(F.col("run_id") != 3, F.col("run_id"))).withColumn("seq", F.monotonically_increasing_id())
    for name, engine in verdicts.ENGINES.items():
        assert {r["run_id"] for r in verdicts.judge(Timeline.open(day), engine()).collect()} == {None, *range(13)} - {3}, name


def test_powder_recipe_equals_the_band_form(form, series):
    day = six_kinds(series).withColumns({
        "target_temp": F.lit(30.0), "uncertainty": F.lit(1.0), "hold_time_s": F.lit(1800.0), "hysteresis": F.lit(3.0),
        "continuous": F.col("run_id") % 2 == 0, "max_dips_s": F.lit(2000.0), "max_ramp": F.lit(1.5), "max_time_to_threshold_s": F.lit(5000.0)})
    limits = day.columns[6:]
    recipe = verdicts.powder_engine(300.0, given=limits)
    columns = ["run_id", "status", "codes", "hold_s", "max_ramp", "time_to_threshold_s", "samples"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows(verdicts.judge(Timeline.open(day), recipe)) == rows(verdicts.powder_verdict(day, 300.0))


def test_queries_of_several_features_read_their_samples_once(spark):
    from tempaudit.plans import load_all

    queries = load_all()[0]
    for name, most in (("v12_shadow_comparison", 1), ("j03_metric_differences", 1), ("v06_concrete_verdict", 1), ("v11_concrete_independent", 1),
                       ("b18_industry_dispatch", 2), ("u03_engine_table", 2), ("g11_window_compliance", 1)):
        df = queries[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("] parquet") <= most, (name, plan)


def test_concrete_and_coldchain(form, series):
    day = lambda v, n=97: [(900.0 * i, v(i)) for i in range(n)]
    runs = {1: day(lambda i: 21.0), 2: day(lambda i: 21.0 if i > 10 else 12.0), 3: day(lambda i: 21.0, 6), 4: day(lambda i: 21.0, 4)}
    got = status(verdicts.concrete_verdict(Timeline.open(series(runs)), humidity=None))
    assert got[1][0] == "PASS" and got[2][0] == "FAIL" and got[3][0] == "INDETERMINATE" and got[4][:2] == ("ERROR", {"too_short"})
    assert {"first_day_out", "critical_out", "below_range", "unstable"} <= got[2][1]
    cold = {1: day(lambda i: 5.0), 2: day(lambda i: 5.0 if i % 5 else 9.0), 3: day(lambda i: 5.0, 9), 4: day(lambda i: 5.0 if i != 50 else 30.0)}
    got = status(verdicts.coldchain_verdict(Timeline.open(series(cold))), "hold_s")
    assert got[1] == ("PASS", {"in_range"}, 86_400.0)
    assert got[2][0] == "FAIL" and got[3][0] == "INDETERMINATE" and got[4][0] == "PASS"
    hard = {r["run_id"]: r["pass"] for r in verdicts.coldchain_verdict_independent(Timeline.open(series(cold))).collect()}
    assert hard == {1: True, 2: True, 3: True, 4: False}


def test_adaptation_defaults(spark):
    rows = [("powder", {"target_temp": "190", "hold_duration_minutes": "12"}, 190.0, 720, "PMT"), ("autoclave", {}, 121.0, 900, "OVEN_AIR"),
            ("coldchain", {"max_temp": "7"}, 7.0, 3600, "OVEN_AIR"), ("haccp", {}, 135.0, 7200, "OVEN_AIR"), ("concrete", {"time_window_hours": "48"}, 30.0, 172800, "OVEN_AIR"),
            ("sterile", {}, 55.0, 43200, "OVEN_AIR"), ("other", {"hold_time_s": "60"}, 100.0, 60, "OVEN_AIR")]
    df = spark.createDataFrame(rows, "i string, p map<string,string>, t double, h long, m string")
    for r in df.select(specs.adapt(F.col("p"), F.col("i")).alias("s"), "t", "h", "m").collect():
        assert (r["s"]["target_temp_C"], r["s"]["hold_time_s"], r["s"]["method"]) == (r["t"], r["h"], r["m"])


@pytest.mark.parametrize("name, want", [("Powder-Coating", "powder"), (" cold-chain ", "coldchain"), ("ETO", "sterile"), ("haccp", "haccp")])
def test_industry_alias(spark, name, want):
    assert spark.createDataFrame([(name,)], "x string").select(specs.canonical_industry(F.col("x"))).first()[0] == want
