"""Statistics and sensor-combination queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.operators import curves, excursions, sensors, stats
from tempaudit.operators.timeline import Timeline
from tempaudit.plans.common import HI, HYST, LO, S, THR, WIN, expr, query, r, samples, sql_latch, timeline
from tempaudit.plans.ordered import OUT, SQL_CLOSED, SQL_PHASES, sql_islands

DAY = 86_400_000_000


@query("g01_run_summary", f"""WITH {S} SELECT run_id, arg_min(value, us) AS start_value, arg_max(value, us) AS end_value,
  min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value,
  round((max(us) - min(us)) / 1e6, 6) AS duration_s, count(*) AS samples FROM s GROUP BY run_id""")
def g01(spark, sf):
    return stats.run_summary(timeline(spark, sf)).select(
        "run_id", "start_value", "end_value", "min_value", "max_value", r("mean_value"), r("duration_s"), "samples")


@query("g02_sampling_stats", f"""WITH {S}, d AS (SELECT *, (us - lag(us) OVER {WIN}) / 1e6 AS dt FROM s)
SELECT run_id, count(*) AS samples, round(avg(dt), 5) AS mean_step_s, round(quantile_cont(dt, 0.5), 7) AS median_step_s,
  round(min(dt), 6) AS min_step_s, round(max(dt), 6) AS max_step_s, count(*) FILTER (WHERE dt = 0) AS duplicates,
  count(*) FILTER (WHERE value IS NULL) AS missing, round((max(us) - min(us)) / 1e6, 6) AS duration_s FROM d GROUP BY run_id""")
def g02(spark, sf):
    return stats.sampling_stats(timeline(spark, sf)).select(
        "run_id", "samples", r("mean_step_s", 5), r("median_step_s", 7), r("min_step_s"), r("max_step_s"), "duplicates",
        "missing", r("duration_s"))


@query("g03_in_range_pct", f"""WITH {S} SELECT run_id,
  round(avg(CASE WHEN value BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END) * 100, 6) AS in_range_pct FROM s GROUP BY run_id""")
def g03(spark, sf):
    return stats.in_range_pct(timeline(spark, sf), expr(LO), expr(HI)).select("run_id", r("in_range_pct"))


SQL_DAILY = f"""daily AS (SELECT run_id, us // {DAY} AS d, count(*) AS samples,
  count(*) FILTER (WHERE value BETWEEN {LO} AND {HI}) AS samples_in_range,
  round_even(avg(CASE WHEN value BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END), 3) * 100 AS compliance_pct,
  min(value) AS min_value, max(value) AS max_value, avg(value) AS mean_value, stddev_samp(value) AS std_value
  FROM s GROUP BY ALL)"""


@query("g04_daily_compliance", f"""WITH {S}, {SQL_DAILY}
SELECT run_id, strftime(make_timestamp(d * {DAY}), '%Y-%m-%d') AS day, samples, samples_in_range,
  round(compliance_pct, 6) AS compliance_pct, min_value, max_value, round(mean_value, 6) AS mean_value,
  round(std_value, 6) AS std_value FROM daily""")
def g04(spark, sf):
    d = stats.daily_compliance(samples(spark, sf), expr(LO), expr(HI))
    return d.select("run_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "samples", "samples_in_range",
                    r("compliance_pct"), "min_value", "max_value", r("mean_value"), r("std_value"))


@query("g05_daily_rollup", f"""WITH {S}, {SQL_DAILY}
SELECT run_id, count(*) AS total_days, count(*) FILTER (WHERE compliance_pct >= 60) AS compliant_days,
  count(*) FILTER (WHERE NOT compliance_pct >= 60) AS non_compliant_days, round(avg(compliance_pct), 6) AS mean_day_pct,
  round(min(compliance_pct), 6) AS worst_day_pct, round(max(compliance_pct), 6) AS best_day_pct,
  coalesce(string_agg(CASE WHEN NOT compliance_pct >= 60 THEN strftime(make_timestamp(d * {DAY}), '%Y-%m-%d') END, ','
    ORDER BY d), '') AS non_compliant_dates, bool_and(compliance_pct >= 60) AS all_days_met FROM daily GROUP BY run_id""")
def g05(spark, sf):
    d = stats.daily_compliance(samples(spark, sf), expr(LO), expr(HI))
    return stats.daily_rollup(d, 60.0).select(
        "run_id", "total_days", "compliant_days", "non_compliant_days", r("mean_day_pct"), r("worst_day_pct"),
        r("best_day_pct"), F.concat_ws(",", "non_compliant_dates").alias("non_compliant_dates"), "all_days_met")


@query("g06_time_compliance", f"""WITH {S}, {SQL_CLOSED},
sp AS (SELECT run_id, count(*) AS excursions, sum(duration_s) AS excursion_s FROM closed GROUP BY run_id),
w AS (SELECT run_id, (max(us) - min(us)) / 1e6 AS duration_s FROM s GROUP BY run_id)
SELECT run_id, coalesce(excursions, 0) AS excursions, round(coalesce(excursion_s, 0), 6) AS excursion_s,
  round(CASE WHEN w.duration_s > 0 THEN (w.duration_s - coalesce(excursion_s, 0)) / w.duration_s * 100 ELSE 0 END, 6)
    AS compliance_pct FROM w LEFT JOIN sp USING (run_id)""")
def g06(spark, sf):
    return excursions.time_compliance(timeline(spark, sf), expr(LO), expr(HI)).select(
        "run_id", "excursions", r("excursion_s"), r("compliance_pct"))


@query("g07_mean_kinetic_temperature", f"""WITH {S} SELECT run_id,
  round(CASE WHEN count(value) >= 2 THEN 1 / avg(1 / (value + 273.15)) - 273.15 END, 6) AS mkt FROM s GROUP BY run_id""")
def g07(spark, sf):
    return stats.mean_kinetic(timeline(spark, sf)).select("run_id", r("mkt"))


# lethality of event values spans many orders of magnitude; z = 100 keeps the sums comparable
def sql_f0(ref: float, z: float = 100.0, name: str = "f") -> str:
    return f"""{name} AS (SELECT run_id, coalesce(sum((l + pl) / 2 * dt / 60), 0) AS f0 FROM (SELECT run_id,
      pow(10.0, (value - {ref}) / {z}) AS l, lag(pow(10.0, (value - {ref}) / {z})) OVER {WIN} AS pl,
      (us - lag(us) OVER {WIN}) / 1e6 AS dt FROM s) GROUP BY run_id)"""


@query("g08_lethality", f"""WITH {S}, {sql_f0(121.1, name='a')}, {sql_f0(121.0, name='b')}
SELECT run_id, round(a.f0, 3) AS f0_engine, round(b.f0, 3) AS f0_independent FROM a JOIN b USING (run_id)""")
def g08(spark, sf):
    tl = timeline(spark, sf)
    a = stats.lethality(tl, 121.1, 100.0).withColumnRenamed("f0", "a")
    b = stats.lethality(tl, 121.0, 100.0).withColumnRenamed("f0", "b")
    return a.join(b, "run_id").select("run_id", r("a", 3, "f0_engine"), r("b", 3, "f0_independent"))


@query("g09_supplied_lethality", f"""WITH {S}, {sql_f0(121.1)},
m AS (SELECT run_id, max(CASE WHEN run_id % 2 = 0 THEN k END) AS given FROM s GROUP BY run_id)
SELECT run_id, round(coalesce(given, f0), 3) AS f0 FROM f JOIN m USING (run_id)""")
def g09(spark, sf):
    tl = timeline(spark, sf, "k").with_columns(fo_value=F.when(F.col("run_id") % 2 == 0, F.col("k")))
    return stats.lethality(tl, 121.1, 100.0, supplied="fo_value").select("run_id", r("f0", 3))


SQL_MATURITY = f"""mt AS (SELECT run_id, coalesce(sum(CASE WHEN (value + nv) / 2 > -10
  THEN ((value + nv) / 2 + 10) * (nu - us) / 1e6 / 3600 END), 0) AS m FROM
  (SELECT *, lead(value) OVER {WIN} AS nv, lead(us) OVER {WIN} AS nu FROM s) GROUP BY run_id),
mat AS (SELECT run_id, m AS maturity_h, CASE WHEN m > 0 THEN least(m / (m + 13.65) * 100, 100) ELSE 0 END AS strength_pct FROM mt)"""


@query("g10_maturity_strength", f"""WITH {S}, {SQL_MATURITY}
SELECT run_id, round(maturity_h, 4) AS maturity_h, round(strength_pct, 6) AS strength_pct FROM mat""")
def g10(spark, sf):
    return stats.maturity(timeline(spark, sf)).select("run_id", r("maturity_h", 4), r("strength_pct"))


W_US, ST_US = 5 * DAY, 5 * DAY // 2
SQL_WINDOWS = f"""b AS (SELECT run_id, min(us) AS t0, max(us) AS t1 FROM s GROUP BY run_id),
wins AS (SELECT run_id, t0, unnest(generate_series(0, (t1 - t0 - {W_US}) // {ST_US})) AS window_id FROM b WHERE t1 - t0 >= {W_US}),
ws AS (SELECT w.run_id, w.window_id, s.us, s.seq, s.value FROM wins w JOIN s ON s.run_id = w.run_id
  AND s.us >= t0 + window_id * {ST_US} AND s.us <= t0 + window_id * {ST_US} + {W_US}),
wd AS (SELECT *, coalesce((lead(us) OVER (PARTITION BY run_id, window_id ORDER BY us, seq) - us) / 1e6, 0) AS dt FROM ws),
wa AS (SELECT run_id, window_id, count(*) AS samples, sum(dt) AS total_s,
  CASE WHEN sum(dt) > 0 THEN coalesce(sum(dt) FILTER (WHERE value BETWEEN {LO} AND {HI}), 0) / sum(dt) * 100 ELSE 0 END AS pct
  FROM wd GROUP BY run_id, window_id)"""


@query("j05_window_samples", f"""WITH {S}, {SQL_WINDOWS} SELECT run_id, window_id, seq FROM ws""")
def j05(spark, sf):
    return stats.window_ids(timeline(spark, sf), 5 * 86_400, 5 * 43_200).select("run_id", "window_id", "seq")


@query("g11_window_compliance", f"""WITH {S}, {SQL_WINDOWS}
SELECT run_id, window_id, samples, round(total_s, 6) AS total_s, round(pct, 6) AS compliance_pct,
  pct >= 60 AND samples >= 2 AS compliant FROM wa""")
def g11(spark, sf):
    w = stats.window_compliance(timeline(spark, sf), expr(LO), expr(HI), 5 * 86_400, 5 * 43_200, 60.0)
    return w.select("run_id", "window_id", "samples", r("total_s"), r("compliance_pct"), "compliant")


@query("g24_window_rollup", f"""WITH {S}, {SQL_WINDOWS}
SELECT run_id, count(*) AS total_windows, count(*) FILTER (WHERE pct >= 60 AND samples >= 2) AS compliant_windows,
  count(*) FILTER (WHERE NOT (pct >= 60 AND samples >= 2)) AS failed_windows, round(avg(pct), 6) AS mean_pct,
  count(*) FILTER (WHERE pct >= 60 AND samples >= 2) >= count(*) * 0.8 AS overall_pass FROM wa GROUP BY run_id""")
def g24(spark, sf):
    w = stats.window_compliance(timeline(spark, sf), expr(LO), expr(HI), 5 * 86_400, 5 * 43_200, 60.0)
    return stats.window_rollup(w).select("run_id", "total_windows", "compliant_windows", "failed_windows", r("mean_pct"), "overall_pass")


SQL_STAB = f"""rt AS (SELECT run_id, value, CASE WHEN h > 0 THEN c / h WHEN h = 0 AND c > 0 THEN 0.0 END AS rate FROM
  (SELECT run_id, value, (us - lag(us) OVER {WIN}) / 1e6 / 3600 AS h, abs(value - lag(value) OVER {WIN}) AS c FROM s)),
stab AS (SELECT run_id, coalesce(max(rate), 0) AS max_rate, coalesce(avg(rate), 0) AS mean_rate,
  count(*) FILTER (WHERE rate > 5) AS violations, max(value) - min(value) AS value_range,
  coalesce(stddev_samp(value), 0) AS std_value FROM rt GROUP BY run_id)"""


@query("g12_stability", f"""WITH {S}, {SQL_STAB}
SELECT run_id, round(max_rate, 4) AS max_rate_per_h, round(mean_rate, 4) AS mean_rate_per_h, violations,
  round(value_range, 6) AS value_range, round(std_value, 6) AS std_value FROM stab""")
def g12(spark, sf):
    return stats.stability(timeline(spark, sf)).select(
        "run_id", r("max_rate_per_h", 4), r("mean_rate_per_h", 4), "violations", r("value_range"), r("std_value"))


@query("g13_band_violations", f"""WITH {S} SELECT run_id,
  round(count(*) FILTER (WHERE {OUT}) / count(*) * 100, 6) AS violation_pct FROM s GROUP BY run_id""")
def g13(spark, sf):
    return stats.band_violations(samples(spark, sf), expr(LO), expr(HI)).select("run_id", r("violation_pct"))


@query("g14_humidity_control", f"""WITH {S} SELECT run_id, min(k) AS min_rh, max(k) AS max_rh, round(avg(k), 6) AS mean_rh,
  min(k) >= 1 AND max(k) <= 98 AS controlled FROM s GROUP BY run_id""")
def g14(spark, sf):
    return stats.humidity_control(samples(spark, sf), 1.0, 98.0).select("run_id", "min_rh", "max_rh", r("mean_rh"), "controlled")


@query("g15_sensor_spread", f"""WITH {S}, p AS (SELECT run_id, sensor, max(value) - min(value) AS x FROM s GROUP BY ALL)
SELECT run_id, round(max(x), 6) AS max_sensor_range FROM p GROUP BY run_id""")
def g15(spark, sf):
    return stats.sensor_spread(samples(spark, sf)).select("run_id", r("max_sensor_range"))


@query("g16_target_deviation", f"""WITH {S} SELECT run_id, round(avg(abs(value - {THR})), 6) AS mean_dev,
  round(max(abs(value - {THR})), 6) AS max_dev, round(stddev_pop(abs(value - {THR})), 6) AS std_dev FROM s GROUP BY run_id""")
def g16(spark, sf):
    return stats.target_deviation(samples(spark, sf), expr(THR)).select("run_id", r("mean_dev"), r("max_dev"), r("std_dev"))


@query("g17_simple_range_check", f"""WITH {S} SELECT run_id,
  round(count(*) FILTER (WHERE value BETWEEN 0.05 AND {HI} * 4) / count(*) * 100, 6) AS in_range_pct,
  CASE WHEN bool_and(value BETWEEN 0.05 AND {HI} * 4) THEN 'PASS' ELSE 'FAIL' END AS status FROM s GROUP BY run_id""")
def g17(spark, sf):
    return stats.simple_range_check(samples(spark, sf), 0.05, expr(HI) * 4).select("run_id", r("in_range_pct"), "status")


@query("g18_time_in_range", f"""WITH {S}, d AS (SELECT *, coalesce((us - lag(us) OVER {WIN}) / 1e6, 0) AS dt FROM s)
SELECT run_id, round(coalesce(sum(dt) FILTER (WHERE value BETWEEN {LO} AND {HI}), 0), 6) AS in_range_s FROM d GROUP BY run_id""")
def g18(spark, sf):
    return excursions.time_in_range(timeline(spark, sf), expr(LO), expr(HI)).select("run_id", r("in_range_s"))


@query("g19_low_pressure_share", f"""WITH {S} SELECT run_id, round(avg(CASE WHEN k < 5 THEN 1.0 ELSE 0.0 END) * 100, 6) AS low_pct,
  avg(CASE WHEN k < 5 THEN 1.0 ELSE 0.0 END) * 100 > 5 AS too_low FROM s GROUP BY run_id""")
def g19(spark, sf):
    return stats.low_share(samples(spark, sf), 5.0).select("run_id", r("low_pct"), "too_low")


SQL_PHASE_CHECKS = f"""{SQL_PHASES},
whole AS (SELECT run_id, max(value) AS peak, arg_max(value, us) AS final, avg(CASE WHEN k BETWEEN 45 AND 85 THEN 1.0 ELSE 0.0 END) AS hum_all FROM s GROUP BY run_id),
ins AS (SELECT s.* FROM s JOIN ph USING (run_id) WHERE us >= phase_start_us AND us < phase_end_us),
med AS (SELECT run_id, quantile_cont(value, 0.5) AS md FROM ins GROUP BY run_id),
pc AS (SELECT run_id, bool_and(k BETWEEN 45 AND 85) AS hum_ok,
  (1 - avg(CASE WHEN k BETWEEN 45 AND 85 THEN 1.0 ELSE 0.0 END)) * 100 AS hum_bad,
  avg(CASE WHEN value >= md * 0.5 THEN 1.0 ELSE 0.0 END) AS kept FROM ins JOIN med USING (run_id) GROUP BY run_id),
pchk AS (SELECT run_id, CASE WHEN phase_start_us IS NULL THEN hum_all >= 0.8 ELSE coalesce(hum_ok, true) END AS humidity_ok, coalesce(hum_bad, 0) AS humidity_bad_pct,
  coalesce(kept >= 0.9, true) AS gas_kept, peak > 100 AND final > peak * 0.1 AS evacuation_incomplete
  FROM whole JOIN ph USING (run_id) LEFT JOIN pc USING (run_id))"""


@query("g20_phase_checks", f"""WITH {S}, {SQL_PHASE_CHECKS}
SELECT run_id, humidity_ok, round(humidity_bad_pct, 6) AS humidity_bad_pct, gas_kept, evacuation_incomplete FROM pchk""")
def g20(spark, sf):
    tl = timeline(spark, sf, "k")
    return stats.phase_checks(curves.with_gas_phase(tl)).select(
        "run_id", "humidity_ok", r("humidity_bad_pct"), "gas_kept", "evacuation_incomplete")


# readings: the daily mean of each sensor (event type); the day is the instant
R = f"""{S}, rd AS (SELECT run_id, us // {DAY} * {DAY} AS us, sensor, round(avg(value), 6) AS value, round(avg(k), 6) AS k FROM s GROUP BY ALL)"""


def readings(spark, sf):
    return samples(spark, sf).groupBy(
        "run_id", F.expr(f"us div {DAY}L * {DAY}L").alias("us"), "sensor").agg(
        F.round(F.avg("value"), 6).alias("value"), F.round(F.avg("k"), 6).alias("k"))


@query("g21_first_day_verdict", f"""WITH {R},
t AS (SELECT run_id, min(us) AS t0 FROM rd GROUP BY run_id),
i AS (SELECT run_id, us, bool_and(value BETWEEN 5 AND 120 AND k >= 10) AS ok FROM rd JOIN t USING (run_id)
  WHERE us <= t0 + 20 * {DAY} GROUP BY run_id, us)
SELECT run_id, count(*) AS samples_24h, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100, 6) AS ok_pct,
  CASE WHEN count(*) < 18 THEN 'INDETERMINATE' WHEN avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) * 100 >= 40 THEN 'PASS' ELSE 'FAIL' END
    AS status FROM i GROUP BY run_id""")
def g21(spark, sf):
    # the stand-in is sparse: twenty days stand for the first day, 10 on the k scale for humidity 95
    scaled = readings(spark, sf).withColumn("rh", F.when(F.col("k") >= 10, 95.0).otherwise(0.0))
    return stats.first_day_verdict(Timeline.open(scaled, order=["us", "sensor"]), 5.0, 120.0, humidity="rh", min_samples=18, required=40.0, hours=480.0).select(
        "run_id", "samples_24h", r("ok_pct"), "status")


@query("g22_critical_period", f"""WITH {S}, n AS (SELECT *, row_number() OVER {WIN} AS pos, lag(us) OVER {WIN} AS pu FROM s),
f AS (SELECT run_id, max((us - pu) / 1e6) FILTER (WHERE pos = 2) AS dt FROM n GROUP BY run_id)
SELECT run_id, count(*) AS critical_samples,
  round(avg(CASE WHEN value BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END) * 100, 6) AS critical_pct,
  round(avg(CASE WHEN k >= 95 THEN 1.0 ELSE 0.0 END) * 100, 6) AS critical_rh_pct,
  count(*) > 1 AND avg(CASE WHEN value BETWEEN {LO} AND {HI} THEN 1.0 ELSE 0.0 END) * 100 >= 98 AS critical_ok
FROM n JOIN f USING (run_id) WHERE pos <= floor(864000.0 / dt) GROUP BY run_id""")
def g22(spark, sf):
    return stats.critical_period(timeline(spark, sf, "k"), expr(LO), expr(HI), period_s=864_000.0).select(
        "run_id", "critical_samples", r("critical_pct"), r("critical_rh_pct"), "critical_ok")


SQL_TOTALS = f"""{sql_islands(OUT, extra=f", min(value) AS mn, max(value) AS mx, max({LO}) AS lo, max({HI}) AS hi")},
ex AS (SELECT run_id, count(*) AS events, count(*) FILTER (WHERE duration_s >= 43200) AS alarm_events, sum(duration_s) AS total_s,
  max(duration_s) AS max_s, coalesce(sum(duration_s) FILTER (WHERE duration_s >= 43200), 0) AS alarm_s,
  coalesce(sum(duration_s) FILTER (WHERE mn < lo), 0) AS below_s, coalesce(sum(duration_s) FILTER (WHERE mx > hi), 0) AS above_s,
  min(mn) FILTER (WHERE mn < lo) AS lowest, max(mx) FILTER (WHERE mx > hi) AS highest FROM isl WHERE state GROUP BY run_id),
bs AS (SELECT run_id, count(*) AS samples, count(*) FILTER (WHERE {OUT}) AS samples_outside FROM s GROUP BY run_id)"""


@query("g23_excursion_totals", f"""WITH {S}, {SQL_TOTALS}
SELECT run_id, samples, samples_outside, coalesce(events, 0) AS events, coalesce(alarm_events, 0) AS alarm_events,
  round(coalesce(total_s, 0), 6) AS total_s, round(coalesce(max_s, 0), 6) AS max_s, round(coalesce(alarm_s, 0), 6) AS alarm_s,
  round(coalesce(below_s, 0), 6) AS below_s, round(coalesce(above_s, 0), 6) AS above_s, lowest, highest,
  round((samples - samples_outside) / samples * 100, 6) AS compliance_pct FROM bs LEFT JOIN ex USING (run_id)""")
def g23(spark, sf):
    return excursions.excursion_totals(timeline(spark, sf), expr(LO), expr(HI), 43_200.0).select(
        "run_id", "samples", "samples_outside", "events", "alarm_events", r("total_s"), r("max_s"), r("alarm_s"), r("below_s"),
        r("above_s"), "lowest", "highest", r("compliance_pct"))


@query("j06_hold_pressure", f"""WITH {S}, {sql_islands(sql_latch())},
e AS (SELECT *, lead(k) OVER {WIN} AS nk, lead(state) OVER {WIN} AS ns FROM isl_rows)
SELECT run_id, min(us) AS start_us, max(us) AS end_us,
  min(CASE WHEN NOT coalesce(ns, true) THEN least(k, nk) ELSE k END) AS min_pressure FROM e WHERE state GROUP BY run_id, island""")
def j06(spark, sf):
    return stats.hold_pressure(timeline(spark, sf, "k"), expr(THR), expr(HYST)).select("run_id", "start_us", "end_us", "min_pressure")


# -- combining sensors -------------------------------------------------------------------------


def _combine_sql(e: str) -> str:
    return f"WITH {R} SELECT run_id, us, {e} AS combined, count(value) AS n_valid FROM rd GROUP BY run_id, us"


@query("c08_combine_min", _combine_sql("min(value)"))
def c08(spark, sf):
    return sensors.combine(readings(spark, sf), "min")


@query("c08_combine_mean", _combine_sql("round(avg(value), 8)"))
def c08m(spark, sf):
    return sensors.combine(readings(spark, sf), "mean").select("run_id", "us", r("combined", 8), "n_valid")


@query("c09_combine_majority", _combine_sql(f"count(*) FILTER (WHERE value >= {THR}) > count(value) / 2"))
def c09(spark, sf):
    return sensors.combine(readings(spark, sf), "majority", threshold=expr(THR))


@query("c09_combine_at_least", _combine_sql(f"count(*) FILTER (WHERE value >= {THR}) >= 2"))
def c09b(spark, sf):
    return sensors.combine(readings(spark, sf), "majority", threshold=expr(THR), require_at_least=2)


@query("c10_minimum_valid_sensors", f"""WITH {R}, c AS (SELECT run_id, us, count(value) AS n FROM rd GROUP BY run_id, us)
SELECT run_id, count(*) FILTER (WHERE n < 2) AS bad_samples, CASE WHEN count(*) FILTER (WHERE n < 2) > 0
  THEN concat(count(*) FILTER (WHERE n < 2), ' samples below 2 valid sensors') END AS error FROM c GROUP BY run_id""")
def c10(spark, sf):
    return sensors.too_few_valid(sensors.combine(readings(spark, sf), "min"), 2)


@query("c11_combine_median", _combine_sql("round(CASE WHEN count(value) >= 3 THEN quantile_cont(value, 0.5) ELSE avg(value) END, 8)"))
def c11(spark, sf):
    return sensors.combine(readings(spark, sf), "median").select("run_id", "us", r("combined", 8), "n_valid")


@query("c12_combine_positions", f"""WITH lists AS (SELECT vec_id, embedding FROM embeddings),
p AS (SELECT label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, pos, round(avg(x), 6) AS combined FROM p GROUP BY label, pos""")
def c12(spark, sf):
    from tempaudit.plans.common import table

    lists = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return sensors.combine_positions(lists, "embedding", "label").select("label", "pos", r("combined"))


WANTED = "wanted AS (SELECT run_id, unnest(CASE WHEN run_id % 3 = 0 THEN ['click', 'probe'] WHEN run_id % 3 = 1 THEN ['probe', 'relay'] ELSE ['view', 'error'] END) AS sensor FROM (SELECT DISTINCT run_id FROM s WHERE run_id % 5 > 0))"


def wanted(spark, sf):
    listed = F.expr("CASE WHEN run_id % 3 = 0 THEN array('click', 'probe') WHEN run_id % 3 = 1 THEN array('probe', 'relay') "
                    "ELSE array('view', 'error') END")
    return samples(spark, sf).select("run_id").distinct().filter("run_id % 5 > 0").select("run_id", F.explode(listed).alias("sensor"))


@query("b10_sensor_selection_fallback", f"""WITH {S}, {WANTED},
h AS (SELECT DISTINCT s.run_id, s.sensor FROM s JOIN wanted w ON s.run_id = w.run_id AND s.sensor = w.sensor),
st AS (SELECT run_id, run_id IN (SELECT run_id FROM wanted) AS listed, run_id IN (SELECT run_id FROM h) AS hit,
  s.sensor, seq, (run_id, s.sensor) IN (SELECT (run_id, sensor) FROM h) AS own FROM s)
SELECT run_id, sensor, count(*) AS samples, listed AND NOT hit AS fallback_used FROM st
WHERE NOT listed OR NOT hit OR own GROUP BY ALL""")
def b10(spark, sf):
    kept = sensors.select_with_fallback(samples(spark, sf), wanted(spark, sf))
    return kept.groupBy("run_id", "sensor", "fallback_used").agg(F.count(F.lit(1)).alias("samples"))


@query("b11_sensor_selection_strict", f"""WITH {S}, {WANTED}, d AS (SELECT DISTINCT run_id, sensor, 1 AS have FROM s),
f AS (SELECT w.run_id, count(have) AS found FROM wanted w LEFT JOIN d ON w.run_id = d.run_id AND w.sensor = d.sensor GROUP BY w.run_id)
SELECT run_id, found, CASE WHEN found = 0 THEN 'none of the listed sensors found' WHEN found < 2 THEN 'fewer sensors than required'
  ELSE '' END AS issues FROM f""")
def b11(spark, sf):
    return sensors.selection_issues(samples(spark, sf), wanted(spark, sf), 2).select(
        "run_id", "found", F.concat_ws(",", "issues").alias("issues"))


@query("b12_required_signals", f"""WITH {S}, a AS (SELECT run_id, list_sort(list(DISTINCT CASE WHEN value > 40 + 10 * (run_id % 9) THEN sensor ELSE 'idle' END)) AS av FROM s GROUP BY run_id),
m AS (SELECT run_id, av, list_sort(list_filter(['click', 'error', 'view'], lambda x: NOT list_contains(av, x))) AS ms FROM a)
SELECT run_id, array_to_string(av, ',') AS available, array_to_string(ms, ',') AS missing,
  CASE WHEN len(ms) > 0 THEN 'INDETERMINATE' ELSE 'OK' END AS status FROM m""")
def b12(spark, sf):
    seen = samples(spark, sf).withColumn("sensor", F.expr("CASE WHEN value > 40 + 10 * (run_id % 9) THEN sensor ELSE 'idle' END"))
    req = F.array(*map(F.lit, ("click", "error", "view")))
    return sensors.required_signals(seen, req).select(
        "run_id", F.concat_ws(",", "available").alias("available"), F.concat_ws(",", "missing").alias("missing"), "status")


# a reading counts as missing above 25, so that some sensors have none at all
@query("b13_dead_sensors", f"""WITH {S}, v AS (SELECT run_id, sensor, count(CASE WHEN value <= 8 THEN value END) AS n FROM s GROUP BY ALL)
SELECT run_id, count(*) FILTER (WHERE n > 0) AS live, count(*) FILTER (WHERE n = 0) AS dead,
  CASE WHEN count(*) FILTER (WHERE n > 0) = 0 THEN 'ERROR' WHEN count(*) FILTER (WHERE n = 0) > 0 THEN 'WARNING' ELSE 'OK' END AS status
FROM v GROUP BY run_id""")
def b13(spark, sf):
    gaps = samples(spark, sf).withColumn("value", F.when(F.col("value") <= 8, F.col("value")))
    return sensors.dead_sensor_report(gaps)
