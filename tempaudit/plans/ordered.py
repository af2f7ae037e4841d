"""Ordered-operator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.operators import curves, excursions, holds
from tempaudit.plans.common import (BUDGET, HI, HYST, LO, S, SQL_LONGEST, THR, WIN, expr, query, r, samples,
                                    sql_islands, sql_latch, timeline)


@query("d01_sample_interval", f"""WITH {S}
SELECT run_id, seq, round((us - lag(us) OVER {WIN}) / 1e6, 6) AS dt FROM s""")
def d01(spark, sf):
    return curves.with_step(timeline(spark, sf)).rows().select("run_id", "seq", r("dt"))


# the stand-in's samples are hours apart, so the near-duplicate limit is 30 minutes here
@query("d02_near_duplicates", f"""WITH {S}, d AS (SELECT *, (us - lag(us) OVER {WIN}) / 1e6 AS dt FROM s)
SELECT run_id, seq, value FROM d WHERE dt IS NULL OR dt > 1800""")
def d02(spark, sf):
    return curves.drop_near_duplicates(timeline(spark, sf), 1800.0).rows().select("run_id", "seq", "value")


SQL_QUALITY = f"""d AS (SELECT *, (us - lag(us) OVER {WIN}) / 1e6 AS dt FROM s),
a AS (SELECT run_id, count(*) AS samples, max(dt) AS max_step_s,
  count(*) FILTER (WHERE dt > 43200.0 + 3600 * (run_id % 5)) AS gaps,
  count(*) FILTER (WHERE dt = 0) AS duplicates, max(150000.0 + 10000 * (run_id % 7)) AS period FROM d GROUP BY run_id)"""


@query("d03_step_quality", f"""WITH {S}, {SQL_QUALITY}
SELECT run_id, samples, round(max_step_s, 6) AS max_step_s, gaps, duplicates,
  concat_ws(',', CASE WHEN samples < 2 THEN 'too_few_samples' END, CASE WHEN max_step_s > period THEN 'period_too_long' END,
    CASE WHEN gaps > 0 THEN 'gaps' END, CASE WHEN duplicates > 0 THEN 'duplicate_timestamps' END) AS issues FROM a""")
def d03(spark, sf):
    found = curves.step_quality(timeline(spark, sf), expr("150000.0 + 10000 * (run_id % 7)").cast("double"),
                                expr("43200.0 + 3600 * (run_id % 5)").cast("double"))
    return found.select("run_id", "samples", r("max_step_s"), "gaps", "duplicates", F.concat_ws(",", "issues").alias("issues"))


@query("d04_hysteresis_latch", f"WITH {S} SELECT run_id, seq, {sql_latch()} AS state FROM s")
def d04(spark, sf):
    return holds.latch(timeline(spark, sf), expr(THR), expr(HYST)).rows().select("run_id", "seq", "state")


@query("d05_islands", f"""WITH {S}, {sql_islands(f'value >= {THR}')}
SELECT run_id, state, start_us, end_us, samples, round(duration_s, 6) AS duration_s FROM isl""")
def d05(spark, sf):
    tl = holds.mask(timeline(spark, sf), F.col("value") >= expr(THR))
    return holds.island_rows(tl).select("run_id", "state", "start_us", "end_us", "samples", r("duration_s"))


SQL_BEST = f"""{SQL_LONGEST}
SELECT run_id, round(coalesce(duration_s, 0), 6) AS hold_s, start_us / 1e6 AS hold_start_s, end_us / 1e6 AS hold_end_s
FROM runs LEFT JOIN (SELECT * FROM best WHERE rn = 1) USING (run_id)"""


@query("d06_longest_latched_hold", f"WITH {S}, {sql_islands(sql_latch())}, {SQL_BEST}")
def d06(spark, sf):
    return holds.latched_hold(timeline(spark, sf), expr(THR), expr(HYST)).select(
        "run_id", r("hold_s"), (F.col("hold_start_us") / 1e6).alias("hold_start_s"), (F.col("hold_end_us") / 1e6).alias("hold_end_s"))


@query("d07_longest_band_hold", f"WITH {S}, {sql_islands(f'value >= {THR} - {HYST}')}, {SQL_BEST}")
def d07(spark, sf):
    return holds.band_hold(timeline(spark, sf), expr(THR), expr(HYST)).select(
        "run_id", r("hold_s"), (F.col("hold_start_us") / 1e6).alias("hold_start_s"), (F.col("hold_end_us") / 1e6).alias("hold_end_s"))


@query("d08_boolean_hold", f"""WITH {S}, {sql_islands(f'value >= {THR}')},
a AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS longest_s,
  coalesce(sum(duration_s) FILTER (WHERE NOT state), 0) AS off_s, coalesce(sum(duration_s) FILTER (WHERE state), 0) AS on_s
  FROM isl GROUP BY run_id)
SELECT run_id, round(longest_s, 6) AS longest_s,
  round(CASE WHEN off_s > 20 * {BUDGET} THEN 0 ELSE on_s END, 6) AS cumulative_s FROM a""")
def d08(spark, sf):
    held = holds.boolean_hold(timeline(spark, sf).with_columns(_allow=expr(BUDGET)), F.col("value") >= expr(THR),
                              20 * expr(BUDGET))
    return held.select("run_id", r("longest_s"), r("cumulative_s"))


SQL_BUDGET = f"""{sql_islands(f'value >= {THR}')},
u AS (SELECT *, sum(CASE WHEN state THEN 0 ELSE duration_s END) OVER (PARTITION BY run_id ORDER BY island
  ROWS UNBOUNDED PRECEDING) AS used FROM isl),
f AS (SELECT *, max(CASE WHEN used > {BUDGET} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY island
  ROWS UNBOUNDED PRECEDING) AS stopped FROM u)"""


@query("d09_budgeted_hold", f"""WITH {S}, {SQL_BUDGET}
SELECT run_id, round(coalesce(sum(duration_s) FILTER (WHERE state AND stopped = 0), 0), 6) AS cumulative_s,
  count(*) FILTER (WHERE state AND stopped = 0) AS intervals FROM f GROUP BY run_id""")
def d09(spark, sf):
    return holds.budget_hold(timeline(spark, sf), expr(THR), expr(BUDGET)).select("run_id", r("cumulative_s"), "intervals")


@query("d10_step_hold", f"""WITH {S}, d AS (SELECT *, coalesce((us - lag(us) OVER {WIN}) / 1e6, 0) AS dt FROM s),
a AS (SELECT run_id, coalesce(sum(dt) FILTER (WHERE value >= {THR}), 0) AS gross,
  coalesce(sum(dt) FILTER (WHERE NOT value >= {THR}), 0) AS dips FROM d GROUP BY run_id)
SELECT run_id, round(CASE WHEN dips > 10 * {BUDGET} THEN greatest(0, gross - (dips - 10 * {BUDGET})) ELSE gross END, 6)
  AS cumulative_s FROM a""")
def d10(spark, sf):
    return holds.step_hold(timeline(spark, sf), expr(THR), 10 * expr(BUDGET)).select("run_id", r("cumulative_s"))


@query("d11_latched_total", f"""WITH {S}, {sql_islands(sql_latch())}
SELECT run_id, round(coalesce(sum(duration_s) FILTER (WHERE state), 0), 6) AS cumulative_s FROM isl GROUP BY run_id""")
def d11(spark, sf):
    return holds.latched_total(timeline(spark, sf), expr(THR), expr(HYST)).select("run_id", r("cumulative_s"))


OUT = f"(value < {LO} OR value > {HI})"


@query("d12_excursion_islands", f"""WITH {S},
{sql_islands(OUT, extra=f", min(value) AS min_value, max(value) AS max_value, max({LO}) AS lo, max({HI}) AS hi")}
SELECT run_id, start_us, end_us, round(duration_s, 6) AS duration_s, min_value, max_value,
  duration_s >= 43200 AS is_alarm, min_value < lo AS below_range, max_value > hi AS above_range FROM isl WHERE state""")
def d12(spark, sf):
    return excursions.excursion_islands(timeline(spark, sf), expr(LO), expr(HI), 43200.0).select(
        "run_id", "start_us", "end_us", r("duration_s"), "min_value", "max_value", "is_alarm", "below_range", "above_range")


DEV = f"greatest(value - {HI}, {LO} - value, 0)"
SQL_CLOSED = f"""{sql_islands(OUT)},
nx AS (SELECT *, lead(us) OVER {WIN} AS next_us, lag(state) OVER {WIN} AS was_out, {DEV} AS dev FROM isl_rows),
cl AS (SELECT *, CASE WHEN state AND was_out THEN CASE WHEN dev > 10 THEN 'critical' WHEN dev > 5 THEN 'high'
  WHEN dev > 2 THEN 'medium' END END AS cls,
  CASE WHEN dev > 10 THEN 3 WHEN dev > 5 THEN 2 WHEN dev > 2 THEN 1 ELSE 0 END AS lev FROM nx WHERE state),
closed AS (SELECT run_id, island, min(us) AS start_us, max(coalesce(next_us, us)) AS end_us, min(value) AS min_value,
  max(value) AS max_value, coalesce(arg_max(cls, us) FILTER (WHERE cls IS NOT NULL), 'low') AS severity, max(lev) AS worst,
  (max(coalesce(next_us, us)) - min(us)) / 1e6 AS duration_s FROM cl GROUP BY run_id, island)"""


@query("d13_closed_excursions", f"""WITH {S}, {SQL_CLOSED}
SELECT run_id, start_us, end_us, round(duration_s, 6) AS duration_s, min_value, max_value, severity,
  CASE worst WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity_worst
FROM closed WHERE duration_s >= 3600""")
def d13(spark, sf):
    return excursions.closed_excursions(timeline(spark, sf), expr(LO), expr(HI), 3600.0).select(
        "run_id", "start_us", "end_us", r("duration_s"), "min_value", "max_value", "severity", "severity_worst")


@query("d14_backward_ramp", f"""WITH {S},
d AS (SELECT run_id, (value - lag(value) OVER {WIN}) / ((us - lag(us) OVER {WIN}) / 1e6) * 60 AS v FROM s)
SELECT run_id, round(max(coalesce(v, 0)), 6) AS max_ramp FROM d GROUP BY run_id""")
def d14(spark, sf):
    return curves.max_backward_ramp(timeline(spark, sf)).select("run_id", r("max_ramp"))


@query("d15_central_ramp", f"""WITH {S}, d AS (SELECT run_id, (lead(value) OVER {WIN} - lag(value) OVER {WIN})
  / ((lead(us) OVER {WIN} - lag(us) OVER {WIN}) / 1e6) * 60 AS v FROM s)
SELECT run_id, round(coalesce(max(v), 0), 6) AS max_ramp FROM d GROUP BY run_id""")
def d15(spark, sf):
    return curves.max_central_ramp(timeline(spark, sf)).select("run_id", r("max_ramp"))


@query("d16_time_to_threshold", f"""WITH {S} SELECT run_id,
  round((min(us) FILTER (WHERE value >= 4 * {THR}) - min(us)) / 1e6, 6) AS time_to_threshold_s FROM s GROUP BY run_id""")
def d16(spark, sf):
    return holds.time_to_threshold(timeline(spark, sf), 4 * expr(THR)).select("run_id", r("time_to_threshold_s"))


def sql_cross(target: str, direction: str, name: str) -> str:
    hit = "value >= t AND nv <= t" if direction == "cooling" else "value <= t AND nv >= t"
    return f"""{name} AS (SELECT run_id, (min(CASE WHEN {hit} THEN us + CASE WHEN nv = value THEN 0.0
      ELSE (t - value) / (nv - value) END * (nu - us) END) - min(us)) / 1e6 AS x FROM
      (SELECT *, {target} AS t, lead(value) OVER {WIN} AS nv, lead(us) OVER {WIN} AS nu FROM s) GROUP BY run_id)"""


@query("d17_crossing_cooling", f"""WITH {S}, {sql_cross(THR, 'cooling', 'c')}
SELECT run_id, round(x, 3) AS cross_s FROM c""")
def d17c(spark, sf):
    return curves.crossing(timeline(spark, sf), expr(THR), "cooling").select("run_id", r("cross_s", 3))


@query("d17_crossing_heating", f"""WITH {S}, {sql_cross(THR, 'heating', 'c')}
SELECT run_id, round(x, 3) AS cross_s FROM c""")
def d17h(spark, sf):
    return curves.crossing(timeline(spark, sf), expr(THR), "heating").select("run_id", r("cross_s", 3))


# gas stand-in: k; a drop is k below a tenth of the run's median k
SQL_PHASES = f"""m AS (SELECT run_id, quantile_cont(k, 0.5) AS gas_median FROM s GROUP BY run_id),
ph0 AS (SELECT run_id, any_value(gas_median) AS gas_median, min(us) FILTER (WHERE value BETWEEN 50 AND 60) AS phase_start_us,
  max(us) AS run_end_us, min(us) AS run_start_us, min(us) FILTER (WHERE k < gas_median * 0.1) AS first_drop_us
  FROM s JOIN m USING (run_id) GROUP BY run_id),
ph AS (SELECT *, CASE WHEN phase_start_us IS NOT NULL THEN CASE WHEN first_drop_us > phase_start_us THEN first_drop_us
  ELSE run_end_us END END AS phase_end_us FROM ph0)"""


@query("d18_gas_phases", f"""WITH {S}, {SQL_PHASES}
SELECT run_id, round(gas_median, 6) AS gas_median, phase_start_us / 1e6 AS phase_start_s,
  phase_end_us / 1e6 AS phase_end_s FROM ph""")
def d18(spark, sf):
    return curves.gas_phases(timeline(spark, sf, "k")).select("run_id", r("gas_median"), (F.col("phase_start_us") / 1e6).alias("phase_start_s"),
        (F.col("phase_end_us") / 1e6).alias("phase_end_s"))


@query("d19_cooling_rate", f"""WITH {S}, {sql_cross('50.0', 'cooling', 'a')}, {sql_cross('20.0', 'cooling', 'b')}
SELECT run_id, round(CASE WHEN b.x > a.x THEN 30.0 / ((b.x - a.x) / 3600) END, 6) AS cooling_rate_per_h
FROM a JOIN b USING (run_id)""")
def d19(spark, sf):
    return curves.cooling_rate(timeline(spark, sf), 50.0, 20.0).select("run_id", r("cooling_rate_per_h"))


@query("d20_heating_check", f"""WITH {S}, d AS (SELECT run_id, value - lag(value) OVER {WIN} AS up FROM s)
SELECT run_id, round(max(up), 6) AS max_rise, coalesce(max(up) > 150, false) AS heating_detected FROM d GROUP BY run_id""")
def d20(spark, sf):
    return curves.heating_check(timeline(spark, sf), 150.0).select("run_id", r("max_rise"), "heating_detected")


@query("d21_rolling_uniformity", f"""WITH {S}, w AS (SELECT run_id,
  stddev_pop(value) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING) AS sd,
  count(*) OVER (PARTITION BY run_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 86400000000 FOLLOWING) AS n FROM s)
SELECT run_id, round(avg(sd) FILTER (WHERE n >= 3), 6) AS uniformity, count(*) FILTER (WHERE n >= 3) AS windows
FROM w GROUP BY run_id""")
def d21(spark, sf):
    return curves.rolling_uniformity(timeline(spark, sf), 86_400.0).select("run_id", r("uniformity"), "windows")


STEP_US = 21_600_000_000


@query("d22_resample", f"""WITH {S},
dd AS (SELECT run_id, (us - lag(us) OVER {WIN}) / 1e6 AS dt FROM s),
ok AS (SELECT run_id FROM dd GROUP BY run_id HAVING quantile_cont(dt, 0.5) BETWEEN 1.15 * 21600 AND 2.0 * 21600),
b AS (SELECT run_id, us - us % {STEP_US} AS bucket_us, avg(value) AS m FROM s WHERE run_id IN (SELECT run_id FROM ok) GROUP BY ALL),
g AS (SELECT run_id, unnest(generate_series(min(bucket_us), max(bucket_us), {STEP_US})) AS bucket_us FROM b GROUP BY run_id),
c AS (SELECT g.run_id, g.bucket_us, m FROM g LEFT JOIN b ON g.run_id = b.run_id AND g.bucket_us = b.bucket_us),
f AS (SELECT *,
  last_value(CASE WHEN m IS NOT NULL THEN bucket_us END IGNORE NULLS) OVER a AS pa, last_value(m IGNORE NULLS) OVER a AS pv,
  first_value(CASE WHEN m IS NOT NULL THEN bucket_us END IGNORE NULLS) OVER z AS na, first_value(m IGNORE NULLS) OVER z AS nv
  FROM c WINDOW a AS (PARTITION BY run_id ORDER BY bucket_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  z AS (PARTITION BY run_id ORDER BY bucket_us ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT run_id, bucket_us, round(CASE WHEN bucket_us - pa <= 2 * {STEP_US} THEN pv
  ELSE pv + (nv - pv) * (bucket_us - pa - 2 * {STEP_US}) / (na - pa - 2 * {STEP_US}) END, 6) AS value FROM f""")
def d22(spark, sf):
    return curves.resample(timeline(spark, sf), 21_600).select("run_id", "bucket_us", r("value"))


@query("d23_hold_intervals", f"""WITH {S}, {SQL_BUDGET}
SELECT run_id, start_us, end_us FROM f WHERE state AND stopped = 0""")
def d23(spark, sf):
    return holds.hold_intervals(timeline(spark, sf), expr(THR), expr(HYST), False, expr(BUDGET)).select(
        "run_id", "start_us", "end_us")


@query("d24_final_hold", f"""WITH {S} SELECT run_id,
  round(coalesce((max(us) - min(us) FILTER (WHERE value <= 5.0)) / 1e6, 0), 6) AS final_hold_s FROM s GROUP BY run_id""")
def d24(spark, sf):
    return holds.final_hold(timeline(spark, sf), 5.0).select("run_id", r("final_hold_s"))


@query("d25_consecutive_good", f"""WITH {S}, {sql_islands(f'value >= {LO}')}
SELECT run_id, coalesce(max(samples) FILTER (WHERE state), 0) AS longest_streak,
  coalesce(max(samples) FILTER (WHERE state), 0) >= 12 AS exposure_met FROM isl GROUP BY run_id""")
def d25(spark, sf):
    return holds.consecutive_good(timeline(spark, sf), F.col("value") >= expr(LO), 12).select(
        "run_id", F.col("longest_streak").cast("long"), "exposure_met")


@query("d23_longest_interval", f"""WITH {S}, {sql_islands(sql_latch())}, {SQL_LONGEST}
SELECT run_id, start_us, end_us FROM best WHERE rn = 1""")
def d23l(spark, sf):
    return holds.hold_intervals(timeline(spark, sf), expr(THR), expr(HYST), True)
