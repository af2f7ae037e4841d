"""Verdict queries (J1, V0-V11, U3, U4) and the specification rules behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.functions.scalars import once
from tempaudit.operators import specs as specs_mod
from tempaudit.operators import verdicts
from tempaudit.operators.normalize import normalize
from tempaudit.operators.timeline import Timeline
from tempaudit.plans.common import S, UPTO, WIN, expr, query, r, samples, sql_islands, timeline
from tempaudit.plans.measures import SQL_STAB, sql_f0
from tempaudit.plans.ordered import sql_cross
from tempaudit.session import small_table

# the specification library: a run uses entry run_id % 6.  Hold times fit samples that are hours apart.
LIBRARY = [
    # no, target, uncertainty, hold_time_s, hysteresis, continuous, max_dips_s, max_ramp, max_time_to_threshold_s
    (0, 20.0, 1.0, 43200, 2.0, True, 0.0, None, None),
    (1, 30.0, 1.0, 86400, 4.0, False, 604800.0, 2.0, None),
    (2, 40.0, 2.0, 129600, 20.0, True, 0.0, None, 172800),
    (3, 25.0, 0.5, 172800, 6.0, False, 259200.0, None, None),
    (4, 10.0, 2.0, 86400, 8.0, True, 0.0, 4.0, None),
    (5, 15.0, 1.0, 1036800, 2.0, False, 864000.0, None, 259200),
]
LIBRARY_SCHEMA = ("spec_no int, target_temp double, uncertainty double, hold_time_s long, hysteresis double, continuous boolean, "
                  "max_dips_s double, max_ramp double, max_time_to_threshold_s long")
_val = lambda x: "NULL" if x is None else str(x).lower()
SP = ("sp(spec_no, target_temp, uncertainty, hold_time_s, hysteresis, continuous, max_dips_s, max_ramp_limit, max_ttt) AS (VALUES "
      + ", ".join("(" + ", ".join(_val(x) for x in row) + ")" for row in LIBRARY) + ")")


def with_library(spark, df):
    library = small_table(spark, LIBRARY, LIBRARY_SCHEMA)
    numbered = df.withColumn("spec_no", (F.col("run_id") % 6).cast("int"))
    return verdicts.attach_specs(numbered, library, "spec_no", fixed=True)


@query("j01_samples_with_specs", f"""WITH {S}, {SP} SELECT run_id, count(*) AS samples, max(target_temp + uncertainty)::DOUBLE AS threshold,
  count(*) FILTER (WHERE value >= target_temp + uncertainty) AS above FROM s JOIN sp ON run_id % 6 = spec_no GROUP BY run_id""")
def j01(spark, sf):
    df = with_library(spark, samples(spark, sf)).withColumn("threshold", F.col("target_temp") + F.col("uncertainty"))
    return df.groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"), F.max("threshold").alias("threshold"),
                                    F.count_if(F.col("value") >= F.col("threshold")).alias("above"))


def sql_hold_verdict(form: str, library: str = SP, entries: int = 6, period: float = 14_400.0) -> str:
    latch = f"""coalesce(last_value(CASE WHEN value >= thr THEN true WHEN value < thr - hysteresis THEN false END IGNORE NULLS) OVER {UPTO}, false)"""
    state = f"CASE WHEN continuous THEN {latch if form == 'latch' else 'value >= thr - hysteresis'} ELSE value >= thr END"
    total = "budgeted" if form == "latch" else "stepped"
    few = "INDETERMINATE" if form == "latch" else "FAIL"
    return f"""WITH {S}, {library}, x AS (SELECT s.*, sp.*, target_temp + uncertainty AS thr FROM s JOIN sp ON run_id % {entries} = spec_no),
{sql_islands(state, 'x')},
rv AS (SELECT *, coalesce((us - lag(us) OVER {WIN}) / 1e6, 0) AS dt, (value - lag(value) OVER {WIN}) / ((us - lag(us) OVER {WIN}) / 1e6) * 60 AS ramp FROM x),
rp AS (SELECT run_id, max(coalesce(ramp, 0)) AS max_ramp, count(*) AS n, min(value) AS mn, max(value) AS mx,
  (min(us) FILTER (WHERE value >= thr) - min(us)) / 1e6 AS ttt, coalesce(sum(dt) FILTER (WHERE value >= thr), 0) AS gross,
  coalesce(sum(dt) FILTER (WHERE NOT value >= thr), 0) AS dips FROM rv GROUP BY run_id),
iu AS (SELECT isl.*, sp.max_dips_s, sum(CASE WHEN state THEN 0 ELSE duration_s END) OVER (PARTITION BY run_id ORDER BY island
  ROWS UNBOUNDED PRECEDING) AS used FROM isl JOIN sp ON run_id % {entries} = spec_no),
iv AS (SELECT *, max(CASE WHEN used > max_dips_s THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY island ROWS UNBOUNDED PRECEDING) AS stopped FROM iu),
hh AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS best,
  coalesce(sum(duration_s) FILTER (WHERE state AND stopped = 0), 0) AS budgeted FROM iv GROUP BY run_id),
v0 AS (SELECT *, CASE WHEN dips > max_dips_s THEN greatest(0, gross - (dips - max_dips_s)) ELSE gross END AS stepped,
  greatest(5, floor(hold_time_s / {period}) + 2) AS need, target_temp + uncertainty AS thr FROM rp JOIN hh USING (run_id) JOIN sp ON run_id % {entries} = spec_no),
v AS (SELECT *, CASE WHEN continuous THEN best ELSE {total} END AS held, coalesce(max_ramp > max_ramp_limit, false) AS fast,
  coalesce(ttt > max_ttt, false) AS late, n < need AS short, mx < thr AS never FROM v0)
SELECT run_id, CASE WHEN short THEN '{few}' WHEN never THEN 'FAIL' WHEN held >= hold_time_s AND NOT fast AND NOT late THEN 'PASS' ELSE 'FAIL' END AS status,
  concat_ws(',', CASE WHEN short THEN 'too_few_points' END, CASE WHEN NOT short AND never THEN 'never_reached' END,
    CASE WHEN NOT short AND NOT never AND fast THEN 'ramp_too_high' END, CASE WHEN NOT short AND NOT never AND late THEN 'too_late' END,
    CASE WHEN NOT short AND NOT never AND held >= hold_time_s THEN 'hold_met' END,
    CASE WHEN NOT short AND NOT never AND held < hold_time_s THEN 'hold_short' END) AS codes,
  round(CASE WHEN short OR never THEN 0 ELSE held END, 6)::DOUBLE AS hold_s, mn AS min_temp, mx AS max_temp, round(max_ramp, 6) AS max_ramp FROM v"""


def _hold_columns(v):
    return v.select("run_id", "status", F.array_join("codes", ",").alias("codes"), r("hold_s"), "min_temp", "max_temp", r("max_ramp"))


@query("v01_default_hold_verdict", sql_hold_verdict("latch"))
def v01(spark, sf):
    lean = samples(spark, sf).select("run_id", "us", "seq", "value")
    return _hold_columns(verdicts.hold_verdict(with_library(spark, lean), "latch", 14_400.0))


@query("v02_powder_verdict", sql_hold_verdict("band"))
def v02(spark, sf):
    lean = samples(spark, sf).select("run_id", "us", "seq", "value")
    return _hold_columns(verdicts.powder_verdict(with_library(spark, lean), 14_400.0))


F135, F70, F41 = "((135 - 32) * 5 / 9.0)", "((70 - 32) * 5 / 9.0)", "5.0"
SQL_COOL = f"""{sql_cross(F70, 'cooling', 'a')}, {sql_cross(F41, 'cooling', 'b')},
up AS (SELECT run_id, max(d) AS max_rise FROM (SELECT run_id, value - lag(value) OVER {WIN} AS d FROM s) GROUP BY run_id),
c AS (SELECT s.run_id, arg_min(value, us) AS start_temp, min(value) AS mn, max(value) AS mx, any_value(a.x) AS p1, any_value(b.x) AS p2,
  any_value(max_rise) AS max_rise, (max(us) - min(us) FILTER (WHERE value <= 5.0)) / 1e6 AS below, count(*) AS n
  FROM s JOIN a ON a.run_id = s.run_id JOIN b ON b.run_id = s.run_id JOIN up ON up.run_id = s.run_id GROUP BY s.run_id)"""


def sql_cooling(p1=259_200, p2=864_000, rise=350) -> str:
    return f"""WITH {S}, {SQL_COOL},
f AS (SELECT *, start_temp < {F135} - 0.1 AS cold, max_rise > {rise} AS heated, coalesce(p1 > {p1}, false) AS slow1,
  coalesce(p2 > {p2}, false) AS slow2 FROM c)
SELECT run_id, CASE WHEN NOT cold AND NOT heated AND NOT slow1 AND p1 IS NOT NULL AND NOT slow2 AND p2 IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS status,
  concat_ws(',', CASE WHEN cold THEN 'start_too_cold' END, CASE WHEN heated THEN 'heating' END, CASE WHEN slow1 THEN 'phase1_slow' END,
    CASE WHEN p1 IS NULL THEN 'phase1_missed' END, CASE WHEN slow2 THEN 'phase2_slow' END, CASE WHEN p2 IS NULL THEN 'phase2_missed' END) AS codes,
  round(CASE WHEN p2 IS NOT NULL THEN coalesce(below, 0) ELSE 0 END, 3)::DOUBLE AS hold_s, round(p1, 3) AS to_70f_s, round(p2, 3) AS to_41f_s FROM f"""


@query("v03_cooling_verdict", sql_cooling())
def v03(spark, sf):
    v = verdicts.cooling_verdict(timeline(spark, sf), 259_200.0, 864_000.0, 350.0)
    return v.select("run_id", "status", F.array_join("codes", ",").alias("codes"), r("hold_s", 3), r("to_70f_s", 3), r("to_41f_s", 3))


@query("v09_cooling_independent", f"""WITH {S}, {SQL_COOL}
SELECT run_id, start_temp >= {F135} AS start_ok, round(CASE WHEN start_temp >= {F135} THEN p1 END, 3) AS phase1_s,
  round(CASE WHEN start_temp >= {F135} THEN p2 END, 3) AS phase2_s, coalesce(start_temp >= {F135} AND p1 <= 259200, false) AS phase1_pass,
  coalesce(start_temp >= {F135} AND p2 <= 864000, false) AS phase2_pass FROM c""")
def v09(spark, sf):
    v = verdicts.cooling_verdict_independent(timeline(spark, sf), 259_200.0, 864_000.0)
    return v.select("run_id", "start_ok", r("phase1_s", 3), r("phase2_s", 3), "phase1_pass", "phase2_pass")


PRESSURE = "CAST(CASE run_id % 3 WHEN 0 THEN 105 + k WHEN 1 THEN 0.8 + k / 50 ELSE 10 + k / 4 END AS DOUBLE)"


def sql_autoclave(lo=60.0, hi=400, hold=86_400, ref=150.0, z=100.0) -> str:
    return f"""WITH {S}, {sql_f0(ref, z)},
x AS (SELECT *, {PRESSURE} AS p FROM s),
{sql_islands(f"coalesce(last_value(CASE WHEN value >= {lo} THEN true WHEN value < {lo} - 0.3 THEN false END IGNORE NULLS) OVER {UPTO}, false)", 'x')},
e AS (SELECT *, lead(p) OVER {WIN} AS np, lead(state) OVER {WIN} AS ns FROM isl_rows),
u AS (SELECT run_id, CASE WHEN max(p) BETWEEN 0.8 AND 3.0 AND min(p) >= 0.5 THEN 'bar' WHEN max(p) BETWEEN 10 AND 50 AND min(p) >= 5 THEN 'psi'
  WHEN max(p) BETWEEN 80 AND 300 AND min(p) >= 50 THEN 'kPa' ELSE 'unknown' END AS unit FROM x GROUP BY run_id),
uf AS (SELECT *, CASE unit WHEN 'bar' THEN 100.0 WHEN 'psi' THEN 6.895 ELSE 1.0 END AS fac FROM u),
a AS (SELECT e.run_id, any_value(unit) AS unit, min(CASE WHEN NOT coalesce(ns, true) THEN least(p, np) ELSE p END) FILTER (WHERE state) * any_value(fac) AS hp,
  count(*) FILTER (WHERE p * fac < 103.4) / count(*) * 100 AS low_pct, count(*) FILTER (WHERE value BETWEEN {lo} AND {hi}) AS in_range, max(value) AS mx
  FROM e JOIN uf ON uf.run_id = e.run_id GROUP BY e.run_id),
h AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS hold_s FROM isl GROUP BY run_id),
j AS (SELECT *, hold_s >= {hold} AS long_enough, in_range > 0 AS reached, f0 >= 12 AS f0_ok, mx > {hi} AS hot, coalesce(hp < 103.4, false) AS dropped, low_pct > 5 AS lowp
  FROM a JOIN h USING (run_id) JOIN f USING (run_id)),
k AS (SELECT *, reached AND NOT long_enough AND f0 >= 24 AS comp FROM j)
SELECT run_id, CASE WHEN f0_ok AND reached AND (long_enough OR comp) AND NOT hot AND NOT dropped AND NOT lowp THEN 'PASS' ELSE 'FAIL' END AS status,
  concat_ws(',', CASE WHEN NOT f0_ok THEN 'f0_low' END, CASE WHEN comp THEN 'hold_compensated' END,
    CASE WHEN reached AND NOT long_enough AND NOT comp THEN 'hold_short' END, CASE WHEN NOT reached THEN 'never_in_range' END, CASE WHEN hot THEN 'too_hot' END,
    CASE WHEN dropped THEN 'pressure_dropped' END, CASE WHEN lowp THEN 'pressure_low' END) AS codes,
  round(f0, 2) AS f0, round(hold_s, 6)::DOUBLE AS hold_s, unit AS pressure_unit, round(low_pct, 6) AS low_pressure_pct FROM k"""


@query("v04_autoclave_verdict", sql_autoclave())
def v04(spark, sf):
    tl = Timeline.open(samples(spark, sf).select("run_id", "us", "seq", "value", expr(PRESSURE).alias("k")))
    v = verdicts.autoclave_verdict(tl, 60.0, 400.0, 86_400.0, reference=150.0, z=100.0)
    return v.select("run_id", "status", F.array_join("codes", ",").alias("codes"), r("f0", 2), r("hold_s"), "pressure_unit", r("low_pressure_pct"))


@query("v08_autoclave_independent", f"""WITH {S}, {sql_f0(100.0, 100.0)},
{sql_islands(f"coalesce(last_value(CASE WHEN value >= 100.0 THEN true WHEN value < 98.0 THEN false END IGNORE NULLS) OVER {UPTO}, false)")},
h AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS hold_s FROM isl GROUP BY run_id)
SELECT run_id, round(f0, 1) AS f0, round(hold_s, 6)::DOUBLE AS hold_s, f0 >= 20000 AND hold_s >= 20000 AS pass FROM f JOIN h USING (run_id)""")
def v08(spark, sf):
    v = verdicts.autoclave_verdict_independent(timeline(spark, sf), 100.0, 20_000.0, 20_000.0, 100.0)
    return v.select("run_id", r("f0", 1), r("hold_s"), "pass")


def sql_sterile(lo=20.0, hi=300, hold=86_400) -> str:
    return f"""WITH {S}, x AS (SELECT *, 40 + k / 2 AS rh FROM s),
m AS (SELECT run_id, quantile_cont(k, 0.5) AS md FROM s GROUP BY run_id),
p0 AS (SELECT s.run_id, min(us) FILTER (WHERE value BETWEEN {lo} AND {hi}) AS ps, max(us) AS pe0, min(us) FILTER (WHERE k < md * 0.1) AS fd,
  max(k) AS peak, arg_max(k, us) AS final, min(value) AS mn, max(value) AS mx FROM s JOIN m USING (run_id) GROUP BY s.run_id),
ph AS (SELECT *, CASE WHEN ps IS NOT NULL THEN CASE WHEN fd > ps THEN fd ELSE pe0 END END AS pe FROM p0),
ins AS (SELECT x.* FROM x JOIN ph USING (run_id) WHERE us >= ps AND us < pe),
im AS (SELECT run_id, quantile_cont(k, 0.5) AS imd, min(value) AS pmin FROM ins GROUP BY run_id),
ic AS (SELECT run_id, bool_and(rh BETWEEN 45 AND 85) AS hum, avg(CASE WHEN k >= imd * 0.5 THEN 1.0 ELSE 0.0 END) AS kept, any_value(pmin) AS pmin FROM ins JOIN im USING (run_id) GROUP BY run_id),
{sql_islands(f"coalesce(last_value(CASE WHEN value >= {lo} THEN true WHEN value < {lo} - 1.0 THEN false END IGNORE NULLS) OVER {UPTO}, false)")},
h AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS hold_s FROM isl GROUP BY run_id),
a AS (SELECT ph.*, hold_s, CASE WHEN ps IS NULL THEN (SELECT avg(CASE WHEN rh BETWEEN 45 AND 85 THEN 1.0 ELSE 0.0 END) >= 0.8 FROM x WHERE x.run_id = ph.run_id) ELSE coalesce(hum, true) END AS hum_ok, coalesce(kept >= 0.9, true) AS gas_ok, peak > 100 AND final > peak * 0.1 AS evac,
  ps IS NOT NULL AS reached, mx > {hi} AS hot, mn < {lo} - 2 AND coalesce(CASE WHEN ps IS NOT NULL THEN pmin ELSE mn END < {lo}, false) AS dropped,
  (pe - ps) / 1e6 AS phase_s FROM ph JOIN h USING (run_id) LEFT JOIN ic USING (run_id)),
b AS (SELECT *, reached AND hold_s >= {hold} AS time_ok, reached AND NOT hot AND NOT dropped AS range_ok FROM a),
c AS (SELECT *, CASE WHEN range_ok AND time_ok THEN true WHEN reached THEN phase_s >= {hold} ELSE true END AS phases_ok FROM b)
SELECT run_id, CASE WHEN range_ok AND time_ok AND hum_ok AND gas_ok AND phases_ok THEN 'PASS' ELSE 'FAIL' END AS status,
  concat_ws(',', CASE WHEN reached AND NOT time_ok THEN 'time_short' END, CASE WHEN NOT reached THEN 'never_in_range' END, CASE WHEN hot THEN 'too_hot' END,
   CASE WHEN dropped THEN 'dropped_below' END, CASE WHEN NOT hum_ok THEN 'humidity_out' END, CASE WHEN NOT gas_ok THEN 'gas_not_kept' END,
   CASE WHEN evac THEN 'evacuation_incomplete' END, CASE WHEN NOT phases_ok THEN 'phase_short' END) AS codes,
  round(hold_s, 6)::DOUBLE AS hold_s, round(phase_s, 6)::DOUBLE AS phase_s FROM c"""


@query("v05_sterile_verdict", sql_sterile())
def v05(spark, sf):
    df = samples(spark, sf).select("run_id", "us", "seq", "value", F.col("k").alias("gas"), (F.lit(40.0) + F.col("k") / 2).alias("k"))
    v = verdicts.sterile_verdict(Timeline.open(df), 20.0, 300.0, 86_400.0)
    return v.select("run_id", "status", F.array_join("codes", ",").alias("codes"), r("hold_s"), r("phase_s"))


def sql_concrete(lo=2.0, hi=150, few=18, hours=240, period=864_000) -> str:
    return f"""WITH {S}, {SQL_STAB},
t AS (SELECT run_id, min(us) AS t0 FROM s GROUP BY run_id),
i AS (SELECT run_id, count(*) AS n24, avg(CASE WHEN value BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END) * 100 AS ok_pct FROM s JOIN t USING (run_id)
  WHERE us <= t0 + {hours * 3_600_000_000} GROUP BY run_id),
n AS (SELECT *, row_number() OVER {WIN} AS pos, lag(us) OVER {WIN} AS pu FROM s),
fd AS (SELECT run_id, max((us - pu) / 1e6) FILTER (WHERE pos = 2) AS dt FROM n GROUP BY run_id),
cr AS (SELECT run_id, count(*) AS cn, avg(CASE WHEN value BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END) * 100 AS cp FROM n JOIN fd USING (run_id)
  WHERE pos <= floor({period}.0 / dt) GROUP BY run_id),
{sql_islands(f"coalesce(last_value(CASE WHEN value >= {lo} THEN true WHEN value < {lo} - 0.5 THEN false END IGNORE NULLS) OVER {UPTO}, false)")},
h AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS hold_s FROM isl GROUP BY run_id),
w AS (SELECT run_id, min(value) AS mn, max(value) AS mx, (max(us) - min(us)) / 1e6 AS dur, avg(CASE WHEN value BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END) * 100 AS rp FROM s GROUP BY run_id),
v AS (SELECT *, CASE WHEN n24 < {few} THEN 'INDETERMINATE' WHEN ok_pct >= 95 THEN 'PASS' ELSE 'FAIL' END AS status FROM w JOIN i USING (run_id)
  JOIN stab USING (run_id) JOIN h USING (run_id) LEFT JOIN cr USING (run_id)),
z AS (SELECT *, status = 'FAIL' AS bad FROM v)
SELECT run_id, status, concat_ws(',', CASE WHEN status = 'INDETERMINATE' THEN 'too_few_samples' END, CASE WHEN bad THEN 'first_day_out' END,
  CASE WHEN bad AND dur < 86400 THEN 'period_short' END, CASE WHEN bad AND rp < 95 THEN 'range_out' END,
  CASE WHEN bad AND NOT coalesce(cn > 1 AND cp >= 98, false) THEN 'critical_out' END, CASE WHEN bad AND mn < {lo} THEN 'below_range' END,
  CASE WHEN bad AND mx > {hi} THEN 'above_range' END, CASE WHEN bad AND max_rate > 5 THEN 'unstable' END) AS codes,
  round(CASE WHEN status <> 'INDETERMINATE' AND rp > 0 THEN hold_s ELSE 0 END, 6)::DOUBLE AS hold_s, round(ok_pct, 6) AS ok_pct, round(rp, 6) AS in_range_pct FROM z"""


@query("v06_concrete_verdict", sql_concrete())
def v06(spark, sf):
    v = verdicts.concrete_verdict(timeline(spark, sf, "k"), None, 2.0, 150.0, min_samples=18, day_hours=240.0, period_s=864_000.0)
    return v.select("run_id", "status", F.array_join("codes", ",").alias("codes"), r("hold_s"), r("ok_pct"), r("in_range_pct"))


def sql_outside(lo: float, hi: float) -> str:
    return sql_islands(f"(value < {lo} OR value > {hi})", extra=", min(value) AS mn, max(value) AS mx")


def sql_coldchain(lo=2, hi=150, required=92, per_day=2.3) -> str:
    return f"""WITH {S}, {sql_outside(lo, hi)},
ex AS (SELECT run_id, count(*) AS events, max(duration_s) AS max_s FROM isl WHERE state GROUP BY run_id),
d AS (SELECT *, coalesce((us - lag(us) OVER {WIN}) / 1e6, 0) AS dt FROM s),
a AS (SELECT run_id, count(*) AS n, avg(CASE WHEN value BETWEEN {lo} AND {hi} THEN 1.0 ELSE 0.0 END) * 100 AS pct, (max(us) - min(us)) / 1e6 / 86400 AS days,
  coalesce(sum(dt) FILTER (WHERE value BETWEEN {lo} AND {hi}), 0) AS held FROM d GROUP BY run_id),
b AS (SELECT *, n < greatest(10, floor(days * {per_day})) AS thin FROM a LEFT JOIN ex USING (run_id))
SELECT run_id, CASE WHEN thin THEN 'INDETERMINATE' WHEN pct >= {required} THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN thin THEN 'too_few_samples' WHEN pct >= {required} THEN 'in_range' ELSE 'compliance_low' END AS codes,
  concat_ws(',', CASE WHEN days < 1 THEN 'short_period' END, CASE WHEN days >= 30 THEN 'extended_period' END, CASE WHEN events > 0 THEN 'excursions' END) AS warnings,
  round(held, 6)::DOUBLE AS hold_s, round(pct, 6) AS compliance_pct, coalesce(events, 0) AS events FROM b"""


@query("v07_coldchain_verdict", sql_coldchain())
def v07(spark, sf):
    v = verdicts.coldchain_verdict(timeline(spark, sf), 2.0, 150.0, 92.0, 2.3)
    return v.select("run_id", "status", F.array_join("codes", ",").alias("codes"), F.array_join("warnings", ",").alias("warnings"), r("hold_s"),
                    r("compliance_pct"), "events")


@query("v07_coldchain_details", f"""WITH {S}, {sql_outside(2, 150)},
ex AS (SELECT run_id, count(*) FILTER (WHERE duration_s >= 43200) AS alarms, coalesce(sum(duration_s) FILTER (WHERE duration_s >= 43200), 0) AS alarm_s FROM isl WHERE state GROUP BY run_id),
dl AS (SELECT run_id, us // 86400000000 AS d, round_even(avg(CASE WHEN value BETWEEN 2 AND 150 THEN 1.0 ELSE 0.0 END), 3) * 100 AS p FROM s GROUP BY ALL),
dr AS (SELECT run_id, bool_and(p >= 92) AS every_day, avg(p) AS mean_p FROM dl GROUP BY run_id),
a AS (SELECT run_id, count(*) AS n, avg(CASE WHEN value BETWEEN 2 AND 150 THEN 1.0 ELSE 0.0 END) * 100 AS pct, (max(us) - min(us)) / 1e6 AS dur, min(value) AS mn, max(value) AS mx FROM s GROUP BY run_id),
b AS (SELECT *, coalesce(alarms, 0) AS al, coalesce(alarm_s, 0) AS als FROM a JOIN dr USING (run_id) LEFT JOIN ex USING (run_id))
SELECT run_id, round(pct, 6) AS compliance_pct, pct >= 92 AS range_ok, al = 0 OR als <= 7200 AS alarms_ok, al <= 1 AND als <= 7200 AS control_ok,
  CASE WHEN dur >= 86400 THEN every_day AND mean_p >= 92 ELSE pct >= 92 END AS daily_ok, coalesce(dur / (n - 1) <= 900, false) AS logging_ok,
  CASE WHEN mn < -2 THEN 'critical' WHEN mn < 2 THEN 'below' ELSE 'ok' END AS low_side,
  CASE WHEN mx > 15 THEN 'critical' WHEN mx > 150 THEN 'above' ELSE 'ok' END AS high_side FROM b""")
def v07d(spark, sf):
    v = verdicts.coldchain_details(timeline(spark, sf), 2.0, 150.0, 92.0, 43_200.0)
    return v.withColumn("compliance_pct", F.round("compliance_pct", 6))


@query("v10_coldchain_independent", f"""WITH {S}, {sql_islands('(value < 1 OR value > 250)')},
nx AS (SELECT *, lead(us) OVER {WIN} AS nu, lag(state) OVER {WIN} AS was, greatest(value - 250, 1 - value, 0) AS dev FROM isl_rows),
cl AS (SELECT *, CASE WHEN was THEN CASE WHEN dev > 10 THEN 'critical' WHEN dev > 5 THEN 'high' WHEN dev > 2 THEN 'medium' END END AS cls FROM nx WHERE state),
ev AS (SELECT run_id, island, (max(coalesce(nu, us)) - min(us)) / 1e6 / 3600 AS h, coalesce(arg_max(cls, us) FILTER (WHERE cls IS NOT NULL), 'low') AS sev FROM cl GROUP BY run_id, island),
b AS (SELECT run_id, count(*) FILTER (WHERE sev = 'critical' OR h > 48 OR (sev = 'high' AND h > 4)) AS bad FROM ev GROUP BY run_id),
w AS (SELECT run_id, min(value) >= -5 AND max(value) <= 350 AS limits_ok FROM s GROUP BY run_id)
SELECT run_id, limits_ok, coalesce(bad, 0) AS bad_events, limits_ok AND coalesce(bad, 0) = 0 AS pass FROM w LEFT JOIN b USING (run_id)""")
def v10(spark, sf):
    return verdicts.coldchain_verdict_independent(timeline(spark, sf), 1.0, 250.0, -5.0, 350.0, 48.0)


from tempaudit.plans.measures import SQL_MATURITY, ST_US, W_US  # noqa: E402


@query("v11_concrete_independent", f"""WITH {S}, {SQL_MATURITY},
b AS (SELECT run_id, min(us) AS t0, max(us) AS t1 FROM s GROUP BY run_id),
wins AS (SELECT run_id, t0, unnest(generate_series(0, (t1 - t0 - {W_US}) // {ST_US})) AS w FROM b WHERE t1 - t0 >= {W_US}),
ws AS (SELECT q.run_id, q.w, s.us, s.seq, s.value FROM wins q JOIN s ON s.run_id = q.run_id AND s.us >= t0 + w * {ST_US} AND s.us <= t0 + w * {ST_US} + {W_US}),
wd AS (SELECT *, coalesce((lead(us) OVER (PARTITION BY run_id, w ORDER BY us, seq) - us) / 1e6, 0) AS dt FROM ws),
wa AS (SELECT run_id, w, count(*) AS n, CASE WHEN sum(dt) > 0 THEN coalesce(sum(dt) FILTER (WHERE value BETWEEN 1 AND 180), 0) / sum(dt) * 100 ELSE 0 END AS pct FROM wd GROUP BY ALL),
wr AS (SELECT run_id, count(*) AS tw, avg(pct) AS mp, count(*) FILTER (WHERE pct >= 88 AND n >= 2) >= count(*) * 0.8 AS ok FROM wa GROUP BY run_id),
z AS (SELECT *, coalesce(ok, false) AS tp, strength_pct >= 99.9 AS sp, (t1 - t0) / 1e6 >= 29 * 86400 AS dp FROM b JOIN mat USING (run_id) LEFT JOIN wr USING (run_id))
SELECT run_id, tp AS temperature_pass, sp AS strength_pass, dp AS duration_pass, tp AND sp AND dp AS pass, coalesce(tw, 0) AS total_windows,
  round(strength_pct, 6) AS strength_pct, round(coalesce(mp, 0), 6) AS compliance_pct FROM z""")
def v11(spark, sf):
    v = verdicts.concrete_verdict_independent(timeline(spark, sf), 1.0, 180.0, 432_000, 216_000, 88.0, 99.9, 29.0)
    return v.withColumns({"strength_pct": F.round("strength_pct", 6), "compliance_pct": F.round("compliance_pct", 6)})


# -- normalisation chain -------------------------------------------------------------------------

V0_SQL = f"""{S}, n0 AS (SELECT run_id, us, seq, CASE WHEN sensor = 'click' THEN 'oven_temp_F' ELSE sensor END AS sensor,
  CASE WHEN sensor = 'click' THEN (value - 32) * 5 / 9 ELSE value END AS value, sensor = 'click' AS conv FROM s),
n1 AS (SELECT *, (us - lag(us) OVER (PARTITION BY run_id, sensor ORDER BY us, seq)) / 1e6 AS dt FROM n0),
n2 AS (SELECT *, coalesce(dt <= 3600, false) AS near FROM n1),
n3 AS (SELECT *, (us - lag(us) OVER (PARTITION BY run_id, sensor ORDER BY us, seq)) / 1e6 AS dt2 FROM n2 WHERE NOT near),
q1 AS (SELECT run_id, sensor, count(*) AS n, max(dt2) AS mx, count(*) FILTER (WHERE dt2 > 700000) AS gaps FROM n3 GROUP BY ALL),
q2 AS (SELECT run_id, sum(n)::BIGINT AS rows_kept, max(mx) AS max_step_s, sum(gaps)::BIGINT AS gaps, bool_or(n < 2) AS few, bool_or(mx > 800000) AS long FROM q1 GROUP BY run_id),
q3 AS (SELECT run_id, count(*) AS rows_in, count(*) FILTER (WHERE near) AS near_duplicates, count(*) FILTER (WHERE conv) AS converted_rows FROM n2 GROUP BY run_id),
rep AS (SELECT *, concat_ws(',', CASE WHEN gaps > 0 THEN 'gaps' END, CASE WHEN long THEN 'period_too_long' END, CASE WHEN few THEN 'too_few_samples' END) AS issues FROM q2 JOIN q3 USING (run_id))"""


def _normalized(spark, sf):
    named = samples(spark, sf).select("run_id", "us", "seq", F.when(F.col("sensor") == "click", "oven_temp_F").otherwise(
        F.col("sensor")).alias("sensor"), "value")
    return normalize(named, 800_000.0, 700_000.0, None, 3600.0)


@query("v00_normalize_report", f"""WITH {V0_SQL} SELECT run_id, rows_in, near_duplicates, rows_kept, converted_rows, gaps, round(max_step_s, 6) AS max_step_s,
  issues, CASE WHEN issues = '' THEN 'OK' ELSE 'ERROR' END AS status, concat_ws(',', 'timestamps_utc', 'sorted',
  CASE WHEN near_duplicates > 0 THEN 'near_duplicates_dropped' END, CASE WHEN converted_rows > 0 THEN 'fahrenheit_converted' END, 'quality_checked') AS trace FROM rep""")
def v00r(spark, sf):
    report = _normalized(spark, sf)[1]
    return report.select("run_id", "rows_in", "near_duplicates", "rows_kept", "converted_rows", "gaps", r("max_step_s"),
                         F.array_join("issues", ",").alias("issues"), "status", F.array_join("trace", ",").alias("trace"))


@query("v00_normalized_samples", f"""WITH {V0_SQL} SELECT run_id, seq, sensor, round(value, 6) AS value FROM n3 JOIN rep USING (run_id) WHERE issues = ''""")
def v00s(spark, sf):
    return _normalized(spark, sf)[0].select("run_id", "seq", "sensor", r("value"))


# -- specifications --------------------------------------------------------------------------------


def spec_rows(spark, sf):
    """Version-1 specifications derived from the orders, some of them breaking rules."""
    from tempaudit.plans.common import table

    o = table(spark, sf, "orders")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    text = F.format_string(
        '{"version":"%s","industry":"%s","job":{"job_id":"job%s%d"},"spec":{"method":"%s","target_temp_C":%d,"hold_time_s":%d,'
        '"temp_band_C":{"min":%d,"max":100},"sensor_uncertainty_C":%d},"data_requirements":{"max_sample_period_s":%d,"allowed_gaps_s":60},'
        '"sensor_selection":{"mode":"mean","sensors":["t1","t%d"],"require_at_least":%d},"logic":{"continuous":true,"max_total_dips_s":0}}',
        F.when(k % 11 == 0, "2.0").otherwise("1.0"), F.when(k % 2 == 0, "powder").otherwise("haccp"), F.when(k % 13 == 0, " ").otherwise("-"), k,
        F.when(k % 5 == 0, "PMT").when(k % 5 == 1, "REFRIGERATION").otherwise("OVEN_AIR"), (k % 400), (p.cast("long") % 200_000),
        (k % 120), (k % 12), (k % 4000), (1 + k % 3).cast("int"), (k % 6).cast("int"))
    return o.select("o_orderkey", once(F.from_json(text, specs_mod.SPEC_SCHEMA)).alias("j")).select("o_orderkey", "j.*")


SQL_SPEC = """sp AS (SELECT o_orderkey AS k, o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) % 200000 AS hold FROM orders),
bad AS (SELECT o_orderkey, concat_ws(',', CASE WHEN k % 11 = 0 THEN 'version' END, CASE WHEN k % 13 = 0 THEN 'job_id' END,
  CASE WHEN k % 400 <= 0 OR k % 400 > 300 THEN 'target_temp_C' END, CASE WHEN NOT hold BETWEEN 1 AND 172800 THEN 'hold_time_s' END,
  CASE WHEN k % 120 > 100 THEN 'temp_band_C' END, CASE WHEN k % 12 > 10 THEN 'sensor_uncertainty_C' END,
  CASE WHEN NOT k % 4000 BETWEEN 1 AND 3600 THEN 'max_sample_period_s' END, CASE WHEN k % 3 = 0 THEN 'sensors_not_unique' END,
  CASE WHEN k % 6 < 1 THEN 'require_at_least' END, CASE WHEN k % 2 = 1 AND k % 5 = 0 THEN 'industry_method' END) AS violations FROM sp)"""


@query("b17_spec_validation", f"WITH {SQL_SPEC} SELECT o_orderkey, violations FROM bad")
def b17(spark, sf):
    return spec_rows(spark, sf).select("o_orderkey", F.array_join(specs_mod.rule_violations(), ",").alias("violations"))


@query("a07_spec_scan", f"WITH {SQL_SPEC} SELECT violations = '' AS valid, count(*) AS n FROM bad GROUP BY ALL")
def a07(spark, sf):
    judged = spec_rows(spark, sf).select((F.size(specs_mod.rule_violations()) == 0).alias("valid"))
    return judged.groupBy("valid").agg(F.count(F.lit(1)).alias("n"))


INDUSTRY_NAMES = ("powder", "autoclave", "coldchain", "haccp", "concrete", "sterile", "ceramics")


@query("b16_spec_adaptation", """WITH x AS (SELECT o_orderkey AS k, ['powder','autoclave','coldchain','haccp','concrete','sterile','ceramics'][o_orderkey % 7 + 1] AS ind,
  o_orderkey % 3 = 0 AS given FROM orders)
SELECT k AS o_orderkey, ind AS industry, CASE WHEN ind = 'powder' THEN 'PMT' ELSE 'OVEN_AIR' END AS method,
  CASE WHEN given AND ind IN ('powder', 'ceramics') THEN (k % 100)::DOUBLE ELSE CASE ind WHEN 'powder' THEN 180.0 WHEN 'autoclave' THEN 121.0 WHEN 'coldchain' THEN 8.0
    WHEN 'haccp' THEN 135.0 WHEN 'concrete' THEN 30.0 WHEN 'sterile' THEN 55.0 ELSE 100.0 END END::DOUBLE AS target_temp_C,
  (CASE ind WHEN 'powder' THEN CASE WHEN given THEN (k % 40) * 60 ELSE 600 END WHEN 'autoclave' THEN 900 WHEN 'coldchain' THEN 3600 WHEN 'haccp' THEN 7200
    WHEN 'concrete' THEN 86400 WHEN 'sterile' THEN 43200 ELSE 600 END)::BIGINT AS hold_time_s,
  CASE WHEN ind = 'coldchain' THEN 1.0 ELSE 2.0 END::DOUBLE AS sensor_uncertainty_C FROM x""")
def b16(spark, sf):
    from tempaudit.plans.common import table

    k = F.col("o_orderkey")
    industry = F.element_at(F.array(*map(F.lit, INDUSTRY_NAMES)), (k % 7 + 1).cast("int"))
    params = F.when(k % 3 == 0, F.create_map(F.lit("target_temp"), (k % 100).cast("string"), F.lit("hold_duration_minutes"),
                                             (k % 40).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    v2 = table(spark, sf, "orders").select("o_orderkey", industry.alias("industry"), params.alias("parameters"))
    return v2.select("o_orderkey", "industry", specs_mod.adapt(F.col("parameters"), F.col("industry")).alias("s")).select(
        "o_orderkey", "industry", "s.*")


ENGINE_NAMES = ("powder", "haccp", "autoclave", "sterile", "concrete", "coldchain")  # the engine of runs with run_id % 6 = 0 to 5
ONE_SPEC = ("sp(spec_no, target_temp, uncertainty, hold_time_s, hysteresis, continuous, max_dips_s, max_ramp_limit, max_ttt) AS "
            "(VALUES (0, 180.0, 2.0, 600, 2.0, true, 0.0, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)))")


def sql_engines(*queries: str) -> str:
    return " UNION ALL ".join(f"SELECT run_id, '{name}' AS industry, status, codes FROM ({q}) AS q{i} WHERE run_id % 6 = {i}"
                              for i, (name, q) in enumerate(zip(ENGINE_NAMES, queries)))


def tagged_runs(spark, sf):
    """Samples with a signal for every engine, and a specification with aliased industry names per run."""
    named = ("Powder-Coating", "haccp", "autoclave", "ETO", "concrete", " cold-chain")
    df = samples(spark, sf).select("run_id", "us", "seq", "value", "k", F.col("k").alias("gas"), (F.lit(40.0) + F.col("k") / 2).alias("rh"),
                                   expr(PRESSURE).alias("pressure"))
    industry = F.element_at(F.array(*map(F.lit, named)), (F.col("run_id") % 6 + 1).cast("int"))
    return df, df.select("run_id").distinct().withColumn("industry", industry)


def _judged(spark, sf, engines, extra=lambda specs: specs):
    df, specs = tagged_runs(spark, sf)
    return verdicts.judge_runs(df, extra(specs), engines).select("run_id", "industry", "status", F.array_join("codes", ",").alias("codes"))


@query("b18_industry_dispatch", sql_engines(sql_hold_verdict("band"), sql_cooling(), sql_autoclave(), sql_sterile(), sql_concrete(), sql_coldchain()))
def b18(spark, sf):
    """All engines with limits that fit the spacing of the stand-in samples; powder runs bring theirs along."""
    limits = ("target_temp", "uncertainty", "hold_time_s", "hysteresis", "continuous", "max_dips_s", "max_ramp", "max_time_to_threshold_s")
    return _judged(spark, sf, {
        "powder": verdicts.powder_engine(14_400.0, given=limits), "haccp": verdicts.cooling_engine(259_200.0, 864_000.0, 350.0),
        "autoclave": verdicts.autoclave_engine(60.0, 400.0, 86_400.0, pressure="pressure", reference=150.0, z=100.0),
        "sterile": verdicts.sterile_engine(20.0, 300.0, 86_400.0, humidity="rh"),
        "concrete": verdicts.concrete_engine(2.0, 150.0, min_samples=18, day_hours=240.0, period_s=864_000.0),
        "coldchain": verdicts.coldchain_engine(2.0, 150.0, 92.0, 2.3)}, lambda specs: with_library(spark, specs).drop("spec_no"))


@query("u03_engine_table", sql_engines(
    sql_hold_verdict("band", ONE_SPEC, 1, 30.0), sql_cooling(7200, 21_600, 2), sql_autoclave(119.0, 123, 900, 121.1, 10.0),
    sql_sterile(50.0, 60, 7200), sql_concrete(16.0, 27, 10, 24, 86_400), sql_coldchain(2, 8, 95, 96.0)))
def u03(spark, sf):
    """The table of engines as shipped, with the limits of the rules; two entries are told which column holds their signal."""
    return _judged(spark, sf, verdicts.ENGINES | {
        "autoclave": verdicts.autoclave_engine(pressure="pressure"), "sterile": verdicts.sterile_engine(humidity="rh")})


@query("u04_processing_trace", f"""WITH {V0_SQL}, t AS (SELECT run_id, unnest(['timestamps_utc', 'sorted', 'quality_checked']) AS step FROM rep
  UNION ALL SELECT run_id, 'near_duplicates_dropped' FROM rep WHERE near_duplicates > 0 UNION ALL SELECT run_id, 'fahrenheit_converted' FROM rep WHERE converted_rows > 0)
SELECT step, count(*) AS runs FROM t GROUP BY step""")
def u04(spark, sf):
    report = _normalized(spark, sf)[1]
    return report.select(F.explode("trace").alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("runs"))
