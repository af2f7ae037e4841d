"""Row-function and column-name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.functions import clock, names, scalars, units
from tempaudit.plans.common import S, THR, expr, query, r, samples, table
from tempaudit.session import small_table

# header spellings dealt out over the events, with the meaning each must get
HEADERS = [
    ("Temp_C", "temperature"), ("TEMPERATURE", "temperature"), ("Temp 1", "temperature_1"), ("Sensor_2", "temperature_2"),
    ("temp [°C]", "temperature"), ("Date-Time", "timestamp"), ("Sample_Time", "timestamp"), ("Pressure (psi)", "pressure"),
    ("pressure_kPa", "pressure"), ("P1", "pressure_1"), ("%RH", "humidity"), ("Relative Humidity", "humidity"),
    ("Probe-3", "temperature_3"), ("Oven_Temp", "temperature"), ("notes", "notes"), ("gas_ppm", "gas_ppm"), ("shelf", "shelf"),
    ("humidity(%)", "humidity"), ("pt100", "temperature"),
]
N_HEADERS = len(HEADERS)


def headers(spark, sf):
    dealt = F.element_at(F.array(*[F.lit(h) for h, _ in HEADERS]), (F.col("seq") % N_HEADERS + 1).cast("int"))
    return samples(spark, sf).withColumn("name", dealt)


HEAD = "hd(i, name, canonical) AS (VALUES {})".format(", ".join(f"({i}, '{h}', '{c}')" for i, (h, c) in enumerate(HEADERS)))


@query("b01_header_aliases", f"""WITH {S}, {HEAD}
SELECT name, canonical, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN hd ON seq % {N_HEADERS} = i GROUP BY ALL""")
def b01(spark, sf):
    return names.rename_headers(headers(spark, sf), spark).groupBy("name", "canonical").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _profile(df, columns):
    """Count and sum of each detected column, in long form."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, x)").groupBy("name").agg(
        F.count("x").alias("n"), F.round(F.sum("x"), 4).alias("total"))


def _profile_sql(*cols):
    return f"WITH {S} " + " UNION ALL ".join(
        f"SELECT '{n}' AS name, count({e}) AS n, round(sum({e}), 4)::DOUBLE AS total FROM s" for n, e in cols)


def wide(spark, sf):
    return samples(spark, sf).select(
        F.timestamp_micros("us").alias("log_time"), F.col("value").alias("Temp_C"), F.col("k").alias("pressure_psi"),
        (F.col("k") + 1).alias("RH_percent"), (F.col("value") * 10).alias("eto_ppm"), F.col("value").alias("notes_len"),
        F.col("sensor").alias("temp_label"), (F.col("value") + F.col("k")).alias("sensor_1"))


@query("b02_timestamp_column", f"""WITH {S} SELECT 'log_time' AS name, count(us) AS n,
  min(us) AS first_us, max(us) AS last_us FROM s""")
def b02(spark, sf):
    df = wide(spark, sf)
    c = names.timestamp_column(df)
    return df.select(F.lit(c).alias("name"), F.unix_micros(c).alias("us")).groupBy("name").agg(
        F.count("us").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("b03_timestamp_format", f"""WITH {S} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'unix' ELSE 'iso' END AS ts_format
FROM s GROUP BY run_id""")
def b03(spark, sf):
    text = F.when(F.col("run_id") % 2 == 0, F.expr("us div 1000000L").cast("string")).otherwise(
        F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss"))
    return clock.detect_format(samples(spark, sf).withColumn("text", text), "text")


@query("b04_temperature_columns", _profile_sql(("Temp_C", "value"), ("sensor_1", "value + k")))
def b04(spark, sf):
    df = wide(spark, sf)
    return _profile(df, names.temperature_columns(df))


@query("b05_decision_temperature_columns", _profile_sql(("Temp_C", "value")))
def b05(spark, sf):
    df = wide(spark, sf)
    return _profile(df, names.decision_temperature_columns(df))


@query("b05_temperature_by_values", _profile_sql(("beta", "value")))
def b05v(spark, sf):
    df = samples(spark, sf).select((F.col("value") * 1e6).alias("alpha"), F.col("value").alias("beta"), F.col("k").alias("gamma"))
    return _profile(df, names.decision_temperature_columns(df))


@query("b06_coldchain_temperature_columns", _profile_sql(("Temp_C", "value")))
def b06(spark, sf):
    df = wide(spark, sf)
    return _profile(df, names.coldchain_temperature_columns(df))


@query("b07_pressure_columns", _profile_sql(("pressure_psi", "k")))
def b07(spark, sf):
    df = wide(spark, sf)
    return _profile(df, names.pressure_columns(df))


@query("b08_humidity_columns", _profile_sql(("RH_percent", "k + 1")))
def b08(spark, sf):
    df = wide(spark, sf)
    return _profile(df, names.humidity_columns(df))


@query("b09_gas_columns", _profile_sql(("eto_ppm", "value * 10")))
def b09(spark, sf):
    df = wide(spark, sf)
    return _profile(df, names.gas_columns(df))


@query("b04_signal_by_header", f"""WITH {S}, {HEAD}, g AS (SELECT CASE
    WHEN name IN ('Date-Time', 'Sample_Time') THEN 'timestamp' WHEN name IN ('Pressure (psi)', 'pressure_kPa') THEN 'pressure'
    WHEN name IN ('%RH', 'Relative Humidity', 'humidity(%)') THEN 'humidity' WHEN name = 'gas_ppm' THEN 'gas'
    WHEN name IN ('Temp_C', 'TEMPERATURE', 'Temp 1', 'Sensor_2', 'temp [°C]', 'Oven_Temp') THEN 'temperature' ELSE 'none' END AS signal
  FROM s JOIN hd ON seq % {N_HEADERS} = i)
SELECT signal, count(*) AS n FROM g GROUP BY signal""")
def b04s(spark, sf):
    return headers(spark, sf).select(F.coalesce(names.signal_of(F.col("name")), F.lit("none")).alias("signal")).groupBy(
        "signal").agg(F.count(F.lit(1)).alias("n"))


@query("b14_legacy_status", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus
  WHEN o_orderkey % 3 = 1 THEN 'D' || o_orderstatus WHEN o_totalprice > 150000 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders""")
def b14(spark, sf):
    k = F.col("o_orderkey") % 3
    legacy = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k == 0, F.col("o_orderstatus")).alias("status"),
        F.when(k <= 1, F.concat(F.lit("D"), "o_orderstatus")).alias("decision"), (F.col("o_totalprice") > 150000).alias("pass"))
    return legacy.select("o_orderkey", scalars.status_of(legacy).alias("status"))


@query("b15_enum_aliases", """WITH m AS (SELECT o_orderkey, ['REFRIGERATION','AMBIENT_CURE','ETO_STERILIZATION','PMT','OVEN_AIR'][o_orderkey % 5 + 1] AS a,
  ['mean','min','majority','min_of_set'][o_orderkey % 4 + 1] AS b FROM orders)
SELECT CASE WHEN a IN ('REFRIGERATION','AMBIENT_CURE','ETO_STERILIZATION') THEN 'OVEN_AIR' ELSE a END AS method,
  CASE b WHEN 'mean' THEN 'mean_of_set' WHEN 'min' THEN 'min_of_set' WHEN 'majority' THEN 'majority_over_threshold' ELSE b END AS mode,
  count(*) AS n FROM m GROUP BY ALL""")
def b15(spark, sf):
    from tempaudit.operators.specs import METHOD_ALIASES, MODE_ALIASES

    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % m + 1).cast("int"))
    a = pick(("REFRIGERATION", "AMBIENT_CURE", "ETO_STERILIZATION", "PMT", "OVEN_AIR"), 5)
    b = pick(("mean", "min", "majority", "min_of_set"), 4)
    return table(spark, sf, "orders").groupBy(
        scalars.one_of(a, METHOD_ALIASES).alias("method"), scalars.one_of(b, MODE_ALIASES).alias("mode")).agg(
        F.count(F.lit(1)).alias("n"))


@query("c01_temperature_units", f"""WITH {S} SELECT seq, round((value - 32) * 5 / 9, 6) AS c, round(value * 9 / 5 + 32, 6) AS f FROM s""")
def c01(spark, sf):
    return samples(spark, sf).select("seq", F.round(units.fahrenheit_to_celsius(F.col("value")), 6).alias("c"),
                                     F.round(units.celsius_to_fahrenheit(F.col("value")), 6).alias("f"))


@query("c02_pressure_units", f"""WITH {S} SELECT seq, round(k * 6.895, 6) AS kpa, round(k / 6.895, 6) AS psi,
  round(k * 100.0, 6) AS kpa_from_bar FROM s""")
def c02(spark, sf):
    k = F.col("k")
    return samples(spark, sf).select("seq", F.round(units.psi_to_kpa(k), 6).alias("kpa"), F.round(units.kpa_to_psi(k), 6).alias("psi"),
                                     F.round(units.bar_to_kpa(k), 6).alias("kpa_from_bar"))


@query("c03_pressure_unit_inference", f"""WITH {S}, p AS (SELECT run_id, CASE run_id % 4 WHEN 0 THEN 0.8 + k / 50 WHEN 1 THEN 10 + k / 4
  WHEN 2 THEN 60 + k ELSE k END AS p FROM s),
u AS (SELECT run_id, CASE WHEN max(p) BETWEEN 0.8 AND 3.0 AND min(p) >= 0.5 THEN 'bar' WHEN max(p) BETWEEN 10 AND 50 AND min(p) >= 5
  THEN 'psi' WHEN max(p) BETWEEN 80 AND 300 AND min(p) >= 50 THEN 'kPa' ELSE 'unknown' END AS unit FROM p GROUP BY run_id)
SELECT run_id, unit AS pressure_unit, round(avg(p * CASE unit WHEN 'bar' THEN 100.0 WHEN 'psi' THEN 6.895 ELSE 1 END), 8) AS mean_kpa
FROM p JOIN u USING (run_id) GROUP BY run_id, unit""")
def c03(spark, sf):
    p = F.expr("CASE run_id % 4 WHEN 0 THEN 0.8 + k / 50 WHEN 1 THEN 10 + k / 4 WHEN 2 THEN 60 + k ELSE k END").cast("double")
    df = units.with_pressure_kpa(samples(spark, sf).withColumn("p", p), "p")
    return df.groupBy("run_id", "pressure_unit").agg(F.round(F.avg("pressure_kpa"), 8).alias("mean_kpa"))


SQL_FAHR = "sensor IN ('click', 'view')"


@query("c04_fahrenheit_columns", f"""WITH {S} SELECT run_id, CASE WHEN {SQL_FAHR} THEN sensor || '_temp_F' ELSE sensor || ' shelf' END AS sensor,
  {SQL_FAHR} AS converted, round(avg(CASE WHEN {SQL_FAHR} THEN (value - 32) * 5 / 9 ELSE value END), 8) AS mean_value FROM s GROUP BY ALL""")
def c04(spark, sf):
    named = F.when(F.col("sensor").isin("click", "view"), F.concat("sensor", F.lit("_temp_F"))).otherwise(F.concat("sensor", F.lit(" shelf")))
    df = units.celsius_samples(samples(spark, sf).withColumn("sensor", named))
    return df.groupBy("run_id", "sensor", "converted").agg(F.round(F.avg("value"), 8).alias("mean_value"))


@query("c04_fahrenheit_by_range", f"""WITH {S}, h AS (SELECT run_id, sensor, count(value) > 5 AND ((avg(value) > 80 AND max(value) > 200)
  OR (min(value) > 32 AND avg(value) > 100 AND max(value) > 300)) AS hot FROM s GROUP BY ALL)
SELECT run_id, sensor, hot AS converted, round(avg(CASE WHEN hot THEN (value - 32) * 5 / 9 ELSE value END), 8) AS mean_value
FROM s JOIN h USING (run_id, sensor) GROUP BY ALL""")
def c04r(spark, sf):
    df = units.celsius_samples(samples(spark, sf), heuristic=True)
    return df.groupBy("run_id", "sensor", "converted").agg(F.round(F.avg("value"), 8).alias("mean_value"))


@query("c05_timestamp_parsing", f"""WITH {S} SELECT seq, CASE run_id % 5 WHEN 4 THEN (us - min(us) OVER (PARTITION BY run_id)) // 1000000 * 1000000 ELSE CASE run_id % 4 WHEN 0 THEN us // 1000000 * 1000000
  WHEN 1 THEN us // 3600000000 * 3600000000 WHEN 2 THEN us // 1000000 * 1000000
  ELSE us // 1000000 * 1000000 + 18000000000 END END AS utc_us FROM s""")
def c05(spark, sf):
    """Epoch seconds, serial days, text with and without offset, and seconds counted from a run's start."""
    t = F.timestamp_micros("us")
    text = (
        F.when(F.col("run_id") % 5 == 4, F.expr("(us - start_us) div 1000000L").cast("string"))
        .when(F.col("run_id") % 4 == 0, F.expr("us div 1000000L").cast("string"))
        .when(F.col("run_id") % 4 == 1, (F.expr("us div 3600000000L") / 24.0 + clock.EXCEL_EPOCH_DAYS).cast("string"))
        .when(F.col("run_id") % 4 == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss")))
    zone = F.when(F.col("run_id") % 4 == 3, "-05:00").otherwise("UTC")
    s = samples(spark, sf)
    starts = s.groupBy("run_id").agg(F.min("us").alias("start_us"))
    texts = s.join(starts, "run_id").select("run_id", "seq", text.alias("text"), zone.alias("zone"))
    formats = clock.detect_format(texts, "text")
    at = texts.join(formats, "run_id").select("seq", F.unix_micros(clock.parse(F.col("text"), F.col("ts_format"), F.col("zone"))).alias("us"))
    # serial days carry about a microsecond of rounding
    return at.select("seq", (F.round(F.col("us") / 1000) * 1000).cast("long").alias("utc_us"))


@query("u01_zone_resolver", f"""WITH {S} SELECT seq, us + CASE run_id % 3 WHEN 0 THEN 18000000000 WHEN 1 THEN -3600000000 ELSE 0 END AS utc_us FROM s""")
def u01(spark, sf):
    # fixed zones without a daylight rule, so that the SQL side needs no zone data
    zones = small_table(spark, [("plant-a", "-05:00"), ("plant-b", "+01:00")], "alias string, zone string")
    zone = F.when(F.col("run_id") % 3 == 0, "Plant-A").when(F.col("run_id") % 3 == 1, "plant-b").otherwise("plant-x")
    df = clock.resolve_zone(samples(spark, sf).withColumn("zone", zone), F.broadcast(zones))
    return df.select("seq", F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("us"), F.col("zone"))).alias("utc_us"))


@query("u02_unit_resolver", f"""WITH {S} SELECT sensor, sensor IN ('error', 'view') AS converted,
  round(avg(CASE WHEN sensor IN ('error', 'view') THEN (value - 32) * 5 / 9 ELSE value END), 8) AS mean_value FROM s GROUP BY ALL""")
def u02(spark, sf):
    table_ = small_table(spark, [("error", "F"), ("view", "fahrenheit"), ("click", "C")], "sensor string, unit string")
    df = units.celsius_samples(samples(spark, sf), units=F.broadcast(table_))
    return df.groupBy("sensor", "converted").agg(F.round(F.avg("value"), 8).alias("mean_value"))


@query("c06_safe_casts", """SELECT o_orderkey, coalesce(TRY_CAST(substr(o_orderpriority, 1, 1 + o_orderkey % 3) AS DOUBLE), -1.0) AS d,
  coalesce(trunc(TRY_CAST(substr(CAST(o_totalprice AS VARCHAR), 1, 7) AS DOUBLE))::BIGINT, -1) AS i FROM orders""")
def c06(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", scalars.safe_double(F.expr("substr(o_orderpriority, 1, cast(1 + o_orderkey % 3 as int))"), -1.0).alias("d"),
        scalars.safe_int(F.expr("substr(cast(o_totalprice as decimal(12,2)), 1, 7)"), -1).alias("i"))


@query("c07_conservative_threshold", f"WITH {S} SELECT run_id, max({THR} + run_id % 4 * 0.5) AS threshold FROM s GROUP BY run_id")
def c07(spark, sf):
    return samples(spark, sf).groupBy("run_id").agg(F.max(scalars.conservative_threshold(
        expr(THR), expr("cast(run_id % 4 as double) * 0.5D"))).alias("threshold"))


# every measurement against its neighbour sensor signal, tolerance given for two runs out of three
@query("c13_tolerance_check", f"""WITH {S}, d AS (SELECT seq, abs(value - k) AS diff, greatest(abs(value), abs(k)) AS m,
  CASE WHEN run_id % 3 > 0 THEN run_id % 3 * 5.0 END AS tol, value, k FROM s)
SELECT seq, round(diff, 6) AS difference, CASE WHEN value = 0 AND k = 0 THEN true WHEN tol IS NOT NULL THEN diff <= tol
  ELSE CASE WHEN m > 0 THEN diff / m ELSE 0 END <= 0.05 END AS within_tolerance,
  CASE WHEN value = 0 AND k = 0 THEN 'exact' WHEN tol IS NOT NULL THEN 'absolute' ELSE 'relative' END AS tolerance_type FROM d""")
def c13(spark, sf):
    tol = F.when(F.col("run_id") % 3 > 0, (F.col("run_id") % 3) * 5.0)
    return samples(spark, sf).select("seq", scalars.tolerance_check(F.col("value"), F.col("k"), tol).alias("c")).select(
        "seq", F.round("c.difference", 6).alias("difference"), "c.within_tolerance", "c.tolerance_type")


@query("c14_reason_text", f"""WITH {S}, a AS (SELECT run_id, count(*) AS n, max(value) > 200 AS hot, min(value) < 1 AS cold FROM s GROUP BY run_id)
SELECT run_id, concat_ws('; ', CASE WHEN hot THEN concat('maximum above 200 in ', n, ' samples') END,
  CASE WHEN cold THEN concat('minimum below 1 in ', n, ' samples') END) AS reasons FROM a""")
def c14(spark, sf):
    a = samples(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    reasons = scalars.join_reasons(F.when(F.col("hi") > 200, F.format_string("maximum above 200 in %d samples", "n")),
                                   F.when(F.col("lo") < 1, F.format_string("minimum below 1 in %d samples", "n")))
    return a.select("run_id", F.concat_ws("; ", reasons).alias("reasons"))


@query("c15_content_hash", """SELECT doc_id, sha256(text) AS digest, substr(sha256(concat('{"lang":"', lang, '"}', text)), 1, 10) AS short_id,
  substr(sha256(upper(source) || ' @example.com'), 1, 16) AS owner FROM documents""")
def c15(spark, sf):
    spec = F.to_json(F.struct("lang"))
    return table(spark, sf, "documents").select(
        "doc_id", scalars.content_hash(F.col("text")).alias("digest"), scalars.short_run_id(spec, F.col("text")).alias("short_id"),
        scalars.email_hash(F.concat(F.upper("source"), F.lit(" @example.com"))).alias("owner"))


def log_lines(spark, sf):
    """Application-log lines derived from the events: JSON, access-log and free-text forms."""
    e = samples(spark, sf)
    t = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ms = F.round(F.col("value") * 100).cast("long")
    status = F.when(F.col("sensor") == "error", 500 + F.col("seq") % 4).otherwise(200)
    line = (
        F.when(F.col("seq") % 4 == 0, F.format_string(
            '{"time": "%s", "level": "INFO", "msg": "Compile done", "duration_ms": %d}', t, ms))
        .when(F.col("seq") % 4 == 1, F.format_string(
            '{"time": "%s", "msg": "request", "method": "GET", "path": "/api/%s", "status": %d}', t, "sensor", status))
        .when(F.col("seq") % 4 == 2, F.format_string('%s "POST /api/%s" %d %d', t, "sensor", status, ms))
        .otherwise(F.format_string("%s bundle verify %s took %d ms", t, F.when(F.col("sensor") == "error", "failed").otherwise("ok"), ms)))
    return e.select("seq", "us", "sensor", scalars.once(line).alias("line"))


SQL_LOG = f"""{S}, lg AS (SELECT seq, us // 1000000 * 1000000 AS us, seq % 4 AS f, sensor, round(value * 100)::BIGINT AS ms,
  CASE WHEN sensor = 'error' THEN 500 + seq % 4 ELSE 200 END AS st, us AS raw_us FROM s)"""


@query("c16_log_fields", f"""WITH {SQL_LOG}
SELECT seq, us AS time_us, CASE WHEN f = 0 OR f = 3 THEN ms / 1000.0 END AS compile_s,
  coalesce(CASE f WHEN 1 THEN 'GET' WHEN 2 THEN 'POST' END, '') AS method, CASE WHEN f IN (1, 2) THEN '/api/' || sensor ELSE '' END AS path,
  (CASE WHEN f IN (1, 2) THEN st ELSE -1 END)::BIGINT AS status, (CASE WHEN f = 3 THEN CASE WHEN sensor = 'error' THEN 1 ELSE 0 END ELSE -1 END)::BIGINT AS verify_error FROM lg""")
def c16(spark, sf):
    df = log_lines(spark, sf).select("*", scalars.once(scalars.log_record(F.col("line"))).alias("rec"))
    line, rec = F.col("line"), F.col("rec")
    req = scalars.request_fields(line, rec)
    return df.select(
        "seq", F.unix_micros(scalars.log_time(line, rec)).alias("time_us"), scalars.compile_seconds(line, rec).alias("compile_s"),
        F.coalesce(req["method"], F.lit("")).alias("method"), F.coalesce(req["path"], F.lit("")).alias("path"),
        F.coalesce(req["status"].cast("long"), F.lit(-1).cast("long")).alias("status"),
        F.coalesce(scalars.verify_event(line, rec).cast("long"), F.lit(-1).cast("long")).alias("verify_error"))


@query("c17_month_keys", """SELECT strftime(o_orderdate, '%Y-%m') AS month_key, strftime(o_orderdate, '%b %Y') AS month_label,
  strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_reset, count(*) AS n FROM orders GROUP BY ALL""")
def c17(spark, sf):
    t = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy(
        clock.month_key(t).alias("month_key"), clock.month_label(t).alias("month_label"),
        F.date_format(clock.next_reset(t), "yyyy-MM-dd").alias("next_reset")).agg(F.count(F.lit(1)).alias("n"))


@query("c18_deviation_severity", f"""WITH {S}, d AS (SELECT seq, greatest(value - 60, 10 - value, 0) AS dev FROM s)
SELECT seq, round(dev, 6) AS deviation, CASE WHEN dev > 10 THEN 'critical' WHEN dev > 5 THEN 'high' WHEN dev > 2 THEN 'medium' ELSE 'low' END
  AS severity FROM d""")
def c18(spark, sf):
    from tempaudit.operators.excursions import deviation, severity

    d = samples(spark, sf).select("seq", deviation(F.col("value"), 10.0, 60.0).alias("dev"))
    return d.select("seq", r("dev", 6, "deviation"), F.coalesce(severity(F.col("dev")), F.lit("low")).alias("severity"))
