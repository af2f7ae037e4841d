"""Source, sink and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempaudit.operators import compare, curves
from tempaudit.plans.columns import log_lines
from tempaudit.plans.common import HYST, S, THR, expr, query, samples, sql_islands, sql_latch, table, timeline
from tempaudit.plans.comparisons import CORPUS, corpus
from tempaudit.plans.ordered import STEP_US
from tempaudit.session import ensure_checkpointing, scratch_path
from tempaudit.sources import corpus as scans
from tempaudit.sources import sinks, textlog

# one text log per run: comment lines, a header, then a line per event; the delimiter goes by run
DELIM = "CASE run_id % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN '\t' ELSE '|' END"


def parts(spark) -> int:
    """Tasks that make the logs, however few bytes they are."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def log_files(spark, sf):
    """Every run as a log of three leading lines, a header and a line per sample, made from one scan."""
    s = samples(spark, sf).select("run_id", "us", "seq", "value", "k").repartition("run_id").withColumn("first", F.min("seq").over(Window.partitionBy("run_id")))
    d = F.expr(DELIM)
    place = lambda n: F.struct(F.lit(0).cast("long").alias("block"), n.cast("long").alias("n"))
    iso = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = F.when(F.col("run_id") % 4 == 0, F.replace(F.col("value").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))).otherwise(
        F.col("value").cast("decimal(12,2)").cast("string"))
    number = F.when(F.col("seq") % 101 == 0, "").when(F.col("seq") % 103 == 0, "n/a").otherwise(number)
    row = F.concat(iso, d, number, d, F.col("k").cast("int").cast("string"))
    head = (F.concat(F.lit("# job: J"), "run_id"), F.concat(F.lit("# operator: op"), F.col("run_id") % 3), F.lit(""),
            F.concat(F.lit("timestamp"), d, F.lit("temp_C"), d, F.lit("pressure_psi")))
    line = lambda text, n: F.struct(place(n).alias("place"), text.alias("line"))
    top = F.when(F.col("seq") == F.col("first"), F.array(*[line(x, F.lit(i - 10)) for i, x in enumerate(head)]))
    every = F.concat(F.coalesce(top, F.array().cast("array<struct<place:struct<block:bigint,n:bigint>,line:string>>")), F.array(line(row, F.col("seq"))))
    return s.select(F.col("run_id").cast("string").alias("file"), F.explode(every).alias("l")).select("file", "l.*")


def written_logs(spark, sf):
    """The logs as real text files, one per run, read back by the line scan; ``run`` is the file's run."""
    path = scratch_path(spark, "logs")
    lines = log_files(spark, sf)
    lines.repartition(parts(spark), "file").sortWithinPartitions("file", "place").select("line", F.col("file").alias("run")).write.partitionBy("run").text(path)
    return textlog.scan_lines(spark, f"{path}/*")


def run_of(file):
    return F.regexp_extract(file, r"/run=(\d+)/", 1)


@query("a01_text_log_readings", f"""WITH {S}, c AS (SELECT run_id, seq, us // 1000000 * 1000000 AS us, unnest(['temp_C', 'pressure_psi']) AS sensor, unnest([
  CASE WHEN seq % 101 = 0 OR seq % 103 = 0 THEN NULL ELSE value END, k]) AS value FROM s)
SELECT run_id::VARCHAR AS run_id, seq, us, sensor, coalesce(value, -1) AS value FROM c""")
def a01(spark, sf):
    got = textlog.samples_of(textlog.readings(log_files(spark, sf)))
    return got.select("run_id", F.col("seq.n").alias("seq"), "us", "sensor", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("a02_log_metadata", f"""WITH {S} SELECT DISTINCT run_id::VARCHAR AS file, 'J' || run_id AS job, 'op' || (run_id % 3) AS operator FROM s""")
def a02(spark, sf):
    """From real files."""
    return textlog.metadata(written_logs(spark, sf)).select(run_of(F.col("file")).alias("file"), F.col("metadata")["job"].alias("job"), F.col("metadata")["operator"].alias("operator"))


@query("a03_encoding_probe", """SELECT doc_id, ['utf-8','utf-8-sig','utf-16-le','utf-16-be','utf-32-le','utf-32-be'][doc_id % 6 + 1] AS encoding, length(text) AS n FROM documents""")
def a03(spark, sf):
    k = F.col("doc_id") % 6
    text = F.col("text")

    def utf_32(big):
        digits = F.transform(F.split(text, ""), lambda c: F.lpad(F.hex(F.ascii(c)), 8, "0"))
        return F.unhex(F.array_join(digits if big else F.transform(digits, lambda h: F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])), ""))

    content = (
        F.when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE")))
        .when(k == 3, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(k == 4, F.concat(F.unhex(F.lit("FFFE0000")), utf_32(False)))
        .when(k == 5, F.concat(F.unhex(F.lit("0000FEFF")), utf_32(True))).otherwise(F.encode(text, "UTF-8")))
    raw = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return raw.select("doc_id", textlog.encoding_of(F.col("content")).alias("encoding"), F.length(textlog.decode_content(F.col("content"))).cast("long").alias("n"))


@query("a04_delimiter_detection", f"""WITH {S} SELECT DISTINCT run_id::VARCHAR AS file, CASE run_id % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter FROM s""")
def a04(spark, sf):
    """From real files."""
    return textlog.delimiters(written_logs(spark, sf)).withColumn("file", run_of(F.col("file")))


@query("a05_decimal_commas", """WITH t AS (SELECT o_orderkey AS k, o_totalprice AS p, CAST(floor(o_totalprice) AS BIGINT) AS w, CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS c FROM orders),
x AS (SELECT k, w, lpad(c::VARCHAR, 2, '0') AS c, lpad((w % 1000)::VARCHAR, 3, '0') AS low, w // 1000 AS high FROM t)
SELECT k, CASE k % 5 WHEN 0 THEN high || low || '.' || c WHEN 1 THEN w || '.' || c WHEN 2 THEN '# ' || high || '.' || low || ',' || c
  WHEN 3 THEN 'no digits here' ELSE 'a,b,c,' || w || ',' || c END AS line FROM x""")
def a05(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").alias("w"), F.lpad((cents % 100).cast("string"), 2, "0").alias("c"))
    high, low = F.expr("cast(w div 1000 as string)"), F.lpad((F.col("w") % 1000).cast("string"), 3, "0")
    k = F.col("k") % 5
    line = (
        F.when(k == 0, F.concat(high, F.lit("."), low, F.lit(","), "c")).when(k == 1, F.concat("w", F.lit(","), "c"))
        .when(k == 2, F.concat(F.lit("# "), high, F.lit("."), low, F.lit(","), "c")).when(k == 3, F.lit("no digits here"))
        .otherwise(F.concat(F.lit("a,b,c,"), "w", F.lit(","), "c")))
    return t.select("k", textlog.normalize_decimals(line).alias("line"))


@query("a06_parse_warnings", f"""WITH {S}, a AS (SELECT run_id, bool_or(seq % 7 = 0) AND run_id % 3 = 0 AS wide,
  run_id % 4 = 1 OR run_id % 4 = 0 AND bool_or(seq % 101 <> 0 AND seq % 103 <> 0) AS commas FROM s GROUP BY run_id)
SELECT run_id::VARCHAR AS file, concat_ws(',', CASE WHEN wide THEN 'delimiter_fallback' END, CASE WHEN wide AND commas THEN 'parse_failure' END) AS warnings,
  CASE WHEN wide AND commas THEN 'ERROR' WHEN wide THEN 'INDETERMINATE' ELSE 'OK' END AS status FROM a""")
def a06(spark, sf):
    """A third of the runs have lines with a cell too many; commas help where no cell holds a decimal comma."""
    run = F.col("file").cast("long")
    extra = (run % 3 == 0) & (F.col("place.n") >= 0) & (F.col("place.n") % 7 == 0)
    lines = log_files(spark, sf).withColumn("line", F.when(extra, F.concat("line", F.expr(DELIM.replace("run_id", "cast(file as long)")), F.lit("x"))).otherwise(F.col("line")))
    return textlog.parse_status(lines, safe_mode=True).select("file", F.array_join("warnings", ",").alias("warnings"), "status")


@query("a08_dataset_registry", f"""WITH {CORPUS} SELECT industry, count(*) AS datasets, count(*) FILTER (WHERE expected = 'PASS') AS expected_pass FROM c GROUP BY industry""")
def a08(spark, sf):
    entries = corpus(spark, sf).select(
        F.col("k").cast("string").alias("id"), "industry", F.concat(F.lit("data/"), F.col("k"), F.lit(".csv")).alias("csv_path"), F.col("expected").alias("expected_outcome"))
    return entries.groupBy("industry").agg(F.count(F.lit(1)).alias("datasets"), F.count_if(F.col("expected_outcome") == "PASS").alias("expected_pass"))


@query("a09_decision_corpus", f"""WITH {CORPUS} SELECT k::VARCHAR AS job_id, CASE WHEN k % 3 = 0 THEN actual WHEN t < 250000 THEN 'PASS' ELSE 'FAIL' END AS status, k % 6 = 0 AS fallback_used FROM c""")
def a09(spark, sf):
    # a third of the documents state a status, the others only the pass flag
    doc = F.when(F.col("k") % 3 == 0, F.format_string('{"job_id":"%d","status":"%s","flags":{"fallback_used":%s}}', "k", "actual", (F.col("k") % 6 == 0).cast("string"))).otherwise(
        F.format_string('{"job_id":"%d","pass":%s}', "k", (F.col("t") < 250000).cast("string")))
    raw = corpus(spark, sf).select(F.from_json(doc, scans.DECISION_SCHEMA).alias("j")).select("j.*")
    return scans.with_status(raw).select("job_id", "status", "fallback_used")


@query("a19_fixture_pairs", """WITH p AS (SELECT doc_id // 10 AS g, source AS industry, ['pass','fail','gap','borderline','missing_required'][doc_id // 10 % 5 + 1] || '_' || (doc_id // 10) AS cs,
  doc_id % 10 AS i FROM documents)
SELECT a.industry || '/' || a.cs AS fixture, CASE WHEN a.cs LIKE 'pass%' OR a.cs LIKE 'borderline%' THEN 'PASS' WHEN a.cs LIKE 'fail%' THEN 'FAIL' WHEN a.cs LIKE 'gap%' THEN 'ERROR' ELSE 'INDETERMINATE' END AS expected
FROM p a JOIN p b ON a.g = b.g AND a.industry = b.industry AND a.i = 0 AND b.i = 1""".replace("source AS industry", "'ind' || (doc_id // 10 % 4 + CASE WHEN doc_id % 70 = 1 THEN 9 ELSE 0 END) AS industry"))
def a19(spark, sf):
    g = F.expr("doc_id div 10")
    case = F.concat(F.element_at(F.array(*map(F.lit, ("pass", "fail", "gap", "borderline", "missing_required"))), (g % 5 + 1).cast("int")), F.lit("_"), g)
    industry = F.concat(F.lit("ind"), (g % 4 + F.when(F.col("doc_id") % 70 == 1, 9).otherwise(0)).cast("string"))
    # the first two documents of ten are a pair, the others are files that make no fixture
    ending = F.when(F.col("doc_id") % 10 == 0, ".csv").when(F.col("doc_id") % 10 == 1, ".json").otherwise(F.concat(F.lit(".part"), F.col("doc_id") % 10))
    listing = table(spark, sf, "documents").select(F.concat(F.lit("/fixtures/"), industry, F.lit("/"), case, ending).alias("path"))
    return scans.fixture_pairs(listing).select(F.concat_ws("/", "industry", "case").alias("fixture"), "expected")


# -- sinks: written to the shared folder and read back -----------------------------------------------


@query("a14_samples_sink", f"WITH {S} SELECT run_id, seq, value, CASE WHEN run_id % 2 = 0 THEN 'powder' ELSE 'haccp' END AS industry FROM s")
def a14(spark, sf):
    path = scratch_path(spark, "samples")
    df = samples(spark, sf).select("run_id", "seq", "value", F.when(F.col("run_id") % 2 == 0, "powder").otherwise("haccp").alias("industry"))
    sinks.write_samples(df, path, files_per_value=4)
    return spark.read.schema(df.schema).parquet(path)


@query("a15_decision_sink", f"WITH {CORPUS} SELECT k, industry, actual AS status FROM c")
def a15(spark, sf):
    path = scratch_path(spark, "decisions")
    df = corpus(spark, sf).select("k", "industry", F.col("actual").alias("status"))
    sinks.write_decisions(df, path)
    return spark.read.schema(df.schema).json(path)


@query("a16_daily_metrics_sink", f"WITH {S} SELECT strftime(make_timestamp(us), '%Y-%m-%d') AS day, count(*) AS samples FROM s GROUP BY 1")
def a16(spark, sf):
    path = scratch_path(spark, "daily")
    day = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd").alias("day")
    df = samples(spark, sf).groupBy(day).agg(F.count(F.lit(1)).alias("samples"))
    half = F.lit("2024-01-15")
    sinks.append_daily(df.filter(F.col("day") < half), path)
    sinks.append_daily(df.filter(F.col("day") >= half), path)
    return spark.read.schema(df.schema).option("header", True).csv(path)


@query("a17_campaign_export", f"""WITH {CORPUS}, m AS (SELECT industry, count(*) FILTER (WHERE expected = 'PASS' AND actual = 'PASS') AS tp, count(*) FILTER (WHERE expected <> 'PASS' AND actual = 'PASS') AS fp,
  count(*) FILTER (WHERE expected <> 'PASS' AND actual <> 'PASS') AS tn, count(*) FILTER (WHERE expected = 'PASS' AND actual <> 'PASS') AS fn FROM c GROUP BY industry)
SELECT 'matrix' AS kind, '{{"industry":"' || industry || '","confusion_matrix":{{"tp":' || tp || ',"fp":' || fp || ',"tn":' || tn || ',"fn":' || fn || '}}}}' AS value FROM m
UNION ALL SELECT 'disagreement', '{{"k":' || k || ',"expected":"' || expected || '","actual":"' || actual || '"}}' FROM c WHERE expected <> actual""")
def a17(spark, sf):
    c = corpus(spark, sf)
    export = sinks.campaign_export(compare.confusion_2x2(c, "industry"), c.filter("mismatch").select("k", "expected", "actual"))
    path = scratch_path(spark, "campaign")
    sinks.write_campaign(export, path)
    return spark.read.schema("value string, kind string").text(path)


@query("a18_metrics_exposition", f"""WITH {S} SELECT 'tempaudit_' || m || '{{sensor="' || sensor || '"}} ' || CASE m WHEN 'samples' THEN n ELSE runs END || '.0 1704067200000' AS value
FROM (SELECT sensor, count(*) AS n, count(DISTINCT run_id) AS runs FROM s GROUP BY sensor) CROSS JOIN (VALUES ('samples'), ('runs')) AS t(m)""")
def a18(spark, sf):
    df = samples(spark, sf).groupBy("sensor").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("run_id").alias("runs"))
    return sinks.exposition(df, ["samples", "runs"], ["sensor"], F.lit(1704067200000))


@query("a18_metrics_json", f"""WITH {S} SELECT '{{"sensor":"' || sensor || '","samples":' || count(*) || '}}' AS value FROM s GROUP BY sensor""")
def a18j(spark, sf):
    return sinks.exposition_json(samples(spark, sf).groupBy("sensor").agg(F.count(F.lit(1)).alias("samples")), ["samples"], ["sensor"])


@query("j04_grid_join", f"""WITH {S}, b AS (SELECT run_id, us - us % {STEP_US} AS bucket_us, avg(value) AS m FROM s GROUP BY ALL),
g AS (SELECT run_id, unnest(generate_series(min(bucket_us), max(bucket_us), {STEP_US})) AS bucket_us FROM b GROUP BY run_id)
SELECT g.run_id, g.bucket_us, round(coalesce(m, -1), 8) AS mean_value FROM g LEFT JOIN b ON g.run_id = b.run_id AND g.bucket_us = b.bucket_us""")
def j04(spark, sf):
    cells = curves.grid(timeline(spark, sf), 21_600)
    return cells.select("run_id", "bucket_us", F.round(F.coalesce("mean_value", F.lit(-1.0)), 8).alias("mean_value"))


@query("s09_union_of_logs", f"WITH {S} SELECT sensor, count(*) AS lines FROM s GROUP BY sensor")
def s09(spark, sf):
    lines = log_lines(spark, sf)
    parts = [lines.filter(F.col("seq") % 3 == i) for i in range(3)]
    return scans.union_logs(*parts).groupBy("sensor").agg(F.count("line").alias("lines"))


# -- streams, run to completion over the given table -------------------------------------------------


def event_stream(spark, sf):
    batch = table(spark, sf, "events")
    return spark.readStream.schema(batch.schema).parquet(f"{sf.rstrip('/')}/events.parquet*").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "value",
        F.col("event_type").alias("sensor"))


def drain(stream, spark, label: str, mode: str, schema: str):
    """Run a stream over what is there and return the table it wrote."""
    ensure_checkpointing(spark)
    path, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    if mode == "append":
        sink = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        def keep(df, epoch):
            df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(path)

        sink, schema = stream.writeStream.foreachBatch(keep).outputMode(mode), schema + ", epoch long"
    run = sink.option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query("t01_live_alert_windows", f"""WITH {S}, e AS (SELECT us, 'compile' AS figure, value / 10 AS c, value / 10 > 5 AS b, 6 AS h FROM s
  UNION ALL SELECT us, 'requests', NULL, sensor = 'error' AND value > 150, 3 FROM s WHERE sensor <> 'view'
  UNION ALL SELECT us, 'verify', NULL, value > 100, 4 FROM s WHERE sensor = 'view'),
w AS (SELECT e.*, unnest(generate_series(us // 3600000000 - h + 1, us // 3600000000)) * 3600000000 AS start_us FROM e),
g AS (SELECT figure, start_us, start_us + any_value(h) * 3600000000 AS end_us, count(*) AS seen, count(*) FILTER (WHERE b) AS bad, quantile_disc(c, 0.95) AS p95 FROM w GROUP BY figure, start_us)
SELECT figure, start_us, end_us, seen, bad, round(coalesce(p95, -1), 6) AS p95_s, CASE figure WHEN 'compile' THEN p95 > 5 WHEN 'requests' THEN bad / seen * 100 > 1 ELSE bad / seen * 100 > 0.5 END AS alert
FROM g WHERE end_us <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM s)""")
def t01(spark, sf):
    from tempaudit.streaming.live import ALERT_SCHEMA, alert_windows

    e = event_stream(spark, sf).select(
        "ts", (F.col("value") / 10).alias("compile_s"), F.when(F.col("sensor") != "view", F.when((F.col("sensor") == "error") & (F.col("value") > 150), 500).otherwise(200)).alias("http_status"),
        F.when(F.col("sensor") == "view", F.col("value") > 100).alias("verify_error"))
    w = alert_windows(e, ("6 hours", "3 hours", "4 hours"), "1 hour", "1 hour")
    return drain(w, spark, "alerts", "append", ALERT_SCHEMA).withColumn("p95_s", F.round(F.coalesce("p95_s", F.lit(-1.0)), 6))


@query("t02_live_hold_tracker", f"""WITH {S}, {sql_islands(sql_latch())} SELECT s.run_id, round(coalesce(max(duration_s) FILTER (WHERE state), 0), 6)::DOUBLE AS longest_s,
  (SELECT max(us) FROM s z WHERE z.run_id = s.run_id) AS last_us FROM isl s GROUP BY s.run_id""")
def t02(spark, sf):
    from tempaudit.streaming.live import TRACK_SCHEMA, track_holds

    e = event_stream(spark, sf).select(
        "run_id", "ts", F.unix_micros("ts").alias("us"), "seq", "value", expr(THR).alias("on_level"), (expr(THR) - expr(HYST)).alias("off_level"))
    out = drain(track_holds(e), spark, "holds", "update", TRACK_SCHEMA)
    # the latest row of each run is its state after all batches
    return out.groupBy("run_id").agg(F.round(F.max("longest_s"), 6).alias("longest_s"), F.max("last_us").alias("last_us"))
