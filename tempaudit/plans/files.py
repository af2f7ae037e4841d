"""Readers over real files (A7-A13): each query writes the files its table stands for and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.operators import opslog
from tempaudit.operators import specs as specs_mod
from tempaudit.plans.columns import log_lines
from tempaudit.plans.common import query, table
from tempaudit.plans.comparisons import CORPUS, corpus
from tempaudit.plans.ingest import parts
from tempaudit.plans.operations import SQL_EV, jobs
from tempaudit.session import scratch_path
from tempaudit.sources import corpus as scans

HOLD = "CAST(trunc(abs(s_acctbal) * 10) AS BIGINT) % 200000"


def spread(rows, key: str):
    """Rows dealt to tasks by key before a file is written for each: the files cost the time, not the few bytes in them."""
    return rows.repartition(parts(rows.sparkSession), key)


@query("a07_spec_files", f"""WITH sp AS (SELECT s_suppkey AS k, {HOLD} AS hold FROM supplier)
SELECT k AS no, CASE WHEN k % 17 = 0 THEN 'malformed' ELSE concat_ws(',', CASE WHEN k % 11 = 0 THEN 'version' END, CASE WHEN k % 13 = 0 THEN 'job_id' END,
  CASE WHEN k % 400 <= 0 OR k % 400 > 300 THEN 'target_temp_C' END, CASE WHEN NOT hold BETWEEN 1 AND 172800 THEN 'hold_time_s' END) END AS verdict FROM sp""")
def a07f(spark, sf):
    """A file per specification over several lines; the truncated ones go to the quarantine."""
    k, hold = F.col("s_suppkey"), F.expr(HOLD.replace("trunc(", "floor("))
    text = F.format_string(
        '{"version": "%s", "industry": "powder", "job": {"job_id": "job%s%d"},\n "spec": {"method": "PMT", "target_temp_C": %d, "hold_time_s": %d,\n'
        '  "temp_band_C": {"min": 10, "max": 100}, "sensor_uncertainty_C": 1}, "data_requirements": {"max_sample_period_s": 30, "allowed_gaps_s": 60},\n'
        ' "sensor_selection": {"mode": "mean", "sensors": ["t1", "t2"], "require_at_least": 1}, "logic": {"continuous": true, "max_total_dips_s": 0}}',
        F.when(k % 11 == 0, "2.0").otherwise("1.0"), F.when(k % 13 == 0, " ").otherwise("-"), k, k % 400, hold)
    text = F.when(k % 17 == 0, F.substring(text, 1, 60)).otherwise(text)
    path = scratch_path(spark, "specs")
    spread(table(spark, sf, "supplier").select(text.alias("text"), k.alias("no")), "no").write.partitionBy("no").text(path)
    read = specs_mod.read_specs(spark, path)
    verdict = F.when(F.col("_corrupt").isNotNull(), "malformed").otherwise(F.array_join(specs_mod.rule_violations(), ","))
    return read.select(F.col("no").cast("long").alias("no"), verdict.alias("verdict"))


@query("a08_registry_file", f"""WITH {CORPUS} SELECT industry, expected AS expected_outcome, count(*) AS datasets, max('data/' || k || '.csv') AS last_path FROM c GROUP BY ALL""")
def a08f(spark, sf):
    """The registry file, an entry per line, read by the registry's schema; each entry carries its provenance."""
    entry = F.struct(F.col("k").cast("string").alias("id"), "industry", F.concat(F.lit("data/"), F.col("k"), F.lit(".csv")).alias("csv_path"),
                     F.col("expected").alias("expected_outcome"), F.struct(F.lit("campaign").alias("source")).alias("provenance"))
    path = scratch_path(spark, "registry")
    corpus(spark, sf).select(entry.alias("e")).select("e.*").write.json(path)
    read = scans.read_registry(spark, path).filter(F.col("provenance")["source"] == "campaign")
    return read.groupBy("industry", "expected_outcome").agg(F.count(F.lit(1)).alias("datasets"), F.max("csv_path").alias("last_path"))


@query("a09_decision_files", """SELECT s_suppkey AS job, CASE WHEN s_suppkey % 3 = 0 THEN 'INDETERMINATE' WHEN s_acctbal < 4000 THEN 'PASS' ELSE 'FAIL' END AS status, s_suppkey % 6 = 0 AS fallback_used FROM supplier""")
def a09f(spark, sf):
    """Decisions in nested job directories among other files, found by name whatever their depth."""
    k = F.col("s_suppkey")
    doc = F.when(k % 3 == 0, F.format_string('{\n "job_id": "%d",\n "status": "INDETERMINATE", "flags": {"fallback_used": %s}}', k, (k % 6 == 0).cast("string"))).otherwise(
        F.format_string('{"job_id": "%d", "pass": %s}', k, (F.col("s_acctbal") < 4000).cast("string")))
    path = scratch_path(spark, "store")
    rows = table(spark, sf, "supplier").select(doc.alias("doc"), (k % 4).alias("shelf"), k.alias("no"))
    spread(rows, "no").write.partitionBy("shelf", "no").text(path)
    rows.select(F.lit("time,temp").alias("t"), "shelf").write.mode("append").option("compression", "gzip").partitionBy("shelf").text(path)  # other files
    read = scans.scan_decisions(spark, path, "part-*.txt")
    return read.select(F.col("job_id").cast("long").alias("job"), "status", "fallback_used")


@query("a10_log_files", f"""WITH {SQL_EV} SELECT count(*) AS lines, count(c) AS compiles, round(sum(c), 2)::DOUBLE AS compile_s, count(h) AS requests, count(*) FILTER (WHERE h >= 500) AS errors FROM ev""")
def a10f(spark, sf):
    """Plain and compressed log files of several services, scanned together and parsed."""
    paths = [scratch_path(spark, "log") for _ in range(2)]
    lines = log_lines(spark, sf).select("line", F.col("seq") % 2)
    for i, kind in enumerate(("none", "gzip")):
        lines.filter(F.col(lines.columns[1]) == i).select("line").write.option("compression", kind).text(paths[i])
    events = opslog.parse_lines(scans.scan_log(spark, paths))
    return events.agg(F.count(F.lit(1)).alias("lines"), F.count("compile_s").alias("compiles"), F.round(F.sum("compile_s"), 2).alias("compile_s"),
                      F.count("http_status").alias("requests"), F.count_if(F.col("http_status") >= 500).alias("errors"))


@query("a11_jsonl_files", """SELECT o_orderkey AS job_id, o_custkey AS user_id, o_orderkey % 3 AS stage FROM orders WHERE o_orderkey % 10 > 0""")
def a11f(spark, sf):
    """A queue file with truncated lines, which the source drops."""
    good = F.format_string('{"job_id": %d, "user_id": %d, "stage": %d}', "job_id", "user_id", F.col("job_id") % 3)
    path = scratch_path(spark, "queue")
    jobs(spark, sf).select(F.when(F.col("job_id") % 10 == 0, F.concat(F.lit('{"job_id": '), "job_id")).otherwise(good)).write.text(path)
    return scans.scan_jsonl(spark, path, "job_id long, user_id long, stage long")


@query("a12_artifact_files", """SELECT printf('%02x', s_suppkey % 4) AS shelf, 'job=' || s_suppkey AS job_id, length(s_name) + 1 AS size_bytes FROM supplier WHERE s_suppkey % 3 > 0""")
def a12f(spark, sf):
    """Artifacts in job directories, listed with their sizes; files elsewhere are left out and no content is read."""
    k = F.col("s_suppkey")
    path = scratch_path(spark, "artifacts")
    rows = table(spark, sf, "supplier").select("s_name", F.when(k % 3 > 0, F.lower(F.lpad(F.hex(k % 4), 2, "0"))).otherwise("misc").alias("shelf"), k.alias("job"))
    for shelf in ("00", "01", "02", "03", "misc"):
        spread(rows.filter(F.col("shelf") == shelf).drop("shelf"), "job").write.partitionBy("job").text(f"{path}/{shelf}")
    listed = scans.list_artifacts(spark, path)
    return listed.select(F.regexp_extract("path", r"/([0-9a-f]{2})/job=", 1).alias("shelf"), "job_id", "size_bytes")


@query("a13_table_files", """SELECT c_mktsegment AS plan, count(*) AS jobs, count(DISTINCT o_custkey) AS users FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a13f(spark, sf):
    """Exported tables with columns in another order and more of them, read by their fixed schemas."""
    u, j = scratch_path(spark, "users"), scratch_path(spark, "jobs")
    table(spark, sf, "customer").select(F.lit("x").alias("note"), F.col("c_mktsegment").alias("plan"), F.col("c_custkey").cast("string").alias("user_id"),
                                        F.concat("c_custkey", F.lit("@x")).alias("email"), F.timestamp_seconds(F.lit(0)).alias("created_at")).write.parquet(u)
    jobs(spark, sf).select(F.lit("DONE").alias("status"), F.col("user_id").cast("string").alias("user_id"), F.col("job_id").cast("string").alias("job_id"),
                           F.timestamp_micros("us").alias("created_at")).write.parquet(j)
    per_user = scans.scan_table(spark, "jobs", j).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(scans.scan_table(spark, "users", u), "user_id").groupBy("plan").agg(F.sum("n").alias("jobs"), F.count(F.lit(1)).alias("users"))
