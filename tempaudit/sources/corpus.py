"""Corpus scans: registry, decisions, log and queue files, listings, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempaudit.functions.scalars import status_of
from tempaudit.session import few_listing_tasks

REGISTRY_SCHEMA = ("dataset_key string, id string, industry string, csv_path string, spec_path string, expected_outcome string, "
                   "provenance map<string,string>, metadata map<string,string>")
DECISION_SCHEMA = ("`pass` boolean, status string, decision string, industry string, job_id string, target_temp_C double, "
                   "conservative_threshold_C double, actual_hold_time_s double, required_hold_time_s long, max_temp_C double, "
                   "min_temp_C double, reasons array<string>, warnings array<string>, flags map<string,boolean>")

# fixed values: the relational tables' columns
TABLES = {
    "users": "user_id string, email string, plan string, created_at timestamp",
    "plans": "plan string, quota long, price double, overage_price double",
    "subscriptions": "subscription_id string, user_id string, plan string, active boolean, created_at timestamp",
    "jobs": "job_id string, user_id string, status string, created_at timestamp",
    "quota_counters": "user_id string, month string, used long",
    "audit_logs": "id string, user_id string, action string, details string, created_at timestamp",
}


def registry(spark: SparkSession, entries) -> DataFrame:
    """Dataset registry from a list of dicts (the parsed registry file, a small dimension)."""
    rows = [tuple(e.get(k) for k in ("dataset_key", "id", "industry", "csv_path", "spec_path", "expected_outcome", "provenance", "metadata")) for e in entries]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def read_registry(spark: SparkSession, path) -> DataFrame:
    """A registry kept as JSON lines, for registries too large for the driver."""
    return spark.read.schema(REGISTRY_SCHEMA).json(path)


def scan_decisions(spark: SparkSession, root: str, name="decision.json") -> DataFrame:
    """Every file of that name (or pattern) below a root, status filled from older fields."""
    reader = spark.read.schema(DECISION_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    with few_listing_tasks(spark):
        raw = reader.json(root)
    return with_status(raw.withColumn("path", F.col("_metadata.file_path")))


def with_status(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"status": status_of(raw), "fallback_used": F.coalesce(F.col("flags")["fallback_used"], F.lit(False))})


def scan_log(spark: SparkSession, paths) -> DataFrame:
    """Application-log lines of one or many sources."""
    return spark.read.text(paths).select(F.col("value").alias("line"))


def union_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def scan_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_jsonl(lines: DataFrame, schema: str, line="line") -> DataFrame:
    """The same over lines already in a table."""
    parsed = F.from_json(F.col(line), schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return lines.select(parsed.alias("j")).filter("j is not null and j._corrupt is null").select("j.*").drop("_corrupt")


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of all files below a root; contents are not read."""
    with few_listing_tasks(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return job_artifacts(files.select("path", F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("created_us")))


def job_artifacts(listing: DataFrame) -> DataFrame:
    """Only files in job directories below a two-digit hex directory."""
    pattern = r"/([0-9a-fA-F]{2})/([^/]+)/[^/]+$"
    return listing.filter(F.col("path").rlike(pattern)).withColumn("job_id", F.regexp_extract("path", pattern, 2))


def scan_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A relational table exported as parquet, with its fixed schema."""
    return spark.read.schema(TABLES[name]).parquet(path)


def fixture_pairs(listing: DataFrame) -> DataFrame:
    """Pair ``<industry>/<case>.csv`` with ``<case>.json`` and expect the result its case name states."""
    pattern = r"([^/]+)/([^/]+)\.(csv|json)$"
    part = lambda i: F.regexp_extract("path", pattern, i)
    files = listing.filter(F.col("path").rlike(pattern)).select("path", part(1).alias("industry"), part(2).alias("case"), part(3).alias("kind"))
    logs = files.filter("kind = 'csv'").select("industry", "case", F.col("path").alias("csv_path"))
    specs = files.filter("kind = 'json'").select("industry", "case", F.col("path").alias("spec_path"))
    stem = F.col("case")
    expected = (
        F.when(stem.rlike("^(pass|borderline)"), "PASS").when(stem.rlike("^fail"), "FAIL")
        .when(stem.rlike("^missing_required"), "INDETERMINATE").when(stem.rlike("^(gap|dup_ts)"), "ERROR").otherwise("UNKNOWN"))
    return logs.join(specs, ["industry", "case"]).withColumn("expected", expected)
