"""Operational metrics from application logs and artifact listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.functions.scalars import compile_seconds, log_record, log_time, once, request_fields, verify_event
from tempaudit.operators.stats import nth_of_counts, order_statistic, value_counts


def parse_lines(lines: DataFrame, line="line", since: Column | None = None) -> DataFrame:
    """Log lines to typed events; lines before ``since`` or without a time are left out when it is given."""
    rec = lines.select("*", once(log_record(F.col(line))).alias("_r"))
    text, r = F.col(line), F.col("_r")
    req = request_fields(text, r)
    out = rec.withColumns({
        "log_ts": log_time(text, r), "compile_s": compile_seconds(text, r), "method": req["method"], "path": req["path"],
        "http_status": req["status"], "verify_error": verify_event(text, r)}).drop("_r")
    return out if since is None else out.filter(F.col("log_ts") >= since)


def one_row(*figures: DataFrame) -> DataFrame:
    """Several one-row tables side by side: stacked, then folded column by column."""
    stacked = figures[0]
    for other in figures[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def p95(df: DataFrame, value: str, name="p95") -> DataFrame:
    """Element floor(0.95 n) of the sorted values, exact."""
    return order_statistic(df, value, F.floor(F.col("_n") * 0.95), name)


def compile_metrics(events: DataFrame, limit_s=5.0) -> DataFrame:
    counts = value_counts(events, "compile_s")
    n = F.coalesce(F.sum("_c"), F.lit(0).cast("long"))
    base = counts.agg(F.coalesce(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c"), F.lit(0.0)).alias("avg_s"), n.alias("compiles"))
    joined = one_row(base, nth_of_counts(counts, F.floor(F.col("_n") * 0.95), "p95_s"))
    v = F.coalesce("p95_s", F.lit(0.0))
    return joined.select(F.round(v, 2).alias("p95_s"), F.round("avg_s", 2).alias("avg_s"), "compiles", (v > limit_s).alias("slow"))


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)) * 100, F.lit(0.0))


def _requests(during: Column) -> list[Column]:
    status = F.when(during, F.col("http_status"))
    return [F.count(status).alias("requests"), F.count_if(status >= 500).alias("errors")]


def _verifications() -> list[Column]:
    return [F.count("verify_error").alias("verifications"), F.count_if("verify_error").alias("verify_errors")]


def _breach(part: str, whole: str, pct: str, flag: str, limit: float) -> list[Column]:
    share = rate(F.col(part), F.col(whole))
    return [F.col(whole), F.col(part), F.round(share, 2).alias(pct), (share > limit).alias(flag)]


def error_metrics(events: DataFrame, limit_pct=1.0) -> DataFrame:
    return events.agg(*_requests(F.lit(True))).select(*_breach("errors", "requests", "error_pct", "erring", limit_pct))


def verify_metrics(events: DataFrame, limit_pct=0.5) -> DataFrame:
    return events.agg(*_verifications()).select(
        *_breach("verify_errors", "verifications", "verify_error_pct", "verify_failing", limit_pct))


def health_summary(events: DataFrame, now: Column, short="interval 5 minutes", long="interval 10 minutes") -> DataFrame:
    """Compile, request and verification figures of the trailing windows with one overall flag."""
    recent = events.filter(F.col("log_ts") >= now - F.expr(long))
    counted = recent.agg(*_requests(F.col("log_ts") >= now - F.expr(short)), *_verifications()).select(
        *_breach("errors", "requests", "error_pct", "erring", 1.0),
        *_breach("verify_errors", "verifications", "verify_error_pct", "verify_failing", 0.5))
    joined = one_row(compile_metrics(recent), counted)
    return joined.withColumn("healthy", ~F.col("slow") & ~F.col("erring") & ~F.col("verify_failing"))


def daily_artifacts(files: DataFrame) -> DataFrame:
    """Uploads, verdicts and sizes per day from a listing (path, size, day, status)."""
    ends = lambda x: F.col("path").endswith(x)
    mb = lambda x: F.round(F.coalesce(F.sum(F.when(ends(x), F.col("size_bytes"))), F.lit(0)) / 1048576, 2)
    return files.groupBy("day").agg(
        F.count_if(ends(".csv")).alias("uploads"), F.count_if(ends("decision.json") & (F.col("status") == "PASS")).alias("passes"),
        F.count_if(ends("decision.json") & (F.col("status") == "FAIL")).alias("fails"), mb(".pdf").alias("pdf_mb"), mb(".zip").alias("zip_mb"),
        F.count(F.lit(1)).alias("files"))


def daily_log_metrics(lines: DataFrame, day: Column, line="line") -> DataFrame:
    """Requests, errors and ends of compilations per day, by the words of the service's log lines."""
    text, low = F.col(line), F.lower(F.col(line))
    succeeded = low.contains("compilation success")
    return lines.groupBy(day.alias("day")).agg(
        F.count_if(text.contains('"POST /') | text.contains('"GET /')).alias("requests"), F.count_if(low.contains("error")).alias("errors"),
        F.count_if(succeeded).alias("compile_successes"),
        F.count_if(~succeeded & low.contains("compilation fail")).alias("compile_failures"))
