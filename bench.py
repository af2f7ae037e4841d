"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 1).
BENCH_COPIES > 1 repeats the sensor runs under new run ids, to show how the times grow.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tempaudit.plans import common, load_all  # noqa: E402
from tempaudit.session import build_session  # noqa: E402

HEADLINE = (
    "a01_text_log_readings", "v00_normalize_report", "v01_default_hold_verdict", "v02_powder_verdict", "v03_cooling_verdict",
    "v04_autoclave_verdict", "v05_sterile_verdict", "v06_concrete_verdict", "v07_coldchain_verdict", "v12_shadow_comparison",
    "d06_longest_latched_hold", "d09_budgeted_hold", "d13_closed_excursions", "d21_rolling_uniformity", "d22_resample",
    "d27_signup_rules", "g04_daily_compliance", "g11_window_compliance", "g25_confusion_2x2", "g30_compile_p95",
    "g36_quota_status", "g39_daily_campaigns", "j10_manifest_check", "s02_recent_jobs",
)


def replicate(copies: int) -> None:
    """Make every query read ``copies`` sets of runs."""
    single = common.samples

    def many(spark, sf):
        base = single(spark, sf)
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c")
        return base.select("*", copy).withColumn("run_id", F.col("run_id") + F.col("c") * 10_000_000).drop("c")

    for module in list(sys.modules.values()):
        if getattr(module, "__name__", "").startswith("tempaudit.plans") and hasattr(module, "samples"):
            module.samples = many


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, copies = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_COPIES", "1"))
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    if copies > 1:
        replicate(copies)
    samples = common.samples(spark, sf_dir) if copies == 1 else common.timeline.__globals__["samples"](spark, sf_dir)
    rows, runs = samples.count(), samples.select("run_id").distinct().count()  # also warms the session up
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(repeat):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    verdict = times["v01_default_hold_verdict"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": float(re.sub(r"^.*sf", "", sf_dir.rstrip("/")) or 0), "sample_rows": rows, "copies": copies,
        "runs": runs, "verdict_rows_per_s": round(rows / verdict), "verdict_ms_per_run": round(verdict * 1000 / runs, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
