"""Streams over several micro-batches."""

import random

from pyspark.sql import functions as F

from tempaudit.operators import holds
from tempaudit.operators.timeline import Timeline
from tempaudit.plans.ingest import drain
from tempaudit.streaming.live import ALERT_SCHEMA, TRACK_SCHEMA, alert_windows, track_holds


def test_hold_tracker_matches_batch(spark, series, tmp_path):
    rng = random.Random(4)
    runs = {r: [(60.0 * i, rng.uniform(0, 20)) for i in range(80)] for r in range(3)}
    df = series(runs)
    path = str(tmp_path / "in")
    for part in range(4):  # in time order, four files, one per micro-batch
        df.filter(F.col("us").between(part * 1_200_000_000, (part + 1) * 1_200_000_000 - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumns({
        "ts": F.timestamp_micros("us"), "on_level": F.lit(12.0), "off_level": F.lit(8.0)})
    out = drain(track_holds(stream), spark, "t", "update", TRACK_SCHEMA).collect()
    assert len({r["epoch"] for r in out}) == 4 and all(r["late_rows"] == 0 for r in out)
    best = {k: max(r["longest_s"] for r in out if r["run_id"] == k) for k in runs}
    batch = {r["run_id"]: r["hold_s"] for r in holds.latched_hold(Timeline.open(df), 12.0, 4.0).collect()}
    assert best == batch


def test_late_rows_are_counted_not_applied(spark, series, tmp_path):
    path = str(tmp_path / "in")
    first, second = series({1: [(100.0, 20.0), (200.0, 20.0)]}), series({1: [(150.0, 0.0), (300.0, 20.0)]})
    first.coalesce(1).write.parquet(path)
    second.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumns({
        "ts": F.timestamp_micros("us"), "on_level": F.lit(10.0), "off_level": F.lit(8.0)})
    last = max(drain(track_holds(stream), spark, "t", "update", TRACK_SCHEMA).collect(), key=lambda r: r["epoch"])
    assert last["late_rows"] == 1 and last["longest_s"] == 200.0


def test_alert_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(i, 0.1 if i % 10 else 9.0, 500 if i == 3 else 200, None) for i in range(60)]
    df = spark.createDataFrame(rows, "m long, compile_s double, http_status int, verify_error boolean").withColumn("ts", F.timestamp_seconds(F.col("m") * 60))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    out = drain(alert_windows(spark.readStream.schema(df.schema).parquet(path)), spark, "a", "append", ALERT_SCHEMA).collect()
    assert max(r["end_us"] for r in out) <= (59 - 10) * 60 * 10**6
    got = {(r["figure"], r["start_us"] // 60_000_000): r for r in out}
    slow = got["compile", 0]
    assert (slow["end_us"], slow["seen"], slow["bad"], slow["p95_s"], slow["alert"]) == (600_000_000, 10, 1, 9.0, True)
    half, later = got["requests", 0], got["requests", 5]  # requests have windows of half the width
    assert (half["end_us"], half["seen"], half["bad"], half["alert"]) == (300_000_000, 5, 1, True)
    assert (later["seen"], later["bad"], later["alert"]) == (5, 0, False)
    assert not any(r["figure"] == "verify" for r in out)


def test_p95_is_exact_with_many_values_in_a_window(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i % 600, round(rng.lognormvariate(0, 1), 4)) for i in range(50_000)] + [(5000, 0.0)]
    df = spark.createDataFrame(rows, "s long, compile_s double").withColumns({
        "ts": F.timestamp_seconds("s"), "http_status": F.lit(None).cast("int"), "verify_error": F.lit(None).cast("boolean")})
    path = str(tmp_path / "in")
    df.write.parquet(path)
    out = drain(alert_windows(spark.readStream.schema(df.schema).parquet(path)), spark, "a", "append", ALERT_SCHEMA).collect()
    got = {r["start_us"] // 60_000_000: r for r in out}
    for minute in (-9, -4, 0, 3, 9):
        inside = sorted(v for s, v in rows if minute * 60 <= s < minute * 60 + 600)
        assert (got[minute]["seen"], got[minute]["bad"]) == (len(inside), sum(v > 5 for v in inside))
        assert got[minute]["p95_s"] == inside[-(-len(inside) * 95 // 100) - 1]
    assert len([r for r in out if r["start_us"] == 0]) == 1 and got[0]["seen"] == 50_000


def test_a_run_of_a_whole_batch_goes_through_pieces(spark, series, tmp_path):
    rng = random.Random(6)
    points = [(30.0 * i, rng.uniform(0, 20)) for i in range(3000)]
    rng.shuffle(points)
    df = series({1: points, 2: points[:50]})
    path = str(tmp_path / "in")
    for lo, hi in ((0, 40_000), (40_000, 100_000)):
        df.filter(F.col("us").between(lo * 10**6, hi * 10**6 - 1)).repartition(3).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path).withColumns({
        "ts": F.timestamp_micros("us"), "on_level": F.lit(8.0), "off_level": F.lit(2.0)})
    out = drain(track_holds(stream, most=200), spark, "t", "update", TRACK_SCHEMA).collect()
    best = {k: max(r["longest_s"] for r in out if r["run_id"] == k) for k in (1, 2)}
    assert best == {r["run_id"]: r["hold_s"] for r in holds.latched_hold(Timeline.open(df), 8.0, 6.0).collect()}


def test_state_of_finished_runs_goes(spark, series, tmp_path):
    path = str(tmp_path / "in")
    day = 86_400.0
    for part in (series({1: [(10.0, 20.0), (510.0, 20.0)]}), series({2: [(3 * day, 0.0)]}), series({2: [(9 * day, 0.0)]}), series({2: [(20 * day, 0.0)]}),
                 series({1: [(21 * day, 0.0), (21 * day + 7, 20.0)]})):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path).withColumns({
        "ts": F.timestamp_micros("us"), "on_level": F.lit(10.0), "off_level": F.lit(8.0)})
    out = [r for r in drain(track_holds(stream, keep_ms=5 * 86_400_000), spark, "t", "update", TRACK_SCHEMA).collect() if r["run_id"] == 1]
    ended = [r for r in out if not r["holding"] and r["longest_s"] == 500.0]
    last = max(out, key=lambda r: r["epoch"])
    assert ended and last["longest_s"] == 0.0 and last["holding"]  # begun anew after its state was dropped


def test_a_resumed_run_keeps_its_longest_hold(spark, series, tmp_path):
    path = str(tmp_path / "in")
    days = [series({1: [(10.0, 20.0), (510.0, 20.0), (600.0, 0.0)]}), series({2: [(400_000.0, 0.0)]}), series({2: [(500_000.0, 0.0)]}),
            series({1: [(600_000.0, 20.0), (600_050.0, 20.0)]})]
    for part in days:
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(days[0].schema).option("maxFilesPerTrigger", 1).parquet(path).withColumns({
        "ts": F.timestamp_micros("us"), "on_level": F.lit(10.0), "off_level": F.lit(8.0)})
    out = [r for r in drain(track_holds(stream), spark, "t", "update", TRACK_SCHEMA).collect() if r["run_id"] == 1]
    last = max(out, key=lambda r: r["epoch"])
    assert len(out) >= 2 and last["longest_s"] == 500.0 and last["holding"] and last["current_s"] == 50.0
