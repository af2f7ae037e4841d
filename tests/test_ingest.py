"""Files: text logs, specifications, decisions, listings, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tempaudit.functions import clock, names, units
from tempaudit.operators import specs
from tempaudit.sources import corpus, sinks, textlog


@pytest.fixture
def logs(tmp_path):
    files = {
        "semi.csv": "# job: J-1\n# site: north\n\ntimestamp;temp_C;hum\n2024-01-01T00:00:00Z;1.180,5;40\n2024-01-01T00:00:30Z;181,25;41\n",
        "comma.csv": "time,t1,t2\n1704067200,20.5,21\n1704067230,,bad\n",
        "tab.csv": "Date Time\ttemp\n2024-01-01 00:00:00\t5.5\n2024-01-01 00:01:00\t6.5\n",
        "empty.csv": "# nothing: here\n",
        "headonly.csv": "timestamp,temp\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def stem(path):
    return path.rsplit("/", 1)[-1]


def test_readings(spark, logs):
    got = textlog.samples_of(textlog.readings(textlog.scan_lines(spark, logs))).collect()
    values = {(stem(r["run_id"]), r["us"] // 10**6 - 1704067200, r["sensor"]): r["value"] for r in got}
    assert values == {
        ("semi.csv", 0, "temp_C"): 1180.5, ("semi.csv", 0, "hum"): 40.0, ("semi.csv", 30, "temp_C"): 181.25, ("semi.csv", 30, "hum"): 41.0,
        ("comma.csv", 0, "t1"): 20.5, ("comma.csv", 0, "t2"): 21.0, ("comma.csv", 30, "t1"): None, ("comma.csv", 30, "t2"): None,
        ("tab.csv", 0, "temp"): 5.5, ("tab.csv", 60, "temp"): 6.5}


def test_small_splits_give_the_same_readings(spark, tmp_path):
    rows = [f"2024-01-01T{h:02d}:{m:02d}:00Z|{h * 60 + m}.5" for h in range(24) for m in range(60)]
    (tmp_path / "long.csv").write_text("# job: X\ntimestamp|temp\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = textlog.scan_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 5
        got = textlog.samples_of(textlog.readings(lines)).agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.max("sensor").alias("c")).first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (got["n"], got["s"], got["c"]) == (1440, sum(range(1440)) + 720.0, "temp")


def test_metadata_and_status(spark, logs):
    lines = textlog.scan_lines(spark, logs)
    meta = {stem(r["file"]): r["metadata"] for r in textlog.metadata(lines).collect()}
    assert meta["semi.csv"] == {"job": "J-1", "site": "north"} and meta["empty.csv"] == {"nothing": "here"}
    status = {stem(r["file"]): (r["status"], sorted(r["warnings"])) for r in textlog.parse_status(lines).collect()}
    assert status == {
        "semi.csv": ("OK", []), "tab.csv": ("OK", []), "comma.csv": ("OK", []),
        "empty.csv": ("ERROR", ["no_header"]), "headonly.csv": ("ERROR", ["no_rows"])}


def test_quotes_late_delimiters_and_fallbacks(spark, tmp_path):
    late = "".join(f"2024-01-01T00:00:{i:02d}Z;{i}\n" for i in range(40))
    files = {
        "notes.csv": 'timestamp,temp,notes\n2024-01-01T00:00:00Z,180.0,"door open, then ""closed"""\n2024-01-01T00:00:30Z,181.0,\n',
        "late.csv": "timestamp;v\n" + "2024-01-01T00:00:00Z;1 | 2 | 3\n" * 10 + late,
        "wide.csv": "timestamp\ttemp\n2024-01-01T00:00:00Z\t1\n2024-01-01T00:00:30Z\t2\t3\n",
        "broken.csv": "timestamp;temp\n2024-01-01T00:00:00Z;1,5;7\n",
        "seconds.csv": "time,temp\n0,1\n30,2\n99990,3\n100020,4\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.csv").write_bytes("timestamp,tür\n2024-01-01T00:00:00Z,1\n".encode("latin1"))
    lines = textlog.scan_lines(spark, str(tmp_path))
    rows = [(stem(r["file"]), r["name"], r["text"], r["us"]) for r in textlog.readings(lines).collect()]
    assert ("notes.csv", "notes", 'door open, then "closed"', 1704067200 * 10**6) in rows and sum(r[0] == "notes.csv" for r in rows) == 4
    assert sorted(r[3] // 10**6 for r in rows if r[0] == "seconds.csv") == [0, 30, 99_990, 100_020]
    assert {stem(r["file"]): r["delimiter"] for r in textlog.delimiters(textlog.data_lines(lines)).collect()}["late.csv"] == ";"
    for safe, softer in ((False, "OK"), (True, "INDETERMINATE")):
        status = {stem(r["file"]): (r["status"], r["warnings"]) for r in textlog.parse_status(lines, safe).collect()}
        assert status["wide.csv"] == (softer, ["delimiter_fallback"]) and status["bytes.csv"] == (softer, ["encoding_fallback"])
        assert ("bytes.csv", "tür") in {(r[0], r[1]) for r in rows}
        assert status["broken.csv"] == ("ERROR", ["delimiter_fallback", "parse_failure"]) and status["notes.csv"] == ("OK", [])


def test_encodings(spark, tmp_path):
    text = "timestamp,temp_°C\n2024-01-01T00:00:00Z,1.5\n"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + text.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe" + text.encode("utf-16-le"))
    (tmp_path / "c.csv").write_bytes(b"\xfe\xff" + text.encode("utf-16-be"))
    (tmp_path / "d.csv").write_text(text)
    (tmp_path / "e.csv").write_bytes(b"\xff\xfe\x00\x00" + text.encode("utf-32-le"))
    (tmp_path / "f.csv").write_bytes(b"\x00\x00\xfe\xff" + text.encode("utf-32-be"))
    lines = textlog.scan_encoded(spark, str(tmp_path))
    kinds = {stem(r["file"]): r["encoding"] for r in lines.select("file", "encoding").distinct().collect()}
    assert kinds == {"a.csv": "utf-8-sig", "b.csv": "utf-16-le", "c.csv": "utf-16-be", "d.csv": "utf-8", "e.csv": "utf-32-le", "f.csv": "utf-32-be"}
    got = textlog.readings(lines.drop("encoding")).collect()
    assert {(stem(r["file"]), r["name"], r["value"]) for r in got} == {(f, "temp_°C", 1.5) for f in ("a.csv", "b.csv", "c.csv", "d.csv", "e.csv", "f.csv")}


@pytest.mark.parametrize("raw, want", [
    ("1.234,56", "1234.56"), ("12.345.678,9", "12345678.9"), ("1234,5", "1234.5"), ("1,234.56", "1,234.56"), ("# 1,5", "# 1,5"),
    ("no digits", "no digits"), ("a,b,c,1,5", "a,b,c,1,5"), ("1.5", "1.5"), ("x;234,56;1.000,5", "x;234.56;1000.5")])
def test_decimals(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(textlog.normalize_decimals(F.col("x"))).first()[0] == want


def test_spec_scan(spark, tmp_path):
    good = {"version": "1.0", "industry": "powder", "job": {"job_id": "a-1"}, "spec": {"method": "PMT", "target_temp_C": 180, "hold_time_s": 600},
            "data_requirements": {"max_sample_period_s": 30, "allowed_gaps_s": 60}}
    bad = {**good, "industry": "haccp", "spec": {**good["spec"], "hold_time_s": 0}, "sensor_selection": {"sensors": ["a", "a", " "]}}
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    (tmp_path / "broken.json").write_text("{nope")
    ok, quarantine = specs.split_valid(specs.read_specs(spark, str(tmp_path)))
    assert [r["job"]["job_id"] for r in ok.collect()] == ["a-1"]
    found = sorted([sorted(r["violations"]) for r in quarantine.collect()], key=len)
    assert found[0] == ["hold_time_s", "industry_method", "sensor_name_empty", "sensors_not_unique"] or found[1] == [
        "hold_time_s", "industry_method", "sensor_name_empty", "sensors_not_unique"]
    assert len(found) == 2


def test_decisions_and_queue(spark, tmp_path):
    for i, doc in enumerate([{"pass": True, "job_id": "a"}, {"status": "INDETERMINATE", "pass": False, "job_id": "b", "flags": {"fallback_used": True}}]):
        folder = tmp_path / "runs" / str(i)
        folder.mkdir(parents=True)
        (folder / "decision.json").write_text(json.dumps(doc))
        (folder / "other.json").write_text('{"job_id": "x"}')
    got = {r["job_id"]: (r["status"], r["fallback_used"]) for r in corpus.scan_decisions(spark, str(tmp_path / "runs")).collect()}
    assert got == {"a": ("PASS", False), "b": ("INDETERMINATE", True)}
    (tmp_path / "q.jsonl").write_text('{"job_id": "1", "stage": 0}\nnot json\n{"job_id": "2", "stage": 1}\n')
    assert corpus.scan_jsonl(spark, str(tmp_path / "q.jsonl"), "job_id string, stage int").count() == 2


def test_listing(spark, tmp_path):
    for p in ("ab/job1/x.csv", "ab/job1/y.pdf", "zz/job2/x.csv", "abc/job3/x.csv"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("12345")
    got = corpus.list_artifacts(spark, str(tmp_path)).collect()
    assert {(r["job_id"], r["size_bytes"]) for r in got} == {("job1", 5)} and len(got) == 2


def test_registry(spark):
    entries = [{"dataset_key": "k", "id": "1", "industry": "powder", "csv_path": "realworld/a.csv", "expected_outcome": "PASS",
                "provenance": {"source": "x"}, "metadata": {"sensors": "t1"}}]
    row = corpus.registry(spark, entries).first()
    assert row["industry"] == "powder" and row["provenance"] == {"source": "x"} and row["spec_path"] is None


def test_tables(spark, tmp_path):
    path = str(tmp_path / "users")
    spark.createDataFrame([("u", "a@b", "free")], "user_id string, email string, plan string").write.parquet(path)
    row = corpus.scan_table(spark, "users", path).first()
    assert row["plan"] == "free" and row["created_at"] is None


def test_samples_sink_prunes_by_industry(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, i, float(i), "powder" if i % 2 else "haccp") for i in range(20)], "run_id long, seq long, value double, industry string")
    path = str(tmp_path / "s")
    sinks.write_samples(df, path, files_per_value=2)
    read = spark.read.parquet(path).filter("industry = 'powder'")
    assert read.count() == 10 and "PartitionFilters: [isnotnull(industry" in read._jdf.queryExecution().toString()


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "x", 5.0)], "Timestamp double, Temp_C double, `temp [°C]` double, `Chamber psi` double, label string, `RH %` double")
    assert names.timestamp_column(df) == "Timestamp"
    assert names.temperature_columns(df) == ["Temp_C", "temp [°C]"]
    assert names.pressure_columns(df) == ["Chamber psi"] and names.humidity_columns(df) == ["RH %"]
    assert names.rename_wide(df).columns == ["timestamp", "temperature", "temperature__2", "Chamber psi", "label", "RH %"]
    first = spark.createDataFrame([("2024-01-01", 1.0)], "a string, b double")
    assert names.timestamp_column(first) == "a"
    with pytest.raises(ValueError):
        names.timestamp_column(spark.createDataFrame([("x", 1.0)], "a string, b double"))


def test_fahrenheit_names_and_clock(spark):
    rows = [("temp_F", True), ("shelf", False), ("°F probe", True), ("degF", True), ("fahrenheit", True), ("offset", False), ("temp_C", False)]
    df = spark.createDataFrame(rows, "n string, want boolean").withColumn("got", units.named_fahrenheit(F.col("n")))
    assert [(r["n"], r["got"]) for r in df.collect()] == rows
    texts = [(1, "1704067200", 0), (2, "45292", 0), (3, "2024-01-01T00:00:00Z", 0), (3, "2023-12-31T19:00:00-05:00", 0), (3, "2024-01-01 00:00:00", -3600)]
    texts += [(4, str(s), s - 1704067200) for s in (0, 30, 99_990, 100_020)]  # seconds from a run's start stay one clock
    df = spark.createDataFrame(texts, "run_id long, t string, w long")
    parsed = F.unix_micros(clock.parse(F.col("t"), F.col("ts_format"), "Europe/Berlin"))
    got = df.join(clock.detect_format(df, "t"), "run_id").select(parsed.alias("us"), "w").collect()
    assert len(got) == len(texts) and [r["us"] // 10**6 - 1704067200 for r in got] == [r["w"] for r in got]


def test_listing_reads_no_content_and_tables_keep_their_schema(spark, tmp_path):
    from tempaudit.sources import corpus

    for job in ("ab/j1", "zz/j2"):
        (tmp_path / job).mkdir(parents=True)
        (tmp_path / job / "a.csv").write_text("x" * 7)
    listed = corpus.list_artifacts(spark, str(tmp_path))
    assert [(r["job_id"], r["size_bytes"]) for r in listed.collect()] == [("j1", 7)]
    plan = str(listed._jdf.queryExecution().executedPlan())
    assert "content" not in plan.split("ReadSchema:")[-1]
    spark.createDataFrame([("u", 1)], "user_id string, extra int").write.parquet(str(tmp_path / "users"))
    read = corpus.scan_table(spark, "users", str(tmp_path / "users"))
    assert read.columns == ["user_id", "email", "plan", "created_at"] and read.first()["email"] is None
