import re

import pytest

from tempaudit.plans import files
from tempaudit.session import few_listing_tasks


def written(spark, tmp_path, monkeypatch, name):
    """Rows of a query over 40 suppliers, of which two share a key, and the data files it wrote."""
    rows = [(i, f"Supplier#{i}", 100.0 * i) for i in range(39)] + [(38, "Supplier#38", 3800.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "sf" / "supplier.parquet"))
    root = tmp_path / "written"
    monkeypatch.setattr(files, "scratch_path", lambda *_: str(root))
    got = files.__dict__[name](spark, str(tmp_path / "sf")).collect()
    return got, [str(p.relative_to(root)) for p in root.rglob("part-*.txt")]


def tasks(paths):
    return {re.search(r"part-(\d+)", p)[1] for p in paths}


def test_specification_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    got, paths = written(spark, tmp_path, monkeypatch, "a07f")
    assert len(tasks(paths)) > 1
    assert len(paths) == 39 and sorted(r["no"] for r in got) == list(range(39))
    assert {r["no"] for r in got if r["verdict"] == "malformed"} == {0, 17, 34}


def test_listings_of_many_folders_take_few_tasks(spark):
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), few_listing_tasks(spark):
        assert int(spark.conf.get(name)) <= 4 * spark.sparkContext.defaultParallelism
        raise ValueError
    assert spark.conf.get(name) == before


def test_decision_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    got, paths = written(spark, tmp_path, monkeypatch, "a09f")
    assert len(tasks(paths)) > 1
    assert len(paths) == 39 and sorted(r["job"] for r in got) == list(range(39))


def test_artifact_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    got, paths = written(spark, tmp_path, monkeypatch, "a12f")
    assert all(len(tasks(p for p in paths if p.startswith(shelf))) > 1 for shelf in ("00/", "01/", "02/", "03/", "misc/"))
    assert {r["job_id"]: r["size_bytes"] for r in got} == {f"job={k}": (len(f"Supplier#{k}") + 1) * (2 if k == 38 else 1) for k in range(39) if k % 3}
