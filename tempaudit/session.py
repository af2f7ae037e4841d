"""Session settings and the shared folder that cuts lineage and holds scratch output."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = "tempaudit.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 5_000_000


def build_session(app: str = "tempaudit", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC clock and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def rows_per_task(spark: SparkSession) -> int:
    """Largest number of rows of one run that a single task may be asked to order."""
    return int(spark.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Within it, each listing of many folders is a job of four tasks a core, not of one task a folder."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tempaudit-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ensure_checkpointing(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        folder = shared_folder(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A literal table (a rule set, a dimension of a few rows) as a local relation of known size."""
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows)
    return spark.createDataFrame(pa.table({name: pa.array(col, kinds[kind]) for (name, kind), col in zip(fields, columns)}))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written table."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
