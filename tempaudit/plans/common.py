"""Query registry and the stand-in tables every query starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempaudit.operators.timeline import Timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the statement that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as sensor samples: a run per user, the event type as sensor, ``k`` as second signal."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("seq"), "value", F.col("event_type").alias("sensor"),
        F.get_json_object("props", "$.k").cast("double").alias("k"))


def timeline(spark: SparkSession, sf: str, *columns: str) -> Timeline:
    """Samples as a timeline, pruned to the columns the query reads."""
    wanted = list(dict.fromkeys(["run_id", "us", "seq", "value", *columns]))
    return Timeline.open(samples(spark, sf).select(*wanted))


# The same expressions serve Spark and the SQL side.
THR = "CAST(20 + 10 * (run_id % 6) AS DOUBLE)"
HYST = "CAST(2 + 2 * (run_id % 5) AS DOUBLE)"
LO = "CAST(10 + 2 * (run_id % 4) AS DOUBLE)"
HI = "CAST(60 + 5 * (run_id % 4) AS DOUBLE)"
BUDGET = "CAST(43200 * (1 + run_id % 4) AS DOUBLE)"



def expr(text: str) -> Column:
    return F.expr(text)


def r(name: str, digits: int = 6, alias: str | None = None) -> Column:
    return F.round(F.col(name), digits).alias(alias or name.split(".")[-1])


S = """s AS (SELECT user_id AS run_id, epoch_us(ts) AS us, event_id AS seq, value, event_type AS sensor,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)"""
WIN = "(PARTITION BY run_id ORDER BY us, seq)"
UPTO = "(PARTITION BY run_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def sql_islands(state: str, source: str = "s", extra: str = "") -> str:
    """CTEs ``st`` (rows with state), ``isl_rows`` and ``isl`` (one row per island)."""
    return f"""st AS (SELECT *, {state} AS state FROM {source}),
    ch AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER {WIN} THEN 1 ELSE 0 END AS step FROM st),
    isl_rows AS (SELECT *, sum(step) OVER {UPTO} AS island FROM ch),
    isl AS (SELECT run_id, island, state, min(us) AS start_us, max(us) AS end_us, count(*) AS samples,
      (max(us) - min(us)) / 1e6 AS duration_s{extra} FROM isl_rows GROUP BY run_id, island, state)"""


def sql_latch(on: str = THR, off_by: str = HYST, value: str = "value") -> str:
    return f"""coalesce(last_value(CASE WHEN {value} >= {on} THEN true WHEN {value} < {on} - {off_by} THEN false END IGNORE NULLS)
      OVER {UPTO}, false)"""


SQL_LONGEST = """best AS (SELECT run_id, duration_s, start_us, end_us,
      row_number() OVER (PARTITION BY run_id ORDER BY duration_s DESC, start_us) AS rn FROM isl WHERE state AND duration_s > 0),
    runs AS (SELECT DISTINCT run_id FROM s)"""
