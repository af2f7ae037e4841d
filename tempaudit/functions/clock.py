"""Timestamp parsing and calendar keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIX_MAX = 4_102_444_800  # fixed value: 2100-01-01, the upper end of plausible epoch seconds
EXCEL_DAYS = (25_000, 100_000)  # fixed value: serial days a log can hold (1968 to 2173)
EXCEL_EPOCH_DAYS = 25_569  # fixed value: days from 1899-12-30 to 1970-01-01


def numeric(text: Column) -> Column:
    """Number or null.  A failing cast costs far more than the pattern that avoids it."""
    text = text.cast("string")
    return F.when(text.rlike(r"^\s*[-+]?[0-9.]+([eE][-+]?[0-9]+)?\s*$"), text.try_cast("double"))


def timestamp_format(lowest: Column, highest: Column) -> Column:
    """``excel`` if all values are serial days, ``unix`` if all are in the epoch range, else ``iso``."""
    return F.when((lowest >= EXCEL_DAYS[0]) & (highest <= EXCEL_DAYS[1]), "excel").when(
        (lowest >= 0) & (highest <= UNIX_MAX), "unix").otherwise("iso")


def detect_format(df: DataFrame, text: str, key=("run_id",)) -> DataFrame:
    """Format of each run's instants, judged on all its values together: one log has one format."""
    number = numeric(F.col(text))
    whole = F.count(number) == F.count(text)
    return df.groupBy(*key).agg(
        F.when(whole, timestamp_format(F.min(number), F.max(number))).otherwise("iso").alias("ts_format"))


def from_unix(text: Column) -> Column:
    return F.timestamp_micros(F.round(numeric(text) * 1_000_000).cast("long"))


def from_excel_serial(text: Column) -> Column:
    """Excel serial days to an instant."""
    return F.timestamp_micros(F.round((numeric(text) - EXCEL_EPOCH_DAYS) * 86_400 * 1_000_000).cast("long"))


def has_offset(text: Column) -> Column:
    return text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def parse(text: Column, fmt: Column, zone: Column | str = "UTC") -> Column:
    """Instant of a text by its run's format (see ``detect_format``); naive ISO text is in ``zone``."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    iso = F.try_to_timestamp(text)
    local = F.when(has_offset(text), iso).otherwise(F.to_utc_timestamp(iso, zone))
    return F.when(fmt == "excel", from_excel_serial(text)).when(fmt == "unix", from_unix(text)).otherwise(local)


def resolve_zone(df: DataFrame, zones: DataFrame, name: str = "zone") -> DataFrame:
    """Zone alias per row through a caller's table (alias, zone); unknown aliases are UTC."""
    z = zones.select(F.lower("alias").alias("_alias"), F.col("zone").alias("_zone"))
    return df.join(z, F.lower(F.col(name)) == F.col("_alias"), "left").withColumn(
        name, F.coalesce("_zone", F.lit("UTC"))).drop("_alias", "_zone")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def next_reset(ts: Column) -> Column:
    """First day of the following month."""
    return F.add_months(F.trunc(ts, "month"), 1)
