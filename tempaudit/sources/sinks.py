"""Sinks (A14-A18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_samples(df: DataFrame, path: str, by="industry", fmt="parquet", files_per_value: int = 1, mode="errorifexists") -> None:
    """Normalised samples, partitioned by industry.

    A large industry, or one large run, is spread over ``files_per_value`` tasks by a hash of its rows.
    """
    spread = F.pmod(F.xxhash64("run_id", "seq"), F.lit(files_per_value))
    placed = df.repartition(F.col(by), spread)
    placed.write.mode(mode).partitionBy(by).option("header", True).format(fmt).save(path)


def write_decisions(df: DataFrame, path: str, fmt="json", mode="errorifexists") -> None:
    df.write.mode(mode).format(fmt).save(path)


def append_daily(df: DataFrame, path: str) -> None:
    """Daily rows appended to a CSV directory, each file with its header."""
    df.write.mode("append").option("header", True).csv(path)


def campaign_export(confusion: DataFrame, disagreements: DataFrame, by="industry") -> DataFrame:
    """One JSON document per group: its confusion matrix, and one per disagreement.

    Disagreements stay rows: their number grows with the corpus.
    """
    matrix = F.to_json(F.struct(F.col(by), F.struct("tp", "fp", "tn", "fn").alias("confusion_matrix")))
    single = F.to_json(F.struct(*[F.col(c) for c in disagreements.columns]))
    return confusion.select(F.lit("matrix").alias("kind"), matrix.alias("value")).unionAll(
        disagreements.select(F.lit("disagreement").alias("kind"), single.alias("value")))


def write_campaign(export: DataFrame, path: str) -> None:
    export.write.partitionBy("kind").text(path)


def exposition(df: DataFrame, metrics: list[str], labels: list[str], at_ms: Column, prefix="tempaudit") -> DataFrame:
    """Metrics as text lines ``name{label="x"} value time``."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    rows = df.withColumn("_at", at_ms).selectExpr(*labels, "_at", f"stack({len(metrics)}, {pairs}) AS (metric, v)")
    label = F.concat_ws(",", *[F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels])
    return rows.select(F.concat(F.lit(f"{prefix}_"), F.col("metric"), F.lit("{"), label, F.lit("} "), F.col("v").cast("string"),
                                F.lit(" "), F.col("_at").cast("string")).alias("value"))


def exposition_json(df: DataFrame, metrics: list[str], labels: list[str]) -> DataFrame:
    """The same figures as one JSON object per row."""
    return df.select(F.to_json(F.struct(*labels, *metrics)).alias("value"))
