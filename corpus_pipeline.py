"""A training-data pipeline over ``documents``: quality, line dedup, document dedup, mixing and encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor, hot sources and copies
included.  All but the last return the columns of ``documents``.  Rows with a null text or id are
handled as the operators say; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempaudit.llm import bpe, line_dedup, mixing, ngram_join
from tempaudit.llm.queries import judged, vocabulary
from tempaudit.llm.textops import unused
from tempaudit.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; an id with several texts stays if one of them is kept."""
    key = unused(docs, "_id")
    kept = judged(docs, sf_dir).filter("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came earlier in the corpus; ``n_chars`` counts what is left."""
    return line_dedup.cleaned(docs).withColumn("n_chars", F.length("text").cast("long"))


def document_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_rows(docs, mixing.mix(docs, F.array("source"), mixing.cycled(5, 2, 1)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    encoded = bpe.encode(docs, vocabulary())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality), ("line_dedup", line_dedup_stage), ("document_dedup", document_dedup), ("mix", mix), ("encode", encode)]

#: The classifier and the mix are fitted, not queried, so SQL has no counterpart; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again as the next input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
