"""Shards along a Hilbert curve through the metadata, with built-in functions only.

Each dimension is quantised into bins of about equally many rows.  Rows are sorted by the place of their bins on the curve
and the sorted rows are cut into runs of equal length.  Rows near on the curve are near in every dimension, so a
filter on any of them, or on several, opens few shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.llm import hilbert
from tempaudit.llm.textops import unused
from tempaudit.session import scratch_path

#: Bits of a bin number: each dimension has at most 2**BITS bins.
BITS = 5


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ordered(df: DataFrame, order: list[str], weight: str | None = None, before: str = "before", total: str = "total") -> DataFrame:
    """The rows with the weights (default: 1) of all rows that sort before them, and of all rows.

    Rows are range-partitioned and written once with their place in their partition.  Only the partitions' sums, a row for each, are
    put in order in one task, and are small enough to be sent to all.
    """
    at, part, sums = unused(df, "_at"), unused(df, "_part"), unused(df, "_sum")
    kept = _written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    kept = kept.withColumn(part, F.shiftright(at, 33))
    if weight is None:
        inside = F.col(at).bitwiseAND((1 << 33) - 1)
        per_part = kept.groupBy(part).agg(F.count(F.lit(1)).alias(sums))
    else:
        inside = F.coalesce(F.sum(weight).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per_part = kept.groupBy(part).agg(F.sum(weight).alias(sums))
    line = Window.orderBy(part)
    per_part = per_part.select(part, F.sum(sums).over(Window.partitionBy()).alias(total), F.coalesce(
        F.sum(sums).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return kept.join(F.broadcast(per_part), part).withColumn(before, F.col(before) + inside).drop(at, part)


def bin_edges(df: DataFrame, column: str, bins: int) -> list:
    """The smallest value of each bin but the first; at most ``bins - 1`` values, with equally many rows between them where ties allow."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    spread = ordered(counts, ["value"], "rows")
    place = F.floor(F.col("before") * bins / F.col("total"))
    rows = spread.groupBy(place.alias("place")).agg(F.min("value").alias("value")).filter("place > 0").orderBy("place").collect()
    return [r["value"] for r in rows]


def binned(value: Column, edges: list) -> Column:
    """0 for null, else the number of edges at or below the value."""
    return sum((F.when(value >= F.lit(x), 1).otherwise(0) for x in edges), F.lit(0))


def shard(docs: DataFrame, dimensions: list[str], shards: int, ties: list[str], bits: int = BITS) -> DataFrame:
    """The rows with ``curve`` (place on the curve), ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    Shards hold equally many rows, give or take one; with fewer rows than shards some are empty.  ``dimensions`` are two to four
    columns of numbers, strings or times, nulls in the lowest bin; rows of one cell are ordered by ``ties``, nulls first, and then
    by the dimensions.  Rows equal in all of these are interchangeable.  No rows give no rows.
    """
    curve, before, total = unused(docs, "curve"), unused(docs, "_before"), unused(docs, "_total")
    cells = [binned(F.col(c), bin_edges(docs, c, 1 << bits)) for c in dimensions]
    rows = hilbert.with_index(docs, cells, bits, curve)
    rows = ordered(rows, list(dict.fromkeys([curve, *ties, *dimensions])), None, before, total)
    number = F.expr(f"({before} * {shards}) div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    rows = rows.withColumn("shard", number.cast("int"))
    return rows.withColumn("slot", F.col(before) - first).drop(before, total)


def shard_documents(docs: DataFrame, shards: int, dimensions: tuple[str, ...] = ("source", "lang", "size")) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and ``curve`` of every document.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1) and ``text_crc32`` their checksum (null: that of no bytes).  The law is ``rows``:
    counts of shards are at most one apart, whatever the sizes, and ``grown_shard`` is null, as one more shard moves every cut.
    Inside a cell of the curve rows are ordered by checksum and id, so copies with the same metadata stand together.  Repeated rows
    are placed one by one.  Only numbers and metadata are sorted, the texts are read once.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = _written(docs.select("doc_id", "source", "lang", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
                                F.crc32(body).alias("text_crc32")), "shard-rows")
    placed = shard(slim, list(dimensions), shards, ["text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         "curve")


def write_shards(docs: DataFrame, path: str, dimensions: list[str], shards: int, ties: list[str]) -> None:
    """The rows as Parquet files below ``path``, in a folder ``shard=N`` for each shard, ordered by slot inside a file and across files.

    A shard is written by as many tasks as its rows fill.  Every file holds a run of the curve, so its footer's least and greatest
    values of each dimension are close together and readers skip it by them.
    """
    placed = shard(docs, dimensions, shards, ties)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
