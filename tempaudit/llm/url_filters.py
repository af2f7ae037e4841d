"""URL rules by a sort-merge range join on reversed-host keys.

A rule names a host and a path prefix.  With the host's labels reversed, every host below the rule's
is an interval of keys, and intervals of different rules are nested or apart.  URLs and rules are
sorted together; a sweep keeps the stack of rules whose interval holds the current host.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.session import scratch_path

#: Ends each label of a key; it sorts below the characters of host names.
END = "\x01"


def lowered(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


class Stack:
    """Rules whose interval holds the current key: outermost first, one entry per rule host."""

    def __init__(self):
        self.open: list[tuple[str, str, dict[str, tuple]]] = []

    def close_before(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, host: str, path: str, action: str) -> None:
        self.close_before(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, host, {}))
        paths = self.open[-1][2]
        paths[path] = max(paths.get(path, ""), action)  # of equal rules, block wins

    def best(self, host: str, path: str) -> tuple[str | None, str | None]:
        found = None
        for _, rule_host, paths in self.open:
            if host != rule_host and not host.endswith("." + rule_host):
                continue
            for size in {len(p) for p in paths}:
                if size <= len(path) and (action := paths.get(path[:size])) is not None:
                    found = max(found or (-1,), (len(rule_host) + size, len(rule_host), rule_host + path[:size], action))
        return (found[2], found[3]) if found else (None, None)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", id_column: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule`` (host and path of the longest fitting
    rule, else null) and ``verdict`` (its action, else ``default``).

    ``rules`` has ``host``, ``path`` and ``action`` ('allow' or 'block'); neither table need be small.
    A rule fits its host and all subdomains if the path starts with the rule's.  The longest host plus
    path wins, of equally long ones the longer host; equal rules that disagree block.  Null urls and
    urls without ``://`` have an empty host and path, which no rule fits; rules with a null or empty
    host fit nothing, and a null path is empty.  Repeated rows give repeated results.

    Rows are range-partitioned by key, path and id, so one host, or one url, may hold any share of them.
    The rules open at a partition's first key are those on its chain of parent hosts: one small
    join on the first keys finds them.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_column).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.withColumn("key", key_of(F.col("host")))
    clean = rules.filter("host <> '' AND action IS NOT NULL").select(
        lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    clean = clean.withColumn("key", key_of(F.col("host")))
    both = urls.select("key", F.lit(1).alias("kind"), "host", "path", "_id", F.lit(None).cast("string").alias("action")).unionByName(
        clean.select("key", F.lit(0).alias("kind"), "host", "path", F.lit(None).cast(urls.schema["_id"].dataType).alias("_id"), "action"))
    spread = scratch_path(spark, "url-ranges")
    (both.repartitionByRange("key", "kind", "path", F.xxhash64("_id")).withColumn("part", F.spark_partition_id())
     .write.parquet(spread))
    parts = spark.read.parquet(spread)
    labels = F.split("first", END)
    chain = parts.groupBy("part").agg(F.min("key").alias("first")).select("part", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), END), F.lit(END)))).alias("key"))
    carried = chain.join(clean, "key").select("key", F.lit(-1).alias("kind"), "host", "path",
                                              F.lit(None).cast(urls.schema["_id"].dataType).alias("_id"), "action", "part")
    id_type = urls.schema["_id"].dataType.simpleString()
    # rules carried in come first, by key and so outermost first; one that starts in this part comes twice, which adds nothing
    ordered = parts.unionByName(carried).withColumn("here", F.col("kind") >= 0).repartition("part").sortWithinPartitions(
        "part", "here", "key", "kind")

    def sweep(batches):
        part, stack = None, Stack()
        for batch in batches:
            out = []
            columns = (batch.column(i).to_pylist() for i in map(batch.schema.get_field_index, ("part", "kind", "key", "host", "path", "action")))
            for here, kind, key, host, path, action in zip(*columns):
                if here != part:
                    part, stack = here, Stack()
                if kind <= 0:
                    stack.add(key, host, path, action)
                    out.append(None)
                else:
                    stack.close_before(key)
                    out.append(stack.best(host, path))
            keep = pa.array([x is not None for x in out], pa.bool_())
            rows = batch.filter(keep)
            found = [x for x in out if x is not None]
            yield pa.RecordBatch.from_arrays([
                rows.column(rows.schema.get_field_index(c)) for c in ("_id", "host", "path")] + [
                pa.array([x[0] for x in found], pa.string()), pa.array([x[1] or default for x in found], pa.string())],
                ["_id", "host", "path", "rule", "verdict"])

    swept = ordered.mapInArrow(sweep, f"_id {id_type}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("_id", id_column)
