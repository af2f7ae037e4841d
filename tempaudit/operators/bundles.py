"""Evidence bundles: manifests, root digests and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: parts every bundle must hold
REQUIRED_PARTS = ("raw_data", "specification", "normalized_data", "decision", "plot", "report")


def integrity(manifest: DataFrame, files: DataFrame, key=("bundle_id", "path")) -> DataFrame:
    """State of every file named or found: ok, missing, extra or changed.

    One full outer join gives both anti joins and the inner comparison.
    """
    m = manifest.select(*key, F.col("sha256").alias("expected"))
    f = files.select(*key, F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(
        F.col("expected") != F.col("found"), "changed").otherwise("ok")
    return m.join(f, list(key), "full_outer").select(*key, state.alias("state"))


def missing_parts(parts: DataFrame, required=REQUIRED_PARTS) -> DataFrame:
    have = F.collect_set(F.when(F.col("part").isin(*required), F.col("part")))
    return parts.groupBy("bundle_id").agg(
        F.array_sort(F.array_except(F.array(*map(F.lit, required)), have)).alias("missing_parts"))


def manifest_line(path: Column, size: Column) -> Column:
    return F.format_string("sha256 %d %s\n", size, path)


def _digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each bundle's lines, which arrive sorted and adjacent; holds one running hash."""
    nothing = object()
    current, running, kind = nothing, None, None

    def closed():
        return pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([running.hexdigest()], pa.string())], ["bundle_id", "digest"])

    for batch in batches:
        kind = batch.column(0).type
        for bundle, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if current is nothing or bundle != current:
                if current is not nothing:
                    yield closed()
                current, running = bundle, hashlib.sha256()
            if line is not None:
                running.update(line.encode())
    if current is not nothing:
        yield closed()


def ordered_digest(df: DataFrame, line: Column) -> DataFrame:
    """SHA-256 over the bundle's lines in path order.

    A digest is sequential, so a bundle is one task's work; its sorted lines stream through a running hash and
    nothing is collected, whatever the bundle's size.  A null line adds nothing, a null path comes first, and
    rows without a bundle id are a bundle of their own with a null id.
    """
    kind = df.schema["bundle_id"].dataType.simpleString()
    lines = df.select("bundle_id", "path", line.alias("line")).repartition("bundle_id").sortWithinPartitions("bundle_id", "path", "line")
    return lines.select("bundle_id", "line").mapInArrow(_digest_stream, f"bundle_id {kind}, digest string")


def root_digest(manifest: DataFrame) -> DataFrame:
    """Digest over sizes and paths."""
    return ordered_digest(manifest, manifest_line(F.col("path"), F.col("size_bytes")))


def content_digest(manifest: DataFrame) -> DataFrame:
    """Digest over the concatenated file hashes."""
    return ordered_digest(manifest, F.col("sha256"))


def canonical_manifest(manifest: DataFrame) -> DataFrame:
    """Digest over the files as canonical JSON, keys in sorted order."""
    return ordered_digest(manifest, F.to_json(F.struct("path", "sha256", "size_bytes")))


def bundle_verdict(file_states: DataFrame, digests: DataFrame, stored: DataFrame, replay: DataFrame | None = None) -> DataFrame:
    """A bundle is valid if all files are ok, the root digest holds and, where asked for, the replay matches."""
    files = file_states.groupBy("bundle_id").agg(
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "extra").alias("extra"),
        F.count_if(F.col("state") == "changed").alias("changed"))
    out = files.join(stored.select("bundle_id", F.col("digest").alias("stored")), "bundle_id", "left").join(
        digests.select("bundle_id", "digest"), "bundle_id", "left")
    root_ok = F.coalesce(F.col("stored") == F.col("digest"), F.lit(False))
    clean = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("changed") == 0)
    if replay is not None:
        out = out.join(replay.select("bundle_id", "matches"), "bundle_id", "left")
        clean = clean & F.coalesce("matches", F.lit(False))
    return out.select("bundle_id", "missing", "extra", "changed", root_ok.alias("root_ok"), (clean & root_ok).alias("valid"))
