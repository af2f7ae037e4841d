"""Near-duplicate embeddings by cosine: tiles of vectors in principal-component order.

Vectors are rotated onto their principal components, so that the leading coordinates hold most of a
product.  A tile compares two blocks of vectors: it adds up the products of leading coordinates group by group,
bounds the rest by the norms of the suffixes (Cauchy-Schwarz), and stops once no pair can reach the
threshold; few remaining pairs are finished one by one.  What survives is decided by the cosine of the
original vectors in double precision.  Blocks are ranges of the first component: two unit
vectors with cosine t lie within sqrt(2 - 2 t) there, so that distant blocks never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempaudit.llm.graph import components, local_roots
from tempaudit.session import scratch_path

THRESHOLD = 0.9
#: Vectors of one side of a tile: a task holds two blocks, whatever the table's size.
BLOCK_LEAST, BLOCK_MOST = 512, 4096
#: Blocks aimed at while they are smaller than ``BLOCK_MOST``.
BLOCKS = 24
#: Cells of the first component, by whose counts blocks are cut.
CELLS = 4096
#: Coordinates added at a time, and slack for the rounding of single precision.
STEP, SLACK = 16, 2e-5
#: Above this share of open pairs a tile goes on with matrix products.
DENSE = 0.02


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _usable(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def stack(raw: list[bytes], sizes: np.ndarray, kind: str, dim: int) -> np.ndarray:
    """Vectors of bytes as unit rows in double precision, shorter ones filled with zeros."""
    out = np.zeros((len(raw), dim))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[rows, :size] = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), size)
    out /= np.abs(out).max(1, keepdims=True)  # keeps the squares finite
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def principal_axes(reps: DataFrame, kind: str, dim: int) -> np.ndarray:
    """Axes by falling variance, from the second moments of all unit vectors, summed in two levels."""
    def sums(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            raw, sizes = batch.column("raw").to_pylist(), np.asarray(batch.column("size"))
            for i in range(0, len(raw), 4096):
                x = stack(raw[i:i + 4096], sizes[i:i + 4096], kind, dim)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def join(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for raw in batch.column("total").to_pylist():
                total += np.frombuffer(raw).reshape(dim, dim)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    first = reps.mapInArrow(sums, "total binary")
    total = sum(np.frombuffer(r.total).reshape(dim, dim) for r in first.repartition(16).mapInArrow(join, "total binary").collect())
    values, axes = np.linalg.eigh(total)
    return axes[:, np.argsort(-values, kind="stable")]


def tile_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of rotated single-precision blocks that may reach the threshold."""
    limit = np.float32(threshold - SLACK)
    dim = a.shape[1]

    def suffix(x):
        return np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0)).astype(np.float32)

    sa, sb = suffix(a), suffix(b)
    got = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, dim, STEP):
        hi = min(lo + STEP, dim)
        got += a[:, lo:hi] @ b[:, lo:hi].T
        if hi == dim:
            return np.nonzero(got >= limit)
        reach = got + sa[:, hi][:, None] * sb[:, hi][None, :]
        open_ = reach >= limit
        count = np.count_nonzero(open_)
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if count < DENSE * open_.size:
            i, j = np.nonzero(open_)
            part = got[i, j]
            while hi < dim and len(i):
                lo, hi = hi, min(hi + STEP, dim)
                part = part + np.einsum("ij,ij->i", a[i, lo:hi], b[j, lo:hi])
                rest = sa[i, hi] * sb[j, hi] if hi < dim else 0
                keep = part + rest >= limit
                i, j, part = i[keep], j[keep], part[keep]
            return i, j
    return np.nonzero(got >= limit)


def links(vectors: DataFrame, vector: str = "embedding", id_column: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the id, ``n_links`` (other vectors with cosine >= threshold), ``component_id``
    (smallest id reachable over links, itself included) and ``kept`` (id = component_id).

    Rows of one id with equal vectors count as one vector, those with different vectors add their links
    (each row is returned).  Null, zero, and
    non-finite vectors, vectors with null components and rows with a null id link with nothing; a null
    id has a null component and is not kept.  Vectors of different length do not link.  Equal vectors
    are one class with a count, whatever their number, so a very common vector is one row of a tile.
    """
    spark = vectors.sparkSession
    item = vectors.schema[vector].dataType.elementType
    kind = "float32" if isinstance(item, T.FloatType) else "float64"
    base = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<float>" if kind == "float32" else "array<double>").alias("v"))
    usable = base.filter(F.col("id").isNotNull() & _usable("v"))
    classes = usable.distinct().groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))

    def packed(batches):
        for batch in batches:
            values = batch.column("v")
            flat, edges = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
            raw = [flat[p:q].astype(kind).tobytes() for p, q in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_pydict({"rep": batch.column("rep"), "n": batch.column("n"), "raw": pa.array(raw, pa.binary()),
                                              "size": pa.array(np.diff(edges), pa.int32())})

    id_type = vectors.schema[id_column].dataType.simpleString()
    # one id may stand for several vectors: rows of a tile are numbered, ids only name them
    reps = _written(classes.mapInArrow(packed, f"rep {id_type}, n long, raw binary, size int"), "vectors")
    count, dim = reps.agg(F.count(F.lit(1)), F.max("size")).first()
    if not count:
        return vectors.select(F.col(id_column), F.lit(0).cast("long").alias("n_links"), F.col(id_column).alias("component_id"),
                              F.coalesce(F.col(id_column) == F.col(id_column), F.lit(False)).alias("kept"))
    axes = principal_axes(reps, kind, dim)
    width = min(max(count // BLOCKS, BLOCK_LEAST), BLOCK_MOST)

    def leading(batches):
        for batch in batches:
            x = stack(batch.column("raw").to_pylist(), np.asarray(batch.column("size")), kind, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x @ axes[:, 0])], [*batch.schema.names, "first"])

    placed = _written(reps.mapInArrow(leading, f"rep {id_type}, n long, raw binary, size int, first double"), "placed")
    placed = placed.withColumn("cell", F.floor((F.col("first") + 1) * (CELLS / 2)).cast("int"))
    cells = sorted(map(tuple, placed.groupBy("cell").agg(F.count(F.lit(1))).collect()))
    # neighbouring cells form a bucket of about one block; a fuller bucket is split by hash
    buckets, filled = [], width
    for cell, rows in cells:
        if filled >= width:
            buckets.append([])
            filled = 0
        buckets[-1].append((cell, rows))
        filled += rows
    parts = [max(1, -(-sum(r for _, r in b) // (2 * width))) for b in buckets]
    offset = np.concatenate([[0], np.cumsum(parts)])
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    lows = np.array([b[0][0] for b in buckets]) * (2 / CELLS)
    last = [int(offset[np.searchsorted(lows, (b[-1][0] + 1) * (2 / CELLS) + reach, side="right")]) - 1 for b in buckets]
    ends = np.repeat(last, parts)  # of each block, the last block it meets
    starts = np.searchsorted(ends, np.arange(len(ends)))  # and the first one that meets it
    plan = spark.createDataFrame([(cell, int(offset[k]), parts[k]) for k, b in enumerate(buckets) for cell, _ in b], "cell int, offset int, parts int")
    spans = spark.createDataFrame([(k, int(starts[k]), int(ends[k])) for k in range(len(ends))], "block int, first_block int, last_block int")
    blocks = placed.join(F.broadcast(plan), "cell").withColumn("block", (F.col("offset") + F.pmod(F.xxhash64("raw", "rep"), F.col("parts"))).cast("int"))
    blocks = blocks.join(spans, "block").select("rep", "n", "raw", "size", "block", F.explode(F.sequence("first_block", "last_block")).alias("other"))
    tiles = blocks.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).alias("right"),
                          "rep", "n", "raw", "size")

    def compare(key, table):
        raw, sizes_ = table.column("raw").to_pylist(), table.column("size").to_numpy()
        right, n = table.column("right").to_numpy(zero_copy_only=False), table.column("n").to_numpy()
        x = stack(raw, sizes_, kind, dim)
        turned = (x @ axes).astype(np.float32)
        own = key[0].as_py() == key[1].as_py()
        left, other = (np.arange(len(raw)),) * 2 if own else (np.flatnonzero(~right), np.flatnonzero(right))
        i, j = tile_pairs(turned[left], turned[other], threshold)
        i, j = left[i], other[j]
        keep = (i < j) if own else np.ones(len(i), bool)
        keep &= sizes_[i] == sizes_[j]
        i, j = i[keep], j[keep]
        sure = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 20_000]], x[j[k:k + 20_000]]) >= threshold for k in range(0, len(i), 20_000)]) \
            if len(i) else np.zeros(0, bool)
        i, j = i[sure], j[sure]
        found = np.bincount(i, n[j], len(raw)) + np.bincount(j, n[i], len(raw))
        root = local_roots(len(raw), i, j)
        rows = np.flatnonzero(found > 0)
        return pa.table({"rep": table.column("rep").take(pa.array(rows)), "links": found[rows].astype(np.int64),
                         "root": table.column("rep").take(pa.array(root[rows]))})

    found = _written(tiles.groupBy("a", "b").applyInArrow(compare, f"rep {id_type}, links long, root {id_type}"), "tile-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = usable.distinct().join(classes, "v").select("id", "rep", "n")
    per_id = own.join(linked, "rep", "left").groupBy("id").agg(
        F.min("rep").alias("rep"), F.sum(F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    shared = own.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(shared))
    out = base.select("id").join(per_id, "id", "left").join(roots, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
