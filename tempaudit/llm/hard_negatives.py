"""Hard negatives by exact inner products, over blocks of candidates that zone maps let in.

Vectors are whole numbers.  Candidates of one label are sorted along a Hilbert curve through the dimensions that vary
most and cut into blocks, stored as Parquet with the least and greatest value of every dimension of each block.  An
anchor's products with a block lie in an interval that follows from these (interval arithmetic): the block is read only if
the interval meets what the anchor still looks for, which is its best rows of its own label first and then the windows
of scores that its positives open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.llm import hilbert
from tempaudit.llm.sharding import ordered
from tempaudit.session import scratch_path

#: Rows of a candidate block and of an anchor block; a tile holds one of each.
BLOCK, ANCHORS = 1024, 512
#: Blocks of candidates whose zone maps one task compares with an anchor block.
ZONES = 512
#: Dimensions of the curve, and bits of each.
CURVE_DIMS, CURVE_BITS = 4, 6
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Negatives score from so many to so many hundredths of the positive's score.
WINDOW = (50, 95)
#: Whole numbers below this are exact in double precision.
EXACT = 2 ** 53


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def usable(vectors: DataFrame, vector: str, id_column: str, label: str) -> DataFrame:
    """``id``, ``label``, ``v`` (whole numbers) of the rows that take part; of several rows with one id the least by label and vector."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & F.col(label).isNotNull() & F.col(id_column).isNotNull()).filter(finite).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def moved_labels(rows: DataFrame, every: int, labels: int) -> DataFrame:
    """Rows whose id is divisible by ``every`` get the next label, modulo the number of labels."""
    return rows.withColumn("label", F.when(F.pmod("id", F.lit(every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def matrix(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Vectors of bytes as rows of whole numbers, shorter ones filled with zeros."""
    sizes = np.array([len(x) for x in raw], np.int64) // np.dtype(kind).itemsize
    out = np.zeros((len(raw), dim), np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out[rows, :size] = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), size)
    return out


def exact(a: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as doubles if 100 times a product of their rows is exact so, else as Python's whole numbers."""
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, *others)]
    fits = 100 * most[0] * max(most[1:]) * max(1, a.shape[1]) < EXACT
    return [x.astype(np.float64 if fits else object) for x in (a, *others)]


def in_range(scores: np.ndarray) -> np.ndarray:
    """Scores beyond the range of a long count as its ends."""
    return np.clip(scores, -2 ** 63, 2 ** 63 - 1) if scores.dtype == object else scores


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = exact(a, b)
    return in_range(a @ b.T)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every anchor with any row between ``low`` and ``high`` of every block."""
    a, low, high = exact(anchors, low, high)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return in_range(up @ low.T + down @ high.T), in_range(up @ high.T + down @ low.T)


def first(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n highest allowed scores of every row; of equal ones the smaller columns."""
    rows, columns = scores.shape
    n = min(n, columns)
    if scores.dtype == object or columns * float(np.abs(scores).max(initial=0)) >= EXACT:
        picked = [sorted(np.flatnonzero(allowed[i]).tolist(), key=lambda j, s=scores[i]: (-s[j], j))[:n] for i in range(rows)]
        return np.repeat(np.arange(rows), [len(p) for p in picked]), np.array([j for p in picked for j in p], np.int64)
    key = np.where(allowed, np.arange(columns) - scores * columns, np.inf)
    at = np.argpartition(key, n - 1, axis=1)[:, :n]
    i, j = np.repeat(np.arange(rows), n), at.ravel()
    keep = allowed[i, j]
    return i[keep], j[keep]


def longs(values) -> pa.Array:
    return pa.array([int(x) for x in values], pa.int64())


def on_curve(rows: DataFrame) -> tuple[DataFrame, int, str]:
    """``id``, ``label``, ``raw`` (the vector's bytes) and ``curve`` of every row, the largest dimension, and the kind of number.

    The curve runs through the dimensions of the greatest variance, each cut into equal steps within two deviations of its mean.
    """
    def packed(batches):
        for batch in batches:
            values = batch.column("v")
            flat, edges = values.flatten().to_numpy(), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy())])
            raw = [flat[p:q].astype(np.int64).tobytes() for p, q in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(raw, pa.binary())], ["id", "label", "raw"])

    flat = _written(rows.mapInArrow(packed, "id long, label long, raw binary"), "vectors")
    dim = int((flat.agg(F.max(F.octet_length("raw"))).first()[0] or 0) // 8)

    def moments(batches):
        count, total, squares, most = 0, np.zeros(dim), np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = matrix(batch.column("raw").to_pylist(), dim, "int64").astype(float)
            count, total, squares, most = count + len(x), total + x.sum(0), squares + (x * x).sum(0), np.maximum(most, np.abs(x).max(0, initial=0))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "n": pa.array([count] * dim, pa.int64()), "total": total,
                                          "squares": squares, "most": most})

    stats = flat.mapInArrow(moments, "i int, n long, total double, squares double, most double").groupBy("i").agg(
        F.sum("total") / F.sum("n"), F.sum("squares") / F.sum("n"), F.max("most")).collect()
    most = max((r[3] for r in stats), default=0)
    kind = next(k for k, top in (("int16", 2 ** 15 - 1), ("int32", 2 ** 31 - 1), ("int64", float("inf"))) if most <= top)
    spread = sorted(((max(0.0, s - m * m), -i, m) for i, m, s, _ in stats), reverse=True)[:CURVE_DIMS]
    axes, means = [-i for _, i, _ in spread], np.array([m for _, _, m in spread])
    widths = np.array([max(v, 1e-9) ** 0.5 for v, _, _ in spread]) / 2 ** (CURVE_BITS - 2)

    def placed(batches):
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            curve = np.zeros(len(raw), np.int64)
            if axes:
                x = matrix(raw, dim, "int64")[:, axes].astype(float)
                steps = np.clip((x - means) / widths + 2 ** (CURVE_BITS - 1), 0, 2 ** CURVE_BITS - 1).astype(np.int64)
                curve = hilbert.indexes(steps, CURVE_BITS)
            small = [np.frombuffer(x, np.int64).astype(kind).tobytes() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(small, pa.binary()), pa.array(curve)],
                                             ["id", "label", "raw", "curve"])

    return flat.mapInArrow(placed, "id long, label long, raw binary, curve long"), dim, kind


def blocks(rows: DataFrame, dim: int, kind: str, every: int) -> DataFrame:
    """The rows as candidates in curve order: ``block``, ``zone`` (at a block's first row) and ``seed`` (at anchors).

    A block holds at most ``BLOCK`` rows of one label and one partition; its number is unique.  The zone is the bytes of the least
    and of the greatest value of every dimension.  The seed is the score of the last positive an anchor would have in its own
    block, null if the block has too few: no block whose bound is less can give it a better one.
    """
    def cut(batches: Iterator[pa.RecordBatch]):
        number = 0
        for batch in batches:
            label = np.asarray(batch.column("label"))
            edges = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:]):
                for lo in range(start, end, BLOCK):
                    part = batch.slice(lo, min(BLOCK, end - lo))
                    x = matrix(part.column("raw").to_pylist(), dim, kind)
                    ids = np.asarray(part.column("id"))
                    seed = [None] * len(ids)
                    anchors = np.flatnonzero(ids % every == 0)
                    if len(ids) > POSITIVES:
                        scores = products(x[anchors], x)
                        scores[np.arange(len(anchors)), anchors] = -2 ** 63
                        for i, row in zip(anchors.tolist(), np.sort(scores, 1)):
                            seed[i] = int(row[-POSITIVES])
                    zone = [np.concatenate([x.min(0), x.max(0)]).tobytes(), *[None] * (len(ids) - 1)]
                    task = part.column("part")[0].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("id", "label", "raw", "curve")), pa.array([(task << 32) + number] * len(ids), pa.int64()),
                         pa.array(zone, pa.binary()), pa.array(seed, pa.int64())], ["id", "label", "raw", "curve", "block", "zone", "seed"])
                    number += 1

    order = ["label", "curve", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return _written(ranged.mapInArrow(cut, "id long, label long, raw binary, curve long, block long, zone binary, seed long"), "blocks")


def wanted_tiles(anchors: DataFrame, groups: int, candidates: DataFrame, dim: int, kind: str, own: bool) -> DataFrame:
    """(``team``, ``block``) of the blocks that some anchor of the team must read, by interval arithmetic on the zone maps.

    With ``own``, blocks of an anchor's label whose greatest possible score reaches its ``seed``; else blocks of other labels whose
    interval of scores meets the window of one of its ``positives``.  Zone maps are dealt out in chunks, and a task meets one
    team with one chunk.
    """
    zones = candidates.filter("zone IS NOT NULL").select("block", "label", "zone")
    chunks = max(1, -(-zones.count() // ZONES))
    spread = anchors.select("team", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(None).cast("long").alias("block"),
                            "label", "raw", "seed", "positives")
    zones = zones.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("team"), F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"),
                         "block", "label", F.col("zone").alias("raw"), F.lit(None).cast("long").alias("seed"),
                         F.lit(None).cast("array<long>").alias("positives"))

    def choose(key, table):
        block = table.column("block")
        zone, anchor = table.filter(block.is_valid()), table.filter(block.is_null())
        if not anchor.num_rows or not zone.num_rows:
            return pa.table({"team": pa.array([], pa.int32()), "block": pa.array([], pa.int64())})
        x = matrix(anchor.column("raw").to_pylist(), dim, kind)
        edges = np.frombuffer(b"".join(zone.column("raw").to_pylist()), np.int64).reshape(zone.num_rows, 2, dim)
        least, most = bounds(x, edges[:, 0], edges[:, 1])
        same = np.asarray(anchor.column("label"))[:, None] == np.asarray(zone.column("label"))[None, :]
        if own:
            seed = np.array([-2 ** 63 if s is None else s for s in anchor.column("seed").to_pylist()], object if most.dtype == object else float)
            need = same & (most >= seed[:, None])
        else:
            need = np.zeros(same.shape, bool)
            for ps in slots(anchor.column("positives").to_pylist(), most.dtype):
                need |= ~same & in_window(most, ps, low=True) & in_window(least, ps, high=True)
        found = np.flatnonzero(need.any(0))
        return pa.table({"team": pa.array([key[0].as_py()] * len(found), pa.int32()), "block": zone.column("block").take(pa.array(found))})

    return _written(spread.unionByName(zones).groupBy("team", "chunk").applyInArrow(choose, "team int, block long"), "tiles")


def slots(positives: list[list[int]], kind) -> Iterator[np.ndarray]:
    """For each place among the positives, every anchor's score there as a column; NaN (or none) where it has no such positive."""
    for k in range(max(map(len, positives), default=0)):
        yield np.array([p[k] if k < len(p) else None for p in positives], object if kind == object else float)[:, None]


def in_window(scores: np.ndarray, positive: np.ndarray, low: bool = False, high: bool = False) -> np.ndarray:
    """Where scores lie at or above the window's lower end, at or below its upper end."""
    if scores.dtype == object:
        known = np.array([[p is not None] for p in positive[:, 0]])
        positive = np.where(known, positive, 0)
        out = np.broadcast_to(known, scores.shape).copy()
    else:
        out = np.broadcast_to(~np.isnan(positive), scores.shape).copy()
    with np.errstate(invalid="ignore"):
        if low:
            out &= (100 * scores >= WINDOW[0] * positive).astype(bool)
        if high:
            out &= (100 * scores <= WINDOW[1] * positive).astype(bool)
    return out


def compared(anchors: DataFrame, candidates: DataFrame, tiles: DataFrame, dim: int, kind: str, own: bool) -> DataFrame:
    """``id``, ``place``, ``other``, ``score``: each wanted block's best rows for every anchor of the team.

    With ``own`` these are its best rows of the same label (place 0), else the best rows of other labels in the window of each of its
    positives, by the positive's place.  A tile has at most ``ANCHORS`` and ``BLOCK`` rows.
    """
    none = F.lit(None).cast("array<long>").alias("positives")
    sides = tiles.join(anchors, "team").select("team", "block", F.lit(True).alias("anchor"), "id", "label", "raw", "positives").unionByName(
        tiles.join(candidates.select("block", "id", "label", "raw"), "block").select("team", "block", F.lit(False).alias("anchor"), "id", "label", "raw", none))

    def compare(table):
        is_anchor = table.column("anchor")
        a, b = table.filter(is_anchor), table.filter(pa.compute.invert(is_anchor))
        b = b.sort_by("id")
        scores = products(matrix(a.column("raw").to_pylist(), dim, kind), matrix(b.column("raw").to_pylist(), dim, kind))
        ids, others = np.asarray(a.column("id")), np.asarray(b.column("id"))
        same = np.asarray(a.column("label"))[:, None] == np.asarray(b.column("label"))[None, :]
        if own:
            looks = [(same & (ids[:, None] != others[None, :]), POSITIVES)]
        else:
            looks = [(~same & in_window(scores, ps, True, True), NEGATIVES) for ps in slots(a.column("positives").to_pylist(), scores.dtype)]
        out = [(np.full(len(i), k), ids[i], others[j], scores[i, j]) for k, (allowed, n) in enumerate(looks) for i, j in [first(scores, allowed, n)]]
        place, one, two, score = (np.concatenate([o[k] for o in out]) if out else [] for k in range(4))
        return pa.table({"id": longs(one), "place": pa.array(place, pa.int32()), "other": longs(two), "score": longs(score)})

    found = sides.groupBy("team", "block").applyInArrow(compare, "id long, place int, other long, score long")
    rank = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= (POSITIVES if own else NEGATIVES))


def mine(rows: DataFrame, every: int) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``id``, ``label``, ``v`` (see ``usable``).  Anchors are the rows whose id is divisible by ``every``.  A score is the inner
    product with the anchor; higher ones come first, equal ones by id.  Positives are the anchor's first five other rows of its
    label; for each, the first three rows of other labels with 50 % to 95 % of its score follow, in order of rank.  An anchor without such
    rows has none.  Shorter vectors are taken as filled with zeros, the empty one scores 0.  No rows give no rows.

    Zone maps only spare reading: results are those of comparing every anchor with every row.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    placed, dim, kind = on_curve(rows)
    candidates = blocks(placed, dim, kind, every)
    teams = ordered(candidates.filter(F.pmod("id", F.lit(every)) == 0).select("id", "label", "raw", "curve", "seed"), ["label", "curve", "id"])
    teams = _written(teams.withColumn("team", F.expr(f"before div {ANCHORS}").cast("int")).drop("curve", "before", "total"), "anchors")
    groups = teams.agg(F.max("team")).first()[0]
    if groups is None:
        return spark.createDataFrame([], schema)
    anchors = teams.withColumn("positives", F.lit(None).cast("array<long>"))
    tiles = wanted_tiles(anchors, groups + 1, candidates, dim, kind, True)
    best = _written(compared(anchors, candidates, tiles, dim, kind, True), "positives")
    listed = best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p")).select("id", F.col("p.score").alias("positives"))
    anchors = teams.join(listed, "id")
    tiles = wanted_tiles(anchors, groups + 1, candidates, dim, kind, False)
    chosen = compared(anchors, candidates, tiles, dim, kind, False)
    named = best.select(F.col("id").alias("anchor_id"), (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return chosen.withColumnRenamed("id", "anchor_id").join(named, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
