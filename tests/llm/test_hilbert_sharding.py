import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempaudit.llm import hilbert, sharding


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_and_moves_to_a_neighbour(spark, dims, bits):
    points = np.array([*product(range(1 << bits), repeat=dims)])
    places = hilbert.indexes(points, bits)
    assert sorted(places.tolist()) == list(range(len(points)))
    walk = points[np.argsort(places)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    df = spark.createDataFrame([(*map(int, p), i) for i, p in enumerate(points)], ", ".join([*(f"x{i} int" for i in range(dims)), "_state long"]))
    got = hilbert.with_index(df, [F.col(f"x{i}") for i in range(dims)], bits, "h")
    assert got.columns == [*df.columns, "h"]
    assert all(r.h == places[r._state] for r in got.collect())


def check_law(rows, shards):
    counts = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_documents_against_brute_force(spark, odd_texts, docs):
    sources = [None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}" for i in range(len(odd_texts))]
    table = docs(odd_texts, sources).withColumn("shard", F.lit("x")).withColumn("curve", F.lit(1)).withColumn("_at", F.lit(1))
    table = table.unionByName(table.filter("doc_id % 5 = 0")).unionByName(table.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard_documents(table, 8).collect()
    check_law(rows, 8)
    want = sorted([(-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in
                   [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    again = sharding.shard_documents(table.repartition(7), 8).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_few_and_no_rows(spark, docs, empty_docs):
    assert sharding.shard_documents(empty_docs, 8).count() == 0
    rows = sharding.shard_documents(docs(["a", "b", None]), 8).collect()
    check_law(rows, 8)


def test_bins_hold_equal_shares(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.when(F.col("id") < 400, "hot").when(F.col("id") < 990, F.concat(
        F.lit("k"), F.col("id"))).alias("s"))
    assert sharding.bin_edges(df, "x", 4) == [250, 500, 750]
    edges = sharding.bin_edges(df, "s", 8)
    sizes = [r["count"] for r in df.select(sharding.binned(F.col("s"), edges).alias("b")).groupBy("b").count().collect()]
    assert len(edges) < 8 and max(sizes) < 400 + 2 * 990 / 8  # the hot value shares its bin with few


def test_files_are_pruned_in_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, f"s{int(a)}", int(b)) for i, (a, b) in enumerate(zip(rng.integers(0, 64, 4000), rng.integers(0, 10_000, 4000)))]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    sharding.write_shards(df, str(tmp_path / "shards"), ["source", "size"], 16, ["doc_id"])
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(tuple(r) for r in back.select("doc_id", "source", "size").collect()) == rows
    zones = back.groupBy("shard").agg(F.min("source").alias("a"), F.max("source").alias("b"), F.min("size").alias("c"), F.max("size").alias("d")).collect()
    assert len(zones) == 16
    assert np.mean([sum(z.a <= s <= z.b for z in zones) for _, s, _ in rows]) <= 7
    assert np.mean([sum(z.c <= n <= z.d for z in zones) for _, _, n in rows]) <= 7


def test_plan_has_no_python(spark, docs):
    plan = sharding.shard_documents(docs(["a", "b"]), 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
