"""Near-duplicate texts: n-gram Jaccard similarity with a MinHash LSH forest and exact verification.

Each distinct shingle set gets a signature of several trees, each a short sequence of minimum hashes.
Sorted by these sequences, texts that share a prefix are neighbours, as in a prefix trie.
Prefixes are shortened step by step, from full length to the depth at which the trees together
find a pair at the threshold with the target recall; texts joined at a longer prefix go on as one.
The groups so found are compared pair by pair on their whole shingle sets, in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempaudit.llm.graph import components, local_roots
from tempaudit.llm.textops import Hasher, find_words, mix, over_texts, text_chunks, unused, windows
from tempaudit.session import scratch_path

SIMILARITY = 0.8
NGRAM = 5
TREES, DEEPEST = 24, 8
TARGET_RECALL = 0.999
#: Bounds of one side of a tile: texts, and shingles in all.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 400_000
#: A group of many small texts is cut into so many blocks at least, so that its tiles spread over the tasks.
SPREAD = 24
#: Columns of shingles multiplied at a time.
COLUMNS = 4096

_RNG = np.random.default_rng(97)
_ODD = _RNG.integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def floor_depth(similarity: float, target: float) -> int:
    """Longest prefix at which all trees together find a pair of that similarity with the target recall."""
    for depth in range(DEEPEST, 1, -1):
        if 1 - (1 - similarity ** depth) ** TREES >= target:
            return depth
    return 1


def shingles(data: np.ndarray, bounds: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as (text, hash) sorted by both; a text of fewer words is one shingle."""
    words = find_words(data, bounds)
    keys = Hasher(data).ranges(words.start, words.end)
    at, grams = windows(keys, words.doc, n)
    doc = words.doc[at]
    count = np.bincount(words.doc, minlength=len(bounds) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        edges = np.concatenate([[0], np.cumsum(count)])
        doc = np.concatenate([doc, short])
        grams = np.concatenate([grams, [mix((keys[edges[i]:edges[i + 1]] * mix(np.arange(2, count[i] + 2))).sum(keepdims=True))[0] for i in short]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def set_hashes(grams: np.ndarray) -> tuple[int, int]:
    """Two order-free hashes of one shingle set."""
    sums = np.array([grams.sum(), mix(grams ^ _ODD[0]).sum()], np.uint64).view(np.int64)
    return int(sums[0]), int(sums[1])


def signatures(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """Per row the id, the number of shingles, two hashes of the set and the minimum hashes of all trees."""
    def work(rows, data, bounds):
        n = len(bounds) - 1
        doc, grams = shingles(data, bounds)
        size = np.bincount(doc, minlength=n)
        full = np.flatnonzero(size)
        first = np.concatenate([[0], np.cumsum(size[full])])[:-1].astype(np.int64)
        table = np.zeros((n, TREES * DEEPEST), np.uint32)
        one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if len(full):
            for k, odd in enumerate(_ODD):
                table[full, k] = np.minimum.reduceat(grams * odd, first) >> np.uint64(32)
            one[full], two[full] = np.add.reduceat(grams, first), np.add.reduceat(mix(grams ^ _ODD[0]), first)
        return {id_column: rows.column(rows.schema.get_field_index(id_column)), "size": size, "one": one.view(np.int64), "two": two.view(np.int64),
                "signature": pa.array([r.tobytes() for r in table], pa.binary())}

    id_type = docs.schema[id_column].dataType.simpleString()
    return over_texts(docs.select(id_column, text), work, f"`{id_column}` {id_type}, size long, one long, two long, signature binary", text)


def trie_links(labels: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, row) between rows whose sequences share a prefix, longest prefixes first, and the rows left as leaders."""
    order = np.lexsort(labels.T[::-1])
    ordered, alive = labels[order], np.arange(len(order))
    rows, heads = [], []
    for depth in range(labels.shape[1], floor - 1, -1):
        part = ordered[alive, :depth]
        begins = np.ones(len(alive), bool)
        begins[1:] = (part[1:] != part[:-1]).any(1)
        head = alive[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        rows.append(order[alive[~begins]])
        heads.append(order[head[~begins]])
        alive = alive[begins]
    return np.concatenate(rows), np.concatenate(heads), order[alive]


def candidate_links(reps: DataFrame, floor: int) -> DataFrame:
    """Links ``u``, ``v`` that join every group of texts sharing a prefix of the floor depth in some tree.

    Each batch is searched first, longest prefixes first, and hands on one leader per prefix of the floor
    depth, so a prefix shared by any number of texts is shuffled once per batch; there the leaders of all
    batches meet.
    """
    width = DEEPEST * 4

    def inside(batches):
        for batch in batches:
            rep = np.asarray(batch.column("rep"))
            table = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(len(rep), TREES, DEEPEST)
            us, vs = [], []
            for tree in range(TREES):
                labels = np.ascontiguousarray(table[:, tree])
                a, b, leaders = trie_links(labels, floor)
                us.append(rep[a])
                vs.append(rep[b])
                raw = labels[leaders].tobytes()
                prefix = mix(Hasher(np.frombuffer(raw, np.uint8)).ranges(np.arange(len(leaders)) * width, np.arange(len(leaders)) * width + floor * 4)
                             + np.uint64(tree)) if len(leaders) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_pydict({"u": rep[leaders], "v": pa.nulls(len(leaders), pa.int64()), "prefix": prefix.view(np.int64)})
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"u": pairs[:, 0], "v": pairs[:, 1], "prefix": pa.nulls(len(pairs), pa.int64())})

    schema = "u long, v long, prefix long"
    path = scratch_path(reps.sparkSession, "forest")
    reps.select("rep", "signature").mapInArrow(inside, schema).write.parquet(path)
    forest = reps.sparkSession.read.parquet(path)
    leaders = forest.filter("prefix IS NOT NULL").select("prefix", "u")

    def across(batches):
        last, head = None, None
        for batch in batches:
            prefix, u = np.asarray(batch.column("prefix")), np.asarray(batch.column("u"))
            if not len(u):
                continue
            begins = np.ones(len(u), bool)
            begins[1:] = prefix[1:] != prefix[:-1]
            begins[0] = last is None or prefix[0] != last
            place = np.cumsum(begins) - 1
            heads = u[np.flatnonzero(begins)]
            if not begins[0]:
                heads, place = np.append(head, heads), place + 1
            last, head = prefix[-1], heads[-1]
            rows = np.flatnonzero(~begins)
            yield pa.RecordBatch.from_pydict({"u": u[rows], "v": heads[place[rows]]})

    met = leaders.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(across, "u long, v long")
    return forest.filter("prefix IS NULL").select("u", "v").unionByName(met)


def similar(size_a, size_b, both, threshold: float):
    return both >= threshold * (size_a + size_b - both) - 1e-9


def compare_texts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of left, one of right) of shingle sets at or above the threshold, from exact counts."""
    size = np.array([len(s) for s in sets])
    if len(left) * len(right) <= 16:
        pairs = [(i, j) for i in left for j in right if i != j and similar(size[i], size[j], len(np.intersect1d(sets[i], sets[j], True)), threshold)]
        return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)
    owner = np.repeat(np.arange(len(sets)), size)
    _, where = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(where)[where] > 1
    _, column = np.unique(where[shared], return_inverse=True)
    owner = owner[shared]
    place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
    place_a[left], place_b[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        c, o = column[a:b] - lo, owner[a:b]
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        in_a, in_b = place_a[o] >= 0, place_b[o] >= 0
        x[place_a[o[in_a]], c[in_a]] = 1
        y[place_b[o[in_b]], c[in_b]] = 1
        both += x @ y.T
    i, j = np.nonzero(similar(size[left][:, None], size[right][None, :], both, threshold))
    return left[i], right[j]


def verified_links(texts: DataFrame, threshold: float) -> DataFrame:
    """Per tile and text ``rep``: copies of the texts it links to, and a ``root`` it is connected to in the tile.

    ``texts``: group, a, b (the tile), right, rep, n, text; rows of a tile come together and in order.
    """
    def finish(reps, counts, sides, sets, own):
        keep = np.array(sides)
        every = np.arange(len(reps))
        left, right = (every, every) if own else (np.flatnonzero(~keep), np.flatnonzero(keep))
        i, j = compare_texts(sets, left, right, threshold)
        if own:
            i, j = i[i < j], j[i < j]
        n = np.array(counts)
        found = np.bincount(i, n[j], len(reps)) + np.bincount(j, n[i], len(reps))
        root = local_roots(len(reps), i, j)
        rows, names = np.flatnonzero(found), np.array(reps, np.int64)
        return pa.RecordBatch.from_pydict({"rep": names[rows], "links": found[rows].astype(np.int64), "root": names[root[rows]]})

    def run(batches):
        tile, held, seen = None, ([], [], [], []), set()
        for batch in batches:
            for rows, data, bounds in text_chunks(batch, "text"):
                doc, grams = shingles(data, bounds)
                edges = np.searchsorted(doc, np.arange(len(bounds)))
                columns = [rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("group", "a", "b", "rep", "n", "right", "one", "two")]
                for k, (group, a, b, rep, n, right, one, two) in enumerate(zip(*columns)):
                    if (group, a, b) != tile:
                        if len(held[0]) > 1:
                            yield finish(*held, tile[1] == tile[2])
                        tile, held, seen = (group, a, b), ([], [], [], []), set()
                    mine = grams[edges[k]:edges[k + 1]]
                    # an id may have other texts, and a row may be repeated
                    if set_hashes(mine) == (one, two) and (one, two) not in seen:
                        seen.add((one, two))
                        for into, value in zip(held, (rep, n, right, mine)):
                            into.append(value)
        if len(held[0]) > 1:
            yield finish(*held, tile[1] == tile[2])

    ordered = texts.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b")
    return ordered.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = SIMILARITY,
                    target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per input row: the id, ``class_id`` (smallest id reachable over links, itself included),
    ``n_links`` (other documents with a Jaccard similarity of five-word shingles >= threshold) and
    ``copy_of`` (smallest id with the same shingle set).

    Words are case-sensitive; a text of fewer than five words is one shingle.  Null, empty and blank
    texts and rows with a null id link with nothing (a null id has a null class).  Rows that repeat an id and its
    text count once; an id with several texts joins their links.  Ids are integers.

    Documents with one shingle set are one row from the first step on.  Candidates of the forest are
    joined to groups; a group is cut into blocks by hash and every pair of blocks is one tile, so a
    group of any size is compared whole, with no pair emitted: tiles return counts and a spanning star.
    """
    spark = docs.sparkSession

    def written(df, label):
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    base = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = written(signatures(base, "text", "doc"), "signatures")
    full = signed.filter("size > 0 AND doc IS NOT NULL")
    own = written(full.select("doc", "one", "two", "size").distinct(), "sets")
    classes = written(own.groupBy("one", "two").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size")), "classes")
    keys = ["doc", "one", "two"]
    reps = full.select(*keys, "signature").join(classes.select(F.col("rep").alias("doc"), "one", "two"), keys).dropDuplicates(keys)
    groups = components(candidate_links(reps.select(F.col("doc").alias("rep"), "signature"), floor_depth(threshold, target_recall)))
    members = written(groups.join(classes, groups.node == classes.rep).select(F.col("root").alias("group"), "rep", "n", "size", "one", "two"), "groups")
    texts, words = F.count(F.lit(1)), F.sum("size")
    blocks = F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(words / BLOCK_SHINGLES), F.least(F.ceil(texts / 64), F.lit(SPREAD)))
    plan = members.groupBy("group").agg(blocks.cast("int").alias("blocks"))
    placed = members.join(plan, "group").withColumn("block", F.pmod(F.xxhash64("one"), F.col("blocks")).cast("int"))
    # both sides are shuffled at every size: a group may hold any share of the texts
    tiles = base.join(placed.hint("merge"), base.doc == placed.rep).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("block") > F.col("other")).alias("right"),
        "rep", "n", "one", "two", "text")
    found = written(verified_links(tiles, threshold), "verified")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = own.join(classes.select("one", "two", "rep"), ["one", "two"])
    several = named.groupBy("doc").agg(F.min("rep").alias("u"), F.max("rep").alias("v")).filter("u <> v").select("u", "v")
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).unionByName(several))
    per_class = classes.join(linked, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "one", "two", "rep", F.coalesce("root", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    per_class = written(per_class, "class-links")  # so that a class of very many copies is a plain join, which can be split
    per_doc = own.join(per_class, ["one", "two"]).groupBy("doc").agg(
        F.min("rep").alias("copy_of"), F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
    out = signed.select("doc").join(per_doc, "doc", "left")
    return out.select(F.col("doc").alias(id_column), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.coalesce("copy_of", "doc").alias("copy_of"))


def one_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose id is their class's smallest; all columns stay.  Rows with a null id stay, as they are in no class."""
    found = near_duplicates(docs, text, id_column, threshold)
    key = unused(docs, "_gone")
    gone = found.filter(F.col(id_column) != F.col("class_id")).select(F.col(id_column).alias(key)).distinct()
    return docs.join(gone.hint("merge"), F.col(id_column) == F.col(key), "left_anti")
