"""Mix documents of overlapping sources to target weights by a min-cost flow over membership patterns."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.llm.textops import unused
from tempaudit.session import scratch_path

#: Largest number of membership patterns; the flow over them is solved on the driver.
MAX_PATTERNS = 20_000
#: Rows whose running sum one window orders.
BUCKET_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Mix:
    """``documents``: id, members, size, taken, shares; ``sources``: (source, size, target, routed), nulls last."""

    documents: DataFrame
    sources: list[tuple[str | None, int, float, int]]


def name_order(name: str | None) -> tuple:
    return name is None, name or ""


def capped_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight; none exceeds ``cap`` times its size, and the excess is shared again by weight."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        share = {i: total * weights[i] / weight if weight else 0.0 for i in open_}
        over = {i for i in open_ if share[i] > cap * sizes[i]}
        for i in over or open_:
            target[i] = float(cap * sizes[i]) if over else share[i]
        if not over:
            break
        total -= sum(target[i] for i in over)
        open_ -= over
    return target


def route(patterns: list[tuple[list[int], int]], quotas: list[int], repeats: int) -> list[dict[int, int]]:
    """Words of each pattern given to each source: as much of the quotas as can be met, at least cost.

    The r-th use of a pattern's words costs r - 1, so costs are convex and a pattern's uses are taken in order.
    Augmenting paths leave a pattern with unused words of the current use, may take words back
    from a source that another pattern also serves, and end at a source that lacks words; uses in
    rising order make the paths' costs non-decreasing, which is the successive-shortest-path rule.
    """
    flow = [dict.fromkeys(sources, 0) for sources, _ in patterns]
    lack = list(quotas)
    serves: list[list[int]] = [[] for _ in quotas]
    for p, (sources, _) in enumerate(patterns):
        for s in sources:
            serves[s].append(p)
    for _ in range(repeats):
        left = [size for _, size in patterns]
        for p in sorted(range(len(patterns)), key=lambda p: len(patterns[p][0])):  # the least flexible first
            for s in patterns[p][0]:
                step = min(left[p], lack[s])
                flow[p][s] += step
                left[p] -= step
                lack[s] -= step
        while True:
            reached = {("p", p): None for p in range(len(patterns)) if left[p]}
            queue, goal = deque(reached), None
            while queue and goal is None:
                kind, x = queue.popleft()
                if kind == "p":
                    steps = [("s", s) for s in patterns[x][0]]
                else:
                    steps = [("p", p) for p in serves[x] if flow[p][x]]
                for node in steps:
                    if node not in reached:
                        reached[node] = (kind, x)
                        if node[0] == "s" and lack[node[1]]:
                            goal = node
                            break
                        queue.append(node)
            if goal is None:
                break
            path = [goal]
            while reached[path[-1]] is not None:
                path.append(reached[path[-1]])
            path.reverse()  # pattern, source, pattern, source, ...
            step = min([left[path[0][1]], lack[goal[1]]] + [flow[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)])
            for i in range(0, len(path) - 1, 2):
                flow[path[i][1]][path[i + 1][1]] += step
                if i:
                    flow[path[i][1]][path[i - 1][1]] -= step
            left[path[0][1]] -= step
            lack[goal[1]] -= step
    return flow


def mix(docs: DataFrame, sources: Column, weights, share: float = 1.5, repeats: int = 2, seed: int = 17, text: str = "text",
        id_column: str = "doc_id") -> Mix:
    """Choose how many words of each document the mix takes.

    ``sources``: array of the sources a document belongs to (a null element is a source of its own; a
    null or empty array counts as that).  ``weights``: weight of the i-th source, sources sorted by code
    point and null last.  Targets share ``share`` times all words; see ``capped_targets``.
    ``documents`` has one row per input row: id, ``members``, ``size`` (words; null text: 0), ``taken`` (words,
    repeats counted; at most ``repeats * size``) and ``shares`` (array of source and words).

    Each pattern's words form a sequence in seeded hash order, repeated ``repeats`` times; what the flow
    takes is a prefix, so one document per pattern can be taken in part and every routed quota is met
    exactly.  Equal seeds give equal results; rows that repeat an id and a size are told apart by nothing and
    stand next to each other.  Running sums are taken inside hash buckets of bounded size and
    offset by the buckets' sums, so a source of any size is spread.  There may be at most ``MAX_PATTERNS``
    different memberships (else ValueError); an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    path = scratch_path(spark, "sizes")
    docs.select(F.col(id_column).alias("id"), members.alias("members"), words_in(F.col(text)).alias("size")).write.parquet(path)
    sized = spark.read.parquet(path)
    found = sized.groupBy("members").agg(F.sum("size").alias("cap"), F.count(F.lit(1)).alias("rows")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} different memberships")
    found.sort(key=lambda r: [name_order(m) for m in r.members])
    names = sorted({m for r in found for m in r.members}, key=name_order)
    place = {n: i for i, n in enumerate(names)}
    sizes = [sum(r.cap for r in found if n in r.members) for n in names]
    targets = capped_targets(sizes, [weights(i) for i in range(len(names))], share * sum(r.cap for r in found), repeats)
    flow = route([([place[m] for m in r.members], r.cap) for r in found], [round(t) for t in targets], repeats)
    routed = [sum(f.get(i, 0) for f in flow) for i in range(len(names))]
    plan = []
    for r, f in zip(found, flow):
        pieces, at = [], 0
        for s, words in f.items():
            if words:
                pieces.append((names[s], at, at + words))
                at += words
        buckets = 1
        while buckets * BUCKET_ROWS < r.rows:
            buckets *= 2
        plan.append((r.members, len(plan), r.cap, at, buckets, pieces))
    plan = F.broadcast(spark.createDataFrame(plan, "m array<string>, pattern int, cap long, flow long, buckets int, "
                                                   "pieces array<struct<source: string, lo: long, hi: long>>"))
    order = F.xxhash64(F.lit(seed), F.col("id"))
    rows = sized.join(plan.select("m", "pattern", "buckets"), F.col("members").eqNullSafe(F.col("m"))).drop("m").withColumn("h", order)
    rows = rows.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.col("buckets")).cast("long"))
    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")).selectExpr(
        "pattern", "bucket", "sum(words) OVER (PARTITION BY pattern ORDER BY bucket) - words AS before")
    inside = rows.selectExpr("*", "sum(size) OVER (PARTITION BY pattern, bucket ORDER BY h, id, size ROWS UNBOUNDED PRECEDING) - size AS inner")
    placed = inside.join(sums, ["pattern", "bucket"]).join(plan.drop("buckets"), "pattern").withColumn("at", F.expr("before + inner"))
    uses = "sequence(0, %d)" % (repeats - 1)
    overlap = "greatest(0L, least({hi}, at + u * cap + size) - greatest({lo}, at + u * cap))"
    shares = F.expr(f"""filter(transform(pieces, p -> struct(p.source AS source,
        aggregate({uses}, 0L, (s, u) -> s + {overlap.format(lo='p.lo', hi='p.hi')}) AS words)), p -> p.words > 0)""")
    taken = F.expr(f"aggregate({uses}, 0L, (s, u) -> s + {overlap.format(lo='0L', hi='flow')})")
    out = placed.select(F.col("id").alias(id_column), "members", "size", taken.alias("taken"), shares.alias("shares"))
    return Mix(out, list(zip(names, sizes, targets, routed)))


def cycled(*weights: float):
    """Weights that repeat over the sources."""
    return lambda i: weights[i % len(weights)]


def mixed_rows(docs: DataFrame, chosen: Mix, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes its text, rounded to whole uses; unused ones go.

    Rows with one id share their uses evenly, rounded.  Documents without words go.
    """
    key, times, use = unused(docs, "_id"), unused(docs, "_uses"), unused(docs, "_use")
    uses = chosen.documents.groupBy(F.col(id_column).alias(key)).agg(F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias(times))
    uses = uses.filter(F.col(times) > 0)
    out = docs.join(uses.hint("merge"), F.col(id_column).eqNullSafe(F.col(key))).withColumn(use, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.drop(key, times, use)
