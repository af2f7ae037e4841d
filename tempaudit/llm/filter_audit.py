"""How filters interact: what every filter removes in every order, by difference arrays over ranks of orders.

Documents are reduced to the set of filters they fail.  Orders of n filters are ranked lexicographically, so that all
orders with one beginning are an interval of ranks.  A document is removed at the first of its failed filters: each
beginning of passed filters that ends in a failed one is an interval in which it goes at that step.  Counts are added at
the interval's start and taken off at its end; a running sum over the ranks then gives every order's numbers at once.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.session import scratch_path, small_table

#: A word, and the characters of filter D.
WORD, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[#$%&*|]"


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders in which a document failing ``mask`` goes at ``step``."""

    def down(mask: int, left: list[int], step: int, rank: int):
        width = factorial(filters - step)
        for i, f in enumerate(left):
            start = rank + i * width
            if mask >> f & 1:
                yield mask, step, start, start + width
            else:
                yield from down(mask, left[:i] + left[i + 1:], step + 1, start)

    return [x for mask in range(1, 1 << filters) for x in down(mask, list(range(filters)), 1, 0)]


def audit(docs: DataFrame, part: Column, fails: dict[str, Column], lost: dict[str, Column]) -> DataFrame:
    """One row per part, order and step: ``part``, ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, a column for each of ``lost`` and ``shapley``.

    ``fails`` names up to seven filters by a letter each, with the condition that fails a row (null: passed).  Every row
    counts once, repeated ones too.  ``kept`` are the part's rows left after the step, ``removed`` those that go at it,
    ``redundant`` those that fail its filter but went before, ``unique_fails`` those that fail no other, and ``shapley`` what its filter
    removes, summed over all orders.  ``lost`` counts, among the removed, the rows for which a condition holds.  All orders
    stand for every part, with zeros where nothing goes; a null part is the empty string; no rows give no parts.

    Rows are counted by part and failed set before anything is shuffled, so a hot part costs no more than another.
    """
    spark, letters = docs.sparkSession, sorted(fails)
    n, orders = len(letters), [*permutations(sorted(fails))]
    if not 1 <= n <= 7 or any(len(x) != 1 for x in letters):
        raise ValueError("one to seven filters, each named by one letter")
    mask = sum((F.when(fails[x], F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters)), F.lit(0))
    counted = _written(docs.select(F.coalesce(part, F.lit("")).alias("part"), mask.alias("mask"), *[
        F.when(c, 1).otherwise(0).alias(f"lost_{name}") for name, c in lost.items()])
        .groupBy("part", "mask").agg(F.count(F.lit(1)).alias("removed"), *[F.sum(f"lost_{x}").alias(x) for x in lost]), "failed-sets")
    sums = ["removed", *lost]

    spans = F.broadcast(small_table(spark, removal_intervals(n), "mask int, step int, first int, after int"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign")))).alias("end")
    changes = counted.join(spans, "mask").select("part", "step", ends, *sums).filter(F.col("end.rank") < len(orders))
    changes = changes.select("part", "step", "end.rank", *[(F.col(c) * F.col("end.sign")).alias(c) for c in sums])
    steps = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    empty = counted.select("part").distinct().select("part", steps).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *[F.lit(0).cast("long").alias(c) for c in sums])
    bits = [F.col("mask").bitwiseAND(1 << i) != 0 for i in range(n)]
    facts = counted.groupBy("part").agg(
        F.sum("removed").alias("total"),
        F.array(*[F.sum(F.when(b, F.col("removed")).otherwise(0)) for b in bits]).alias("failing"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("removed")).otherwise(0)) for i in range(n)]).alias("alone"))

    named = F.broadcast(small_table(spark, [(i, "".join(o)) for i, o in enumerate(orders)], "rank int, filter_order string"))
    line = changes.unionByName(empty).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in sums]).join(named, "rank")
    line = line.join(facts, "part").repartition("part")  # all windows below share this exchange
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({c: F.sum(c).over(along) for c in sums})
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    line = line.withColumn("spot", F.instr(F.lit("".join(letters)), letter) - 1)
    gone = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return line.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), "removed",
        (F.get("failing", F.col("spot")) - F.col("removed")).alias("redundant"), F.get("alone", F.col("spot")).alias("unique_fails"), *lost,
        F.sum("removed").over(Window.partitionBy("part", "spot")).alias("shapley"))


def document_failures(docs: DataFrame, part: str = "source", text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, ``part`` and the conditions ``a`` to ``e`` of every row, from its whole text (null: empty).

    a: under 200 words; b: fewer than half of the words are distinct; c: more than 2 % of the characters are A-Z; d: holds
    one of ``#$%&*|``; e: a smaller id has the same text.  Rows of one id do not count against each other, and a row
    without id neither fails e nor makes others fail it.

    Copies are compared by digest.  The smallest id of each text is found with partial aggregation; rows meet it by
    digest and id together, so a text that stands in a third of all rows is spread like any other.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace("body", "[^A-Z]+", ""))
    base = docs.select(F.col(id_column).alias("doc_id"), F.col(part).alias("part"), body.alias("body")).withColumn("words", words)
    slim = _written(base.select(
        "doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), (F.size("words") < 200).alias("a"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("b"),
        (100 * capitals.cast("long") > 2 * F.length("body").cast("long")).alias("c"), F.col("body").rlike(SYMBOLS).alias("d")), "failures")
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    found = slim.join(firsts, ["digest", "doc_id"], "left")
    return found.select("doc_id", "part", "a", "b", "c", "d", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("e"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five document filters by source, with ``good_lost`` (quality 1) and ``toxic_lost`` (toxic 1).

    A document has a label if one of its label rows (``doc_id``, ``quality``, ``toxic``) says so; labels without a document do not count.
    """
    flagged = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = document_failures(docs).join(flagged, "doc_id", "left")
    return audit(rows, F.col("part"), {x.upper(): F.col(x) for x in "abcde"}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
