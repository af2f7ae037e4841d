import re
from itertools import permutations

from pyspark.sql import functions as F

from tempaudit.llm import filter_audit


def brute(rows, lost, letters):
    """rows: (part, {failed letters}, {lost columns})."""
    out, orders = {}, ["".join(p) for p in permutations(letters)]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        sums = dict.fromkeys(letters, 0)
        for order in orders:
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                sums[x] += len(gone)
                out[part, order, step] = [x, len(left), len(gone), sum(x in r[1] for r in own) - len(gone), sum(r[1] == {x} for r in own),
                                          *[sum(k in r[2] for r in gone) for k in lost]]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[v[0]])
    return {k: v[1:] for k, v in out.items()}


def found(df, lost):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, *[r[k] for k in lost], r.shapley] for r in df.collect()}


def test_intervals_cover_each_order_once():
    for n in (1, 3, 5):
        for mask in range(1, 1 << n):
            spans = [x for x in filter_audit.removal_intervals(n) if x[0] == mask]
            assert sorted(r for _, _, a, b in spans for r in range(a, b)) == list(range(len([*permutations(range(n))])))
            for rank, order in enumerate(permutations(range(n))):
                step = next(i for i, f in enumerate(order, 1) if mask >> f & 1)
                assert any(s == step and a <= rank < b for _, s, a, b in spans)


def failed(doc, docs):
    i, text = doc
    text, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
    out = set()
    out |= {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    return out | ({"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t in docs) else set())


def test_documents_against_brute_force(spark, odd_texts, docs):
    sources = [None if i % 9 == 0 else "" if i % 9 == 1 else "hot" if i % 2 else f"s{i % 3}" for i in range(len(odd_texts))]
    table = docs(odd_texts, sources).withColumn("part", F.lit(1)).withColumn("mask", F.lit("m"))
    table = table.unionByName(table.filter("doc_id % 4 = 1")).unionByName(table.filter("doc_id % 13 = 2").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(i, q, t) for i, q, t in [(0, 1, 0), (3, 1, 1), (3, 0, 0), (5, None, 1), (7, 0, None), (9, 1, 0), (9999, 1, 1), (None, 1, 1)]]
                                   + [(i, i % 2, i % 3) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, set()).update({"good_lost"} if r.quality == 1 else set(), {"toxic_lost"} if r.toxic == 1 else set())
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    pairs = [(i, t) for i, t, _ in rows]
    want = brute([(s or "", failed((i, t), pairs), marks.get(i, set()) if i is not None else set()) for i, t, s in rows], ["good_lost", "toxic_lost"], "ABCDE")
    assert found(filter_audit.audit_documents(table, labels), ["good_lost", "toxic_lost"]) == want


def test_other_filters_and_empty_tables(spark, empty_docs):
    df = spark.createDataFrame([("p", 1, None), ("p", 2, True), (None, 3, False), ("q", 4, None)], "g string, x int, y boolean")
    got = found(filter_audit.audit(df, F.col("g"), {"x": F.col("x") > 1, "k": F.col("y")}, {}), [])
    rows = [("p", set(), set()), ("p", {"x", "k"}, set()), ("", {"x"}, set()), ("q", {"x"}, set())]
    assert got == brute(rows, [], "kx")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(empty_docs, none).count() == 0
