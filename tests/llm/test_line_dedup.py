import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempaudit.llm import line_dedup
from tempaudit.llm.line_dedup import cleaned, dedup_lines, within

SPACE = " \t\n\r\x0b\x0c"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(texts, edits=2, least=25):
    seen, earlier, out = set(), [], []
    for text in texts:
        kept, exact, near, lines = [], 0, 0, [] if text is None else text.split("\n")
        for line in lines:
            core = line.strip(SPACE)
            if len(core) < least:
                kept.append(line)
            elif core in seen:
                exact += 1
            else:
                close = len(core) >= 25 and any(len(o) >= 25 and abs(len(core) - len(o)) <= edits and distance(core, o) <= edits for o in earlier)
                seen.add(core)
                earlier.append(core)
                near += close
                if not close:
                    kept.append(line)
        out.append((None if text is None else "\n".join(kept), len(lines), exact, near))
    return out


def changed(rng, line, n):
    for _ in range(n):
        at = rng.randrange(len(line))
        line = rng.choice([line[:at] + line[at + 1:], line[:at] + rng.choice("abé数") + line[at:], line[:at] + "z" + line[at + 1:]])
    return line


@pytest.fixture
def pages():
    rng = random.Random(6)
    pool = ["".join(rng.choices("abcdé ü数f", k=rng.randint(20, 90))).strip() + "x" for _ in range(60)]
    texts = []
    for _ in range(90):
        lines = [changed(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice(["\n", "\n\n", " \n\t"]).join(lines))
    return texts + ["The very same line stands here\n" * 40, None, "", "\n", "short", "  The very same line stands here\r"]


def test_bit_parallel_distance():
    rng = random.Random(3)
    lines = ["".join(rng.choices("ab", k=rng.randint(0, 14))) for _ in range(60)] + ["".join(rng.choices("abcd", k=300))]
    lines += [changed(rng, lines[-1], n) for n in (1, 2, 3)]
    codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in lines]
    i, j = (x.ravel() for x in np.mgrid[:len(lines), :len(lines)])
    for edits in (1, 2, 3):
        assert within(codes, i, j, edits).tolist() == [distance(lines[a], lines[b]) <= edits for a, b in zip(i, j)]


@pytest.mark.parametrize("tile", [128, 3])
def test_against_brute_force(docs, pages, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    table = docs(pages).withColumn("removed", F.lit("clash")).withColumn("number", F.lit(1))
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_exact, r.n_near) for r in dedup_lines(table).collect()}
    want = brute(pages)
    assert [got[i] for i in range(len(pages))] == want
    assert sum(w[3] for w in want) > 10


def test_odd_rows(spark, docs, odd_texts, empty_docs, monkeypatch):
    assert dedup_lines(empty_docs).count() == 0
    got = {r.doc_id: r for r in dedup_lines(docs(odd_texts)).collect()}
    assert len(got) == len(odd_texts) and all((got[i].kept_text is None) == (t is None) for i, t in enumerate(odd_texts))
    line = "one line that is long enough to count"
    rows = [(2, line), (1, line), (1, line), (None, line), (3, line + "\nshort")]
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    out = cleaned(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, line), (1, line), (3, "short")]


def test_lines_of_a_hot_segment_are_handed_on_once(spark, docs, pages, monkeypatch):
    for name, size in (("HOT", 4), ("BLOCK", 2)):
        monkeypatch.setattr(line_dedup, name, size, raising=False)
    got = {r.doc_id: (r.kept_text, r.n_lines, r.n_exact, r.n_near) for r in dedup_lines(docs(pages)).collect()}
    assert [got[i] for i in range(len(pages))] == brute(pages)
    monkeypatch.setattr(line_dedup, "HOT", 64)
    rng = random.Random(8)
    table = docs(["Posted by some user on the first of May, " + "".join(rng.choices("0123456789", k=20)) for _ in range(600)])
    met = line_dedup.meetings(table, 2).groupBy("key").count().agg(F.max("count")).first()[0]
    assert 1200 >= met >= 600


def test_query_removes_equal_lines_of_every_length(tmp_path, spark, docs):
    from tempaudit.llm.queries import QUERIES

    line = "one line that is long enough to count"
    docs([f"{line}\nshort\n\nx", f"{line}\nshort\n\n x \nshore", "short\r\n\n", line + "!"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_exact, r.n_near, list(r.removed)) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, 0, []), 1: (3, 0, [0, 1, 3]), 2: (1, 0, [0]), 3: (0, 1, [0])}
