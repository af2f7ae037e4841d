import random
import re

import pytest

from tempaudit.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    words = WORD.findall(text or "")
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(texts):
    sets = [grams(t) for t in texts]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    root, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([root[i], *(root[j] for j in others)])
            changed, root[i] = changed or low < root[i], low
    return [(r, len(o)) for r, o in zip(root, near)]


@pytest.fixture
def copies():
    rng, texts = random.Random(9), []
    vocab = [f"w{i}" for i in range(3000)]
    for i in range(25):
        base = rng.choices(vocab, k=rng.randint(60, 300))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            other = list(base)
            for _ in range(rng.choice([0, 1, 2, 6])):
                other[rng.randrange(len(other))] = "changed" + str(rng.random())
            texts.append("\n".join(other) if rng.random() < 0.2 else " ".join(other))
    hot = rng.choices(vocab, k=120)
    for _ in range(150):  # one large group of near copies, each with one word of its own
        other = list(hot)
        other[rng.randrange(120)] += "x"
        texts.append(" ".join(other))
    texts += [" ".join(hot)] * 40 + ["a b", "a  b", "a b c", "", None, " \n", "same words here only four".replace(" only", "")] + [" ".join(rng.choices(vocab, k=30_000))]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [512, 20])
def test_links_and_classes(docs, copies, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    table = docs(copies).withColumnRenamed("n_chars", "rep")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(table).collect()}
    want = brute(copies)
    assert [got[i] for i in range(len(copies))] == want
    kept = {r.doc_id for r in ngram_join.one_of_each(table).collect()}
    assert kept == {i for i, (c, _) in enumerate(want) if c == i}


def test_odd_rows(spark, docs, odd_texts, empty_docs):
    assert ngram_join.near_duplicates(empty_docs).count() == 0
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs(odd_texts)).collect()}
    assert [got[i] for i in range(len(odd_texts))] == brute(odd_texts)
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (3, "x y"), (3, "a b c d e")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in got) == [(0, 0, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 1, 2)]


def test_depth_reaches_the_target():
    depth = ngram_join.floor_depth(0.8, 0.999)
    assert 1 - (1 - 0.8 ** depth) ** ngram_join.TREES >= 0.999 and 2 < depth < ngram_join.DEEPEST


def test_components_that_run_out_of_rounds_raise(spark):
    from tempaudit.llm.graph import components

    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.root for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, rounds=1)
