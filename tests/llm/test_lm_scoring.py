import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tempaudit.llm import attention, lm_scoring
from tempaudit.llm.lm_scoring import score

PATH = public_tokenizers.path("byte_bpe_50k.json")


def training():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2


SCORES = []


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def brute(texts):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    counts = Counter(t for text, h in zip(texts, held) if not h for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(h, len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x))) for x, h in zip(texts, held)]


@pytest.mark.parametrize("frequent", [300_000, 4])
def test_counts_and_base_score(docs, odd_texts, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 50)
    got = {r.doc_id: r for r in score(docs(odd_texts).withColumn("key", F.lit("clash")), PATH, training()).collect()}
    assert len(got) == len(odd_texts)
    for i, want in enumerate(brute(odd_texts)):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert got[0].score == got[1].score  # null and empty
    SCORES.append([got[i].score for i in range(len(odd_texts))])
    assert np.allclose(SCORES[0], SCORES[-1], rtol=0.01)  # whether words come by broadcast or by join


def test_model_beats_the_word_counts_on_held_out_text(docs):
    rng = np.random.default_rng(5)
    words = ["the", "of", "house", "water", "green", "river", "walks", "slowly"]
    texts = []
    for _ in range(260):
        at, out = int(rng.integers(8)), []
        for _ in range(80):
            out.append(words[at])
            at = (at + 1 + int(rng.random() < 0.1)) % 8  # a strong order that counts can't see
        texts.append(" ".join(out))
    got = score(docs(texts), PATH, training(), rounds=12).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in attention.start(12, 5).items()}
    x, target = rng.integers(0, 12, (3, attention.WIDTH)), rng.integers(0, 5, (3, attention.WIDTH))
    weight = np.ones(x.shape)

    def loss():
        return -attention.log_probability(p, x, target).mean()

    grads = attention.gradient(p, x, target, weight)
    for k in p:
        at = tuple(int(rng.integers(s)) for s in p[k].shape)
        if k == "e":
            at = (int(x[0, 3]), at[1])
        keep, eps = p[k][at], 1e-5
        p[k][at] = keep + eps
        up = loss()
        p[k][at] = keep - eps
        down = loss()
        p[k][at] = keep
        assert grads[k][at] == pytest.approx((up - down) / (2 * eps), rel=2e-3, abs=1e-6), k
    every = sum(np.exp(attention.log_probability(p, x, np.full_like(target, c))) for c in range(5))
    assert np.allclose(every, 1)


def test_windows_score_every_token_once():
    for n in (1, 31, 32, 33, 55, 56, 57, 200):
        bounds = np.array([0, n, n + 3])
        doc, at = lm_scoring.cut_windows(bounds)
        seen = Counter()
        for d, a in zip(doc, at):
            for i in range(0 if a == 0 else attention.CONTEXT, attention.WIDTH):
                if bounds[d] + a + i < bounds[d + 1]:
                    seen[bounds[d] + a + i] += 1
        assert sorted(seen) == list(range(n + 3)) and set(seen.values()) == {1}


def test_empty(empty_docs):
    assert score(empty_docs, PATH, training()).count() == 0


def test_no_training_text(docs, odd_texts):
    """All counts are 0, the model is the one it starts from, and every text still has a finite score."""
    for r in score(docs(odd_texts), PATH, F.lit(False)).collect():
        assert (r.held_out, r.n_known, r.train_tokens, r.base_score) == (True, 0, 0, 0.0)
        assert r.n_tokens == len(tokens(odd_texts[r.doc_id])) and math.isfinite(r.score) and r.score < 0


def test_every_training_window_is_learned_from(docs, monkeypatch):
    """At the parameters of the query: company counts every window, and a strong order is learned from few texts."""
    rng = np.random.default_rng(6)
    words = ["the", "of", "house", "water", "green", "river", "walks", "slowly"]
    texts = []
    for _ in range(1200):
        at, out = int(rng.integers(8)), []
        for _ in range(100):
            out.append(words[at])
            at = (at + 1 + int(rng.random() < 0.1)) % 8
        texts.append(" ".join(out))
    seen = {}
    monkeypatch.setattr(lm_scoring, "train", lambda windows, tables, rounds, f=lm_scoring.train: seen.update(n=windows.count()) or f(windows, tables, rounds))
    monkeypatch.setattr(lm_scoring, "company_of", lambda windows, counts, f=lm_scoring.company_of: seen.update(company=windows.count()) or f(windows, counts))
    got = score(docs(texts), PATH, training()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    learned = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts)))
    each = len(lm_scoring.cut_windows(np.array([0, 101]))[0])  # these words are one subword each
    assert seen == {"n": learned * each, "company": learned * each}
    assert got[0] > 0.8 * got[1]


def test_feed_forward_layer_and_classes():
    """Without attention the logits are no sum over parts of an embedding, and frequent subwords are told apart."""
    p = attention.start(3, 4)
    p["o"][:], p["pos"][:], p["e"][2] = 0, 0, p["e"][0] + p["e"][1]
    one, two, both = (attention.forward(p, np.full((1, attention.WIDTH), i))[0] for i in range(3))
    assert not np.allclose(one + two, both, atol=1e-3)
    counts = np.arange(1000, 0, -1)
    tables = lm_scoring.Tables(counts, np.ones((1000, lm_scoring.COMPANY)), np.arange(1000) % 2 == 0)
    assert len(tables.bias) == 64 and len(set(tables.classes[:32])) == 32 and tables.classes[32:].min() == 32


def test_context_is_read_but_not_learned_from():
    """Slopes from a position on are those of a loss that gives the positions before it no weight; scratch arrays change nothing."""
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in attention.start(12, 5).items()}
    room = attention.Room()
    for n in (4, 2, 3):
        x, target = rng.integers(0, 12, (n, attention.WIDTH)), rng.integers(0, 5, (n, attention.WIDTH))
        weight = rng.integers(0, 2, x.shape).astype(np.float64)
        late = weight * (np.arange(attention.WIDTH) >= attention.CONTEXT)
        whole, part = attention.gradient(p, x, target, late), attention.gradient(p, x, target, weight, attention.CONTEXT, room)
        for k in p:
            assert np.allclose(whole[k], part[k], atol=1e-12), k
        full = attention.log_probability(p, x, target)[:, attention.CONTEXT:]
        assert np.allclose(full, attention.log_probability(p, x, target, attention.CONTEXT, room))


def test_steps_over_one_vector_are_the_usual_ones():
    """All weights but the embeddings are views of one vector; each takes the step it would take alone."""
    rng = np.random.default_rng(3)
    p = attention.start(9, 5)
    plain = {k: v.astype(np.float64) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in plain.items()} for _ in range(2))
    adam = attention.Adam(p, 0.01, ("e",))
    assert p["u"].base is p["b"].base is p["pos"].base is not None
    for t in range(1, 6):
        there = np.sort(rng.choice(9, 4, replace=False))
        g = {k: rng.normal(0, 1, v[there].shape if k == "e" else v.shape).astype(np.float32) for k, v in p.items()}
        adam.step(g, {"e": there})
        for k in p:
            at = there if k == "e" else slice(None)
            first[k][at] += 0.1 * (g[k] - first[k][at])
            second[k][at] += 0.01 * (g[k].astype(np.float64) ** 2 - second[k][at])
            plain[k][at] -= 0.01 * (1 - 0.99 ** t) ** 0.5 / (1 - 0.9 ** t) * first[k][at] / (np.sqrt(second[k][at]) + 1e-7)
    for k in p:
        assert np.allclose(p[k], plain[k], atol=1e-5), k


def test_windows_are_read_back_from_any_slice():
    rng = np.random.default_rng(4)
    for size in (50_258, 70_000):
        rows = rng.integers(-1, size, (7, attention.WIDTH + 1))
        column = lm_scoring.packed(rows, size)
        assert column.type == "binary" and column[2].as_py() == lm_scoring.packed(rows[2:3], size)[0].as_py()
        assert np.array_equal(lm_scoring.unpacked(column, size), rows)
        assert np.array_equal(lm_scoring.unpacked(column.slice(2, 3), size), rows[2:5])
        assert lm_scoring.unpacked(column.slice(0, 0), size).shape == (0, attention.WIDTH + 1)
