"""A row that stands in the table twice is answered twice and alike."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tempaudit.llm import bpe, lm_scoring, mixing, quality_rules, secrets


@pytest.mark.parametrize("name, work", [
    ("secrets", secrets.scan), ("rules", quality_rules.repetition),
    ("bpe", lambda df: bpe.round_trip(df, public_tokenizers.path("byte_bpe_50k.json"))),
    ("mix", lambda df: mixing.mix(df, F.array("source"), mixing.cycled(5, 2, 1)).documents)])
def test_repeated_rows_are_answered_alike(docs, name, work):
    texts = [None, "", "one two three token=abcdef99", "the same words again " * 30, "Straße été 数据 undheitkeiten"]
    once = docs(texts).withColumns({"n_words_": F.lit(1), "ids": F.lit("clash"), "members": F.lit("clash")})
    got = work(once.unionByName(once)).collect()
    assert len(got) == 2 * len(texts)
    if name != "mix":  # the mix takes a sequence of words, of which one copy may be taken in part
        assert len({str(r) for r in got}) == len(texts)
    else:
        assert all(0 <= r.taken <= 2 * r.size for r in got) and len({(r.doc_id, r.size) for r in got}) == len(texts)


def test_scores_of_repeated_rows_and_without_training_texts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    once = docs(["one two three", "four five", None])
    got = lm_scoring.score(once.unionByName(once), path, F.col("doc_id") != 1).collect()
    assert len(got) == 6 and len({(r.doc_id, r.n_tokens, round(r.score, 9)) for r in got}) == 3
    none = lm_scoring.score(once, path, F.lit(False)).collect()
    assert {(r.doc_id, r.held_out, r.n_known, r.train_tokens) for r in none} == {(i, True, 0, 0) for i in range(3)}
    assert all(r.score < 0 for r in none)


def test_sums_over_many_tasks(spark):
    import numpy as np

    flat = np.arange(5000.0)
    parts = spark.range(40).repartition(40).mapInArrow(lambda batches: (x for b in batches for _ in range(b.num_rows) for x in lm_scoring.sliced(flat, 3)),
                                                       lm_scoring.SLICED)
    seen, total = lm_scoring.summed(parts)
    assert seen == 120 and np.array_equal(total, 40 * flat)
    assert lm_scoring.summed(parts.limit(0))[0] == 0
