import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempaudit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_every_character_and_random_strings(library):
    vocab, rng = bpe.Vocabulary(PATH), random.Random(2)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 37 == 0)]
    texts = [f"a{c}b 1{c}2{c}{c} '{c}s\n{c}" for c in every[::5]]
    pieces = ["'s", "'re", " ", "  ", "\n", "\t", "aaaa", "the", "don't", "THE", "12345", "é", "<|endoftext|>", "<|endof", " ", " ", "数据", "é", "😀", "!!'ll", "'"]
    texts += ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeths ", k=rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 3000, ""]
    ids, edges = bpe.encode_texts(vocab, *flat(texts))
    want = library.encode_batch(texts, add_special_tokens=False)
    for i, text in enumerate(texts):
        got = ids[edges[i]:edges[i + 1]]
        assert got.tolist() == want[i].ids, repr(text)
        assert bpe.decode_ids(vocab, got).decode() == library.decode(want[i].ids, skip_special_tokens=False)


def test_tables(spark, docs, odd_texts, empty_docs, library):
    got = {r.doc_id: r for r in bpe.round_trip(docs(odd_texts), PATH).collect()}
    full = {r.doc_id: r for r in bpe.decode(bpe.encode(docs(odd_texts), PATH), PATH).collect()}
    for i, text in enumerate(odd_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert full[i].ids == ids and full[i].decoded == (text or "") and full[i].text == text
    assert bpe.round_trip(empty_docs, PATH).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), PATH).collect() == [(1, None, None), (2, [], "")]
