import re
from collections import Counter

from pyspark.sql import functions as F

from tempaudit.llm.quality_rules import LINE_LIMIT, WINDOW_LIMITS, repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)

    def marks(n, later):
        seen, count, hit = set(), Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1)), [False] * len(words)
        for i in range(len(words) - n + 1):
            w = tuple(words[i:i + n])
            if count[w] > 1 and (not later or w in seen):
                hit[i:i + n] = [True] * n
            seen.add(w)
        return hit

    chars, seen, dup, dup_chars = sum(map(len, words)), set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    shares = [sum(len(w) for w, h in zip(words, marks(n, True)) if h) / max(chars, 1) for n in WINDOW_LIMITS]
    repeat = sum(marks(5, False))
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    kept = not failed and all(s <= m for s, m in zip(shares, WINDOW_LIMITS.values())) and dup_chars / max(chars, 1) <= LINE_LIMIT
    return len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, [round(s, 9) for s in shares], failed, kept


def test_against_brute_force(docs, odd_texts):
    got = {r.doc_id: r for r in repetition(docs(odd_texts).withColumn("kept", F.lit(1))).collect()}
    assert len(got) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, [round(s, 9) for s in r.dup_share],
                r.base_failed, r.kept) == brute(text), text


def test_empty_table(empty_docs):
    assert repetition(empty_docs).count() == 0
