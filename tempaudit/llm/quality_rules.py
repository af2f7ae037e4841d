"""Repetition coverage of whole texts: characters inside repeated n-word windows and repeated lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempaudit.llm.textops import BASE, LEAD, SPACE, Hasher, find_words, mix, over_texts, per_doc, repeated, windows

#: Largest share of a text's word characters that repeated windows of so many words may hold.
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.30
MIN_WORDS = 10
REPEAT_PERCENT = 20

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def repetition(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per input row: counts, repetition shares and the verdict.

    Columns: the id, ``n_words``, ``word_chars`` (code points in words), ``n_symbols``,
    ``n_dup_lines`` (lines with a word that equal an earlier line of the text), ``n_repeat_words``
    (words in five-word windows that occur twice or more, first occurrence included),
    ``dup_share`` (array: per length of ``WINDOW_LIMITS`` the share of word characters inside
    windows that occurred before), ``line_share`` (share inside lines that occurred before),
    ``base_failed`` and ``kept``.

    A null or empty text has no words and fails.  Repeated rows give repeated results; other columns
    are ignored, whatever their names.  Work is one pass without a shuffle.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "dup_share array<double>, line_share double, base_failed boolean, kept boolean")

    def work(rows, data, bounds):
        n = len(bounds) - 1
        words = find_words(data, bounds)
        hashes = Hasher(data)
        keys = hashes.ranges(words.start, words.end)
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum(LEAD[data] & ~SPACE[data], out=leads[1:])
        chars = leads[words.end] - leads[words.start]
        n_words = np.bincount(words.doc, minlength=n)
        word_chars = np.bincount(words.doc, chars, n)
        doc_salt = mix(np.arange(1, n + 1, dtype=np.uint64))

        def covered(at, length, size):
            steps = np.zeros(size + 1, np.int64)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + length, -1)
            return np.cumsum(steps[:-1]) > 0

        shares, n_repeat = [], None
        for length in WINDOW_LIMITS:
            at, grams = windows(keys, words.doc, length)
            grams = grams + doc_salt[words.doc[at]]
            again = repeated(grams)
            if length == 5:
                inside = covered(at[again], length, len(keys))
                n_repeat = np.bincount(words.doc[inside], minlength=n)
            at, grams = at[again], grams[again]
            order = np.argsort(grams, kind="stable")
            later = np.zeros(len(at), bool)
            later[order[1:]] = grams[order[1:]] == grams[order[:-1]]
            inside = covered(at[later], length, len(keys))
            shares.append(np.bincount(words.doc[inside], chars[inside], n) / np.maximum(word_chars, 1))

        breaks = np.flatnonzero(data == 10)
        line_start = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
        # the position after a text's last newline can be the next text's start: that line is empty
        line_doc = np.searchsorted(bounds[:-1], line_start, side="right") - 1
        line_end = np.concatenate([line_start[1:], [len(data)]]) if n else line_start
        line_end = np.minimum(line_end, bounds[line_doc + 1])
        line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else 0)
        line_chars = leads[line_end] - leads[line_start]
        full = line_chars > 0
        line_doc, line_chars = line_doc[full], line_chars[full]
        line_keys = hashes.ranges(line_start[full], line_end[full]) + doc_salt[line_doc] * BASE
        order = np.argsort(line_keys, kind="stable")
        dup = np.zeros(len(line_keys), bool)
        dup[order[1:]] = line_keys[order[1:]] == line_keys[order[:-1]]
        n_dup = np.bincount(line_doc[dup], minlength=n)
        line_share = np.bincount(line_doc[dup], line_chars[dup], n) / np.maximum(word_chars, 1)

        failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
        table = np.stack(shares, 1)
        kept = ~failed & (table <= np.array(list(WINDOW_LIMITS.values()))).all(1) & (line_share <= LINE_LIMIT)
        return {
            id_column: rows.column(rows.schema.get_field_index(id_column)), "n_words": n_words, "word_chars": word_chars.astype(np.int64),
            "n_symbols": per_doc(SYMBOL[data], bounds), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
            "dup_share": pa.array(list(table), pa.list_(pa.float64())), "line_share": line_share, "base_failed": failed, "kept": kept}

    return over_texts(docs.select(id_column, text), work, schema, text)
