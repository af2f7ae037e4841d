"""Byte-level BPE by speculation: greedy longest matches, a check of adjacent pairs, exact merging of the rest.

A token sequence is what BPE yields if each token yields itself and no adjacent pair would have merged
across its boundary on the way.  At any moment of the merging, the piece left of the boundary
is on the right edge of the left token's merge tree, and the piece right of it on the left edge of
the right token's.  Walking both edges downwards in the order in which their merges were made meets
every pair of pieces that touch; the sequence fails if such a pair has a merge of its own that comes
first.  Greedy proposals that pass are the encoding; words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tempaudit.llm.textops import LEAD, Hasher, over_texts

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Fixed by the vocabulary's splitting rule: endings that an apostrophe opens.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LATE = np.int64(1 << 40)


@cache
def char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merge trees, pair ranks and a trie of all tokens, as arrays that travel to the tasks once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec["pre_tokenizer"], spec["model"]
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if (split["type"], split["add_prefix_space"], model["type"], spec["normalizer"], plain) != ("ByteLevel", False, "BPE", None, True):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        symbols, ids = byte_symbols(), model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.pieces = [b""] * size
        for text, i in ids.items():
            self.pieces[i] = bytes(symbols[c] for c in text)
        for text, i in self.special.items():
            self.pieces[i] = text
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        pairs = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            pairs.append((ids[a] << 20 | ids[b], rank, made))
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = ids[a], ids[b], rank
        pairs.sort()
        self.pair_keys, self.pair_ranks, self.pair_made = (np.array(x, np.int64) for x in zip(*pairs))
        made = np.flatnonzero(self.rank >= 0)
        if not (np.maximum(self.rank[self.left[made]], self.rank[self.right[made]]) < self.rank[made]).all():
            raise ValueError(f"{path} merges tokens before it makes them")
        self.made_by = np.zeros(len(model["merges"]), np.int64)
        self.made_by[self.pair_ranks] = self.pair_made
        self.byte_ids = np.array([ids[c] for c in sorted(symbols, key=symbols.get)], np.int64)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.pool = np.frombuffer(b"".join(self.pieces), np.uint8)
        made = np.flatnonzero(self.rank >= 0)
        own = np.ones(size, bool)
        own[made] = self.stable(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            own[t] &= own[self.left[t]] & own[self.right[t]]
        self._trie(np.concatenate([self.byte_ids, made[own[made]]]))

    def _trie(self, tokens: np.ndarray) -> None:
        nodes, moves, accept = {b"": 0}, {}, {}
        for t in tokens.tolist():
            piece = self.pieces[t]
            for i in range(len(piece)):
                head = piece[:i + 1]
                if head not in nodes:
                    nodes[head] = len(nodes)
                    moves[nodes[piece[:i]] << 8 | piece[i]] = nodes[head]
            accept[nodes[piece]] = t
        self.move_keys = np.array(sorted(moves), np.int64)
        self.move_to = np.array([moves[k] for k in self.move_keys.tolist()], np.int64)
        self.accept = np.full(len(nodes), -1, np.int64)
        self.accept[list(accept)] = list(accept.values())

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, ``LATE`` where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], LATE)

    def stable(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """True where no merge crosses the boundary of a and b; with ``before``, none ranked earlier than it."""
        ok = np.ones(len(a), bool)
        until = np.full(len(a), LATE) if before is None else before
        row, a, b = np.arange(len(a)), a.copy(), b.copy()
        a_until, b_until = until.copy(), until.copy()
        while len(row):
            rank = self.ranks_of(a, b)
            # of equal merges the left one is made first
            crossing = (rank < a_until) & ((rank <= b_until) if before is None else np.where(b_until == until[row], rank < b_until, rank <= b_until))
            crossing &= rank < LATE
            ok[row[crossing]] = False
            deep_a = self.rank[a] > self.rank[b]
            end = ~deep_a & (self.rank[b] < 0)
            go = ~crossing & ~end
            row, a, b, a_until, b_until, deep_a = (x[go] for x in (row, a, b, a_until, b_until, deep_a))
            a_until = np.where(deep_a, self.rank[a], a_until)
            b_until = np.where(deep_a, b_until, self.rank[b])
            a, b = np.where(deep_a, self.right[a], a), np.where(deep_a, b, self.left[b])
        return ok

    def greedy(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of byte ranges: word index and id, in order."""
        words, ids = [], []
        word, at, stop = np.arange(len(start)), start.copy(), end
        while len(word):
            best, size = np.full(len(word), -1), np.zeros(len(word), np.int64)
            row, node, depth = np.arange(len(word)), np.zeros(len(word), np.int64), 0
            while len(row):
                key = node << 8 | data[at[row] + depth]
                hit = np.minimum(np.searchsorted(self.move_keys, key), len(self.move_keys) - 1)
                found = self.move_keys[hit] == key
                row, node, depth = row[found], self.move_to[hit[found]], depth + 1
                token = self.accept[node]
                full = token >= 0
                best[row[full]], size[row[full]] = token[full], depth
                more = at[row] + depth < stop[row]
                row, node = row[more], node[more]
            words.append(word)
            ids.append(best)
            at = at + size
            open_ = at < stop
            word, at, stop = word[open_], at[open_], stop[open_]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, ids = np.concatenate(words), np.concatenate(ids)
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE of byte ranges by its definition: in every word all pairs of its earliest merge, from the left, then again.

        A token's merges come after the one that makes it, so the pairs of one merge can be joined together.
        """
        size = end - start
        word = np.repeat(np.arange(len(start)), size)
        first = np.concatenate([[0], np.cumsum(size)])
        ids = self.byte_ids[data[np.arange(len(word)) - first[word] + start[word]]]
        rank = np.full(len(ids), LATE)  # of each token with the next one of its word
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        done_words, done_ids = [], []
        while len(ids):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begins, len(ids)))
            least = np.minimum.reduceat(rank, begins)
            over = np.repeat(least == LATE, size)
            if over.any():
                done_words.append(word[over])
                done_ids.append(ids[over])
                word, ids, rank = word[~over], ids[~over], rank[~over]
                size, least = size[least < LATE], least[least < LATE]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, size))
            apart = np.append(True, (np.diff(hits) > 1) | (word[hits][1:] != word[hits][:-1]))
            run = np.maximum.accumulate(np.where(apart, np.arange(len(hits)), 0))
            at = hits[(np.arange(len(hits)) - run) % 2 == 0]  # a a a: the first two join
            ids[at] = self.made_by[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one token is gone for each earlier pair
            word, ids, rank = word[keep], ids[keep], rank[keep]
            for left in (at - 1, at):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                same = word[left] == word[left + 1]
                rank[left[same]] = self.ranks_of(ids[left[same]], ids[left[same] + 1])
                rank[left[~same]] = LATE
            if at[-1] == len(ids) - 1:
                rank[-1] = LATE
        word, ids = np.concatenate(done_words), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]


def encode_words(vocab: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of distinct words and the bounds of each word's ids."""
    word, ids = vocab.greedy(data, start, end)
    same = word[1:] == word[:-1]
    pair = (ids[:-1] << 20 | ids[1:])[same]
    distinct, back = np.unique(pair, return_inverse=True)
    failing = ~vocab.stable(distinct >> 20, distinct & 0xFFFFF)[back]
    bad = np.unique(word[:-1][same][failing])
    if len(bad):
        exact, exact_ids = vocab.merge(data, start[bad], end[bad])
        passed = np.ones(len(start), bool)
        passed[bad] = False
        keep = passed[word]
        word, ids = np.concatenate([word[keep], bad[exact]]), np.concatenate([ids[keep], exact_ids])
        order = np.argsort(word, kind="stable")
        word, ids = word[order], ids[order]
    return ids, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(start)))])


def split_words(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a word begins.  ``chars``: code points; ``first``: where a text (or a piece of one) begins."""
    n = len(chars)
    kind = char_classes()[chars]
    last = np.append(first[1:], True)
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before_word = np.zeros(n, bool)  # the last white space before something else
    before_word[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    begins |= before_word
    joined = np.zeros(n, bool)  # its word takes a plain space along
    joined[1:] = before_word[:-1] & (chars[:-1] == 32)
    begins &= ~joined
    at = np.flatnonzero((chars == 39) & begins & ~last)
    at = at[kind[np.minimum(at + 1, n - 1)] == LETTER]
    for ending in ENDINGS:
        fits = np.ones(len(at), bool)
        for j, c in enumerate(ending, 1):
            here = np.minimum(at + j, n - 1)
            fits &= (at + j < n) & (chars[here] == ord(c)) & ~first[here]
        hit = at[fits]
        begins[hit + 1] = False
        after = hit + 1 + len(ending)
        after = after[after < n]
        begins[after] = True
        keep = ~fits
        at = at[keep]
    return begins


def encode_texts(vocab: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the bounds of each text's ids.  Special tokens in a text are that token."""
    n = len(bounds) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    raw = data.tobytes()
    cuts, special = [], []
    if vocab.special:
        for m in regex.finditer(b"|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True)), raw):
            if bounds[np.searchsorted(bounds, m.start(), side="right")] >= m.end():  # within one text
                cuts.append(m.span())
                special.append(vocab.special[m[0]])
    lead = np.flatnonzero(LEAD[data])
    chars = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    first_byte = np.zeros(len(data) + 1, bool)
    first_byte[bounds] = True
    inside = np.zeros(len(data) + 1, bool)
    for a, b in cuts:
        first_byte[a] = first_byte[b] = True
        inside[a + 1:b] = True
    begins = split_words(chars, first_byte[lead])
    start = lead[begins & ~inside[lead]]
    end = np.append(start[1:], len(data))
    keys = Hasher(data).ranges(start, end)
    distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
    is_special = np.zeros(len(start), bool)
    if cuts:
        is_special[np.searchsorted(start, [a for a, _ in cuts])] = True
        plain = ~is_special
        distinct, where, back_plain = np.unique(keys[plain], return_index=True, return_inverse=True)
        where = np.flatnonzero(plain)[where]
        back = np.zeros(len(start), np.int64)
        back[plain] = back_plain
    ids, edges = encode_words(vocab, data, start[where], end[where])
    if cuts:  # special tokens follow the words in the pool
        back[is_special] = len(where) + np.arange(len(special))
        ids, edges = np.concatenate([ids, special]), np.concatenate([edges, edges[-1] + 1 + np.arange(len(special))])
    sizes = np.diff(edges)[back]
    total = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.repeat(edges[back] - total[:-1], sizes) + np.arange(total[-1])
    return ids[flat], total[np.searchsorted(start, bounds)]


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """UTF-8 of the text of token ids; bytes that are no UTF-8 become U+FFFD."""
    sizes = vocab.lengths[ids]
    total = np.concatenate([[0], np.cumsum(sizes)])
    raw = vocab.pool[np.repeat(vocab.offsets[ids] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
    return raw.decode("utf-8", "replace").encode("utf-8")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` and ``ids`` (array of token ids; replaces a column of that name).

    A null or empty text has no ids.  Repeated rows give repeated results.  ``path`` is the vocabulary
    file on the driver; the tasks get its arrays by broadcast (a few MB, fixed by the file).
    """
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    docs = docs.drop(ids)

    def work(rows, data, bounds):
        flat, edges = encode_texts(vocab.value, data, bounds)
        found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat, pa.int32()))
        return dict(zip(rows.schema.names, rows.columns)) | {ids: found}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{ids}` array<int>"
    return over_texts(docs, work, schema, text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the text of ``ids``; null ids give null."""
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))
    encoded = encoded.drop(text)

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if v is None else decode_ids(vocab.value, np.asarray(v, np.int64)).decode() for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + f", `{text}` string"
    return encoded.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Encode and decode in one pass: the id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def work(rows, data, bounds):
        flat, edges = encode_texts(vocab.value, data, bounds)
        parts = [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return {id_column: rows.column(rows.schema.get_field_index(id_column)), "n_tokens": np.diff(edges),
                "ids_sha256": [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts],
                "decoded_sha256": [hashlib.sha256(decode_ids(vocab.value, p)).hexdigest() for p in parts]}

    id_type = docs.schema[id_column].dataType.simpleString()
    return over_texts(docs.select(id_column, text), work, f"`{id_column}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string",
                      text)
