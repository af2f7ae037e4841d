"""Language-model scores of whole texts: word counts of the corpus, and causal attention over subword ids.

Words become subword ids by longest match in a public vocabulary.  The attention model gives the
probability of the next subword's class; a class is a frequent subword or a cluster of others that keep the same
company, and inside a class a subword's share of the corpus counts applies.  The product is a probability over all
sequences of subwords.  A word's probability is the mean of that of its subwords in their context and of its share
of the corpus's tokens, so that a frequent word does not depend on its spelling, and a new one has only that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.llm import attention
from tempaudit.llm.attention import CONTEXT, WIDTH
from tempaudit.llm.bpe import Vocabulary
from tempaudit.llm.textops import LOWER, Hasher, find_words, mix, over_texts, text_chunks
from tempaudit.session import scratch_path

#: Most words whose counts and subwords every task holds, the most frequent ones; all others are joined.
FREQUENT = 300_000
#: Frequent subwords that are a class of their own, and clusters of all others: half begin words, half go on with them.
OWN_CLASSES, CLUSTERS = 32, 32
#: Frequent subwords whose presence in a window is the company that clusters are made by, and rounds of clustering.
COMPANY, CLUSTER_ROUNDS = 24, 15
#: Subwords with an embedding of their own, and embeddings that the others share.
OWN_SYMBOLS, SHARED_SYMBOLS = 6000, 500
ROUNDS, BATCH, RATE = 2, 128, 0.01
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 400_000
#: Key of the end token; a word cannot have it but by a hash collision.
END = np.uint64(0x5EED5EED5EED5EED)
LOG10 = np.log(10.0)
#: Weight of a word's share of the corpus in its probability; the attention model has the rest.
BY_COUNT = 0.5


class Subwords:
    """Longest-match ids of distinct words, each with the space that stands before it in running text."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.size = vocab, len(vocab.pieces)
        self.end = self.size  # one id more, for the end of a text

    def split(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - start + 1
        total = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], size)
        source = np.repeat(start, size) + place - 1
        buffer = np.where(place == 0, np.uint8(32), data[np.maximum(source, 0)]) if len(data) else np.zeros(0, np.uint8)
        word, ids = self.vocab.greedy(buffer, total[:-1], total[1:])
        return ids, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(start)))])


def gather(ids: np.ndarray, edges: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the picked words in a row, and their bounds."""
    size = np.diff(edges)[pick]
    total = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(edges[pick] - total[:-1], size) + np.arange(total[-1])], total


def with_ends(tokens: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' ids with the end token after each, and the new bounds."""
    n = len(bounds) - 1
    out = np.full(len(tokens) + n, end, np.int64)
    out[np.arange(len(tokens)) + np.repeat(np.arange(n), np.diff(bounds))] = tokens
    return out, bounds + np.arange(n + 1)


def cut_windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first position of the windows that together score every token once."""
    size = np.diff(bounds)
    count = 1 + np.maximum(0, -(-(size - WIDTH) // (WIDTH - CONTEXT)))
    count[size == 0] = 0
    doc = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, number * (WIDTH - CONTEXT)


def fill(stream: np.ndarray, bounds: np.ndarray, doc: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of targets (-1 beyond the text) and of the tokens before them; a text begins after an end."""
    place = bounds[doc][:, None] + at[:, None] + np.arange(WIDTH)
    inside = place < bounds[doc + 1][:, None]
    target = np.where(inside, stream[np.minimum(place, len(stream) - 1)], -1)
    before = np.where(place == bounds[doc][:, None], end, stream[np.clip(place - 1, 0, len(stream) - 1)])
    return target, np.where(inside, before, end)


def cluster(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Weighted k-means; centres start evenly over the rows' mass, rows given by falling weight."""
    if len(x) <= k:
        return np.arange(len(x))
    mass = np.cumsum(weight)
    centre = x[np.searchsorted(mass, (np.arange(k) + 0.5) / k * mass[-1])]
    for _ in range(CLUSTER_ROUNDS):
        near = (x @ centre.T - 0.5 * (centre * centre).sum(1)).argmax(1)
        total = np.bincount(near, weight, k)
        sums = np.stack([np.bincount(near, weight * x[:, c], k) for c in range(x.shape[1])], 1)
        centre = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centre)
    return near


class Tables:
    """What the counts of the corpus say: class and share of each subword, and the symbols the model reads."""

    def __init__(self, counts: np.ndarray, company: np.ndarray, begins: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.classes = np.zeros(len(counts), np.int64)
        self.classes[order[:OWN_CLASSES]] = np.arange(min(OWN_CLASSES, len(counts)))
        rest = np.ones(len(counts), bool)
        rest[order[:OWN_CLASSES]] = False
        shape = company + 5 * (company.sum(0) + 1) / (company.sum() + company.shape[1])
        shape = np.sqrt(shape / shape.sum(1, keepdims=True))
        for half, first in ((rest & begins, OWN_CLASSES), (rest & ~begins, OWN_CLASSES + CLUSTERS // 2)):
            rows = order[half[order]]
            self.classes[rows] = first + cluster(shape[rows], counts[rows] + 0.5, CLUSTERS // 2)
        smooth = counts + 0.5
        total = np.maximum(np.bincount(self.classes, smooth, OWN_CLASSES + CLUSTERS), 0.5)
        self.bias = np.log(total / total.sum()).astype(np.float32)
        self.share = np.log(smooth / total[self.classes]).astype(np.float64)
        self.symbols = (OWN_SYMBOLS + mix(np.arange(len(counts), dtype=np.uint64)) % np.uint64(SHARED_SYMBOLS)).astype(np.int64)
        self.symbols[order[:OWN_SYMBOLS]] = np.arange(min(OWN_SYMBOLS, len(counts)))


def score_stream(p: dict, tables: Tables, stream: np.ndarray, bounds: np.ndarray, end: int, step: int = 128) -> np.ndarray:
    """Natural log probability of each subword; every one is scored in one window."""
    doc, at = cut_windows(bounds)
    out, room = tables.share[stream], attention.Room()
    for first, rows in ((0, np.flatnonzero(at == 0)), (CONTEXT, np.flatnonzero(at > 0))):
        for i in range(0, len(rows), step):
            pick = rows[i:i + step]
            target, before = fill(stream, bounds, doc[pick], at[pick], end)
            known = target[:, first:] >= 0
            found = attention.log_probability(p, tables.symbols[before], tables.classes[np.maximum(target, 0)], first, room)
            place = bounds[doc[pick]][:, None] + at[pick][:, None] + np.arange(first, WIDTH)
            out[place[known]] += found[known]
    return out


def mixed(n, total: int, spelled):
    """Log10 probability of words with counts n and log10 probabilities of their subwords."""
    by_count = BY_COUNT if total else 0.0
    return np.log10(by_count * n / max(total, 1) + (1 - by_count) * 10.0 ** np.maximum(spelled, -300)) if by_count else spelled


def lowered(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def packed(rows: np.ndarray, size: int) -> pa.Array:
    """Windows of ids below ``size`` (-1 beyond the text), each in as few bytes as do."""
    raw = np.ascontiguousarray(rows.astype(np.uint16 if size < 65535 else np.int32))
    edges = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(raw.itemsize * raw.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(edges), pa.py_buffer(raw)])


def unpacked(column: pa.Array, size: int) -> np.ndarray:
    kind = np.dtype(np.uint16 if size < 65535 else np.int32)
    if not len(column):
        return np.zeros((0, WIDTH + 1), np.int32)
    edges = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[edges[0]:edges[-1]].view(kind).reshape(-1, WIDTH + 1).astype(np.int32)
    raw[raw >= size] = -1
    return raw


def count_corpus(docs: DataFrame, sub) -> DataFrame:
    """Over the training texts: rows (key, word, n) of words, (sub, n) of subwords, and all windows."""
    schema = "key long, word binary, n long, sub int, tokens binary"

    def run(batches):
        s = sub.value
        held: dict[int, list] = {}
        keys, counts, words = [], [], []
        subs = np.zeros(s.size + 1, np.int64)

        def hand_on():
            key, n, word = np.concatenate(keys), np.concatenate(counts), [w for part in words for w in part]
            distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(back, n, len(distinct)).astype(np.int64)
            for i in range(0, len(distinct), 50_000):
                part = slice(i, i + 50_000)
                m = len(distinct[part])
                yield pa.RecordBatch.from_arrays([pa.array(distinct[part].view(np.int64)), pa.array([word[k] for k in first[part]], pa.binary()),
                                                  pa.array(total[part]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["key", "word", "n", "sub", "tokens"])

        for batch in batches:
            for rows, raw, bounds in text_chunks(batch, "text"):
                data, n = lowered(raw), len(bounds) - 1
                found = find_words(data, bounds)
                key, first, back, count = np.unique(Hasher(data).ranges(found.start, found.end), return_index=True, return_inverse=True, return_counts=True)
                plain = data.tobytes()
                keys.append(np.append(key, END))
                counts.append(np.append(count, n))
                words.append([plain[a:b] for a, b in zip(found.start[first].tolist(), found.end[first].tolist())] + [b""])
                ids, edges = s.split(data, found.start[first], found.end[first])
                subs[:s.size] += np.bincount(ids, np.repeat(count, np.diff(edges)), s.size).astype(np.int64)
                subs[s.end] += n
                tokens, place = gather(ids, edges, back)
                stream, ends = with_ends(tokens, place[np.searchsorted(found.doc, np.arange(n + 1))], s.end)
                doc, at = cut_windows(ends)
                if len(doc):
                    target, before = fill(stream, ends, doc, at, s.end)
                    both = packed(np.concatenate([before[:, :1], target], 1), s.size + 1)
                    m = len(both)
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()),
                                                      both], ["key", "word", "n", "sub", "tokens"])
                if sum(map(len, keys)) > HELD_WORDS:
                    yield from hand_on()
                    keys, counts, words = [], [], []
        if keys:
            yield from hand_on()
        used = np.flatnonzero(subs)
        m = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(subs[used]), pa.array(used.astype(np.int32)),
                                          pa.nulls(m, pa.binary())], ["key", "word", "n", "sub", "tokens"])

    return docs.mapInArrow(run, schema)


def train(windows: DataFrame, tables, rounds: int) -> dict[str, np.ndarray]:
    """Parallel training: each task steps through its windows from the common weights, then all weights are averaged.

    A round learns from every token of the training texts once: what a window repeats as context is only read.
    The average is taken per slice of the weights by grouped sums; the driver gets one set of weights.
    """
    spark, end = windows.sparkSession, len(tables.value.symbols) - 1
    p = attention.start(OWN_SYMBOLS + SHARED_SYMBOLS, OWN_CLASSES + CLUSTERS)
    p["b"] = tables.value.bias.copy()  # training starts from the classes' frequencies in the whole corpus
    for turn in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def learn(batches, now=now, turn=turn):
            mine, seen = {k: v.copy() for k, v in now.value.items()}, 0
            adam, t, room = attention.Adam(mine, RATE / (1 + turn), ("e",)), tables.value, attention.Room()
            place, rng = np.zeros(len(mine["e"]), np.int64), np.random.default_rng(turn)
            for batch in batches:
                rows = unpacked(batch.column("tokens"), len(t.symbols))
                begins = rows[:, 0] == end  # these have no context, all their tokens are learned from
                for first, some in ((0, np.flatnonzero(begins)), (CONTEXT, np.flatnonzero(~begins))):
                    some = rng.permutation(some)
                    for i in range(0, len(some), BATCH):
                        window = rows[some[i:i + BATCH]]
                        target = window[:, 1:]
                        known = target >= 0
                        symbol = t.symbols[np.concatenate([window[:, :1], np.maximum(target[:, :-1], 0)], 1)]
                        used = np.zeros(len(place), bool)
                        used[symbol] = True
                        there = np.flatnonzero(used)
                        place[there] = np.arange(len(there))
                        part = mine | {"e": mine["e"][there]}  # only the symbols of the batch take a step
                        adam.step(attention.gradient(part, place[symbol], t.classes[np.maximum(target, 0)], known.astype(np.float32), first, room), {"e": there})
                        seen += int(known[:, first:].sum())
            if seen:
                yield from sliced(np.frombuffer(attention.pack(mine), np.float32) * np.float64(seen), seen)

        seen, flat = summed(windows.mapInArrow(learn, SLICED))
        if not seen:
            break
        p = attention.unpack((flat / seen).astype(np.float32).tobytes(), p)
    return p


SLICED = "slice long, seen long, total binary"


#: Numbers in a slice, so that a batch of slices stays small whatever the vector.
SLICE = 2048


def sliced(flat: np.ndarray, seen: int):
    """A task's vector in parts, so that a sum over tasks is spread."""
    parts = [flat[i:i + SLICE].astype(np.float64).tobytes() for i in range(0, len(flat), SLICE)]
    yield pa.RecordBatch.from_pydict({"slice": pa.array(range(len(parts)), pa.int64()), "seen": pa.array([seen] * len(parts), pa.int64()),
                                      "total": pa.array(parts, pa.binary())})


def summed(parts: DataFrame) -> tuple[int, np.ndarray]:
    """Sum of all tasks' ``seen`` and vectors; the driver gets one vector.

    A task adds up the slices it is dealt as they stream in and holds one sum per slice, so any number of tasks may have parts.
    """
    def add(batches):
        held: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in ("slice", "seen", "total"))):
                seen[k] = seen.get(k, 0) + n
                if k in held:
                    held[k] += np.frombuffer(raw)
                else:
                    held[k] = np.frombuffer(raw).copy()
        if held:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(held), pa.int64()), "seen": pa.array(list(seen.values()), pa.int64()),
                                              "total": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    rows = sorted(parts.repartition("slice").mapInArrow(add, SLICED).collect(), key=lambda r: r.slice)
    return (rows[0].seen, np.concatenate([np.frombuffer(bytes(r.total)) for r in rows])) if rows else (0, np.zeros(0))


def company_of(windows: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Per subword, in how many of its places each of the most frequent subwords was in the same window."""
    top, size = np.argsort(-counts, kind="stable")[:COMPANY], len(counts)

    def run(batches):
        place = np.full(size + 1, -1)
        place[top] = np.arange(len(top))
        total, seen = np.zeros((size + 1, COMPANY)), 0
        for batch in batches:
            rows = unpacked(batch.column("tokens"), size)[:, 1:]
            hit, rows = place[rows], np.where(rows < 0, size, rows)  # no token is the last
            there = np.zeros((len(rows), COMPANY), bool)
            at = np.nonzero(hit >= 0)
            there[at[0], hit[at]] = True
            for c in range(COMPANY):
                total[:, c] += np.bincount(rows[there[:, c]].ravel(), minlength=size + 1)
            seen += len(rows)
        if seen:
            yield from sliced(total[:-1].ravel(), seen)

    seen, flat = summed(windows.mapInArrow(run, SLICED))
    return flat.reshape(size, COMPANY) if seen else np.zeros((size, COMPANY))


def least_frequent(words: DataFrame) -> int:
    """Smallest count of which no more than ``FREQUENT`` words have as much, from the sizes of logarithmic bands of counts."""
    bands = words.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 64).alias("band")).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("words"))
    least, held = 1 << 62, 0
    for r in sorted(bands.collect(), key=lambda r: -r.band):  # a few thousand bands at most
        held += r.words
        if held > FREQUENT:
            break
        least = r.least
    return least


def score(docs: DataFrame, vocabulary: str, training: Column, text: str = "text", id_column: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are words with A-Z lower-cased, then one end.  ``training`` tells the texts that are learned from (null: yes).
    ``base_score`` is the add-one log10 probability by the words' counts in them, ``score`` that of the model:
    attention over subwords and the words' shares of the corpus, half each.  A null text is empty and holds the end only.  Repeated rows count as often as they stand
    there and are scored alike; an empty table gives no rows; with no training text all counts are 0.

    Counts run over all training texts, with the words of a task pre-aggregated.  The counts of the
    ``FREQUENT`` most frequent words go to every task; the other words of a text are joined to the counts.
    All windows of the training texts tell the company that subwords keep and train the attention weights.
    """
    spark = docs.sparkSession

    def written(df, label):
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    sub = spark.sparkContext.broadcast(Subwords(Vocabulary(vocabulary)))
    base = docs.select(F.col(id_column).alias("id"), F.coalesce(training, F.lit(True)).alias("training"), F.col(text).alias("text"))
    counted = written(count_corpus(base.filter("training").select("text"), sub), "counts")
    words = written(counted.filter("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"), F.min("word").alias("word")), "words")
    ends = F.sum(F.when(F.col("key") == int(END.view(np.int64)), F.col("n")))
    total, distinct, end_n = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(ends, F.lit(0))).first()
    subs = np.zeros(sub.value.size + 1, np.int64)
    for r in counted.filter("sub IS NOT NULL").groupBy("sub").agg(F.sum("n").alias("n")).collect():
        subs[r["sub"]] = r["n"]
    windows = counted.filter("tokens IS NOT NULL").select("tokens")
    begins = np.array([p[:1] == b" " for p in sub.value.vocab.pieces] + [True])
    tables = spark.sparkContext.broadcast(Tables(subs, company_of(windows, subs), begins))
    weights = spark.sparkContext.broadcast(train(windows, tables, rounds))
    frequent = words.filter(F.col("n") >= least_frequent(words)).select("key", "n", "word").toArrow().sort_by("key")
    raw = frequent.column("word").to_pylist()
    data = np.frombuffer(b"".join(raw), np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
    key = np.asarray(frequent.column("key")).view(np.uint64)
    order = np.argsort(key)
    ids, bounds = sub.value.split(data, edges[:-1][order], edges[1:][order])
    common = spark.sparkContext.broadcast((key[order], np.asarray(frequent.column("n"))[order].astype(np.float64), ids.astype(np.int32), bounds.astype(np.int32)))

    def work(rows, raw_data, bounds_):
        s, (keys, n_of, pool, at) = sub.value, common.value
        text_data, n = lowered(raw_data), len(bounds_) - 1
        found = find_words(text_data, bounds_)
        hashes = Hasher(text_data).ranges(found.start, found.end)
        distinct_, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, distinct_), max(len(keys) - 1, 0))
        usual = keys[place] == distinct_ if len(keys) else np.zeros(len(distinct_), bool)
        rare = np.flatnonzero(~usual)
        more, more_at = s.split(text_data, found.start[first[rare]], found.end[first[rare]])
        pick = np.zeros(len(distinct_), np.int64)
        pick[usual], pick[rare] = place[usual], len(at) - 1 + np.arange(len(rare))
        tokens, edges_ = gather(np.concatenate([pool, more]), np.concatenate([at, at[-1] + more_at[1:]]), pick[back])
        docs_at = np.searchsorted(found.doc, np.arange(n + 1))
        stream, ends = with_ends(tokens, edges_[docs_at], s.end)
        spelled = np.concatenate([[0], np.cumsum(score_stream(weights.value, tables.value, stream, ends, s.end))]) / LOG10
        word_lp = spelled[edges_[1:] + found.doc] - spelled[edges_[:-1] + found.doc]
        end_lp = spelled[ends[1:]] - spelled[ends[1:] - 1]
        log_n = np.where(usual, np.log10(1 + n_of[place]) if len(keys) else 0.0, 0.0)[back]
        known = usual[back]
        count_of = np.where(usual, n_of[place] if len(keys) else 0.0, 0.0)[back]
        new = np.log10(1 - BY_COUNT) + word_lp if total else word_lp  # until a rare word's count is known
        scores = np.bincount(found.doc, np.where(known, mixed(count_of, total, word_lp), new), n) + mixed(end_n, total, end_lp)
        unusual = np.flatnonzero(~known)
        edge = np.searchsorted(found.doc[unusual], np.arange(n + 1))
        odd = hashes[unusual].view(np.int64)
        count = np.diff(docs_at)
        return {"id": rows.column(rows.schema.get_field_index("id")), "training": rows.column(rows.schema.get_field_index("training")),
                "n_tokens": count + 1, "n_known": np.bincount(found.doc[known], minlength=n) + int(end_n > 0),
                "logs": np.bincount(found.doc, log_n, n) + np.log10(1 + end_n), "score": scores,
                "spelled": pa.array([word_lp[unusual[a:b]] for a, b in zip(edge[:-1], edge[1:])], pa.list_(pa.float64())),
                "rare": pa.array([odd[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.list_(pa.int64()))}

    id_type = docs.schema[id_column].dataType.simpleString()
    out = over_texts(base.select("id", "training", "text"), work, f"id {id_type}, training boolean, n_tokens long, n_known long, logs double, score double, "
                                                                  "spelled array<double>, rare array<long>")
    scored = written(out.withColumn("place", F.monotonically_increasing_id()), "scored")
    rest = scored.select("place", F.explode(F.arrays_zip("rare", "spelled")).alias("r")).select("place", F.col("r.rare").alias("key"), "r.spelled")
    rest = rest.join(words.select("key", "n"), "key")
    lp = F.greatest("spelled", F.lit(-300.0))
    gain = F.log10(BY_COUNT * F.col("n") / max(total, 1) + (1 - BY_COUNT) * F.pow(F.lit(10.0), lp)) - float(np.log10(1 - BY_COUNT)) - F.col("spelled")
    rest = rest.groupBy("place").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"), F.count(F.lit(1)).alias("more_known"), F.sum(gain).alias("gain"))
    joined = scored.drop("rare", "spelled").join(rest, "place", "left")
    log_total = float(np.log10(total + distinct + 1))
    return joined.select(F.col("id").alias(id_column), (~F.col("training")).alias("held_out"), "n_tokens",
                         (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                         (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * log_total).alias("base_score"),
                         (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
