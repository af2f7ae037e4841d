"""Document quality by hierarchical empirical Bayes: text evidence and the record of host and path.

A logistic model of words and layout gives each document a log odds of being good, and one of being
toxic.  Documents are grouped by path and host; each group's rate of good documents is shrunk to that of the
level above (path to host, host to all) by a weight estimated from how much the groups differ.  A
document's odds are then those of its text with the global rate exchanged for its path's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.llm.textops import LEAD, LOWER, Hasher, find_words, hashed_sample, over_texts, per_doc
from tempaudit.session import scratch_path

#: Largest number of labelled documents the text model is fitted on, taken in hash order.
TRAIN_ROWS = 12_000
#: Words per target the model looks at, and documents of the sample that must hold such a word.
WORDS, LEAST_DOCS = 512, 8
#: Bounds of the weight (in documents) of the level above.
WEIGHTS = (2.0, 1000.0)

#: Bytes that words are made of here: letters and everything outside ASCII; all other bytes part words.
_KEEP = np.zeros(256, bool)
_KEEP[65:91] = _KEEP[97:123] = _KEEP[128:] = True
_FOLD = np.where(_KEEP, LOWER, np.uint8(32)).astype(np.uint8)
_CLASSES = {"upper": range(65, 91), "small": range(97, 123), "digit": range(48, 58), "newline": [10], "mark": list(b"#$%&*!"), "bar": list(b"|<>{}[]=_\\/")}
STATS = [*_CLASSES, "log_words", "word_length", "again", "variety", "long_words", "loud_lines"]


def _class_table(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


_TABLES = {k: _class_table(v) for k, v in _CLASSES.items()}


def describe(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Layout figures of each text, and its distinct words as (text, hash)."""
    n = len(bounds) - 1
    words = find_words(_FOLD[data], bounds)
    keys = Hasher(_FOLD[data]).ranges(words.start, words.end) if len(data) else np.zeros(0, np.uint64)
    count = np.bincount(words.doc, minlength=n)
    chars = np.maximum(per_doc(LEAD[data], bounds), 1)
    size = words.end - words.start
    order = np.lexsort((keys, words.doc))
    doc, key = words.doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (words.doc[1:] == words.doc[:-1])
    total = np.maximum(count, 1)
    capital = _TABLES["upper"][data[words.end - 1]] if len(data) else again  # words that end in a capital
    figures = [per_doc(t[data], bounds) / chars for t in _TABLES.values()]
    figures += [np.log1p(count), np.bincount(words.doc, size, n) / total, np.bincount(words.doc[again], minlength=n) / total,
                np.bincount(doc[new], minlength=n) / total, np.bincount(words.doc[size > 30], minlength=n) / total,
                np.bincount(words.doc[capital & (size > 1)], minlength=n) / total]
    return np.stack(figures, 1), doc[new], key[new]


class TextModel:
    """Logistic regression on standardised layout figures (with squares) and the presence of chosen words."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words.astype(np.uint64))
        self.centre, self.scale = np.zeros(len(STATS)), np.ones(len(STATS))
        self.weights: dict[str, np.ndarray] = {}

    def matches(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return doc[:0], doc[:0]
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        hit = self.words[at] == key
        return doc[hit], at[hit]

    def _dense(self, figures: np.ndarray) -> np.ndarray:
        z = np.clip((figures - self.centre) / self.scale, -6, 6)
        return np.concatenate([z, z * z, np.ones((len(z), 1))], 1)

    def fit(self, figures: np.ndarray, doc: np.ndarray, column: np.ndarray, targets: dict[str, np.ndarray], steps: int = 250) -> None:
        self.centre, self.scale = figures.mean(0), figures.std(0) + 1e-6
        dense, n = self._dense(figures), len(figures)
        for name, y in targets.items():
            known = np.isfinite(y)
            if min((y[known] > 0.5).sum(), (y[known] <= 0.5).sum()) < 5:
                continue  # nothing to tell apart
            w = np.zeros(dense.shape[1] + len(self.words))
            first, second = np.zeros_like(w), np.zeros_like(w)
            goal = np.where(known, y, 0)
            for t in range(1, steps + 1):
                z = dense @ w[:dense.shape[1]] + np.bincount(doc, w[dense.shape[1] + column], n)
                d = np.where(known, 1 / (1 + np.exp(-np.clip(z, -40, 40))) - goal, 0) / known.sum()
                g = np.concatenate([dense.T @ d, np.bincount(column, d[doc], len(self.words))]) + 1e-4 * w
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                w -= 0.1 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8) * min(1.0, 2 * (1 - t / (steps + 1)))
            self.weights[name] = w

    def log_odds(self, name: str, figures: np.ndarray, doc: np.ndarray, column: np.ndarray) -> np.ndarray:
        w = self.weights.get(name)
        if w is None:
            return np.zeros(len(figures))
        deep = 2 * len(STATS) + 1
        return np.clip(self._dense(figures) @ w[:deep] + np.bincount(doc, w[deep + column], len(figures)), -20, 20)


def train(docs: DataFrame, labels: DataFrame, text: str, id_column: str, targets: tuple[str, ...], rows: int) -> TextModel:
    """Fit on at most ``rows`` labelled documents, the first in the order of their ids' hashes."""
    spark = docs.sparkSession
    chosen = hashed_sample(labels, rows, "_key")
    sample = docs.select(F.col(id_column).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")

    def work(part, data, bounds):
        figures, doc, key = describe(data, bounds)
        edges = np.searchsorted(doc, np.arange(len(bounds)))
        key = key.view(np.int64)
        return {"figures": pa.array([r.tobytes() for r in figures], pa.binary()),
                "words": pa.array([key[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.list_(pa.int64())),
                **{t: part.column(part.schema.get_field_index(t)) for t in targets}}

    path = scratch_path(spark, "labelled")
    over_texts(sample, work, "figures binary, words array<long>, " + ", ".join(f"{t} double" for t in targets)).write.parquet(path)
    seen = spark.read.parquet(path)
    counted = seen.select(F.explode("words").alias("word"), *targets).groupBy("word").agg(
        F.count(F.lit(1)).alias("docs"), *[F.avg(t).alias(t) for t in targets]).filter(F.col("docs") >= LEAST_DOCS)
    base = seen.agg(*[F.avg(t).alias(t) for t in targets]).first()
    words = set()
    for t in targets:
        if base[t] is not None and 0 < base[t] < 1:
            telling = F.abs(F.col(t) - base[t]) * F.sqrt("docs")
            words |= {r.word for r in counted.orderBy(telling.desc(), "word").limit(WORDS).collect()}
    model = TextModel(np.array(sorted(words), np.int64).view(np.uint64))

    def found(batches):
        for batch in batches:
            lists = batch.column("words")
            doc = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            hit, column = model.matches(doc, np.asarray(lists.flatten()).view(np.uint64))
            edges = np.searchsorted(hit, np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column("figures"), pa.array([column[a:b].astype(np.uint16).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
                *[batch.column(t) for t in targets]], ["figures", "found", *targets])

    got = seen.mapInArrow(found, "figures binary, found binary, " + ", ".join(f"{t} double" for t in targets)).collect()
    if got:
        columns = [np.frombuffer(bytes(r.found), np.uint16) for r in got]
        goals = {t: np.array([np.nan if r[t] is None else r[t] for r in got]) for t in targets}
        order = sorted(range(len(got)), key=lambda i: (bytes(got[i].figures), bytes(got[i].found)))  # the same whatever the partitions
        figures = np.stack([np.frombuffer(bytes(got[i].figures)) for i in order])
        doc = np.repeat(np.arange(len(order)), [len(columns[i]) for i in order])
        model.fit(figures, doc, np.concatenate([columns[i] for i in order]).astype(np.int64), {t: g[order] for t, g in goals.items()})
    return model


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _weight(groups: DataFrame, rate: float, n: str, good: str) -> float:
    """Weight of the level above by the method of moments: large where groups differ no more than chance makes them."""
    row = groups.filter(f"{n} > 0").agg(F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.count(F.lit(1)).alias("k"),
                                        F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - rate, 2)).alias("spread")).first()
    within = rate * (1 - rate)
    if not row.k or row.k < 2 or within <= 0:
        return WEIGHTS[1]
    between = (row.spread - (row.k - 1) * within) / max(row.n - row.nn / row.n, 1e-9)
    return float(np.clip(within / between - 1 if between > 0 else WEIGHTS[1], *WEIGHTS))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text: str = "text", id_column: str = "doc_id",
             rows: int = TRAIN_ROWS, threshold: float = 0.5, toxic_threshold: float = 0.5) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``p_quality``, ``p_toxic`` (posteriors), ``host_quality``, ``path_quality``
    (shrunk rates) and ``kept``: p_quality >= threshold, p_toxic < toxic_threshold and at least one word.

    ``labels``: the id, quality and toxic (0/1 or null); several labels of an id are averaged, ids without a document are
    ignored.  ``host`` and ``path`` are columns of ``docs``; null is a group of its own.  A group's rate counts
    labels where a document has one and the text model's probability elsewhere, over all documents.
    Without labels of both kinds a target stays undecided (0.5), which keeps.  Null and empty texts are
    not kept.  Repeated rows give repeated results, rows with a null id are judged like others.

    Texts are read once for the sample and once for all; group sums are pre-aggregated, so a host of any
    size is a few rows in the shuffle.
    """
    spark = docs.sparkSession
    targets = ("quality", "toxic")
    known = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_key")).agg(
        *[F.avg(F.col(t).cast("double")).alias(t) for t in targets]).filter("quality IS NOT NULL OR toxic IS NOT NULL")
    model = spark.sparkContext.broadcast(train(docs, known, text, id_column, targets, rows))

    def work(part, data, bounds):
        figures, doc, key = describe(data, bounds)
        hit, column = model.value.matches(doc, key)
        words = np.bincount(find_words(data, bounds).doc, minlength=len(bounds) - 1)
        return {"id": part.column(part.schema.get_field_index("id")), "host": part.column(part.schema.get_field_index("host")),
                "path": part.column(part.schema.get_field_index("path")), "n_words": words,
                **{f"t_{t}": model.value.log_odds(t, figures, hit, column) for t in targets}}

    id_type = docs.schema[id_column].dataType.simpleString()
    flat = docs.select(F.col(id_column).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    scored = over_texts(flat, work, f"id {id_type}, host string, path string, n_words long, t_quality double, t_toxic double")
    place = scratch_path(spark, "scored")
    scored.join(known, F.col("id") == F.col("_key"), "left").drop("_key").write.parquet(place)
    scored = spark.read.parquet(place)
    for t in targets:
        scored = scored.withColumn(f"y_{t}", F.coalesce(t, 1 / (1 + F.exp(-F.col(f"t_{t}")))))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y_{t}").alias(t) for t in targets])
    place = scratch_path(spark, "paths")
    paths.write.parquet(place)
    paths = spark.read.parquet(place)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(t).alias(f"h_{t}") for t in targets])
    total = paths.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in targets]).first()
    both = paths.withColumnRenamed("host", "_host").join(hosts, F.col("_host").eqNullSafe(F.col("host"))).drop("_host")
    for t in targets:
        rate = total[t] / total.n if total.n else 0.5
        k_host, k_path = _weight(hosts, rate, "hn", f"h_{t}"), _weight(paths, rate, "n", t)
        both = both.withColumn(f"host_{t}", (F.col(f"h_{t}") + k_host * rate) / (F.col("hn") + k_host))
        both = both.withColumn(f"path_{t}", (F.col(t) + k_path * F.col(f"host_{t}")) / (F.col("n") + k_path))
        both = both.withColumn(f"shift_{t}", _logit(F.col(f"path_{t}")) - _logit(F.lit(rate)))
    sites = both.select(F.col("host").alias("_host"), F.col("path").alias("_path"), *[f"{c}_{t}" for t in targets for c in ("host", "path", "shift")])
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    for t in targets:
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"t_{t}") + F.col(f"shift_{t}")))))
    tests = {"quality": F.col("p_quality") >= threshold, "toxic": F.col("p_toxic") < toxic_threshold}
    kept = F.col("n_words") > 0
    for t in model.value.weights:
        kept &= tests[t]
    return out.select(F.col("id").alias(id_column), "n_words", "p_quality", "p_toxic", "host_quality", "path_quality", kept.alias("kept"))
