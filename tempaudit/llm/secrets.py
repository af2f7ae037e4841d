"""Secret scan: fixed patterns plus a character convolutional network over every candidate string.

A candidate is a maximal run of at least 12 of the characters secrets are written in.  The network reads all of it,
in segments with the bytes before and after each, and pools over the segments.  Findings of the fixed patterns are
the positive labels: training windows are made from their values, always without the keyword, many of them swapped for
random ones of the same kinds, so that the network learns what a value looks like and few findings, or none, are enough.
Candidates that no pattern covers are unlabelled: those that look like findings at first are left out of the second
fit, and each is scored by a network that was not fitted on candidates of its half (cross-fitting), so that an unknown
secret among them is not learned away.  The threshold keeps the stated share of held-out findings of every kind of value.
All different findings and candidates take part: they are dealt to groups by hash, the networks are fitted group by group
and averaged, and the threshold comes from counts of the scores of all groups.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempaudit.llm.attention import pack, unpack
from tempaudit.llm.lm_scoring import SLICED, sliced, summed
from tempaudit.llm.textops import LEAD, Hasher, over_texts
from tempaudit.session import scratch_path

ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                    rb"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN, CANDIDATE_MIN = 6, 20, 24, 12
KINDS = ("assign", "access", "hex", "model")

#: Bytes of a candidate that one segment holds, and bytes before and after it that the network reads as well.
SEGMENT, AROUND = 48, 16
WIDTH = AROUND + SEGMENT + AROUND
#: Different windows of findings and candidates that one group has, on the mean; a group is fitted on in one task.
GROUP = 36_000
#: Steps of averaging per fit, where there are several groups: each learns from one part of every group.
TURNS = 4
#: Rows that a group of any size takes steps on in a fit, at most six times each and at least once.
PRACTICE = 36_000
#: Least number of training windows that are made from a group's findings, and candidates for one of them where that makes more.
MADE, PER_MADE = 3000, 3
#: Least number of held-out ones: few of a kind would give it a low threshold by chance.
MADE_HELD_OUT = 12_000
#: Scores are counted in steps of one in so many.
STEPS = 256
#: Share of held-out findings of every kind that the threshold must keep.
RECALL = 0.95
#: Findings whose value is shorter always have it swapped for training: a short word alone is no secret.
TELLING = 20
#: Characters of random values, and beginnings that some of them have.
ALPHABETS = (b"0123456789abcdef", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
             b"abcdefghijklmnopqrstuvwxyz0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
             b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
BEGINNINGS = (b"", b"", b"", b"ghp_", b"sk-", b"AKIA", b"xoxb-")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
def _runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return start[long], end[long]


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def segments(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all segments of the spans, the bytes of the span in each, and the span of each; nothing beyond lo and hi is read."""
    count = np.maximum(1, -(-(end - start) // SEGMENT))
    span = np.repeat(np.arange(len(start)), count)
    first = start[span] + (np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    at = first[:, None] + np.arange(-AROUND, SEGMENT + AROUND)
    inside = (at >= lo[span][:, None]) & (at < hi[span][:, None])
    window = np.where(inside, buf[np.clip(at, 0, max(len(buf) - 1, 0))] if len(buf) else 0, 0).astype(np.uint8)
    return window, np.minimum(end[span] - first, SEGMENT), span


def find(data: np.ndarray, bounds: np.ndarray):
    """Base matches (kind, start, end, start and end of the value) and candidates (start, end, covered) of texts, in bytes.

    The texts are laid out with a newline between them, which no pattern can cross.
    """
    raw = data.tobytes()
    joined = b"\n".join(raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    buf = np.frombuffer(joined, np.uint8)
    starts = bounds[:-1] + np.arange(len(bounds) - 1)
    found = [(0, *m.span(), *m.span(2)) for m in ASSIGN.finditer(joined) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    found += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(joined) if m.end() - m.start() >= ACCESS_MIN]
    found += [(2, a, b, a, b) for a, b in zip(*(x.tolist() for x in _runs(_HEX[buf], HEX_MIN)))]
    base = np.array(sorted(found, key=lambda x: (x[1], x[0])), np.int64).reshape(-1, 5)
    start, end = _runs(_TOKEN[buf], CANDIDATE_MIN)
    cover = np.zeros(len(buf) + 1, np.int64)
    np.add.at(cover, base[:, 1], 1)
    np.add.at(cover, base[:, 2], -1)
    inside = _sums(np.cumsum(cover[:-1]) > 0)
    return buf, starts, base, start, end, inside[end] > inside[start]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan_base(docs: DataFrame, text: str, id_column: str) -> DataFrame:
    """Per row the base spans (kind, start, end), the uncovered candidates (start, end, half, segments) with their windows and bytes
    per window, and the findings' first windows with their bytes."""
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = (f"`{id_column}` {id_type}, spans array<long>, candidates array<long>, windows binary, sizes binary, "
              "found binary, found_sizes binary")

    def work(rows, data, bounds):
        buf, starts, base, start, end, covered = find(data, bounds)
        start, end = start[~covered], end[~covered]
        points, stops = _sums(LEAD[buf]), starts + np.diff(bounds)
        doc = np.searchsorted(starts, start, side="right") - 1
        window, size, span = segments(buf, start, end, starts[doc], stops[doc])
        owner = np.searchsorted(starts, base[:, 1], side="right") - 1
        theirs, their_size, whose = segments(buf, base[:, 3], base[:, 4], starts[owner], stops[owner])
        once = np.concatenate([[True], whose[1:] != whose[:-1]]) if len(whose) else np.zeros(0, bool)
        theirs, their_size = theirs[once], their_size[once]
        # equal strings are in the same half, wherever they stand
        half = Hasher(buf).ranges(start, end) % np.uint64(2) if len(start) else np.zeros(0, np.uint64)
        count = np.bincount(span, minlength=len(start))
        seg = np.concatenate([[0], np.cumsum(count)])
        n, out = len(starts), {k: [] for k in ("spans", "candidates", "windows", "sizes", "found", "found_sizes")}
        where = np.searchsorted(base[:, 1], np.append(starts, len(buf) + 1))
        cut = np.searchsorted(start, np.append(starts, len(buf) + 1))
        for i in range(n):
            origin, b, c = points[starts[i]], slice(where[i], where[i + 1]), slice(cut[i], cut[i + 1])
            g = slice(seg[cut[i]], seg[cut[i + 1]])
            out["spans"].append(np.stack([base[b, 0], points[base[b, 1]] - origin, points[base[b, 2]] - origin], 1).ravel())
            out["candidates"].append(np.stack([points[start[c]] - origin, points[end[c]] - origin, half[c].astype(np.int64), count[c]], 1).ravel())
            out["windows"].append(window[g].tobytes())
            out["sizes"].append(size[g].astype(np.uint8).tobytes())
            out["found"].append(theirs[b].tobytes())
            out["found_sizes"].append(their_size[b].astype(np.uint8).tobytes())
        kinds = {"spans": pa.list_(pa.int64()), "candidates": pa.list_(pa.int64())}
        return {id_column: rows.column(rows.schema.get_field_index(id_column)), **{k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()}}

    return over_texts(docs.select(id_column, text), work, schema, text)


def made_findings(rng: np.random.Generator, found: tuple, plain: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training windows of secrets: values of findings, half of them swapped for random ones (all, where short), in the surroundings
    of candidates without a finding, so that neither a keyword nor its absence tells them apart.  The third array has the kind of
    value: that of its alphabet, or -1 for one of a finding."""
    out, size, kind = np.zeros((n, WIDTH), np.uint8), np.zeros(n, np.int64), np.full(n, -1)
    (windows, sizes), (others, lengths) = found, plain
    for i in range(n):
        j = i % max(len(windows), 1)
        if len(windows) and sizes[j] >= TELLING and rng.random() < 0.5:
            value = windows[j][AROUND:AROUND + sizes[j]]
        else:
            kind[i] = rng.integers(len(ALPHABETS))
            begin, letters = BEGINNINGS[rng.integers(len(BEGINNINGS))], np.frombuffer(ALPHABETS[kind[i]], np.uint8)
            value = np.concatenate([np.frombuffer(begin, np.uint8), rng.choice(letters, rng.integers(20, SEGMENT + 1 - len(begin)))])
        k = rng.integers(len(others))
        rest = others[k][AROUND + lengths[k]:][:WIDTH - AROUND - len(value)]
        out[i, :AROUND], out[i, AROUND:AROUND + len(value)], size[i] = others[k][:AROUND], value, len(value)
        out[i, AROUND + len(value):][:len(rest)] = rest
    return out, size, kind


class Network:
    """Embedding, one convolution, largest and mean response over positions, logistic output; a candidate has the mean of its segments."""

    DIM, SPAN, FILTERS = 8, 5, 16

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        deep = self.SPAN * (self.DIM + 1)
        p = {"e": rng.normal(0, 0.3, (256, self.DIM)), "w": rng.normal(0, 0.2, (deep, self.FILTERS)), "b": np.zeros(self.FILTERS),
             "v": rng.normal(0, 0.2, 2 * self.FILTERS), "c": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 1.0

    def _columns(self, x, length):
        inside = (np.arange(WIDTH) >= AROUND) & (np.arange(WIDTH) < AROUND + length[:, None])
        z = np.concatenate([self.p["e"][x], inside[:, :, None]], 2, dtype=np.float32)
        return np.lib.stride_tricks.sliding_window_view(z, self.SPAN, 1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - self.SPAN + 1, -1)

    def _forward(self, x, length):
        cols = self._columns(x, length)
        h = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        pooled = np.concatenate([h.max(1), h.mean(1)], 1)
        return cols, h, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def logits(self, x, length, step: int = 512) -> np.ndarray:
        parts = [self._forward(x[i:i + step], length[i:i + step])[3] for i in range(0, len(x), step)]
        return np.concatenate(parts).astype(float) if parts else np.zeros(0)

    def chance(self, logits) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -40, 40)))

    def _gradient(self, x, length, y):
        cols, h, pooled, out = self._forward(x, length)
        d = ((1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) / len(y)).astype(np.float32)
        g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
        dp = d[:, None] * self.p["v"]
        top, mean = dp[:, :self.FILTERS], dp[:, self.FILTERS:]
        dh = np.repeat(mean[:, None] / h.shape[1], h.shape[1], 1)
        np.put_along_axis(dh, best := h.argmax(1)[:, None], np.take_along_axis(dh, best, 1) + top[:, None], 1)
        dh *= h > 0
        g["b"], g["w"] = dh.sum((0, 1)), cols.reshape(-1, cols.shape[2]).T @ dh.reshape(-1, self.FILTERS)
        dc = (dh @ self.p["w"].T).reshape(*h.shape[:2], self.SPAN, self.DIM + 1)[..., :self.DIM]
        dz = np.zeros((len(x), WIDTH, self.DIM), np.float32)
        for k in range(self.SPAN):
            dz[:, k:k + h.shape[1]] += dc[:, :, k]
        flat, at = dz.reshape(-1, self.DIM), x.ravel()
        g["e"] = np.stack([np.bincount(at, flat[:, c], 256) for c in range(self.DIM)], 1)
        return g

    def fit(self, x, length, y, epochs: int = 6, step: int = 128, rate: float = 0.01, seed: int = 5) -> None:
        rng, t = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), step):
                rows, t = order[i:i + step], t + 1
                batch = x[rows].copy()
                batch[rng.random(len(rows)) < 0.5, :AROUND] = 0
                batch[rng.random(len(rows)) < 0.3, AROUND + SEGMENT:] = 0
                for k, g in self._gradient(batch, length[rows], y[rows]).items():
                    first[k] += (0.1 * (g - first[k])).astype(np.float32)
                    second[k] += (0.001 * (g * g - second[k])).astype(np.float32)
                    self.p[k] -= (rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)

    def calibrate(self, z, y, kind, n, recall: float) -> None:
        """Platt scaling on counted scores of held-out rows, then the highest threshold that keeps ``recall`` of the findings of each kind."""
        for _ in range(300):
            p = self.chance(z)
            self.slope -= 0.05 * (np.average((p - y) * z, weights=n) + 1e-3 * self.slope)
            self.shift -= 0.05 * np.average(p - y, weights=n)
        each = (ranked(self.chance(z[of]), n[of], 1 - recall) for of in (kind == k for k in np.unique(kind[y == 1])))
        self.threshold = float(min(each))


def ranked(value: np.ndarray, n: np.ndarray, share: float) -> float:
    """The counted value that the stated share of all lie before."""
    order = np.argsort(value, kind="stable")
    upto = np.cumsum(n[order])
    return value[order][np.searchsorted(upto, int(share * upto[-1]), side="right")]


#: Kinds of counted scores beside those of the alphabets and of findings (-1): of made findings learned from, and of candidates.
LEARNED, PLAIN = -3, -2


def grouped(found: DataFrame, group: int) -> tuple[DataFrame, int]:
    """All different first windows of findings and candidates, a row per group, and the number of groups they were dealt to by hash.

    A group's number is a value of its own, not that of a shuffle partition: however many there are, it is fitted on as one group.
    """
    spark = found.sparkSession

    def pieces(batches):
        for batch in batches:
            table = np.concatenate([np.zeros((0, 4), np.int64), *[np.asarray(v, np.int64).reshape(-1, 4) for v in batch.column(0).to_pylist()]])
            first = np.cumsum(table[:, 3]) - table[:, 3]
            raw, sizes, theirs, their_sizes = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8) for c in range(1, 5))
            rows = [np.column_stack([table[:, 2].astype(np.uint8), sizes[first], raw.reshape(-1, WIDTH)[first]]),
                    np.column_stack([np.full(len(their_sizes), 2, np.uint8), their_sizes, theirs.reshape(-1, WIDTH)])]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(sorted({r.tobytes() for x in rows for r in x}), pa.binary())})

    def packed(batches):
        held: dict[int, set[bytes]] = {}
        for batch in batches:
            for number, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(number, set()).add(r)
        for _, rows in sorted(held.items()):
            rows = sorted(rows, key=lambda r: (hashlib.blake2b(r, digest_size=8).digest(), r))
            yield pa.RecordBatch.from_pydict({"rows": pa.array([b"".join(rows)], pa.binary())})

    every = found.select("candidates", "windows", "sizes", "found", "found_sizes").mapInArrow(pieces, "piece binary")
    count = every.agg(F.approx_count_distinct(F.xxhash64("piece"))).first()[0]
    groups = max(1, round(count / group))
    path = scratch_path(spark, "groups")
    dealt = every.select(F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("number"), "piece")
    dealt.repartition(groups, "number").mapInArrow(packed, "rows binary").write.parquet(path)
    return spark.read.parquet(path), groups


def unpacked(batches):
    """Per group its number, which its rows alone decide, the windows and sizes of its findings, and of the candidates of each half."""
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH + 2)
            found, *halves = ((x[:, 2:], x[:, 1].astype(np.int64)) for x in (rows[rows[:, 0] == k] for k in (2, 0, 1)))
            both = tuple(np.concatenate(x) for x in zip(*halves))
            yield int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest()), found, [h if len(h[0]) else both for h in halves]


def made(seed: list[int], found: tuple, plain: tuple, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    around = plain if len(plain[0]) else (np.zeros((1, WIDTH), np.uint8), np.zeros(1, np.int64))
    return made_findings(np.random.default_rng(seed), found, around, max(least, len(found[0]), len(plain[0]) // PER_MADE))


def lesson(number: int, found: tuple, halves: list, own: int, turn: int, turns: int) -> tuple[tuple, tuple]:
    """Made findings and candidates of one turn for the network that scores half ``own``: every row of the group is in one turn."""
    plain, theirs = (tuple(v[turn::turns] for v in x) for x in (halves[1 - own], found))
    return made([40 + own, number, turn], theirs, plain, -(-MADE // turns))[:2], plain


def counted_scores(groups: DataFrame, nets: list[Network], turns: int, held_out: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per network the kinds, steps and numbers of the scores of all made findings it learned from and, if asked for, of the held-out ones
    and of the candidates of its own half."""
    def count(batches):
        for number, found, halves in unpacked(batches):
            for own, net in enumerate(nets):
                parts = []
                for turn in range(turns):
                    x, size = lesson(number, found, halves, own, turn, turns)[0]
                    parts.append((x, size, np.full(len(x), LEARNED)))
                if held_out:
                    parts += [made([50 + own, number], found, halves[own], MADE_HELD_OUT), (*halves[own], np.full(len(halves[own][0]), PLAIN))]
                x, size, kind = (np.concatenate(v) for v in zip(*parts))
                pairs, n = np.unique(np.column_stack([kind, np.floor(net.logits(x, size) * STEPS).astype(np.int64)]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_pydict({"own": np.full(len(n), own), "kind": pairs[:, 0], "step": pairs[:, 1], "n": n})

    counts = groups.mapInArrow(count, "own long, kind long, step long, n long").groupBy("own", "kind", "step").agg(F.sum("n").alias("n"))
    rows = np.array(sorted(map(tuple, counts.collect())), np.int64).reshape(-1, 4)  # as many as there are steps, whatever the number of windows
    return [tuple(rows[rows[:, 0] == own].T[1:]) for own in range(len(nets))]


def train(found: DataFrame, recall: float = RECALL, group: int = GROUP) -> list[Network] | None:
    """A network for each half of the candidates, fitted on the other half; nothing if there are no candidates.

    All different findings and candidates are learned from, group by group from common weights that are averaged after each turn.
    A network is calibrated on all candidates of its own half and on made findings it has not seen.
    """
    if not found.filter(F.size("candidates") > 0).limit(1).count():
        return None
    groups, n_groups = grouped(found, group)
    turns, nets, least = TURNS if n_groups > 1 else 1, None, None
    for _ in range(2):
        now = [Network(), Network()]
        for turn in range(turns):
            def learn(batches, now=now, nets=nets, least=least, turn=turn):
                total, seen = 0, 0
                for number, theirs, halves in unpacked(batches):
                    flat, rows = [], 0
                    for own in (0, 1):
                        (x1, n1), (x0, n0) = lesson(number, theirs, halves, own, turn, turns)
                        if nets:
                            # unlabelled candidates that look like findings are no examples of the opposite: the second network goes without them
                            sure = nets[own].logits(x0, n0) < least[own]
                            x0, n0 = (x0[sure], n0[sure]) if sure.any() else (x0, n0)
                        net, n = Network(), len(x1) + len(x0)
                        net.p = {k: v.copy() for k, v in now[own].p.items()}
                        net.fit(np.concatenate([x1, x0]), np.concatenate([n1, n0]), np.repeat([1.0, 0.0], [len(x1), len(x0)]),
                                max(1, min(6, PRACTICE // (n * turns))))
                        flat.append(np.frombuffer(pack(net.p), np.float32))
                        rows += n
                    total, seen = total + np.concatenate(flat) * np.float64(rows), seen + rows
                if seen:
                    yield from sliced(total, seen)

            seen, flat = summed(groups.mapInArrow(learn, SLICED))
            for net, mean in zip(now, np.split((flat / seen).astype(np.float32), 2)):
                net.p = unpack(mean.tobytes(), net.p)
        last = bool(nets)
        nets, scores = now, counted_scores(groups, now, turns, last)
        least = [ranked(step[kind == LEARNED], n[kind == LEARNED], 0.01) / STEPS for kind, step, n in scores]
    for net, low, (kind, step, n) in zip(nets, least, scores):
        z, plain = step / STEPS, kind == PLAIN
        likely = plain & (z < low)
        use = (kind > PLAIN) | (likely if likely.any() else plain)
        net.calibrate(z[use], (kind[use] > PLAIN).astype(float), kind[use], n[use], recall)
    return nets


def scan(docs: DataFrame, text: str = "text", id_column: str = "doc_id", recall: float = RECALL) -> DataFrame:
    """One row per input row: the id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (SHA-256 of the
    base spans), ``spans`` (``kind:start:end`` in code points, end exclusive, comma-joined, by start and
    then kind; kind ``model`` marks those the network adds), ``n_model`` and ``top_score`` (largest
    calibrated probability of a candidate outside the base spans, else null).

    A null text is empty; empty texts give zero counts and an empty ``spans``.  Repeated rows give
    repeated results.  A table without any candidate has the base spans only; without any finding the networks learn from random
    values in place of candidates.  Whole texts are read once; findings and candidates alone are written and read again.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "findings")
    scan_base(docs, text, id_column).write.parquet(path)
    found = spark.read.parquet(path)
    nets = train(found, recall=recall)
    id_type = docs.schema[id_column].dataType.simpleString()

    def score(batches):
        for batch in batches:
            spans = [list(map(tuple, np.asarray(v, np.int64).reshape(-1, 3).tolist())) for v in batch.column("spans").to_pylist()]
            tables = [np.asarray(v, np.int64).reshape(-1, 4) for v in batch.column("candidates").to_pylist()]
            table = np.concatenate(tables) if tables else np.zeros((0, 4), np.int64)
            doc = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
            x = np.frombuffer(b"".join(batch.column("windows").to_pylist()), np.uint8).reshape(-1, WIDTH)
            size = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), np.uint8).astype(np.int64)
            span = np.repeat(np.arange(len(table)), table[:, 3])
            p, flagged = np.zeros(len(table)), np.zeros(len(table), bool)
            for half, net in enumerate(nets or ()):
                mine = table[span, 2] == half
                logit = np.bincount(span[mine], net.logits(x[mine], size[mine]), len(table)) / np.maximum(table[:, 3], 1)
                here = table[:, 2] == half
                p[here] = net.chance(logit[here])
                flagged[here] = p[here] >= net.threshold
            top, added, every = [None] * len(tables), [0] * len(tables), [list(s) for s in spans]
            for i, q in enumerate(p.tolist()):
                top[doc[i]] = max(top[doc[i]] or 0.0, q)
            for i in np.flatnonzero(flagged).tolist():
                every[doc[i]].append((3, int(table[i, 0]), int(table[i, 1])))
                added[doc[i]] += 1
            kinds = [np.bincount([k for k, _, _ in s], minlength=3) for s in spans]
            yield pa.RecordBatch.from_pydict({
                id_column: batch.column(id_column), **{f"n_{KINDS[k]}": pa.array([int(c[k]) for c in kinds], pa.int64()) for k in range(3)},
                "base_sha256": pa.array([hashlib.sha256(digest(s).encode()).hexdigest() for s in spans], pa.string()),
                "spans": pa.array([digest(sorted(s, key=lambda v: (v[1], v[0]))) for s in every], pa.string()),
                "n_model": pa.array(added, pa.int64()), "top_score": pa.array(top, pa.float64())})

    return found.mapInArrow(score, f"`{id_column}` {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                                   "n_model long, top_score double")
