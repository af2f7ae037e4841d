"""Remove repeated and nearly repeated lines across documents by a segment-partition edit join.

Two lines within t edits share at least one of the t + 1 segments of the shorter one, at a place that
is off by few characters.  Every distinct line puts its segments into an index keyed by its length and
the segment's number, and probes the indexes of all lengths down to t less with the substrings that
can match.  Lines that meet are compared by a bit-parallel edit distance on the band of t diagonals.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempaudit.llm.textops import LEAD, SPACE, Hasher, mix, over_texts, unused
from tempaudit.session import scratch_path

EDITS = 2
#: Shorter lines (in characters, without white space at the ends) are not compared by edits; by default they are not removed as copies either.
LEAST_CHARS = 25
#: Lines of each side of a tile.
TILE = 128
#: A segment of more lines is cut into blocks of so many lines, and its pairs of blocks are dealt out over tasks.
HOT, BLOCK = 2048, 1024
#: A table of at most so many narrow rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Pairs times characters that one comparison step holds.
CELLS = 4_000_000


class Lines:
    """Lines of texts: document, number in it, byte range, byte range without outer white space, length in characters, hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, least: int = LEAST_CHARS):
        self.data, self.points = data, np.concatenate([[0], np.cumsum(LEAD[data])])
        breaks = np.flatnonzero(data == 10)
        doc = np.concatenate([np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks, side="right") - 1])
        start = np.concatenate([bounds[:-1], breaks + 1])
        order = np.lexsort((start, doc))
        self.doc, self.start = doc[order], start[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(self.doc) else np.zeros(0, bool)
        self.end = np.where(last, bounds[self.doc + 1], np.append(self.start[1:], 0) - 1) if len(self.doc) else self.start
        first = np.searchsorted(self.doc, np.arange(len(bounds) - 1))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        self.left, self.right = self._stripped(self.start, self.end)
        self.chars = self.points[self.right] - self.points[self.left]
        self.long = self.chars >= least

    def _stripped(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, data = start.copy(), end.copy(), self.data
        for at, step, other in ((left, 1, right), (right, -1, left)):
            rows = np.flatnonzero(left < right)
            for _ in range(8):  # most lines have hardly any white space at their ends
                rows = rows[SPACE[data[at[rows] - (step < 0)]]]
                at[rows] += step
                rows = rows[left[rows] < right[rows]]
                if not len(rows):
                    break
            if len(rows):
                solid = np.flatnonzero(~SPACE[data])
                if step > 0:
                    found = np.append(solid, len(data))[np.searchsorted(solid, at[rows])]
                    at[rows] = np.minimum(found, other[rows])
                else:
                    found = np.append(0, solid + 1)[np.searchsorted(solid, at[rows])]
                    at[rows] = np.maximum(found, other[rows])
        return left, right

    @cached_property
    def hashes(self) -> Hasher:
        return Hasher(self.data)

    @cached_property
    def key(self) -> np.ndarray:
        return self.hashes.ranges(self.left, self.right) & np.uint64(0xFFFFFFFFFFFFFFFE)

    @cached_property
    def places(self) -> np.ndarray:
        """Byte places of the characters, and one for the end."""
        return np.append(np.flatnonzero(LEAD[self.data]), len(self.data))

    def pieces(self, rows: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the segments and probes of lines, each with the line's key and, in its lowest bit, 1 for a probe."""
        at, size = self.points[self.left[rows]], self.chars[rows]
        keys, lines = [], []

        def add(length, part, shift, side):
            begin, stop = length * part // (edits + 1), length * (part + 1) // (edits + 1)
            fits = (begin + shift >= 0) & (stop + shift <= size) & (stop > begin)
            a, b = self.places[(at + begin + shift)[fits]], self.places[(at + stop + shift)[fits]]
            keys.append(mix(self.hashes.ranges(a, b) ^ mix(length[fits].astype(np.uint64) * np.uint64(64) + np.uint64(part))))
            lines.append(self.key[rows][fits] | np.uint64(side))

        for part in range(edits + 1):
            add(size, part, 0, 0)
            for less in range(edits + 1):  # edits left and right of the segment bound its shift
                for shift in range(max(-part, less - (edits - part)), min(part, less + (edits - part)) + 1):
                    add(size - less, part, shift, 1)
        return np.concatenate(keys).view(np.int64), np.concatenate(lines).view(np.int64)


def first_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Every distinct line of ``least`` characters or more with its first place: ``line``, ``no_id``, ``id``, ``row``, ``number``."""
    def work(rows, data, bounds):
        lines = Lines(data, bounds, least)
        at = np.flatnonzero(lines.long)
        take = pa.array(lines.doc[at])
        return {"line": lines.key[at].view(np.int64), "id": rows.column(rows.schema.get_field_index("id")).take(take),
                "row": rows.column(rows.schema.get_field_index("row")).take(take), "number": lines.number[at].astype(np.int64)}

    found = over_texts(docs.select("id", "row", "text"), work, f"line long, id {docs.schema['id'].dataType.simpleString()}, row long, number long")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "number")
    return found.groupBy("line").agg(F.min(place).alias("place")).select("line", "place.*")


def meetings(docs: DataFrame, edits: int) -> DataFrame:
    """Tiles of lines that share a segment: ``key``, ``a``, ``b``, ``probe``, ``line``, ``others``.  A task holds the keys of one segment's lines (8 bytes each).

    Of a segment of more than ``HOT`` lines, each line is handed on once, with the number of blocks that its own is to meet in ``others``.
    """
    def work(rows, data, bounds):
        lines = Lines(data, bounds)
        at = np.flatnonzero(lines.long)
        at = at[np.unique(lines.key[at], return_index=True)[1]]
        key, line = lines.pieces(at, edits)
        return {"key": key, "line": line}

    met = over_texts(docs.select("text"), work, "key long, line long").repartition("key").sortWithinPartitions("key")

    def tiles(key, line):
        index, probe = np.unique(line[line & 1 == 0]), np.unique(line[line & 1 == 1]) & ~1
        if len(index) + len(probe) > HOT:
            place = np.concatenate([np.arange(len(index)), np.arange(len(probe))]) // BLOCK
            side = np.arange(len(place)) >= len(index)
            blocks = -(-len(index) // BLOCK), -(-len(probe) // BLOCK)
            return {"key": np.full(len(place), key), "a": place.astype(np.int32), "b": place.astype(np.int32), "probe": side,
                    "line": np.concatenate([index, probe]), "others": np.where(side, *blocks).astype(np.int32)} if min(blocks) else {"line": []}
        out = []
        for i in range(0, len(index), TILE):
            for j in range(0, len(probe), TILE):
                x, y = index[i:i + TILE], probe[j:j + TILE]
                if len(x) > 1 or len(y) > 1 or x[0] != y[0]:
                    out.append((np.full(len(x) + len(y), i // TILE), np.full(len(x) + len(y), j // TILE), np.arange(len(x) + len(y)) >= len(x),
                                np.concatenate([x, y])))
        a, b, side, member = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return {"key": np.full(len(a), key), "a": a.astype(np.int32), "b": b.astype(np.int32), "probe": side.astype(bool), "line": member,
                "others": np.zeros(len(a), np.int32)}

    def run(batches):
        held_key, held = None, []
        for batch in batches:
            key, line = np.asarray(batch.column("key")), np.asarray(batch.column("line"))
            if not len(key):
                continue
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            if key[0] != held_key:
                if held_key is not None:
                    yield from closed(held_key, np.concatenate(held))
                held_key, held = key[0], []
            if len(begins) == 1:
                held.append(line)
                continue
            held.append(line[:begins[1]])
            yield from closed(held_key, np.concatenate(held))
            bare = line & ~1
            low, high = np.minimum.reduceat(bare, begins), np.maximum.reduceat(bare, begins)
            for k in np.flatnonzero(low != high):
                if 0 < k < len(begins) - 1:
                    yield from closed(key[begins[k]], line[begins[k]:begins[k + 1]])
            held_key, held = key[-1], [line[begins[-1]:]]
        if held_key is not None:
            yield from closed(held_key, np.concatenate(held))

    def closed(key, line):
        if (line & ~1 != line[0] & ~1).any():
            found = tiles(key, line)
            if len(found["line"]):
                yield pa.RecordBatch.from_pydict(found)

    return met.mapInArrow(run, "key long, a int, b int, probe boolean, line long, others int")


def every_tile(tiles: DataFrame) -> DataFrame:
    """``tiles`` with each line of a cut segment once per block that its own is to meet."""
    cut = tiles.filter("others > 0").repartition("key", "line", "probe").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    cut = cut.select("key", F.when(F.col("probe"), F.col("other")).otherwise(F.col("a")).alias("a"),
                     F.when(F.col("probe"), F.col("b")).otherwise(F.col("other")).alias("b"), "probe", "line")
    return tiles.filter("others = 0").drop("others").unionByName(cut)


def within(codes: list[np.ndarray], i: np.ndarray, j: np.ndarray, edits: int) -> np.ndarray:
    """True for pairs of code point arrays within so many edits.

    Bit k of a state stands for the diagonal k - edits of the band; state e holds the diagonals on which
    the prefixes read so far are at most e edits apart.  One step reads one character of every pair.
    """
    size = np.array([len(c) for c in codes])
    flat, offset = np.concatenate([*codes, [0]]).astype(np.int64), np.concatenate([[0], np.cumsum(size)])
    ok = np.zeros(len(i), bool)
    near = np.flatnonzero(np.abs(size[i] - size[j]) <= edits)
    near = near[np.argsort(size[j[near]], kind="stable")]
    at = 0
    while at < len(near):
        step = max(1, CELLS // max(1, int(size[j[near[at]]]) + 1))
        rows = near[at:at + step]
        at += len(rows)
        la, lb, oa, ob = size[i[rows]], size[j[rows]], offset[i[rows]], offset[j[rows]]
        state = [np.full(len(rows), sum(1 << (edits + k) for k in range(e + 1)), np.uint32) for e in range(edits + 1)]
        band = np.uint32((1 << (2 * edits + 1)) - 1)
        for t in range(int(lb.max()) + 1):
            over = lb == t
            if over.any():
                ok[rows[over]] = (state[edits][over] >> (la - lb + edits)[over].astype(np.uint32)) & 1 == 1
            alive = ~over & (state[edits] != 0)
            if not alive.all():
                rows, la, lb, oa, ob = rows[alive], la[alive], lb[alive], oa[alive], ob[alive]
                state = [s[alive] for s in state]
                if not len(rows):
                    break
            letter, same = flat[ob + t], np.zeros(len(rows), np.uint32)
            for k in range(2 * edits + 1):
                place = t + k - edits
                same |= ((place >= 0) & (place < la) & (flat[np.clip(oa + place, 0, len(flat) - 1)] == letter)).astype(np.uint32) << np.uint32(k)
            before, made = None, None
            for e in range(edits + 1):
                now = state[e] & same
                if e:
                    now |= before | (before >> np.uint32(1)) | (made << np.uint32(1))
                before, made = state[e], now & band
                state[e] = made
    return ok


def near_lines(tiles: DataFrame, edits: int) -> DataFrame:
    """Lines that are within so many edits of a line that came earlier; input rows carry ``no_id``, ``id``, ``row``, ``number`` and ``text``."""
    def pairs(members):
        """Pairs of a tile that may be close, each with the line that goes if they are."""
        probe = np.array([m[0] for m in members])
        codes = [np.frombuffer(m[3].encode("utf-32-le"), np.uint32) for m in members]
        bag = np.stack([np.bincount(c & 31, minlength=32) for c in codes]).astype(np.int32)
        left, right = np.flatnonzero(~probe), np.flatnonzero(probe)
        for k in range(0, len(left), 16):
            far = np.abs(bag[left[k:k + 16]][:, None] - bag[right][None]).sum(2)  # one edit changes at most two counts by one
            for i, j in zip(*np.nonzero(far <= 2 * edits)):
                x, y = members[left[k + i]], members[right[j]]
                if x[1] != y[1]:
                    yield codes[left[k + i]], codes[right[j]], max((x[2], x[1]), (y[2], y[1]))[1]

    def run(batches):
        tile, members, waiting, cells = None, [], [], 0

        def closed(members):
            nonlocal waiting, cells
            for pair in pairs(members) if members else ():
                waiting.append(pair)
                cells += len(pair[0])
                if cells > CELLS // 4:
                    yield verdict()
                    waiting, cells = [], 0

        def verdict():
            codes = [c for a, b, _ in waiting for c in (a, b)]
            place = 2 * np.arange(len(waiting))
            sure = within(codes, place, place + 1, edits)
            return pa.RecordBatch.from_pydict({"line": pa.array(sorted({waiting[k][2] for k in np.flatnonzero(sure)}), pa.int64())})

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "a", "b", "probe", "line", "no_id", "id", "row", "number", "text")]
            for key, a, b, probe, line, no_id, id_, row, number, text in zip(*columns):
                if (key, a, b) != tile:
                    yield from closed(members)
                    tile, members = (key, a, b), []
                members.append((probe, line, (no_id, id_ if not no_id else 0, row, number), text))
        yield from closed(members)
        if waiting:
            yield verdict()

    ordered = tiles.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return ordered.mapInArrow(run, "line long").distinct()


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """All columns of ``docs`` and ``kept_text``, ``n_lines``, ``n_exact``, ``n_near`` and ``removed`` (numbers of the removed lines).

    A line of at least ``least`` characters (without outer white space, \\n-split) is removed if an equal line
    comes earlier, in the order of id (null last), text and line number, or if it is a first line of ``LEAST_CHARS``
    characters or more within ``edits`` edits of an earlier such one.  With ``least`` 1 all lines but blank ones count.  Whether that earlier line is itself removed makes no difference.
    Null texts stay null with no lines; an empty text has one empty line.  Rows that repeat an id and its text are one document and
    get the same result.  New columns replace columns of the same names.

    A line of any frequency is pre-aggregated to its first place, so no step gathers its occurrences.
    """
    spark = docs.sparkSession

    def written(df, label):
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    new = ["kept_text", "n_lines", "n_exact", "n_near", "removed"]
    docs = docs.drop(*new)
    row = F.xxhash64(F.col(id_column), F.col(text))
    base = docs.select(F.col(id_column).alias("id"), row.alias("row"), F.col(text).alias("text"))
    firsts = written(first_lines(base, least), "first-lines")
    tiles = written(meetings(base, edits), "line-tiles")
    wanted = tiles.select("line").distinct().join(firsts, "line")
    per_row = written(wanted.groupBy("row").agg(F.collect_list("number").alias("numbers")), "wanted-lines")

    def fetch(rows, data, bounds):
        lines = Lines(data, bounds)
        wanted_, first = rows.column(rows.schema.get_field_index("numbers")).to_pylist(), np.searchsorted(lines.doc, np.arange(len(bounds) - 1))
        at = np.concatenate([first[d] + np.array(n, np.int64) for d, n in enumerate(wanted_)]) if wanted_ else np.zeros(0, np.int64)
        raw = data.tobytes()
        return {"line": lines.key[at].view(np.int64), "text": pa.array([raw[a:b].decode() for a, b in zip(lines.left[at], lines.right[at])], pa.string())}

    texts = written(over_texts(base.join(small(per_row), "row").select("numbers", "text"), fetch, "line long, text string").dropDuplicates(["line"]), "line-texts")
    near = near_lines(every_tile(tiles).join(texts.join(firsts, "line"), "line"), edits).withColumn("near", F.lit(True))
    marked = firsts.join(near, "line", "left").groupBy(F.col("row").alias("_row")).agg(
        F.collect_list("number").alias("_first"), F.collect_list(F.when(F.col("near"), F.col("number"))).alias("_near"))
    key, first_name, near_name = (unused(docs, c) for c in ("_row", "_first", "_near"))
    marked = marked.select(F.col("_row").alias(key), F.col("_first").alias(first_name), F.col("_near").alias(near_name))
    joined = docs.withColumn(key, row).join(marked, key, "left").drop(key)

    def cut(rows, data, bounds):
        lines = Lines(data, bounds, least)
        edges = np.searchsorted(lines.doc, np.arange(len(bounds)))
        texts_ = rows.column(rows.schema.get_field_index(text)).to_pylist()
        firsts_, nears = (rows.column(rows.schema.get_field_index(c)).to_pylist() for c in (first_name, near_name))
        out = {c: [] for c in new}
        raw = data.tobytes()
        for d, value in enumerate(texts_):
            a, b = edges[d], edges[d + 1]
            keep = ~lines.long[a:b]
            keep[np.array(firsts_[d] or [], np.int64)] = True
            exact, near_ = int((~keep).sum()), np.array(nears[d] or [], np.int64)
            keep[near_] = False
            gone = np.flatnonzero(~keep)
            out["kept_text"].append(value if value is None or not len(gone) else b"\n".join(
                raw[lines.start[k]:lines.end[k]] for k in a + np.flatnonzero(keep)).decode())
            for name, x in zip(new[1:], (0 if value is None else int(b - a), exact, len(near_), gone.tolist())):
                out[name].append(x)
        names = [n for n in rows.schema.names if n not in (first_name, near_name)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return {n: rows.column(rows.schema.get_field_index(n)) for n in names} | {n: pa.array(out[n], k) for n, k in zip(new, kinds)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return over_texts(joined, cut, schema + ", kept_text string, n_lines long, n_exact long, n_near long, removed array<long>", text)


def cleaned(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with repeated lines of any length cut out of the text; rows that lose all their words to it go."""
    out = dedup_lines(docs, text, id_column, least=1)
    empty = (F.size("removed") > 0) & ~F.coalesce(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.filter(~empty).select(*[F.col("kept_text").alias(c) if c == text else F.col(c) for c in docs.columns])
