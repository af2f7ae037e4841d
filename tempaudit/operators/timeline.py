"""Ordered evaluation of many runs, safe when one run holds a large share of all rows.

A window partitioned by run puts each run into one task.  That is right for ordinary runs and
wrong for a run of billions of samples, so :class:`Timeline` first measures the longest run.

* Every run fits a task: plain windows over ``(run)``; all of them share one exchange.
* Some run does not: the rows are range-partitioned by ``(run, time, tie)`` - Spark samples the
  keys, so any run, burst or set of equal timestamps is cut into even pieces - and the pieces
  are checkpointed, which pins the piece numbers.  Every ordered operator is then a window over
  ``(run, piece)`` plus a carry: one summary row per piece, scanned per run and joined back on
  the same partitioning.  Results are equal to the plain form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.session import ensure_checkpointing, rows_per_task

PIECE = "_piece"


@dataclass(frozen=True)
class Scan:
    kind: str
    expr: Column


def prev(expr) -> Scan:
    """Value of the previous row of the run."""
    return Scan("prev", _col(expr))


def following(expr) -> Scan:
    """Value of the next row of the run."""
    return Scan("following", _col(expr))


def last_seen(expr) -> Scan:
    """Latest non-null value at or before the row."""
    return Scan("last_seen", _col(expr))


def next_seen(expr) -> Scan:
    """Earliest non-null value at or after the row."""
    return Scan("next_seen", _col(expr))


def run_sum(expr) -> Scan:
    """Sum from the start of the run up to and including the row."""
    return Scan("run_sum", _col(expr))


def run_max(expr) -> Scan:
    """Maximum from the start of the run up to and including the row."""
    return Scan("run_max", _col(expr))


def position() -> Scan:
    """1-based position of the row in its run."""
    return Scan("run_sum", F.lit(1).cast("long"))


def _col(expr) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def _add(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, zero) + F.coalesce(b, zero))


class Timeline:
    """Rows of many runs with an order inside each run."""

    def __init__(self, df: DataFrame, key=("run_id",), order=("us", "seq"), parts: int = 0, fresh: bool = True):
        self.df = df
        self.key = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)
        self.parts = parts  # number of pieces all rows are cut into; 0 while whole runs fit a task
        self._fresh = fresh

    @property
    def pieces(self) -> bool:
        return self.parts > 0

    # -- opening -----------------------------------------------------------------------------

    @classmethod
    def open(cls, df: DataFrame, key=("run_id",), order=("us", "seq"), limit: int | None = None,
             measure: DataFrame | None = None) -> "Timeline":
        """Measure the runs and choose the plain or the piecewise form.

        ``measure`` is a cheaper table with the same keys and no fewer rows (the source ``df`` was
        derived from); counting it spares a second evaluation of ``df``.
        """
        key = [key] if isinstance(key, str) else list(key)
        order = [order] if isinstance(order, str) else list(order)
        limit = limit or rows_per_task(df.sparkSession)
        size = (
            (df if measure is None else measure).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.max("n").alias("longest"), F.sum("n").alias("total")).first()
        )
        longest, total = size["longest"] or 0, size["total"] or 0
        if longest <= limit:
            return cls(df, key, order)
        return cls._cut(df, key, order, max(2, -(-total // limit)))

    @classmethod
    def _cut(cls, df, key, order, parts: int) -> "Timeline":
        ensure_checkpointing(df.sparkSession)
        pinned = (
            df.repartitionByRange(int(parts), *key, *order)
            .withColumn(PIECE, F.spark_partition_id())
            .checkpoint()
        )
        return cls(pinned, key, order, parts)

    def again(self, df: DataFrame, key=None, order=None, growth: int = 1) -> "Timeline":
        """A timeline over rows derived from this one (islands, grids), cut if this one was.

        Its rows are at most about ``growth`` times as many, which sets the number of pieces
        without another count.
        """
        key = [key] if isinstance(key, str) else list(key or self.key)
        order = [order] if isinstance(order, str) else list(order or self.order)
        if not self.pieces:
            return Timeline(df, key, order)
        return Timeline._cut(df.drop(PIECE), key, order, self.parts * growth)

    def with_columns(self, **cols: Column) -> "Timeline":
        """Row-local columns."""
        return Timeline(self.df.withColumns(cols), self.key, self.order, self.parts, self._fresh)

    def rows(self) -> DataFrame:
        return self.df.drop(PIECE) if self.pieces else self.df

    # -- ordered columns -----------------------------------------------------------------------

    def scan(self, **scans: Scan) -> "Timeline":
        if not self.pieces:
            window = Window.partitionBy(*self.key).orderBy(*self.order)
            return Timeline(
                self.df.withColumns({name: _over(s, window) for name, s in scans.items()}),
                self.key, self.order, 0, False,
            )
        return self._scan_pieces(scans)

    def _scan_pieces(self, scans: dict[str, Scan]) -> "Timeline":
        base = self.df if self._fresh else self.df.checkpoint()
        group = [*self.key, PIECE]
        local = Window.partitionBy(*group).orderBy(*self.order)
        across = Window.partitionBy(*self.key).orderBy(PIECE)
        rank = F.struct(*self.order)

        inner = base.withColumns({f"_l_{n}": _over_boxed(s, local) for n, s in scans.items()})
        summary = base.groupBy(*group).agg(*[_piece_summary(s, rank).alias(f"_s_{n}") for n, s in scans.items()])
        carry = summary.select(*group, *[_carry(s, F.col(f"_s_{n}"), across).alias(f"_c_{n}") for n, s in scans.items()])
        joined = _join_null_safe(inner, carry, group)
        done = joined.withColumns(
            {n: _merge(s, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, s in scans.items()}
        ).drop(*[f"_{p}_{n}" for n in scans for p in ("l", "c")])
        return Timeline(done, self.key, self.order, self.parts, False)

    def join_run(self, table: DataFrame, how: str = "inner") -> "Timeline":
        """Join a table with one row per run to the rows; a null run meets a null run.

        A cut run meets its row once per piece, so the rows stay spread as they are.  Values that follow from the rows
        themselves come cheaper by ``attach``.
        """
        if not self.pieces:
            return Timeline(_join_null_safe(self.df, table, self.key, how), self.key, self.order, 0, self._fresh)
        spots = _join_null_safe(self.df.select(*self.key, PIECE).distinct(), table, self.key, "inner")
        joined = _join_null_safe(self.df, spots, [*self.key, PIECE], how)
        return Timeline(joined, self.key, self.order, self.parts, False)

    def attach(self, **aggs: Column) -> "Timeline":
        """Per-run aggregates as columns of the rows.

        Plain runs take them from windows on the partitioning they have, which reads and shuffles nothing anew;
        cut runs merge partials and meet the result once per piece.
        """
        if not self.pieces:
            whole = Window.partitionBy(*self.key)
            return Timeline(self.df.withColumns({n: a.over(whole) for n, a in aggs.items()}), self.key, self.order, 0, False)
        return self._attached(self.per_run(*[a.alias(n) for n, a in aggs.items()]))

    def attach_quantile(self, expr, p: float, name: str) -> "Timeline":
        """Exact interpolated quantile of the run as a column of the rows."""
        if not self.pieces:
            return self.attach(**{name: F.percentile(_col(expr), F.lit(p))})
        return self._attached(self.quantile(expr, p, name))

    def _attached(self, table: DataFrame) -> "Timeline":
        spots = _join_null_safe(self.df.select(*self.key, PIECE).distinct(), table, self.key)
        return Timeline(_join_null_safe(self.df, spots, [*self.key, PIECE]), self.key, self.order, self.parts, False)

    # -- per-run results ---------------------------------------------------------------------

    def per_run(self, *aggs: Column) -> DataFrame:
        """One row per run.  Use only aggregates with partial forms; a cut run merges its partials."""
        return self.rows().groupBy(*self.key).agg(*aggs)

    def quantile(self, expr, p: float, name: str) -> DataFrame:
        """Exact interpolated quantile per run.

        A run that fits a task keeps a value histogram in that task.  Runs that were cut are
        ranked instead: equal values are counted, the counts summed along the values.
        """
        value = _col(expr)
        if not self.pieces:
            return self.rows().groupBy(*self.key).agg(F.percentile(value, F.lit(p)).alias(name))
        there = F.col("_v").isNotNull()  # a group without values keeps its row
        counts = (
            self.rows().select(*self.key, value.cast("double").alias("_v"))
            .groupBy(*self.key, "_v").agg(F.count_if(there).alias("_c"))
        )
        ranked = self.again(counts, order=["_v"]).scan(_upto=run_sum("_c")).attach(_n=F.sum("_c"))
        spot = (F.col("_n") - 1) * F.lit(p)
        lo = F.min(F.when(F.col("_upto") > F.floor(spot), F.col("_v")))
        hi = F.min(F.when(F.col("_upto") > F.ceil(spot), F.col("_v")))
        found = ranked.per_run(lo.alias("_lo"), hi.alias("_hi"), F.first(spot - F.floor(spot)).alias("_f"))
        return found.select(*self.key, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(name))

    def islands(self, state: str, name: str = "island") -> "Timeline":
        """Number the maximal stretches of equal ``state``, from 0 in each run."""
        before = f"_{name}_before"
        return (
            self.scan(**{before: prev(F.struct(F.col(state).alias("v")))})
            .with_columns(**{f"_{name}_step": (
                F.col(before).isNotNull() & ~F.col(f"{before}.v").eqNullSafe(F.col(state))).cast("int")})
            .scan(**{name: run_sum(f"_{name}_step")})
            .dropping(before, f"_{name}_step")
        )

    def dropping(self, *names: str) -> "Timeline":
        return Timeline(self.df.drop(*names), self.key, self.order, self.parts, self._fresh)

    def where(self, cond) -> "Timeline":
        return Timeline(self.df.filter(cond), self.key, self.order, self.parts, self._fresh)


def _join_null_safe(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join in which a null key meets a null key, as windows and groups treat it."""
    other = table.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(other, same, how).drop(*[f"_k_{k}" for k in keys])


def _over(s: Scan, w) -> Column:
    if s.kind == "prev":
        return F.lag(s.expr).over(w)
    if s.kind == "following":
        return F.lead(s.expr).over(w)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if s.kind == "last_seen":
        return F.last(s.expr, ignorenulls=True).over(upto)
    if s.kind == "next_seen":
        return F.first(s.expr, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if s.kind == "run_sum":
        return F.sum(s.expr).over(upto)
    if s.kind == "run_max":
        return F.max(s.expr).over(upto)
    raise ValueError(s.kind)


def _over_boxed(s: Scan, w) -> Column:
    """As _over, with neighbours boxed so that a null neighbour differs from no neighbour."""
    if s.kind in ("prev", "following"):
        return _over(Scan(s.kind, F.struct(s.expr.alias("v"))), w)
    return _over(s, w)


def _piece_summary(s: Scan, rank: Column) -> Column:
    if s.kind == "prev":
        return F.max_by(F.struct(s.expr.alias("v")), rank)
    if s.kind == "following":
        return F.min_by(F.struct(s.expr.alias("v")), rank)
    if s.kind == "last_seen":
        return F.max_by(s.expr, F.when(s.expr.isNotNull(), rank))
    if s.kind == "next_seen":
        return F.min_by(s.expr, F.when(s.expr.isNotNull(), rank))
    if s.kind == "run_sum":
        return F.sum(s.expr)
    return F.max(s.expr)


def _carry(s: Scan, summary: Column, across) -> Column:
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    if s.kind == "prev":
        return F.lag(summary).over(across)
    if s.kind == "following":
        return F.lead(summary).over(across)
    if s.kind == "last_seen":
        return F.last(summary, ignorenulls=True).over(before)
    if s.kind == "next_seen":
        return F.first(summary, ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
    if s.kind == "run_sum":
        return F.sum(summary).over(before)
    return F.max(summary).over(before)


def _merge(s: Scan, local: Column, carry: Column) -> Column:
    if s.kind in ("prev", "following"):
        return F.coalesce(local, carry)["v"]
    if s.kind in ("last_seen", "next_seen"):
        return F.coalesce(local, carry)
    if s.kind == "run_sum":
        return _add(local, carry)
    return F.greatest(local, carry)


def range_sums(tl: Timeline, before_us: int, after_us: int, sums: dict[str, Column], open_start: bool = False) -> DataFrame:
    """Sums over ``[us - before_us, us + after_us]`` around every row (start excluded if ``open_start``).

    A sliding frame costs as much per row as it holds rows.  Here every row sends a marker to
    each edge of its window and reads the running sums there, so the cost is two extra rows
    per row whatever the density.  Rows are identified by ``(key, us, seq)``.
    """
    edge_mark = 2 if open_start else 0  # before or after the samples of that instant
    spots = [(-before_us, edge_mark, -1), (0, 1, 0), (after_us, 3, 1)]
    points = tl.rows().select(
        *tl.key, F.col("us").alias("_us"), F.col("seq").alias("_seq"), *[c.alias(f"_v_{n}") for n, c in sums.items()],
        F.explode(F.array(*[F.struct((F.col("us") + F.lit(d)).alias("at"), F.lit(m).alias("mark"), F.lit(g).alias("sign"))
                            for d, m, g in spots])).alias("_p"))
    points = points.select("*", "_p.at", "_p.mark", "_p.sign").drop("_p")
    line = tl.again(points, order=["at", "mark", "_seq"], growth=3).scan(
        **{f"_r_{n}": run_sum(F.when(F.col("mark") == 1, F.col(f"_v_{n}"))) for n in sums})
    return line.rows().filter("sign <> 0").groupBy(*tl.key, "_us", "_seq").agg(
        *[F.sum(F.col("sign") * F.coalesce(F.col(f"_r_{n}"), F.lit(0))).alias(n) for n in sums]
    ).withColumnsRenamed({"_us": "us", "_seq": "seq"})


def keyed_join(big: DataFrame, small: DataFrame, on, spread, how: str = "inner", measure: DataFrame | None = None,
               limit: int | None = None) -> DataFrame:
    """Join rows to a table with few rows per key when a key may hold a large share of the rows.

    Keys beyond ``limit`` rows are counted first; there are at most ``rows / limit`` of them, so
    their list is small enough to broadcast.  Their rows are dealt out over as many salts as they
    need by a hash of ``spread``, and only their rows of ``small`` are repeated per salt.  Without
    such keys this is the plain join.  Inner, left, left_semi and left_anti joins.
    """
    on = [on] if isinstance(on, str) else list(on)
    limit = limit or rows_per_task(big.sparkSession)
    counted = (big if measure is None else measure).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counted.filter(F.col("_rows") > limit).select(*on, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts"))
    if hot.isEmpty():
        return big.join(small, on, how)
    ensure_checkpointing(big.sparkSession)
    hot = F.broadcast(hot.checkpoint())
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    copies = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def join_runs(*tables: DataFrame, key=("run_id",)) -> DataFrame:
    """Put one-row-per-run tables side by side, by the runs of the first; a null run meets a null run."""
    return reduce(lambda a, b: _join_null_safe(a, b, list(key)), tables)


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two epoch-microsecond columns."""
    return (later - earlier) / F.lit(1e6)
