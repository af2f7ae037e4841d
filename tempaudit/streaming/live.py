"""Streaming forms: alert windows over a log and a hold tracker per run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRACK_SCHEMA = "run_id long, holding boolean, current_s double, longest_s double, last_us long, late_rows long"
TRACK_STATE = "holding boolean, start_us long, last_us long, best_s double, late long"
#: Keeps state on disk, which the tracker's pieces rely on.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


ALERT_SCHEMA = "figure string, start_us long, end_us long, seen long, bad long, p95_s double, alert boolean"


def quantile_of_counts(pairs: Column, total: Column, p: float) -> Column:
    """The smallest value at or below which a share ``p`` of ``total`` values lies, from structs of ``v`` and how often it occurs, ``n``."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("double").alias("found"))
    reached = lambda t, x: t["found"].isNull() & (t["upto"] + x["n"] >= F.ceil(total * p))
    step = lambda t, x: F.struct((t["upto"] + x["n"]).alias("upto"), F.when(reached(t, x), x["v"]).otherwise(t["found"]).alias("found"))
    return F.aggregate(F.array_sort(pairs), start, step)["found"]


def alert_windows(events: DataFrame, widths=("10 minutes", "5 minutes", "10 minutes"), slide="1 minute", lateness="10 minutes", slow_s=5.0,
                  error_pct=1.0, verify_pct=0.5) -> DataFrame:
    """Sliding alert figures over ``ts, compile_s, http_status, verify_error``; rows behind the watermark are dropped.

    Each figure (``compile``, ``requests``, ``verify``) has a window of its own width and a row per window in which it was seen.
    ``p95_s`` is exact for any number of compilations: a first stateful aggregation counts equal durations per window, spread over
    tasks by window and duration; when a window closes, a second one ranks the counts, so a task holds a window's different durations
    and no more.
    """
    timed = events.withWatermark("ts", lateness)
    share = lambda limit: F.coalesce(F.col("bad") / F.nullif(F.col("seen"), F.lit(0)) * 100 > limit, F.lit(False))
    out = lambda w, figure, alert: w.select(
        F.lit(figure).alias("figure"), F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"), "seen", "bad",
        "p95_s", alert.alias("alert"))
    # a zero of either sign is one duration
    spent = timed.filter(F.col("compile_s").isNotNull()).withColumn("compile_s", F.col("compile_s") + F.lit(0.0))
    counts = spent.groupBy(F.window("ts", widths[0], slide), "compile_s").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.groupBy("window").agg(
        F.sum("n").alias("seen"), F.coalesce(F.sum(F.when(F.col("compile_s") > slow_s, F.col("n"))), F.lit(0).cast("long")).alias("bad"),
        F.collect_list(F.struct(F.col("compile_s").alias("v"), "n")).alias("_pairs"))
    ranked = ranked.withColumn("p95_s", quantile_of_counts(F.col("_pairs"), F.col("seen"), 0.95))
    parts = [out(ranked, "compile", F.coalesce(F.col("p95_s") > slow_s, F.lit(False)))]
    figures = (("requests", "http_status", F.count_if(F.col("http_status") >= 500), share(error_pct)),
               ("verify", "verify_error", F.count_if("verify_error"), share(verify_pct)))
    for (figure, column, bad, alert), width in zip(figures, widths[1:]):
        w = timed.filter(F.col(column).isNotNull()).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("seen"), bad.alias("bad"))
        parts.append(out(w.withColumn("p95_s", F.lit(None).cast("double")), figure, alert))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


class HoldTracker(StatefulProcessor):
    """The latch of one run, advanced by each micro-batch in time order.

    A batch's rows are gathered up to ``most`` in memory; beyond, they go to a map state by time piece, which the state store keeps on
    disk, and are folded piece by piece.  So a run may hold any share of a batch, and a task holds ``most`` rows and one piece.  Rows
    behind the run's last instant of earlier batches are counted, not applied.  A run without rows for ``idle_ms`` is reported as
    ended, and after ``keep_ms`` its state is dropped.
    """

    def __init__(self, piece_us: int, most: int, idle_ms: int, keep_ms: int):
        self.piece_us, self.most, self.idle_ms, self.keep_ms = piece_us, most, idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latch = handle.getValueState("latch", TRACK_STATE)
        self.pieces = handle.getMapState("pieces", "piece long, part long", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        holding, start, last, best, late = self.latch.get() if self.latch.exists() else (False, 0, -1, 0.0, 0)
        held, count, part, spilled, seen = [], 0, 0, set(), last
        for chunk in rows:
            x = np.stack([chunk[c].to_numpy(float, na_value=np.nan) if c in ("value", "on_level", "off_level") else chunk[c].to_numpy(np.int64).view(float)
                          for c in ("us", "seq", "value", "on_level", "off_level")], 1)
            behind = x[:, 0].view(np.int64) < last if len(x) else np.zeros(0, bool)
            late += int(behind.sum())
            x = x[~behind]
            held.append(x)
            count += len(x)
            if count > self.most:
                part = self._spill(np.concatenate(held), part, spilled)
                held, count = [], 0
        if spilled:
            self._spill(np.concatenate(held) if held else np.zeros((0, 5)), part, spilled)
            for piece in sorted(spilled):
                parts = [(k, v) for k, v in ((k, self.pieces.getValue((piece, k))) for k in range(part + 1) if self.pieces.containsKey((piece, k)))]
                x = np.concatenate([np.frombuffer(v[0]).reshape(-1, 5) for _, v in parts])
                holding, start, seen, best = self._advance(x, holding, start, seen, best)
                for k, _ in parts:
                    self.pieces.removeKey((piece, k))
        elif held:
            holding, start, seen, best = self._advance(np.concatenate(held), holding, start, seen, best)
        self.latch.update((holding, start, seen, best, late))
        self._wait(max(seen // 1000, timerValues.getCurrentWatermarkInMs()))
        yield self._row(key, holding, (seen - start) / 1e6 if holding else 0.0, best, seen, late)

    def _spill(self, x: np.ndarray, part: int, spilled: set) -> int:
        piece = x[:, 0].copy().view(np.int64) // self.piece_us
        for p in np.unique(piece).tolist():
            self.pieces.updateValue((p, part), (np.ascontiguousarray(x[piece == p]).tobytes(),))
            spilled.add(p)
        return part + 1

    @staticmethod
    def _advance(x: np.ndarray, holding: bool, start: int, last: int, best: float):
        if not len(x):
            return holding, start, last, best
        us, seq = x[:, 0].copy().view(np.int64), x[:, 1].copy().view(np.int64)
        order = np.lexsort((seq, us))
        us, (v, on, off) = us[order], x[order, 2:].T
        decided = pd.Series(np.where(v >= on, 1.0, np.where(v < off, 0.0, np.nan))).ffill().fillna(float(holding)).to_numpy() > 0
        begins = decided & ~np.concatenate([[holding], decided[:-1]])
        since = us[np.maximum.accumulate(np.where(begins, np.arange(len(us)), -1))]
        since = np.where(np.maximum.accumulate(begins), since, start)
        best = max(best, float(np.where(decided, (us - since) / 1e6, 0.0).max()))
        return bool(decided[-1]), int(since[-1]), int(us[-1]), best

    def _wait(self, since_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(since_ms + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.latch.exists():
            return
        holding, start, last, best, late = self.latch.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if now - last // 1000 >= self.keep_ms:
            self.latch.clear()
            return
        # the row is final unless the run resumes; its best hold is kept for that until the state goes
        self.latch.update((False, 0, last, best, late))
        self.handle.registerTimer(max(now + 1, last // 1000 + self.keep_ms))
        yield self._row(key, False, 0.0, best, last, late)

    @staticmethod
    def _row(key, *values) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *values)], columns=[c.split()[0] for c in TRACK_SCHEMA.split(", ")])


DAY_MS = 86_400_000


def track_holds(events: DataFrame, lateness="1 hour", piece_s=3600, most=100_000, idle_ms=DAY_MS, keep_ms=30 * DAY_MS) -> DataFrame:
    """Live hold state per run over ``run_id, ts, us, seq, value, on_level, off_level``, one row per run and micro-batch.

    The session's state store is set to the one that keeps state on disk.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.withWatermark("ts", lateness).groupBy("run_id")
    return rows.transformWithStateInPandas(HoldTracker(piece_s * 1_000_000, most, idle_ms, keep_ms), TRACK_SCHEMA, "Update", "EventTime")
