"""Live feeds: frames or documents to folded state, and a decaying heatmap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from orrery.operators import heatmap

from .runs import RunTable

STALE_SECONDS = 21_600


def merge_stream(patches: DataFrame, table: RunTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Fold a stream of patches (with ``seq``) into ``table``, a run a micro-batch."""
    writer = patches.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"}))
    return writer.foreachBatch(lambda batch, n: table.apply(batch, n)).start()


def heat_over_time(points: DataFrame, tick: Column, now: int) -> DataFrame:
    """gx, gz, n at tick ``now`` from points (x, z) that arrived at ticks: each cell's fold over its ticks.

    Only ticks with arrivals are kept; between them the count decays, cut off each time, and the fold
    inside a row is as long as a cell has ticks.
    """
    inside, gx, gz = heatmap.cell(F.col("x"), F.col("z"))
    counts = points.where(inside).groupBy(gx.alias("gx"), gz.alias("gz"), tick.cast("int").alias("tick")).agg(F.count(F.lit(1)).alias("c")).where(F.col("tick") <= now)
    cells = counts.groupBy("gx", "gz").agg(F.sort_array(F.collect_list(F.struct("tick", "c"))).alias("w"))
    decay: Callable[[Column, Column], Column] = lambda v, ticks: F.aggregate(F.sequence(F.lit(1), ticks), v, lambda a, _: F.floor(a * F.lit(heatmap.DECAY)))
    later = lambda v, ticks: F.when(ticks > 0, decay(v, F.greatest(ticks, F.lit(1)))).otherwise(v)
    zero = F.struct(F.get("w", F.lit(0))["tick"].alias("tick"), F.lit(0).cast("bigint").alias("n"))
    step = lambda acc, x: F.struct(x["tick"].alias("tick"), (later(acc["n"], x["tick"] - acc["tick"]) + x["c"]).alias("n"))
    done = F.aggregate("w", zero, step, lambda acc: later(acc["n"], F.lit(now) - acc["tick"]))
    return cells.select("gx", "gz", done.alias("n")).where("n > 0")


class HeatCell(StatefulProcessor):
    """Count of one cell and the tick it stands at; between ticks it decays, and a cell that has come to nothing is forgotten.

    Rows have ``tick``, the number of the period in which a point came.  A timer rings once a period of processing time and brings
    the count down, so that cells without new points are dropped as well; ``seconds`` is the period, 0 for no timers.
    """

    def __init__(self, seconds: int = heatmap.TICK_SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("heat", "n bigint, tick bigint")

    def _later(self, n: int, ticks: int) -> int:
        while n and ticks > 0:
            n, ticks = int(n * heatmap.DECAY), ticks - 1
        return n

    def _kept(self, key: tuple, n: int, tick: int) -> Row:
        if n:
            self.state.update((n, tick))
        else:
            self.state.clear()
        return Row(gx=key[0], gz=key[1], n=n, tick=tick)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        n, tick = self.state.get() if self.state.exists() else (0, None)
        if tick is None and self.seconds:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds)
        came: dict[int, int] = {}
        for r in rows:  # as many entries as a batch has periods
            came[r.tick] = came.get(r.tick, 0) + 1
        for t in sorted(came):
            at = t if tick is None else max(t, tick)  # what comes late counts when it comes
            n, tick = self._later(n, at - (at if tick is None else tick)) + came[t], at
        yield self._kept(key, n, tick)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            n, tick = self.state.get()
            row = self._kept(key, self._later(n, 1), tick + 1)
            if row.n:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds)
            yield row

    def close(self) -> None:
        pass


def heat_states(points: DataFrame, tick: Column, seconds: int = heatmap.TICK_SECONDS) -> DataFrame:
    """A stream of gx, gz, n, tick: the count of each cell whenever it changes, 0 when it is forgotten.

    The state of a cell is two numbers in the state store (which has to be RocksDB's), whatever has come.  A cell that isn't
    told of since tick t stands at n brought down by the ticks since.
    """
    inside, gx, gz = heatmap.cell(F.col("x"), F.col("z"))
    rows = points.where(inside).select(gx.alias("gx"), gz.alias("gz"), tick.cast("bigint").alias("tick"))
    return rows.groupBy("gx", "gz").transformWithState(HeatCell(seconds), "gx int, gz int, n bigint, tick bigint", "Update", "ProcessingTime" if seconds else "None")


def heat_stream(points: DataFrame, table: RunTable, checkpoint: str, tick: Column, trigger: dict | None = None, seconds: int = heatmap.TICK_SECONDS) -> StreamingQuery:
    """Keep the latest count of each cell in ``table`` (keys gx, gz); ``heat_now`` reads it."""

    def add(batch: DataFrame, n: int) -> None:
        table.apply(batch.withColumn("seq", F.col("tick")), n)

    writer = heat_states(points, tick, seconds).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).foreachBatch(add).start()


def heat_now(cells: DataFrame, now: int) -> DataFrame:
    """gx, gz, n at tick ``now`` from the latest counts; empty cells are left out."""
    ticks = F.greatest(F.lit(now) - F.col("tick"), F.lit(0)).cast("int")
    down = F.aggregate(F.when(ticks > 0, F.sequence(F.lit(1), F.greatest(ticks, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.col("n"), lambda a, _: F.floor(a * F.lit(heatmap.DECAY)))
    return cells.select("gx", "gz", down.alias("n")).where("n > 0")


def ingest_stats(frames: DataFrame, text: str, parsed: Column, handled: Column) -> DataFrame:
    """One row of counters: received, processed, dropped (unreadable) and ignored."""
    bad = F.col(text).isNull() | parsed.isNull()
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return frames.agg(F.count(F.lit(1)).alias("received"), count(~bad & handled).alias("processed"), count(bad).alias("dropped"), count(~bad & ~handled).alias("ignored"))


def is_stale(last_sync: Column, now: Column) -> Column:
    """Whether the last whole import is too long ago, or unknown."""
    return F.coalesce(now - last_sync > STALE_SECONDS, F.lit(True))
