"""Counters of an ingest, taken while its rows pass, and the report that they are a part of.

``observed`` attaches the counts to the rows themselves, so nothing is read twice: a batch reads them from an
``Observation``, a stream's come with the progress of each micro-batch to ``Counters``, a listener.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from orrery.operators import heatmap, translate

NAME = "orrery_ingest"
#: Counters that add up, and times of which the latest counts.
SUMS = ("messages_received", "messages_processed", "messages_dropped", "systems_emitted", "bodies_emitted", "stations_emitted", "total_bumps")
LATEST = ("last_message_time",)


def observed(frames: DataFrame, to: Observation | str = NAME, payload: str = "json", schema: str = translate.JOURNAL, arrived: str | None = None) -> DataFrame:
    """The handled messages of ``frames``, as ``translate.messages`` gives them, with the counts of all frames observed on the way.

    A frame is dropped if its text is null or isn't JSON, and processed if it gives a system.
    ``arrived`` names a column of seconds.
    """
    m = F.col("message")
    rows = translate.read(frames, payload, schema)
    rows = translate.once(rows, _gives=F.coalesce(F.col("_named") & translate.handled(m), F.lit(False)))
    gives, place = F.col("_gives"), [translate.number(m, f"$.StarPos[{i}]") for i in (0, 2)]
    bump = F.coalesce(gives & translate.placed(m) & heatmap.cell(*place)[0], F.lit(False))
    count = lambda c, name: F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(name)
    counts = [
        F.count(F.lit(1)).alias("messages_received"), count(gives, "messages_processed"), count(F.col("_unread"), "messages_dropped"), count(gives, "systems_emitted"),
        count(gives & F.coalesce(translate.of_body(m), F.lit(False)), "bodies_emitted"), count(gives & F.coalesce(translate.of_station(m), F.lit(False)), "stations_emitted"),
        count(bump, "total_bumps"), F.coalesce(F.max(F.when(gives, F.col(arrived))) if arrived else F.lit(None), F.lit(0)).cast("bigint").alias("last_message_time"),
    ]
    return rows.observe(to, *counts).where("_gives").drop("_gives", "_named", "_unread")


class Counters(StreamingQueryListener):
    """Counts of all micro-batches of streams with ``observed`` rows: ``spark.streams.addListener(counters)``.

    A micro-batch that runs again after a failure reports its progress once, when it is done.
    """

    def __init__(self, name: str = NAME):
        self.name, self.connected, self.reconnects = name, False, 0
        self.values: dict[str, int] = dict.fromkeys((*SUMS, *LATEST), 0)

    def add(self, counts: dict) -> None:
        for k in SUMS:
            self.values[k] += counts[k]
        for k in LATEST:
            self.values[k] = max(self.values[k], counts[k])

    def onQueryStarted(self, event) -> None:
        self.connected = True

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.connected = False


def pushed_counts(documents: DataFrame, now: Column) -> DataFrame:
    """One row about a pushed batch: systems, bodies and stations, and when it came; of single documents as of many."""
    size = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")), F.lit(0))
    return documents.agg(F.count(F.lit(1)).alias("systems_ingested"), size("bodies").alias("bodies_ingested"), size("stations").alias("stations_ingested"), F.max(now).alias("last_ingest_time"))


def report(spark: SparkSession, live: Counters, pushed: DataFrame, meta: DataFrame) -> DataFrame:
    """One nested row: what was pushed, what came live, the heat map, and the last whole import by ``meta`` (key, value)."""
    v = live.values
    eddn = F.struct(F.lit(live.connected).alias("connected"), *[F.lit(v[k]).cast("bigint").alias(k) for k in (*SUMS[:-1], *LATEST)], F.lit(live.reconnects).cast("bigint").alias("reconnects"))
    bounds = lambda a, b: F.array(F.lit(a), F.lit(b))
    heat = F.struct(
        F.lit(v["total_bumps"]).cast("bigint").alias("total_bumps"), F.lit(f"{heatmap.CELLS}x{heatmap.CELLS}").alias("grid"), bounds(heatmap.X_MIN, heatmap.X_MAX).alias("bounds_x"),
        bounds(heatmap.Z_MIN, heatmap.Z_MAX).alias("bounds_z"), F.lit(heatmap.DECAY).alias("decay_factor_per_5min"),
    )
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    known = meta.agg(F.coalesce(of("last_sync_time").try_cast("bigint"), F.lit(0)).cast("bigint").alias("last_sync"), F.coalesce(of("import_complete"), F.lit("false")).alias("import_complete"))
    one = pushed.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("systems_ingested", "bodies_ingested", "stations_ingested")], F.coalesce(F.max("last_ingest_time"), F.lit(0)).cast("bigint").alias("last_ingest_time"))
    return one.select(F.struct("*").alias("push_ingest")).join(known.select(F.struct("*").alias("database")), F.lit(True)).select("push_ingest", eddn.alias("live_ingest"), heat.alias("heatmap"), "database")
