"""Heat kept as state equals heat folded over time, and cells that cool down are forgotten."""

import random
import time

import pytest
from pyspark.sql import functions as F

from orrery.operators import heatmap
from orrery.streaming import live
from orrery.streaming.runs import RunTable

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture
def rocks(spark):
    spark.conf.set(*STORE)
    yield spark
    spark.conf.unset(STORE[0])


def test_state_equals_fold_over_time(rocks, tmp_path):
    spark, rng = rocks, random.Random(6)
    rows = [(rng.choice((0.0, 50.0, 900.0, -60_000.0)), rng.choice((0.0, 300.0)), t) for t in (0, 1, 1, 4, 9) for _ in range(60)]
    for t in (0, 1, 4, 9):
        spark.createDataFrame([r for r in rows if r[2] == t], "x double, z double, tick int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    table = RunTable(spark, str(tmp_path / "heat"), ["gx", "gz"], {})
    stream = spark.readStream.schema("x double, z double, tick int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.heat_stream(stream, table, str(tmp_path / "c"), F.col("tick"), {"availableNow": True}, seconds=0).awaitTermination(120)
    every = spark.createDataFrame(rows, "x double, z double, tick int")
    for now in (9, 12, 40):
        got = live.heat_now(table.read(), now)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.heat_over_time(every, F.col("tick"), now).collect()))


def test_timers_cool_cells_down(rocks, tmp_path):
    spark = rocks
    spark.createDataFrame([(0.0, 0.0, 0)] * 2, "x double, z double, tick int").write.parquet(str(tmp_path / "in"))
    seen = []
    rows = live.heat_states(spark.readStream.schema("x double, z double, tick int").parquet(str(tmp_path / "in")), F.col("tick"), seconds=1)
    query = rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").foreachBatch(lambda df, n: seen.extend((r.n, r.tick) for r in df.collect())).start()
    try:
        until = time.time() + 60
        while time.time() < until and (not seen or seen[-1][0]):
            time.sleep(0.2)
    finally:
        query.stop()
    # 2, then 1 (1.98 cut off), then 0 and forgotten
    assert seen == [(2, 0), (1, 1), (0, 2)] and heatmap.DECAY < 1
