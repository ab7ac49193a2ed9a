"""The run table: equal to one fold, whatever fails; bytes follow the batch; new columns; what is kept."""

import os
import random

from orrery.operators import merge
from orrery.streaming.runs import RunTable

RULES = merge.SYSTEM_RULES | merge.STATION_RULES | {"isLandable": merge.last_given}
SCHEMA = "k int, x double, y double, z double, population bigint, haveMarket int, haveShipyard int, haveOutfitting int, otherServices string, isLandable int, name string, seq bigint"


def patches(rng, n, first):
    some = lambda *v: rng.choice((None, *v))
    return [(rng.choice((None, *range(12))), some(1.0, 2.0), some(3.0), some(4.0), some(0, 5, -1), some(0, 1), some(1), None, some("[]", '["a"]', '["b"]'), some(0, 1), some("p", "q"), first + i) for i in range(n)]


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def test_runs_equal_one_fold(spark, tmp_path):
    rng = random.Random(4)
    table, every = RunTable(spark, str(tmp_path / "t"), ["k"], RULES, fan=3), []
    assert table.read() is None
    for n in range(11):
        rows = patches(rng, 6, 10 * n)
        every += rows
        batch = spark.createDataFrame(rows, SCHEMA)
        table.apply(batch, n)
        if n in (2, 5, 8):  # again, as after a failure before the batch was noted
            table.apply(batch, n)
    want = merge.fold(spark.createDataFrame(every, SCHEMA), ["k"], RULES)
    assert sorted(map(str, table.read().select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [r["level"] for r in table.runs()] == [2, 0, 0] and len(os.listdir(tmp_path / "t" / "manifest")) <= 4
    kept = {r["name"] for r in table.runs()} | {r["name"] for r in table.runs(below=10)}
    assert set(os.listdir(tmp_path / "t" / "runs")) == kept


def test_failure_between_run_and_manifest(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ["k"], {})
    table.apply(spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int"), 0)
    table._write(spark.createDataFrame([(1, "half")], "k int, v string"), 1, 1, 0)  # no manifest names it
    assert [tuple(r) for r in table.read().collect()] == [(1, "a")]
    table.apply(spark.createDataFrame([(2, "b", 2)], "k int, v string, seq int"), 1)
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "b")}


def test_bytes_follow_the_batch_and_columns_are_added(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), ["k"], {}, fan=50)
    table.apply(spark.range(200_000).selectExpr("id AS k", "uuid() AS v", "id AS seq"), 0)
    before = size(tmp_path / "t")
    table.apply(spark.createDataFrame([(7, "new", 1)], "k bigint, added string, seq bigint"), 1)
    assert before > 5_000_000 and size(tmp_path / "t") - before < 5_000
    row = table.read().where("k = 7").first()
    assert row.added == "new" and len(row.v) == 36 and table.read().where("k = 8").first().added is None
