"""Counters of a stream, and the report."""

import json

from orrery.streaming import stats


def test_stream_counters_and_report(spark, tmp_path):
    scan = {"event": "Scan", "SystemAddress": 1, "StarSystem": "S", "BodyID": 2, "BodyName": "B", "StarPos": [1, 2, 3]}
    docked = {"event": "Docked", "SystemAddress": 1, "StarSystem": "S", "MarketID": 2, "StationName": "T", "StarPos": [1, 2, 99_999]}
    frames = [json.dumps({"$schemaRef": "https://eddn.edcd.io/schemas/journal/1", "message": m}) for m in (scan, scan | {"BodyID": None}, docked, {"event": "Location", "SystemAddress": 1, "StarSystem": "S"}, scan | {"event": "Music"})]
    frames += ["{broken", None, json.dumps({"$schemaRef": "https://other/1", "message": scan})]
    for k in range(2):
        spark.createDataFrame([(f, 10 * k + i) for i, f in enumerate(frames)], "json string, at bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counters = stats.Counters()
    spark.streams.addListener(counters)
    try:
        rows = stats.observed(spark.readStream.schema("json string, at bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), arrived="at")
        query = rows.select("id64").writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        for _ in range(100):  # the listener is told in its own time
            if counters.values["messages_received"] >= 16 and not counters.connected:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.values == {"messages_received": 16, "messages_processed": 6, "messages_dropped": 4, "systems_emitted": 6, "bodies_emitted": 2, "stations_emitted": 2, "total_bumps": 2, "last_message_time": 13}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    documents = spark.sql("SELECT array(1, 2) AS bodies, cast(null AS array<int>) AS stations UNION ALL SELECT array(1), array(7)")
    meta = spark.createDataFrame([("last_sync_time", "1700"), ("import_complete", "true")], "key string, value string")
    got = stats.report(spark, counters, stats.pushed_counts(documents, stats.F.lit(99)), meta).first().asDict(recursive=True)
    assert got["push_ingest"] == {"systems_ingested": 2, "bodies_ingested": 3, "stations_ingested": 1, "last_ingest_time": 99}
    assert got["database"] == {"last_sync": 1700, "import_complete": "true"} and got["heatmap"]["grid"] == "1024x1024"
    assert got["live_ingest"]["messages_processed"] == 6 and got["live_ingest"]["connected"] is False and got["live_ingest"]["reconnects"] == 0
    empty = stats.report(spark, stats.Counters(), stats.pushed_counts(documents.limit(0), stats.F.lit(99)), meta.limit(0)).first()
    assert empty.push_ingest.last_ingest_time == 0 and empty.database.last_sync == 0 and empty.database.import_complete == "false"
