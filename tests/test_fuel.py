"""The fuel fold over routes of many hops."""

import math

from pyspark.sql import functions as F

from orrery.operators import routing


def plain(lengths, tank, market, cargo, base):
    left, stock, out = float(tank), float(market), []
    for d in lengths:
        fuel = float(math.ceil(5.0 + d * (cargo + stock + max(left, 0.0) + base) / 200000.0))
        left -= fuel
        top = min(max(tank - left, 0.0), stock)
        out.append((fuel, left + top, stock - top, left >= 0))
        left, stock = left + top, stock - top
    return out


def test_routes_are_carried_over_batches_and_never_held(spark):
    lengths = lambda r: [float((k * 37 + r * 11) % 450 + 20) for k in range(1, 9001)]
    hops = spark.range(27_003).select((F.col("id") % 3).alias("route"), F.floor(F.col("id") / 3).cast("int").alias("step"))
    hops = hops.withColumn("d", F.when(F.col("step") > 0, ((F.col("step") * 37 + F.col("route") * 11) % 450 + 20).cast("double")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for squadron, base in ((False, 25_000.0), (True, 60_000.0)):
            steps = routing.fuel_steps(hops, 1000, 2000, 100, squadron)
            assert "collect_list" not in steps._jdf.queryExecution().toString()
            got = steps.orderBy("route", "step").collect()
            for r in range(3):
                assert [(h.fuel, h.tank, h.market, h.enough) for h in got if h.route == r] == plain(lengths(r), 1000, 2000, 100, base)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
