"""Pairs within a radius against all pairs."""

import math
import random

from orrery.operators import search


def test_pairs_meet_once_over_all_tasks(spark):
    rng = random.Random(2)
    points = {i: tuple(rng.uniform(-40, 40) for _ in "xyz") for i in range(300)} | {300 + i: (3.0 * i, 6.0, -3.0) for i in range(20)} | {400 + i: (0.0, 6.0, -3.0) for i in range(5)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(999, None, 0.0, 0.0)], "id64 bigint, x double, y double, z double").coalesce(1)
    pairs = search.pairs_within(df, 12.0)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in points for j in points if i != j and math.dist(points[i], points[j]) <= 12.0}
    assert all(r.d == math.dist(points[r.a], points[r.b]) or math.isclose(r.d, math.dist(points[r.a], points[r.b])) for r in pairs.limit(50).collect())


def test_points_visit_only_cells_within_reach(spark):
    rng = random.Random(5)
    points = {i: tuple(rng.choice((0.0, 4e8, -7e9)) + rng.uniform(-30, 30) for _ in "xyz") for i in range(400)}
    points |= {500 + i: (10.0 * (i % 3), 10.0 * (i // 3 % 3), 10.0 * (i // 9) - 10.0) for i in range(27)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "id64 bigint, x double, y double, z double")
    plain = df.where("id64 < 400 and abs(x) < 100 and abs(y) < 100 and abs(z) < 100").union(df.where("id64 < 400").selectExpr("id64", "x % 30", "y % 30", "z % 30"))
    assert search._visits(plain, 10.0).count() < 12 * plain.count()  # of 14
    got = [(r.a, r.b) for r in search.pairs_within(df, 10.0).collect()]
    want = {(i, j) for i, p in points.items() for j, q in points.items() if i != j and sum((u - v) * (u - v) for u, v in zip(p, q)) <= 100.0}
    assert len(got) == len(set(got)) and set(got) == want
