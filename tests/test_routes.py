"""Searches and greedy routes against plain versions on random points."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from orrery.operators import routing

SCHEMA = "id64 bigint, name string, x double, y double, z double"


def sky(spark, n, size, seed):
    rng = random.Random(seed)
    points = {i: tuple(rng.uniform(0, size) for _ in "xyz") for i in range(n)}
    return points, spark.createDataFrame([(i, f"S{i}", *p) for i, p in points.items()], SCHEMA)


def plain_route(points, reach, starts, goals, most=None):
    """Fewest jumps, least ids: distances to the goals, then step by step."""
    links = {a: [b for b in points if b != a and math.dist(points[a], points[b]) <= reach[a]] for a in points}
    back = {a: [b for b in points if a in set(links[b])] for a in points}
    away, level = {}, 0
    while level <= len(points) + max(goals.values()):
        now = [g for g, d in goals.items() if d == level and g not in away] + [b for a, d in away.items() if d == level - 1 for b in back[a] if b not in away]
        away.update(dict.fromkeys(now, level))
        level += 1
    total = min((d + away[s] for s, d in starts.items() if s in away), default=None)
    if total is None or most is not None and total > most:
        return None
    at = min((d, s) for s, d in starts.items() if s in away and d + away[s] == total)[1]
    out = [at]
    while away[at] > min(goals.values()) and not (at in goals and goals[at] == away[at]):
        at = min(b for b in links[at] if away.get(b) == away[at] - 1)
        out.append(at)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shortest_equals_plain_search(spark, seed):
    points, df = sky(spark, 120, 100.0, seed)
    rng = random.Random(seed + 50)
    reach = {i: 38.0 if i % 5 == 0 else 17.0 for i in points}
    nodes = routing.graph(df, F.when(F.col("id64") % 5 == 0, 38.0).otherwise(17.0))
    a, b = rng.sample(range(120), 2)
    for starts, goals in (({a: 0}, {b: 0}), ({a: 2}, {b: 3})):
        want = plain_route(points, reach, starts, goals)
        assert routing.shortest(nodes, 38.0, starts, goals) == want
        if want is not None:
            jumps = len(want) - 1 + starts[a] + goals[b]
            assert routing.shortest(nodes, 38.0, starts, goals, jumps) == want
            assert routing.shortest(nodes, 38.0, starts, goals, jumps - 1) is None


def test_search_edges(spark):
    line = spark.createDataFrame([(i, f"S{i}", 10.0 * i, 0.0, 0.0) for i in range(8)] + [(9, "far", 1e6, 0.0, 0.0), (10, "unplaced", None, 0.0, 0.0)], SCHEMA)
    assert routing.ship_route(line, 0, 7, 20.0) == [0, 1, 3, 5, 7]
    assert routing.ship_route(line, 3, 3) == [3]
    for goal, radius in ((7, 5.0), (9, 20.0), (10, 20.0), (11, 20.0)):
        with pytest.raises(routing.RouteError):
            routing.ship_route(line, 0, goal, radius)
    assert {tuple(r) for r in routing.depths(line, 0, 20.0).collect()} == {(i, (i + 1) // 2) for i in range(8)}
    assert {tuple(r) for r in routing.depths(line, 0, 20.0, most=2).collect()} == {(i, (i + 1) // 2) for i in range(5)}
    assert routing.carrier_route(line, 0, 0)[0] == [0, 0]
    stars = spark.createDataFrame([(0,)], "systemId64 bigint")
    assert len(routing.neutron_search(line, stars, 0, 7, routing.Ship(10.0))) == 5
    assert len(routing.neutron_search(line, stars, 0, 7, routing.Ship(10.0, "Caspian"))) == 3
    assert routing.neutron_search(line, stars, 7, 9, routing.Ship(10.0)) is None


def test_many_levels_are_compacted(spark):
    line = spark.createDataFrame([(i, f"S{i}", 10.0 * i, 0.0, 0.0) for i in range(25)], SCHEMA)
    assert routing.ship_route(line, 24, 0, 10.0) == list(range(24, -1, -1))
    assert {tuple(r) for r in routing.depths(line, 0, 10.0).collect()} == {(i, i) for i in range(25)}


def plain_greedy(points, stars, ship, start, stops):
    at, out = start, [start]
    for stop in stops:
        begin = points[at]
        half = max(3 * ship.boosted, 1500.0)

        def in_segment(p):
            a, d = begin, [v - u for u, v in zip(begin, points[stop], strict=True)]
            size = sum(x * x for x in d)
            t = min(1.0, max(0.0, sum((u - v) * x for u, v, x in zip(p, a, d, strict=True)) / size))
            return math.dist(p, [u + t * x for u, x in zip(a, d, strict=True)]) <= half

        while True:
            reach, left = ship.boosted if at in stars else ship.jump, math.dist(points[at], points[stop])
            if left <= reach:
                out += [stop] if at != stop else []
                at = stop
                break
            closer = [(math.dist(points[i], points[stop]), i, math.dist(points[i], points[at])) for i in points]
            closer = [(t, i, d) for t, i, d in closer if d > 0 and t < left]
            for ok in (lambda i, d: i in stars and d <= reach and in_segment(points[i]), lambda i, d: d <= reach, lambda i, d: d <= 1.05 * reach):
                if some := [(t, i) for t, i, d in closer if ok(i, d)]:
                    break
            if not some:
                break
            at = min(some)[1]
            out.append(at)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_neutron_greedy_equals_plain_version(spark, seed):
    points, df = sky(spark, 400, 6000.0, seed)
    stars = {i for i in points if i % 4 == 0}
    marked = routing.with_neutrons(df, spark.createDataFrame([(i,) for i in stars], "systemId64 bigint")).cache()
    row = lambda i: Row(id64=i, x=points[i][0], y=points[i][1], z=points[i][2], neutron=i in stars)
    ship, stops = routing.Ship(420.0), random.Random(seed).sample(range(400), 3)
    got = routing.neutron_greedy(routing.in_cube(marked), ship, row(1), [row(i) for i in stops])
    assert [r.id64 for r in got] == plain_greedy(points, stars, ship, 1, stops)


def test_neutron_route_keeps_greedy_ends(spark):
    """The greedy route runs into a bend of stars; the search finds the straight way between its first and last star."""
    line = [(i, f"S{i}", 100.0 * i, 0.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(line, SCHEMA)
    stars = spark.createDataFrame([(i,) for i in range(2, 60, 4)], "systemId64 bigint")
    ship = routing.Ship(100.0)
    route, better = routing.neutron_route(df, stars, 0, 59, ship)
    greedy, no = routing.neutron_route(df, stars, 0, 59, ship, engine="greedy")
    assert (greedy[0], greedy[-1], no) == (0, 59, False) and len(route) <= len(greedy) and better == (len(route) < len(greedy))
    assert route[:3] == [0, 1, 2] and all(b - a <= (4 if a % 4 == 2 else 1) for a, b in zip(route, route[1:], strict=False))
    row = lambda i: Row(id64=i, neutron=i % 4 == 2)
    nodes = routing.graph(df.where("id64 % 4 = 2 or id64 in (0, 19)"), F.when(F.col("id64") % 4 == 2, 400.0).otherwise(100.0))
    long = [row(i) for i in (0, 1, 2, 3, 6, 9, 10, 14, 15, 18, 19)]
    assert routing.refined(nodes, ship, long, True) == [0, 1, 2, 6, 10, 14, 18, 19]
    assert routing.refined(nodes, ship, long, False) == [0, 1, 2, 6, 10, 14, 18, 19]
    assert routing.refined(nodes, ship, [row(i) for i in (0, 1, 2, 6, 10, 14, 18, 19)], True) is None
    with pytest.raises(routing.RouteError):
        routing.neutron_route(df, stars.limit(0), 0, 59, routing.Ship(90.0))
