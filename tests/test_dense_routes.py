"""Searches where a jump reaches over many systems: cells against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import routing
from tests.test_routes import SCHEMA, plain_route


def dense(spark, n, seed):
    """Points of which many share a place, and reaches of two kinds."""
    rng = random.Random(seed)
    points = {i: tuple(rng.uniform(-60, 60) for _ in "xyz") for i in range(n)} | {n + i: (7.0, 7.0, 7.0) for i in range(40)}
    reach = {i: 45.0 if i % 9 == 0 else 20.0 for i in points}
    df = spark.createDataFrame([(i, f"S{i}", *p) for i, p in points.items()], SCHEMA)
    return points, reach, routing.graph(df, F.when(F.col("id64") % 9 == 0, 45.0).otherwise(20.0))


@pytest.mark.parametrize("filled,depth", [(1, 1), (0.1, 2)])
def test_cells_link_what_pairs_do(spark, monkeypatch, filled, depth):
    points, reach, nodes = dense(spark, 1500, 3)
    monkeypatch.setattr(routing, "CELL_POINTS", filled)
    monkeypatch.setattr(routing, "CELLS_A_JUMP", 4)
    grid = routing._Grid(nodes, 45.0)
    assert grid.depth >= depth
    some = [i for i in points if points[i][0] < -30]
    others = nodes.where("x < -30")
    for backwards in (False, True):
        want = {i for i in points if any(math.dist(points[i], points[j]) <= reach[i if backwards else j] for j in some)}
        got = [r.id64 for r in grid.linked(nodes, others, backwards).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_dense_route_equals_plain_search(spark, monkeypatch):
    monkeypatch.setattr(routing, "CELL_POINTS", 1)
    monkeypatch.setattr(routing, "CELLS_A_JUMP", 4)
    points, reach, nodes = dense(spark, 700, 5)
    assert routing._Grid(nodes, 45.0).depth >= 0
    for a, b in ((0, 1), (13, 701)):
        assert routing.shortest(nodes, 45.0, {a: 0}, {b: 0}) == plain_route(points, reach, {a: 0}, {b: 0})


def test_levels_look_among_nodes_that_are_left(spark, monkeypatch):
    line = spark.createDataFrame([(i, f"S{i}", 10.0 * i, 0.0, 0.0) for i in range(6)], SCHEMA)
    looked, linked = [], routing._Grid.linked
    monkeypatch.setattr(routing._Grid, "linked", lambda self, nodes, *rest: looked.append(nodes.count()) or linked(self, nodes, *rest))
    assert {tuple(r) for r in routing.depths(line, 0, 10.0).collect()} == {(i, i) for i in range(6)}
    assert looked == [5, 4, 3, 2, 1, 0]
