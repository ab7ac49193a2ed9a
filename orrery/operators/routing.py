"""Route planning over implicit graphs: systems are nodes, an edge joins two within a range.

Every edge costs one jump, so the best route is a breadth-first search: level by level, each level a join of the frontier
with the grid cells around it, written as a table that cuts the lineage.  Searches between two systems grow from both
ends.  A capsule around the line of travel bounds the nodes; none of it comes to the driver but one row a jump.  Greedy
routes are an aggregate a step over any number of systems.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.sources.shared import shared_dir

from .search import nearest_in_boxes

# Fixed values of the planners.
SHIP_RANGE, CARRIER_RANGE, CARRIER_AIM, CARRIER_BOXES, CARRIER_STEPS, CARRIER_WIDTH = 14.99, 500.0, 498.5, (20.0, 50.0, 80.0, 110.0, 140.0), 500, 1500.0
WAYPOINT_SPACING, SEGMENT_STEPS, FALLBACK, LAST_HOP, LONG, BASE_MASS, SQUADRON_MASS = 2000.0, 1000, 1.05, 1.5, 10_000.0, 25_000.0, 60_000.0
CELLS_A_JUMP, CELL_POINTS = 8, 16  # of a search over dense systems: cells along a jump, and points that a cell may hold
Point = tuple[float, float, float]


class RouteError(ValueError):
    """No route, or an unknown system."""


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


# ------------------------------------------------------------------ search
_XYZ = ("x", "y", "z")


def graph(systems: DataFrame, reach: Column | float) -> DataFrame:
    """Nodes of a search, written once and dealt over tasks: id64, x, y, z and how far a jump from there goes."""
    far = F.lit(float(reach)) if isinstance(reach, (int, float)) else reach
    rows = systems.select("id64", *_XYZ, far.alias("reach")).where("x is not null and y is not null and z is not null")
    return _checkpointed(rows.repartition(int(systems.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id64"))


def _linked(nodes: DataFrame, others: DataFrame, widest: float, backwards: bool = False) -> DataFrame:
    """The ``nodes`` that can be reached from one of ``others`` by a jump (backwards: that reach one of them).

    A semi-join on grid cells as wide as the widest jump, so that a node comes once however many reach it.
    """
    size, around = F.lit(float(widest)), F.array(*[F.lit(k) for k in (-1, 0, 1)])
    o = others.select(*[F.col(c).alias(f"o{c}") for c in _XYZ], F.col("reach").alias("oreach"))
    for c in _XYZ:
        o = o.withColumn("_k", F.explode(around)).withColumn(f"c{c}", F.floor(F.col(f"o{c}") / size) + F.col("_k")).drop("_k")
    n = nodes.select("*", *[F.floor(F.col(c) / size).alias(f"n{c}") for c in _XYZ])
    d2 = S.distance_squared(*map(F.col, ("x", "y", "z", "ox", "oy", "oz")))
    far = F.col("reach" if backwards else "oreach")
    same = (F.col("nx") == F.col("cx")) & (F.col("ny") == F.col("cy")) & (F.col("nz") == F.col("cz"))
    return n.join(o, same & (d2 <= far * far), "left_semi").select(*nodes.columns)


class _Grid:
    """Which systems are linked, by cells where a jump reaches over many of them.

    A cell is a part of space and a reach, with the box around its points.  Two cells whose boxes are within reach at their
    farthest link all their points, two that are beyond it at their nearest link none, and only the rest is taken apart: into
    cells half as wide, and at last into points.  Cells are halved until they hold few points, and what has to be taken apart lies
    along the rim of what is reached, so the work grows with the number of systems and not with the pairs that a jump could join.
    """

    def __init__(self, nodes: DataFrame, widest: float):
        self.nodes, self.widest = nodes, widest
        self.depth = self._depth()

    def _depth(self) -> int:
        """How often cells are halved until they hold ``CELL_POINTS``; -1 where even the widest hold no more, so that points are joined."""
        n, cells = self.nodes.agg(F.count(F.lit(1)), F.approx_count_distinct(self._cell(0))).first()
        full = n / max(cells, 1) / CELL_POINTS
        return -1 if full <= 1 else math.ceil(math.log(full, 8))

    def _cell(self, halved: int) -> Column:
        return F.struct(*[F.floor(F.col(c) / F.lit(self.widest / (CELLS_A_JUMP << halved))).alias(c) for c in _XYZ], "reach")

    def _cells(self, points: DataFrame, halved: int) -> DataFrame:
        """Cells with the box around their points."""
        box = [f(c).alias(f"{k}{c}") for c in _XYZ for k, f in (("l", F.min), ("h", F.max))]
        return points.groupBy(self._cell(halved).alias("cell")).agg(*box)

    def _dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df`` over all tasks: cells are few bytes, so that by their size a few tasks would get them, but they meet many others."""
        return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    def _near(self, cells: DataFrame, others: DataFrame, pairs: DataFrame | None, backwards: bool) -> DataFrame:
        """Pairs of cells (cell, ocell) within reach at their nearest, and whether they are at their farthest (sure).

        They are looked for among the parts of ``pairs``, or without it among all cells a jump around.
        """
        o = others.select(*[F.col(c).alias(f"o{c}") for c in others.columns])
        if pairs is None:
            block = lambda cell: [F.floor(F.col(f"{cell}.{c}") / F.lit(CELLS_A_JUMP)).alias(f"{cell}_{c}") for c in _XYZ]
            o, n = o.select("*", *block("ocell")), cells.select("*", *block("cell"))
            for c in _XYZ:
                o = o.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn(f"ocell_{c}", F.col(f"ocell_{c}") + F.col("_k")).drop("_k")
            both = self._dealt(n, *[f"cell_{c}" for c in _XYZ]).join(self._dealt(o, *[f"ocell_{c}" for c in _XYZ]), reduce(lambda a, b: a & b, [F.col(f"cell_{c}") == F.col(f"ocell_{c}") for c in _XYZ]))
        else:
            whole = lambda cell: F.struct(*[F.floor(F.col(f"{cell}.{c}") / F.lit(2)).alias(c) for c in _XYZ], f"{cell}.reach")
            wide = pairs.select(F.col("cell").alias("pcell"), F.col("ocell").alias("pocell"))
            parts = self._dealt(cells.withColumn("pcell", whole("cell")), "pcell").join(self._dealt(wide, "pcell"), "pcell")
            both = self._dealt(parts, "pocell").join(self._dealt(o.withColumn("pocell", whole("ocell")), "pocell"), "pocell")
        # differences of coordinates lie between those of the boxes' ends, in floating point too
        apart = [F.greatest(F.col(f"l{c}") - F.col(f"oh{c}"), F.col(f"ol{c}") - F.col(f"h{c}"), F.lit(0.0)) for c in _XYZ]
        across = [F.greatest(F.col(f"h{c}") - F.col(f"ol{c}"), F.col(f"oh{c}") - F.col(f"l{c}")) for c in _XYZ]
        squared = lambda d: d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        far = F.col("cell.reach" if backwards else "ocell.reach")
        return both.where(squared(apart) <= far * far).select("cell", "ocell", (squared(across) <= far * far).alias("sure"))

    def linked(self, nodes: DataFrame, others: DataFrame, backwards: bool = False) -> DataFrame:
        """The ``nodes`` that can be reached from one of ``others`` by a jump (backwards: that reach one of them)."""
        if self.depth < 0:
            return _linked(nodes, others, self.widest, backwards)
        found, rest, pairs = [], nodes, None
        for k in range(self.depth + 1):
            cells = _checkpointed(self._cells(rest, k))
            ocells = _checkpointed(self._cells(others, k))
            near = lambda some: self._near(some, ocells, pairs, backwards)  # noqa: B023, E731
            known = _checkpointed(near(cells).groupBy("cell").agg(F.bool_or("sure").alias("sure")))
            of = lambda sure: known.where("sure" if sure else "not sure").select("cell")  # noqa: B023, E731
            keyed = rest.withColumn("cell", self._cell(k))
            found.append(keyed.join(of(True), "cell", "left_semi").select(*nodes.columns))
            rest = keyed.join(of(False), "cell", "left_semi").select(*nodes.columns)
            pairs = _checkpointed(near(cells.join(of(False), "cell", "left_semi")).select("cell", "ocell"))
        o = others.select(self._cell(self.depth).alias("ocell"), *[F.col(c).alias(f"o{c}") for c in (*_XYZ, "reach")])
        d2 = S.distance_squared(*map(F.col, ("x", "y", "z", "ox", "oy", "oz")))
        far = F.col("reach" if backwards else "oreach")
        n = rest.select("*", self._cell(self.depth).alias("ncell"))
        found.append(n.join(pairs.join(o, "ocell"), (F.col("ncell") == F.col("cell")) & (d2 <= far * far), "left_semi").select(*nodes.columns))
        return reduce(DataFrame.union, found)


class _Side:
    """One side of a search: a table of nodes for each depth, of which the last is the frontier.

    ``seeds`` are ids and the depths at which they join in.
    """

    def __init__(self, grid: _Grid, seeds: dict[int, int], backwards: bool = False):
        self.grid, self.left, self.seeds, self.backwards = grid, grid.nodes, seeds, backwards
        self.first = self.level = min(seeds.values())
        self.levels: dict[int, DataFrame] = {}
        self._reached(self._due())

    def _due(self) -> DataFrame:
        return self.left.where(F.col("id64").isin([k for k, d in self.seeds.items() if d == self.level]))

    def _reached(self, found: DataFrame) -> None:
        """``found`` are the nodes of this level; the next ones are looked for among those that are left."""
        self.levels[self.level] = _checkpointed(found)
        self.size = self.levels[self.level].count()
        if self.size:
            self.left = _checkpointed(self.left.join(self.levels[self.level].select("id64"), "id64", "left_anti"))

    @property
    def joined(self) -> bool:
        return self.level >= max(self.seeds.values())

    @property
    def ended(self) -> bool:
        return self.size == 0 and self.joined

    def expand(self) -> None:
        found = self.grid.linked(self.left, self.levels[self.level], self.backwards)
        self.level += 1
        if self.level in self.seeds.values():
            found = found.union(self._due()).dropDuplicates(["id64"])
        self._reached(found)

    def depths(self) -> DataFrame:
        return reduce(DataFrame.union, [t.select("id64", F.lit(k).alias("depth")) for k, t in self.levels.items()])


def depths(systems: DataFrame, start: int, radius: float, most: int | None = None) -> DataFrame:
    """Jumps from ``start`` to every system that can be reached (in ``most`` jumps): id64, depth."""
    side = _Side(_Grid(graph(systems, radius), radius), {start: 0})
    while not side.ended and (most is None or side.level < most):
        side.expand()
    return side.depths()


def shortest(nodes: DataFrame, widest: float, starts: dict[int, int], goals: dict[int, int], most: int | None = None) -> list[int] | None:
    """Ids of a route of fewest jumps from one of ``starts`` to one of ``goals``, or None if there is none in ``most``.

    Starts and goals have depths of their own, which count as jumps.  Both sides grow level by level, the smaller frontier
    first, each level a semi-join against the nodes (see ``_Grid``) and one anti-join against what was seen; where
    they meet is a join.  Of equal routes it is the one whose ids are least from the start on, so every run finds the same.
    One row a jump comes to the driver.
    """
    grid = _Grid(nodes, widest)
    ahead, back = _Side(grid, starts), _Side(grid, goals, backwards=True)
    total: int | None = None

    def met(new: _Side, other: _Side) -> None:
        nonlocal total
        least = new.levels[new.level].join(other.depths(), "id64").agg(F.min("depth")).first()[0]
        if least is not None and (total is None or new.level + least < total):
            total = new.level + least

    met(ahead, back)
    # every route of ahead.level + back.level jumps or fewer is known
    while (total is None or total > ahead.level + back.level + 1) and (most is None or ahead.level + back.level < most):
        if ahead.ended and back.joined or back.ended and ahead.joined:
            break
        grows = min((s for s in (ahead, back) if not s.ended), key=lambda s: s.size)
        grows.expand()
        met(grows, back if grows is ahead else ahead)
    if total is None or most is not None and total > most:
        return None
    return _least_route(ahead, back, total)


def _least_route(ahead: _Side, back: _Side, total: int) -> list[int]:
    """The route of ``total`` jumps whose ids are least, from the levels of both sides."""
    middle = min(ahead.level, total - back.first)
    # what lies on a route, level by level from the middle to the start
    on = {middle: _checkpointed(ahead.levels[middle].join(back.levels[total - middle].select("id64"), "id64", "left_semi"))}
    for k in range(middle - 1, ahead.first - 1, -1):
        on[k] = _checkpointed(ahead.grid.linked(ahead.levels[k], on[k + 1], backwards=True)) if k in ahead.levels else on[k + 1].limit(0)
    begins = [k for k in range(ahead.first, middle + 1) if k in ahead.seeds.values()]
    at = None
    for k in begins:  # a start of small depth wins among equals
        at = on[k].where(F.col("id64").isin([i for i, d in ahead.seeds.items() if d == k])).orderBy("id64").first()
        if at is not None:
            break
    route, level = [at.id64], k
    for k in range(level + 1, total - back.first + 1):
        rows = on[k] if k <= middle else back.levels[total - k]
        here = S.distance_squared(*map(F.col, _XYZ), *[F.lit(at[c]) for c in _XYZ]) <= F.lit(at.reach * at.reach)
        step = rows.where(here).orderBy("id64").first()
        if step is None:  # a goal of greater depth was met
            break
        at = step
        route.append(at.id64)
    return route


def _place(systems: DataFrame, *ids: int) -> dict[int, Point]:
    found = {r.id64: (r.x, r.y, r.z) for r in systems.where(F.col("id64").isin(*ids)).select("id64", "x", "y", "z").collect()}
    for i in ids:
        if found.get(i, (None,))[0] is None:
            raise RouteError(f"unknown system: {i}")
    return found


def ship_route(systems: DataFrame, start: int, goal: int, radius: float = SHIP_RANGE) -> list[int]:
    """Ids of a route of fewest jumps."""
    _place(systems, start, goal)
    if start == goal:
        return [start]
    route = shortest(graph(systems, radius), radius, {start: 0}, {goal: 0})
    if route is None:
        raise RouteError("no route")
    return route


# ------------------------------------------------------------------ carriers
def capsule(systems: DataFrame, a: Point, b: Point, half: float) -> DataFrame:
    return systems.where(S.in_capsule(F.col("x"), F.col("y"), F.col("z"), a, b, half))


def carrier_greedy(systems: DataFrame, place: dict[int, Point], start: int, goal: int) -> list[int]:
    """Aim one range ahead and take, from the first box around the aim that has any, the system closest to the goal.

    Each step is one aggregate over the box, of which one row comes to the driver.
    """
    at, end, out = place[start], place[goal], [start]
    xyz, to_goal = [F.col(c) for c in "xyz"], S.distance(*map(F.col, "xyz"), *map(F.lit, end))
    for _ in range(CARRIER_STEPS):
        left = math.dist(at, end)
        if left <= CARRIER_RANGE:
            break
        aim = [a + (e - a) / left * CARRIER_AIM for a, e in zip(at, end, strict=True)]
        d = S.distance(*xyz, *map(F.lit, at))
        off = F.greatest(*[F.abs(c - F.lit(m)) for c, m in zip(xyz, aim, strict=True)])
        near = systems.where((off <= CARRIER_BOXES[-1]) & (d > 0) & (d <= CARRIER_RANGE) & (to_goal < left))
        box = F.coalesce(*[F.when(off <= half, F.lit(half)) for half in CARRIER_BOXES])
        best = near.agg(F.min(F.struct(box.alias("box"), to_goal.alias("left"), "id64", "x", "y", "z")).alias("m")).first().m
        if best is None:
            raise RouteError("no system within a jump ahead")
        at = (best.x, best.y, best.z)
        out.append(best.id64)
    return [*out, goal]


def carrier_route(systems: DataFrame, start: int, goal: int, engine: str = "greedy") -> tuple[list[int], bool]:
    """Ids of the route and whether the search, which any engine but ``greedy`` asks for, beat the greedy one."""
    place = _place(systems, start, goal)
    near = graph(capsule(systems, place[start], place[goal], CARRIER_WIDTH), CARRIER_RANGE)
    greedy = carrier_greedy(near, place, start, goal)
    if engine != "greedy" and start != goal:
        best = shortest(near, CARRIER_RANGE, {start: 0}, {goal: 0}, len(greedy) - 2)
        if best is not None:
            return best, True
    return greedy, False


def fuel_steps(hops: DataFrame, tank: float, market: float, cargo: float = 0.0, squadron: bool = False) -> DataFrame:
    """Per route the hops with fuel used, tank and market after, and whether the tank was enough.

    ``hops`` has route, step and d (length of the jump to this hop; null at the start).  Each hop needs the one before, so a
    route is one task's; its hops pass in order, batch by batch, with the tank and market of the last one carried on.
    """
    base, full, sold = SQUADRON_MASS if squadron else BASE_MASS, float(tank), float(market)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, left, stock, begun = None, full, sold, False
        for batch in batches:
            out: list[list] = [[], [], [], []]
            routes, lengths = batch.column("route").to_pylist(), batch.column("d").to_pylist()
            for r, d in zip(routes, lengths, strict=True):
                if not begun or r != route:
                    route, left, stock, begun = r, full, sold, True
                burnt = 5.0 + d * (cargo + stock + max(left, 0.0) + base) / 200000.0
                fuel = float(math.ceil(burnt)) if math.isfinite(burnt) else burnt
                left -= fuel
                enough, missing = left >= 0, max(full - left, 0.0)
                top = missing if missing <= stock else stock
                left, stock = left + top, stock - top
                for column, value in zip(out, (fuel, left, stock, enough), strict=True):
                    column.append(value)
            types = (pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            added = [pa.array(column, kind) for column, kind in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("route", "step", "d")), *added], ["route", "step", "d", "fuel", "tank", "market", "enough"])

    rows = hops.where(F.col("d").isNotNull()).select("route", F.col("step").cast("int"), F.col("d").cast("double"))
    kind = rows.schema["route"].dataType.simpleString()
    return rows.repartition("route").sortWithinPartitions("route", "step", "d").mapInArrow(fold, f"route {kind}, step int, d double, fuel double, tank double, market double, enough boolean")


# ------------------------------------------------------------------ neutron routes
def boosted_range(jump: float, ship: str = "") -> float:
    return jump * (6 if ship.lower() == "caspian" else 4)


def waypoints(spark: SparkSession, a: Point, b: Point, spacing: float = WAYPOINT_SPACING) -> DataFrame:
    """Points along the line every ``spacing``: i, x, y, z."""
    total = math.dist(a, b)
    n = math.ceil(total / spacing)
    row = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")).alias("i"))
    return row.select("i", *[(F.lit(u) + F.lit(v - u) * (F.col("i") * F.lit(spacing) / F.lit(total or 1.0))).alias(c) for c, u, v in zip("xyz", a, b, strict=True)])


@dataclass(frozen=True)
class Ship:
    """How far a jump goes, from a plain star and from a neutron star."""

    jump: float
    kind: str = ""

    @property
    def boosted(self) -> float:
        return boosted_range(self.jump, self.kind)


def with_neutrons(systems: DataFrame, neutrons: DataFrame) -> DataFrame:
    """``systems`` with ``neutron``; ``neutrons`` has systemId64."""
    stars = neutrons.select(F.col("systemId64").alias("id64"), F.lit(True).alias("neutron"))
    return systems.select("id64", "x", "y", "z").join(stars, "id64", "left").withColumn("neutron", F.coalesce("neutron", F.lit(False)))


Near = Callable[[Point, float], DataFrame]


def waypoints_to(ends: DataFrame, a: Point, spacing: float = WAYPOINT_SPACING) -> DataFrame:
    """Points every ``spacing`` along the line from ``a`` to each of ``ends`` (id64, x, y, z): id64, i, x, y, z."""
    total = S.distance(*map(F.col, _XYZ), *map(F.lit, a))
    rows = ends.withColumn("_total", total).withColumn("_n", F.ceil(F.col("_total") / spacing).cast("int")).where("_n > 1")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    return rows.select("id64", "i", *[(F.lit(u) + (F.col(c) - F.lit(u)) * (F.col("i") * F.lit(spacing) / F.col("_total"))).alias(c) for c, u in zip(_XYZ, a, strict=True)])


def in_cube(marked: DataFrame) -> Near:
    """Look-ups of ``marked`` by cube, for systems that aren't stored in an order of their own."""
    return lambda centre, half: marked.where(S.in_box(F.col("x"), F.col("y"), F.col("z"), centre, half))


def neutron_greedy(near: Near, ship: Ship, start: Row, stops: list[Row]) -> list[Row]:
    """From stop to stop: the stop itself where it is in reach, else the star that gets closest to it.

    Of what is closer to the stop than the ship is, a neutron star of the segment's capsule in reach comes first, then
    any system in reach, then any a little beyond.  Each step is one aggregate over the cube around the ship, which ``near``
    reads; every step gets closer, so no system of a segment is met twice.  Rows have id64, x, y, z, neutron.
    """
    at, out = start, [start]
    xyz = [F.col(c) for c in _XYZ]
    point = lambda r: (r.x, r.y, r.z)
    for stop in stops:
        segment = S.in_capsule(*xyz, point(at), point(stop), max(3 * ship.boosted, 1500.0))
        for _ in range(SEGMENT_STEPS):
            reach, left = ship.boosted if at.neutron else ship.jump, math.dist(point(at), point(stop))
            if left <= reach:
                if at.id64 != stop.id64:
                    out.append(stop)
                at = stop
                break
            d, t = S.distance(*xyz, *map(F.lit, point(at))), S.distance(*xyz, *map(F.lit, point(stop)))
            rank = F.when(F.col("neutron") & segment & (d <= reach), 1).when(d <= reach, 2).when(d <= reach * FALLBACK, 3)
            ahead = near(point(at), reach * FALLBACK).where(rank.isNotNull() & (d > 0) & (t < left))
            best = ahead.agg(F.min(F.struct(rank.alias("rank"), t.alias("t"), "id64", "x", "y", "z", "neutron")).alias("m")).first().m
            if best is None:
                break
            at = best
            out.append(at)
    return out


def neutron_search(systems: DataFrame, neutrons: DataFrame, start: int, goal: int, ship: Ship, most: int | None = None) -> list[int] | None:
    """Fewest jumps over all systems: a neutron star's jumps are boosted, any other's aren't; None if there is no route."""
    reach = F.when(F.col("neutron"), F.lit(ship.boosted)).otherwise(F.lit(ship.jump))
    return shortest(graph(with_neutrons(systems, neutrons), reach), ship.boosted, {start: 0}, {goal: 0}, most)


def refined(nodes: DataFrame, ship: Ship, greedy: list[Row], long: bool) -> list[int] | None:
    """Fewer jumps than ``greedy`` has by neutron stars, or None.

    The search starts at the first neutron star of the greedy route, as deep as it stands there, and what leads to it stays; a
    long route's also ends at the last one, whose way to the goal stays.  ``nodes`` are the stars and the goal.
    """
    ids, stars = [r.id64 for r in greedy], [k for k, r in enumerate(greedy) if r.neutron]
    first, last = (stars[0], stars[-1]) if stars else (0, len(ids) - 1)
    last = last if long and last > first else len(ids) - 1
    middle = shortest(nodes, ship.boosted, {ids[first]: first}, {ids[last]: len(ids) - 1 - last}, len(ids) - 2)
    return None if middle is None else ids[:first] + middle + ids[last + 1 :]


def neutron_route(systems: DataFrame, neutrons: DataFrame, start: int, goal: int, ship: Ship, engine: str = "astar", near: Near | None = None) -> tuple[list[int], bool]:
    """Greedy by way of the neutron star nearest to each waypoint; any engine but ``greedy`` also looks for fewer jumps.

    Returns the ids and whether the search beat the greedy route.  ``neutrons`` has systemId64; ``near`` gives marked systems
    of a cube (``systems`` themselves, written once, if it is missing).
    """
    place = _place(systems, start, goal)
    if start == goal:
        return [start], False
    a, b = place[start], place[goal]
    neutrons = _checkpointed(neutrons)  # read more than once below
    marked = _checkpointed(with_neutrons(systems, neutrons)) if near is None else None
    near = near or in_cube(marked)
    row = lambda i: near(place[i], 0.0).where(F.col("id64") == i).first()
    width = max(6 * ship.boosted, 3000.0)
    stars = systems.select("id64", "x", "y", "z").join(neutrons.select(F.col("systemId64").alias("id64")), "id64", "left_semi")
    corridor = _checkpointed(capsule(stars, a, b, width))
    found = nearest_in_boxes(waypoints(systems.sparkSession, a, b), corridor).join(corridor, "id64").orderBy("i").collect()
    stops = [Row(id64=r.id64, x=r.x, y=r.y, z=r.z, neutron=True) for k, r in enumerate(found) if not k or r.id64 != found[k - 1].id64]
    end = row(goal)
    greedy = neutron_greedy(near, ship, row(start), [*stops, end])
    if greedy[-1].id64 != goal:
        last = greedy[-1]
        if math.dist((last.x, last.y, last.z), b) > LAST_HOP * (ship.boosted if last.neutron else ship.jump):
            raise RouteError("only part of the route was found")
        greedy.append(end)
    ids = [r.id64 for r in greedy]
    if engine != "greedy":
        others = systems.where(F.col("id64").isin([r.id64 for r in (greedy[0], end) if not r.neutron])).select("id64", "x", "y", "z", F.lit(ship.jump).alias("reach"))
        nodes = graph(corridor.select("*", F.lit(ship.boosted).alias("reach")).union(others).dropDuplicates(["id64"]), F.col("reach"))
        best = refined(nodes, ship, greedy, math.dist(a, b) > LONG)
        if best is not None:
            return best, True
    return ids, False


# ------------------------------------------------------------------ rendering
def _placed(systems: DataFrame, route: list[int]) -> DataFrame:
    hops = systems.sparkSession.createDataFrame(list(enumerate(route)), "step int, id64 bigint")
    return systems.join(hops, "id64")


def render(systems: DataFrame, route: list[int], neutrons: DataFrame | None = None) -> DataFrame:
    """step, id64 (text), name, distances from the previous, to the next, along the path and straight from the start."""
    by = Window.partitionBy("route").orderBy("step")
    rows = _placed(systems, route).withColumn("route", F.lit(0))
    here, first = [F.col(c) for c in "xyz"], [F.first(c).over(by) for c in "xyz"]
    back = S.distance(*[F.lag(c).over(by) for c in "xyz"], *here)
    ahead = S.distance(*here, *[F.lead(c).over(by) for c in "xyz"])
    rows = rows.withColumns({"_back": F.coalesce(back, F.lit(0.0)), "_ahead": F.coalesce(ahead, F.lit(0.0)), "straight_from_start": S.round_to(S.distance(*first, *here), 2), "last": F.lead("step").over(by).isNull()})
    rows = rows.withColumn("distance_from_start", S.round_to(F.sum("_back").over(by), 2))
    boost = F.lit(False)
    if neutrons is not None:
        rows = rows.join(neutrons.select(F.col("systemId64").alias("id64"), F.lit(True).alias("_n")), "id64", "left")
        boost = F.coalesce("_n", F.lit(False)) & ~F.col("last")
    return rows.select("step", F.col("id64").cast("string").alias("id64"), "name", S.round_to(F.col("_back"), 2).alias("distance_from_prev"), S.round_to(F.col("_ahead"), 2).alias("jump_distance"), "distance_from_start", "straight_from_start", boost.alias("used_neutron_boost"))
