"""Look-ups and spatial searches."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import scalars as S

from . import cube_filter

CUBE_ROWS, MAX_CUBE, STATION_STEPS = 5000, 500.0, (100.0, 500.0, 1500.0, 4000.0, 8000.0, 15000.0, 30000.0, 70000.0)
CARRIER = "Drake-Class Carrier"


@dataclass(frozen=True)
class CubeQuery:
    """A cube around a named system (if it is found) or a point."""

    x: float = 0.0
    y: float = 0.0
    z: float = 0.0
    size: float | None = None
    reference: str | None = None
    body_type: str | None = None
    custom_filter: str | None = None


@dataclass(frozen=True)
class StationQuery:
    """Stations near a named system.  Any government asked for means prisons."""

    reference: str
    allegiance: str | None = None
    economy: str | None = None
    government: str | None = None
    station_type: str | None = None
    pad: str | None = None
    max_distance: float | None = None
    include_carriers: bool = False
    include_surface: bool = False
    radius: float | None = None
    limit: int = 25


def find_system(systems: DataFrame, name_or_id: str) -> DataFrame:
    """By id if the text is an integer, else by name without regard to ASCII case; the least id of equal names."""
    text = str(name_or_id)
    digits = text[1:] if text[:1] in "+-" else text
    if digits.isascii() and digits.isdigit():
        return systems.where(F.col("id64") == int(text)).limit(1)
    return systems.where(S.fold_case(F.col("name")) == S.fold_case(F.lit(text))).orderBy("id64").limit(1)


def coordinates(systems: DataFrame, name_or_id: str) -> tuple[float, float, float] | None:
    row = find_system(systems, name_or_id).select("x", "y", "z").first()
    return None if row is None or row.x is None else (row.x, row.y, row.z)


def pair_distance(systems: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the distance of two systems, or none if one is unknown."""
    left = find_system(systems, a).select(F.col("name").alias("from_system"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    right = find_system(systems, b).select(F.col("name").alias("to_system"), "x", "y", "z")
    d = S.distance(*map(F.col, ("ax", "ay", "az", "x", "y", "z")))
    return left.join(right, F.lit(True)).select("from_system", "to_system", S.round_to(d, 2).alias("distance"))  # one row each


def _requirements(bodies: DataFrame, wanted: cube_filter.Filter) -> DataFrame:
    """Systems that have a body for every requirement: one pass instead of one semi-join each."""
    has = [F.bool_or(F.coalesce(wanted.need(*n), F.lit(False))).alias(f"has{i}") for i, n in enumerate(wanted.needed)]
    return bodies.groupBy("systemId64").agg(*has).where(" AND ".join(f"has{i}" for i in range(len(has)))).select("systemId64")


def cube_search(systems: DataFrame, bodies: DataFrame, query: CubeQuery) -> DataFrame:
    """Bodies (or systems, without a filter that says anything) in a cube, nearest first.

    The limit comes after the order, so the result is the same in every run.
    """
    half = min(query.size or 20.0, MAX_CUBE) / 2
    centre = (query.reference and coordinates(systems, query.reference)) or (query.x, query.y, query.z)
    box = systems.where(S.in_box(F.col("x"), F.col("y"), F.col("z"), centre, half))
    light_years = S.round_to(S.distance(F.col("x"), F.col("y"), F.col("z"), *map(F.lit, centre)), 2).alias("systemDistLy")
    common = [F.col("id64").cast("string").alias("systemId64"), F.col("name").alias("system"), light_years, S.yes_no(F.col("population")).alias("inhabited"), "x", "y", "z"]
    wanted = cube_filter.parse(query.custom_filter or query.body_type)
    if not wanted.any:
        rows = box.where(F.col("name").isNotNull() & F.col("population").isNotNull())
        found = rows.select(*common, F.col("id64").cast("string").alias("uniqueId"), F.lit("-").alias("body"), F.lit(0.0).alias("arrivalDistLs"), F.col("id64").alias("_i"), F.lit(0).alias("_b"))
    else:
        here = box.select("id64", "name", "population", "x", "y", "z")
        if wanted.needed:
            ours = bodies.join(here.select(F.col("id64").alias("systemId64")), "systemId64", "left_semi")
            here = here.join(_requirements(ours, wanted), here["id64"] == F.col("systemId64"), "left_semi")
        body = bodies.where(wanted.bodies() & F.col("name").isNotNull() & F.col("subType").isNotNull() & F.col("distanceToArrival").isNotNull())
        body = body.select(F.col("systemId64").alias("_s"), "bodyId", F.col("name").alias("fullBodyName"), F.col("subType").alias("type"), "distanceToArrival")
        rows = body.join(here, F.col("_s") == F.col("id64"))
        found = rows.select(*common, F.concat_ws("-", "id64", "bodyId").alias("uniqueId"), S.short_body_name(F.col("fullBodyName"), F.col("name")).alias("body"), F.col("distanceToArrival").alias("arrivalDistLs"), "fullBodyName", "type", F.col("id64").alias("_i"), F.col("bodyId").alias("_b"))
    return found.orderBy("systemDistLy", "_i", "_b").limit(CUBE_ROWS).drop("_i", "_b")


def system_rows(table: DataFrame, system_id: int) -> DataFrame:
    """Bodies or stations of a system, nearest to its star first, unknown distances before all."""
    return table.where(F.col("systemId64") == system_id).orderBy(F.col("distanceToArrival").asc_nulls_first())


def render_bodies(bodies: DataFrame) -> DataFrame:
    """Flags as booleans, the default terraforming text, JSON texts as values."""
    out = {"isLandable": F.col("isLandable") == 1, "terraformingState": F.coalesce("terraformingState", F.lit("Not terraformable"))}
    for c in ("rings", "signals", "materials", "parents", "belts"):
        if c in bodies.columns:
            out[c] = F.try_parse_json(c)
    return bodies.withColumns(out)


def _given(text: str | None) -> str | None:
    return text if text and text.lower() != "any" else None


def _conditions(q: StationQuery, columns: list[str]) -> Column:
    cond = F.lit(True)
    same = lambda c, v: S.fold_case(F.col(c)) == S.fold_case(F.lit(v))
    if not q.include_carriers:
        cond = cond & (F.col("type") != CARRIER)  # an unknown type is left out, too
    if not q.include_surface:
        cond = cond & F.col("latitude").isNull()
    if v := _given(q.allegiance):
        cond = cond & same("allegiance", v)
    if v := _given(q.economy):
        cond = cond & (same("economy", v) | (same("systemEconomy", v) if "systemEconomy" in columns else F.lit(False)))
    if v := _given(q.station_type):
        cond = cond & same("type", v)
    if q.max_distance is not None:
        cond = cond & (F.col("distanceToArrival").isNull() | (F.col("distanceToArrival") <= q.max_distance))
    if (q.pad or "").lower() in ("large", "medium"):
        need = S.large_or_medium_pads(F.col("landingPads"), "large") > 0
        if q.pad.lower() == "medium":
            need = need | (S.large_or_medium_pads(F.col("landingPads"), "medium") > 0)
        cond = cond & need
    if _given(q.government):
        prison = [F.lower(c).contains("rison") for c in ("government", "systemGovernment") if c in columns]
        cond = cond & (prison[0] if len(prison) == 1 else prison[0] | prison[1])
    return cond


def nearest_stations(systems: DataFrame, stations: DataFrame, q: StationQuery, prisons: DataFrame | None = None) -> DataFrame:
    """Stations in the smallest box of the ladder that holds any (or in the given one), nearest first.

    The ladder takes one pass: each candidate's own step is known from its box distance, so the nearest of the
    least step are the first in the order of step and distance, and no radius is tried twice.  Prisons, which are those
    of a station's or its system's government, have no radius.
    """
    return _searched(systems, stations, q, prisons).drop("radius")


def _searched(systems: DataFrame, stations: DataFrame, q: StationQuery, prisons: DataFrame | None) -> DataFrame:
    """The stations that are found, with the radius at which each search step would meet them."""
    at = coordinates(systems, q.reference)
    if at is None:
        raise LookupError(f"unknown system: {q.reference}")
    own = {"primaryEconomy": "systemEconomy", "government": "systemGovernment"}
    place = systems.select(F.col("id64").alias("systemId64"), F.col("name").alias("systemName"), "x", "y", "z", *[F.col(c).alias(k) for c, k in own.items() if c in systems.columns])
    prison = _given(q.government) is not None
    if prison and prisons is not None:
        place = place.join(prisons, "systemId64", "left_semi")
    reach = F.greatest(*[F.abs(F.col(c) - F.lit(m)) for c, m in zip("xyz", at, strict=True)])
    if not prison:
        most = min(max(q.radius, 1.0), STATION_STEPS[-1]) if q.radius is not None else STATION_STEPS[-1]
        place = place.where(S.in_box(F.col("x"), F.col("y"), F.col("z"), at, most))
    rows = stations.join(place, "systemId64")
    rows = rows.where(_conditions(q, rows.columns)).withColumn("systemDistanceLy", S.round_to(S.distance(F.col("x"), F.col("y"), F.col("z"), *map(F.lit, at)), 2))
    ladder = not prison and q.radius is None
    rows = rows.withColumn("radius", F.coalesce(*[F.when(reach <= r, F.lit(r)) for r in STATION_STEPS]) if ladder else F.lit(0.0 if prison else most))
    found = rows.orderBy("radius", "systemDistanceLy", "systemId64", "id").limit(min(max(q.limit, 1), 100))
    if ladder:  # of at most 100 rows
        found = found.withColumn("_least", F.min("radius").over(Window.partitionBy(F.lit(0)))).where("radius = _least").drop("_least")
    return found.orderBy("systemDistanceLy", "systemId64", "id")


def station_report(systems: DataFrame, stations: DataFrame, q: StationQuery, prisons: DataFrame | None = None) -> DataFrame:
    """One row about a search: the system it starts from, its place, the radius that was searched, and the stations (at most 100).

    Without a find the radius is the last of the ladder; a search for prisons, which has none, reports how far the last of its
    stations is.
    """
    rows = _searched(systems, stations, q, prisons)
    farthest = STATION_STEPS[-1] if q.radius is None else min(max(q.radius, 1.0), STATION_STEPS[-1])
    prison = _given(q.government) is not None
    radius = F.coalesce(F.max("systemDistanceLy" if prison else "radius"), F.lit(0.0 if prison else farthest))
    one = F.sort_array(F.collect_list(F.struct("systemDistanceLy", "systemId64", "id", "systemName", "type")))
    found = rows.agg(radius.alias("searchedRadiusLy"), F.count(F.lit(1)).alias("count"), one.alias("results"))
    here = find_system(systems, q.reference).select(F.col("name").alias("refSystem"), F.struct("x", "y", "z").alias("refCoords"))
    return here.join(F.broadcast(found), F.lit(True))  # one row each


def _visits(points: DataFrame, radius: float) -> DataFrame:
    """a, ax, ay, az, home and cell: points once for each cell that they visit, which are their own and, of the 26 around it, those
    of the half that comes after it that are within ``radius`` of the point.  A cell's place is one number, which far cells may share."""
    side, after = F.lit(float(radius)), [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    cell = {c: F.floor(F.col(c) / side) for c in "xyz"}

    def code(o: tuple[int, int, int]) -> Column:
        x, y, z = (F.pmod(cell[c] + F.lit(k), F.lit(1 << 20)) for c, k in zip("xyz", o, strict=True))
        return x * F.lit(1 << 40) + y * F.lit(1 << 20) + z

    def away(c: str, k: int) -> Column:
        """How far a point is from the next cell on an axis, less what rounding may take."""
        gap = (cell[c] + 1) * side - F.col(c) if k > 0 else F.col(c) - cell[c] * side
        return F.greatest(F.lit(0.0), gap - F.lit(1e-9) * (side + F.abs(F.col(c))))

    def met(o: tuple[int, int, int]) -> Column:
        far = [away(c, k) * away(c, k) for c, k in zip("xyz", o, strict=True) if k]
        return F.when(sum(far[1:], far[0]) <= F.lit(radius * radius), code(o)) if far else code(o)

    visited = F.filter(F.array(*[met(o) for o in after]), lambda k: k.isNotNull())
    here = points.where("x is not null and y is not null and z is not null")
    return here.select(F.col("id64").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), code((0, 0, 0)).alias("home"), F.explode(visited).alias("cell"))


def pairs_within(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b, d) of different points within ``radius``, both ways round: an equi-join of grid cells, then the exact test.

    Two points meet once, where one of them visits the other's own cell, and give both rows.  Cells are dealt over all tasks, and a
    task holds one cell's points at a time.  The rows themselves grow with the density.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    visits, own = _visits(points, radius), F.col("home") == F.col("cell")
    a = visits.select("a", "ax", "ay", "az", own.alias("own"), "cell")
    b = visits.where(own).select(F.col("a").alias("b"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("az").alias("bz"), "cell")
    d2 = S.distance_squared(*map(F.col, ("ax", "ay", "az", "bx", "by", "bz")))
    once = (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b")))
    near = a.repartition(n, "cell").join(b.repartition(n, "cell").hint("merge"), "cell").where(once & (d2 <= F.lit(radius * radius)))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return near.select(F.explode(both).alias("p"), F.sqrt(d2).alias("d")).select("p.a", "p.b", "d")


def grid_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b, d) of points within ``radius``: an equi-join of grid cells, then the exact test.

    The left side visits the 27 cells around its own, so each pair meets once; cells spread over
    tasks by hash, and adaptive execution splits crowded ones.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius)))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = left.select(F.col("id64").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    for axis, c in zip(("cx", "cy", "cz"), ("ax", "ay", "az"), strict=True):
        a = a.withColumn(axis, cell(c)).withColumn("_o", F.explode(around)).withColumn(axis, F.col(axis) + F.col("_o")).drop("_o")
    b = right.select(F.col("id64").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    d2 = S.distance_squared(*map(F.col, ("ax", "ay", "az", "bx", "by", "bz")))
    near = a.join(b, ["cx", "cy", "cz"]).where((F.col("a") != F.col("b")) & (d2 <= F.lit(radius * radius)))
    return near.select("a", "b", F.sqrt(d2).alias("d"))


def nearest_in_boxes(points: DataFrame, targets: DataFrame, steps: tuple[float, ...] = (300.0, 800.0, 1500.0, 3000.0)) -> DataFrame:
    """For each point the nearest target within the first box that holds any, by an equi-join of grid cells."""
    size, around = F.lit(float(steps[-1])), F.array(*[F.lit(k) for k in (-1, 0, 1)])
    p = points.select("i", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    for axis, c in zip(("cx", "cy", "cz"), ("px", "py", "pz"), strict=True):
        p = p.withColumn("_o", F.explode(around)).withColumn(axis, F.floor(F.col(c) / size) + F.col("_o")).drop("_o")
    t = targets.select("id64", "x", "y", "z", *[F.floor(F.col(c) / size).alias(axis) for axis, c in zip(("cx", "cy", "cz"), "xyz", strict=True)])
    reach = F.greatest(F.abs(F.col("x") - F.col("px")), F.abs(F.col("y") - F.col("py")), F.abs(F.col("z") - F.col("pz")))
    pairs = t.join(p, ["cx", "cy", "cz"]).withColumn("step", F.coalesce(*[F.when(reach <= s, F.lit(s)) for s in steps])).where("step is not null")
    d2 = S.distance_squared(*map(F.col, ("x", "y", "z", "px", "py", "pz")))
    best = pairs.groupBy("i").agg(F.min(F.struct("step", d2.alias("d2"), F.col("id64").alias("id"))).alias("m"))
    return best.select("i", F.col("m.id").alias("id64"), F.sqrt("m.d2").alias("d"))
