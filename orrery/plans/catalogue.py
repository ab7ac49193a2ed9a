"""The registered queries of the catalogue engine and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import cube_filter, heatmap, merge, routing, search, translate
from orrery.sources import feeds, fixtures, layout, patches
from orrery.sources.shared import shared_path
from orrery.streaming import live, runs, stats

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE_SQL: dict[str, str] = {}
_WITH = f"WITH RECURSIVE systems AS ({fixtures.SYSTEMS}), stations AS ({fixtures.STATIONS}), patches AS ({fixtures.BODY_PATCHES}), bodies AS ({fixtures.BODIES})\n"


def query(sql: str | None = None, head: str = _WITH) -> Callable[[Q], Q]:
    def add(fn: Q) -> Q:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = head + sql
        return fn

    return add


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold(fixtures.body_patches(spark, sf_dir), ["systemId64", "bodyId"], merge.BODY_RULES)


def neutron_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.neutron_systems(fixtures.body_patches(spark, sf_dir))
    return fixtures.systems(spark, sf_dir).join(found.withColumnRenamed("systemId64", "id64"), "id64", "left_semi")


_D2 = "round(sqrt((x-{0})*(x-{0})+(y-{1})*(y-{1})+(z-{2})*(z-{2}))*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE)"
_AT0 = _D2.format("CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)")
_BOX = "abs(x) <= {0} AND abs(y) <= {0} AND abs(z) <= {0}"
_YES = "CASE WHEN population > 0 THEN 'Yes' ELSE 'No' END AS inhabited"


# ------------------------------------------------------------------ cube search
@query(f"SELECT CAST(id64 AS VARCHAR) AS systemId64, name AS system, {_AT0} AS systemDistLy, {_YES}, x, y, z, CAST(id64 AS VARCHAR) AS uniqueId, '-' AS body, CAST(0 AS DOUBLE) AS arrivalDistLs FROM systems WHERE {_BOX.format(100)} AND population IS NOT NULL ORDER BY systemDistLy, id64 LIMIT 5000")
def cube_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cube_search(fixtures.systems(spark, sf_dir), bodies(spark, sf_dir), search.CubeQuery(size=200))


def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = shared_path(spark, "points")
    layout.write_points(fixtures.systems(spark, sf_dir), path)
    return path


@query(ORACLE_SQL["cube_all"], head="")
def cube_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cube from systems that are stored in Z-order."""
    here = layout.read_box(spark, _stored(spark, sf_dir), (0.0, 0.0, 0.0), 100.0)
    return search.cube_search(here, bodies(spark, sf_dir), search.CubeQuery(size=200))


def _cube(cond: str, needed: tuple[str, ...] = ()) -> str:
    exists = "".join(f" AND EXISTS (SELECT 1 FROM bodies b2 WHERE b2.systemId64 = s.id64 AND b2.subType = '{n}')" for n in needed)
    return f"""SELECT CAST(id64 AS VARCHAR) AS systemId64, s.name AS system, {_AT0} AS systemDistLy, {_YES}, x, y, z,
 concat(id64, '-', bodyId) AS uniqueId, CASE WHEN trim(replace(b.name, s.name, '')) = '' THEN 'A' ELSE trim(replace(b.name, s.name, '')) END AS body,
 distanceToArrival AS arrivalDistLs, b.name AS fullBodyName, subType AS type
FROM systems s JOIN bodies b ON b.systemId64 = s.id64 WHERE {_BOX.format(50)} AND {cond}{exists} ORDER BY systemDistLy, id64, bodyId LIMIT 5000"""


def _filtered(name: str, text: str, cond: str, needed: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.cube_search(fixtures.systems(spark, sf_dir), bodies(spark, sf_dir), search.CubeQuery(size=100, custom_filter=text))

    run.__name__ = name
    query(_cube(cond, needed))(run)


_filtered("cube_earthlike", "Earth-like", "subType = 'Earth-like world'", ("Earth-like world",))
_filtered("cube_two_types", "earth-like and water world", "subType IN ('Earth-like world', 'Water world')", ("Earth-like world", "Water world"))
_filtered("cube_terraformable", "terraformable landable", "terraformingState IN ('Terraformable', 'Terraforming completed') AND isLandable = 1")
_filtered("cube_rings", "icy ring", "rings ILIKE '%\"Icy%'")
_filtered("cube_signals", "bio", "signals ILIKE '%Biological%'")
_filtered("cube_white_dwarfs", "white dwarf", "subType ILIKE 'White Dwarf%'")


#: Every phrase of the grammar, and every body type that it knows of with one that it doesn't.
_PHRASES = (
    [*cube_filter.PLANETS, *cube_filter.STARS, "white dwarf", "wolf-rayet", *(f"white dwarf {c}" for c in cube_filter.WHITE_DWARFS), *(f"wolf-rayet {c}" for c in cube_filter.WOLF_RAYETS)]
    + ["terraformable", "bio", "geological", "landable", "ring", *cube_filter.RINGS]
)
_TYPES = sorted({*cube_filter.PLANETS.values(), *(n for names in cube_filter.STARS.values() for n in names), *(f"White Dwarf ({c.upper()}) Star" for c in cube_filter.WHITE_DWARFS), *(f"Wolf-Rayet {c.upper()} Star" for c in cube_filter.WOLF_RAYETS), "White Dwarf Remnant", "Asteroid"})
_SHOWN = """SELECT o_orderkey AS id, o_custkey AS systemId64, CAST(o_orderkey % 2 AS INTEGER) AS isLandable, CASE o_orderkey % 4 WHEN 0 THEN 'Terraformable' WHEN 1 THEN 'Terraforming completed' WHEN 2 THEN 'Not terraformable' END AS terraformingState,
 CASE o_orderkey % 3 WHEN 0 THEN '[{"type":"biological"}]' WHEN 1 THEN '[{"type":"Geological"},{"type":"Biological"}]' END AS signals,
 CASE o_orderkey % 7 WHEN 0 THEN '[{"type":"Icy"}]' WHEN 1 THEN '[{"type":"Metallic"}]' WHEN 2 THEN '[{"type":"Metal Rich"}]' WHEN 3 THEN '[{"type":"rocky"}]' WHEN 4 THEN '[]' WHEN 5 THEN '[{"type":"Rocky"},{"type":"Icy"}]' END AS rings FROM orders"""


@query(f"""WITH b AS (SELECT *, (ARRAY[{", ".join(f"'{t}'" for t in _TYPES)}])[1 + id % {len(_TYPES)}] AS t FROM ({_SHOWN})), p AS (SELECT unnest(ARRAY[{", ".join(f"'{x}'" for x in _PHRASES)}]) AS phrase),
m AS (SELECT phrase, systemId64 AS s, coalesce(CASE
 WHEN phrase IN ('earth-like', 'high metal content') THEN lower(t) = phrase || ' world'
 WHEN phrase LIKE '%-based life giant' THEN t = 'Gas giant with ' || split_part(phrase, ' ', 1) || ' life'
 WHEN phrase IN ('white dwarf', 'wolf-rayet') THEN starts_with(lower(t), phrase)
 WHEN phrase LIKE 'white dwarf %' THEN lower(t) = 'white dwarf (' || substr(phrase, 13) || ') star'
 WHEN phrase LIKE 'wolf-rayet %' THEN lower(t) = phrase || ' star'
 WHEN phrase IN ('t tauri', 'herbig') THEN starts_with(lower(t), phrase)
 WHEN phrase = 'ms star type' THEN t IN ('MS-type Star', 'S-type Star')
 WHEN phrase = 's star type' THEN t = 'S-type Star'
 WHEN phrase LIKE '% star type' THEN lower(t) = split_part(phrase, ' ', 1) || ' star'
 WHEN phrase LIKE '_ star' OR phrase LIKE '_ dwarf' THEN starts_with(lower(t), left(phrase, 1) || ' (')
 WHEN phrase = 'terraformable' THEN terraformingState LIKE 'Terraform%' WHEN phrase = 'bio' THEN signals ILIKE '%biological%' WHEN phrase = 'geological' THEN signals ILIKE '%geological%' WHEN phrase = 'landable' THEN isLandable = 1
 WHEN phrase = 'ring' THEN rings <> '[]' WHEN phrase LIKE '% ring' THEN rings ILIKE '%"' || left(phrase, length(phrase) - 5) || '%'
 ELSE lower(t) = phrase END, false) AS ok FROM b, p)
SELECT phrase, count(*) FILTER (WHERE ok) AS n, count(DISTINCT CASE WHEN ok THEN s END) AS systems FROM m GROUP BY phrase""", head="")
def cube_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each phrase of the filter grammar finds, all in one pass over the bodies."""
    rows = fixtures._view(spark, sf_dir, _SHOWN).withColumn("subType", F.get(F.array(*map(F.lit, _TYPES)), (F.col("id") % len(_TYPES)).cast("int")))
    found = F.array_compact(F.array(*[F.when(cube_filter.parse(p).bodies(), F.lit(p)) for p in _PHRASES]))
    return rows.select("systemId64", F.explode(found).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("systemId64").alias("systems"))


# ------------------------------------------------------------------ look-ups
@query("SELECT id64, name, x, y, z, population, allegiance, government FROM systems WHERE name = 'Customer#000000007'")
def system_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_system(fixtures.systems(spark, sf_dir), "CUSTOMER#000000007")


@query("SELECT bodyId, name, subType, CAST(isLandable AS INTEGER) = 1 AS isLandable, coalesce(terraformingState, 'Not terraformable') AS terraformingState, distanceToArrival FROM bodies WHERE systemId64 = 7")
def system_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.render_bodies(search.system_rows(bodies(spark, sf_dir), 7)).select("bodyId", "name", "subType", "isLandable", "terraformingState", "distanceToArrival")


@query("SELECT bodyId, json_extract_string(rings, '$[0].type') AS ring, json_extract_string(signals, '$[0].type') AS signal, rings IS NOT NULL AS known FROM bodies WHERE systemId64 IN (7, 8, 10)")
def system_bodies_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON texts as values that can be looked into."""
    rows = search.render_bodies(bodies(spark, sf_dir).where("systemId64 in (7, 8, 10)"))
    return rows.select("bodyId", F.try_variant_get("rings", "$[0].type", "string").alias("ring"), F.try_variant_get("signals", "$[0].type", "string").alias("signal"), F.col("rings").isNotNull().alias("known"))


@query("SELECT id, systemId64, type, allegiance, government, economy, latitude, landingPads, distanceToArrival FROM stations WHERE systemId64 = 7")
def system_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.system_rows(fixtures.stations(spark, sf_dir), 7)


@query("SELECT a.name AS from_system, b.name AS to_system, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS distance FROM systems a, systems b WHERE a.id64 = 3 AND b.id64 = 11")
def distance_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pair_distance(fixtures.systems(spark, sf_dir), "3", "customer#000000011")


@query("SELECT id64, round(((x-1)*CAST(100 AS DOUBLE)+(y-2)*CAST(50 AS DOUBLE)+(z-3)*CAST(-25 AS DOUBLE))/CAST(13125 AS DOUBLE)*CAST(100 AS DOUBLE)*CAST(10000 AS DOUBLE))/CAST(10000 AS DOUBLE) AS percent FROM systems")
def line_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.systems(spark, sf_dir).select("id64", S.line_progress(F.col("x"), F.col("y"), F.col("z"), (1, 2, 3), (101, 52, -22)).alias("percent"))


# ------------------------------------------------------------------ stations
def _nearest(cond: str, radius: str = "", plain: str = "type <> 'Drake-Class Carrier' AND latitude IS NULL") -> str:
    step = "CASE " + " ".join(f"WHEN greatest(abs(x-rx), abs(y-ry), abs(z-rz)) <= {r} THEN {r}" for r in (100, 500, 1500, 4000, 8000, 15000, 30000, 70000)) + " END"
    last = f"WHERE {radius}" if radius else "WHERE step <= (SELECT min(step) FROM c)"
    return f""", r AS (SELECT x AS rx, y AS ry, z AS rz FROM systems WHERE id64 = 7),
c AS (SELECT t.*, s.name AS systemName, {_D2.format("rx", "ry", "rz")} AS systemDistanceLy, {step} AS step FROM stations t JOIN systems s ON s.id64 = t.systemId64 CROSS JOIN r WHERE {plain} AND {cond})
SELECT id, systemId64, systemName, type, systemDistanceLy FROM c {last} ORDER BY systemDistanceLy, systemId64, id LIMIT 25"""


def _near(name: str, cond: str, within: str = "", plain: str = "type <> 'Drake-Class Carrier' AND latitude IS NULL", **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stations, systems = fixtures.stations(spark, sf_dir), fixtures.systems(spark, sf_dir)
        found = search.nearest_stations(systems, stations, search.StationQuery("7", **options), merge.prison_systems(stations, systems) if options.get("government") else None)
        return found.select("id", "systemId64", "systemName", "type", "systemDistanceLy")

    run.__name__ = name
    query((_WITH.rstrip() + _nearest(cond, within, plain)), head="")(run)


_PADS = "coalesce(TRY_CAST(json_extract_string(landingPads, '$.large') AS DOUBLE), TRY_CAST(json_extract_string(landingPads, '$.Large') AS DOUBLE), 0) > 0"
_near("nearest_station_default", "true")
_near("nearest_station_economy", "lower(economy) = 'high tech'", economy="high tech")
_near("nearest_station_large_pad", _PADS, pad="large")
_PRISON = "(lower(t.government) LIKE '%rison%' OR lower(s.government) LIKE '%rison%')"
_near("nearest_station_prison", _PRISON, within="true", government="Democracy")
_near("nearest_station_allegiance", "lower(t.allegiance) = 'empire'", allegiance="Empire")
_near("nearest_station_type", "lower(type) = '1-urgent'", station_type="1-urgent")
_near("nearest_station_max_distance", "(t.distanceToArrival IS NULL OR t.distanceToArrival <= 50000)", max_distance=50000.0)
_near("nearest_station_carriers", "lower(type) = 'drake-class carrier'", plain="latitude IS NULL", include_carriers=True, station_type="DRAKE-CLASS CARRIER")
_near("nearest_station_surface", "lower(t.economy) = 'refinery'", plain="type <> 'Drake-Class Carrier'", include_surface=True, economy="refinery")
_near("nearest_station_medium_pad", f"({_PADS} OR coalesce(TRY_CAST(json_extract_string(landingPads, '$.medium') AS DOUBLE), TRY_CAST(json_extract_string(landingPads, '$.Medium') AS DOUBLE), 0) > 0)", pad="medium")
_near("nearest_station_radius", "greatest(abs(x-rx), abs(y-ry), abs(z-rz)) <= 25", within="true", radius=25.0)


@query((_WITH.rstrip() + _nearest("lower(t.allegiance) = 'federation'")).replace("SELECT id, systemId64", ", top AS (SELECT id, step, systemId64", 1) + """)
SELECT (SELECT name FROM systems WHERE id64 = 7) AS "refSystem", coalesce(max(step), 70000) + CAST(0 AS DOUBLE) AS "searchedRadiusLy", count(*) AS "count", string_agg(id, ',' ORDER BY systemDistanceLy, systemId64, id) AS ids FROM top""", head="")
def nearest_station_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search reports beside its stations."""
    found = search.station_report(fixtures.systems(spark, sf_dir), fixtures.stations(spark, sf_dir), search.StationQuery("7", allegiance="FEDERATION"))
    return found.select("refSystem", "searchedRadiusLy", "count", F.array_join(F.col("results.id").cast("array<string>"), ",").alias("ids"))


# ------------------------------------------------------------------ merges
@query("SELECT systemId64, bodyId, name, subType, rings, signals, terraformingState, CAST(isLandable AS INTEGER) AS isLandable, distanceToArrival FROM bodies")
def merge_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bodies(spark, sf_dir)


_SYSTEM_PATCHES = "SELECT o_custkey AS id64, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS allegiance, CAST(o_orderkey % 5 AS BIGINT) - 1 AS population, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS security, o_orderkey AS seq FROM orders"
_STATION_PATCHES = "SELECT o_custkey AS systemId64, CAST(o_orderkey % 3 AS BIGINT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS type, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS haveMarket, CASE WHEN o_orderkey % 4 = 0 THEN concat('[\"', o_orderpriority, '\"]') ELSE '[]' END AS otherServices, o_orderkey AS seq FROM orders"


@query(f"SELECT id64, max_by(allegiance, seq) FILTER (WHERE allegiance IS NOT NULL) AS allegiance, coalesce(max_by(population, seq) FILTER (WHERE population > 0), 0) AS population, max_by(security, seq) FILTER (WHERE security IS NOT NULL) AS security FROM ({_SYSTEM_PATCHES}) p GROUP BY id64", head="")
def merge_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold(fixtures._view(spark, sf_dir, _SYSTEM_PATCHES), ["id64"], merge.SYSTEM_RULES)


@query(f"SELECT systemId64, id, max_by(type, seq) FILTER (WHERE type IS NOT NULL) AS type, max(haveMarket) AS haveMarket, coalesce(max_by(otherServices, seq) FILTER (WHERE otherServices <> '[]'), '[]') AS otherServices FROM ({_STATION_PATCHES}) p GROUP BY systemId64, id", head="")
def merge_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold(fixtures._view(spark, sf_dir, _STATION_PATCHES), ["systemId64", "id"], merge.STATION_RULES)


@query(f"SELECT id64, max_by(allegiance, seq) FILTER (WHERE allegiance IS NOT NULL) AS allegiance, coalesce(max_by(population, seq) FILTER (WHERE population > 0), 0) AS population, max_by(security, seq) FILTER (WHERE security IS NOT NULL) AS security FROM ({_SYSTEM_PATCHES}) p GROUP BY id64", head="")
def stream_merge_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patches through a stream, a third of them in each micro-batch, in order of their arrival."""
    root = shared_path(spark, "stream")
    patches = fixtures._view(spark, sf_dir, _SYSTEM_PATCHES)
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).first()[0] or 0
    table = runs.RunTable(spark, f"{root}/state", ["id64"], merge.SYSTEM_RULES, fan=2)
    for k in range(3):
        patches.where((F.col("seq") * 3 > k * last) & (F.col("seq") * 3 <= (k + 1) * last)).write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(patches.schema).parquet(f"{root}/in")
        live.merge_stream(source, table, f"{root}/checkpoint", {"availableNow": True}).awaitTermination()
    return table.read()


@query("SELECT DISTINCT systemId64 FROM patches WHERE subType = 'Neutron Star'")
def neutron_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.neutron_systems(fixtures.body_patches(spark, sf_dir))


@query("SELECT 'empty' AS before, systemId64 FROM (SELECT DISTINCT systemId64 FROM patches WHERE subType = 'Neutron Star') UNION ALL SELECT 'filled', id64 FROM systems WHERE id64 % 7 = 0")
def backfill_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table is filled from its source only where it is empty."""
    stars = merge.neutron_systems(fixtures.body_patches(spark, sf_dir))
    some = fixtures.systems(spark, sf_dir).where("id64 % 7 = 0").select(F.col("id64").alias("systemId64"))
    before = lambda name, df: df.select(F.lit(name).alias("before"), "systemId64")
    return before("empty", merge.backfilled(some.where("systemId64 < 0"), stars)).union(before("filled", merge.backfilled(some, stars)))


@query("SELECT systemId64 FROM stations WHERE lower(government) LIKE '%rison%' UNION SELECT id64 FROM systems WHERE lower(government) LIKE '%rison%'")
def prison_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.prison_systems(fixtures.stations(spark, sf_dir), fixtures.systems(spark, sf_dir))


# ------------------------------------------------------------------ distance joins and routes
_NEAR = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


@query(f"SELECT a.id64 AS a, b.id64 AS b, sqrt({_NEAR}) AS d FROM systems a JOIN systems b ON a.id64 <> b.id64 AND {_NEAR} <= CAST(14.99 AS DOUBLE)*CAST(14.99 AS DOUBLE)")
def neighbours_within_r(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pairs_within(fixtures.systems(spark, sf_dir), 14.99)


@query(""", n AS (SELECT * FROM systems WHERE id64 IN (SELECT systemId64 FROM patches WHERE subType = 'Neutron Star')),
w AS (SELECT i, -100 + 40.0*i AS wx, -20 + 4.0*i AS wy, 100 - 40.0*i AS wz FROM range(1, 5) t(i)),
c AS (SELECT i, id64, sqrt((x-wx)*(x-wx)+(y-wy)*(y-wy)+(z-wz)*(z-wz)) AS d FROM n, w WHERE greatest(abs(x-wx), abs(y-wy), abs(z-wz)) <= 300)
SELECT CAST(i AS INTEGER) AS i, arg_min(id64, (d, id64)) AS id64, min(d) AS d FROM c GROUP BY i""".replace("40.0*i", "CAST(40 AS DOUBLE)*i").replace("4.0*i", "CAST(4 AS DOUBLE)*i"), head=_WITH.rstrip())
def nearest_neutron_to_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.createDataFrame([(i, -100 + 40.0 * i, -20 + 4.0 * i, 100 - 40.0 * i) for i in range(1, 5)], "i int, x double, y double, z double")
    return search.nearest_in_boxes(points, neutron_nodes(spark, sf_dir))


_T = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ((x+100)*CAST(200 AS DOUBLE)+(y+20)*CAST(40 AS DOUBLE)+(z-100)*CAST(-200 AS DOUBLE))/CAST(81600 AS DOUBLE)))"


@query(f", p AS (SELECT *, {_T} AS t FROM systems) SELECT id64, name FROM p WHERE (x+100-t*200)*(x+100-t*200)+(y+20-t*40)*(y+20-t*40)+(z-100+t*200)*(z-100+t*200) <= CAST(900 AS DOUBLE)", head=_WITH.rstrip())
def capsule_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capsule from systems that are stored in Z-order."""
    return layout.read_capsule(spark, _stored(spark, sf_dir), (-100.0, -20.0, 100.0), (100.0, 20.0, -100.0), 30.0).select("id64", "name")


@query(ORACLE_SQL["capsule_stored"], head="")
def capsule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.capsule(fixtures.systems(spark, sf_dir), (-100.0, -20.0, 100.0), (100.0, 20.0, -100.0), 30.0).select("id64", "name")


_BFS = f""", e AS MATERIALIZED (SELECT a.id64 AS a, b.id64 AS b FROM systems a JOIN systems b ON {_NEAR} <= CAST(1600 AS DOUBLE)),
bfs(id64, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, bfs.depth + 1 FROM bfs JOIN e ON e.a = bfs.id64 WHERE bfs.depth < 30)
SELECT id64, CAST(min(depth) AS INTEGER) AS depth FROM bfs GROUP BY id64"""


@query(_BFS, head=_WITH.rstrip())
def ship_bfs_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.depths(fixtures.systems(spark, sf_dir), 1, 40.0)


@query(_BFS.replace("SELECT id64, CAST(min(depth) AS INTEGER) AS depth FROM bfs GROUP BY id64", "SELECT CAST(1 AS BIGINT) AS from_id, CAST(100 AS BIGINT) AS to_id, CAST(min(depth) AS INTEGER) AS jumps FROM bfs WHERE id64 = 100"), head=_WITH.rstrip())
def ship_route_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = routing.ship_route(fixtures.systems(spark, sf_dir), 1, 100, 40.0)
    return spark.createDataFrame([(route[0], route[-1], len(route) - 1)], "from_id bigint, to_id bigint, jumps int")


@query(_BFS, head=_WITH.rstrip())
def ship_bfs_depths_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from systems that are stored in Z-order."""
    return routing.depths(layout.read_points(spark, _stored(spark, sf_dir)), 1, 40.0)


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The systems at ten times the spacing, for carrier and neutron ranges."""
    return fixtures.systems(spark, sf_dir).withColumns({c: F.col(c) * 10.0 for c in "xyz"})


_CARRIER = f""", w AS (SELECT id64, name, x*CAST(10 AS DOUBLE) AS x, y*CAST(10 AS DOUBLE) AS y, z*CAST(10 AS DOUBLE) AS z FROM systems),
e AS (SELECT x AS ex, y AS ey, z AS ez FROM w WHERE id64 = 100),
g(step, id64, hx, hy, hz) AS (SELECT 0, id64, x, y, z FROM w WHERE id64 = 1 UNION ALL
 SELECT step + 1, arg_min(id64, (box, t, id64)), arg_min(x, (box, t, id64)), arg_min(y, (box, t, id64)), arg_min(z, (box, t, id64)) FROM (
  SELECT *, {" ".join(f"{'CASE' if k == 0 else ''} WHEN off <= CAST({b} AS DOUBLE) THEN {k}" for k, b in enumerate(routing.CARRIER_BOXES))} END AS box FROM (
   SELECT step, w.id64, x, y, z, sqrt((x-ex)*(x-ex)+(y-ey)*(y-ey)+(z-ez)*(z-ez)) AS t, sqrt((x-hx)*(x-hx)+(y-hy)*(y-hy)+(z-hz)*(z-hz)) AS d, h,
    greatest(abs(x-(hx+(ex-hx)/h*CAST(498.5 AS DOUBLE))), abs(y-(hy+(ey-hy)/h*CAST(498.5 AS DOUBLE))), abs(z-(hz+(ez-hz)/h*CAST(498.5 AS DOUBLE)))) AS off
   FROM (SELECT *, sqrt((hx-ex)*(hx-ex)+(hy-ey)*(hy-ey)+(hz-ez)*(hz-ez)) AS h FROM g, e) g2 JOIN w ON h > 500) c
  WHERE off <= 140 AND d > 0 AND d <= 500 AND t < h) c2 GROUP BY step),"""


def _rendered(boost: str = "false") -> str:
    """The columns of a route r (step, id64) over w."""
    return f"""q AS (SELECT r.step, r.id64, name, x, y, z{"" if boost == "false" else ", star"} FROM r JOIN w ON w.id64 = r.id64),
p AS (SELECT *, coalesce(sqrt((x-lag(x) OVER v)*(x-lag(x) OVER v)+(y-lag(y) OVER v)*(y-lag(y) OVER v)+(z-lag(z) OVER v)*(z-lag(z) OVER v)), 0) AS back,
 sqrt((x-first(x) OVER v)*(x-first(x) OVER v)+(y-first(y) OVER v)*(y-first(y) OVER v)+(z-first(z) OVER v)*(z-first(z) OVER v)) AS straight FROM q WINDOW v AS (ORDER BY step))
SELECT CAST(step AS INTEGER) AS step, CAST(id64 AS VARCHAR) AS id64, name, round(back*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS distance_from_prev, round(coalesce(lead(back) OVER (ORDER BY step), 0)*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS jump_distance,
 round(sum(back) OVER (ORDER BY step)*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS distance_from_start, round(straight*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE) AS straight_from_start, {boost} AS used_neutron_boost FROM p"""


_GREEDY_ROUTE = "(SELECT step, id64 FROM g UNION ALL SELECT max(step) + 1, 100 FROM g)"


@query(f"{_CARRIER}\nr AS {_GREEDY_ROUTE},\n{_rendered()}", head=_WITH.rstrip())
def carrier_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = _wide(spark, sf_dir)
    route, _ = routing.carrier_route(systems, 1, 100, "greedy")
    return routing.render(systems, route)


#: The route of fewest jumps whose ids are least: jumps to the goal from every node, then step by step the least id that is one nearer.
_LEAST = """links AS MATERIALIZED (SELECT a.id64 AS a, b.id64 AS b FROM nodes a JOIN nodes b ON a.id64 <> b.id64 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= a.reach*a.reach),
away(id64, d) AS (SELECT CAST(100 AS BIGINT), 0 UNION SELECT links.a, away.d + 1 FROM away JOIN links ON links.b = away.id64 WHERE away.d < 12),
near AS MATERIALIZED (SELECT id64, min(d) AS d FROM away GROUP BY id64),
path(step, id64, d) AS (SELECT step, near.id64, near.d FROM seed JOIN near ON near.id64 = seed.id64
 UNION ALL SELECT path.step + 1, min(near.id64), path.d - 1 FROM path JOIN links ON links.a = path.id64 JOIN near ON near.id64 = links.b AND near.d = path.d - 1 GROUP BY path.step, path.d)"""


@query(f"""{_CARRIER}
gr AS {_GREEDY_ROUTE},
ends AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, ex - a.x AS dx, ey - a.y AS dy, ez - a.z AS dz FROM w a, e WHERE a.id64 = 1),
along AS (SELECT w.*, x - ax AS px, y - ay AS py, z - az AS pz, dx, dy, dz, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ((x-ax)*dx+(y-ay)*dy+(z-az)*dz)/(dx*dx+dy*dy+dz*dz))) AS t FROM w, ends),
nodes AS (SELECT id64, x, y, z, CAST(500 AS DOUBLE) AS reach FROM along WHERE (px-t*dx)*(px-t*dx)+(py-t*dy)*(py-t*dy)+(pz-t*dz)*(pz-t*dz) <= CAST(2250000 AS DOUBLE)),
seed AS (SELECT 0 AS step, CAST(1 AS BIGINT) AS id64),
{_LEAST},
best AS (SELECT (SELECT max(step) FROM path) < (SELECT max(step) FROM gr) AS searched),
r AS (SELECT step, id64 FROM path, best WHERE searched UNION ALL SELECT step, id64 FROM gr, best WHERE searched IS NOT TRUE),
{_rendered()}""", head=_WITH.rstrip())
def carrier_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy route, or a searched one of fewer jumps."""
    systems = _wide(spark, sf_dir)
    route, _ = routing.carrier_route(systems, 1, 100, "astar")
    return routing.render(systems, route)


_HOPS = "SELECT CAST(c_nationkey AS BIGINT) AS route, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS step, CAST(c_custkey % 450 AS DOUBLE) + 20 AS d FROM customer"


@query(f"""WITH RECURSIVE h AS ({_HOPS}),
f(route, step, d, fuel, tank, market, enough) AS (
 SELECT route, step, d, ceil(5+d*(100+2000+1000+25000)/CAST(200000 AS DOUBLE)), 1000-ceil(5+d*(28100)/CAST(200000 AS DOUBLE))+least(greatest(ceil(5+d*(28100)/CAST(200000 AS DOUBLE)),0),CAST(2000 AS DOUBLE)), 2000-least(greatest(ceil(5+d*(28100)/CAST(200000 AS DOUBLE)),0),CAST(2000 AS DOUBLE)), 1000-ceil(5+d*(28100)/CAST(200000 AS DOUBLE)) >= 0 FROM h WHERE step = 1
 UNION ALL
 SELECT route, step, d, fuel, l+top, market-top, l >= 0 FROM (SELECT *, least(greatest(1000-l,0),market) AS top FROM (SELECT *, tank-fuel AS l FROM (
   SELECT h.route, h.step, h.d, ceil(5+h.d*(100+f.market+greatest(f.tank,0)+25000)/CAST(200000 AS DOUBLE)) AS fuel, f.tank, f.market FROM f JOIN h ON h.route = f.route AND h.step = f.step+1)))
)
SELECT * FROM f""", head="")
def carrier_fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.fuel_steps(fixtures._view(spark, sf_dir, _HOPS), tank=1000, market=2000, cargo=100)


@query(f""", n AS (SELECT * FROM systems WHERE id64 % 10 = 1), t AS (SELECT n.id64, n.x*30 AS x, n.y*30 AS y, n.z*30 AS z, sqrt(900*(n.x*n.x+n.y*n.y+n.z*n.z)) AS far FROM n)
SELECT id64, CAST(i AS INTEGER) AS i, x*(i*CAST(2000 AS DOUBLE)/far) AS x, y*(i*CAST(2000 AS DOUBLE)/far) AS y, z*(i*CAST(2000 AS DOUBLE)/far) AS z FROM t, range(1, 10) r(i) WHERE i < ceil(far/2000)""", head=_WITH.rstrip())
def neutron_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints from the origin to every tenth system at thirty times the spacing."""
    ends = fixtures.systems(spark, sf_dir).where("id64 % 10 = 1").select("id64", *[(F.col(c) * 30.0).alias(c) for c in "xyz"])
    return routing.waypoints_to(ends, (0.0, 0.0, 0.0))


@query(ORACLE_SQL["carrier_fuel"].replace("25000", "60000").replace("28100", "63100"), head="")
def carrier_fuel_squadron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heavier carriers."""
    return routing.fuel_steps(fixtures._view(spark, sf_dir, _HOPS), tank=1000, market=2000, cargo=100, squadron=True)


def _neutron_sql(scale: int, jump: int) -> str:
    """g: the greedy route with its stops, over systems at ``scale`` times the spacing.  The capsules are wider than the catalogue."""
    far = lambda p, q: "sqrt(" + "+".join(f"({p}{c}-{q}{c})*({p}{c}-{q}{c})" for c in "xyz") + ")"
    return f""", star AS (SELECT DISTINCT systemId64 FROM patches WHERE subType = 'Neutron Star'),
w AS MATERIALIZED (SELECT id64, name, x*CAST({scale} AS DOUBLE) AS x, y*CAST({scale} AS DOUBLE) AS y, z*CAST({scale} AS DOUBLE) AS z, systemId64 IS NOT NULL AS star FROM systems LEFT JOIN star ON systemId64 = id64),
ends AS (SELECT a.x AS ux, a.y AS uy, a.z AS uz, b.x AS vx, b.y AS vy, b.z AS vz, {far('a.', 'b.')} AS total FROM w a, w b WHERE a.id64 = 1 AND b.id64 = 100),
way AS (SELECT i, ux+(vx-ux)*(i*CAST(2000 AS DOUBLE)/total) AS wx, uy+(vy-uy)*(i*CAST(2000 AS DOUBLE)/total) AS wy, uz+(vz-uz)*(i*CAST(2000 AS DOUBLE)/total) AS wz FROM ends, range(1, 100) r(i) WHERE i < ceil(total/2000)),
boxed AS (SELECT i, id64, (x-wx)*(x-wx)+(y-wy)*(y-wy)+(z-wz)*(z-wz) AS d2, greatest(abs(x-wx), abs(y-wy), abs(z-wz)) AS off FROM way JOIN w ON w.star),
stop AS (SELECT i, arg_min(id64, (CASE WHEN off <= 300 THEN 1 WHEN off <= 800 THEN 2 WHEN off <= 1500 THEN 3 ELSE 4 END, d2, id64)) AS id64 FROM boxed WHERE off <= 3000 GROUP BY i),
kept AS (SELECT i, id64 FROM (SELECT i, id64, lag(id64) OVER (ORDER BY i) AS prior FROM stop) WHERE prior IS NULL OR prior <> id64 UNION ALL SELECT 1000, 100),
st AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS k, w.id64 AS sid, x AS sx, y AS sy, z AS sz FROM kept JOIN w ON w.id64 = kept.id64),
g(turn, k, id64, hx, hy, hz, star, moved) AS (SELECT 0, 1, id64, x, y, z, star, true FROM w WHERE id64 = 1
 UNION ALL SELECT turn + 1, CASE WHEN b IS NULL OR b.rank = 0 THEN k + 1 ELSE k END, coalesce(b.id, id64), coalesce(b.x, hx), coalesce(b.y, hy), coalesce(b.z, hz), coalesce(b.star, star), b IS NOT NULL AND b.id <> id64 FROM (
  SELECT turn, k, id64, hx, hy, hz, star, min(CASE WHEN rank IS NOT NULL THEN {{'rank': rank, 't': t, 'id': id, 'x': x, 'y': y, 'z': z, 'star': wstar}} END) AS b FROM (
   SELECT *, CASE WHEN l <= reach THEN CASE WHEN id = sid THEN 0 END WHEN t >= l OR d = 0 THEN NULL WHEN wstar AND d <= reach THEN 1 WHEN d <= reach THEN 2 WHEN d <= reach * CAST(1.05 AS DOUBLE) THEN 3 END AS rank FROM (
    SELECT g.*, sid, w.id64 AS id, x, y, z, w.star AS wstar, {far('h', '')} AS d, {far('s', '')} AS t, {far('h', 's')} AS l, CASE WHEN g.star THEN CAST({4 * jump} AS DOUBLE) ELSE CAST({jump} AS DOUBLE) END AS reach FROM g JOIN st ON st.k = g.k JOIN w ON true WHERE turn < 300) c) c2
  GROUP BY turn, k, id64, hx, hy, hz, star) c3),
walked AS (SELECT CAST(row_number() OVER (ORDER BY turn) - 1 AS INTEGER) AS step, id64 FROM g WHERE moved),
gr AS (SELECT step, id64 FROM walked UNION ALL SELECT (SELECT max(step) + 1 FROM walked), 100 WHERE (SELECT arg_max(id64, step) FROM walked) <> 100),
"""


_BOOST = "star AND lead(step) OVER (ORDER BY step) IS NOT NULL"


@query(f"{_neutron_sql(1, 40)}r AS (SELECT * FROM gr),\n{_rendered(_BOOST)}", head=_WITH.rstrip())
def neutron_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment, over systems that are stored in Z-order."""
    systems, stars = fixtures.systems(spark, sf_dir), merge.neutron_systems(fixtures.body_patches(spark, sf_dir))
    path = shared_path(spark, "marked")
    layout.write_points(routing.with_neutrons(systems, stars), path)
    near = lambda centre, half: layout.read_box(spark, path, centre, half)
    route, _ = routing.neutron_route(systems, stars, 1, 100, routing.Ship(40.0), "greedy", near)
    return routing.render(systems, route, stars)


@query(f""", n AS (SELECT DISTINCT systemId64 FROM patches WHERE subType = 'Neutron Star'),
e AS MATERIALIZED (SELECT a.id64 AS a, b.id64 AS b FROM systems a LEFT JOIN n ON n.systemId64 = a.id64 JOIN systems b ON {_NEAR} <= CASE WHEN n.systemId64 IS NULL THEN CAST(400 AS DOUBLE) ELSE CAST(6400 AS DOUBLE) END),
bfs(id64, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.b, bfs.depth + 1 FROM bfs JOIN e ON e.a = bfs.id64 WHERE bfs.depth < 20)
SELECT CAST(min(depth) AS INTEGER) AS jumps FROM bfs WHERE id64 = 100""", head=_WITH.rstrip())
def neutron_bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    stars = merge.neutron_systems(fixtures.body_patches(spark, sf_dir))
    route = routing.neutron_search(fixtures.systems(spark, sf_dir), stars, 1, 100, routing.Ship(20.0))
    return spark.createDataFrame([(None if route is None else len(route) - 1,)], "jumps int")


@query(f"""{_neutron_sql(10, 150)}nodes AS (SELECT id64, x, y, z, CASE WHEN star THEN CAST(600 AS DOUBLE) ELSE CAST(150 AS DOUBLE) END AS reach FROM w WHERE star OR id64 IN (1, 100)),
seed AS (SELECT step, id64 FROM (SELECT gr.step, gr.id64, w.star FROM gr JOIN w ON w.id64 = gr.id64) ORDER BY NOT star, step LIMIT 1),
{_LEAST},
best AS (SELECT (SELECT max(step) FROM path) < (SELECT max(step) FROM gr) AND (SELECT count(*) FROM path WHERE id64 = 100) > 0 AS searched),
r AS (SELECT gr.step, gr.id64 FROM gr, best, seed WHERE searched AND gr.step < seed.step UNION ALL SELECT step, id64 FROM path, best WHERE searched UNION ALL SELECT step, id64 FROM gr, best WHERE searched IS NOT TRUE),
{_rendered(_BOOST)}""", head=_WITH.rstrip())
def neutron_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By waypoints, greedy and search, over the catalogue at ten times the spacing."""
    systems, stars = _wide(spark, sf_dir), merge.neutron_systems(fixtures.body_patches(spark, sf_dir))
    route, _ = routing.neutron_route(systems, stars, 1, 100, routing.Ship(150.0))
    return routing.render(systems, route, stars)


@query("SELECT key, max_by(value, seq) AS value FROM (SELECT concat('k', o_custkey % 10) AS key, o_orderstatus AS value, o_orderkey AS seq FROM orders) GROUP BY key", head="")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures._view(spark, sf_dir, "SELECT concat('k', o_custkey % 10) AS key, o_orderstatus AS value, o_orderkey AS seq FROM orders")
    return merge.fold(rows, ["key"], {})


@query("SELECT o_orderkey AS id, o_orderkey > 21600 OR o_orderkey % 5 = 0 AS stale FROM orders", head="")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("o_orderkey") % 5 != 0, F.lit(0).cast("bigint"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), live.is_stale(last, F.col("o_orderkey")).alias("stale"))


_RENDER = ", r AS (SELECT row_number() OVER (ORDER BY id64) - 1 AS step, * FROM systems WHERE id64 IN (1,2,3,4,5,6,7,8)), p AS (SELECT *, sqrt((x-lag(x) OVER w)*(x-lag(x) OVER w)+(y-lag(y) OVER w)*(y-lag(y) OVER w)+(z-lag(z) OVER w)*(z-lag(z) OVER w)) AS back FROM r WINDOW w AS (ORDER BY step))"
_R2 = "round({0}*CAST(100 AS DOUBLE))/CAST(100 AS DOUBLE)"


@query(f"{_RENDER} SELECT CAST(step AS INTEGER) AS step, CAST(id64 AS VARCHAR) AS id64, name, {_R2.format('coalesce(back,0)')} AS distance_from_prev, {_R2.format('coalesce(lead(back) OVER (ORDER BY step),0)')} AS jump_distance FROM p", head=_WITH.rstrip())
def route_render_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.render(fixtures.systems(spark, sf_dir), list(range(1, 9))).select("step", "id64", "name", "distance_from_prev", "jump_distance")


@query(f"{_RENDER} SELECT CAST(step AS INTEGER) AS step, {_R2.format('sum(coalesce(back,0)) OVER (ORDER BY step)')} AS distance_from_start FROM p", head=_WITH.rstrip())
def route_render_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.render(fixtures.systems(spark, sf_dir), list(range(1, 9))).select("step", "distance_from_start")


# ------------------------------------------------------------------ heatmap
_POINTS = "SELECT event_id, (event_id * 7919) % 101000 - CAST(50500 AS DOUBLE) + value * 0 AS x, (event_id * 104729) % 101000 - CAST(25500 AS DOUBLE) AS z FROM events"
_BINS = f"SELECT CAST(floor((x+50000)/CAST(100000 AS DOUBLE)*1024) AS INTEGER) // 64 AS gx, CAST(floor((z+25000)/CAST(100000 AS DOUBLE)*1024) AS INTEGER) // 64 AS gz, count(*) AS n FROM ({_POINTS}) p WHERE x >= -50000 AND x < 50000 AND z >= -25000 AND z < 75000 GROUP BY ALL"


def _heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse cells, so that counts differ."""
    fine = heatmap.bins(fixtures._view(spark, sf_dir, _POINTS))
    return fine.groupBy(F.floor(F.col("gx") / 64).cast("int").alias("gx"), F.floor(F.col("gz") / 64).cast("int").alias("gz")).agg(F.sum("n").alias("n"))


@query(_BINS, head="")
def heat_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir)


@query(f"WITH RECURSIVE b AS ({_BINS}), d(gx, gz, n, k) AS (SELECT gx, gz, n, 0 FROM b UNION ALL SELECT gx, gz, CAST(floor(n*CAST(0.9928057 AS DOUBLE)) AS BIGINT), k+1 FROM d WHERE k < 12) SELECT gx, gz, n FROM d WHERE k = 12", head="")
def heat_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _heat(spark, sf_dir).select("gx", "gz", heatmap.decayed(F.col("n"), 12).alias("n"))


_TIMED = "SELECT x/64 AS x, z/64 AS z, CAST(event_id % 5 AS INTEGER) AS tick FROM ({0}) p"
_STATE_CELL = "CAST(floor((x+50000)/CAST(100000 AS DOUBLE)*1024) AS INTEGER) AS gx, CAST(floor((z+25000)/CAST(100000 AS DOUBLE)*1024) AS INTEGER) AS gz"


@query(f"""WITH RECURSIVE c AS (SELECT {_STATE_CELL}, tick, count(*) AS c FROM ({_TIMED.format(_POINTS)}) GROUP BY ALL), k AS (SELECT DISTINCT gx, gz FROM c),
h(gx, gz, tick, n) AS (SELECT gx, gz, -1, CAST(0 AS BIGINT) FROM k UNION ALL SELECT h.gx, h.gz, h.tick + 1, CAST(floor(h.n*CAST(0.9928057 AS DOUBLE)) AS BIGINT) + coalesce((SELECT max(c.c) FROM c WHERE c.gx = h.gx AND c.gz = h.gz AND c.tick = h.tick + 1), 0) FROM h WHERE h.tick < 9)
SELECT gx, gz, n FROM h WHERE tick = 9 AND n > 0""", head="")
def heat_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as keyed state of a stream, a batch a tick, and what they have come down to at tick 9."""
    root, setting = shared_path(spark, "heat"), "spark.sql.streaming.stateStore.providerClass"
    points, before = fixtures._view(spark, sf_dir, _TIMED.format(_POINTS)), spark.conf.get(setting, None)
    table = runs.RunTable(spark, f"{root}/cells", ["gx", "gz"], {})
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for tick in range(5):
            points.where(F.col("tick") == tick).write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(points.schema).parquet(f"{root}/in")
            live.heat_stream(source, table, f"{root}/checkpoint", F.col("tick"), {"availableNow": True}, seconds=0).awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return live.heat_now(table.read(), 9)


_INTENSITY = f"SELECT gx, gz, n, ln(n+CAST(1 AS DOUBLE))/greatest(ln((SELECT max(n) FROM ({_BINS}))+CAST(1 AS DOUBLE)),1) AS t FROM ({_BINS})"


@query(f"SELECT gx, gz, n, round(t*CAST(1000000 AS DOUBLE))/CAST(1000000 AS DOUBLE) AS t FROM ({_INTENSITY})", head="")
def heat_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap.intensity(_heat(spark, sf_dir)).withColumn("t", S.round_to(F.col("t"), 6))


def _lerp(k: int) -> str:
    low = "CASE p " + " ".join(f"WHEN {i} THEN CAST({s[k]} AS DOUBLE)" for i, s in enumerate(heatmap.STOPS)) + " END"
    return f"CAST(floor({low} + ({low.replace('CASE p', 'CASE p+1')} - {low}) * (t*8-p)) AS INTEGER)"


@query(f"SELECT n, {_lerp(0)} AS r, {_lerp(1)} AS g, {_lerp(2)} AS b, CAST(floor(60+t*195) AS INTEGER) AS a FROM (SELECT n, t, least(CAST(floor(t*8) AS INTEGER), 7) AS p FROM (SELECT DISTINCT n, n/CAST(1000 AS DOUBLE) AS t FROM (SELECT (event_id*7) % 1000 AS n FROM events)))", head="")
def heat_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("n") / F.lit(1000.0)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(((F.col("event_id") * 7) % 1000).alias("n")).distinct().select("n", *[c.alias(k) for k, c in heatmap.colour(t).items()])


@query(f"SELECT event_id, (x+50000)/CAST(100000 AS DOUBLE)*100 AS left_pct, (1-(z+25000)/CAST(100000 AS DOUBLE))*100 AS top_pct FROM ({_POINTS}) p", head="")
def heat_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, top = heatmap.marker(F.col("x"), F.col("z"))
    return fixtures._view(spark, sf_dir, _POINTS).select("event_id", left.alias("left_pct"), top.alias("top_pct"))


# ------------------------------------------------------------------ scalars
_CODES = sorted(S.STAR_NAMES) + ["Q"]


def _case(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.STAR_NAMES.items()) + f" ELSE {column} END"


@query(f"SELECT c_custkey AS id, code, {_case('code')} AS name FROM (SELECT c_custkey, (ARRAY{_CODES!r})[1 + c_custkey % {len(_CODES)}] AS code FROM customer)", head="")
def star_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, _CODES))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.get(codes, (F.col("c_custkey") % len(_CODES)).cast("int")).alias("code"))
    return rows.withColumn("name", S.star_name(F.col("code")))


@query("SELECT o_orderkey AS id, regexp_replace(regexp_replace(regexp_replace(t, '^\\$+', ''), ';+$', ''), '^[^_]*_', '') AS token FROM (SELECT o_orderkey, concat('$gov_', o_orderstatus, '_', o_orderkey, ';') AS t FROM orders)", head="")
def token_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("id"), S.strip_token(F.concat(F.lit("$gov_"), "o_orderstatus", F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(";"))).alias("token"))


_SCHEMA = "https://x/journal/"
_MESSAGE = """SELECT o_orderkey AS seq, concat('{"$schemaRef":"https://x/journal/1","message":{"event":"', CASE o_orderkey % 4 WHEN 0 THEN 'FSDJump' WHEN 1 THEN 'Scan' WHEN 2 THEN 'Docked' ELSE 'Music' END,
 '","SystemAddress":', o_custkey, ',"StarSystem":"S', o_custkey, '","StarPos":[', o_custkey % 100, ',0.5,', o_orderkey % 50, '],"BodyID":', o_orderkey % 7, ',"BodyName":"B","StarType":"N","SurfacePressure":', o_orderkey,
 ',"OrbitalPeriod":', o_orderkey, ',"Radius":', o_orderkey, ',"SemiMajorAxis":', o_orderkey, ',"RotationPeriod":-', o_orderkey, ',"SurfaceGravity":', o_orderkey, '.5,"MarketID":', o_orderkey, ',"StationName":"T","StationServices":["Market","Dock","Missions"]}}') AS json FROM orders"""


@query("SELECT o_custkey AS \"systemId64\", CAST(o_orderkey % 7 AS BIGINT) AS \"bodyId\", 'Neutron Star' AS \"subType\", o_orderkey/CAST(101325 AS DOUBLE) AS \"surfacePressure\", o_orderkey/CAST(86400 AS DOUBLE) AS \"orbitalPeriod\", o_orderkey/CAST(695700000 AS DOUBLE) AS \"solarRadius\", o_orderkey/CAST(1000 AS DOUBLE) AS radius, o_orderkey/CAST(149597870700 AS DOUBLE) AS \"semiMajorAxis\", -o_orderkey/CAST(86400 AS DOUBLE) AS \"rotationalPeriod\", (o_orderkey+CAST(0.5 AS DOUBLE))/CAST(9.80665 AS DOUBLE) AS gravity FROM orders WHERE o_orderkey % 4 = 1", head="")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = translate.bodies(translate.messages(fixtures._view(spark, sf_dir, _MESSAGE), schema=_SCHEMA))
    return found.select("systemId64", "bodyId", "subType", "surfacePressure", "orbitalPeriod", "solarRadius", "radius", "semiMajorAxis", "rotationalPeriod", "gravity")


@query("SELECT o_custkey AS \"systemId64\", o_orderkey AS id, CAST(1 AS INTEGER) AS \"haveMarket\", CAST(0 AS INTEGER) AS \"haveShipyard\", CAST(0 AS INTEGER) AS \"haveOutfitting\", '[\"Missions\"]' AS \"otherServices\" FROM orders WHERE o_orderkey % 4 = 2", head="")
def service_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = translate.stations(translate.messages(fixtures._view(spark, sf_dir, _MESSAGE), schema=_SCHEMA))
    return found.select("systemId64", "id", "haveMarket", "haveShipyard", "haveOutfitting", "otherServices")


@query("SELECT CASE o_orderkey % 4 WHEN 0 THEN 'FSDJump' WHEN 1 THEN 'Scan' WHEN 2 THEN 'Docked' ELSE 'Music' END AS event, count(*) AS n, count(DISTINCT o_custkey) AS systems FROM orders GROUP BY ALL", head="")
def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.messages(fixtures._view(spark, sf_dir, _MESSAGE), schema=_SCHEMA).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id64").alias("systems"))


@query("SELECT o_custkey AS id64, concat('S', o_custkey) AS name, CAST(o_custkey % 100 AS DOUBLE) AS x, CAST(0.5 AS DOUBLE) AS y, CAST(o_orderkey % 50 AS DOUBLE) AS z FROM orders WHERE o_orderkey % 4 < 3", head="")
def jump_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.systems(translate.messages(fixtures._view(spark, sf_dir, _MESSAGE), schema=_SCHEMA)).select("id64", "name", "x", "y", "z")


_LIVE = """SELECT o_orderkey AS seq, concat('{"$schemaRef":"https://x/journal/1","message":{"event":"', CASE o_orderkey % 5 WHEN 0 THEN 'Location' WHEN 1 THEN 'Scan' WHEN 2 THEN 'Docked' WHEN 3 THEN 'SAASignalsFound' ELSE 'Music' END,
 '","SystemAddress":', CASE WHEN o_orderkey % 17 = 0 THEN '"7"' ELSE CAST(o_custkey AS VARCHAR(20)) END, ',"StarSystem":"', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'S' END, '","StarPos":[', o_custkey % 100, ',0.5,', CASE WHEN o_orderkey % 7 = 0 THEN '"far"' WHEN o_orderkey % 11 = 0 THEN '1,2' ELSE '3' END,
 '],"Population":9', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat(',"BodyID":', o_orderkey, ',"MarketID":', o_orderkey) END, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',"BodyName":"B","StationName":"T"' END, ',"Signals":[1]}}') AS json FROM orders"""
_EVENT = "(o_orderkey % 5 = 0 OR o_orderkey % 3 <> 0 AND (o_orderkey % 5 IN (1, 2) AND o_orderkey % 2 <> 0 OR o_orderkey % 5 = 3)) AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0"


@query(f"SELECT o_orderkey AS seq, o_custkey AS id64, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS x, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(3 AS DOUBLE) END AS z, CASE WHEN o_orderkey % 5 = 0 THEN CAST(9 AS BIGINT) END AS population FROM orders WHERE {_EVENT}", head="")
def live_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of message places its system by three numbers; one without a valid body or station gives nothing."""
    found = translate.systems(translate.messages(fixtures._view(spark, sf_dir, _LIVE), schema=_SCHEMA))
    return found.select("seq", "id64", "x", "z", "population")


@query("SELECT count(*) AS received, CAST(count(*) FILTER (WHERE o_orderkey % 4 < 3 AND o_orderkey % 10 <> 0) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE o_orderkey % 10 = 0) AS BIGINT) AS dropped, CAST(count(*) FILTER (WHERE o_orderkey % 4 = 3 AND o_orderkey % 10 <> 0) AS BIGINT) AS ignored FROM orders", head="")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fixtures._view(spark, sf_dir, _MESSAGE).withColumn("json", F.when(F.col("seq") % 10 == 0, F.lit("{broken")).otherwise(F.col("json")))
    v = F.try_parse_json("json")
    handled = F.coalesce(translate.text(v, "$.message.event").isin(*translate.JUMPS, "Scan", "Docked", "SAASignalsFound"), F.lit(False))
    return live.ingest_stats(frames, "json", v, handled)


@query(f"""SELECT count(*) AS messages_received, CAST(count(*) FILTER (WHERE NOT broken AND {_EVENT}) AS BIGINT) AS messages_processed, CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS messages_dropped,
 CAST(count(*) FILTER (WHERE NOT broken AND {_EVENT} AND o_orderkey % 5 IN (1, 3)) AS BIGINT) AS bodies_emitted, CAST(count(*) FILTER (WHERE NOT broken AND {_EVENT} AND o_orderkey % 5 = 2) AS BIGINT) AS stations_emitted,
 CAST(count(*) FILTER (WHERE NOT broken AND {_EVENT} AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0) AS BIGINT) AS total_bumps, CAST(max(o_orderkey) FILTER (WHERE NOT broken AND {_EVENT}) AS BIGINT) AS last_message_time,
 (SELECT count(*) FROM customer WHERE c_custkey % 17 <> 0) AS systems_ingested, (SELECT count(*) FROM customer WHERE c_custkey % 17 <> 0) AS bodies_ingested, (SELECT max(o_orderkey) FROM orders WHERE o_custkey % 10 = 3) AS last_sync, 'false' AS import_complete
 FROM (SELECT *, o_orderkey % 10 = 0 AS broken FROM orders)""", head="")
def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, opened up: counts that were observed while the live messages were written as patches, a push, and the meta table."""
    frames = fixtures._view(spark, sf_dir, _LIVE).withColumn("json", F.when(F.col("seq") % 20 == 0, F.lit("{broken")).when(F.col("seq") % 10 != 0, F.col("json")))
    watch, live_counts = Observation(), stats.Counters()
    translate.systems(stats.observed(frames, watch, schema=_SCHEMA, arrived="seq")).write.parquet(shared_path(spark, "patches"))
    live_counts.add(watch.get)
    meta = fixtures._view(spark, sf_dir, "SELECT CASE WHEN o_custkey % 10 = 3 THEN 'last_sync_time' ELSE 'other' END AS key, CAST(o_orderkey AS VARCHAR(20)) AS value, o_orderkey AS seq FROM orders")
    found = stats.report(spark, live_counts, stats.pushed_counts(_documents(spark, sf_dir), F.lit(5)), merge.fold(meta, ["key"], {}))
    from_live = [f"live_ingest.{c}" for c in ("messages_received", "messages_processed", "messages_dropped", "bodies_emitted", "stations_emitted", "last_message_time")]
    return found.select(*from_live, "heatmap.total_bumps", "push_ingest.systems_ingested", "push_ingest.bodies_ingested", "database.last_sync", "database.import_complete")


# ------------------------------------------------------------------ ingest
_DUMP = """SELECT c_custkey AS seq, concat('{"id64":', CASE WHEN c_custkey % 17 = 0 THEN 'null' ELSE CAST(c_custkey AS VARCHAR(20)) END, ',"name":"', c_name, '","population":', c_custkey % 5, ',"coords":{"x":', c_custkey % 100, '.5,"y":0.25,"z":-', c_custkey % 7,
 '},"government":"', CASE WHEN c_custkey % 16 = 1 THEN 'Prison Colony' ELSE 'Feudal' END, '","controllingFaction":{"name":"F', c_nationkey, '"},"bodies":[{"bodyId":', CASE WHEN c_custkey % 5 = 0 THEN '"7"' ELSE CAST(c_custkey % 9 AS VARCHAR(20)) END, ',"subType":"Neutron Star","isLandable":', CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '1' END,
 ',"surfaceTemperature":', c_custkey % 1000, CASE WHEN c_custkey % 2 = 0 THEN '.75' ELSE '' END, ',"solarMasses":', CASE WHEN c_custkey % 4 = 0 THEN 'null' ELSE '1.5' END, ',"stellarMass":2.5,"wasMapped":', CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '4' ELSE '"x"' END,
 ',"id64":', c_custkey * 3, CASE c_custkey % 3 WHEN 0 THEN ',"solidComposition":null' WHEN 1 THEN ',"solidComposition":{"Ice":1}' ELSE '' END, ',"composition":{"Rock":2},"mainStar":', CASE c_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '0' ELSE 'null' END, ',"age":', CASE WHEN c_custkey % 2 = 0 THEN '12' ELSE '12.5' END, ',"axialTilt":0.125,"signals":', CASE WHEN c_custkey % 6 = 0 THEN 'null' ELSE '[{"n":1}]' END, '}],"stations":[{"id":', c_custkey, ',"name":"T","government":"', CASE WHEN c_custkey % 8 = 0 THEN 'PRISON' ELSE 'Other' END,
 '","primaryEconomy":"Refinery","services":["Shipyard","Dock","Missions",3,"Autodock"],"landingPads":{"Large":', c_custkey % 3, '}}]}') AS json FROM customer"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.documents(fixtures._view(spark, sf_dir, _DUMP))


@query("""SELECT c_custkey AS id64, c_name AS name, CAST(c_custkey % 5 AS BIGINT) AS population, (c_custkey % 100) + CAST(0.5 AS DOUBLE) AS x, CAST(0.25 AS DOUBLE) AS y, CAST(-(c_custkey % 7) AS DOUBLE) AS z, concat('{"name":"F', c_nationkey, '"}') AS "controllingFaction" FROM customer WHERE c_custkey % 17 <> 0""", head="")
def dump_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as patches of systems; one without an id is skipped."""
    return patches.systems(_documents(spark, sf_dir)).select("id64", "name", "population", "x", "y", "z", "controllingFaction")


@query("""SELECT c_custkey AS "systemId64", CAST(c_custkey % 9 AS BIGINT) AS "bodyId", 'Neutron Star' AS "subType", CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS "isLandable", CAST(c_custkey % 1000 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS "surfaceTemperature",
 CASE WHEN c_custkey % 4 <> 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(2.5 AS DOUBLE) END AS "stellarMass", CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 END AS "wasMapped", CASE WHEN c_custkey % 2 = 0 THEN CAST(12 AS BIGINT) END AS age, CAST(0.125 AS DOUBLE) AS "axisTilt", CASE WHEN c_custkey % 6 <> 0 THEN '[{"n":1}]' END AS signals
 FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 5 <> 0""", head="")
def dump_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of documents with the derived columns, merged; one without a number is dropped."""
    found = patches.bodies(_documents(spark, sf_dir)).select("systemId64", "bodyId", "subType", "isLandable", "surfaceTemperature", "stellarMass", "wasMapped", "age", "axisTilt", "signals", "seq")
    return merge.fold(found, ["systemId64", "bodyId"], {"isLandable": merge.last_given})


@query("""SELECT c_custkey AS "systemId64", CAST(c_custkey * 3 AS BIGINT) AS "bodyId64", CASE c_custkey % 3 WHEN 1 THEN '{"Ice":1}' WHEN 2 THEN '{"Rock":2}' END AS composition, CASE c_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS "mainStar" FROM customer WHERE c_custkey % 17 <> 0""", head="")
def dump_body_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solid composition goes before the plain one, even where it is null."""
    return patches.bodies(_documents(spark, sf_dir)).select("systemId64", "bodyId64", "composition", "mainStar")


@query("""SELECT c_custkey AS "systemId64", c_custkey AS id, CASE WHEN c_custkey % 8 = 0 THEN 'PRISON' ELSE 'Other' END AS government, 'Refinery' AS economy, 0 AS "haveMarket", 1 AS "haveShipyard", '["Missions"]' AS "otherServices", concat('{"Large":', c_custkey % 3, '}') AS "landingPads" FROM customer WHERE c_custkey % 17 <> 0""", head="")
def dump_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.stations(_documents(spark, sf_dir)).select("systemId64", "id", "government", "economy", "haveMarket", "haveShipyard", "otherServices", "landingPads")


@query("SELECT c_custkey AS \"systemId64\" FROM customer WHERE c_custkey % 17 <> 0 AND (c_custkey % 8 = 0 OR c_custkey % 16 = 1)", head="")
def dump_prisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return merge.prison_systems(patches.stations(docs), patches.systems(docs))


DUMP_LINES = 20_000  # of a dump's file


def _dump_file(spark: SparkSession, sf_dir: str) -> str:
    """A dump as gzip files of all layouts: several documents a line, documents over lines, with a comma between, and broken ones."""
    key, json = F.col("seq"), F.col("json")
    again = F.replace(json, F.concat(F.lit('"id64":'), key.cast("string")), F.concat(F.lit('"id64":'), (key + 1_000_000).cast("string")))
    lines = F.when(key % 7 == 0, F.expr("left(json, length(json) div 2)")).when(key % 7 == 1, F.concat(json, again)).when(key % 7 == 2, F.replace(json, F.lit(","), F.lit(",\n  "))).when(key % 7 == 3, F.concat(F.lit("["), json, F.lit(",")))
    lines = lines.when(key % 7 == 4, F.replace(json, F.lit('"name":"'), F.lit('"note":"}{[ \\\\ ","name":"'))).when(key % 7 == 5, F.replace(json, F.lit('"stations":['), F.lit('"stations":{'))).otherwise(json)
    path = shared_path(spark, "dump")
    rows = fixtures._view(spark, sf_dir, _DUMP).select("seq", lines.alias("value"))
    # a gzip file is one task's to read, so files are as many as tasks, and more where they would hold too much
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq").select("value")
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", DUMP_LINES).text(path)
    return path


@query("""SELECT id64, name, population, x, government FROM (SELECT c_custkey AS id64, c_name AS name, CAST(c_custkey % 5 AS BIGINT) AS population, (c_custkey % 100) + CAST(0.5 AS DOUBLE) AS x, CASE WHEN c_custkey % 16 = 1 THEN 'Prison Colony' ELSE 'Feudal' END AS government FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 7 NOT IN (0, 5)
 UNION ALL SELECT c_custkey + 1000000, c_name, CAST(c_custkey % 5 AS BIGINT), (c_custkey % 100) + CAST(0.5 AS DOUBLE), CASE WHEN c_custkey % 16 = 1 THEN 'Prison Colony' ELSE 'Feudal' END FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 7 = 1)""", head="")
def dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump that is written and read again by structure; what is broken is left out and costs no other document."""
    return patches.systems(feeds.read_dump(spark, _dump_file(spark, sf_dir))).select("id64", "name", "population", "x", "government")


@query("SELECT count(*) AS accepted FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey < 5000", head="")
def push_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pushed batch within its bounds."""
    rows = fixtures._view(spark, sf_dir, _DUMP).where("seq % 17 <> 0 and seq < 5000").select("json")
    return feeds.pushed(rows).agg(F.count(F.lit(1)).alias("accepted"))


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 10 <> 0 THEN concat('{\"n\":', o_orderkey, '}') END AS json FROM orders", head="")
def frame_inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed frames as text; what isn't one is null."""
    packed = F.when(F.col("seq") % 10 == 0, F.lit(b"no frame")).otherwise(feeds.deflate(F.concat(F.lit('{"n":'), F.col("seq").cast("string"), F.lit("}"))))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"))
    return rows.select("seq", feeds.inflate(packed).alias("json"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN CAST(-1.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x FROM orders", head="")
def coordinate_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.lit("-1.5")).when(key % 4 == 2, F.lit("north"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), feeds.coordinate(text).alias("x"))


_SIGNALS = """SELECT o_orderkey AS seq, concat('{"$schemaRef":"', CASE WHEN o_orderkey % 11 = 0 THEN 'https://y/?u=https://x/journal/1' ELSE 'https://x/journal/1' END, '","message":{"event":"SAASignalsFound","SystemAddress":', o_custkey, ',"StarSystem":"S","BodyID":', CASE WHEN o_orderkey % 5 = 0 THEN '"1"' ELSE CAST(o_orderkey % 5 AS VARCHAR(20)) END,
 ',"BodyName":"B","Signals":', CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE concat('[{"Count":', o_orderkey, '}]') END, ',"timestamp":"t', o_orderkey, '"}}') AS json FROM orders"""


@query("SELECT o_custkey AS \"systemId64\", CAST(o_orderkey % 5 AS BIGINT) AS \"bodyId\", 'B' AS name, concat('[{\"Count\":', o_orderkey, '}]') AS signals, 0 AS \"isLandable\", concat('t', o_orderkey) AS \"updateTime\" FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0", head="")
def signals_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found signals as patches of bodies; another schema, a number as text or no signals give none."""
    found = translate.bodies(translate.messages(fixtures._view(spark, sf_dir, _SIGNALS), schema=_SCHEMA))
    return found.select("systemId64", "bodyId", "name", "signals", "isLandable", "updateTime")


_SCANS = """SELECT o_orderkey AS seq, concat('{"$schemaRef":"https://x/journal/1","message":{"event":"Scan","SystemAddress":', o_custkey, ',"StarSystem":"S","BodyID":', o_orderkey % 9, ',"BodyName":"B","PlanetClass":"Icy body"', """ + ", ".join(
    f"""',"{source}":', {dict(double="o_orderkey", whole="o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '.5' ELSE '' END", flag="CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '1' END", int="CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE '3' END", string="concat('\"', o_orderpriority, '\"')", json="concat('[', o_orderkey, ']')", bigint="o_orderkey")[how]}""" for source, how in translate.SCAN_FIELDS.values()
) + ", '}}') AS json FROM orders"
_SCANNED = {"double": "CAST(o_orderkey AS DOUBLE)", "whole": "CAST(o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT)", "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END", "int": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END", "string": "o_orderpriority", "json": "concat('[', o_orderkey, ']')", "bigint": "o_orderkey"}


@query("SELECT o_custkey AS \"systemId64\", CAST(o_orderkey % 9 AS BIGINT) AS \"bodyId\", " + ", ".join(f'{_SCANNED[how]} AS "{k}"' for k, (_, how) in translate.SCAN_FIELDS.items()) + " FROM orders", head="")
def scan_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of a scan that are copied under another name."""
    found = translate.bodies(translate.messages(fixtures._view(spark, sf_dir, _SCANS), schema=_SCHEMA))
    return found.select("systemId64", "bodyId", *translate.SCAN_FIELDS)


_JUMPS = """SELECT o_orderkey AS seq, concat('{"$schemaRef":"https://x/journal/1","message":{"event":"FSDJump","SystemAddress":', o_custkey, ',"StarSystem":"S","SystemGovernment":"$gov_Feudal_', o_orderkey % 3, ';"', CASE WHEN o_orderkey % 2 = 0 THEN ',"SystemGovernment_Localised":"Feudal"' ELSE '' END, '}}') AS json FROM orders"""


@query("SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'Feudal' ELSE concat('Feudal_', o_orderkey % 3) END AS government FROM orders", head="")
def localised_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.systems(translate.messages(fixtures._view(spark, sf_dir, _JUMPS), schema=_SCHEMA)).select("seq", "government")


_TOLD = """SELECT o_orderkey AS seq, concat('{"$schemaRef":"https://x/journal/1","message":{"event":"', CASE WHEN o_orderkey % 2 = 0 THEN 'CarrierJump' ELSE 'Docked' END, '","SystemAddress":', o_custkey, ',"StarSystem":"S","MarketID":', o_orderkey, ',"StationName":"T","SystemAllegiance":"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Empire' END,
 '","Population":', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '.5' ELSE '' END, ',"SystemEconomy":"$economy_Refinery;","SystemSecondEconomy_Localised":"Tourism","SystemSecurity":', CASE WHEN o_orderkey % 3 = 0 THEN '7' ELSE '"$SYSTEM_SECURITY_high;"' END, ',"SystemFaction":{"Name":"F', o_custkey % 9, '"},"Factions":', CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '[1,{"a":2}]' END,
 ',"PowerplayState":"Fortified","ControllingPower":"P","PowerplayStateControlProgress":0.25,"PowerplayStateReinforcement":', o_orderkey, ',"Powers":["P"],"ThargoidWar":{"n":1},"timestamp":"t', o_orderkey, '","StationType":"Coriolis","DistFromStarLS":', o_orderkey, '.5,"StationAllegiance":"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Empire' END,
 '","StationGovernment":"$government_Prison;","StationEconomy":"$economy_X_Y;","StationEconomy_Localised":"Xy","StationFaction":{"Name":"N"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"FactionState":"Boom"' END, '},"LandingPads":{"Large":', o_orderkey % 4, '},"StationEconomies":', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '[{"Proportion":1}]' END, '}}') AS json FROM orders"""


@query("""SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN 'Empire' END AS allegiance, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS population, 'Refinery' AS "primaryEconomy", 'Tourism' AS "secondaryEconomy", CASE WHEN o_orderkey % 3 <> 0 THEN 'SECURITY_high' END AS security,
 concat('{"Name":"F', o_custkey % 9, '"}') AS "controllingFaction", CASE WHEN o_orderkey % 4 <> 0 THEN '[1,{"a":2}]' END AS factions, 'Fortified' AS "powerState", 'P' AS "controllingPower", CAST(0.25 AS DOUBLE) AS "powerStateControlProgress", CAST(o_orderkey AS DOUBLE) AS "powerStateReinforcement",
 CAST(NULL AS DOUBLE) AS "powerStateUndermining", '["P"]' AS powers, '{"n":1}' AS "thargoidWar", concat('t', o_orderkey) AS date FROM orders WHERE o_orderkey % 2 = 0""", head="")
def jump_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a jump says of its system beside its place."""
    found = translate.systems(translate.messages(fixtures._view(spark, sf_dir, _TOLD), schema=_SCHEMA)).where("powerState is not null")
    return found.select("seq", "allegiance", "population", "primaryEconomy", "secondaryEconomy", "security", "controllingFaction", "factions", "powerState", "controllingPower", "powerStateControlProgress", "powerStateReinforcement", "powerStateUndermining", "powers", "thargoidWar", "date")


@query("""SELECT o_orderkey AS id, o_orderkey AS "marketId", 'T' AS name, 'Coriolis' AS type, o_orderkey + CAST(0.5 AS DOUBLE) AS "distanceToArrival", CASE WHEN o_orderkey % 3 <> 0 THEN 'Empire' END AS allegiance, 'Prison' AS government, 'Xy' AS economy, 'N' AS "controllingFaction",
 CASE WHEN o_orderkey % 3 <> 0 THEN 'Boom' END AS "controllingFactionState", concat('{"Large":', o_orderkey % 4, '}') AS "landingPads", CASE WHEN o_orderkey % 5 <> 0 THEN '[{"Proportion":1}]' END AS economies, concat('t', o_orderkey) AS "updateTime" FROM orders WHERE o_orderkey % 2 <> 0""", head="")
def docked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a docking says of its station beside the services."""
    found = translate.stations(translate.messages(fixtures._view(spark, sf_dir, _TOLD), schema=_SCHEMA))
    return found.select("id", "marketId", "name", "type", "distanceToArrival", "allegiance", "government", "economy", "controllingFaction", "controllingFactionState", "landingPads", "economies", "updateTime")


_PLACES = "SELECT o_custkey % 50 AS id64, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS x, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey AS DOUBLE) END AS y, CAST(o_orderkey AS DOUBLE) AS z, o_orderkey AS seq FROM orders"


@query(f"SELECT id64, max(seq) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS whole, CAST(max(seq) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS DOUBLE) AS x, CAST(max(seq) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS DOUBLE) AS y, CAST(max(seq) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS DOUBLE) AS z, CAST(77 AS BIGINT) AS last_update FROM ({_PLACES}) p GROUP BY id64", head="")
def merge_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates come from one patch, and the time of the update is that of the import."""
    found = merge.fold(fixtures._view(spark, sf_dir, _PLACES), ["id64"], merge.SYSTEM_RULES, now=F.lit(77).cast("bigint"))
    return found.select("id64", F.col("x").cast("bigint").alias("whole"), "x", "y", "z", "last_update")
