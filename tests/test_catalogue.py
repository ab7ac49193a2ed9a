"""Every catalogue query against its SQL, and hand-written cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from orrery.operators import cube_filter, heatmap, merge, routing, search, translate
from orrery.plans import catalogue
from orrery.sources import feeds, patches
from orrery.streaming import live

SF = "/root/testdata/sf0.001"
#: Customers are few at this scale, so some routes don't exist.
SPARSE = {"carrier_greedy", "carrier_route", "neutron_greedy", "neutron_route", "neutron_bfs_hops"}


def norm(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


def _duck(sf):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return _duck(SF)


@pytest.mark.parametrize("name", sorted(SPARSE))
def test_sparse_query_equals_sql(spark, name):
    _compare(spark, "/root/testdata/sf0.01", _duck("/root/testdata/sf0.01"), name)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - SPARSE))
def test_query_equals_sql(spark, duck, name):
    _compare(spark, SF, duck, name)


def _compare(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i].lower())
    got = sorted(tuple(norm(r[i]) for i in order) for r in df.collect())
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    there = sorted(range(len(names)), key=lambda i: names[i].lower())
    assert [df.columns[i].lower() for i in order] == [names[i].lower() for i in there]
    assert got == sorted(tuple(norm(r[i]) for i in there) for r in cursor.fetchall())


def test_filter_grammar():
    f = cube_filter.parse("White Dwarf DA Star")
    assert f.wanted == ["White Dwarf (DA) Star", "A (Blue-White) Star", "A (Blue-White super giant) Star"] and len(f.needed) == 2
    assert cube_filter.parse("white dwarf").prefixes == ["White Dwarf"]
    assert cube_filter.parse("white dwarf dav").wanted == ["White Dwarf (DAV) Star"]
    assert cube_filter.parse("ms star type").wanted == ["MS-type Star", "S-type Star"]
    assert set(cube_filter.parse("wolf-rayet o star").wanted) == {"Wolf-Rayet O Star", "O (Blue-White) Star"}
    assert cube_filter.parse("supermassive black hole").wanted == ["Supermassive Black Hole"]
    assert cube_filter.parse("metal ring").ring == "" and cube_filter.parse("metallic ring").ring == "Metallic"
    assert not cube_filter.parse("nothing known").any


def test_merge_rules(spark):
    rows = spark.createDataFrame([(1, 0, 1, "a", 1, 100, '["Missions"]'), (1, 0, 2, None, None, 0, "[]"), (None, 0, 3, "x", 1, 1, "[]")], "s int, b int, seq int, v string, isLandable int, population bigint, otherServices string")
    rules = merge.BODY_RULES | merge.SYSTEM_RULES | merge.STATION_RULES
    assert [tuple(r) for r in merge.fold(rows, ["s", "b"], rules).collect()] == [(1, 0, "a", 0, 100, '["Missions"]')]
    first, second = rows.where("seq = 1"), rows.where("seq = 2")
    twice = merge.upsert(merge.upsert(None, first, ["s", "b"], rules), second, ["s", "b"], rules)
    assert twice.drop("seq").collect() == merge.fold(rows, ["s", "b"], rules).collect()


def test_documents_to_patches(spark, tmp_path):
    lines = ['{"id64": 1, "name": "Sol", "population": 5, "coords": {"x": 1, "y": 2, "z": 3}, "bodies": [{"bodyId": 3, "isLandable": true, "surfaceTemperature": 2.5, "rings": [{"t": 1}]}, {"subType": "Neutron Star", "isLandable": 1}], "stations": [{"id": 9, "government": "PRISON COLONY", "services": ["Market", "Dock", "Missions"]}]}', "{broken"]
    (tmp_path / "d.json").write_text("\n".join(lines))
    docs = feeds.read_dump(spark, str(tmp_path / "d.json"))
    assert docs.count() == 1
    b = {r.bodyId: r for r in patches.bodies(docs).collect()}
    assert (b[3].isLandable, b[3].surfaceTemperature, b[3].rings, b[None].isLandable) == (1, 3, '[{"t":1}]', 0)
    assert merge.neutron_systems(patches.bodies(docs)).collect()[0][0] == 1
    st = patches.stations(docs)
    assert [tuple(r) for r in st.select("haveMarket", "haveShipyard", "otherServices").collect()] == [(1, 0, '["Missions"]')]
    assert merge.prison_systems(st, patches.systems(docs)).count() == 1
    with pytest.raises(ValueError):
        feeds.pushed(spark.createDataFrame([(x,) for x in lines], "json string"))


def test_frames(spark):
    import zlib

    good = zlib.compress(b'{"$schemaRef":"https://a/journal/1","message":{"event":"SAASignalsFound","SystemAddress":5,"StarSystem":"S","BodyID":2,"Signals":[1]}}')
    rows = spark.createDataFrame([(bytearray(good),), (bytearray(b"no"),), (None,)], "frame binary").select(feeds.inflate("frame").alias("json"))
    found = translate.bodies(translate.messages(rows, schema="https://a/journal/"))
    assert [tuple(r) for r in found.select("systemId64", "bodyId", "signals", "isLandable").collect()] == [(5, 2, "[1]", 0)]


def test_grid_join_equals_brute_force(spark):
    pts = spark.range(300).select(F.col("id").alias("id64"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 10.0).alias(c) for c in "xyz"])
    a = pts.toPandas()
    want = {(i, j) for i in range(300) for j in range(300) if i != j and sum((a.loc[i, c] - a.loc[j, c]) ** 2 for c in "xyz") <= 144.0}
    assert {(r.a, r.b) for r in search.grid_join(pts, pts, 12.0).collect()} == want


def test_render(spark):
    line = spark.createDataFrame([(i, f"S{i}", 10.0 * i, 0.0, 0.0) for i in range(8)], "id64 bigint, name string, x double, y double, z double")
    last = routing.render(line, [0, 2, 7]).orderBy("step").collect()[-1]
    assert (last.distance_from_prev, last.distance_from_start, last.jump_distance) == (50.0, 70.0, 0.0)


def test_dump_time(spark):
    page = spark.createDataFrame([("<a>x.json.gz</a> 2024-01-02 03:04:05 <a>y.gz</a> 2025-01-01 00:00:00",), ("none",)], "t string")
    assert [r[0] for r in page.select(feeds.dump_time(F.col("t"), "x.json.gz")).collect()] == ["2024-01-02 03:04:05", None]


def test_heat(spark):
    pts = spark.createDataFrame([(-50000.0, 0.0), (50000.0, 0.0), (float("nan"), 0.0), (None, 0.0)], "x double, z double")
    assert [tuple(r) for r in heatmap.bins(pts).collect()] == [(0, 256, 1)]
    cells = spark.createDataFrame([(1,), (100,), (138,), (139,)], "n bigint")
    assert [r[0] for r in cells.select(heatmap.decayed(F.col("n"), 1)).collect()] == [0, 99, 137, 137]
    timed = spark.createDataFrame([(0.0, 0.0, 0)] * 200 + [(0.0, 0.0, 2)] * 5, "x double, z double, tick int")
    assert live.heat_over_time(timed, F.col("tick"), 3).first().n == int(int(int(int(200 * 0.9928057) * 0.9928057) + 5) * 0.9928057)


def test_picture(spark):
    """Decoded, the picture has the colour of each cell at its place and nothing elsewhere."""
    import struct
    import zlib

    import numpy as np

    cells = [(0, 0, 1), (1023, 1023, 9), (5, 700, 400), (6, 700, 400)]
    grid = spark.createDataFrame(cells, "gx int, gz int, n bigint")
    raw, at, parts = heatmap.png(grid), 8, {}
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        parts[kind] = raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + parts[kind])
        at += n + 12
    assert struct.unpack(">2I5B", parts[b"IHDR"]) == (1024, 1024, 8, 6, 0, 0, 0)
    image = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(1024, 1 + 4096)
    assert not image[:, 0].any()
    image = image[:, 1:].reshape(1024, 1024, 4).copy()
    for gx, gz, n in cells:
        t = math.log(n + 1) / math.log(401)
        piece = min(int(t * 8), 7)
        low, high, f = heatmap.STOPS[piece], heatmap.STOPS[piece + 1], t * 8 - piece
        want = [int(a + (b - a) * f) for a, b in zip(low, high, strict=True)] + [int(60 + 195 * t)]
        assert np.abs(image[1023 - gz, gx].astype(int) - want).max() <= 1
        image[1023 - gz, gx] = 0
    assert not image.any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "systemId64"


def test_push_bounds(spark):
    one = '{"id64": 1, "name": "a"}'
    rows = spark.range(10_001).select(F.lit(one).alias("json"))
    for bad in (rows, rows.limit(0)):
        with pytest.raises(ValueError):
            feeds.pushed(bad)
    assert feeds.pushed(rows.limit(10_000)).count() == 10_000
