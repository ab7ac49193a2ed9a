"""The driver's tables seen as a catalogue.  The same SQL text runs in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SYSTEMS = """
SELECT c_custkey AS id64, c_name AS name,
       ((c_custkey *    7919) % 2003) / CAST(8  AS DOUBLE) - 125.0 AS x,
       ((c_custkey *  104729) % 1009) / CAST(16 AS DOUBLE) -  31.5 AS y,
       ((c_custkey * 1299709) % 1999) / CAST(8  AS DOUBLE) - 125.0 AS z,
       CAST(floor(c_acctbal) AS BIGINT) AS population, c_mktsegment AS allegiance,
       CASE WHEN c_custkey % 50 = 0 THEN 'Prison colony' WHEN c_custkey % 3 > 0 THEN 'Democracy' END AS government
FROM customer"""
STATIONS = """
SELECT o_orderkey AS id, o_custkey AS systemId64, CASE WHEN o_orderkey % 13 = 0 THEN 'Drake-Class Carrier' ELSE o_orderpriority END AS type,
       CASE o_orderkey % 4 WHEN 0 THEN 'EMPIRE' WHEN 1 THEN 'Federation' END AS allegiance,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Prison' ELSE 'Democracy' END AS government,
       CASE o_orderkey % 5 WHEN 0 THEN 'Refinery' WHEN 1 THEN 'HIGH TECH' ELSE 'Tourism' END AS economy,
       CASE WHEN o_orderkey % 11 = 0 THEN CAST(12.5 AS DOUBLE) END AS latitude,
       CASE o_orderkey % 3
         WHEN 0 THEN concat('{"large":', CAST(o_orderkey % 4 AS VARCHAR(9)), '}')
         WHEN 1 THEN concat('{"Large":', CAST(o_orderkey % 4 AS VARCHAR(9)), ',"medium":2}') END AS landingPads,
       o_totalprice AS distanceToArrival
FROM orders"""
BODY_PATCHES = """
SELECT o_custkey AS systemId64, l_orderkey * 8 + l_linenumber AS bodyId,
       concat(c_name, ' ', p_brand) AS name,
       CASE p_type WHEN 'ECONOMY' THEN 'Neutron Star' WHEN 'PROMO' THEN 'Water world'
                   WHEN 'LARGE' THEN 'Earth-like world' WHEN 'SMALL' THEN 'Icy body'
                   WHEN 'MEDIUM' THEN 'White Dwarf (DA) Star' ELSE 'Rocky body' END AS subType,
       CASE WHEN p_name LIKE '%ring' THEN '[{"type":"Icy"}]' END AS rings,
       CASE WHEN p_name LIKE '%gear' THEN '[{"type":"Biological"}]' END AS signals,
       CASE WHEN l_returnflag = 'R' THEN 'Terraformable' END AS terraformingState,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS isLandable,
       l_extendedprice AS distanceToArrival,
       (CAST(extract(year FROM l_shipdate) AS BIGINT) * 10000 + CAST(extract(month FROM l_shipdate) AS BIGINT) * 100
         + CAST(extract(day FROM l_shipdate) AS BIGINT)) * 10000000000 + l_partkey * 10000 + l_suppkey AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON c_custkey = o_custkey"""
# last value that isn't null, by arrival; isLandable is never null, so its last value counts
BODIES = f"""
SELECT systemId64, bodyId,
       {", ".join(f"MAX_BY({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("name", "subType", "rings", "signals", "terraformingState", "isLandable", "distanceToArrival"))}
FROM ({BODY_PATCHES}) AS p GROUP BY systemId64, bodyId"""
_TABLES = ("customer", "orders", "lineitem", "part", "events")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver's tables, bound as frames, so no name is left in the session."""
    return spark.sql(
        _named(sql), **{f"orrery_{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t}" in sql}
    )


def _named(sql: str) -> str:
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON texts aren't names
    for t in _TABLES:
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {t}", f"{word} {{orrery_{t}}}")
    return sql


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SYSTEMS)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, STATIONS)


def body_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, BODY_PATCHES)
