"""System documents as patches of systems, bodies and stations, with the strict coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.merge import split_services
from orrery.operators.translate import flag, flag_or_int, integer, json, number, shape, text, whole

JSON_COLUMNS = ("controllingFaction", "factions", "powers", "powerConflictProgress", "thargoidWar")
BODY_TEXT = ("name", "type", "subType", "volcanismType", "atmosphereType", "terraformingState", "luminosity", "spectralClass", "reserveLevel", "updateTime")
BODY_NUMBERS = ("distanceToArrival", "gravity", "earthMasses", "radius", "orbitalPeriod", "semiMajorAxis", "orbitalEccentricity", "orbitalInclination", "argOfPeriapsis", "rotationalPeriod", "absoluteMagnitude", "surfacePressure", "ascendingNode", "meanAnomaly", "solarRadius")
BODY_JSON = ("atmosphereComposition", "rings", "parents", "signals", "materials", "belts")
STATION_TEXT = ("name", "type", "allegiance", "government", "updateTime", "realName", "carrierName", "controllingFaction", "controllingFactionState", "state", "carrierDockingAccess")
STATION_JSON = ("landingPads", "economies", "market", "shipyard", "outfitting")


def _seq(df: DataFrame) -> list[str]:
    return ["seq"] if "seq" in df.columns else []


def systems(documents: DataFrame) -> DataFrame:
    plain = [c for c in documents.columns if c not in ("coords", "bodies", "stations", "seq", *JSON_COLUMNS)]
    texts = [F.to_json(c).alias(c) for c in JSON_COLUMNS if c in documents.columns]
    return documents.select(*plain, *texts, "coords.x", "coords.y", "coords.z", *_seq(documents))


def _present(v: Column, path: str) -> Column:
    return shape(v, path).isNotNull()


def bodies(documents: DataFrame) -> DataFrame:
    b = F.col("b")
    rows = documents.select(F.col("id64").alias("systemId64"), F.explode("bodies").alias("b"), *_seq(documents))
    out = {c: text(b, f"$.{c}") for c in BODY_TEXT} | {c: number(b, f"$.{c}") for c in BODY_NUMBERS} | {c: json(b, f"$.{c}") for c in BODY_JSON}
    out |= {
        "isLandable": flag(b, "$.isLandable"), "isTidallyLocked": flag(b, "$.rotationalPeriodTidallyLocked"), "axisTilt": number(b, "$.axialTilt"), "age": integer(b, "$.age"), "subclass": integer(b, "$.subclass"),
        "surfaceTemperature": whole(b, "$.surfaceTemperature"),
        "stellarMass": F.coalesce(number(b, "$.solarMasses"), number(b, "$.stellarMass")),
        "composition": F.when(_present(b, "$.solidComposition"), json(b, "$.solidComposition")).otherwise(json(b, "$.composition")),
        "wasDiscovered": flag_or_int(b, "$.wasDiscovered"), "wasMapped": flag_or_int(b, "$.wasMapped"), "bodyId64": integer(b, "$.id64"), "mainStar": flag_or_int(b, "$.mainStar"),
    }
    return rows.select("systemId64", integer(b, "$.bodyId").alias("bodyId"), *[c.alias(k) for k, c in out.items()], *_seq(documents))


def stations(documents: DataFrame) -> DataFrame:
    s = F.col("s")
    rows = documents.select(F.col("id64").alias("systemId64"), F.explode("stations").alias("s"), *_seq(documents))
    services = F.transform(F.try_variant_get(s, "$.services", "array<variant>"), lambda v: text(v, "$"))
    out = {c: text(s, f"$.{c}") for c in STATION_TEXT} | {c: json(s, f"$.{c}") for c in STATION_JSON} | split_services(services)
    out |= {"marketId": integer(s, "$.marketId"), "distanceToArrival": number(s, "$.distanceToArrival"), "economy": text(s, "$.primaryEconomy"), "secondEconomy": text(s, "$.secondaryEconomy"), "latitude": number(s, "$.latitude"), "longitude": number(s, "$.longitude")}
    return rows.select("systemId64", integer(s, "$.id").alias("id"), *[c.alias(k) for k, c in out.items()], *_seq(documents))
