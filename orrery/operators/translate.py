"""Live journal events as catalogue patches, on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import scalars as S

# Event kinds, and fields that are copied under another name.
JOURNAL, JUMPS = "https://eddn.edcd.io/schemas/journal/", ("FSDJump", "Location", "CarrierJump")
SCAN_FIELDS = {
    "distanceToArrival": ("DistanceFromArrivalLS", "double"), "surfaceTemperature": ("SurfaceTemperature", "whole"), "orbitalEccentricity": ("Eccentricity", "double"),
    "orbitalInclination": ("OrbitalInclination", "double"), "argOfPeriapsis": ("Periapsis", "double"), "isTidallyLocked": ("TidalLock", "flag"), "axisTilt": ("AxialTilt", "double"),
    "ascendingNode": ("AscendingNode", "double"), "meanAnomaly": ("MeanAnomaly", "double"), "wasDiscovered": ("WasDiscovered", "int"), "wasMapped": ("WasMapped", "int"),
    "volcanismType": ("Volcanism", "string"), "terraformingState": ("TerraformState", "string"), "atmosphereComposition": ("AtmosphereComposition", "json"),
    "composition": ("Composition", "json"), "materials": ("Materials", "json"), "rings": ("Rings", "json"), "parents": ("Parents", "json"), "stellarMass": ("StellarMass", "double"),
    "absoluteMagnitude": ("AbsoluteMagnitude", "double"), "age": ("Age_MY", "bigint"), "luminosity": ("Luminosity", "string"), "subclass": ("Subclass", "bigint"),
    "reserveLevel": ("ReserveLevel", "string"), "earthMasses": ("MassEM", "double"), "isLandable": ("Landable", "flag"),
}


def shape(v: Column, path: str) -> Column:
    """Type of what stands at a path, upper case; null if nothing stands there, VOID for JSON's null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    """Strings only."""
    return F.when(shape(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def integer(v: Column, path: str) -> Column:
    """Integer numbers only."""
    return F.when(shape(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def number(v: Column, path: str) -> Column:
    """Any number, no strings."""
    kind = shape(v, path)
    return F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, path, "double"))


def whole(v: Column, path: str) -> Column:
    """Any number, rounded half away from zero where it isn't an integer."""
    return F.coalesce(integer(v, path), F.round(number(v, path)).cast("bigint"))


def _boolean(v: Column, path: str) -> Column:
    return F.when(shape(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("int"))


def flag(v: Column, path: str) -> Column:
    """A boolean as 1 or 0; anything else, or nothing, is 0."""
    return F.coalesce(_boolean(v, path), F.lit(0))


def flag_or_int(v: Column, path: str) -> Column:
    return F.coalesce(_boolean(v, path), integer(v, path).cast("int"))


def json(v: Column, path: str) -> Column:
    """Whatever stands there as JSON text, null for JSON's null."""
    return F.when(shape(v, path) != "VOID", F.to_json(F.try_variant_get(v, path, "variant")))


_READ = {"double": number, "bigint": integer, "string": text, "flag": flag, "whole": whole, "int": flag_or_int, "json": json}


def once(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with columns that are computed once: a generator stands between them and what reads them, so that
    filters aren't pushed below it with a copy of the expression each."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def read(frames: DataFrame, payload: str = "json", schema: str = JOURNAL) -> DataFrame:
    """All ``frames`` with event, id64, system and the message as a VARIANT; ``_unread`` where the payload isn't JSON, ``_named``
    where it is a journal message (its frame's schema begins with ``schema``) that names a system."""
    rows = once(frames, _v=F.try_parse_json(F.col(payload)))
    rows = once(rows, _schema=text(F.col("_v"), "$['$schemaRef']"), message=F.try_variant_get("_v", "$.message", "variant"), _unread=F.col("_v").isNull()).drop("_v")
    m = F.col("message")
    rows = once(rows, event=text(m, "$.event"), id64=integer(m, "$.SystemAddress"), system=text(m, "$.StarSystem"))
    named = F.col("_schema").startswith(schema) & F.col("event").isNotNull() & F.col("id64").isNotNull() & (F.col("system") != "")
    return rows.withColumn("_named", F.coalesce(named, F.lit(False))).drop("_schema")


def messages(frames: DataFrame, payload: str = "json", schema: str = JOURNAL) -> DataFrame:
    """Journal messages that name a system: event, id64, system and the message as a VARIANT.  A frame's schema begins with ``schema``."""
    return read(frames, payload, schema).where("_named").drop("_named", "_unread")


def placed(m: Column) -> Column:
    """Whether a message has three numbers as its place."""
    place = [number(m, f"$.StarPos[{i}]").isNotNull() for i in range(3)]
    return place[0] & place[1] & place[2] & shape(m, "$.StarPos[3]").isNull()


def of_body(m: Column) -> Column:
    """Whether a message tells of a body: a scan with its number and name, or found signals with its number."""
    scan = (F.col("event") == "Scan") & text(m, "$.BodyName").isNotNull()
    return (scan | ((F.col("event") == "SAASignalsFound") & json(m, "$.Signals").isNotNull())) & integer(m, "$.BodyID").isNotNull()


def of_station(m: Column) -> Column:
    """Whether a message tells of a station: a docking with its market and name."""
    return (F.col("event") == "Docked") & integer(m, "$.MarketID").isNotNull() & text(m, "$.StationName").isNotNull()


def handled(m: Column) -> Column:
    """Whether a message gives anything: a jump, or one that tells of a body or a station."""
    return F.col("event").isin(*JUMPS) | F.coalesce(of_body(m), F.lit(False)) | F.coalesce(of_station(m), F.lit(False))


def _localised(name: str) -> Column:
    return S.localised(text(F.col("message"), f"$.{name}_Localised"), text(F.col("message"), f"$.{name}"))


def systems(rows: DataFrame) -> DataFrame:
    """Patches of systems: every message that is handled names one and its place, only jumps say more."""
    m, jump = F.col("message"), F.col("event").isin(*JUMPS)
    place = [number(m, f"$.StarPos[{i}]") for i in range(3)]
    place = {c: F.when(placed(m), p) for c, p in zip("xyz", place, strict=True)}
    said = {
        "population": integer(m, "$.Population"), "allegiance": F.nullif(text(m, "$.SystemAllegiance"), F.lit("")), "government": _localised("SystemGovernment"),
        "primaryEconomy": _localised("SystemEconomy"), "secondaryEconomy": _localised("SystemSecondEconomy"), "security": _localised("SystemSecurity"),
        "controllingFaction": json(m, "$.SystemFaction"), "factions": json(m, "$.Factions"), "powers": json(m, "$.Powers"), "powerState": text(m, "$.PowerplayState"),
        "controllingPower": text(m, "$.ControllingPower"), "powerStateControlProgress": number(m, "$.PowerplayStateControlProgress"),
        "powerStateReinforcement": number(m, "$.PowerplayStateReinforcement"), "powerStateUndermining": number(m, "$.PowerplayStateUndermining"),
        "powerConflictProgress": json(m, "$.PowerplayConflictProgress"), "thargoidWar": json(m, "$.ThargoidWar"), "date": text(m, "$.timestamp"),
    }
    return rows.where(handled(m)).select("id64", F.col("system").alias("name"), *[c.alias(k) for k, c in place.items()], *[F.when(jump, c).alias(k) for k, c in said.items()], *[c for c in ("seq",) if c in rows.columns])


def bodies(rows: DataFrame) -> DataFrame:
    """Patches of bodies from scans and found signals."""
    m, scan = F.col("message"), F.col("event") == "Scan"
    planet, star = text(m, "$.PlanetClass"), text(m, "$.StarType")
    is_star = planet.isNull() & star.isNotNull()
    copied = {k: _READ[how](m, f"$.{source}") for k, (source, how) in SCAN_FIELDS.items()}
    flags = {k for k, (_, how) in SCAN_FIELDS.items() if how == "flag"}
    said = copied | {
        "surfacePressure": number(m, "$.SurfacePressure") / S.PASCALS_AN_ATMOSPHERE, "orbitalPeriod": number(m, "$.OrbitalPeriod") / S.SECONDS_A_DAY,
        "semiMajorAxis": number(m, "$.SemiMajorAxis") / S.METRES_AN_AU, "rotationalPeriod": number(m, "$.RotationPeriod") / S.SECONDS_A_DAY,
        "atmosphereType": F.coalesce(F.nullif(text(m, "$.AtmosphereType"), F.lit("")), F.nullif(text(m, "$.Atmosphere"), F.lit(""))),
        "type": F.when(planet.isNotNull(), F.lit("Planet")).when(is_star, F.lit("Star")), "subType": F.when(planet.isNotNull(), planet).when(is_star, S.star_name(star)),
        "spectralClass": F.when(is_star, star), "mainStar": F.when(is_star & (integer(m, "$.BodyID") == 0), F.lit(1)),
        "solarRadius": F.when(is_star, number(m, "$.Radius") / S.SOLAR_RADIUS), "gravity": number(m, "$.SurfaceGravity") / S.GRAVITY, "radius": number(m, "$.Radius") / S.METRES_A_KM,
    }
    found = rows.where(of_body(m))
    values = [(F.when(scan, c).otherwise(0) if k in flags else F.when(scan, c)).alias(k) for k, c in said.items()]
    return found.select(F.col("id64").alias("systemId64"), integer(m, "$.BodyID").alias("bodyId"), text(m, "$.BodyName").alias("name"), *values, F.when(~scan, json(m, "$.Signals")).alias("signals"), text(m, "$.timestamp").alias("updateTime"), *[c for c in ("seq",) if c in rows.columns])


def stations(rows: DataFrame) -> DataFrame:
    """Patches of stations from dockings."""
    m = F.col("message")
    found = rows.where(of_station(m))
    services = F.try_variant_get(m, "$.StationServices", "array<string>")
    from .merge import split_services

    said = {
        "marketId": integer(m, "$.MarketID"), "name": text(m, "$.StationName"), "type": text(m, "$.StationType"), "distanceToArrival": number(m, "$.DistFromStarLS"),
        "allegiance": F.nullif(text(m, "$.StationAllegiance"), F.lit("")), "government": _localised("StationGovernment"), "economy": _localised("StationEconomy"),
        **split_services(services), "controllingFaction": text(m, "$.StationFaction.Name"), "controllingFactionState": text(m, "$.StationFaction.FactionState"),
        "landingPads": json(m, "$.LandingPads"), "economies": json(m, "$.StationEconomies"), "updateTime": text(m, "$.timestamp"),
    }
    return found.select(F.col("id64").alias("systemId64"), integer(m, "$.MarketID").alias("id"), *[c.alias(k) for k, c in said.items()], *[c for c in ("seq",) if c in rows.columns])
