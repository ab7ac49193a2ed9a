"""Scalar expressions of the catalogue, all built-in Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Star codes and the names they stand for.
STAR_NAMES = {
    "O": "O (Blue-White) Star", "B": "B (Blue-White) Star", "A": "A (Blue-White) Star", "F": "F (White) Star", "G": "G (White-Yellow) Star",
    "K": "K (Yellow-Orange) Star", "M": "M (Red dwarf) Star", "L": "L (Brown dwarf) Star", "T": "T (Brown dwarf) Star", "Y": "Y (Brown dwarf) Star",
    "TTS": "T Tauri Star", "AeBe": "Herbig Ae/Be Star", "MS": "MS-type Star", "S": "S-type Star", "N": "Neutron Star", "H": "Black Hole",
    "X": "Exotic", "SupermassiveBlackHole": "Supermassive Black Hole",
    **dict.fromkeys(("W", "WN", "WNC", "WC", "WO"), "Wolf-Rayet Star"),
    **dict.fromkeys(("CS", "C", "CN", "CJ", "CH", "CHd"), "Carbon Star"),
    **dict.fromkeys(("D", "DA", "DAB", "DAO", "DAZ", "DAV", "DB", "DBZ", "DBV", "DO", "DOV", "DQ", "DC", "DCV", "DX"), "White Dwarf"),
}
# What raw units are divided by.
PASCALS_AN_ATMOSPHERE, SECONDS_A_DAY, METRES_AN_AU, GRAVITY, METRES_A_KM, SOLAR_RADIUS = 101325.0, 86400.0, 149_597_870_700.0, 9.80665, 1000.0, 695_700_000.0


def distance_squared(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return dx * dx + dy * dy + dz * dz


def distance(*six: Column) -> Column:
    return F.sqrt(distance_squared(*six))


def round_to(value: Column, places: int) -> Column:
    """Half away from zero after scaling as a double, which differs from decimal rounding."""
    scale = F.lit(10.0**places)
    return F.round(value * scale) / scale


def fold_case(text: Column) -> Column:
    """ASCII case only."""
    return F.translate(text, _UPPER, _LOWER)


def short_body_name(body: Column, system: Column) -> Column:
    rest = F.regexp_replace(F.replace(body, system, F.lit("")), r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    return F.when(rest == "", F.lit("A")).otherwise(rest)


def strip_token(token: Column) -> Column:
    """``$government_Prison_Colony;`` -> ``Prison_Colony``."""
    return F.regexp_replace(F.regexp_replace(token, r"^\$+|;+$", ""), r"^[^_]*_", "")


def localised(localised_text: Column, raw: Column) -> Column:
    return F.coalesce(localised_text, strip_token(raw))


def star_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STAR_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), code)


def yes_no(count: Column) -> Column:
    return F.when(count > 0, F.lit("Yes")).otherwise(F.lit("No"))


def large_or_medium_pads(pads: Column, size: str) -> Column:
    """Pads of a size, under either spelling of its key, or 0."""
    read = [F.get_json_object(pads, f"$.{key}").try_cast("double") for key in (size, size.capitalize())]
    return F.coalesce(*read, F.lit(0.0))


def line_progress(px: Column, py: Column, pz: Column, a: tuple, b: tuple) -> Column:
    """How far along the line from a to b, in percent with four places; 0 if the line has no length."""
    d = [v - u for u, v in zip(a, b, strict=True)]
    length = sum(x * x for x in d)
    if length == 0:
        return F.lit(0.0)
    dot = sum((p - F.lit(float(u))) * F.lit(float(x)) for p, u, x in zip((px, py, pz), a, d, strict=True))
    return round_to(dot / F.lit(float(length)) * 100.0, 4)


def in_box(x: Column, y: Column, z: Column, centre: tuple, half: float) -> Column:
    """Conjunction of ranges, which reaches the Parquet scan."""
    cond = F.lit(True)
    for c, m in zip((x, y, z), centre, strict=True):
        cond = cond & c.between(F.lit(float(m - half)), F.lit(float(m + half)))
    return cond


def in_capsule(x: Column, y: Column, z: Column, a: tuple, b: tuple, half: float) -> Column:
    """Within ``half`` of the segment a-b; its bounding box comes first, for the scan."""
    box = F.lit(True)
    for c, u, v in zip((x, y, z), a, b, strict=True):
        box = box & c.between(F.lit(float(min(u, v) - half)), F.lit(float(max(u, v) + half)))
    d = [float(v - u) for u, v in zip(a, b, strict=True)]
    length = sum(t * t for t in d)
    if length < 1:
        return box
    w = [c - F.lit(float(u)) for c, u in zip((x, y, z), a, strict=True)]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(p * F.lit(q) for p, q in zip(w, d, strict=True)) / F.lit(length)))
    return box & (sum((p - t * F.lit(q)) * (p - t * F.lit(q)) for p, q in zip(w, d, strict=True)) <= F.lit(float(half * half)))
