"""The filter grammar of the cube search: phrases found anywhere in a text become conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of the grammar and the body types each asks for.
PLANETS = {
    "earth-like": "Earth-like world", "water world": "Water world", "ammonia world": "Ammonia world", "high metal content": "High metal content world",
    "metal-rich body": "Metal-rich body", "rocky body": "Rocky body", "rocky ice world": "Rocky Ice world", "icy body": "Icy body",
    "class i gas giant": "Class I gas giant", "class ii gas giant": "Class II gas giant", "class iii gas giant": "Class III gas giant",
    "class iv gas giant": "Class IV gas giant", "class v gas giant": "Class V gas giant",
    "water-based life giant": "Gas giant with water-based life", "ammonia-based life giant": "Gas giant with ammonia-based life",
    "helium-rich gas giant": "Helium-rich gas giant", "helium gas giant": "Helium gas giant", "water giant": "Water giant",
    "neutron star": "Neutron Star", "supermassive black hole": "Supermassive Black Hole", "black hole": "Black Hole",
}
STARS = {
    "o star": ("O (Blue-White) Star",), "b star": ("B (Blue-White) Star", "B (Blue-White super giant) Star"), "a star": ("A (Blue-White) Star", "A (Blue-White super giant) Star"),
    "f star": ("F (White) Star", "F (White super giant) Star"), "g star": ("G (White-Yellow) Star", "G (White-Yellow super giant) Star"),
    "k star": ("K (Yellow-Orange) Star", "K (Yellow-Orange giant) Star"), "m star": ("M (Red dwarf) Star", "M (Red giant) Star", "M (Red super giant) Star"),
    "l dwarf": ("L (Brown dwarf) Star",), "t dwarf": ("T (Brown dwarf) Star",), "y dwarf": ("Y (Brown dwarf) Star",), "t tauri": ("T Tauri Star",),
    "herbig": ("Herbig Ae/Be Star",), "c star type": ("C Star",), "cj star type": ("CJ Star",), "cn star type": ("CN Star",), "ms star type": ("MS-type Star",), "s star type": ("S-type Star",),
}
WHITE_DWARFS = ("dab", "dav", "daz", "da", "dbv", "dbz", "db", "dcv", "dc", "dq", "d")
WOLF_RAYETS = ("c", "n", "nc", "o")
RINGS = {"icy ring": "Icy", "metallic ring": "Metallic", "metal rich ring": "Metal Rich", "rocky ring": "Rocky"}
#: A phrase yields to another that says more.
YIELDS = {"helium gas giant": "helium-rich gas giant", "black hole": "supermassive black hole"}


@dataclass
class Filter:
    """``wanted``: types (or LIKE prefixes) of which a body has one; ``needed``: sets of which a system has one of each."""

    wanted: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    needed: list[tuple[tuple[str, ...], str | None]] = field(default_factory=list)
    terraformable: bool = False
    biological: bool = False
    geological: bool = False
    landable: bool = False
    ring: str | None = None  # "" for any

    @property
    def any(self) -> bool:
        return bool(self.wanted or self.prefixes or self.terraformable or self.biological or self.geological or self.landable or self.ring is not None)

    def bodies(self) -> Column:
        """Condition on a body."""
        cond = F.lit(True)
        if self.wanted or self.prefixes:
            one = F.col("subType").isin(self.wanted) if self.wanted else F.lit(False)
            for p in self.prefixes:
                one = one | F.col("subType").ilike(p + "%")
            cond = cond & one
        if self.terraformable:
            cond = cond & F.col("terraformingState").isin("Terraformable", "Terraforming completed")
        if self.biological:
            cond = cond & F.col("signals").ilike("%Biological%")
        if self.geological:
            cond = cond & F.col("signals").ilike("%Geological%")
        if self.landable:
            cond = cond & (F.col("isLandable") == 1)
        if self.ring == "":
            cond = cond & F.col("rings").isNotNull() & (F.col("rings") != "[]")
        elif self.ring:
            cond = cond & F.col("rings").ilike(f'%"{self.ring}%')
        return cond

    def need(self, types: tuple[str, ...], prefix: str | None) -> Column:
        cond = F.col("subType").isin(list(types)) if types else F.lit(False)
        return cond | F.col("subType").ilike(prefix + "%") if prefix else cond


def parse(text: str | None) -> Filter:
    """Compile a filter text; phrases are independent of each other and of their place."""
    text, out = (text or "").lower(), Filter()

    def ask(types: tuple[str, ...], prefix: str | None = None) -> None:
        out.wanted += types
        out.prefixes += [prefix] if prefix else []
        out.needed.append((types, prefix))

    for phrase, name in PLANETS.items():
        if phrase in text and not (phrase in YIELDS and YIELDS[phrase] in text):
            ask((name,))
    codes = [c for c in WHITE_DWARFS if f"white dwarf {c}" in text]
    exact = [c for c in codes if not any(o != c and o.startswith(c) for o in codes)]
    for c in exact:
        ask((f"White Dwarf ({c.upper()}) Star",))
    if "white dwarf" in text and not exact:
        ask((), "White Dwarf")
    codes = [c for c in WOLF_RAYETS if f"wolf-rayet {c}" in text]
    exact = [c for c in codes if not (c in ("c", "n") and "nc" in codes)]
    for c in exact:
        ask((f"Wolf-Rayet {c.upper()} Star",))
    if "wolf-rayet" in text and not exact:
        ask((), "Wolf-Rayet")
    for phrase, names in STARS.items():
        if phrase in text:
            ask(names)
    out.terraformable, out.landable = "terraformable" in text, "landable" in text
    out.biological, out.geological = "bio" in text, "geo" in text
    out.ring = next((r for phrase, r in RINGS.items() if phrase in text), "" if "ring" in text else None)
    return out
