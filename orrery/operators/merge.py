"""Upserts as folds: for every key the values of its patches in order of arrival.

Each rule is one aggregate, so a state and a batch fold alike: the state is a patch that arrived
first.  Partial aggregation keeps one row a key and task before the only shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[str, str], Column]


def last_known(column: str, seq: str) -> Column:
    """The last value that isn't null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(seq)))


def last_given(column: str, seq: str) -> Column:
    """The last value; a missing one counts as 0, so a partial patch resets it."""
    return F.max_by(F.coalesce(F.col(column), F.lit(0)), F.col(seq))


def last_positive(column: str, seq: str) -> Column:
    """The last value above 0, else 0."""
    return F.coalesce(F.max_by(F.col(column), F.when(F.col(column) > 0, F.col(seq))), F.lit(0).cast("bigint"))


def sticky(column: str, seq: str) -> Column:
    """1 once it has been 1."""
    return F.max(F.coalesce(F.col(column), F.lit(0)))


def last_filled(column: str, seq: str) -> Column:
    """The last JSON array that isn't empty, else the empty one."""
    filled = F.col(column).isNotNull() & (F.col(column) != "[]")
    return F.coalesce(F.max_by(F.col(column), F.when(filled, F.col(seq))), F.lit("[]"))


SYSTEM_RULES: dict[str, Rule] = {"population": last_positive}
BODY_RULES: dict[str, Rule] = {"isLandable": last_given, "isTidallyLocked": last_given}
STATION_RULES: dict[str, Rule] = {"haveMarket": sticky, "haveShipyard": sticky, "haveOutfitting": sticky, "otherServices": last_filled}


#: Columns that come from one patch: the last that has them all.
PLACE = ("x", "y", "z")


def _together(columns: tuple[str, ...], seq: str) -> dict[str, Column]:
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    last = F.max_by(F.struct(*columns), F.when(whole, F.col(seq)))
    return {c: last[c] for c in columns}


def fold(patches: DataFrame, keys: list[str], rules: dict[str, Rule], seq: str = "seq", keep_seq: bool = False, now: Column | None = None) -> DataFrame:
    """One row a key.  Rows with a null in the key are dropped; columns without a rule keep the last known value.

    Coordinates are replaced as a whole; with ``now``, ``last_update`` is that, whatever the patches say.
    """
    known = patches
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    values = [c for c in patches.columns if c not in keys and c != seq and not (now is not None and c == "last_update")]
    place = _together(PLACE, seq) if set(PLACE) <= set(values) else {}
    out = [(place[c] if c in place else rules.get(c, last_known)(c, seq)).alias(c) for c in values]
    if now is not None:
        out.append(F.max(now).alias("last_update"))
    return known.groupBy(*keys).agg(*out, *([F.max(seq).alias(seq)] if keep_seq else []))


def upsert(state: DataFrame | None, batch: DataFrame, keys: list[str], rules: dict[str, Rule], seq: str = "seq") -> DataFrame:
    """State and batch folded, the state as a patch that arrived before any of the batch.  New columns may appear."""
    every = batch if state is None else state.withColumn(seq, F.lit(-(1 << 62)).cast("bigint")).unionByName(batch, allowMissingColumns=True)
    return fold(every, keys, rules, seq, keep_seq=True)


def split_services(services: Column) -> dict[str, Column]:
    """Flags of three services, and the JSON array of the rest without the two docking ones."""
    flag = lambda name: F.coalesce(F.array_contains(services, name), F.lit(False)).cast("int")
    rest = F.filter(F.coalesce(services, F.array().cast("array<string>")), lambda s: s.isNotNull() & ~s.isin("Market", "Shipyard", "Outfitting", "Dock", "Autodock"))
    return {"haveMarket": flag("Market"), "haveShipyard": flag("Shipyard"), "haveOutfitting": flag("Outfitting"), "otherServices": F.to_json(rest)}


def neutron_systems(patches: DataFrame) -> DataFrame:
    """Systems of any neutron star, also of rows whose own key is incomplete."""
    return patches.where((F.col("subType") == "Neutron Star") & F.col("systemId64").isNotNull()).select("systemId64").distinct()


def backfilled(target: DataFrame, source: DataFrame) -> DataFrame:
    """``target``, or the rows of ``source`` where it is empty: the gate is one row, so the source isn't read otherwise."""
    return target.unionByName(source.select(*target.columns).join(F.broadcast(target.select(F.lit(True).alias("_any")).limit(1)), F.lit(True), "left_anti"))


def prison_systems(stations: DataFrame, systems: DataFrame | None = None) -> DataFrame:
    """Systems whose own government, or that of a station, holds ``rison``."""
    found = stations.where(F.lower("government").contains("rison")).select("systemId64")
    if systems is not None:
        found = found.union(systems.where(F.lower("government").contains("rison")).select("id64"))
    return found.where(F.col("systemId64").isNotNull()).distinct()
