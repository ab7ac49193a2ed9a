"""Sources: dumps of system documents, pushed documents, and compressed live frames."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .dump import scan_dump

PUSH_LIMIT = 10_000
DOCUMENT = """id64 bigint, name string, population bigint, coords struct<x:double,y:double,z:double>, bodies array<variant>, stations array<variant>,
 allegiance string, government string, primaryEconomy string, secondaryEconomy string, security string, bodyCount bigint, date string,
 controllingFaction variant, factions variant, powerState string, powers variant, controllingPower string, powerStateControlProgress double,
 powerStateReinforcement double, powerStateUndermining double, powerConflictProgress variant, thargoidWar variant"""


def read_dump(spark: SparkSession, path: str, partitions: int | None = None, members: bool = False) -> DataFrame:
    """Documents of a dump, with ``seq`` in its order; those that can't be read are left out.

    A gzip file is one task's to unpack (see ``dump``), so its texts are dealt out before they are parsed.
    """
    rows = scan_dump(spark, path, members)
    return documents(rows.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))))


def documents(rows: DataFrame) -> DataFrame:
    """Documents parsed from a column ``json``; those without id or name are skipped."""
    parsed = rows.withColumn("d", F.from_json("json", DOCUMENT, {"mode": "PERMISSIVE"}))
    return parsed.select("d.*", *[c for c in rows.columns if c != "json"]).where("id64 is not null and name is not null")


def dump_time(listing: Column, file: str) -> Column:
    """The first time stamp within 800 characters after a file's name in an index page, to tell a changed dump."""
    name = re.escape(file)
    return F.nullif(F.regexp_extract(listing, rf"(?s){name}.{{0,800}}?(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}})", 1), F.lit(""))


def pushed(rows: DataFrame, limit: int = PUSH_LIMIT) -> DataFrame:
    """A pushed batch of 1 to ``limit`` documents; anything unreadable is an error."""
    n = rows.limit(limit + 1).count()
    if not 1 <= n <= limit:
        raise ValueError(f"a batch has 1 to {limit} documents")
    found = documents(rows)
    if found.count() < n:
        raise ValueError("a document can't be read")
    return found


def coordinate(value: Column) -> Column:
    """Numbers, or numbers as text; else 0."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


@F.pandas_udf(StringType())
def inflate(frames: pd.Series) -> pd.Series:
    """zlib frames as text; null for those that aren't."""

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else zlib.decompress(raw).decode()
        except (zlib.error, UnicodeDecodeError):
            return None

    return frames.map(one)


@F.pandas_udf(BinaryType())
def deflate(texts: pd.Series) -> pd.Series:
    """Texts as zlib frames."""
    return texts.map(lambda t: None if t is None else zlib.compress(t.encode()))
