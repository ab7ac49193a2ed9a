"""The activity heatmap: counts by cell, decay, intensity and colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The grid, its domain, the decay of a tick and the stops of the colour map.
CELLS, X_MIN, X_MAX, Z_MIN, Z_MAX = 1024, -50_000.0, 50_000.0, -25_000.0, 75_000.0
DECAY, TICK_SECONDS = 0.9928057, 300
STOPS = ((0.0, 0.0, 4.0), (40.0, 11.0, 84.0), (96.0, 19.0, 110.0), (159.0, 42.0, 99.0), (212.0, 72.0, 66.0), (245.0, 125.0, 21.0), (250.0, 193.0, 39.0), (252.0, 255.0, 164.0), (252.0, 255.0, 164.0))


def cell(x: Column, z: Column) -> tuple[Column, Column, Column]:
    """Whether the point is inside, and its column and row."""
    inside = x.isNotNull() & z.isNotNull() & ~F.isnan(x) & ~F.isnan(z) & (x >= X_MIN) & (x < X_MAX) & (z >= Z_MIN) & (z < Z_MAX)
    place = lambda v, low, high: F.floor((v - F.lit(low)) / F.lit(high - low) * F.lit(float(CELLS))).cast("int")
    return inside, place(x, X_MIN, X_MAX), place(z, Z_MIN, Z_MAX)


def bins(points: DataFrame) -> DataFrame:
    """gx, gz, n of points (x, z) inside the domain."""
    inside, gx, gz = cell(F.col("x"), F.col("z"))
    return points.where(inside).groupBy(gx.alias("gx"), gz.alias("gz")).agg(F.count(F.lit(1)).alias("n"))


def decayed(count: Column, ticks: int) -> Column:
    """The count after some ticks; each multiplies and cuts off the fraction."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ticks)), count.cast("bigint"), lambda v, _: F.floor(v * F.lit(DECAY))) if ticks else count


def intensity(grid: DataFrame) -> DataFrame:
    """``grid`` with t, the logarithm of the count against that of the largest (one number, joined as a scalar)."""
    top = grid.agg(F.max("n").alias("top"))
    return grid.join(F.broadcast(top), F.lit(True)).withColumn("t", F.log(F.col("n") + 1.0) / F.greatest(F.log(F.col("top") + 1.0), F.lit(1.0))).drop("top")


def colour(t: Column) -> dict[str, Column]:
    """r, g, b, a in 0..255 by linear pieces, fractions cut off."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    piece = F.least(F.floor(t * 8).cast("int"), F.lit(7))
    f = t * 8 - piece
    out = {}
    for k, name in enumerate("rgb"):
        values = F.array(*[F.lit(s[k]) for s in STOPS])
        low, high = F.get(values, piece), F.get(values, piece + 1)
        out[name] = F.floor(low + (high - low) * f).cast("int")
    return out | {"a": F.floor(60.0 + t * 195.0).cast("int")}


def marker(x: Column, z: Column) -> tuple[Column, Column]:
    """left and top of a point on the image, in percent; high z is at the top."""
    return (x - X_MIN) / (X_MAX - X_MIN) * 100.0, (1.0 - (z - Z_MIN) / (Z_MAX - Z_MIN)) * 100.0


def png(grid: DataFrame) -> bytes:
    """The picture of a grid, whose size is fixed at CELLS squared."""
    import struct
    import zlib

    import numpy as np

    c = colour(F.col("t"))
    rows = intensity(grid).select("gx", "gz", *[v.alias(k) for k, v in c.items()]).toPandas()
    image = np.zeros((CELLS, CELLS, 4), np.uint8)
    image[CELLS - 1 - rows["gz"], rows["gx"]] = rows[["r", "g", "b", "a"]].to_numpy(np.uint8)
    raw = b"".join(b"\0" + line.tobytes() for line in image)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", CELLS, CELLS, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
