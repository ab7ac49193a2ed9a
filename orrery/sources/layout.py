"""Points stored in Z-order, so that a box or a capsule reads few files and row groups.

A point's code interleaves the bits of its three cell numbers.  Rows are ranged and sorted by the code when they are
written, and a manifest keeps the least and greatest code of each file.  A region becomes a few ranges of
codes (``code_ranges``): the files whose codes meet none of them aren't opened, and of the others Parquet skips the row
groups by the same ranges, which stand in the scan's filter beside the exact condition.

Rows without a place have no code; they are stored, and no region finds them.  Cells at the edge of the numbered space
take in what lies beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import scalars as S

#: Width of a cell in light years, bits a coordinate, cells before zero, and how many ranges a region may become.
CELL, BITS, RANGES, ROW_GROUP_BYTES = 10.0, 21, 64, 16 << 20
OFFSET = 1 << (BITS - 1)
# The steps that spread 21 bits to every third place.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
Point = tuple[float, float, float]
Cells = tuple[int, int, int]


def _cell(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor(value / F.lit(CELL)) + F.lit(OFFSET)))


def code(x: Column, y: Column, z: Column) -> Column:
    """The code of a point; null if a coordinate is missing."""
    # a step uses a number twice: as a function of an array's elements it is computed once, as plain columns 32 times
    spread = F.array(_cell(z), _cell(y), _cell(x))
    for shift, mask in _SPREAD:
        spread = F.transform(spread, lambda v: v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask)))  # noqa: B023
    whole = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return F.when(whole, F.aggregate(spread, F.lit(0).cast("bigint"), lambda bits, v: F.shiftleft(bits, 1).bitwiseOR(v)))


def code_ranges(touches: Callable[[Cells, int], bool], inside: Callable[[Cells, int], bool], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of codes that cover a region, by halving cubes until there are ``most``.

    A cube is its lowest cell and its width in cells; ``touches`` may say yes too often, ``inside`` too seldom.
    """
    open_cubes, done = [((0, 0, 0), 0)], []
    width = 1 << BITS
    while open_cubes and width > 1:
        width //= 2
        halves = []
        for low, prefix in open_cubes:
            for k in range(8):
                cube = tuple(v + width * (k >> i & 1) for i, v in enumerate(low))
                if touches(cube, width):
                    halves.append((cube, prefix * 8 + k))
        kept = [(c, p) for c, p in halves if not inside(c, width)]
        if len(done) + len(halves) > most:
            width *= 2
            break
        done += [(p * width**3, (p + 1) * width**3 - 1) for c, p in halves if inside(c, width)]
        open_cubes = kept
    done += [(p * width**3, (p + 1) * width**3 - 1) for _, p in open_cubes]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _number(v: float) -> int:
    return max(0, min((1 << BITS) - 1, math.floor(v / CELL) + OFFSET))


def box_ranges(low: Point, high: Point, most: int = RANGES) -> list[tuple[int, int]]:
    a, b = [_number(v) for v in low], [_number(v) for v in high]
    touches = lambda c, w: all(u <= q and u + w - 1 >= p for u, p, q in zip(c, a, b, strict=True))
    inside = lambda c, w: all(p <= u and u + w - 1 <= q for u, p, q in zip(c, a, b, strict=True))
    return code_ranges(touches, inside, most)


def capsule_ranges(a: Point, b: Point, half: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Cubes whose middle is near enough to the segment, within the capsule's box."""
    low, high = [_number(min(u, v) - half) for u, v in zip(a, b, strict=True)], [_number(max(u, v) + half) for u, v in zip(a, b, strict=True)]
    d = [v - u for u, v in zip(a, b, strict=True)]
    length = sum(x * x for x in d)

    def touches(c: Cells, w: int) -> bool:
        if not all(u <= q and u + w - 1 >= p for u, p, q in zip(c, low, high, strict=True)):
            return False
        if any(u == 0 or u + w == 1 << BITS for u in c):
            return True  # takes in what lies beyond
        mid = [(u + w / 2 - OFFSET) * CELL for u in c]
        t = min(1.0, max(0.0, sum((m - u) * x for m, u, x in zip(mid, a, d, strict=True)) / length)) if length else 0.0
        return math.dist(mid, [u + t * x for u, x in zip(a, d, strict=True)]) <= half + w * CELL * math.sqrt(3) / 2

    return code_ranges(touches, lambda c, w: False, most)


def write_points(points: DataFrame, path: str, files: int | None = None) -> None:
    """Write rows with x, y, z in the order of their codes, and the manifest."""
    spark = points.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = points.withColumn("zcode", code(F.col("x"), F.col("y"), F.col("z")))
    rows.repartitionByRange(n, "zcode").sortWithinPartitions("zcode").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/rows")
    kept = spark.read.parquet(f"{path}/rows").select("zcode", F.col("_metadata.file_path").alias("file"))
    # a row a file, of two numbers and a name
    kept.groupBy("file").agg(F.min("zcode").alias("least"), F.max("zcode").alias("greatest")).write.parquet(f"{path}/manifest")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All rows."""
    return spark.read.parquet(f"{path}/rows").drop("zcode")


def _read_ranges(spark: SparkSession, path: str, ranges: list[tuple[int, int]]) -> DataFrame:
    meets = F.lit(False)
    for a, b in ranges:
        meets = meets | ((F.col("least") <= b) & (F.col("greatest") >= a))
    files = [r.file for r in spark.read.parquet(f"{path}/manifest").where(meets).select("file").collect()]
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    within = F.lit(False)
    for a, b in ranges:
        within = within | F.col("zcode").between(a, b)
    return rows.where(within).drop("zcode")


def read_box(spark: SparkSession, path: str, centre: Point, half: float) -> DataFrame:
    """The rows in a cube around a point."""
    ranges = box_ranges(tuple(c - half for c in centre), tuple(c + half for c in centre))
    return _read_ranges(spark, path, ranges).where(S.in_box(F.col("x"), F.col("y"), F.col("z"), centre, half))


def read_capsule(spark: SparkSession, path: str, a: Point, b: Point, half: float) -> DataFrame:
    """The rows within ``half`` of a segment."""
    return _read_ranges(spark, path, capsule_ranges(a, b, half)).where(S.in_capsule(F.col("x"), F.col("y"), F.col("z"), a, b, half))
