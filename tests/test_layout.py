"""The Z-order layout: codes, ranges against brute force, and what a region reads."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import routing
from orrery.sources import layout


def plain_code(p):
    cells = [layout._number(v) for v in p]
    return sum((c >> i & 1) << (3 * i + k) for k, c in enumerate(cells) for i in range(layout.BITS))


def test_codes(spark):
    rng = random.Random(1)
    points = [tuple(rng.uniform(-1e5, 1e5) for _ in "xyz") for _ in range(200)] + [(0.0, -0.001, 1e12), (-1e12, 5.0, 0.0)]
    rows = spark.createDataFrame(points, "x double, y double, z double").select(layout.code(F.col("x"), F.col("y"), F.col("z")).alias("c"))
    assert [r.c for r in rows.collect()] == [plain_code(p) for p in points]
    assert spark.createDataFrame([(None, 1.0, 1.0)], "x double, y double, z double").select(layout.code(F.col("x"), F.col("y"), F.col("z"))).first()[0] is None


def test_a_code_computes_each_cell_once(spark):
    plan = spark.range(1).select(*[F.rand(k).alias(c) for k, c in enumerate("xyz")]).select(layout.code(F.col("x"), F.col("y"), F.col("z")).alias("c"))
    assert plan._jdf.queryExecution().analyzed().toString().lower().count("floor(") == 3


def test_ranges_cover_regions():
    rng = random.Random(2)
    for _ in range(30):
        a, b = tuple(rng.uniform(-3e3, 3e3) for _ in "xyz"), tuple(rng.uniform(-3e3, 3e3) for _ in "xyz")
        half = rng.choice((5.0, 60.0, 700.0))
        box, capsule = layout.box_ranges(tuple(v - half for v in a), tuple(v + half for v in a)), layout.capsule_ranges(a, b, half)
        assert len(box) <= layout.RANGES and len(capsule) <= layout.RANGES
        for _ in range(200):
            p = tuple(v + rng.uniform(-half, half) for v in a)
            assert any(u <= plain_code(p) <= v for u, v in box)
            t, step = rng.random(), [rng.gauss(0, 1) for _ in "xyz"]
            size = half * rng.random() / sum(v * v for v in step) ** 0.5
            p = tuple(u + t * (v - u) + size * w for u, v, w in zip(a, b, step, strict=True))
            assert any(u <= plain_code(p) <= v for u, v in capsule)
        # the cover is of the region's size, not of the whole space
        assert sum(v - u + 1 for u, v in box) <= 64 * (2 * half / layout.CELL + 2) ** 3


def test_regions_read_few_files(spark, tmp_path):
    points = spark.range(20_000).select(F.col("id").alias("id64"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(200_000)) / 100.0 - 1000.0).alias(c) for c in "xyz"])
    lost = spark.createDataFrame([(-1, None, 1.0, 2.0)], "id64 bigint, x double, y double, z double")
    layout.write_points(points.unionByName(lost), str(tmp_path / "t"), files=64)
    assert layout.read_points(spark, str(tmp_path / "t")).count() == 20_001
    all_files = len(spark.read.parquet(str(tmp_path / "t" / "rows")).inputFiles())
    box = layout.read_box(spark, str(tmp_path / "t"), (300.0, -200.0, 10.0), 90.0)
    want = points.where(S.in_box(F.col("x"), F.col("y"), F.col("z"), (300.0, -200.0, 10.0), 90.0))
    assert sorted(box.collect()) == sorted(want.collect()) and box.count() > 5
    assert all_files == 64 and len(box.inputFiles()) <= 8
    a, b = (-900.0, -900.0, 0.0), (800.0, 900.0, 50.0)
    capsule = layout.read_capsule(spark, str(tmp_path / "t"), a, b, 60.0)
    assert sorted(capsule.collect()) == sorted(routing.capsule(points, a, b, 60.0).collect())
    assert len(capsule.inputFiles()) <= 40
    assert layout.read_box(spark, str(tmp_path / "t"), (1e7, 0.0, 0.0), 50.0).count() == 0
    plan = box._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan.split("Physical Plan")[-1] or "Or(" in plan.split("PushedFilters")[-1]


@pytest.mark.parametrize("half", [0.0, 1e9])
def test_extreme_boxes(half):
    assert layout.box_ranges((-half,) * 3, (half,) * 3)[0][0] >= 0
