"""Helpers that the training-data operators share: tables, shared folder, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from orrery.sources.shared import shared_dir as shared_dir
from orrery.sources.shared import shared_path as shared_path

#: Bounds of what an operator works on at once: rows and bytes (a longer text stands alone).
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Bits of a filter of ``marked``: at most 16 MB are broadcast, whatever the table's size.
MOST_BITS, BITMAP_BITS = 27, 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Shield:
    """Keeps the columns that an operator doesn't read out of its way, whatever their names.

    ``inner`` has the ``core`` columns and the others under plain names; ``restore`` gives the others
    their names back beside the outputs.  An input column with an output's name makes room for it.
    """

    def __init__(self, docs: DataFrame, *core: str):
        self.names, self.core = docs.columns, core
        self.held = {c: f"_held{i}" for i, c in enumerate(docs.columns) if c not in core}
        self.inner = docs.select(*[named(c) if c in core else named(c).alias(self.held[c]) for c in docs.columns])

    def restore(self, df: DataFrame, **outputs: Column) -> DataFrame:
        replaced = {c.lower() for c in outputs}
        kept = [named(c) if c in self.core else F.col(self.held[c]).alias(c) for c in self.names if c.lower() not in replaced]
        return df.select(*kept, *[v.alias(k) for k, v in outputs.items()])


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes, without copying."""
    for batch in batches:
        step = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over small batches.  Spark bounds the bytes of what it sends; no session setting is touched.

    A worker serves many stages, so a task begins by giving back what Arrow holds free from the ones before.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        return fn(pieces(batches))

    return df.mapInArrow(run, schema)


def extended(schema: StructType, *fields: StructField) -> StructType:
    """``schema`` with further fields, whatever its names and types."""
    return StructType([*schema.fields, *fields])


def marked(df: DataFrame, value: Column, members: DataFrame) -> DataFrame:
    """``df`` with ``marked``: false only where ``value`` surely isn't among the longs of ``members`` (one column).

    The members become bitmaps, of 16 bits a member up to 16 MB, which are broadcast; beyond, more rows
    are marked for nothing, but none is missed.
    """
    count = members.count()
    bits = min(MOST_BITS, max(BITMAP_BITS, (16 * count).bit_length()))
    place = F.pmod(value, F.lit(1 << bits))
    at = members.select(F.pmod(F.col(members.columns[0]), F.lit(1 << bits)).alias("at")).distinct()
    maps = at.groupBy(F.shiftright("at", BITMAP_BITS).alias("_nth")).agg(F.expr(f"bitmap_construct_agg(at & {(1 << BITMAP_BITS) - 1})").alias("_bits"))
    both = df.withColumn("_place", place).join(F.broadcast(maps), F.shiftright("_place", BITMAP_BITS) == F.col("_nth"), "left")
    inside = F.col("_place").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_place & {(1 << BITMAP_BITS) - 1}) / 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.pow(F.lit(2), F.pmod(inside, F.lit(8))).cast("int")
    return both.withColumn("marked", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("_place", "_nth", "_bits")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
