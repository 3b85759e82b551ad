"""Dense row numbers without a one-partition window, thinning and random rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridterrain.functions.numeric import mix_hash
from gridterrain.scratch import cut

_SLOT_BITS = 33


def number_rows(df: DataFrame, *keys: str, name: str = "row_id") -> DataFrame:
    """Add 0..n-1 in the order of unique ``keys``.

    Rows are range-partitioned and sorted, then written once with their partition and position, so
    both stay fixed whatever is lost or re-planned later. The offsets table has one row per
    partition, which bounds both its window and its broadcast.
    """
    ordered = df.repartitionByRange(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
    placed = cut(ordered.withColumn("_slot", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("_slot", _SLOT_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_offset"))
    position = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position)
        .drop("_part", "_slot", "_offset")
    )


def thin(df: DataFrame, density: int, row_id: str = "row_id") -> DataFrame:
    """every ``density``-th row by position, before any clipping."""
    return df if density == 1 else df.filter(F.col(row_id) % density == 0)


def random_order(row_id: Column, seed: int) -> list[Column]:
    """A repeatable shuffled order of rows."""
    return [mix_hash(row_id, seed), row_id]


def random_rows(df: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """L4: ``n`` different random rows; each task keeps its own best ``n``, so nothing is sorted whole."""
    return df.orderBy(*random_order(F.col(row_id), seed)).limit(n)
