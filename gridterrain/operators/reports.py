"""Profiles and grouped reports over the postcode table.

Groups with a null key are left out of grouped reports, and only groups that occur are listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridterrain.schemas import CATEGORY_COLUMNS
from gridterrain.scratch import cut

# Columns counted value by value; the district is listed twice.
COUNTED_COLUMNS = [
    "Postcode_area", "Quality", "Country_code", "Admin_county_code", "Admin_district_code",
    "Admin_district_code", "Admin_ward_code",
]
QUALITY_EXAMPLES = 10
QUARTILES = (25, 50, 75)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def counts_by(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Non-null counts of columns by keys, rows with a null key left out."""
    keyed = reduce(lambda d, k: d.filter(_c(k).isNotNull()), keys, df)
    return keyed.groupBy(*[_c(k) for k in keys]).agg(*[F.count(_c(c)).alias(c) for c in columns])


def area_counts(df: DataFrame) -> DataFrame:
    """A1: non-null count of every column by area."""
    return counts_by(df, ["Postcode_area"], [c for c in df.columns if c not in ("Postcode_area", "row_id")])


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(section, column, value)`` with one row per row and listed column, nulls left out."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("section"), F.lit(c).alias("column"), _c(c).cast("string").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(F.inline(rows)).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: list[str] = COUNTED_COLUMNS) -> DataFrame:
    """A2: rows per distinct value of each listed column, in one pass and one shuffle."""
    return long_values(df, columns).groupBy("section", "column", "value").agg(F.count("*").alias("cases"))


def distinct_areas(df: DataFrame) -> DataFrame:
    """A3."""
    return df.filter(F.col("Postcode_area").isNotNull()).select("Postcode_area").distinct()


def quality_counts(df: DataFrame) -> DataFrame:
    """A4."""
    columns = ["Postcode", "Postcode_area", "Eastings", "Northings", "County Name", "District Name", "Ward Name"]
    return counts_by(df, ["Quality"], columns)


def quality_ranges(df: DataFrame) -> DataFrame:
    """A5."""
    return df.filter(F.col("Quality").isNotNull()).groupBy("Quality").agg(
        F.count("*").alias("Cases"), F.min("Eastings").alias("Min_E"), F.max("Eastings").alias("Max_E"),
        F.min("Northings").alias("Min_N"), F.max("Northings").alias("Max_N"),
    )


def quality_examples(df: DataFrame, qualities: tuple[int, ...] = (60, 90), n: int = QUALITY_EXAMPLES) -> DataFrame:
    """L3: the first rows of each listed quality; each list is a bounded top-n, never a full sort."""
    parts = [df.filter(F.col("Quality") == q).orderBy("row_id").limit(n) for q in qualities]
    return reduce(DataFrame.unionByName, parts)


def pattern_counts(df: DataFrame) -> DataFrame:
    """A6."""
    return counts_by(df, ["Pattern"], ["Postcode"])


def outward_counts(df: DataFrame) -> DataFrame:
    """A7."""
    return counts_by(df, ["Postcode_area", "Post Town", "Outward"], ["Postcode"])


def outwards_per_area(df: DataFrame) -> DataFrame:
    """Exact distinct outwards; duplicates collapse before the second aggregation."""
    keyed = df.filter(F.col("Postcode_area").isNotNull() & _c("Post Town").isNotNull())
    return keyed.groupBy("Postcode_area", _c("Post Town")).agg(F.count_distinct("Outward").alias("Outward"))


def code_usage(df: DataFrame, code: str, name: str, first: int) -> DataFrame:
    """The first codes in use with name and count, and how many more there are."""
    used = counts_by(df, [code, name], ["Postcode"]).select(
        _c(code).alias("code"), _c(name).alias("name"), F.col("Postcode").alias("cases")
    )
    total = used.agg(F.count("*")).scalar()
    return used.orderBy("code", "name").limit(first).withColumn("more", F.greatest(total - first, F.lit(0)).cast("bigint"))


def _weighted_quartiles(counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(column, q25, q50, q75)`` of values ``(column, value, w, _part)`` in ranges of ``_part``, interpolated.

    A table with one row per column and range gives the weight before each range; within a range a running
    sum does. The values at the two ranks around each quartile are picked out, six a column at most.
    """
    ranges = counted.groupBy("column", "_part").agg(F.sum("w").alias("_w"))
    earlier = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("column", "_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0).cast("bigint")).alias("_offset"))
    running = Window.partitionBy("column", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("_upto", F.sum("w").over(running))
    placed = upto.join(F.broadcast(offsets), ["column", "_part"]).join(F.broadcast(sizes), "column")
    last = F.col("_offset") + F.col("_upto")
    # Four times the rank of the quartile p per cent of the way from 0 to n - 1.
    at = {p: p // 25 * (F.col("count") - 1) for p in QUARTILES}
    low = {p: F.floor(at[p] / 4) for p in QUARTILES}
    high = {p: F.ceil(at[p] / 4) for p in QUARTILES}
    holds = lambda rank: (rank >= last - F.col("w")) & (rank < last)
    picked = placed.groupBy("column").agg(
        *[F.max(F.when(holds(rank[p]), F.col("value"))).alias(f"_{name}{p}") for name, rank in (("low", low), ("high", high)) for p in QUARTILES],
        F.max("count").alias("count"),
    )
    part = {p: F.pmod(at[p], F.lit(4)) / 4 for p in QUARTILES}
    return picked.select(
        "column", *[(F.col(f"_low{p}") + (F.col(f"_high{p}") - F.col(f"_low{p}")) * part[p]).alias(f"q{p}") for p in QUARTILES]
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns.

    Quartiles are exact. Rows shrink to one per distinct value first; these are range-partitioned and
    written once, and quartiles are found by rank, so no task holds all values of a column.
    """
    rows = F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("double").alias("value")) for c in columns])
    counted = cut(
        df.select(F.inline(rows)).filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count("*").alias("w"))
        .repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()),
        "values",
    )
    v, w = F.col("value"), F.col("w")
    sums = counted.groupBy("column").agg(
        F.sum("w").alias("count"), F.sum(v * w).alias("_s"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    mean = sums.select(F.col("column").alias("_column"), (F.col("_s") / F.col("count")).alias("mean"))
    spread = (
        counted.join(mean, F.col("column") == F.col("_column"))
        .groupBy("column").agg(F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("_d"))
    )
    quartiles = _weighted_quartiles(counted, sums.select("column", "count"))
    return sums.join(spread, "column").join(quartiles, "column").select(
        "column", "count", (F.col("_s") / F.col("count")).alias("mean"),
        F.when(F.col("count") > 1, F.sqrt(F.col("_d") / (F.col("count") - 1))).alias("std"), "min",
        *[f"q{p}" for p in QUARTILES], "max",
    )


def category_profile(df: DataFrame, columns: list[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Count, distinct values, commonest value (smallest on a tie) and its count."""
    counted = value_counts(df, columns)
    return counted.groupBy("column").agg(
        F.sum("cases").alias("count"), F.count("*").alias("unique"),
        F.min_by("value", F.struct(-F.col("cases"), F.col("value"))).alias("top"), F.max("cases").alias("freq"),
    )


def column_report(df: DataFrame) -> DataFrame:
    """Position, name, type and non-null count of each column, with the table's row count."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(_c(c)).alias(c) for c in df.columns])
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("type"), _c(c).alias("non_null"), F.col("_rows").alias("rows"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return counts.select(F.inline(rows))


def first_town(df: DataFrame) -> DataFrame:
    """Post town of the first row of each area."""
    return df.groupBy("Postcode_area").agg(F.min_by(_c("Post Town"), "row_id").alias("Post Town"))
