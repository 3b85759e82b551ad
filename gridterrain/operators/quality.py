"""Keys, lookups, referential audits and postcode breakdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridterrain.functions import text
from gridterrain.schemas import CATEGORY_COLUMNS, LOOKUPS, UNLOCATED_QUALITIES, VALID_PATTERNS


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """A10: key values that occur more than once, and null keys, with their row counts.

    Rows are counted before the shuffle, so neither a hot duplicate nor many nulls load one task.
    """
    return (
        df.groupBy(F.col(f"`{key}`").cast("string").alias("key_value"))
        .agg(F.count("*").alias("cases"))
        .filter((F.col("cases") > 1) | F.col("key_value").isNull())
    )


def add_lookup(df: DataFrame, lookup: DataFrame, code: str, lookup_code: str, value: str) -> DataFrame:
    """Add one looked-up column; rows without a match keep a null.

    The lookup's key is unique (checked by A10 on load), so no row is multiplied. No broadcast is
    forced: the optimiser broadcasts a lookup below the size threshold and otherwise sorts and
    merges, with adaptive splitting of a hot code on the table's side.
    """
    named = lookup.select(F.col(f"`{lookup_code}`").alias("_code"), F.col(f"`{value}`"))
    return df.join(named, df[f"`{code}`"] == named["_code"], "left").drop("_code")


def add_lookups(df: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """The five lookups in a chain."""
    return reduce(lambda d, spec: add_lookup(d, lookups[spec[0]], *spec[1:]), LOOKUPS, df)


def code_counts(df: DataFrame, code: str) -> DataFrame:
    """Rows per code; everything after it works on one row per distinct code."""
    return df.groupBy(F.col(f"`{code}`").alias("code")).agg(F.count("*").alias("cases"))


def unused_lookups(df: DataFrame, lookup: DataFrame, code: str, lookup_code: str, value: str) -> DataFrame:
    """Lookup rows that no row of the table refers to."""
    used = code_counts(df, code)
    named = lookup.select(F.col(f"`{lookup_code}`").alias("code"), F.col(f"`{value}`").alias("name"))
    return named.join(used, "code", "left_anti")


def failed_lookups(df: DataFrame, lookup: DataFrame, code: str, lookup_code: str, value: str) -> DataFrame:
    """Codes in use without a lookup row, with their row counts."""
    used = code_counts(df, code).filter(F.col("code").isNotNull())
    return used.join(lookup.select(F.col(f"`{lookup_code}`").alias("code")), "code", "left_anti")


def null_codes(df: DataFrame, codes: list[str]) -> DataFrame:
    """Per code column, null codes with a known location problem and other null codes.

    All columns are counted in one pass; the single result row is then turned into one per column.
    """
    unlocated = F.col("Quality").isin(UNLOCATED_QUALITIES)
    counts = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNull() & unlocated).alias(f"{c}|known") for c in codes],
        *[F.count_if(F.col(f"`{c}`").isNull() & ~unlocated).alias(f"{c}|other") for c in codes],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("code_column"), F.col(f"`{c}|known`").alias("known_issue"), F.col(f"`{c}|other`").alias("other"))
            for c in codes
        ]
    )
    return counts.select(F.inline(rows))


def audit(df: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """J2-J4 for every lookup: ``(check, code_column, code, cases)``, one row per finding.

    Rows are counted once for all five code columns, then everything joins on distinct codes.
    """
    long = df.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(s[1]).alias("code_column"), F.col(f"`{s[1]}`").alias("code")) for s in LOOKUPS]
            )
        ),
        F.col("Quality").isin(UNLOCATED_QUALITIES).alias("unlocated"),
    )
    used = long.groupBy("code_column", "code").agg(
        F.count("*").alias("cases"), F.count_if("unlocated").alias("known")
    )
    known = reduce(
        DataFrame.unionByName,
        [
            lookups[name].select(F.lit(code).alias("code_column"), F.col(f"`{key}`").alias("code"))
            for name, code, key, _ in LOOKUPS
        ],
    )
    nulls = used.filter(F.col("code").isNull())
    unused = known.join(used, ["code_column", "code"], "left_anti").withColumn("cases", F.lit(0).cast("bigint"))
    failed = used.filter(F.col("code").isNotNull()).join(known, ["code_column", "code"], "left_anti")
    parts = [
        unused.withColumn("check", F.lit("unused")),
        failed.select("code_column", "code", "cases", F.lit("failed").alias("check")),
        nulls.select("code_column", "code", F.col("known").alias("cases"), F.lit("null, unlocated").alias("check")),
        nulls.select("code_column", "code", (F.col("cases") - F.col("known")).alias("cases"), F.lit("null, located").alias("check")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).select("check", "code_column", "code", "cases")


def add_breakdown(df: DataFrame) -> DataFrame:
    """Shape, inward, outward and district columns."""
    return (
        df.withColumn("Pattern", text.shape(F.col("Postcode")))
        .withColumn("Inward", text.inward(F.col("Postcode")))
        .withColumn("Outward", text.outward(F.col("Postcode")))
        .withColumn("District", text.outward_district(F.col("Outward")))
    )


def breakdown_faults(df: DataFrame) -> DataFrame:
    """rows of a broken-down table with a bad pattern, area or district.

    Null counts as unequal, and the first fault found names the row.
    """
    area = text.outward_area(F.col("Outward"))
    rejoined = F.concat(area, F.col("District"))
    fault = (
        F.when(~F.coalesce(F.col("Pattern").isin(VALID_PATTERNS), F.lit(False)), "pattern")
        .when(~area.eqNullSafe(F.col("Postcode_area")), "area")
        .when(~rejoined.eqNullSafe(F.col("Outward")), "district")
    )
    return df.select("Postcode", "Postcode_area", "Pattern", fault.alias("fault")).filter(F.col("fault").isNotNull())


def missing_columns(df: DataFrame, required: list[str] = CATEGORY_COLUMNS) -> list[str]:
    """Required columns that the table lacks, in order."""
    present = set(df.columns)
    return [c for c in required if c not in present]
