"""The five code lookups, from two-column sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridterrain.functions import text
from gridterrain.operators.quality import key_violations
from gridterrain.schemas import DISTRICT_KINDS, LOOKUPS, WARD_KINDS
from gridterrain.sources.dims import countries


def area_lookup(sheet: DataFrame) -> DataFrame:
    """Post towns by area; the first two headings are fixed."""
    expected = ["Postcode Area", "Post Town"]
    if sheet.columns[:2] != expected:
        raise ValueError(f"post town headings are {sheet.columns[:2]}, expected {expected}")
    return sheet.select(*[f"`{c}`" for c in expected])


def county_lookup(sheet: DataFrame) -> DataFrame:
    """County names without the word County."""
    return sheet.select(text.county_name(F.col("`County Name`")).alias("County Name"), "County Code")


def district_lookup(sheets: dict[str, DataFrame]) -> DataFrame:
    """Four kinds of district in one lookup, London boroughs renamed."""
    parts = [
        sheets[kind].withColumn(
            "District Name",
            text.london_borough_name(F.col("District Name")) if kind == "LBO" else F.col("District Name"),
        )
        for kind in DISTRICT_KINDS
    ]
    return reduce(DataFrame.unionByName, parts)


def ward_lookup(sheets: dict[str, DataFrame]) -> DataFrame:
    """Five kinds of ward in one lookup, without the names of detached parts."""
    union = reduce(DataFrame.unionByName, [sheets[kind] for kind in WARD_KINDS])
    return union.filter(~text.is_detached_ward(F.col("Ward Name")))


def load_lookups(
    spark: SparkSession, areas: DataFrame, counties: DataFrame, districts: dict[str, DataFrame], wards: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """All lookups by name."""
    return {
        "areas": area_lookup(areas),
        "countries": countries(spark),
        "counties": county_lookup(counties),
        "districts": district_lookup(districts),
        "wards": ward_lookup(wards),
    }


def lookup_faults(lookups: dict[str, DataFrame]) -> DataFrame:
    """A10 on every lookup, and a row for each empty lookup; no rows means all may be used."""
    parts = []
    for name, _, key, _ in LOOKUPS:
        bad_keys = key_violations(lookups[name], key)
        parts.append(bad_keys.select(F.lit(name).alias("lookup"), "key_value", "cases"))
        size = lookups[name].agg(F.count("*").alias("cases"))
        parts.append(size.filter("cases = 0").select(F.lit(name).alias("lookup"), F.lit("empty").alias("key_value"), "cases"))
    return reduce(DataFrame.unionByName, parts)
