"""Q1: build the postcode table from scanned rows and lookups."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridterrain.operators import quality
from gridterrain.operators.rows import number_rows
from gridterrain.schemas import DERIVED_COLUMNS, LOOKED_UP_COLUMNS, LOOKUPS, SCANNED_COLUMNS
from gridterrain.scratch import cut, scratch_path
from gridterrain.sources import archives as zips, lookups as sheets, postcodes as files


class Built(NamedTuple):
    """The finished table, its faults ``(check, subject, cases)`` and its audit ``(check, code_column, code, cases)``."""

    table: DataFrame
    faults: DataFrame
    audit: DataFrame


def stored_lookups(lookups: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Lookups written in one go, so that joins see their true size and broadcast only the small ones."""
    specs = {name: (key, value) for name, _, key, value in LOOKUPS}
    rows = [
        df.select(F.lit(name).alias("lookup"), F.col(f"`{specs[name][0]}`").alias("key"), F.col(f"`{specs[name][1]}`").alias("value"))
        for name, df in lookups.items()
    ]
    path = scratch_path(rows[0].sparkSession, "lookups")
    reduce(DataFrame.unionByName, rows).write.partitionBy("lookup").parquet(path)
    read = rows[0].sparkSession.read.schema("key string, value string")
    stored = {}
    for name in lookups:
        key, value = specs[name]
        stored[name] = read.parquet(f"{path}/lookup={name}").select(F.col("key").alias(key), F.col("value").alias(value))
    return stored


def build_postcodes(scanned: DataFrame, lookups: dict[str, DataFrame]) -> Built:
    """J1-J4, P3-P5, W4 on checked lookups: the finished table, its faults and its audit.

    Faults are doubled or null postcodes, bad patterns, areas or districts. The table is sound when
    there are none. The audit lists unused lookup entries, codes without one, and null codes; these
    are findings and no faults. The scanned rows are written once, and all three start from there.
    """
    scanned = cut(scanned.select(*SCANNED_COLUMNS), "scanned")
    broken_down = quality.add_breakdown(scanned)
    enriched = quality.add_lookups(broken_down, lookups)
    missing = quality.missing_columns(enriched)
    if missing:
        raise ValueError(f"columns missing from the postcode table: {missing}")
    keys = quality.key_violations(scanned, "Postcode").select(
        F.lit("key").alias("check"), F.col("key_value").alias("subject"), "cases"
    )
    shapes = quality.breakdown_faults(broken_down).select(
        F.col("fault").alias("check"), F.col("Postcode").alias("subject"), F.lit(1).cast("bigint").alias("cases")
    )
    numbered = number_rows(enriched.select(*[f"`{c}`" for c in SCANNED_COLUMNS + LOOKED_UP_COLUMNS + DERIVED_COLUMNS]), "Postcode_area", "Postcode")
    return Built(numbered, keys.unionByName(shapes), quality.audit(scanned, lookups))


def build_from_archive(
    spark: SparkSession, archives: DataFrame, areas: DataFrame, counties: DataFrame,
    districts: dict[str, DataFrame], wards: dict[str, DataFrame],
) -> Built:
    """Q1 from zip archives and code sheets: table, faults and audit; archive and heading faults included."""
    lines = cut(zips.entry_lines(archives, files.DATA_ENTRY), "lines")
    scanned = files.postcodes_from_lines(lines)
    lookups = stored_lookups(sheets.load_lookups(spark, areas, counties, districts, wards))
    table, faults, audit = build_postcodes(scanned, lookups)
    one = F.lit(1).cast("bigint").alias("cases")
    bad_archives = zips.rejected_archives(archives).select(
        F.lit("archive").alias("check"), F.col("archive").alias("subject"), F.col("bad_entries").alias("cases")
    )
    heading_entries = zips.unpack_archives(archives, r"^Doc/.*Column_Headers\.csv$")
    heading_files = cut(heading_entries.select(F.col("entry").alias("path"), "text"), "headings")
    headings = files.header_faults(heading_files).select(F.lit("heading").alias("check"), F.col("path").alias("subject"), one)
    no_heading = heading_files.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("heading").alias("check"), F.lit("missing").alias("subject"), one
    )
    bad_lookups = sheets.lookup_faults(lookups).select(
        F.concat(F.lit("lookup "), F.col("lookup")).alias("check"), F.col("key_value").alias("subject"), "cases"
    )
    unreadable = zips.unreadable_entries(archives).select(
        F.lit("entry").alias("check"), F.concat_ws(" ", "archive", "entry").alias("subject"), one
    )
    for extra in (bad_archives, unreadable, files.as_faults(files.malformed_lines(lines)), headings, no_heading, bad_lookups):
        faults = faults.unionByName(extra)
    return Built(table, faults, audit)
