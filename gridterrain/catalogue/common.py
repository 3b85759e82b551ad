"""Shared inputs of the registered queries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridterrain import fixtures
from gridterrain.operators.quality import add_breakdown, add_lookups
from gridterrain.plans.generate import stored_lookups
from gridterrain.scratch import cut, scratch_path
from gridterrain.sources.archives import read_archives, store_of
from gridterrain.sources.dims import grid_squares
from gridterrain.sources.lookups import load_lookups
from gridterrain.sources.tiles import tile_headers


def lookups(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return load_lookups(
        spark, fixtures.area_sheet(spark, sf_dir), fixtures.county_sheet(spark, sf_dir),
        fixtures.district_sheets(spark, sf_dir), fixtures.ward_sheets(spark, sf_dir),
    )


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcodes with looked-up names."""
    return add_lookups(fixtures.postcodes(spark, sf_dir), stored_lookups(lookups(spark, sf_dir)))


def with_towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcodes with their post town only."""
    from gridterrain.operators.quality import add_lookup
    from gridterrain.sources.lookups import area_lookup

    return add_lookup(
        fixtures.postcodes(spark, sf_dir), area_lookup(fixtures.area_sheet(spark, sf_dir)),
        "Postcode_area", "Postcode Area", "Post Town",
    )


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postcodes with looked-up names and derived parts: the finished table."""
    return add_breakdown(named(spark, sf_dir))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, alt)``: one altitude of -20 to 1450 m per order, at 0.1 m."""
    k = F.col("o_orderkey")
    return fixtures.table(spark, sf_dir, "orders").select(
        k.alias("k"), (((k * 7919) % 14700).cast("double") / 10.0 - 20.0).alias("alt")
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_headers(fixtures.tile_texts(spark, sf_dir))


def squares(spark: SparkSession) -> DataFrame:
    return grid_squares(spark)


def zipped(name: str, data: str) -> bytes:
    """An archive of one file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, data)
    return out.getvalue()


def stored_archives(made: DataFrame) -> DataFrame:
    """Archives ``(archive, content)`` written as files by their tasks, and listed.

    Their bytes are written as a table first, so a task that runs again writes the same files.
    """
    folder = scratch_path(made.sparkSession, "zips")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, inner = store_of(folder)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            for row in batch.itertuples(index=False):
                with store.open_output_stream(f"{inner}/{row.archive}") as out:
                    out.write(row.content)
            yield batch[["archive"]]

    cut(cut(made, "archives").mapInPandas(write, "archive string"), "written")
    return read_archives(made.sparkSession, folder)
