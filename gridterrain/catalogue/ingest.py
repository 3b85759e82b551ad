"""Registered queries of scans, lookups, archives and the built table."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridterrain import fixtures, scratch
from gridterrain.catalogue import common
from gridterrain.catalogue.oracle import sql
from gridterrain.catalogue.registry import query
from gridterrain.functions import text
from gridterrain.operators import quality
from gridterrain.plans import generate
from gridterrain.schemas import HEADER_LONG, HEADER_SHORT, LOOKUPS, SCANNED_COLUMNS
from gridterrain.sources import archives, dims, lookups as sheets, postcodes, tables

_SCANNED = ", ".join(f'"{c}"' for c in SCANNED_COLUMNS)


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.scanned_postcodes(spark, sf).withColumnRenamed("Quality", "Positional_quality_indicator")
    return rows.select(*HEADER_LONG, F.concat(F.lower("Postcode_area"), F.lit(".csv")).alias("file"), "row_id")


def _raw_folder(spark: SparkSession, sf: str) -> str:
    """Postcode files written by Spark: one folder per area, named like the area's file."""
    folder = scratch.scratch_path(spark, "csv")
    _raw(spark, sf).drop("row_id").write.partitionBy("file").csv(folder)
    return folder


@query("s1_scan_files", sql("scanned", f"SELECT {_SCANNED} FROM scanned"))
def _(spark, sf):
    return postcodes.scan_postcode_files(spark, _raw_folder(spark, sf))


@query("u1_union_files", sql("scanned", 'SELECT "Postcode_area", count(*) AS cases FROM scanned GROUP BY 1'))
def _(spark, sf):
    scan = postcodes.scan_postcode_files(spark, _raw_folder(spark, sf))
    return scan.groupBy("Postcode_area").agg(F.count("*").alias("cases"))


@query(
    "s3_load_chain",
    sql("scanned", 'SELECT "Postcode_area", count(*) AS cases, 0::BIGINT AS faults FROM scanned GROUP BY 1'),
)
def _(spark, sf):
    heading_file = scratch.scratch_path(spark, "headings")
    names = [(",".join(HEADER_SHORT) + "\n" + " , ".join(HEADER_LONG),)]
    spark.createDataFrame(names, "value string").coalesce(1).write.text(heading_file)
    scan, faults = postcodes.load_postcode_folder(spark, _raw_folder(spark, sf), heading_file)
    found = faults.agg(F.count("*")).scalar()
    return scan.groupBy("Postcode_area").agg(F.count("*").alias("cases")).withColumn("faults", found)


def _usage(lookup: DataFrame, table: DataFrame, spec: tuple) -> DataFrame:
    """A lookup with the number of table rows that use each entry."""
    _, code, key, value = spec
    used = quality.code_counts(table, code)
    named = lookup.select(F.col(f"`{key}`").alias("code"), F.col(f"`{value}`").alias("name"))
    return named.join(used, "code", "left").select("code", "name", F.coalesce("cases", F.lit(0)).cast("bigint").alias("cases"))


def _usage_sql(part: str, code: str, key: str, value: str) -> str:
    return sql(
        f"scanned {part}",
        f'SELECT l."{key}" AS code, l."{value}" AS name, count(s."{code}") AS cases '
        f'FROM {part} l LEFT JOIN scanned s ON s."{code}" = l."{key}" GROUP BY 1, 2',
    )


_LOADERS = {
    "areas": lambda spark, sf: sheets.area_lookup(fixtures.area_sheet(spark, sf)),
    "countries": lambda spark, sf: dims.countries(spark),
    "counties": lambda spark, sf: sheets.county_lookup(fixtures.county_sheet(spark, sf)),
    "districts": lambda spark, sf: sheets.district_lookup(fixtures.district_sheets(spark, sf)),
    "wards": lambda spark, sf: sheets.ward_lookup(fixtures.ward_sheets(spark, sf)),
}


def _register_usage(name: str, spec: tuple) -> None:
    @query(name, _usage_sql(*spec))
    def _(spark, sf):
        return _usage(_LOADERS[spec[0]](spark, sf), fixtures.postcodes(spark, sf), spec)


for _name, _spec in zip(
    ("s4_area_lookup", "s5_country_lookup", "s6_county_lookup", "s7_district_lookup", "s8_ward_lookup"), LOOKUPS
):
    _register_usage(_name, _spec)


@query(
    "s9_all_lookups",
    sql(
        "areas countries counties districts wards",
        " UNION ALL ".join(
            f"SELECT '{p}' AS lookup, count(*) AS entries, 0::BIGINT AS faults FROM {p}"
            for p in ("areas", "countries", "counties", "districts", "wards")
        ),
    ),
)
def _(spark, sf):
    loaded = common.lookups(spark, sf)
    faults = sheets.lookup_faults(loaded).groupBy("lookup").agg(F.count("*").alias("faults"))
    sizes = None
    for name, df in loaded.items():
        size = df.agg(F.count("*").alias("entries")).select(F.lit(name).alias("lookup"), "entries")
        sizes = size if sizes is None else sizes.unionByName(size)
    return sizes.join(faults, "lookup", "left").fillna(0, ["faults"])


@query(
    "u2_district_union",
    sql("districts", """SELECT CASE substr("District Name", 1, 4) WHEN 'Vale' THEN 'DIS' WHEN 'Moor' THEN 'MTD' WHEN 'Port' THEN 'UTA' ELSE 'LBO' END AS kind,
        count(*) AS entries FROM districts GROUP BY 1"""),
)
def _(spark, sf):
    lookup = sheets.district_lookup(fixtures.district_sheets(spark, sf))
    start = F.substring("District Name", 1, 4)
    kind = F.when(start == "Vale", "DIS").when(start == "Moor", "MTD").when(start == "Port", "UTA").otherwise("LBO")
    return lookup.groupBy(kind.alias("kind")).agg(F.count("*").alias("entries"))


@query("u3_ward_union", sql("wards", 'SELECT "Ward Name", "Ward Code" FROM wards'))
def _(spark, sf):
    return sheets.ward_lookup(fixtures.ward_sheets(spark, sf))


@query(
    "f12_detached_wards",
    sql("", "SELECT 'W' || n::VARCHAR AS \"Ward Code\" FROM (SELECT DISTINCT p_partkey % 60 AS n FROM part) WHERE n % 10 = 0"),
)
def _(spark, sf):
    parts = list(fixtures.ward_sheets(spark, sf).values())
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.filter(text.is_detached_ward(F.col("Ward Name"))).select("Ward Code")


_ZIPPED = "archive string, content binary"


def _zip_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive per batch of rows with a file per area, and one archive with a stray folder."""
    for batch in batches:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for file, rows in batch.groupby("file"):
                z.writestr(f"Data/CSV/{file}", rows[HEADER_LONG].to_csv(header=False, index=False))
        first = batch["row_id"].iloc[0]
        bad = common.zipped("Other/ng.csv", "AB1 0AA\n")
        yield pd.DataFrame({"archive": [f"a{first}.zip", f"b{first}.zip"], "content": [out.getvalue(), bad]})


@query("s10_unpack_archives", sql("scanned", f"SELECT {_SCANNED} FROM scanned"))
def _(spark, sf):
    zipped = common.stored_archives(_raw(spark, sf).mapInPandas(_zip_batches, _ZIPPED))
    return postcodes.postcodes_from_lines(archives.entry_lines(zipped, postcodes.DATA_ENTRY))


@query("s11_save_and_load", sql("scanned", f"SELECT {_SCANNED}, row_id FROM scanned"))
def _(spark, sf):
    path = scratch.scratch_path(spark, "table")
    df = fixtures.postcodes(spark, sf)
    tables.save_table(df, path)
    return tables.load_table(spark, path, df.schema)


@query("s12_export_csv", sql("scanned", f"SELECT {_SCANNED}, row_id FROM scanned WHERE \"Postcode_area\" = 'NG'"))
def _(spark, sf):
    out, df = scratch.scratch_path(spark, "export"), fixtures.postcodes(spark, sf)
    tables.export_csv(df, out, "ng")
    return spark.read.schema(df.schema).option("header", True).csv(tables.csv_path(out, "ng"))


def _zip_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive per tile; every seventh tile has two, every eleventh the wrong file inside."""
    for batch in batches:
        for t in batch.itertuples(index=False):
            name = "OTHER.asc" if t.number % 11 == 5 else f"{t.code}.asc"
            data = common.zipped(name, t.text)
            paths = [f"{t.code.lower()}_grid.zip"] + ([f"{t.code.lower()}_copy.zip"] if t.number % 7 == 3 else [])
            yield pd.DataFrame({"archive": paths, "content": [data] * len(paths)})


@query(
    "s13_tile_archives",
    sql(
        "cells",
        """SELECT number, CASE WHEN number % 7 = 3 THEN 2 ELSE 1 END::BIGINT AS files,
             CASE WHEN number % 7 = 3 OR number % 11 = 5 THEN 'unreadable' END AS fault,
             CASE WHEN number % 7 = 3 OR number % 11 = 5 THEN 0 ELSE n END::BIGINT AS cells
           FROM (SELECT ("row" // 50) * 2 + col // 50 AS number, count(*) AS n FROM cells GROUP BY 1)""",
    ),
)
def _(spark, sf):
    number = (F.col("north") * 2 + F.col("east")).cast("bigint")
    texts = fixtures.tile_texts(spark, sf).select(number.alias("number"), "text")
    # Names are as wide as the largest number needs.
    width = max(4, texts.agg(F.length(F.conv(F.max("number").cast("string"), 10, 36))).first()[0] or 0)
    tiles = texts.withColumn("code", F.lpad(F.conv(F.col("number").cast("string"), 10, 36), width, "0"))
    zipped = common.stored_archives(tiles.mapInPandas(_zip_tiles, _ZIPPED))
    from gridterrain.sources.tiles import tile_headers

    read = tile_headers(archives.tile_archive_texts(zipped, width=width))
    cells = F.when(F.col("fault").isNull(), F.col("nrows") * F.col("ncols")).otherwise(0)
    return read.select(F.conv("tile", 36, 10).cast("bigint").alias("number"), "files", "fault", cells.alias("cells"))


@query(
    "s14_parse_tiles",
    sql(
        "cells",
        """SELECT 't_' || ("row" // 50)::VARCHAR || '_' || (col // 50)::VARCHAR AS tile, "row" % 50 AS "row", col % 50 AS col, alt
           FROM cells""",
    ),
)
def _(spark, sf):
    from gridterrain.sources.tiles import tile_cells

    return tile_cells(common.headers(spark, sf))


@query(
    "s15_grid_squares",
    sql(
        "scanned grid",
        """SELECT g.name, g.easting_index, g.northing_index, g.is_real, count(s.row_id) AS located
           FROM grid g LEFT JOIN scanned s ON s."Eastings" <> 0 AND s."Eastings" // 100000 = g.easting_index
             AND s."Northings" // 100000 = g.northing_index
           GROUP BY ALL""",
    ),
)
def _(spark, sf):
    per_square = (
        fixtures.postcodes(spark, sf).filter("Eastings <> 0")
        .groupBy(dims.square_name(F.floor(F.col("Eastings") / 100000), F.floor(F.col("Northings") / 100000)).alias("name"))
        .agg(F.count("*").alias("located"))
    )
    return (
        dims.grid_squares(spark).join(per_square, "name", "left")
        .select("name", "easting_index", "northing_index", "is_real", F.coalesce("located", F.lit(0)).cast("bigint").alias("located"))
    )


@query("p2_prune_columns", sql("scanned", f"SELECT {_SCANNED} FROM scanned"))
def _(spark, sf):
    raw = _raw(spark, sf)
    return postcodes.as_scanned(raw.select(*HEADER_LONG, "file"), F.concat(F.lit("/data/"), F.col("file")))


_FINISHED = ", ".join(
    f'"{c}"' for c in SCANNED_COLUMNS + ["Post Town", "Country Name", "County Name", "District Name", "Ward Name", "Inward", "Outward", "District", "Pattern"]
)


@query(
    "q1_generate",
    sql("parted", f'SELECT {_FINISHED}, row_number() OVER (ORDER BY "Postcode_area", "Postcode") - 1 AS row_id FROM parted'),
)
def _(spark, sf):
    loaded = generate.stored_lookups(common.lookups(spark, sf))
    return generate.build_postcodes(fixtures.postcodes(spark, sf).drop("row_id"), loaded).table


@query(
    "q1_generate_faults",
    sql("scanned", """SELECT "Postcode_area", count(*) AS cases, 0::BIGINT AS faults FROM scanned GROUP BY 1"""),
)
def _(spark, sf):
    loaded = generate.stored_lookups(common.lookups(spark, sf))
    table = fixtures.postcodes(spark, sf)
    faults = generate.build_postcodes(table, loaded).faults.select("cases").unionByName(sheets.lookup_faults(loaded).select("cases"))
    found = faults.agg(F.count("*")).scalar()
    return table.groupBy("Postcode_area").agg(F.count("*").alias("cases")).withColumn("faults", found)


_SHORT, _LONG = ",".join(HEADER_SHORT), ",".join(HEADER_LONG)


@query(
    "s2_header_contract",
    sql(
        "",
        f"""SELECT path, CASE WHEN list_transform(string_split(string_split(t, chr(10))[1], ','), lambda v: trim(v)) <> string_split('{_SHORT}', ',') THEN 'line 1'
              WHEN list_transform(string_split(string_split(t, chr(10))[2], ','), lambda v: trim(v)) <> string_split('{_LONG}', ',') THEN 'line 2' END AS fault
            FROM (SELECT path, replace(text, chr(13), '') AS t FROM texts) WHERE fault IS NOT NULL""",
        texts=f"""SELECT c_custkey::VARCHAR AS path, CASE c_custkey % 4 WHEN 0 THEN '{_SHORT}' || chr(10) || '{_LONG}' WHEN 1 THEN 'XX,{_SHORT}' || chr(10) || '{_LONG}'
            WHEN 2 THEN replace('{_SHORT}', ',', ' , ') || chr(13) || chr(10) || '{_LONG}' || chr(13) || chr(10)
            ELSE '{_SHORT}' || chr(10) || '{_LONG}_' || c_mktsegment END AS text FROM customer""",
    ),
)
def _(spark, sf):
    """One heading text per customer, some of them wrong."""
    texts = fixtures.table(spark, sf, "customer").selectExpr(
        "string(c_custkey) as path",
        f"case c_custkey % 4 when 0 then concat('{_SHORT}', '\\n', '{_LONG}') when 1 then concat('XX,{_SHORT}', '\\n', '{_LONG}')"
        f" when 2 then concat(replace('{_SHORT}', ',', ' , '), '\\r\\n', '{_LONG}', '\\r\\n')"
        f" else concat('{_SHORT}', '\\n', '{_LONG}_', c_mktsegment) end as text",
    )
    return postcodes.header_faults(texts)
