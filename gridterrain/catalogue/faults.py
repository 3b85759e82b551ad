"""Registered queries of the load, audit and build steps over spoilt rows, sheets, headings and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridterrain import fixtures, scratch
from gridterrain.catalogue import common, ingest
from gridterrain.catalogue.oracle import sql
from gridterrain.catalogue.registry import ORACLES, query
from gridterrain.catalogue.tables import _PATTERNS, _audit_sql
from gridterrain.operators import quality
from gridterrain.plans import generate
from gridterrain.schemas import CATEGORY_COLUMNS, DERIVED_COLUMNS, HEADER_LONG, HEADER_SHORT, LOOKED_UP_COLUMNS, SCANNED_COLUMNS
from gridterrain.sources import lookups as sheets, postcodes, tables

# Some rows have a postcode in lower case, a foreign area, no postcode, or one of five that repeat.
_SPOILT_POSTCODE = "CASE WHEN row_id % 103 = 7 THEN lower({pc}) WHEN row_id % 107 = 9 THEN NULL WHEN row_id % 37 = 10 THEN concat('QQ', row_id % 5, ' 1AA') ELSE {pc} END"
_SPOILT_AREA = "CASE WHEN row_id % 101 = 8 THEN 'ZZ' ELSE {area} END"


def _spoilt(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "Postcode": F.expr(_SPOILT_POSTCODE.format(pc="Postcode")), "Postcode_area": F.expr(_SPOILT_AREA.format(area="Postcode_area"))
    })


_SPOILT_SQL = f"""SELECT * REPLACE ({_SPOILT_POSTCODE.format(pc='"Postcode"')} AS "Postcode", {_SPOILT_AREA.format(area='"Postcode_area"')} AS "Postcode_area") FROM scanned"""
_KEYS_SQL = """SELECT 'key' AS "check", "Postcode" AS subject, count(*) AS cases FROM spoilt GROUP BY 2 HAVING count(*) > 1 OR "Postcode" IS NULL"""


@query(
    "q1_row_faults",
    sql(
        "scanned",
        f"""{_KEYS_SQL} UNION ALL SELECT fault, "Postcode", 1 FROM (
             SELECT "Postcode", CASE WHEN p IS NULL OR p NOT IN ({_PATTERNS}) THEN 'pattern' WHEN area IS DISTINCT FROM "Postcode_area" THEN 'area'
               WHEN area || district IS DISTINCT FROM o THEN 'district' END AS fault
             FROM (SELECT *, regexp_replace(regexp_replace(trim("Postcode"), '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g') AS p,
                     nullif(regexp_extract(o, '([A-Z][A-Z]?)([0-9].*)', 1), '') AS area, nullif(regexp_extract(o, '([A-Z][A-Z]?)([0-9].*)', 2), '') AS district
                   FROM (SELECT *, trim(left("Postcode", length("Postcode") - 3)) AS o FROM spoilt))) WHERE fault IS NOT NULL""",
        spoilt=_SPOILT_SQL,
    ),
)
def _(spark, sf):
    """The faults that building finds in a spoilt table."""
    return generate.build_postcodes(_spoilt(fixtures.postcodes(spark, sf)), generate.stored_lookups(common.lookups(spark, sf))).faults


@query("q1_audit", sql("scanned areas countries counties districts wards", _audit_sql()))
def _(spark, sf):
    """The audit that comes with the built table."""
    return generate.build_postcodes(fixtures.postcodes(spark, sf), generate.stored_lookups(common.lookups(spark, sf))).audit


_HEADINGS = ",".join(HEADER_SHORT) + "\n" + " , ".join(HEADER_LONG)


def _zip_areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive per batch of rows with headings and a file per area, one with a stray folder and one that is no archive."""
    for batch in batches:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("Doc/Column_Headers.csv", _HEADINGS)
            for file, rows in batch.groupby("file"):
                z.writestr(f"Data/CSV/{file}", rows[HEADER_LONG].to_csv(header=False, index=False))
        stray = io.BytesIO()
        with zipfile.ZipFile(stray, "w") as z:
            z.writestr("Data/../ng.csv", "AB1 0AA\n")
        first = batch["row_id"].iloc[0]
        yield pd.DataFrame({"archive": [f"a{first}.zip", f"b{first}.zip", f"c{first}.zip"], "content": [out.getvalue(), stray.getvalue(), b"PK"]})


def _built(spark: SparkSession, sf: str) -> generate.Built:
    zipped = common.stored_archives(ingest._raw(spark, sf).mapInPandas(_zip_areas, "archive string, content binary"))
    return generate.build_from_archive(
        spark, zipped, fixtures.area_sheet(spark, sf), fixtures.county_sheet(spark, sf), fixtures.district_sheets(spark, sf), fixtures.ward_sheets(spark, sf)
    )


@query("q1_from_archive", ORACLES["q1_generate"])
def _(spark, sf):
    """Archives to the finished table, saved and loaded; stray and broken archives add nothing to it."""
    path, built = scratch.scratch_path(spark, "table"), _built(spark, sf).table
    tables.save_table(built, path)
    return tables.load_table(spark, path, built.schema)


@query(
    "s3_load_faults",
    sql(
        "scanned",
        _KEYS_SQL + """ UNION ALL SELECT 'heading', 'line 2', 1 UNION ALL SELECT 'row', reason || ' ' || line, 1 FROM (
          SELECT 'value' AS reason, 'ZZ' || row_id || ',10,abc,1,E92000001,R1,H1,C1,D1,W1' AS line FROM scanned WHERE row_id % 211 = 3
          UNION ALL SELECT 'too many fields', 'ZZ' || row_id || ',10,1,1,E92000001,R1,H1,C1,D1,W1,,more' FROM scanned WHERE row_id % 211 = 4
          UNION ALL SELECT 'too few fields', 'ZZ' || row_id || ',10,1' FROM scanned WHERE row_id % 211 = 5)""",
        spoilt=_SPOILT_SQL,
    ),
)
def _(spark, sf):
    """Faults of a folder with spoilt rows and a heading file whose second line is wrong."""
    heading_file, folder = scratch.scratch_path(spark, "headings"), scratch.scratch_path(spark, "csv")
    spark.createDataFrame([(_HEADINGS + "_",)], "value string").coalesce(1).write.text(heading_file)
    raw = fixtures.scanned_postcodes(spark, sf).withColumnRenamed("Quality", "Positional_quality_indicator")
    _spoilt(raw).select(*HEADER_LONG, F.concat(F.lower("Postcode_area"), F.lit(".csv")).alias("file")).write.partitionBy("file").csv(folder)
    kinds = F.array(*[F.lit(x) for x in (",10,abc,1,E92000001,R1,H1,C1,D1,W1", ",10,1,1,E92000001,R1,H1,C1,D1,W1,,more", ",10,1")])
    odd = raw.filter("row_id % 211 in (3, 4, 5)").select(F.concat(F.lit("ZZ"), "row_id", F.get(kinds, (F.col("row_id") % 211 - 3).cast("int"))))
    odd.write.option("sep", "\t").csv(f"{folder}/file=xy.csv")
    _, faults = postcodes.load_postcode_folder(spark, folder, heading_file)
    subject = F.when(F.col("check") == "heading", F.regexp_extract("subject", r"line \d+$", 0)).when(F.col("check") == "row", F.regexp_extract("subject", r"((value|too few fields|too many fields) ZZ.*)$", 0)).otherwise(F.col("subject"))
    return faults.withColumn("subject", subject)


@query(
    "s9_lookup_faults",
    sql(
        "areas counties",
        """SELECT 'areas' AS lookup, "Postcode Area" AS key_value, 2::BIGINT AS cases FROM areas WHERE "Postcode Area" < 'F'
           UNION ALL SELECT 'counties', NULL, count(*) FROM counties WHERE "County Code" < 'C2' HAVING count(*) > 0
           UNION ALL SELECT 'wards', 'empty', 0""",
    ),
)
def _(spark, sf):
    """Doubled areas, counties without a code, and no wards."""
    loaded = common.lookups(spark, sf)
    code = F.col("County Code")
    spoilt = loaded | {
        "areas": loaded["areas"].unionByName(loaded["areas"].filter(F.col("Postcode Area") < "F")),
        "counties": loaded["counties"].withColumn("County Code", F.when(code >= "C2", code)),
        "wards": loaded["wards"].filter(F.lit(False)),
    }
    return sheets.lookup_faults(spoilt)


_RAW_MISSING = [c for c in CATEGORY_COLUMNS if c in LOOKED_UP_COLUMNS + DERIVED_COLUMNS]


@query(
    "f13_missing_columns",
    sql("scanned", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS "rows" FROM scanned""" for c in _RAW_MISSING)),
)
def _(spark, sf):
    """Required columns that the scanned table lacks, with the rows that lack them."""
    table = fixtures.postcodes(spark, sf)
    missing = F.array(*[F.lit(c) for c in quality.missing_columns(table)])
    return table.agg(F.count("*").alias("rows")).select(F.explode(missing).alias("column"), "rows")


@query(
    "u4_common_columns",
    sql("scanned", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count("{c}") AS non_null FROM scanned""" for c in CATEGORY_COLUMNS if c not in _RAW_MISSING)),
)
def _(spark, sf):
    """Required columns that the scanned table has, with their values."""
    table = fixtures.postcodes(spark, sf)
    missing = quality.missing_columns(table)
    counts = table.agg(*[F.count(c).alias(c) for c in CATEGORY_COLUMNS if c not in missing])
    return counts.unpivot([], counts.columns, "column", "non_null")


@query("q5_to_csv", sql("scanned", f"""SELECT {", ".join(f'"{c}"' for c in SCANNED_COLUMNS)}, row_id FROM scanned"""))
def _(spark, sf):
    """The whole table exported and read back."""
    out, df = scratch.scratch_path(spark, "export"), fixtures.postcodes(spark, sf)
    tables.export_csv(df, out)
    return spark.read.schema(df.schema).option("header", True).csv(tables.csv_path(out))
