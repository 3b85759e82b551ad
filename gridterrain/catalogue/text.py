"""Registered queries of postcode and place-name expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridterrain import fixtures
from gridterrain.catalogue import common
from gridterrain.catalogue.oracle import sql
from gridterrain.catalogue.registry import query
from gridterrain.functions import text


def _untidy():
    """Spellings of a postcode, by row."""
    pc, k = F.col("Postcode"), F.col("row_id")
    return (
        F.when(k % 5 == 0, F.concat(F.lit("  "), F.lower(pc), F.lit(" ")))
        .when(k % 5 == 1, F.replace(pc, F.lit(" "), F.lit("")))
        .when(k % 5 == 2, F.concat(F.lit("\t"), F.left(pc, F.lit(2)), F.lit("  "), F.right(pc, F.lit(5)), F.lit("\n")))
        .when(k % 5 == 3, F.left(pc, F.lit(4)))
        .otherwise(F.concat(pc, F.lit(" x")))
    )


_UNTIDY = """CASE row_id % 5 WHEN 0 THEN '  ' || lower("Postcode") || ' ' WHEN 1 THEN replace("Postcode", ' ', '')
  WHEN 2 THEN chr(9) || left("Postcode", 2) || '  ' || right("Postcode", 5) || chr(10)
  WHEN 3 THEN left("Postcode", 4) ELSE "Postcode" || ' x' END"""


@query(
    "p1_normalise_postcode",
    sql(
        "scanned",
        """SELECT row_id, CASE WHEN length(t) IN (5, 6) THEN left(t, length(t) - 3) || repeat(' ', 7 - length(t)) || right(t, 3) ELSE t END AS postcode
           FROM (SELECT row_id, replace(regexp_replace(regexp_replace(upper(u), '^\\s+', ''), '\\s+$', ''), ' ', '') AS t FROM untidy)""",
        untidy=f"SELECT row_id, {_UNTIDY} AS u FROM scanned",
    ),
)
def _(spark, sf):
    return fixtures.postcodes(spark, sf).select("row_id", text.normalise_postcode(_untidy()).alias("postcode"))


@query(
    "p3_shape_mask",
    sql("scanned", """SELECT row_id, regexp_replace(regexp_replace(trim("Postcode"), '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g') AS shape FROM scanned"""),
)
def _(spark, sf):
    return fixtures.postcodes(spark, sf).select("row_id", text.shape(F.col("Postcode")).alias("shape"))


@query(
    "p4_inward_outward",
    sql("scanned", """SELECT row_id, trim(right("Postcode", 3)) AS inward, trim(left("Postcode", length("Postcode") - 3)) AS outward FROM scanned"""),
)
def _(spark, sf):
    pc = F.col("Postcode")
    return fixtures.postcodes(spark, sf).select("row_id", text.inward(pc).alias("inward"), text.outward(pc).alias("outward"))


@query(
    "p5_area_district",
    sql(
        "scanned",
        """SELECT row_id, nullif(regexp_extract(o, '([A-Z][A-Z]?)([0-9].*)', 1), '') AS area,
             nullif(regexp_extract(o, '([A-Z][A-Z]?)([0-9].*)', 2), '') AS district
           FROM (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN reverse("Postcode") ELSE trim(left("Postcode", 4)) END AS o FROM scanned)""",
    ),
)
def _(spark, sf):
    o = F.when(F.col("row_id") % 7 == 0, F.reverse("Postcode")).otherwise(text.outward(F.col("Postcode")))
    return fixtures.postcodes(spark, sf).select(
        "row_id", text.outward_area(o).alias("area"), text.outward_district(o).alias("district")
    )


@query(
    "p6_county_name",
    sql(
        "",
        """SELECT c_custkey, trim(replace(trim(CASE c_custkey % 3 WHEN 0 THEN ' ' || c_mktsegment || '  County ' WHEN 1 THEN 'County ' || c_mktsegment
             ELSE c_mktsegment || ' County County Y' END), ' County', '')) AS name FROM customer""",
    ),
)
def _(spark, sf):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit(" "), s, F.lit("  County ")))
        .when(k % 3 == 1, F.concat(F.lit("County "), s))
        .otherwise(F.concat(s, F.lit(" County County Y")))
    )
    return fixtures.table(spark, sf, "customer").select("c_custkey", text.county_name(raw).alias("name"))


@query(
    "p7_london_borough",
    sql(
        "",
        """SELECT p_partkey, CASE WHEN t LIKE '%London Boro' THEN 'London Borough of ' || trim(replace(t, ' London Boro', ''))
             WHEN t LIKE '%City of London%' THEN 'City of London' ELSE t END AS name
           FROM (SELECT p_partkey, trim(CASE p_partkey % 3 WHEN 0 THEN ' ' || p_name || ' London Boro' WHEN 1 THEN p_name || ' City of London Corp'
             ELSE '  ' || p_name || ' ' END) AS t FROM part)""",
    ),
)
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_name")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit(" "), s, F.lit(" London Boro")))
        .when(k % 3 == 1, F.concat(s, F.lit(" City of London Corp")))
        .otherwise(F.concat(F.lit("  "), s, F.lit(" ")))
    )
    return fixtures.table(spark, sf, "part").select("p_partkey", text.london_borough_name(raw).alias("name"))


DESCRIPTION = """concat_ws(', ', coalesce(nullif(replace(replace(coalesce("Ward Name", ''), ' Ward', ''), ' ED', ''), ''), '[No ward]'),
  nullif(replace(replace(replace(coalesce("District Name", ''), ' (B)', ''), ' District', ''), ' London Borough', ', London'), ''),
  nullif(coalesce("County Name", ''), ''))"""


@query("p8_location_description", sql("named", f"SELECT row_id, {DESCRIPTION} AS description FROM named"))
def _(spark, sf):
    from gridterrain.operators.spatial import describe_location

    return describe_location(common.named(spark, sf)).select("row_id", "description")


@query(
    "p9_display_postcode",
    sql(
        "scanned",
        """SELECT row_id, CASE WHEN strpos("Postcode", ' ') = 0 THEN left("Postcode", 4) || ' ' || right("Postcode", 3) ELSE "Postcode" END AS display,
             lower(replace("Postcode", ' ', '')) AS file_key FROM scanned""",
    ),
)
def _(spark, sf):
    pc = F.col("Postcode")
    return fixtures.postcodes(spark, sf).select(
        "row_id", text.display_postcode(pc).alias("display"), text.postcode_file_key(pc).alias("file_key")
    )
