"""Registered queries of lookups, audits, filters, extents and reports over the postcode table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gridterrain import fixtures
from gridterrain.catalogue import common
from gridterrain.catalogue.oracle import sql
from gridterrain.catalogue.registry import query
from gridterrain.operators import quality, reports, rows, spatial
from gridterrain.plans.generate import stored_lookups
from gridterrain.schemas import CATEGORY_COLUMNS, DERIVED_COLUMNS, LOOKED_UP_COLUMNS, LOOKUPS, SCANNED_COLUMNS, VALID_PATTERNS
from gridterrain.scratch import cut

_SCANNED = ", ".join(f'"{c}"' for c in SCANNED_COLUMNS)
_NAMES = ["Post Town", "Country Name", "County Name", "District Name", "Ward Name"]
_RANGE = 'min("Eastings") AS "Min_E", max("Eastings") AS "Max_E", min("Northings") AS "Min_N", max("Northings") AS "Max_N"'


def _stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Reports on top of each other with their name as ``part``; columns that a report lacks are null."""
    named = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


@query("a10_key_check", sql("scanned", """SELECT key_value, count(*) AS cases FROM (
    SELECT CASE WHEN row_id % 97 = 0 THEN NULL WHEN row_id % 31 = 0 THEN 'DUP' || (row_id % 5)::VARCHAR ELSE "Postcode" END AS key_value FROM scanned)
  GROUP BY 1 HAVING count(*) > 1 OR key_value IS NULL"""))
def _(spark, sf):
    spoilt = fixtures.postcodes(spark, sf).selectExpr(
        "case when row_id % 97 = 0 then null when row_id % 31 = 0 then concat('DUP', row_id % 5) else Postcode end as Postcode"
    )
    return quality.key_violations(spoilt, "Postcode")


@query("j1_add_lookups", sql("named", f"SELECT row_id, {', '.join(f'\"{c}\"' for c in _NAMES)} FROM named"))
def _(spark, sf):
    return common.named(spark, sf).select("row_id", *[f"`{c}`" for c in _NAMES])


@query(
    "j2_unused_lookups",
    sql(
        "scanned areas countries counties districts wards",
        " UNION ALL ".join(
            f"""SELECT '{p}' AS lookup, "{key}" AS code, "{value}" AS name FROM {p}
                WHERE "{key}" NOT IN (SELECT "{code}" FROM scanned WHERE "{code}" IS NOT NULL)"""
            for p, code, key, value in LOOKUPS
        ),
    ),
)
def _(spark, sf):
    table, loaded, out = fixtures.postcodes(spark, sf), common.lookups(spark, sf), None
    for name, *spec in LOOKUPS:
        part = quality.unused_lookups(table, loaded[name], *spec).select(F.lit(name).alias("lookup"), "code", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j3_failed_lookups",
    sql(
        "scanned areas countries counties districts wards",
        " UNION ALL ".join(
            f"""SELECT '{p}' AS lookup, "{code}" AS code, count(*) AS cases FROM scanned
                WHERE "{code}" IS NOT NULL AND "{code}" NOT IN (SELECT "{key}" FROM {p}) GROUP BY 2"""
            for p, code, key, _ in LOOKUPS
        ),
    ),
)
def _(spark, sf):
    table, loaded, out = fixtures.postcodes(spark, sf), common.lookups(spark, sf), None
    for name, *spec in LOOKUPS:
        part = quality.failed_lookups(table, loaded[name], *spec).select(F.lit(name).alias("lookup"), "code", "cases")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j4_null_codes",
    sql(
        "scanned",
        " UNION ALL ".join(
            f"""SELECT '{code}' AS code_column, count(*) FILTER (WHERE "{code}" IS NULL AND "Quality" IN (60, 90)) AS known_issue,
                  count(*) FILTER (WHERE "{code}" IS NULL AND "Quality" NOT IN (60, 90)) AS other FROM scanned"""
            for _, code, _, _ in LOOKUPS
        ),
    ),
)
def _(spark, sf):
    return quality.null_codes(fixtures.postcodes(spark, sf), [s[1] for s in LOOKUPS])


def _audit_sql() -> str:
    parts = []
    for p, code, key, _ in LOOKUPS:
        parts.append(f"""SELECT 'unused' AS "check", '{code}' AS code_column, "{key}" AS code, 0::BIGINT AS cases FROM {p}
            WHERE "{key}" NOT IN (SELECT "{code}" FROM scanned WHERE "{code}" IS NOT NULL)""")
        parts.append(f"""SELECT 'failed', '{code}', "{code}", count(*) FROM scanned WHERE "{code}" IS NOT NULL
            AND "{code}" NOT IN (SELECT "{key}" FROM {p}) GROUP BY 3""")
        for label, test in (("unlocated", "IN"), ("located", "NOT IN")):
            parts.append(f"""SELECT 'null, {label}', '{code}', NULL, count(*) FILTER (WHERE "Quality" {test} (60, 90)) FROM scanned
                WHERE "{code}" IS NULL HAVING count(*) > 0""")
    return " UNION ALL ".join(parts)


@query("j2_j3_j4_audit", sql("scanned areas countries counties districts wards", _audit_sql()))
def _(spark, sf):
    return quality.audit(fixtures.postcodes(spark, sf), stored_lookups(common.lookups(spark, sf)))


_PATTERNS = ", ".join(f"'{p}'" for p in VALID_PATTERNS)


@query(
    "f11_breakdown_faults",
    sql(
        "scanned",
        f"""SELECT "Postcode", "Postcode_area", "Pattern", CASE WHEN "Pattern" IS NULL OR "Pattern" NOT IN ({_PATTERNS}) THEN 'pattern'
             WHEN area IS DISTINCT FROM "Postcode_area" THEN 'area' WHEN area || district IS DISTINCT FROM o THEN 'district' END AS fault
           FROM (SELECT *, regexp_replace(regexp_replace(trim("Postcode"), '[0-9]', '9', 'g'), '[A-Z]', 'X', 'g') AS "Pattern",
                   nullif(regexp_extract(o, '([A-Z][A-Z]?)([0-9].*)', 1), '') AS area, nullif(regexp_extract(o, '([A-Z][A-Z]?)([0-9].*)', 2), '') AS district
                 FROM (SELECT *, trim(left("Postcode", greatest(length("Postcode") - 3, 0))) AS o FROM spoilt))
           WHERE fault IS NOT NULL""",
        spoilt="""SELECT CASE row_id % 53 WHEN 1 THEN lower("Postcode") WHEN 2 THEN '9' || "Postcode" WHEN 3 THEN NULL WHEN 4 THEN 'A' ELSE "Postcode" END AS "Postcode",
             CASE row_id % 53 WHEN 5 THEN 'ZZ' WHEN 6 THEN NULL ELSE "Postcode_area" END AS "Postcode_area" FROM scanned""",
    ),
)
def _(spark, sf):
    spoilt = fixtures.postcodes(spark, sf).selectExpr(
        "case row_id % 53 when 1 then lower(Postcode) when 2 then concat('9', Postcode) when 3 then null when 4 then 'A' else Postcode end as Postcode",
        "case row_id % 53 when 5 then 'ZZ' when 6 then null else Postcode_area end as Postcode_area",
    )
    return quality.breakdown_faults(quality.add_breakdown(spoilt))


@query(
    "f1_postcode_info",
    sql(
        "parted",
        "SELECT \"Postcode\", field, value FROM (SELECT "
        + ", ".join(f'"{c}"::VARCHAR AS "{c}"' for c in [*SCANNED_COLUMNS, *_NAMES, "Pattern", "Inward", "Outward", "District"])
        + """ FROM parted WHERE "Postcode" = 'NG2 0AA') UNPIVOT INCLUDE NULLS (value FOR field IN (COLUMNS(* EXCLUDE "Postcode")))""",
    ),
)
def _(spark, sf):
    found = spatial.find_postcode(common.parted(spark, sf).drop("row_id"), " ng2 0aa")
    return spatial.as_fields(found)


@query("q2_info_batch", sql("scanned", f"""SELECT c_custkey, {_SCANNED} FROM customer JOIN scanned ON scanned.row_id = c_custkey"""))
def _(spark, sf):
    """Every customer asks for the postcode of the order with its number, in lower case without spaces."""
    from gridterrain.functions.text import normalise_postcode

    table = fixtures.postcodes(spark, sf)
    asked = fixtures.table(spark, sf, "customer").select("c_custkey").join(
        table.selectExpr("row_id as c_custkey", "lower(replace(Postcode, ' ', '')) as asked"), "c_custkey"
    )
    wanted = asked.select("c_custkey", normalise_postcode(F.col("asked")).alias("_pc"))
    return wanted.join(table, F.col("_pc") == F.col("Postcode")).select("c_custkey", *SCANNED_COLUMNS)


@query("f2_area_filter", sql("scanned", f"SELECT {_SCANNED}, row_id FROM scanned WHERE \"Postcode_area\" = 'TQ'"))
def _(spark, sf):
    return fixtures.postcodes(spark, sf).filter(F.col("Postcode_area") == "tq".upper())


@query(
    "f3_rectangle",
    sql("scanned", f'SELECT {_SCANNED}, row_id FROM scanned WHERE "Eastings" BETWEEN 100000 AND 300000 AND "Northings" BETWEEN 200000 AND 700000'),
)
def _(spark, sf):
    return spatial.within(fixtures.postcodes(spark, sf), spatial.Box.of(100_000, 200_000, 300_000, 700_000))


@query(
    "f4_square_filter",
    sql("scanned", 'SELECT count(*) AS cases, count(*) FILTER (WHERE "Eastings" <> 0) AS located FROM scanned WHERE "Eastings" BETWEEN 0 AND 100000 AND "Northings" BETWEEN 0 AND 100000'),
)
def _(spark, sf):
    inside = spatial.within(fixtures.postcodes(spark, sf), spatial.square_box(0, 0))
    return inside.agg(F.count("*").alias("cases"), F.count_if(F.col("Eastings") != 0).alias("located"))


@query(
    "f5_around_postcode",
    sql(
        "scanned",
        """SELECT s."Postcode", s."Eastings", s."Northings", s.row_id FROM scanned s JOIN scanned c ON c."Postcode" = 'NG3 1AA'
             AND s."Eastings" BETWEEN c."Eastings" - 5000 AND c."Eastings" + 5000 AND s."Northings" BETWEEN c."Northings" - 5000 AND c."Northings" + 5000""",
    ),
)
def _(spark, sf):
    table = fixtures.postcodes(spark, sf)
    box = spatial.Box.from_row(spatial.neighbourhood(spatial.find_postcode(table, "ng31aa")))
    return spatial.within(table, box).select("Postcode", "Eastings", "Northings", "row_id")


@query("f6_located", sql("scanned", 'SELECT "Postcode_area", count(*) AS cases FROM scanned WHERE "Eastings" <> 0 GROUP BY 1'))
def _(spark, sf):
    return spatial.located(fixtures.postcodes(spark, sf)).groupBy("Postcode_area").agg(F.count("*").alias("cases"))


@query("f10_thinning", sql("scanned", f"SELECT {_SCANNED}, row_id FROM scanned WHERE row_id % 100 = 0"))
def _(spark, sf):
    return rows.thin(fixtures.postcodes(spark, sf), 100)


@query(
    "j8_square_join",
    sql(
        "scanned grid",
        """SELECT g.name AS square, count(*) AS cases, count(*) FILTER (WHERE s."Eastings" <> 0) AS located
           FROM scanned s JOIN grid g ON s."Eastings" BETWEEN g.easting_index * 100000 AND (g.easting_index + 1) * 100000
             AND s."Northings" BETWEEN g.northing_index * 100000 AND (g.northing_index + 1) * 100000 GROUP BY 1""",
    ),
)
def _(spark, sf):
    joined = spatial.squares_of(fixtures.postcodes(spark, sf).select("Eastings", "Northings"))
    return joined.groupBy("square").agg(F.count("*").alias("cases"), F.count_if(F.col("Eastings") != 0).alias("located"))


@query(
    "j8_square_rows",
    sql(
        "scanned grid",
        """SELECT s.row_id, g.name AS square FROM (SELECT row_id, "Eastings" // 1000 * 1000 AS e, "Northings" // 1000 * 1000 AS n FROM scanned) s
           JOIN grid g ON e BETWEEN g.easting_index * 100000 AND (g.easting_index + 1) * 100000
             AND n BETWEEN g.northing_index * 100000 AND (g.northing_index + 1) * 100000""",
    ),
)
def _(spark, sf):
    """Coordinates cut to whole kilometres, so that many rows lie on the edge of a square."""
    cut = fixtures.postcodes(spark, sf).selectExpr(
        "row_id", "int(Eastings div 1000 * 1000) as Eastings", "int(Northings div 1000 * 1000) as Northings"
    )
    return spatial.squares_of(cut).select("row_id", "square")


_CENTRES = 'SELECT s_suppkey AS centre_id, "Eastings" AS ce, "Northings" AS cn FROM supplier JOIN scanned ON row_id = s_suppkey'


def _centres(spark, sf):
    """Every supplier is at the postcode of the order with its number."""
    return fixtures.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id")).join(
        fixtures.postcodes(spark, sf).select("row_id", "Eastings", "Northings"), "row_id"
    ).withColumnRenamed("row_id", "centre_id")


@query(
    "j9_around_counts",
    sql(
        "scanned",
        f"""SELECT c.centre_id, count(s.row_id) AS points, {_RANGE} FROM centres c LEFT JOIN scanned s
            ON s."Eastings" BETWEEN ce - 5000 AND ce + 5000 AND s."Northings" BETWEEN cn - 5000 AND cn + 5000 GROUP BY 1""",
        centres=_CENTRES,
    ),
)
def _(spark, sf):
    return spatial.around_counts(fixtures.postcodes(spark, sf), _centres(spark, sf))


@query(
    "j9_around_rows",
    sql(
        "scanned",
        """SELECT ce AS centre_e, cn AS centre_n, count(DISTINCT c.centre_id) AS centres, s."Eastings", s."Northings", count(DISTINCT s.row_id) AS points
           FROM centres c JOIN scanned s ON s."Eastings" BETWEEN ce - 5000 AND ce + 5000 AND s."Northings" BETWEEN cn - 5000 AND cn + 5000 GROUP BY ALL""",
        centres=_CENTRES,
    ),
)
def _(spark, sf):
    return spatial.around_rows(fixtures.postcodes(spark, sf), _centres(spark, sf))


# Reports.


@query(
    "a1_area_counts",
    sql("scanned", 'SELECT "Postcode_area", ' + ", ".join(f'count("{c}") AS "{c}"' for c in SCANNED_COLUMNS if c != "Postcode_area") + " FROM scanned GROUP BY 1"),
)
def _(spark, sf):
    return reports.area_counts(fixtures.postcodes(spark, sf))


_VALUES = " UNION ALL ".join(
    f"""SELECT {i}::INT AS section, '{c}' AS "column", "{c}"::VARCHAR AS value, count(*) AS cases FROM scanned WHERE "{c}" IS NOT NULL GROUP BY 3"""
    for i, c in enumerate(reports.COUNTED_COLUMNS)
)


@query("a2_value_counts", sql("scanned", _VALUES))
def _(spark, sf):
    return reports.value_counts(fixtures.postcodes(spark, sf))


@query("a3_distinct_areas", sql("scanned", 'SELECT DISTINCT "Postcode_area" FROM scanned'))
def _(spark, sf):
    return reports.distinct_areas(fixtures.postcodes(spark, sf))


@query(
    "q3_stats",
    sql(
        "scanned",
        "SELECT section, \"column\", value, cases FROM (" + _VALUES + ") UNION ALL SELECT 7, c, \"Postcode_area\", n FROM (SELECT \"Postcode_area\", "
        + ", ".join(f'count("{c}") AS "{c}"' for c in SCANNED_COLUMNS if c != "Postcode_area")
        + " FROM scanned GROUP BY 1) UNPIVOT (n FOR c IN (COLUMNS(* EXCLUDE \"Postcode_area\")))"
        + ' UNION ALL SELECT 8, \'Postcode_area\', "Postcode_area", 0 FROM (SELECT DISTINCT "Postcode_area" FROM scanned)',
    ),
)
def _(spark, sf):
    """All parts of the statistics report in one table: value counts, column counts by area, area list."""
    table = fixtures.postcodes(spark, sf)
    counts = reports.area_counts(table)
    long = counts.unpivot("Postcode_area", [c for c in counts.columns if c != "Postcode_area"], "column", "cases")
    by_area = long.select(F.lit(7).alias("section"), "column", F.col("Postcode_area").alias("value"), "cases")
    areas = reports.distinct_areas(table).select(
        F.lit(8).alias("section"), F.lit("Postcode_area").alias("column"), F.col("Postcode_area").alias("value"), F.lit(0).cast("bigint").alias("cases")
    )
    return reports.value_counts(table).unionByName(by_area).unionByName(areas)


@query(
    "a4_quality_counts",
    sql("parted", 'SELECT "Quality", ' + ", ".join(f'count("{c}") AS "{c}"' for c in ["Postcode", "Postcode_area", "Eastings", "Northings", "County Name", "District Name", "Ward Name"]) + " FROM parted GROUP BY 1"),
)
def _(spark, sf):
    return reports.quality_counts(common.named(spark, sf))


@query("a5_quality_ranges", sql("scanned", f'SELECT "Quality", count(*) AS "Cases", {_RANGE} FROM scanned GROUP BY 1'))
def _(spark, sf):
    return reports.quality_ranges(fixtures.postcodes(spark, sf))


@query("a6_pattern_counts", sql("parted", 'SELECT "Pattern", count(*) AS "Postcode" FROM parted GROUP BY 1'))
def _(spark, sf):
    return reports.pattern_counts(quality.add_breakdown(fixtures.postcodes(spark, sf)))


@query("a7_outward_counts", sql("parted", 'SELECT "Postcode_area", "Post Town", "Outward", count(*) AS "Postcode" FROM parted GROUP BY 1, 2, 3'))
def _(spark, sf):
    return reports.outward_counts(quality.add_breakdown(common.with_towns(spark, sf)))


@query("a8_outwards_per_area", sql("parted", 'SELECT "Postcode_area", "Post Town", count(DISTINCT "Outward") AS "Outward" FROM parted GROUP BY 1, 2'))
def _(spark, sf):
    return reports.outwards_per_area(quality.add_breakdown(common.with_towns(spark, sf)))




@query("a9_extent", sql("extent", "SELECT * FROM extent"))
def _(spark, sf):
    return spatial.extent(fixtures.postcodes(spark, sf), spatial.EXTENT_MARGIN)


@query(
    "a11_code_usage",
    sql(
        "named",
        """SELECT code, name, cases, greatest((SELECT count(*) FROM used) - 10, 0)::BIGINT AS more FROM used ORDER BY code, name LIMIT 10""",
        used="""SELECT "Admin_district_code" AS code, "District Name" AS name, count(*) AS cases FROM named WHERE "District Name" IS NOT NULL GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    from gridterrain.sources.lookups import district_lookup

    spec = LOOKUPS[3]
    lookup = district_lookup(fixtures.district_sheets(spark, sf))
    table = quality.add_lookup(fixtures.postcodes(spark, sf), lookup, *spec[1:])
    return reports.code_usage(table, "Admin_district_code", "District Name", 10)


@query(
    "a12_area_extents",
    sql("scanned", f'SELECT "Postcode_area" AS area, count(*) AS "Cases", {_RANGE} FROM scanned WHERE "Eastings" <> 0 GROUP BY 1'),
)
def _(spark, sf):
    return spatial.area_extents(quality.add_breakdown(fixtures.postcodes(spark, sf)), "Postcode_area")


@query(
    "l1_extents_by_outward",
    sql("parted", f'SELECT "Outward" AS area, count(*) AS "Cases", {_RANGE} FROM parted WHERE "Eastings" <> 0 GROUP BY 1 ORDER BY "Min_E", area'),
)
def _(spark, sf):
    extents = spatial.area_extents(quality.add_breakdown(fixtures.postcodes(spark, sf)), "Outward")
    return extents.orderBy("Min_E", "area")


@query(
    "p17_area_kinds",
    sql(
        "parted",
        " UNION ALL ".join(
            f"""SELECT '{kind}' AS kind, count(DISTINCT "{c}") AS areas, count("{c}") AS cases FROM parted WHERE "Eastings" <> 0"""
            for kind, c in [*spatial.AREA_COLUMNS.items(), ("xx", "Postcode_area")]
        ),
    ),
)
def _(spark, sf):
    table, out = spatial.located(common.parted(spark, sf)), None
    for kind in [*spatial.AREA_COLUMNS, "xx"]:
        found = spatial.area_extents(table, spatial.area_column(kind))
        part = found.agg(F.count("*").alias("areas"), F.sum("Cases").alias("cases")).select(F.lit(kind).alias("kind"), "areas", "cases")
        out = part if out is None else out.unionByName(part)
    return out


_PROFILE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count("{c}") AS "count", round(avg("{c}"), 4) AS mean, round(stddev_samp("{c}"), 4) AS std, min("{c}")::DOUBLE AS "min",
          quantile_cont("{c}"::DOUBLE, 0.25) AS q25, quantile_cont("{c}"::DOUBLE, 0.5) AS q50, quantile_cont("{c}"::DOUBLE, 0.75) AS q75, max("{c}")::DOUBLE AS "max" FROM scanned"""
    for c in ("Eastings", "Northings")
)


def _rounded(profile):
    return profile.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@query("a13_numeric_profile", sql("scanned", _PROFILE))
def _(spark, sf):
    return _rounded(reports.numeric_profile(fixtures.postcodes(spark, sf), ["Eastings", "Northings"]))


_CATEGORIES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", sum(n)::BIGINT AS "count", count(*) AS "unique", min_by(v, (-n, v)) AS top, max(n) AS freq
        FROM (SELECT "{c}"::VARCHAR AS v, count(*) AS n FROM parted WHERE "{c}" IS NOT NULL GROUP BY 1)"""
    for c in CATEGORY_COLUMNS
)


@query("a14_category_profile", sql("parted", _CATEGORIES))
def _(spark, sf):
    return reports.category_profile(common.parted(spark, sf))


_TYPES = {"Quality": "int", "Eastings": "int", "Northings": "int", "row_id": "bigint"}
_COLUMNS = " UNION ALL ".join(
    f"""SELECT {i}::INT AS position, '{c}' AS "column", '{_TYPES.get(c, "string")}' AS "type", count("{c}") AS non_null, count(*) AS "rows" FROM scanned"""
    for i, c in enumerate([*SCANNED_COLUMNS, "row_id"])
)


@query("a15_column_report", sql("scanned", _COLUMNS))
def _(spark, sf):
    return reports.column_report(fixtures.postcodes(spark, sf))


_FINISHED = [*SCANNED_COLUMNS, "row_id", *LOOKED_UP_COLUMNS, *DERIVED_COLUMNS]
_FINISHED_COLUMNS = " UNION ALL ".join(
    f"""SELECT {i}::INT AS position, '{c}' AS "column", '{_TYPES.get(c, "string")}' AS "type", count("{c}") AS non_null, count(*) AS "rows" FROM parted"""
    for i, c in enumerate(_FINISHED)
)


@query(
    "q4_df_info",
    sql(
        "parted",
        f"""SELECT 'category' AS part, * FROM ({_CATEGORIES}) UNION ALL BY NAME SELECT 'numeric' AS part, * FROM ({_PROFILE})
            UNION ALL BY NAME SELECT 'column' AS part, * FROM ({_FINISHED_COLUMNS})""",
    ),
)
def _(spark, sf):
    """The whole profile of the finished table in one result: categories, numbers and columns."""
    table = cut(common.parted(spark, sf).select(*[f"`{c}`" for c in _FINISHED]), "parted")
    parts = {
        "category": reports.category_profile(table), "numeric": _rounded(reports.numeric_profile(table, ["Eastings", "Northings"])),
        "column": reports.column_report(table),
    }
    return _stacked(parts)


@query(
    "l3_quality_examples",
    sql("scanned", f"""SELECT {_SCANNED}, row_id FROM scanned WHERE "Quality" IN (60, 90)
        QUALIFY row_number() OVER (PARTITION BY "Quality" ORDER BY row_id) <= 10"""),
)
def _(spark, sf):
    return reports.quality_examples(fixtures.postcodes(spark, sf))


_COUNTED = ["Postcode", "Postcode_area", "Eastings", "Northings", "County Name", "District Name", "Ward Name"]
_LOCATION = f"""SELECT 'counts' AS part, "Quality", {", ".join(f'count("{c}") AS "with {c}"' for c in _COUNTED)} FROM parted GROUP BY 2
  UNION ALL BY NAME SELECT 'ranges' AS part, "Quality", count(*) AS "Cases", {_RANGE} FROM parted GROUP BY 2
  UNION ALL BY NAME SELECT 'examples' AS part, "Quality", row_id, "Postcode", "Eastings", "Northings", "District Name", "Ward Name" FROM parted WHERE "Quality" IN (60, 90)
    QUALIFY row_number() OVER (PARTITION BY "Quality" ORDER BY row_id) <= 10
  UNION ALL BY NAME SELECT 'patterns' AS part, "Pattern", count("Postcode") AS "Cases" FROM parted GROUP BY 2
  UNION ALL BY NAME SELECT 'outwards' AS part, "Postcode_area", "Post Town", "Outward", count("Postcode") AS "Cases" FROM parted WHERE "Post Town" IS NOT NULL GROUP BY 2, 3, 4
  UNION ALL BY NAME SELECT 'outwards of areas' AS part, "Postcode_area", "Post Town", count(DISTINCT "Outward") AS "Cases" FROM parted WHERE "Post Town" IS NOT NULL GROUP BY 2, 3"""


@query("q13_location_reports", sql("parted", _LOCATION))
def _(spark, sf):
    """All location-quality and pattern reports in one result."""
    table = cut(common.parted(spark, sf), "parted")
    examples = ["Quality", "row_id", "Postcode", "Eastings", "Northings", "`District Name`", "`Ward Name`"]
    parts = {
        "counts": reports.quality_counts(table).withColumnsRenamed({c: f"with {c}" for c in _COUNTED}),
        "ranges": reports.quality_ranges(table),
        "examples": reports.quality_examples(table).select(*examples),
        "patterns": reports.pattern_counts(table).withColumnRenamed("Postcode", "Cases"),
        "outwards": reports.outward_counts(table).withColumnRenamed("Postcode", "Cases"),
        "outwards of areas": reports.outwards_per_area(table).withColumnRenamed("Outward", "Cases"),
    }
    return _stacked(parts)


@query(
    "w2_first_town",
    sql("named", 'SELECT "Postcode_area", min_by("Post Town", row_id) AS "Post Town" FROM named GROUP BY 1'),
)
def _(spark, sf):
    return reports.first_town(common.with_towns(spark, sf))


@query(
    "w4_row_numbers",
    sql("scanned", 'SELECT "Postcode_area", "Postcode", row_number() OVER (ORDER BY "Postcode_area", "Postcode") - 1 AS row_id FROM scanned'),
)
def _(spark, sf):
    return rows.number_rows(fixtures.postcodes(spark, sf).select("Postcode_area", "Postcode"), "Postcode_area", "Postcode")
