"""Registered queries of squares, place strings and map requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridterrain import fixtures
from gridterrain.catalogue import common
from gridterrain.catalogue.oracle import mix, sql, wide
from gridterrain.catalogue.registry import query
from gridterrain.operators import place, reports
from gridterrain.scratch import cut
from gridterrain.sources.dims import grid_layout, real_squares

# Square-like strings: all pairs of letters in both cases, with digits after most of them.
_NAME = (
    "concat(if(o_orderkey % 3 = 0, chr(97 + o_orderkey % 26), chr(65 + o_orderkey % 26)), chr(65 + (o_orderkey div 26) % 26),"
    " case o_orderkey % 5 when 0 then '' when 1 then concat(o_orderkey % 10) when 4 then concat(o_orderkey % 1000)"
    " else concat((o_orderkey div 7) % 10, (o_orderkey div 3) % 10) end)"
)
_NAME_SQL = """CASE WHEN k % 3 = 0 THEN chr((97 + k % 26)::INT) ELSE chr((65 + k % 26)::INT) END || chr((65 + (k // 26) % 26)::INT)
  || CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN (k % 10)::VARCHAR WHEN 4 THEN (k % 1000)::VARCHAR
     ELSE ((k // 7) % 10)::VARCHAR || ((k // 3) % 10)::VARCHAR END"""
_NAMES = f"SELECT k, {_NAME_SQL} AS name FROM (SELECT o_orderkey AS k FROM orders)"


def _names(spark, sf):
    return fixtures.table(spark, sf, "orders").selectExpr("o_orderkey as k", f"{_NAME} as name")


@query(
    "p11_square_name",
    sql("grid", "SELECT k, n.name, g.name IS NOT NULL AS known FROM names n LEFT JOIN grid g ON g.name = upper(n.name)", names=_NAMES),
)
def _(spark, sf):
    return _names(spark, sf).select("k", "name", place.is_square(F.col("name")).alias("known"))


@query(
    "p12_small_square",
    sql(
        "grid",
        """SELECT k, g.name AS gridsquare, CASE WHEN g.name IS NOT NULL THEN substr(n.name, 3, 1)::INT END AS east,
             CASE WHEN g.name IS NOT NULL THEN substr(n.name, 4, 1)::INT END AS north
           FROM names n LEFT JOIN grid g ON regexp_full_match(n.name, '[A-Za-z]{2}[0-9]{2}') AND g.name = upper(left(n.name, 2))""",
        names=_NAMES,
    ),
)
def _(spark, sf):
    square, east, north = place.parse_small_square(F.col("name"))
    return _names(spark, sf).select("k", square.alias("gridsquare"), east.alias("east"), north.alias("north"))


@query(
    "p13_next_squares",
    sql(
        "grid",
        """SELECT k, coalesce(n.name, '') AS to_north, coalesce(e.name, '') AS to_east
           FROM names s LEFT JOIN grid g ON g.name = upper(s.name)
             LEFT JOIN grid n ON n.easting_index = g.easting_index AND n.northing_index = g.northing_index + 1
             LEFT JOIN grid e ON e.easting_index = g.easting_index + 1 AND e.northing_index = g.northing_index""",
        names=_NAMES,
    ),
)
def _(spark, sf):
    name = F.col("name")
    return _names(spark, sf).select(
        "k", place.next_square(name, 0, 1).alias("to_north"), place.next_square(name, 1, 0).alias("to_east")
    )


_REACH = """SELECT o_orderkey AS k, substr('STNOHJ', (o_orderkey % 6 + 1)::INT, 1) || substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', ((o_orderkey // 6) % 25 + 1)::INT, 1) AS sq,
  (o_orderkey // 150) % 10 AS e, (o_orderkey // 11) % 10 AS n, o_custkey % 61 - 20 AS de, o_custkey % 47 - 9 AS dn FROM orders"""


@query(
    "p14_square_reached",
    sql(
        "grid",
        """SELECT k, g2.name || (ae % 10)::VARCHAR || (an % 10)::VARCHAR AS reached
           FROM (SELECT k, g.easting_index * 10 + e + de AS ae, g.northing_index * 10 + n + dn AS an FROM reach JOIN grid g ON g.name = sq)
             LEFT JOIN grid g2 ON ae >= 0 AND an >= 0 AND g2.easting_index = ae // 10 AND g2.northing_index = an // 10""",
        reach=_REACH,
    ),
)
def _(spark, sf):
    steps = fixtures.table(spark, sf, "orders").selectExpr(
        "o_orderkey as k",
        "concat(substr('STNOHJ', int(o_orderkey % 6 + 1), 1), substr('ABCDEFGHJKLMNOPQRSTUVWXYZ', int((o_orderkey div 6) % 25 + 1), 1)) as sq",
        "(o_orderkey div 150) % 10 as e", "(o_orderkey div 11) % 10 as n", "o_custkey % 61 - 20 as de", "o_custkey % 47 - 9 as dn",
    )
    reached = place.square_reached(*[F.col(c) for c in ("sq", "e", "n", "de", "dn")])
    return steps.select("k", reached.alias("reached"))


# Dimension strings, some malformed or too large, and the size of square they count.
_DIMS = (
    "case k % 9 when 0 then '' when 1 then concat(k % 7, 'x') when 2 then concat('0x', k % 5) when 3 then concat(k % 5, 'X0')"
    " when 4 then concat(k % 260, 'x', k % 30) when 5 then concat('00', k % 9, 'x', k % 99) when 6 then concat(k, 'x99999999999999')"
    " else concat(k % 4 + 1, 'X', k % 3 + 1) end"
)
_DIMS_SQL = """CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN concat(k % 7, 'x') WHEN 2 THEN concat('0x', k % 5) WHEN 3 THEN concat(k % 5, 'X0')
  WHEN 4 THEN concat(k % 260, 'x', k % 30) WHEN 5 THEN concat('00', k % 9, 'x', k % 99) WHEN 6 THEN concat(k, 'x99999999999999')
  ELSE concat(k % 4 + 1, 'X', k % 3 + 1) END"""


def _sized(dims: str, km: str) -> str:
    """SQL of the two parsed sides."""
    m = f"regexp_full_match({dims}, '[0-9]+[xX][0-9]+')"
    side = [f"TRY_CAST(regexp_extract({dims}, '^([0-9]+)[xX]([0-9]+)$', {i}) AS DECIMAL(38, 0))" for i in (1, 2)]
    good = f"{m} AND {side[0]} * {km} <= 2000 AND {side[1]} * {km} <= 2000"
    return ", ".join(f"CASE WHEN {good} THEN {s}::BIGINT ELSE 0 END AS {n}" for s, n in zip(side, ("w", "h")))


@query(
    "p15_dimensions",
    sql("", f"SELECT k, {_sized('dims', 'km')} FROM sized",
        sized=f"SELECT k, {_DIMS_SQL} AS dims, CASE WHEN k % 2 = 0 THEN 10 ELSE 100 END AS km FROM (SELECT o_orderkey AS k FROM orders)"),
)
def _(spark, sf):
    sized = fixtures.table(spark, sf, "orders").selectExpr("o_orderkey as k").selectExpr(
        "k", f"{_DIMS} as dims", "if(k % 2 = 0, 10, 100) as km"
    )
    w, h = place.parse_dimensions(F.col("dims"), F.col("km"))
    return sized.select("k", w.alias("w"), h.alias("h"))


@query(
    "p16_map_requests",
    sql(
        "grid",
        f"""SELECT request_id, gridsquare, east, north, w * times AS ew, h * times AS ns, gridsquare IS NOT NULL AND w > 0 AS valid
            FROM (SELECT *, {_sized("CASE WHEN dims = '' THEN '1x1' ELSE dims END", "km")}
                  FROM (SELECT k AS request_id, dims, coalesce(b.name, s.name) AS gridsquare,
                          CASE WHEN b.name IS NOT NULL THEN 0 WHEN s.name IS NOT NULL THEN substr(n.name, 3, 1)::INT END AS east,
                          CASE WHEN b.name IS NOT NULL THEN 0 WHEN s.name IS NOT NULL THEN substr(n.name, 4, 1)::INT END AS north,
                          CASE WHEN b.name IS NOT NULL THEN 10 ELSE 1 END::BIGINT AS times, CASE WHEN b.name IS NOT NULL THEN 100 ELSE 10 END AS km
                        FROM names n LEFT JOIN grid b ON b.name = upper(n.name)
                          LEFT JOIN grid s ON regexp_full_match(n.name, '[A-Za-z]{{2}}[0-9]{{2}}') AND s.name = upper(left(n.name, 2))))""",
        names=f"SELECT k, {_NAME_SQL} AS name, {_DIMS_SQL} AS dims FROM (SELECT o_orderkey AS k FROM orders)",
    ),
)
def _(spark, sf):
    asked = _names(spark, sf).selectExpr("k", "name", f"{_DIMS} as dims").withColumnRenamed("k", "request_id")
    return place.map_requests(asked).drop("name", "dims")


# Place strings of every form, wanted by customers.
_PLACE = (
    "case k % 14 when 0 then ' pa:ng' when 1 then 'PC: ng1 0aa ' when 2 then 'ng:tq' when 3 then 'ALL' when 4 then 'random' when 5 then 'E'"
    " when 6 then 'NE' when 7 then 'NZ' when 8 then 'TQ' when 9 then 'abc' when 10 then 'pa:x:y' when 11 then 'zz:1'"
    " when 12 then concat(pc, ' ') else concat('pc:', element_at(array('random', 'xx9 9xx'), int(k % 2 + 1))) end"
)
_PLACE_SQL = """CASE k % 14 WHEN 0 THEN ' pa:ng' WHEN 1 THEN 'PC: ng1 0aa ' WHEN 2 THEN 'ng:tq' WHEN 3 THEN 'ALL' WHEN 4 THEN 'random' WHEN 5 THEN 'E'
  WHEN 6 THEN 'NE' WHEN 7 THEN 'NZ' WHEN 8 THEN 'TQ' WHEN 9 THEN 'abc' WHEN 10 THEN 'pa:x:y' WHEN 11 THEN 'zz:1'
  WHEN 12 THEN pc || ' ' ELSE 'pc:' || (['random', 'xx9 9xx'])[(k % 2 + 1)::INT] END"""


def _places(spark, sf):
    """One place string per customer; some name the postcode of the order with the customer's number."""
    codes = fixtures.postcodes(spark, sf).selectExpr("row_id as k", "Postcode as pc")
    asked = fixtures.table(spark, sf, "customer").selectExpr("c_custkey as k").join(codes, "k", "left")
    return asked.selectExpr("k as request_id", f"{_PLACE} as place")


_PLACES = f"SELECT k AS request_id, {_PLACE_SQL} AS place FROM (SELECT c_custkey AS k, s.\"Postcode\" AS pc FROM customer LEFT JOIN scanned s ON s.row_id = c_custkey)"

_CLASSIFIED = """SELECT request_id, CASE WHEN strpos(t, ':') > 0 THEN CASE WHEN len(p) = 2 AND kind IN ('pa', 'pc', 'ng') THEN kind ELSE '' END
    WHEN lower(t) = 'all' THEN 'all' WHEN lower(t) = 'random' THEN 'random' WHEN length(t) = 1 THEN 'pa'
    WHEN length(t) = 2 AND is_ng AND NOT is_pa THEN 'ng' WHEN length(t) = 2 AND is_pa AND NOT is_ng THEN 'pa'
    WHEN length(t) >= 5 THEN 'pc' ELSE '' END AS place_type,
  CASE WHEN strpos(t, ':') > 0 THEN CASE WHEN len(p) = 2 AND kind IN ('pa', 'pc', 'ng') THEN trim(p[2]) ELSE '' END
    WHEN lower(t) = 'all' THEN 'GB' WHEN lower(t) = 'random' THEN 'random' WHEN length(t) = 1 THEN t
    WHEN length(t) = 2 AND is_ng <> is_pa THEN t WHEN length(t) >= 5 THEN t ELSE '' END AS place_value
  FROM (SELECT request_id, trim(place) AS t, string_split(trim(place), ':') AS p, lower(trim(string_split(trim(place), ':')[1])) AS kind,
          upper(trim(place)) IN (SELECT "Postcode_area" FROM scanned) AS is_pa,
          upper(trim(place)) IN (SELECT name FROM grid WHERE is_real) AS is_ng FROM places)"""


def _areas(table):
    return reports.distinct_areas(table)


def _classified(spark, sf, table):
    """Classified place strings, written once: the later steps branch on their type."""
    classified = place.classify_places(_places(spark, sf), _areas(table))
    return cut(classified.select("request_id", "place_type", "place_value"), "places")


@query("p10_classify_places", sql("scanned grid", "SELECT * FROM classified", places=_PLACES, classified=_CLASSIFIED))
def _(spark, sf):
    classified = place.classify_places(_places(spark, sf), _areas(fixtures.postcodes(spark, sf)))
    return classified.select("request_id", "place_type", "place_value")


def _norm(value: str) -> str:
    t = f"replace(trim(upper({value})), ' ', '')"
    return f"CASE WHEN length({t}) IN (5, 6) THEN left({t}, length({t}) - 3) || repeat(' ', 7 - length({t})) || right({t}, 3) ELSE {t} END"


_EXISTS = f"""CASE place_type WHEN 'pa' THEN upper(trim(place_value)) IN (SELECT "Postcode_area" FROM scanned)
  WHEN 'pc' THEN {_norm('place_value')} IN (SELECT "Postcode" FROM scanned)
  WHEN 'ng' THEN upper(place_value) IN (SELECT name FROM grid WHERE is_real) ELSE place_type = 'all' END"""


@query(
    "f8_place_exists",
    sql("scanned grid", f'SELECT request_id, place_type, place_value, {_EXISTS} AS "exists" FROM classified', places=_PLACES, classified=_CLASSIFIED),
)
def _(spark, sf):
    table = fixtures.postcodes(spark, sf)
    return place.place_exists(_classified(spark, sf, table), table, _areas(table))


@query(
    "f9_land_squares",
    sql(
        "scanned grid",
        """SELECT g.name, count(s.row_id) AS cases FROM grid g LEFT JOIN scanned s
             ON s."Eastings" BETWEEN g.easting_index * 100000 AND (g.easting_index + 1) * 100000
            AND s."Northings" BETWEEN g.northing_index * 100000 AND (g.northing_index + 1) * 100000
           WHERE g.is_real GROUP BY 1""",
    ),
)
def _(spark, sf):
    from gridterrain.operators.spatial import squares_of

    counts = squares_of(fixtures.postcodes(spark, sf)).groupBy(F.col("square").alias("name")).agg(F.count("*").alias("cases"))
    return real_squares(spark).join(counts, "name", "left").select("name", F.coalesce("cases", F.lit(0)).cast("bigint").alias("cases"))


SEED = 17


@query(
    "l4_random_postcodes",
    sql("scanned", f'SELECT row_id, "Postcode", "Postcode_area" FROM scanned ORDER BY {mix("row_id", SEED)}, row_id LIMIT 10'),
)
def _(spark, sf):
    from gridterrain.operators.rows import random_rows

    return random_rows(fixtures.postcodes(spark, sf).select("row_id", "Postcode", "Postcode_area"), 10, SEED)


_TYPED = f"""SELECT request_id, CASE WHEN place_type = 'random' THEN (['pa', 'pc', 'ng'])[({mix('request_id', SEED)} % 3 + 1)::INT] ELSE place_type END AS place_type,
  place_value FROM classified"""
_CONCRETE = f"""SELECT request_id, place_type, CASE WHEN lower(place_value) <> 'random' THEN place_value WHEN place_type = 'pa' THEN s."Postcode_area"
    WHEN place_type = 'pc' THEN s."Postcode" WHEN place_type = 'ng' THEN
      (SELECT list(name ORDER BY name) FROM grid WHERE is_real)[({mix('request_id', SEED + 2)} % 55 + 1)::INT] ELSE place_value END AS place_value
  FROM typed t LEFT JOIN scanned s ON s.row_id = {wide('request_id', SEED + 1)} % (SELECT count(*) FROM scanned)"""


@query(
    "l5_random_places",
    sql("scanned grid", "SELECT * FROM concrete", places=_PLACES, classified=_CLASSIFIED, typed=_TYPED, concrete=_CONCRETE),
)
def _(spark, sf):
    table = fixtures.postcodes(spark, sf)
    return place.resolve_random(_classified(spark, sf, table), table, real_squares(spark), SEED)


@query(
    "q10_answer_places",
    sql(
        "scanned grid",
        f"""SELECT request_id, place_type, place_value, status, CASE WHEN status <> 0 THEN 0
              WHEN place_type = 'pa' THEN coalesce((SELECT n FROM by_area WHERE a = upper(trim(place_value))), 0)
              WHEN place_type = 'ng' THEN coalesce((SELECT n FROM by_square WHERE a = upper(place_value)), 0)
              WHEN place_type = 'pc' THEN coalesce((SELECT n FROM by_code WHERE a = {_norm('place_value')}), 0)
              ELSE (SELECT count(*) FROM scanned) END::BIGINT AS "rows"
            FROM (SELECT *, CASE WHEN place_type = '' THEN 1 WHEN {_EXISTS} THEN 0 ELSE 2 END::INT AS status FROM concrete)""",
        places=_PLACES, classified=_CLASSIFIED, typed=_TYPED, concrete=_CONCRETE,
        by_area='SELECT "Postcode_area" AS a, count(*) AS n FROM scanned GROUP BY 1',
        by_square="""SELECT g.name AS a, count(*) AS n FROM grid g JOIN scanned s
             ON s."Eastings" BETWEEN g.easting_index * 100000 AND (g.easting_index + 1) * 100000
            AND s."Northings" BETWEEN g.northing_index * 100000 AND (g.northing_index + 1) * 100000 GROUP BY 1""",
        by_code=f"""SELECT c."Postcode" AS a, count(*) AS n FROM scanned c JOIN scanned s
             ON abs(s."Eastings" - c."Eastings") <= 5000 AND abs(s."Northings" - c."Northings") <= 5000
             WHERE c."Postcode" IN (SELECT {_norm('place_value')} FROM concrete WHERE place_type = 'pc') GROUP BY 1""",
    ),
)
def _(spark, sf):
    from gridterrain.plans.maps import answer_places

    return answer_places(fixtures.postcodes(spark, sf), common.squares(spark), _places(spark, sf), SEED)


@query(
    "r9_grid_layout",
    sql(
        "scanned grid",
        """SELECT g.name, CASE WHEN is_real THEN '#99ff66' ELSE '#99ccff' END AS fill, easting_index * 100 + 50 AS label_x, northing_index * 100 + 45 AS label_y,
             CASE WHEN is_real THEN 'black' ELSE 'gray' END AS label_colour, count(s.row_id) AS cases
           FROM grid g LEFT JOIN scanned s ON s."Eastings" BETWEEN g.easting_index * 100000 AND (g.easting_index + 1) * 100000
            AND s."Northings" BETWEEN g.northing_index * 100000 AND (g.northing_index + 1) * 100000 GROUP BY ALL""",
    ),
)
def _(spark, sf):
    from gridterrain.operators.spatial import squares_of

    counts = squares_of(fixtures.postcodes(spark, sf)).groupBy(F.col("square").alias("name")).agg(F.count("*").alias("cases"))
    return grid_layout(common.squares(spark)).join(counts, "name", "left").fillna(0, ["cases"])
