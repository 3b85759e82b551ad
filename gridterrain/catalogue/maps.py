"""Registered queries of scaling, colouring and drawing postcode maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridterrain import fixtures, scratch
from gridterrain.catalogue import common
from gridterrain.catalogue.oracle import floor_div, sql
from gridterrain.catalogue.registry import ORACLES, query
from gridterrain.catalogue.text import DESCRIPTION
from gridterrain.functions.colour import hex_colour, unpack
from gridterrain.operators import raster, spatial
from gridterrain.plans import maps
from gridterrain.sources.dims import area_palette

H = spatial.CANVAS_HEIGHT

# The softened palette, packed.
_SOFT = "[" + ", ".join(str(int(h, 16)) for h in (
    "ff7f7f", "7f7fff", "7fff7f", "ffff7f", "ffd27f", "cf8ff7", "d29494", "ffdfe5", "7ff6f6", "f67ff6", "f6c0f6", "dedede")) + "]"


def _canvas(box: str) -> str:
    """Box, width and metres per pixel."""
    return f"SELECT e0, n0, e1, n1, trunc({H} * (e1 - e0)::DOUBLE / (n1 - n0)::DOUBLE)::INT AS w, (n1 - n0)::DOUBLE / {H}.0::DOUBLE AS f FROM ({box})"


def _drawn(rows: str) -> str:
    """Rows on the canvas with their pixel position."""
    return f"""SELECT * EXCLUDE (e0, n0, e1, n1, f) FROM (SELECT s.*, c.*, {floor_div('"Eastings" - e0', 'f')}::INT AS es, {floor_div('"Northings" - n0', 'f')}::INT AS ns
      FROM ({rows}) s, canvas c WHERE "Eastings" > 0) WHERE ns BETWEEN 0 AND {H} AND es BETWEEN 0 AND w"""


def _coloured(key: str = '"Postcode_area"') -> str:
    """Drawn rows with the packed colour of their area."""
    return f"""SELECT d.*, coalesce(({_SOFT})[(rank % 12 + 1)::INT], 8421504) AS rgb FROM drawn d LEFT JOIN
      (SELECT area, row_number() OVER (ORDER BY min_e, area) - 1 AS rank FROM
        (SELECT {key} AS area, min("Eastings") AS min_e FROM drawn WHERE "Eastings" <> 0 AND {key} IS NOT NULL GROUP BY 1)) g ON g.area = d.{key}"""


_BLOCK = f"""SELECT x, y, max_by(rgb, row_id) AS rgb, max(row_id) AS row_id
  FROM (SELECT es + dx AS x, {H} - ns + dy AS y, rgb, row_id, w FROM coloured, range(3) AS a(dx), range(3) AS b(dy))
  WHERE x < w AND y < {H} GROUP BY 1, 2"""
_RGB = "x::INT AS x, y::INT AS y, (rgb >> 16)::INT AS r, ((rgb >> 8) & 255)::INT AS g, (rgb & 255)::INT AS b"


def _map_sql(box: str, rows: str, body: str, needs: str = "scanned", **more: str) -> str:
    return sql(needs, body, canvas=_canvas(box), drawn=_drawn(rows), coloured=_coloured(), image=_BLOCK, **more)


_ALL_BOX, _ALL_ROWS = "SELECT * FROM extent", "SELECT * FROM scanned"
_ALL = ("scanned extent",)


def _whole(spark, sf, **options):
    return maps.whole_map(fixtures.postcodes(spark, sf), **options)


def _by_area(spark, sf):
    """Extents of every area as box columns."""
    extents = spatial.area_extents(fixtures.postcodes(spark, sf), "Postcode_area")
    margin = (F.greatest(F.col("Max_E") - F.col("Min_E"), F.col("Max_N") - F.col("Min_N")).cast("bigint") * 0.1).cast("bigint")
    grown = extents.select(
        "area", (F.col("Min_E") - margin).alias("e0"), (F.col("Min_N") - margin).alias("n0"),
        (F.col("Max_E") + margin).alias("e1"), (F.col("Max_N") + margin).alias("n1"),
    )
    return grown, spatial.Canvas(spatial.Box(*[F.col(c) for c in ("e0", "n0", "e1", "n1")]))


_AREA_BOXES = """SELECT area, min_e - m AS e0, min_n - m AS n0, max_e + m AS e1, max_n + m AS n1
  FROM (SELECT *, trunc(greatest(max_e - min_e, max_n - min_n) * 0.1::DOUBLE)::BIGINT AS m
        FROM (SELECT "Postcode_area" AS area, min("Eastings")::BIGINT AS min_e, max("Eastings")::BIGINT AS max_e, min("Northings")::BIGINT AS min_n, max("Northings")::BIGINT AS max_n
              FROM scanned WHERE "Eastings" <> 0 GROUP BY 1))"""


@query(
    "p25_canvas",
    sql("scanned", f"SELECT area, trunc({H} * (e1 - e0)::DOUBLE / (n1 - n0)::DOUBLE)::INT AS width, (n1 - n0)::DOUBLE / {H}.0::DOUBLE AS metres_per_pixel FROM boxes", boxes=_AREA_BOXES),
)
def _(spark, sf):
    grown, canvas = _by_area(spark, sf)
    return grown.select("area", canvas.width.alias("width"), canvas.metres_per_pixel.alias("metres_per_pixel"))


@query(
    "p26_pixel_positions",
    sql("scanned extent", 'SELECT row_id, es AS e_scaled, ns AS n_scaled FROM drawn', canvas=_canvas(_ALL_BOX), drawn=_drawn(_ALL_ROWS)),
)
def _(spark, sf):
    whole = _whole(spark, sf)
    return whole.canvas.scaled(whole.rows).select("row_id", "e_scaled", "n_scaled")


@query(
    "p27_size_text",
    sql("scanned", "SELECT area, ((e1 - e0) // 1000)::VARCHAR || ' km x ' || ((n1 - n0) // 1000)::VARCHAR || ' km' AS size FROM boxes", boxes=_AREA_BOXES),
)
def _(spark, sf):
    grown, canvas = _by_area(spark, sf)
    return grown.select("area", canvas.size_text.alias("size"))


@query(
    "p28_titles",
    sql(
        "named",
        """SELECT area, 'Postcode area ' || area || ' [' || town || '] : ' || ((e1 - e0) // 1000)::VARCHAR || ' km x ' || ((n1 - n0) // 1000)::VARCHAR || ' km' AS title
           FROM boxes JOIN (SELECT "Postcode_area" AS a, min_by("Post Town", row_id) AS town FROM named GROUP BY 1) ON a = area""",
        boxes=_AREA_BOXES,
    ),
)
def _(spark, sf):
    from gridterrain.operators.reports import first_town

    grown, canvas = _by_area(spark, sf)
    towns = first_town(common.with_towns(spark, sf)).withColumnRenamed("Postcode_area", "area")
    return grown.join(towns, "area").select(
        "area", canvas.title(spatial.area_title(F.col("area"), F.col("`Post Town`"))).alias("title")
    )


@query(
    "f7_canvas_clip",
    sql("scanned", "SELECT row_id, es AS e_scaled, ns AS n_scaled FROM drawn", canvas=_canvas("SELECT 95000 AS e0, 295000 AS n0, 305000 AS e1, 505000 AS n1"), drawn=_drawn(_ALL_ROWS)),
)
def _(spark, sf):
    canvas = spatial.Canvas(spatial.Box.of(95_000, 295_000, 305_000, 505_000))
    return canvas.scaled(fixtures.postcodes(spark, sf)).select("row_id", "e_scaled", "n_scaled")


@query(
    "w1_colour_groups",
    sql(
        "parted",
        " UNION ALL ".join(
            f"""SELECT '{kind}' AS kind, area, ((row_number() OVER (ORDER BY min_e, area) - 1) % 12)::INT AS colour_group FROM
                (SELECT "{c}" AS area, min("Eastings") AS min_e FROM parted WHERE "Eastings" <> 0 AND "{c}" IS NOT NULL GROUP BY 1)"""
            for kind, c in spatial.AREA_COLUMNS.items()
        ),
    ),
)
def _(spark, sf):
    table, out = common.parted(spark, sf), None
    for kind in spatial.AREA_COLUMNS:
        part = raster.area_colours(table, kind).select(F.lit(kind).alias("kind"), "area", "colour_group")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p19_palette",
    sql(
        "scanned extent",
        """SELECT rgb >> 16 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b, cases FROM (SELECT rgb::INT AS rgb, count(*) AS cases FROM coloured GROUP BY 1)""",
        canvas=_canvas(_ALL_BOX), drawn=_drawn(_ALL_ROWS), coloured=_coloured(),
    ),
)
def _(spark, sf):
    whole = _whole(spark, sf)
    drawn = whole.canvas.scaled(whole.rows)
    used = drawn.groupBy("Postcode_area").agg(F.count("*").alias("n")).join(
        raster.area_colours(drawn), F.col("Postcode_area") == F.col("area")
    )
    per_group = used.groupBy("colour_group").agg(F.sum("n").alias("cases"))
    return area_palette(spark).join(per_group, "colour_group").select("r", "g", "b", "cases")


@query(
    "p18_hex",
    sql("scanned extent", "SELECT row_id, '#' || lpad(lower(to_hex(rgb)), 6, '0') AS hex FROM coloured", canvas=_canvas(_ALL_BOX), drawn=_drawn(_ALL_ROWS), coloured=_coloured()),
)
def _(spark, sf):
    points = _whole(spark, sf).points()
    return points.select("row_id", *unpack(F.col("rgb"))).select("row_id", hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query(
    "j5_row_colours",
    sql("parted extent", "SELECT row_id, rgb::INT AS rgb FROM coloured", canvas=_canvas(_ALL_BOX), drawn=_drawn("SELECT * FROM parted"), coloured=_coloured('"Ward Name"')),
)
def _(spark, sf):
    """Colours by ward: a kind with nulls (grey) and without a bound on its values."""
    table = common.named(spark, sf)
    return maps.whole_map(table, kind="wd").points().select("row_id", "rgb")


@query("r1_point_raster", _map_sql(_ALL_BOX, _ALL_ROWS, f"SELECT {_RGB} FROM image", "scanned extent"))
def _(spark, sf):
    return _whole(spark, sf).pixels()


@query("w3_last_writer", _map_sql(_ALL_BOX, _ALL_ROWS, "SELECT x::INT AS x, y::INT AS y, row_id FROM image", "scanned extent"))
def _(spark, sf):
    return _whole(spark, sf).raster().select("x", "y", "row_id")


_HITS = f"""SELECT x::INT AS x, ns::INT AS ns, max(row_id) AS row_id FROM (SELECT es + dx AS x, d.ns + dy AS ns, row_id, w FROM drawn d, range(-1, 2) AS a(dx), range(-1, 2) AS b(dy))
  WHERE x BETWEEN 0 AND w + 1 AND ns BETWEEN 0 AND {H + 1} GROUP BY 1, 2"""


@query("r3_hit_index", sql("scanned extent", "SELECT * FROM hits", canvas=_canvas(_ALL_BOX), drawn=_drawn(_ALL_ROWS), hits=_HITS))
def _(spark, sf):
    return _whole(spark, sf).hit_index()


@query(
    "j10_pixel_lookup",
    sql("scanned extent", 'SELECT x, h.ns, row_id, "Postcode" FROM hits h JOIN scanned USING (row_id)', canvas=_canvas(_ALL_BOX), drawn=_drawn(_ALL_ROWS), hits=_HITS),
)
def _(spark, sf):
    whole = _whole(spark, sf)
    return raster.hits(whole.hit_index(), whole.rows.select("row_id", "Postcode"))


@query(
    "q6_thinned_map",
    _map_sql(_ALL_BOX, "SELECT * FROM scanned WHERE row_id % 7 = 0", f"SELECT {_RGB} FROM image", "scanned extent"),
)
def _(spark, sf):
    return _whole(spark, sf, density=7).pixels()


def _boxed(rows: str) -> str:
    return f"""SELECT min_e - m AS e0, min_n - m AS n0, max_e + m AS e1, max_n + m AS n1
      FROM (SELECT *, trunc(greatest(max_e - min_e, max_n - min_n) * 0.1::DOUBLE)::BIGINT AS m
            FROM (SELECT min("Eastings")::BIGINT AS min_e, max("Eastings")::BIGINT AS max_e, min("Northings")::BIGINT AS min_n, max("Northings")::BIGINT AS max_n
                  FROM ({rows}) WHERE "Eastings" <> 0))"""


_TITLED = """{rgb}, (SELECT {title} || ' : ' || ((e1 - e0) // 1000)::VARCHAR || ' km x ' || ((n1 - n0) // 1000)::VARCHAR || ' km' FROM canvas) AS title"""


def _titled(a_map):
    """Pixels with the map's title on every row."""
    return a_map.pixels().withColumn("title", a_map.full_title)


@query("q6_whole_map", _map_sql(_ALL_BOX, _ALL_ROWS, "SELECT " + _TITLED.format(rgb=_RGB, title="'Great Britain'") + " FROM image", "scanned extent"))
def _(spark, sf):
    return _titled(_whole(spark, sf))


_NG = "SELECT * FROM scanned WHERE \"Postcode_area\" = 'NG'"


@query(
    "q7_area_map",
    _map_sql(_boxed(_NG), _NG, "SELECT " + _TITLED.format(rgb=_RGB, title="'Postcode area NG [' || (SELECT \"Post Town\" FROM areas WHERE \"Postcode Area\" = 'NG') || ']'") + " FROM image", "scanned areas"),
)
def _(spark, sf):
    return _titled(maps.area_map(common.with_towns(spark, sf), "ng"))


_TQ_BOX = "SELECT 495000 AS e0, 95000 AS n0, 605000 AS e1, 205000 AS n1"
_TQ = 'SELECT * FROM scanned WHERE "Eastings" BETWEEN 500000 AND 600000 AND "Northings" BETWEEN 100000 AND 200000'


@query(
    "q8_square_map",
    _map_sql(_TQ_BOX, _TQ, "SELECT " + _TITLED.format(rgb=_RGB, title="'National Grid square TQ [London, Surrey and Sussex]'") + " FROM image"),
)
def _(spark, sf):
    return _titled(maps.square_map(fixtures.postcodes(spark, sf), common.squares(spark), "tq"))


_PC_BOX = 'SELECT "Eastings" - 5000 AS e0, "Northings" - 5000 AS n0, "Eastings" + 5000 AS e1, "Northings" + 5000 AS n1 FROM scanned WHERE "Postcode" = \'NG3 1AA\''
_PC = f'SELECT s.* FROM scanned s, ({_PC_BOX}) b WHERE "Eastings" BETWEEN e0 AND e1 AND "Northings" BETWEEN n0 AND n1'
_MIX = " + ".join(
    f"(round_even((((coalesce(i.rgb, 16777215) >> {s}) & 255) + ((d.rgb >> {s}) & 255)) / 2.0::DOUBLE, 0)::BIGINT << {s})" for s in (16, 8, 0)
)
_LIT = f"""SELECT coalesce(i.x, d.x) AS x, coalesce(i.y, d.y) AS y, CASE WHEN d.rgb IS NULL THEN i.rgb ELSE {_MIX} END AS rgb FROM image i FULL JOIN
  (SELECT es + dx AS x, {H} - ns + dy AS y, rgb FROM coloured, range(-30, 31) AS a(dx), range(-30, 31) AS b(dy)
   WHERE "Postcode" = 'NG3 1AA' AND dx * dx + dy * dy <= 900 AND es + dx >= 0 AND es + dx < w AND {H} - ns + dy BETWEEN 0 AND {H - 1}) d ON i.x = d.x AND i.y = d.y"""


@query("r2_highlight", _map_sql(_PC_BOX, _PC, f"SELECT {_RGB} FROM lit", lit=_LIT))
def _(spark, sf):
    table = fixtures.postcodes(spark, sf)
    box = spatial.Box.from_row(spatial.neighbourhood(spatial.find_postcode(table, "NG3 1AA")))
    around = maps.PostcodeMap(spatial.within(table, box), box, F.lit(""), F.lit(""), key=F.lit("NG3 1AA"))
    return around.pixels()


@query(
    "q9_postcode_map",
    _map_sql(
        _PC_BOX, _PC,
        "SELECT " + _TITLED.format(rgb=_RGB, title=f"'Around postcode NG3 1AA [' || (SELECT {DESCRIPTION} FROM named WHERE \"Postcode\" = 'NG3 1AA') || ']'") + " FROM lit",
        "named", lit=_LIT,
    ),
)
def _(spark, sf):
    return _titled(maps.postcode_map(common.named(spark, sf), " ng31aa"))


# One place of each kind, and ones that are not known.
_DRAWN = [("all", "GB", "q6_whole_map"), ("pa", "ng", "q7_area_map"), ("ng", "tq", "q8_square_map"), ("pc", " ng31aa", "q9_postcode_map")]
_NOT_DRAWN = [("pa", "zz", 2), ("ng", "qq", 2), ("ng", "ha", 2), ("pc", "zz99zz", 2), ("xx", "ng", 1)]


@query(
    "q10_draw_places",
    " UNION ALL BY NAME ".join(
        [f"SELECT '{t}' AS place_type, '{v}' AS place_value, 0 AS status, * FROM ({ORACLES[q]})" for t, v, q in _DRAWN]
        + [f"SELECT '{t}' AS place_type, '{v}' AS place_value, {s} AS status" for t, v, s in _NOT_DRAWN]
    ),
)
def _(spark, sf):
    """The pixels of each place that is drawn; one row with the outcome for each other place."""
    table, squares = scratch.cut(common.named(spark, sf), "named"), common.squares(spark)
    out = None
    for place_type, value in [p[:2] for p in _DRAWN + _NOT_DRAWN]:
        status, a_map = maps.draw_place(table, squares, place_type, value)
        pixels = _titled(a_map) if a_map else spark.range(1).drop("id")
        part = pixels.select(F.lit(place_type).alias("place_type"), F.lit(value).alias("place_value"), F.lit(status).alias("status"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
