"""Registered queries of altitudes, colours, tiles, mosaics and flat regions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from gridterrain import fixtures
from gridterrain.catalogue import common
from gridterrain.catalogue.oracle import floor_div, ramp, sql
from gridterrain.catalogue.registry import query
from gridterrain.functions.colour import LAND_RAMPS, NUMERIC, SCHEMES, WATER, land_colour, ramp_factors, water_colour
from gridterrain.functions.numeric import same_altitude
from gridterrain.operators import altitudes, flat, terrain
from gridterrain.plans import terrain_map
from gridterrain.sources import dims


def _rgb(channels: list[str]) -> str:
    return ", ".join(f"{c} AS {n}" for c, n in zip(channels, "rgb"))


def _register_ramp(scheme: str) -> None:
    @query(f"p20_land_ramp_{scheme}", sql("heights", f"SELECT k, {_rgb(ramp(LAND_RAMPS[scheme], 'alt'))} FROM heights"))
    def _(spark, sf):
        return common.heights(spark, sf).select("k", *land_colour(scheme, F.col("alt")))


for _scheme in LAND_RAMPS:
    _register_ramp(_scheme)

_EFF = """CASE WHEN alt >= 0 THEN alt * (1349.9::DOUBLE / (SELECT max(alt) FROM heights)) ELSE alt * (9.9::DOUBLE / (SELECT abs(min(alt)) FROM heights)) END"""


@query(
    "p21_scaled_ramp",
    sql("heights", f"SELECT k, {_rgb(ramp(LAND_RAMPS['standard'], 'eff'))} FROM (SELECT k, {_EFF} AS eff FROM heights)"),
)
def _(spark, sf):
    cells = common.heights(spark, sf)
    lowest, highest = cells.agg(F.min("alt"), F.max("alt")).first()
    factors = ramp_factors("standard", F.lit(lowest), F.lit(highest))
    return cells.select("k", *land_colour("standard", F.col("alt"), factors))


_A = "abs(alt)"
_NUMERIC = [
    f"trunc(CASE WHEN alt >= 0 THEN {floor_div(_A, '100.0')} WHEN {_A} > 999 THEN 255 WHEN {_A} < 2.55::DOUBLE THEN {_A} * 100 WHEN {_A} < 10 THEN {_A} * 25 WHEN {_A} < 25.5::DOUBLE THEN {_A} * 10 ELSE {_A} END)::INT",
    f"trunc(CASE WHEN alt >= 0 THEN {_A} % 100 WHEN {_A} > 999 THEN 255 ELSE {_A} END)::INT",
    "CASE WHEN alt >= 0 THEN 0 ELSE 255 END::INT",
]


@query(
    "p22_numeric_colour",
    sql("heights cells", f"SELECT k, {_rgb(_NUMERIC)} FROM (SELECT k, alt FROM heights UNION ALL SELECT -1 - (\"row\" * 100 + col), alt - 30 FROM cells)"),
)
def _(spark, sf):
    cells = fixtures.terrain_cells(spark, sf).selectExpr("-1 - (row * 100 + col) as k", "alt - 30 as alt")
    return common.heights(spark, sf).unionByName(cells).select("k", *land_colour("numeric", F.col("alt")))


_WATER_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS scheme, k, {_rgb([f'{v}::INT' for v in WATER[s]])} FROM heights" for s in WATER
) + f" UNION ALL SELECT 'numeric', k, {_rgb(_NUMERIC)} FROM heights"


@query("p23_water_colour", sql("heights", _WATER_SQL))
def _(spark, sf):
    rows = common.heights(spark, sf)
    out = None
    for scheme in SCHEMES:
        part = rows.select(F.lit(scheme).alias("scheme"), "k", *water_colour(scheme, F.col("alt")))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p24_same_altitude",
    sql("heights", "SELECT k, abs(alt - (alt + ((k % 5)::DOUBLE - 2.0) * 0.006::DOUBLE)) < 0.01::DOUBLE AS same FROM heights"),
)
def _(spark, sf):
    other = F.expr("alt + (double(k % 5) - 2.0D) * 0.006D")
    return common.heights(spark, sf).select("k", same_altitude(F.col("alt"), other).alias("same"))


_SCHEMES = [*LAND_RAMPS, NUMERIC, "plaid"]
_ASKED = "([" + ", ".join(f"'{s}'" for s in _SCHEMES) + f"])[(k % {len(_SCHEMES)} + 1)::INT]"
_USED = "CASE WHEN asked = 'plaid' THEN 'standard' ELSE asked END"


def _by_scheme(channel: int, water: bool) -> str:
    cases = [f"WHEN '{s}' THEN {WATER[s][channel] if water else ramp(LAND_RAMPS[s], 'alt')[channel]}" for s in LAND_RAMPS]
    return f"(CASE {_USED} {' '.join(cases)} ELSE {_NUMERIC[channel]} END)::INT"


@query(
    "s16_colour_schemes",
    sql(
        "heights",
        f"SELECT k, asked, {_USED} AS scheme, " + ", ".join(f"{_by_scheme(i, False)} AS {n}, {_by_scheme(i, True)} AS water_{n}" for i, n in enumerate("rgb"))
        + f" FROM (SELECT k, alt, {_ASKED} AS asked FROM heights)",
    ),
)
def _(spark, sf):
    """Scheme as a column: unknown names fall back, then each row meets its ramp segment and its water."""
    names = F.array(*[F.lit(s) for s in _SCHEMES])
    asked = common.heights(spark, sf).withColumn("asked", F.get(names, (F.col("k") % len(_SCHEMES)).cast("int")))
    return altitudes.scheme_colours(asked, "asked", "alt").drop("alt")


# Altitude statistics.


@query("l2_altitude_counts", sql("counted", "SELECT alt, cases FROM counted ORDER BY alt"))
def _(spark, sf):
    return altitudes.altitude_counts(fixtures.terrain_cells(spark, sf)).orderBy("alt")


_SUMMARY = """SELECT sum(cases)::BIGINT AS cells, count(*) AS unique_altitudes, min(alt) AS min_alt, max(alt) AS max_alt, round_even(max(alt) - min(alt), 1) AS alt_range,
  round_even(sum(alt * cases) / sum(cases)::DOUBLE, 1) AS mean_alt, sum(alt * cases) / sum(cases)::DOUBLE AS mean_exact FROM counted"""


@query("a16_altitude_summary", sql("counted", _SUMMARY))
def _(spark, sf):
    return altitudes.altitude_summary(altitudes.altitude_counts(fixtures.terrain_cells(spark, sf)))


_COMMON = "SELECT alt, cases, round_even(cases / (SELECT sum(cases) FROM counted)::DOUBLE * 100, 3) AS percent FROM counted ORDER BY cases DESC, alt LIMIT 1"


@query("a17_commonest_altitude", sql("counted", _COMMON))
def _(spark, sf):
    return altitudes.commonest_altitude(altitudes.altitude_counts(fixtures.terrain_cells(spark, sf)))


_NOTABLE = """SELECT alt, cases, round_even(cases * 100 / (SELECT sum(cases) FROM counted)::DOUBLE, 2) AS percent FROM counted
  WHERE alt < 1 OR cases >= (SELECT sum(cases) FROM counted) / 100::DOUBLE"""


@query("a18_notable_altitudes", sql("counted", _NOTABLE))
def _(spark, sf):
    return altitudes.notable_altitudes(altitudes.altitude_counts(fixtures.terrain_cells(spark, sf)))


_EDGES = """SELECT row_number() OVER (ORDER BY o) - 1 AS i, edge FROM (
    SELECT -1 AS o, lo AS edge FROM bounds WHERE lo <= 0
    UNION ALL SELECT s AS o, (s * width)::DOUBLE FROM bounds, range(0, 2000) AS r(s) WHERE s * width - hi <= 2 * width)"""
_BOUNDS = """SELECT min(alt) AS lo, max(alt) AS hi, CASE WHEN max(alt) < 100 THEN 10 WHEN max(alt) < 200 THEN 20 WHEN max(alt) < 300 THEN 50 ELSE 100 END AS width FROM {src}"""
_BINS = """SELECT a.i::INT AS bin, a.edge AS lower, b.edge AS upper, coalesce(sum(c.cases), 0)::BIGINT AS cases FROM edges a JOIN edges b ON b.i = a.i + 1
  LEFT JOIN {src} c ON c.alt >= a.edge AND c.alt < b.edge GROUP BY 1, 2, 3"""


def _histogram_sql(needs: str, src: str, body: str = "SELECT * FROM bins", **more: str) -> str:
    return sql(needs, body, **more, bounds=_BOUNDS.format(src=src), edges=_EDGES, bins=_BINS.format(src=src))


@query("a19_histogram", _histogram_sql("counted", "counted"))
def _(spark, sf):
    return altitudes.histogram(altitudes.altitude_counts(fixtures.terrain_cells(spark, sf)))


@query("a19_histogram_heights", _histogram_sql("heights", "tall", tall="SELECT alt, count(*) AS cases FROM heights GROUP BY 1"))
def _(spark, sf):
    return altitudes.histogram(altitudes.altitude_counts(common.heights(spark, sf)))


_HEX = "'#' || " + " || ".join("lpad(lower(to_hex({})), 2, '0')".format(c) for c in ("r", "g", "b"))
_BARS = (
    f"SELECT bin, lower, upper, cases, CASE WHEN lower >= 0 THEN {_HEX} ELSE '#cce5ff' END AS hex FROM "
    f"(SELECT *, {_rgb(ramp(LAND_RAMPS['standard'], 'lower'))} FROM bins)"
)


@query("r10_histogram_colours", _histogram_sql("heights", "tall", _BARS, tall="SELECT alt, count(*) AS cases FROM heights GROUP BY 1"))
def _(spark, sf):
    counts = altitudes.altitude_counts(common.heights(spark, sf))
    return altitudes.histogram_colours(altitudes.histogram(counts), "standard")


# Tiles. The mosaic lacks every fifth tile, has one doubled file in seven and one spoilt text in eleven.

_TILES = """SELECT north, east, (north * 2 + east) AS number, n FROM (SELECT "row" // 50 AS north, col // 50 AS east, count(*) AS n FROM cells GROUP BY 1, 2)"""
_STATUS = """SELECT *, CASE WHEN number % 5 = 4 THEN 'sea' WHEN number % 7 = 3 THEN 'error' WHEN number % 11 = 5 THEN 'error'
    WHEN n <> first_n THEN 'error' ELSE 'ok' END AS status
  FROM (SELECT *, (SELECT n FROM tiles WHERE NOT (number % 5 = 4 OR number % 7 = 3 OR number % 11 = 5) ORDER BY east, north LIMIT 1) AS first_n FROM tiles)"""


def _tile_inputs(spark, sf):
    """Wanted tiles and parsed headers of the spoilt mosaic."""
    number = F.col("north") * 2 + F.col("east")
    texts = fixtures.tile_texts(spark, sf)
    wanted = texts.select(F.lit(0).alias("request_id"), F.col("east").cast("bigint").alias("east"), F.col("north").cast("bigint").alias("north"), "tile")
    held = texts.filter(number % 5 != 4).select(
        "tile", F.when(number % 7 == 3, 2).otherwise(1).cast("bigint").alias("files"),
        F.when(number % 11 == 5, F.replace("text", F.lit("cellsize"), F.lit("cell size"))).otherwise(F.col("text")).alias("text"),
    )
    from gridterrain.scratch import cut
    from gridterrain.sources.tiles import tile_headers

    return wanted, tile_headers(cut(held, "tiles"))


@query("j6_tile_statuses", sql("cells", "SELECT east, north, status FROM statuses", tiles=_TILES, statuses=_STATUS))
def _(spark, sf):
    wanted, headers = _tile_inputs(spark, sf)
    return terrain.tile_statuses(wanted, headers).select("east", "north", "status")


_MOSAIC = """SELECT c."row", c.col, CASE WHEN s.status = 'ok' THEN c.alt ELSE -1000 END AS alt, s.status = 'ok' AS real FROM cells c
  JOIN statuses s ON s.north = c."row" // 50 AND s.east = c.col // 50
  UNION ALL SELECT north * 50 + r, east * 50 + k, -1000, false FROM statuses, range(50) AS a(r), range(50) AS b(k)
  WHERE status <> 'ok' AND north * 50 + r > (SELECT max("row") FROM cells) AND r < first_n // 50"""


@query("r4_mosaic", sql("cells", 'SELECT "row", col, alt, real FROM mosaic', tiles=_TILES, statuses=_STATUS, mosaic=_MOSAIC))
def _(spark, sf):
    wanted, headers = _tile_inputs(spark, sf)
    return terrain.mosaic(terrain.tile_statuses(wanted, headers), headers).drop("request_id")


@query(
    "a20_request_status",
    sql(
        "cells",
        """SELECT 0 AS request_id, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'sea') AS sea, 0::BIGINT AS offgrid,
             count(*) FILTER (WHERE status = 'error') AS error, 'ok' AS status, (SELECT min(alt) FROM mosaic WHERE real) AS min_alt, (SELECT max(alt) FROM mosaic WHERE real) AS max_alt FROM statuses""",
        tiles=_TILES, statuses=_STATUS, mosaic=_MOSAIC,
    ),
)
def _(spark, sf):
    wanted, headers = _tile_inputs(spark, sf)
    statuses = terrain.tile_statuses(wanted, headers)
    ranges = terrain.altitude_ranges(terrain.mosaic(statuses, headers)).select("request_id", F.col("lowest").alias("min_alt"), F.col("highest").alias("max_alt"))
    return terrain.request_status(statuses).join(ranges, "request_id", "left")


@query(
    "j6_requested_tiles",
    sql(
        "grid",
        """SELECT k AS request_id, east, north, g2.name || (ae % 10)::VARCHAR || (an % 10)::VARCHAR AS tile
           FROM (SELECT k, de AS east, dn AS north, g.easting_index * 10 + k % 10 + de AS ae, g.northing_index * 10 + (k // 10) % 10 + dn AS an
                 FROM (SELECT c_custkey AS k, ['NY','TV','OV','HP','SV','JE'][(c_custkey % 6 + 1)::INT] AS sq, c_custkey % 4 AS ew, c_custkey % 3 + 1 AS ns FROM customer) r
                   JOIN grid g ON g.name = sq JOIN range(4) AS x(de) ON de < ew JOIN range(4) AS y(dn) ON dn < ns)
             LEFT JOIN grid g2 ON g2.easting_index = ae // 10 AND g2.northing_index = an // 10""",
    ),
)
def _(spark, sf):
    requests = fixtures.table(spark, sf, "customer").selectExpr(
        "c_custkey as request_id", "get(array('NY','TV','OV','HP','SV','JE'), int(c_custkey % 6)) as gridsquare",
        "c_custkey % 10 as east", "(c_custkey div 10) % 10 as north", "c_custkey % 4 as ew", "c_custkey % 3 + 1 as ns",
    )
    return terrain.requested_tiles(requests)


# Flat regions.


@query("w5_neighbour_sum", sql("near", """SELECT c."row", c.col, count(n.nalt) AS neighbours, coalesce(sum(n.nalt), 0) AS total FROM cells c
    LEFT JOIN near n ON n."row" = c."row" AND n.col = c.col GROUP BY 1, 2"""))
def _(spark, sf):
    near = flat.neighbours(fixtures.terrain_cells(spark, sf), "alt")
    return near.select(
        "row", "col", F.size(F.filter("near", lambda v: v.isNotNull())).cast("bigint").alias("neighbours"),
        F.aggregate("near", F.lit(0.0), lambda acc, v: acc + F.coalesce(v["alt"], F.lit(0.0))).alias("total"),
    )


@query(
    "j7_equal_neighbours",
    sql("near", """SELECT c."row", c.col, coalesce(sum(CASE WHEN abs(c.alt - n.nalt) < 0.01 THEN 1 ELSE 0 END), 0)::INT AS same FROM cells c
        LEFT JOIN near n ON n."row" = c."row" AND n.col = c.col GROUP BY 1, 2"""),
)
def _(spark, sf):
    near = flat.neighbours(fixtures.terrain_cells(spark, sf), "alt")
    same = F.filter("near", lambda v: same_altitude(F.col("alt"), v["alt"]))
    return near.select("row", "col", F.size(same).alias("same"))


@query("r5_flat_seeds", sql("seeds", 'SELECT "row", col, alt, seed::INT AS seed FROM seeds'))
def _(spark, sf):
    return flat.flat_seeds(fixtures.terrain_cells(spark, sf))


@query("r6_grow_regions", sql("marked", 'SELECT "row", col, alt, water::INT AS water FROM marked'))
def _(spark, sf):
    return flat.grow_regions(fixtures.terrain_cells(spark, sf))


@query("r6_grow_small_blocks", sql("marked", 'SELECT "row", col, alt, water::INT AS water FROM marked'))
def _(spark, sf):
    """The same regions through many small blocks, so that most of them cross a block's edge."""
    return flat.grow_regions(fixtures.terrain_cells(spark, sf), block=16)


@query(
    "r7_next_to_marked",
    sql("marked", """SELECT c."row", c.col, c.alt, coalesce(bool_or(abs(c.alt - n.nalt) < 0.01 AND m.seed > 0), false) AS next_to_marked FROM cells c
        LEFT JOIN near n ON n."row" = c."row" AND n.col = c.col LEFT JOIN seeds m ON m."row" = n.nrow AND m.col = n.ncol GROUP BY 1, 2, 3"""),
)
def _(spark, sf):
    return flat.next_to_marked(flat.flat_seeds(fixtures.terrain_cells(spark, sf)), "seed")


@query("a21_water_counts", sql("marked", "SELECT count(*) FILTER (WHERE water = 1) AS seeds, count(*) FILTER (WHERE water > 0) AS total FROM marked"))
def _(spark, sf):
    return flat.water_counts(flat.grow_regions(fixtures.terrain_cells(spark, sf)))


_PIXELS = ", ".join(
    f"CASE WHEN water = 0 THEN {c} ELSE {w} END::INT AS {n}" for c, w, n in zip(ramp(LAND_RAMPS["standard"], "alt"), WATER["standard"], "rgb")
)


@query("r8_terrain_pixels", sql("marked", f'SELECT "row", col, {_PIXELS} FROM marked'))
def _(spark, sf):
    return terrain.terrain_pixels(flat.grow_regions(fixtures.terrain_cells(spark, sf)), "standard")


# Terrain maps start at request texts and at tile archives in a folder. The tiles of the spoilt mosaic lie in the national grid
# from 400 km east and 200 km north on, a hundred to a column; every nation asks for an overlapping rectangle there, two for nothing.

_REQUESTS = """SELECT k, 39 + k % 3 AS gx, 19 + (k // 3) % 3 AS gy, 1 + (k * 7) % 3 AS w, 1 + (k * 5) % 4 AS h FROM (SELECT n_nationkey::BIGINT AS k FROM nation) WHERE k NOT IN (5, 17)"""
_ASKED_TILES = """SELECT k, de AS east, dn AS north, t.number, t.n, t.north AS tn, t.east AS te, t.number IS NOT NULL AND t.number % 5 <> 4 AS held
  FROM requests JOIN range(3) AS x(de) ON de < w JOIN range(4) AS y(dn) ON dn < h
    LEFT JOIN tiles t ON 40 + t.east + 2 * (t.north // 100) = gx + de AND 20 + t.north % 100 = gy + dn"""
_MANY_SHAPES = "SELECT k, arg_min(n, east * 1000 + north) AS first_n FROM asked WHERE held AND number % 7 <> 3 AND number % 11 <> 5 GROUP BY k"
_MANY_STATUS = """SELECT a.*, s.first_n, CASE WHEN NOT held THEN 'sea' WHEN number % 7 <> 3 AND number % 11 <> 5 AND n = s.first_n THEN 'ok' ELSE 'error' END AS status
  FROM asked a LEFT JOIN shapes s USING (k)"""
_MANY_MOSAIC = """SELECT s.k, c."row" - tn * 50 + s.north * (first_n // 50) AS "row", c.col - te * 50 + s.east * 50 AS col, c.alt, true AS real
  FROM statuses s JOIN cells c ON c."row" // 50 = tn AND c.col // 50 = te WHERE status = 'ok'
  UNION ALL SELECT k, north * (first_n // 50) + r, east * 50 + q, -1000, false FROM statuses JOIN range(50) AS a(r) ON r < first_n // 50 JOIN range(50) AS b(q) ON true WHERE status <> 'ok'"""
_MANY_NEAR = """SELECT c.k, c."row", c.col, c.alt, d."row" AS nrow, d.col AS ncol, d.alt AS nalt
  FROM mosaic c JOIN (SELECT a AS dr, b AS dc FROM range(-1, 2) AS x(a), range(-1, 2) AS y(b) WHERE a <> 0 OR b <> 0) s ON true
    JOIN mosaic d ON d.k = c.k AND d."row" = c."row" + s.dr AND d.col = c.col + s.dc"""
_MANY_SEEDS = """SELECT c.k, c."row", c.col, c.alt, CASE WHEN c.alt = -1000 OR coalesce(n.same, 0) >= 6 THEN 1 ELSE 0 END AS seed
  FROM mosaic c LEFT JOIN (SELECT k, "row", col, count(*) AS same FROM near WHERE abs(alt - nalt) < 0.01 GROUP BY ALL) n ON c.k = n.k AND c."row" = n."row" AND c.col = n.col"""
_MANY_FLOOD = """SELECT k, "row", col FROM seeds WHERE seed = 1 AND alt <> -1000
  UNION SELECT n.k, n.nrow, n.ncol FROM flood f JOIN near n ON n.k = f.k AND n."row" = f."row" AND n.col = f.col WHERE abs(n.alt - n.nalt) < 0.01 AND n.nalt <> -1000"""
_MANY_MARKED = """SELECT s.k, s."row", s.col, s.alt, CASE WHEN s.seed = 1 THEN 1 WHEN f."row" IS NOT NULL THEN 2 ELSE 0 END AS water, e.lo, e.hi
  FROM seeds s LEFT JOIN flood f ON s.k = f.k AND s."row" = f."row" AND s.col = f.col JOIN (SELECT k, min(alt) FILTER (real) AS lo, max(alt) FILTER (real) AS hi FROM mosaic GROUP BY k) e ON e.k = s.k"""
_EFFECTIVE = "CASE WHEN alt >= 0 THEN alt * (1349.9::DOUBLE / nullif(hi, 0)) ELSE alt * (9.9::DOUBLE / abs(nullif(lo, 0))) END"


def _many_sql(body: str) -> str:
    return sql(
        "cells", body, tiles=_TILES, requests=_REQUESTS, asked=_ASKED_TILES, shapes=_MANY_SHAPES, statuses=_MANY_STATUS, mosaic=_MANY_MOSAIC,
        near=_MANY_NEAR, seeds=_MANY_SEEDS, flood=_MANY_FLOOD, marked=_MANY_MARKED,
    )


def _many_requests(spark, sf):
    """Request texts by nation: a square's name and a size; one with an unknown name, one without a width."""
    k = F.col("n_nationkey").cast("bigint")
    e, n = 39 + k % 3, 19 + F.floor(k / 3) % 3
    name = F.concat(dims.square_name(F.floor(e / 10), F.floor(n / 10)), (e % 10).cast("string"), (n % 10).cast("string"))
    size = F.concat((1 + (k * 7) % 3).cast("string"), F.lit("x"), (1 + (k * 5) % 4).cast("string"))
    return fixtures.table(spark, sf, "nation").select(
        k.alias("request_id"), F.when(k == 5, "nowhere").otherwise(F.lower(name)).alias("name"), F.when(k == 17, "0x2").otherwise(size).alias("dims"),
    )


def _zip_in_grid(batches):
    """Tile archives as files are named; every seventh tile has two."""
    for batch in batches:
        for t in batch.itertuples(index=False):
            names = [f"{t.tile.lower()}_grid.zip"] + ([f"{t.tile.lower()}_copy.zip"] if t.number % 7 == 3 else [])
            yield pd.DataFrame({"archive": names, "content": [common.zipped(f"{t.tile}.asc", t.text)] * len(names)})


def _grid_archives(spark, sf):
    """Listed archives of the spoilt mosaic's tiles, named by their square of the national grid."""
    number = (F.col("north") * 2 + F.col("east")).cast("bigint")
    e, n = 40 + F.col("east") + 2 * F.floor(F.col("north") / 100), 20 + F.col("north") % 100
    tile = F.concat(dims.square_name(F.floor(e / 10), F.floor(n / 10)), (e % 10).cast("string"), (n % 10).cast("string"))
    spoilt = F.when(number % 11 == 5, F.replace("text", F.lit("cellsize"), F.lit("cell size"))).otherwise(F.col("text"))
    texts = fixtures.tile_texts(spark, sf).filter(number % 5 != 4).select(number.alias("number"), tile.alias("tile"), spoilt.alias("text"))
    return common.stored_archives(texts.filter("tile IS NOT NULL").mapInPandas(_zip_in_grid, "archive string, content binary"))


def _q11_pixels() -> str:
    pixels = ", ".join(f"CASE WHEN water = 0 THEN {c} ELSE {w} END::INT AS {n}" for c, w, n in zip(ramp(LAND_RAMPS["red"], "eff"), WATER["red"], "rgb"))
    return f'SELECT k AS request_id, "row", col, {pixels} FROM (SELECT *, {_EFFECTIVE} AS eff FROM marked)'


@query("q11_terrain_map", _many_sql(_q11_pixels()))
def _(spark, sf):
    """Overlapping requests, from their texts and zipped tiles to pixels."""
    return terrain_map.terrain_map_from_archives(_many_requests(spark, sf), _grid_archives(spark, sf), "red").pixels()


@query(
    "q11_request_statuses",
    _many_sql("""SELECT s.k AS request_id, east, north, status, m.cells FROM statuses s LEFT JOIN (SELECT k, count(*) AS cells FROM mosaic GROUP BY k) m ON m.k = s.k"""),
)
def _(spark, sf):
    """Status of every tile of every request, and the size of the request's map."""
    made = terrain_map.terrain_map_from_archives(_many_requests(spark, sf), _grid_archives(spark, sf))
    sizes = made.cells.groupBy("request_id").agg(F.count("*").alias("cells"))
    return made.statuses.join(sizes, "request_id", "left").select("request_id", "east", "north", "status", "cells")


@query(
    "q12_mosaic_statistics",
    _histogram_sql(
        "counted", "counted",
        f"""SELECT 'summary' AS part, * FROM ({_SUMMARY}) UNION ALL BY NAME SELECT 'commonest' AS part, * FROM ({_COMMON})
            UNION ALL BY NAME SELECT 'notable' AS part, * FROM ({_NOTABLE}) UNION ALL BY NAME SELECT 'histogram' AS part, * FROM ({_BARS})""",
    ),
)
def _(spark, sf):
    """All parts of the statistics of one mosaic in one result; columns that a part lacks are null."""
    parts = terrain_map.terrain_statistics(fixtures.terrain_cells(spark, sf), "standard")
    named = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


_BY_TILE = {
    "counts": """SELECT 't_' || ("row" // 50)::VARCHAR || '_' || (col // 50)::VARCHAR AS tile, alt, count(*) AS cases FROM cells GROUP BY 1, 2""",
    "totals": "SELECT tile, sum(cases)::BIGINT AS total, min(alt) AS lo, max(alt) AS hi, CASE WHEN max(alt) < 100 THEN 10 WHEN max(alt) < 200 THEN 20 WHEN max(alt) < 300 THEN 50 ELSE 100 END AS width FROM counts GROUP BY 1",
    "edges": """SELECT tile, row_number() OVER (PARTITION BY tile ORDER BY o) - 1 AS i, edge FROM (SELECT tile, -1 AS o, lo AS edge FROM totals WHERE lo <= 0
      UNION ALL SELECT tile, s, (s * width)::DOUBLE FROM totals JOIN range(0, 2000) AS r(s) ON s * width - hi <= 2 * width)""",
    "bins": """SELECT a.tile, a.i::INT AS bin, a.edge AS lower, b.edge AS upper, coalesce(sum(c.cases), 0)::BIGINT AS cases FROM edges a JOIN edges b ON b.tile = a.tile AND b.i = a.i + 1
      LEFT JOIN counts c ON c.tile = a.tile AND c.alt >= a.edge AND c.alt < b.edge GROUP BY 1, 2, 3, 4""",
}


@query(
    "q12_tile_statistics",
    sql(
        "cells",
        f"""SELECT 'summary' AS part, tile, sum(cases)::BIGINT AS cells, count(*) AS unique_altitudes, min(alt) AS min_alt, max(alt) AS max_alt, round_even(max(alt) - min(alt), 1) AS alt_range,
              round_even(sum(alt * cases) / sum(cases)::DOUBLE, 1) AS mean_alt, sum(alt * cases) / sum(cases)::DOUBLE AS mean_exact FROM counts GROUP BY tile
            UNION ALL BY NAME SELECT 'commonest' AS part, tile, alt, cases, round_even(cases / total::DOUBLE * 100, 3) AS percent
              FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY cases DESC, alt) AS place FROM counts JOIN totals USING (tile)) WHERE place = 1
            UNION ALL BY NAME SELECT 'notable' AS part, tile, alt, cases, round_even(cases * 100 / total::DOUBLE, 2) AS percent FROM counts JOIN totals USING (tile) WHERE alt < 1 OR cases >= total / 100::DOUBLE
            UNION ALL BY NAME SELECT 'histogram' AS part, tile, * FROM (SELECT * EXCLUDE (r, g, b), CASE WHEN lower >= 0 THEN {_HEX} ELSE '#cce5ff' END AS hex
              FROM (SELECT *, {_rgb(ramp(LAND_RAMPS['standard'], 'lower'))} FROM bins))""".replace("tile, * FROM (SELECT", "* FROM (SELECT"),
        **_BY_TILE,
    ),
)
def _(spark, sf):
    """All parts of the statistics of every tile in one result, each tile with bins of its own; columns that a part lacks are null."""
    parts = terrain_map.tile_statistics(common.headers(spark, sf))
    named = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
