"""Hand-made cases."""

import pytest
from pyspark.sql import functions as F

from gridterrain.functions import colour, text
from gridterrain.operators import altitudes, flat, place, spatial
from gridterrain.sources import dims


def apply(spark, values, function, kind="string"):
    """Results of a column function, in the order of the values."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_normalise(spark):
    cases = {"ng2 6ag": "NG2 6AG", " e1 1aa ": "E1  1AA", "AB10 1AA": "AB101AA", "E1W1AA": "E1W 1AA", "NG": "NG", "SW1A0AA": "SW1A0AA", "\tne1\n": "NE1"}
    assert apply(spark, cases, text.normalise_postcode) == list(cases.values())


def test_names(spark):
    counties = {"Essex  County": "Essex", "County Durham": "County Durham", "X County Y": "X Y"}
    assert apply(spark, counties, text.county_name) == list(counties.values())
    boroughs = {"Camden London Boro": "London Borough of Camden", "City of London Corp": "City of London", " X ": "X"}
    assert apply(spark, boroughs, text.london_borough_name) == list(boroughs.values())
    assert apply(spark, ["E1W", "AB10", "XYZ"], text.outward_area) == ["E", "AB", None]
    assert apply(spark, ["E1W", "AB10", "XYZ"], text.outward_district) == ["1W", "10", None]
    assert apply(spark, ["Tintagel ED (DET) ", "Tintagel ED"], text.is_detached_ward) == [True, False]
    assert apply(spark, ["NG2 6AG", "SW1A0AA"], text.display_postcode) == ["NG2 6AG", "SW1A 0AA"]


def test_description(spark):
    rows = spark.createDataFrame(
        [(0, "Trent Bridge Ward", "Rushcliffe District (B)", "Nottinghamshire"), (1, None, None, None), (2, "A ED", "B London Borough", None)],
        "i int, w string, d string, c string",
    )
    out = rows.select("i", text.location_description(F.col("w"), F.col("d"), F.col("c")).alias("t")).orderBy("i").collect()
    assert [r.t for r in out] == ["Trent Bridge, Rushcliffe, Nottinghamshire", "[No ward]", "A, B, London"]


PLACES = {
    "DN": ("pa", "DN"), "NZ": ("ng", "NZ"), "TQ": ("", ""), "E": ("pa", "E"), "abc": ("", ""), "pa:x:y": ("", ""), "zz:1": ("", ""),
    "pc:random": ("pc", "random"), "ALL": ("all", "GB"), "": ("", ""), " PC: ng2 6ag ": ("pc", "ng2 6ag"), "SW1A0AA": ("pc", "SW1A0AA"), "XX": ("", ""),
}


def test_places(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(PLACES)], "request_id int, place string")
    areas = spark.createDataFrame([("DN",), ("TQ",), ("E",)], "Postcode_area string")
    out = place.classify_places(rows, areas).orderBy("request_id").collect()
    assert [(r.place_type, r.place_value) for r in out] == list(PLACES.values())


def test_squares(spark):
    squares = {r.name: r for r in dims.grid_squares(spark).collect()}
    assert len(squares) == 150 and sum(r.is_real for r in squares.values()) == 55
    where = {n: (squares[n].easting_index, squares[n].northing_index) for n in ("SV", "NG", "NY", "TQ", "NZ", "HP", "OV")}
    assert where == {"SV": (0, 0), "NG": (1, 8), "NY": (3, 5), "TQ": (5, 1), "NZ": (4, 5), "HP": (4, 12), "OV": (5, 5)}
    assert squares["SC"].label == "????" and squares["TQ"].label == "London, Surrey and Sussex"
    assert apply(spark, ["NY", "nz", "TZ", "??"], lambda c: place.next_square(c, 1, 0)) == ["NZ", "OV", "", ""]
    assert apply(spark, ["NZ"], lambda c: place.next_square(c, 0, 1)) == ["NU"]
    parsed = apply(spark, ["ny12", "II00", "NY1", "NY123", "NY12\n"], lambda c: F.array(*[p.cast("string") for p in place.parse_small_square(c)]))
    assert parsed[0] == ["NY", "1", "2"] and all(p == [None] * 3 for p in parsed[1:])
    reach = spark.createDataFrame([("NY", 1, 2, 9, 8), ("TZ", 9, 9, 1, 0), ("NY", 0, 0, -1, 0)], "g string, e int, n int, de int, dn int")
    out = reach.select(place.square_reached(*[F.col(c) for c in reach.columns]).alias("t")).collect()
    assert [r.t for r in out] == ["NU00", None, "NX90"]


@pytest.mark.parametrize("km,dims_text,expected", [(10, "200x200", (200, 200)), (10, "201x1", (0, 0)), (100, "20X20", (20, 20)), (100, "21x1", (0, 0)), (10, "5x0", (5, 0)), (10, "ax1", (0, 0))])
def test_dimensions(spark, km, dims_text, expected):
    row = spark.range(1).select(*place.parse_dimensions(F.lit(dims_text), F.lit(km))).first()
    assert tuple(row) == expected


def test_land_ramp(spark):
    cases = {30.0: (255, 244, 166), -5.0: (255, 255, 195), -10.0: (255, 255, 238), 1350.0: (255, 0, 0), 1400.0: (0, 0, 0), -11.0: (0, 0, 0)}
    out = apply(spark, cases, lambda c: F.array(*colour.land_colour("standard", c)), "double")
    assert [tuple(v) for v in out] == list(cases.values())
    # No range to divide by on the negative side: 0 and above still colour.
    factors = colour.ramp_factors("standard", F.lit(0.0), F.lit(1349.9))
    assert apply(spark, [30.0], lambda c: F.array(*colour.land_colour("standard", c, factors)), "double") == [[255, 244, 166]]


def test_numeric_colour(spark):
    cases = {512.0: (5, 12, 0), -2.0: (200, 2, 255), -5.0: (125, 5, 255), -12.0: (120, 12, 255), -1000.0: (255, 255, 255)}
    out = apply(spark, cases, lambda c: F.array(*colour.land_colour("numeric", c)), "double")
    assert [tuple(v) for v in out] == list(cases.values())


def test_extent_and_canvas(spark):
    rows = spark.createDataFrame([(63222, 8478), (655448, 1213615), (0, 0)], "Eastings int, Northings int")
    corners = spatial.extent(rows, 0.1).first()
    assert tuple(corners) == (-57291, -112035, 775961, 1334128)
    canvas = spatial.Canvas(spatial.Box.of(*corners))
    assert spark.range(1).select(canvas.width, canvas.size_text).first()[:] == (460, "833 km x 1446 km")
    assert tuple(spatial.extent(rows.filter("Eastings = 0"), 0.1).first()) == (None,) * 4


def test_floor_division(spark):
    from gridterrain.functions.numeric import float_floor_div

    values = [1.0, -1.0, 0.3, -0.25, 7.7, 147000.0]
    assert apply(spark, values, lambda c: float_floor_div(c, F.lit(0.1)), "double") == [v // 0.1 for v in values]
    assert apply(spark, values, lambda c: float_floor_div(c, F.lit(1.1)), "double") == [v // 1.1 for v in values]


def test_shared_corner(spark):
    rows = spark.createDataFrame([(100000, 100000), (0, 0), (999999, 50)], "Eastings int, Northings int")
    out = {}
    for r in spatial.squares_of(rows).collect():
        out.setdefault(r.Eastings, set()).add(r.square)
    assert out == {100000: {"SV", "SW", "SQ", "SR"}, 0: {"SV"}, 999999: {"TZ"}}


@pytest.mark.parametrize(
    "alts,edges",
    [([3.2, 95.0], [float(e) for e in range(0, 120, 10)]), ([-1.2, 250.0], [-1.2, 0, 50, 100, 150, 200, 250, 300, 350]), ([0.0, 5.0], [0.0, 0.0, 10.0, 20.0]), ([-50.0, -45.0], [])],
)
def test_histogram_edges(spark, alts, edges):
    counts = altitudes.altitude_counts(spark.createDataFrame([(a,) for a in alts], "alt double"))
    bins = altitudes.histogram(counts).orderBy("bin").collect()
    assert [b.lower for b in bins] == edges[:-1] and [b.upper for b in bins] == edges[1:]
    if edges:
        assert sum(b.cases for b in bins) == len(alts)
    if edges[:2] == [0.0, 0.0]:
        assert bins[0].cases == 0


def grid(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(values) for c, v in enumerate(line)], "row bigint, col bigint, alt double")


def test_flat_square(spark):
    cells = grid(spark, [[1.0] * 3] * 3)
    seeds = {(r.row, r.col): r.seed for r in flat.flat_seeds(cells, block=2).collect()}
    assert seeds == {(r, c): int((r, c) == (1, 1)) for r in range(3) for c in range(3)}
    water = {(r.row, r.col): r.water for r in flat.grow_regions(cells, block=2).collect()}
    assert water == {(r, c): 1 if (r, c) == (1, 1) else 2 for r in range(3) for c in range(3)}


def test_chained_tolerance(spark):
    values = [[1.0, 1.0, 1.0, 9, 9, 9], [1.0, 1.0, 1.0, 1.006, 1.012, 1.1], [1.0, 1.0, 1.0, 9.5, 9.6, -1000]]
    water = {(r.row, r.col): r.water for r in flat.grow_regions(grid(spark, values), block=2).collect()}
    assert water[(1, 3)] == 2 and water[(1, 4)] == 2 and water[(1, 5)] == 0 and water[(2, 5)] == 1


def test_terrain_maps_of_many_requests_stay_apart(spark):
    from gridterrain.plans.terrain_map import terrain_map

    head = "ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 50\n"
    tiles = spark.createDataFrame([("NY00", 1, head + "1 1\n1 1\n"), ("NY10", 1, head + "1 90\n1 1\n"), ("SK00", 1, "broken")], "tile string, files long, text string")
    asked = [(0, "ny00", "2x1"), (1, "NY10", "1x1"), (2, "NY00", "1x2"), (3, "nowhere", "1x1"), (4, "ny10", "0x1"), (5, "ny50", "1x1"), (6, "sk00", "1x1"), (7, "NY00", "2x1")]
    made = terrain_map(spark.createDataFrame(asked, "request_id int, name string, dims string"), tiles, "red", block=2)
    assert {(r.request_id, r.east, r.north): r.status for r in made.statuses.collect()} == {
        (0, 0, 0): "ok", (0, 1, 0): "ok", (1, 0, 0): "ok", (2, 0, 0): "ok", (2, 0, 1): "sea", (5, 0, 0): "sea", (6, 0, 0): "error", (7, 0, 0): "ok", (7, 1, 0): "ok",
    }
    pixels = {}
    for r in made.pixels().collect():
        pixels.setdefault(r.request_id, {})[r.row, r.col] = (r.r, r.g, r.b)
    assert {k: len(v) for k, v in pixels.items()} == {0: 8, 1: 4, 2: 8, 7: 8} and pixels[0] == pixels[7]
    for k, name, size in (asked[i] for i in (0, 1, 2)):
        alone = terrain_map(spark.createDataFrame([(k, name, size)], "request_id int, name string, dims string"), tiles, "red").pixels()
        assert {(r.row, r.col): (r.r, r.g, r.b) for r in alone.collect()} == pixels[k]
    parts = made.statistics()
    assert {r.request_id: r.cells for r in parts["summary"].collect()} == {0: 8, 1: 4, 2: 8, 7: 8}
    assert {r.request_id: (r.alt, r.cases) for r in parts["commonest"].collect()} == {0: (1.0, 7), 1: (1.0, 3), 2: (-1000.0, 4), 7: (1.0, 7)}
    assert {r.request_id for r in parts["histogram"].filter("lower = -1000").collect()} == {2}
    assert terrain_map(spark.createDataFrame(asked[3:5], "request_id int, name string, dims string"), tiles).pixels().collect() == []


def test_quartiles_by_rank(spark):
    import numpy as np

    from gridterrain.operators.reports import numeric_profile

    rng = np.random.default_rng(5)
    for values in ([7], [1, 2], [3, 3, 3, 9], rng.integers(-50, 50, 501).tolist(), (rng.integers(0, 4000, 998) / 4).tolist()):
        rows = [(float(v), None) for v in values] + [(None, None)]
        found = numeric_profile(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect()
        assert [r.column for r in found] == ["a"] and found[0]["count"] == len(values)
        assert [found[0][f"q{p}"] for p in (25, 50, 75)] == np.percentile(values, [25, 50, 75]).tolist()
    assert numeric_profile(spark.createDataFrame([], "a double"), ["a"]).collect() == []


def test_places_are_drawn_or_refused(spark):
    from gridterrain.plans.maps import BAD_PLACE, DRAWN, UNKNOWN_PLACE, draw_place
    from gridterrain.sources.dims import grid_squares

    names = ", ".join(f"`{c}` string" for c in ("Post Town", "County Name", "District Name", "Ward Name"))
    table = spark.createDataFrame(
        [(0, "NG1 1AA", "NG", 457000, 340000, "Nottingham", None, "Rushcliffe", "Mill Ward"), (1, "NG2 6AG", "NG", 458000, 341000, "Nottingham", None, None, None)],
        f"row_id bigint, Postcode string, Postcode_area string, Eastings int, Northings int, {names}",
    )
    asked = [("all", "GB"), ("pa", " ng"), ("ng", "sk"), ("pc", "ng11aa"), ("pa", "zz"), ("ng", "ha"), ("ng", "zz"), ("pc", "zz11zz"), ("xx", "ng")]
    got = [draw_place(table, grid_squares(spark), kind, value) for kind, value in asked]
    assert [status for status, _ in got] == [DRAWN] * 4 + [UNKNOWN_PLACE] * 4 + [BAD_PLACE]
    assert all((a_map is None) == (status != DRAWN) for status, a_map in got)
    assert got[3][1].pixels().count() > 0


def repeated_postcodes(spark):
    """NG1 1AA in a row without a place, one that comes twice, one nearby and one far off."""
    names = ", ".join(f"`{c}` string" for c in ("Post Town", "County Name", "District Name", "Ward Name"))
    rows = [(0, 0, 0, None), (3, 459000, 341000, "Far Ward"), (2, 457000, 340000, "Mill Ward"), (2, 457000, 340000, "Mill Ward"), (4, 900, 900, None)]
    return spark.createDataFrame(
        [(i, "NG1 1AA", "NG", e, n, "Nottingham", None, None, ward) for i, e, n, ward in rows],
        f"row_id bigint, Postcode string, Postcode_area string, Eastings int, Northings int, {names}",
    )


def test_map_around_a_postcode_of_several_rows(spark):
    from gridterrain.plans.maps import postcode_map

    found = postcode_map(repeated_postcodes(spark), "ng11aa")
    assert spark.range(1).select(found.full_title).first()[0] == "Around postcode NG1 1AA [Mill] : 10 km x 10 km"
    pixels = {(r.x, r.y): (r.r, r.g, r.b) for r in found.pixels().collect()}
    assert found.pixels().count() == len(pixels)
    assert pixels[400, 400] == (255, 127, 127) and pixels[400, 425] == (255, 191, 191)  # the place and its disc
    assert pixels[560, 320] == (255, 127, 127) and (560, 340) not in pixels  # no disc around another row
    with pytest.raises(ValueError, match="found 0 times"):
        postcode_map(repeated_postcodes(spark), "ng11ab")


def test_place_of_a_repeated_postcode_is_drawn(spark):
    from gridterrain.plans.maps import DRAWN, draw_place
    from gridterrain.sources.dims import grid_squares

    status, a_map = draw_place(repeated_postcodes(spark), grid_squares(spark), "pc", " ng11aa")
    pixels = a_map.pixels()
    assert status == DRAWN and pixels.count() == pixels.select("x", "y").distinct().count() > 2_000


def test_a_request_of_a_repeated_postcode_has_one_answer(spark):
    from gridterrain.plans.maps import answer_places
    from gridterrain.sources.dims import grid_squares

    asked = spark.createDataFrame([(1, "ng1 1aa"), (2, "all")], "request_id bigint, place string")
    got = answer_places(repeated_postcodes(spark), grid_squares(spark), asked, 1).collect()
    # Around the rows of the postcode there are 2, 3, 3, 3 and 2 rows.
    assert sorted((r.request_id, r.status, r.rows) for r in got) == [(1, 0, 13), (2, 0, 5)]


def test_boxes_of_neighbourhoods_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or write(df, label))
    points = spark.createDataFrame([(i, 7 * i, 11 * i) for i in range(50)], "centre_id bigint, Eastings int, Northings int")
    assert spatial.around_counts(points, points).agg(F.sum("points")).first()[0] > 0
    assert "SortMergeJoin" in plans["cells"] and "BroadcastHashJoin" not in plans["cells"]
