"""Q6-Q10: postcode maps as pixel tables.

A map is described by the rows it draws, the box it covers and its title; drawing is the same for
all kinds of place. The only values that reach the driver are the four corners and the title's names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.text import display_postcode, normalise_postcode, postcode_file_key
from gridterrain.operators import place as places, raster
from gridterrain.operators.rows import thin
from gridterrain.operators.skew import join_unique
from gridterrain.operators.spatial import (
    ALL_TITLE, CANVAS_HEIGHT, EXTENT_MARGIN, SQUARE_MARGIN, Box, Canvas, area_column, area_title, around_counts,
    describe_location, extent, find_postcode, neighbourhood_columns, postcode_title, square_box, square_title, squares_of, within,
)
from gridterrain.scratch import cut


@dataclass
class PostcodeMap:
    """A map to draw: rows (with ``row_id``), box, title columns and the colouring kind.

    Of several rows of the postcode ``key``, all have a disc, or that of ``key_row`` alone.
    """

    rows: DataFrame
    box: Box
    title: Column
    file_key: Column
    kind: str = "pa"
    key: Column | None = None
    key_row: int | None = None
    height: int = CANVAS_HEIGHT
    density: int = 1

    @property
    def canvas(self) -> Canvas:
        return Canvas(self.box, self.height)

    @property
    def full_title(self) -> Column:
        return self.canvas.title(self.title)

    def points(self) -> DataFrame:
        """Drawable rows with pixel position and packed colour.

        Colours are dealt out among the rows that survive thinning and clipping.
        """
        columns = {"row_id", "Postcode", "Eastings", "Northings", area_column(self.kind)}
        # Written once: colours, key and image all read the clipped rows.
        drawn = cut(self.canvas.scaled(thin(self.rows.select(*[f"`{c}`" for c in sorted(columns)]), self.density)), "drawn")
        return raster.with_colours(drawn, raster.area_colours(drawn, self.kind), self.kind)

    def raster(self) -> DataFrame:
        """Packed pixels, with the key postcode's disc if there is one."""
        points = self.points()
        image = raster.point_raster(points, self.canvas)
        if self.key is None:
            return image
        named = points.filter(F.col("Postcode") == self.key)
        if self.key_row is not None:
            named = named.filter(F.col("row_id") == self.key_row).orderBy("e_scaled", "n_scaled", "rgb").limit(1)
        return raster.highlight(image, named, self.canvas)

    def pixels(self) -> DataFrame:
        """``(x, y, r, g, b)``; pixels not listed are white."""
        return raster.pixels(self.raster())

    def hit_index(self) -> DataFrame:
        """``(x, ns, row_id)``."""
        return raster.hit_index(self.canvas.scaled(thin(self.rows, self.density)), self.canvas)


def whole_map(table: DataFrame, **options) -> PostcodeMap:
    """Q6: everything, with a tenth of margin."""
    box = Box.from_row(extent(table, EXTENT_MARGIN))
    return PostcodeMap(table, box, F.lit(ALL_TITLE), F.lit("allGB"), **options)


def area_map(table: DataFrame, area: str, **options) -> PostcodeMap:
    """Q7: one postcode area; the area filter reaches the scan."""
    rows = table.filter(F.col("Postcode_area") == area.upper())
    box = Box.from_row(extent(rows, EXTENT_MARGIN))
    town = rows.agg(F.min_by(F.col("`Post Town`"), "row_id")).first()[0]
    return PostcodeMap(rows, box, area_title(F.lit(area), F.lit(town)), F.lit(f"pa.{area.lower()}"), **options)


def square_map(table: DataFrame, squares: DataFrame, name: str, **options) -> PostcodeMap:
    """Q8: one grid square with a margin of 5 km on the canvas; rows outside the square are not drawn."""
    square = squares.filter(F.col("name") == name.upper()).first()
    name, label = square["name"], square["label"]
    box = square_box(square["easting_index"], square["northing_index"])
    return PostcodeMap(
        within(table, box), box.grown(SQUARE_MARGIN), square_title(F.lit(name), F.lit(label)), F.lit(f"ng.{name.lower()}"), **options
    )


def postcode_map(table: DataFrame, postcode: str, **options) -> PostcodeMap:
    """Q9: 10 km around one postcode, which is highlighted. Needs the looked-up names for its title.

    Of several rows with the postcode the located one of least ``row_id`` is the centre; others in its box are drawn as
    any row is.
    """
    # Equal row numbers are told apart as the disc's row is.
    order = [(F.col("Eastings") > 0).desc_nulls_last(), "row_id", "Eastings", "Northings", "description"]
    centre = describe_location(find_postcode(table, postcode)).orderBy(*order)
    found = centre.select("Postcode", "description", "row_id", *neighbourhood_columns()).first()
    if found is None:
        raise ValueError(f"postcode {postcode!r} found 0 times")
    box = Box.of(*[found[c] for c in ("e0", "n0", "e1", "n1")])
    key = F.lit(found["Postcode"])
    return PostcodeMap(
        within(table, box), box, postcode_title(display_postcode(key), F.lit(found["description"])),
        F.concat(F.lit("pc."), postcode_file_key(key)), key=key, key_row=found["row_id"], **options,
    )


# Outcome of a place request.
DRAWN, BAD_PLACE, UNKNOWN_PLACE = 0, 1, 2


def draw_place(table: DataFrame, squares: DataFrame, place_type: str, place_value: str, **options) -> tuple[int, PostcodeMap | None]:
    """Q10, F8 for one concrete place: the outcome and, if it is known, its map.

    ``table`` needs the looked-up names for an area's or a postcode's title. A type that does not exist is
    a bad place; an area or postcode without rows, or a square without land, an unknown one.
    """
    value = place_value.strip()
    if place_type == "all":
        return DRAWN, whole_map(table, **options)
    if place_type not in places.PLACE_TYPES:
        return BAD_PLACE, None
    found = {
        "pa": lambda: table.filter(F.col("Postcode_area") == value.upper()),
        "ng": lambda: squares.filter((F.col("name") == value.upper()) & F.col("is_real")),
        "pc": lambda: find_postcode(table, value),
    }[place_type]()
    if found.isEmpty():
        return UNKNOWN_PLACE, None
    if place_type == "pa":
        return DRAWN, area_map(table, value, **options)
    if place_type == "ng":
        return DRAWN, square_map(table, squares, value, **options)
    return DRAWN, postcode_map(table, value, **options)


def answer_places(table: DataFrame, squares: DataFrame, requests: DataFrame, seed: int) -> DataFrame:
    """Q10 over a table of place strings ``(request_id, place)``.

    Gives the concrete place, the outcome code and how many rows its map starts from, or the maps around all rows of its postcode.
    """
    # The rows of the areas answer four questions, so they are counted once.
    areas = cut(table.groupBy("Postcode_area").agg(F.count("*").alias("_pa_rows")), "areas")
    classified = places.classify_places(requests, areas)
    wanted = cut(classified.select("request_id", "place_type", "place_value"), "places")
    concrete = cut(places.resolve_random(wanted, table, squares.filter("is_real"), seed), "places")
    checked = places.place_exists(concrete, table.select("Postcode").distinct(), areas)
    status = (
        F.when(F.col("place_type") == "", BAD_PLACE).when(F.col("exists"), DRAWN).otherwise(UNKNOWN_PLACE)
    )
    known = cut(checked.withColumn("status", status), "answers")

    value = F.upper(F.trim("place_value"))
    per_square = squares_of(table.select("Eastings", "Northings")).groupBy("square").agg(F.count("*").alias("rows"))
    named = (
        areas.select(F.lit("pa").alias("_type"), F.col("Postcode_area").alias("_value"), F.col("_pa_rows").alias("rows"))
        .unionByName(per_square.select(F.lit("ng").alias("_type"), F.col("square").alias("_value"), "rows"))
        .unionByName(areas.agg(F.coalesce(F.sum("_pa_rows"), F.lit(0)).alias("rows")).select(F.lit("all").alias("_type"), F.lit("GB").alias("_value"), "rows"))
    )
    by_name = known.filter("place_type <> 'pc' or status <> 0").join(
        named, (F.col("place_type") == F.col("_type")) & (value == F.col("_value")), "left"
    )
    centres = known.filter("place_type = 'pc' and status = 0").withColumn("_pc", normalise_postcode(F.col("place_value")))
    wanted = centres.groupBy("_pc").agg(F.count("*").alias("_n"))
    spots = table.join(wanted, F.col("Postcode") == F.col("_pc"), "left_semi").select(
        F.col("Postcode").alias("centre_id"), "Eastings", "Northings"
    )
    # A postcode of several rows counts what is around each of them, so a request has one answer.
    around = around_counts(table, spots).groupBy(F.col("centre_id").alias("_pc")).agg(F.sum("points").alias("rows"))
    by_code = join_unique(centres, around.join(wanted, "_pc"), ["_pc"], "_n")
    columns = ["request_id", "place_type", "place_value", "status",
               F.when(F.col("status") == DRAWN, F.coalesce("rows", F.lit(0))).otherwise(0).cast("bigint").alias("rows")]
    return by_name.select(*columns).unionByName(by_code.select(*columns))
