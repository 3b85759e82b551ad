"""Fixed dimensions (countries, grid squares, colour schemes, palette)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridterrain.functions.colour import LAND_RAMPS, NUMERIC, SOFT_PALETTE, WATER, hex_colour

# Country codes and names.
COUNTRIES = [
    ("E92000001", "England"), ("S92000003", "Scotland"), ("W92000004", "Wales"), ("N92000002", "N. Ireland"),
]

# Letters of the 500 km squares (south to north, west to east) and of the 100 km
# squares inside one (north to south, west to east; there is no I).
OUTER_LETTERS = ["ST", "NO", "HJ"]
INNER_LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"

# Second letters of the squares without land of Great Britain (S, T, N, H), or with (O).
SEA_LETTERS = {"S": "ABCFGLQ", "T": "BCDEHJKNOPSTUWXYZ", "N": "EPQV", "H": "ABCDEFGHJKLMNOQRSV"}
LAND_LETTERS = {"O": "V"}

# Descriptions of grid squares.
SQUARE_LABELS = {
    "SV": "Isles of Scilly",
    "SW": "Cornwall",
    "SX": "South Devon",
    "SY": "Dorset Coast",
    "SZ": "Isle of Wight",
    "TV": "Beachy Head",
    "SR": "South-west Pembrokeshire",
    "SS": "North Devon and Swansea",
    "ST": "Bristol Channel",
    "SU": "Hampshire and Wiltshire",
    "TQ": "London, Surrey and Sussex",
    "TR": "Kent",
    "SM": "West Pembroke",
    "SN": "West Wales",
    "SO": "West Midlands, Welsh borders, Gloucester",
    "SP": "Birmingham, Oxfordshire and Warwickshire",
    "TL": "Hertfordshire and Cambridgeshire",
    "TM": "Essex and Suffolk",
    "SH": "Anglesey and Snowdonia",
    "SJ": "North-east Wales, Cheshire, Liverpool",
    "SK": "East Midlands",
    "TF": "The Wash",
    "TG": "Norfolk",
    "SC": "Isle of Man",
    "SD": "Lancashire",
    "SE": "Leeds, Bradford and York",
    "TA": "Humber Estuary and East Yorkshire coast",
    "NW": "Western edge of Galloway, south-west Scotland",
    "NX": "Galloway, south-west Scotland",
    "NY": "Cumbria, North Yorkshire and Borders",
    "NZ": "Newcastle and Durham",
    "OV": "East Yorkshire coast (miniscule)",
    "NR": "Islay, Jura, Kintyre",
    "NS": "Glasgow and Ayrshire",
    "NT": "Edinburgh and Borders",
    "NU": "Northumberland Coast",
    "NL": "Tiree and Barra (south west Hebrides)",
    "NM": "Mull, Oban and Mallaig",
    "NN": "Fort William, Pittlochry and Crieff",
    "NO": "Perth and Dundee",
    "NF": "North and South Uist, Outer Hebrides",
    "NG": "Skye and Wester Ross",
    "NH": "Inverness",
    "NJ": "Elgin and Aberdeen",
    "NK": "Peterhead, northeast of Aberdeen",
    "NA": "Western edge of Lewis, Outer Hebrides",
    "NB": "Lewis, Outer Hebrides",
    "NC": "Cape Wrath and northern Scotland",
    "ND": "Thurso and Wick, north-east Scotland",
    "HW": "North Rona, north-west of Cape Wrath",
    "HX": "Sule Skerry and Stack Skerry, west of Orkney",
    "HY": "Orkney",
    "HZ": "Fair Isle, between Shetland and Orkney",
    "HT": "Foula, westernmost of the Shetland Islands",
    "HU": "Shetland",
    "HP": "Unst, northernmost of the Shetland Islands",
}
NO_LABEL = "????"

GRID_EASTS, GRID_NORTHS = 10, 15


def _named_squares() -> list[tuple[str, int, int, bool]]:
    """Name, east index, north index and land flag of every square, west to east and south to north."""
    rows = []
    for e in range(GRID_EASTS):
        for n in range(GRID_NORTHS):
            outer, inner = OUTER_LETTERS[n // 5][e // 5], INNER_LETTERS[(4 - n % 5) * 5 + e % 5]
            real = inner in LAND_LETTERS[outer] if outer in LAND_LETTERS else outer in SEA_LETTERS and inner not in SEA_LETTERS[outer]
            rows.append((outer + inner, e, n, real))
    return rows


SQUARES = _named_squares()


def _texts(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def square_name(easting_index: Column, northing_index: Column) -> Column:
    """Name of the 100 km square at whole-number indexes; null outside the grid."""
    names = F.expr(f"array({_texts([s[0] for s in SQUARES])})")
    place = F.when(northing_index.between(0, GRID_NORTHS - 1), easting_index * GRID_NORTHS + northing_index)
    return F.get(names, place.cast("int"))


def square_indexes(name: Column) -> tuple[Column, Column]:
    """East and north index of a two-letter square name in any case; null for an unknown name."""
    places = F.expr(f"map({', '.join(f"'{s[0]}', {i}" for i, s in enumerate(SQUARES))})")
    place = F.try_element_at(places, F.upper(name))
    return F.floor(place / GRID_NORTHS).cast("int"), place % GRID_NORTHS


def is_square_name(name: Column) -> Column:
    """Any of the 150 names, in any case."""
    return F.coalesce(F.upper(name).isin([s[0] for s in SQUARES]), F.lit(False))


def is_land_name(name: Column) -> Column:
    """A square that holds land of Great Britain, in any case."""
    return F.coalesce(F.upper(name).isin([s[0] for s in SQUARES if s[3]]), F.lit(False))


def grid_squares(spark: SparkSession) -> DataFrame:
    """The 150 grid squares of 100 km."""
    rows = [(n, e, k, 100, real, SQUARE_LABELS.get(n, NO_LABEL) if real else NO_LABEL) for n, e, k, real in SQUARES]
    return spark.createDataFrame(
        rows, "name string, easting_index int, northing_index int, km_length int, is_real boolean, label string"
    )


def real_squares(spark: SparkSession) -> DataFrame:
    """grid squares with land."""
    return grid_squares(spark).filter("is_real")


def countries(spark: SparkSession) -> DataFrame:
    """Country codes and names."""
    return spark.createDataFrame(COUNTRIES, "`Country Code` string, `Country Name` string")


def colour_schemes(spark: SparkSession) -> DataFrame:
    """One row per scheme and ramp segment, with the water colour.

    A segment covers ``altitude <= effective altitude < next_altitude``. The numeric scheme is a
    formula, so it has one row without a segment.
    """
    rows = []
    for scheme, stops in LAND_RAMPS.items():
        for i, (alt, rgb) in enumerate(stops):
            upper = stops[i + 1] if i + 1 < len(stops) else (None, (None, None, None))
            rows.append((scheme, i, float(alt), *rgb, None if upper[0] is None else float(upper[0]), *upper[1], *WATER[scheme]))
    rows.append((NUMERIC, 0, *[None] * 11))
    return spark.createDataFrame(
        rows,
        "scheme string, ord int, altitude double, r int, g int, b int, next_altitude double, next_r int, "
        "next_g int, next_b int, water_r int, water_g int, water_b int",
    )


def area_palette(spark: SparkSession) -> DataFrame:
    """The twelve softened area colours."""
    colours = spark.createDataFrame(
        [(i, *rgb) for i, rgb in enumerate(SOFT_PALETTE)], "colour_group int, r int, g int, b int"
    )
    return colours.withColumn("hex", hex_colour(F.col("r"), F.col("g"), F.col("b")))


# Map colours of land and sea squares, and where a label sits in a 100-unit square.
LAND_SQUARE, SEA_SQUARE = "#99ff66", "#99ccff"
LABEL_EAST, LABEL_NORTH, SQUARE_UNITS = 50, 45, 100


def grid_layout(squares: DataFrame) -> DataFrame:
    """Drawing instructions for the grid: colour, label position and label colour."""
    return squares.select(
        "name",
        F.when(F.col("is_real"), LAND_SQUARE).otherwise(SEA_SQUARE).alias("fill"),
        (F.col("easting_index") * SQUARE_UNITS + LABEL_EAST).alias("label_x"),
        (F.col("northing_index") * SQUARE_UNITS + LABEL_NORTH).alias("label_y"),
        F.when(F.col("is_real"), "black").otherwise("gray").alias("label_colour"),
    )
