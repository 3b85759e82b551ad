"""Fixed column names, codes and formats of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The two heading lines that describe the postcode files, in order.
HEADER_SHORT = ["PC", "PQ", "EA", "NO", "CY", "RH", "LH", "CC", "DC", "WC"]
HEADER_LONG = [
    "Postcode", "Positional_quality_indicator", "Eastings", "Northings", "Country_code",
    "NHS_regional_HA_code", "NHS_HA_code", "Admin_county_code", "Admin_district_code",
    "Admin_ward_code",
]

RAW_POSTCODE = T.StructType(
    [
        T.StructField(name, T.IntegerType() if name in (
            "Positional_quality_indicator", "Eastings", "Northings") else T.StringType())
        for name in HEADER_LONG
    ]
)

# Columns kept from the files, then looked up, then derived.
SCANNED_COLUMNS = [
    "Postcode", "Postcode_area", "Quality", "Eastings", "Northings", "Country_code",
    "Admin_county_code", "Admin_district_code", "Admin_ward_code",
]
LOOKED_UP_COLUMNS = ["Post Town", "Country Name", "County Name", "District Name", "Ward Name"]
DERIVED_COLUMNS = ["Inward", "Outward", "District", "Pattern"]

# Dimension-like columns that the finished table must have.
CATEGORY_COLUMNS = [
    "Postcode_area", "Quality", "Country_code", "Admin_county_code", "Admin_district_code",
    "Admin_ward_code", "Post Town", "Country Name", "County Name", "District Name", "Ward Name",
    "Pattern", "Outward", "District", "Inward",
]

# The six valid postcode shapes.
VALID_PATTERNS = ["X9  9XX", "X99 9XX", "X9X 9XX", "XX9 9XX", "XX999XX", "XX9X9XX"]

# Quality codes of postcodes without a real location.
UNLOCATED_QUALITIES = [60, 90]

# Lookup columns as (lookup name, code in table, code in lookup, value in lookup).
LOOKUPS = [
    ("areas", "Postcode_area", "Postcode Area", "Post Town"),
    ("countries", "Country_code", "Country Code", "Country Name"),
    ("counties", "Admin_county_code", "County Code", "County Name"),
    ("districts", "Admin_district_code", "District Code", "District Name"),
    ("wards", "Admin_ward_code", "Ward Code", "Ward Name"),
]

# The kinds of sheet that make up the district and the ward lookup.
DISTRICT_KINDS = ["DIS", "MTD", "UTA", "LBO"]
WARD_KINDS = ["UTW", "UTE", "DIW", "LBW", "MTW"]

# Terrain files.
TILE_HEADER = ["ncols", "nrows", "xllcorner", "yllcorner", "cellsize"]
NO_ALTITUDE = -1000.0
ALTITUDE_TOLERANCE = 0.01

SQUARE_METRES = 100_000
