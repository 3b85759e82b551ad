"""Postcode and place-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Drop any white space at both ends (``trim`` alone only drops spaces)."""
    return F.btrim(c, F.lit(" \t\n\r\f\v"))


def normalise_postcode(c: Column) -> Column:
    """The seven-character form used as key; other lengths pass through unpadded."""
    packed = F.replace(strip(F.upper(c)), F.lit(" "), F.lit(""))
    size = F.length(packed)
    spaced = F.concat(
        packed.substr(F.lit(1), size - 3), F.repeat(F.lit(" "), F.lit(7) - size), F.right(packed, F.lit(3))
    )
    return F.when(size.isin(5, 6), spaced).otherwise(packed)


def shape(c: Column) -> Column:
    """Digits to 9 and capitals to X, after trimming."""
    return F.regexp_replace(F.regexp_replace(strip(c), "[0-9]", "9"), "[A-Z]", "X")


def inward(c: Column) -> Column:
    """The last three characters."""
    return strip(F.right(c, F.lit(3)))


def outward(c: Column) -> Column:
    """Everything before the last three characters."""
    return strip(c.substr(F.lit(1), F.greatest(F.length(c) - 3, F.lit(0))))


# Fixed value: area letters followed by a district that starts with a digit.
_AREA_DISTRICT = "([A-Z][A-Z]?)([0-9].*)"


def outward_area(c: Column) -> Column:
    """P5: area letters of an outward code, null when there is no match."""
    return F.nullif(F.regexp_extract(c, _AREA_DISTRICT, 1), F.lit(""))


def outward_district(c: Column) -> Column:
    """P5: district part of an outward code, null when there is no match."""
    return F.nullif(F.regexp_extract(c, _AREA_DISTRICT, 2), F.lit(""))


def county_name(c: Column) -> Column:
    """County name without the word County."""
    return strip(F.replace(strip(c), F.lit(" County"), F.lit("")))


def london_borough_name(c: Column) -> Column:
    """Full form of an abbreviated London borough name."""
    name = strip(c)
    return (
        F.when(
            F.endswith(name, F.lit("London Boro")),
            F.concat(F.lit("London Borough of "), strip(F.replace(name, F.lit(" London Boro"), F.lit("")))),
        )
        .when(F.contains(name, F.lit("City of London")), F.lit("City of London"))
        .otherwise(name)
    )


def is_detached_ward(c: Column) -> Column:
    """second name of a ward code for its detached part."""
    return F.endswith(strip(c), F.lit("(DET)"))


# Endings and parts of names that are left out of a description, and what stands for no ward.
WARD_PARTS, DISTRICT_PARTS, NO_WARD = (" Ward", " ED"), (" (B)", " District"), "[No ward]"


def _without(c: Column, *drops: str) -> Column:
    c = F.coalesce(c, F.lit(""))
    for drop in drops:
        c = F.replace(c, F.lit(drop), F.lit(""))
    return c


def location_description(ward: Column, district: Column, county: Column) -> Column:
    """Ward, district and county in one line, blanks skipped."""
    ward = _without(ward, *WARD_PARTS)
    district = F.replace(_without(district, *DISTRICT_PARTS), F.lit(" London Borough"), F.lit(", London"))
    return F.concat_ws(
        ", ",
        F.coalesce(F.nullif(ward, F.lit("")), F.lit(NO_WARD)),
        F.nullif(district, F.lit("")),
        F.nullif(county, F.lit("")),
    )


def display_postcode(c: Column) -> Column:
    """Postcode with a space before the inward part."""
    c = F.upper(c)
    spaced = F.concat(c.substr(F.lit(1), F.greatest(F.length(c) - 3, F.lit(0))), F.lit(" "), F.right(c, F.lit(3)))
    return F.when(F.instr(c, " ") == 0, spaced).otherwise(c)


def postcode_file_key(c: Column) -> Column:
    """Lower-case postcode without spaces, for file names."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))
