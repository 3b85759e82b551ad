"""Place strings, square arithmetic and map requests, over whole tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.numeric import mix_hash, wide_hash
from gridterrain.functions.text import normalise_postcode, strip
from gridterrain.operators.skew import join_unique
from gridterrain.sources.dims import is_land_name, is_square_name, square_indexes, square_name

# Place types, the largest side of a request in km, and sizes of squares in km.
PLACE_TYPES = ["pa", "pc", "ng"]
LARGEST_KM = 2_000
SQUARE_KM, SMALL_KM = 100, 10


def is_square(name: Column) -> Column:
    """Any of the 150 square names, in any case."""
    return is_square_name(name)


def is_land_square(name: Column) -> Column:
    """F8: a square with land."""
    return is_land_name(name)


def parse_small_square(name: Column) -> tuple[Column, Column, Column]:
    """``(gridsquare, east, north)`` of a 10 km square name; nulls when it is not one."""
    outer = F.substring(name, 1, 2)
    good = name.rlike(r"^[A-Za-z]{2}[0-9]{2}\z") & is_square(outer)
    digit = [F.when(good, F.substring(name, i, 1)).cast("int") for i in (3, 4)]
    return F.when(good, F.upper(outer)), digit[0], digit[1]


def next_square(name: Column, east: int, north: int) -> Column:
    """Name of the square some whole squares away; blank off the grid or for an unknown name."""
    e, n = square_indexes(name)
    return F.coalesce(square_name(e + east, n + north), F.lit(""))


def square_reached(gridsquare: Column, east: Column, north: Column, e_step: Column, n_step: Column) -> Column:
    """10 km square reached from one by steps of 10 km; null off the grid. Steps may be negative."""
    e, n = square_indexes(gridsquare)
    e, n = e * 10 + east + e_step, n * 10 + north + n_step
    digits = F.pmod(e, F.lit(10)) * 10 + F.pmod(n, F.lit(10))
    # Concatenation with a null name is null.
    return F.concat(square_name(F.floor(e / 10), F.floor(n / 10)), F.lpad(digits.cast("string"), 2, "0"))


def parse_dimensions(dims: Column, km: Column) -> tuple[Column, Column]:
    """``(east, north)`` counts of a ``WxH`` text; both 0 when malformed or beyond 2 000 km."""
    form = r"^([0-9]+)[xX]([0-9]+)\z"
    sides = [F.regexp_extract(dims, form, i).try_cast("decimal(38,0)") for i in (1, 2)]
    # A malformed text, or a number too long to be in range, gives a null here.
    good = (sides[0] * km <= LARGEST_KM) & (sides[1] * km <= LARGEST_KM)
    return tuple(F.when(good, s).otherwise(0).cast("bigint") for s in sides)


def map_requests(requests: DataFrame) -> DataFrame:
    """``(request_id, name, dims)`` to corner square and counts of 10 km squares.

    A bad name, or an east count of 0, makes ``valid`` false. A north count of 0 is accepted and
    covers nothing.
    """
    name, dims = F.col("name"), F.when(F.col("dims") == "", "1x1").otherwise(F.col("dims"))
    big = is_square(name)
    small = parse_small_square(name)
    ew, ns = parse_dimensions(dims, F.when(big, SQUARE_KM).otherwise(SMALL_KM))
    times = F.when(big, SQUARE_KM // SMALL_KM).otherwise(1)
    known = requests.select(
        "request_id", "name", "dims", F.when(big, F.upper(name)).otherwise(small[0]).alias("gridsquare"),
        F.when(big, 0).otherwise(small[1]).alias("east"), F.when(big, 0).otherwise(small[2]).alias("north"),
        (ew * times).alias("ew"), (ns * times).alias("ns"),
    )
    return known.withColumn("valid", F.col("gridsquare").isNotNull() & (F.col("ew") > 0))


def classify_places(places: DataFrame, areas: DataFrame) -> DataFrame:
    """P10: ``place`` strings to ``place_type`` and ``place_value``, both blank on an error.

    ``areas`` holds the known postcode areas, one row each; the optimiser broadcasts it if its size allows.
    """
    known = areas.select(F.col("Postcode_area").alias("_area"))
    named = places.withColumn("_text", strip(F.col("place"))).withColumn("_parts", F.split("_text", ":"))
    text, parts = F.col("_text"), F.col("_parts")
    joined = named.join(known, F.upper(text) == F.col("_area"), "left").select(
        *places.columns, "_text", F.size(parts).alias("_count"), F.length(text).alias("_length"), F.lower(text).alias("_lower"),
        F.lower(strip(F.get(parts, F.lit(0)))).alias("_kind"), strip(F.get(parts, F.lit(1))).alias("_value"),
        is_land_square(text).alias("_ng"), F.col("_area").isNotNull().alias("_pa"),
    )
    form = (
        F.when((F.col("_count") == 2) & F.col("_kind").isin(PLACE_TYPES), "typed")
        .when(F.col("_count") > 1, "")
        .when(F.col("_lower").isin("all", "random"), F.col("_lower"))
        .when(F.col("_length") == 1, "pa")
        .when((F.col("_length") == 2) & F.col("_ng") & ~F.col("_pa"), "ng")
        .when((F.col("_length") == 2) & ~F.col("_ng") & F.col("_pa"), "pa")
        .when(F.col("_length") >= 5, "pc")
        .otherwise("")
    )
    form_is = joined.withColumn("_form", form)
    form = F.col("_form")
    return form_is.select(
        *places.columns,
        F.when(form == "typed", F.col("_kind")).otherwise(form).alias("place_type"),
        F.when(form == "typed", F.col("_value")).when(form == "all", "GB").when(form == "random", "random")
        .when(form == "", "").otherwise(text).alias("place_value"),
    )


def place_exists(requests: DataFrame, table: DataFrame, areas: DataFrame) -> DataFrame:
    """F8: ``exists`` for each ``(place_type, place_value)``; squares must hold land.

    Postcodes are matched with one row per distinct wanted postcode, so neither a popular request nor
    the table is gathered by anything but the unique key.
    """
    value, kind = F.col("place_value"), F.col("place_type")
    by_code = requests.filter(kind == "pc").withColumn("_pc", normalise_postcode(value))
    wanted = by_code.groupBy("_pc").agg(F.count("*").alias("_n"))
    found = table.select(F.col("Postcode").alias("_found")).join(wanted.select(F.col("_pc").alias("_found")), "_found", "left_semi")
    answers = wanted.join(found, F.col("_pc") == F.col("_found"), "left").select("_pc", "_n", F.col("_found").isNotNull().alias("exists"))
    codes = join_unique(by_code, answers, ["_pc"], "_n").select(*requests.columns, "exists")

    known = areas.select(F.col("Postcode_area").alias("_area"))
    others = requests.filter(kind != "pc").join(known, F.upper(strip(value)) == F.col("_area"), "left")
    exists = (
        F.when(kind == "pa", F.col("_area").isNotNull())
        .when(kind == "ng", is_land_square(value))
        .otherwise(kind == "all")
    )
    return codes.unionByName(others.select(*requests.columns, exists.alias("exists")))


def resolve_random(requests: DataFrame, table: DataFrame, land: DataFrame, seed: int) -> DataFrame:
    """A concrete place for every request whose value is random, one draw per request row.

    ``requests`` is ``(request_id, place_type, place_value)``. A random type is drawn first; then a
    random row of the table gives a postcode or (weighted by rows) an area, or a random land square
    is taken. Rows are drawn by ``row_id`` 0..n-1, so a draw is a key lookup; an empty table gives none.
    """
    rid = F.col("request_id")
    kinds = F.array(*[F.lit(k) for k in PLACE_TYPES])
    typed = requests.withColumn(
        "place_type",
        F.when(F.col("place_type") == "random", F.get(kinds, (mix_hash(rid, seed) % len(PLACE_TYPES)).cast("int"))).otherwise(
            F.col("place_type")
        ),
    )
    rows = table.agg(F.count("*")).scalar()
    squares = land.agg(F.array_sort(F.collect_list("name"))).scalar()
    from_table = (F.lower("place_value") == "random") & F.col("place_type").isin("pa", "pc")
    drawn = typed.filter(from_table).withColumn("row_id", wide_hash(rid, seed + 1) % F.greatest(rows, F.lit(1)))
    rows_drawn = drawn.join(table.select("row_id", "Postcode", "Postcode_area"), "row_id").select(
        "request_id", "place_type",
        F.when(F.col("place_type") == "pa", F.col("Postcode_area")).otherwise(F.col("Postcode")).alias("place_value"),
    )
    square = F.get(squares, (mix_hash(rid, seed + 2) % F.size(squares)).cast("int"))
    drawn_square = (F.lower("place_value") == "random") & (F.col("place_type") == "ng")
    others = typed.filter(~from_table).select(
        "request_id", "place_type", F.when(drawn_square, square).otherwise(F.col("place_value")).alias("place_value")
    )
    return rows_drawn.unionByName(others)
