"""Altitude summary, frequencies and adaptive histogram of a cell table.

Everything starts from one row per distinct altitude, so the cells are shuffled once, pre-counted.
Filler cells count like any altitude unless they are filtered out first (``without_filler``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.colour import LAND_RAMPS, NUMERIC, hex_colour, land_colour, water_colour
from gridterrain.schemas import NO_ALTITUDE
from gridterrain.sources.dims import colour_schemes


def without_filler(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("alt") != NO_ALTITUDE)


def altitude_counts(cells: DataFrame, *by: str) -> DataFrame:
    """L2: cells per distinct altitude, and per group with ``by``."""
    return cells.groupBy(*by, "alt").agg(F.count("*").alias("cases"))


def altitude_summary(counts: DataFrame, *by: str) -> DataFrame:
    """Cells, distinct altitudes, minimum, maximum, range and mean (both also to one decimal)."""
    mean = F.sum(F.col("alt") * F.col("cases")) / F.sum("cases")
    span = F.max("alt") - F.min("alt")
    return counts.groupBy(*by).agg(
        F.sum("cases").alias("cells"), F.count("*").alias("unique_altitudes"), F.min("alt").alias("min_alt"),
        F.max("alt").alias("max_alt"), F.bround(span, 1).alias("alt_range"), F.bround(mean, 1).alias("mean_alt"),
        mean.alias("mean_exact"),
    )


def commonest_altitude(counts: DataFrame, *by: str) -> DataFrame:
    """The most frequent altitude, the smallest on a tie, with its count and share."""
    first = F.max_by(F.struct("alt", "cases"), F.struct(F.col("cases"), -F.col("alt"))).alias("_first")
    found = counts.groupBy(*by).agg(first, F.sum("cases").alias("_total")).filter("_first IS NOT NULL")
    return found.select(*by, "_first.alt", "_first.cases", F.bround(F.col("_first.cases") / F.col("_total") * 100, 3).alias("percent"))


def _beside(counts: DataFrame, totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts with the columns of their group's row in ``totals``; without groups that is one row, sent as constants."""
    if by:
        return counts.join(totals, [*by])
    row = totals.first()
    return counts.withColumns({name: F.lit(row[name]).cast(totals.schema[name].dataType) for name in totals.columns})


def notable_altitudes(counts: DataFrame, *by: str) -> DataFrame:
    """Altitudes below 1 m, or held by at least one per cent of the cells."""
    shared = _beside(counts, counts.groupBy(*by).agg(F.sum("cases").alias("_total")), by)
    return shared.filter((F.col("alt") < 1) | (F.col("cases") >= F.col("_total") / 100)).select(
        *by, "alt", "cases", F.bround(F.col("cases") * 100 / F.col("_total"), 2).alias("percent")
    )


def _width(highest: Column) -> Column:
    # Bin width by highest altitude.
    return F.when(highest < 100, 10).when(highest < 200, 20).when(highest < 300, 50).otherwise(100)


def histogram(counts: DataFrame, *by: str) -> DataFrame:
    """``(*by, bin, lower, upper, cases)``; bins are half-open and empty ones are kept.

    Edges run from 0 in steps of the width to more than two widths past the highest altitude; when
    the lowest is not above 0 it is an extra first edge. Width and edges are those of the group.
    """
    bounds = counts.groupBy(*by).agg(F.min("alt").alias("_lo"), F.max("alt").alias("_hi")).withColumn("_width", _width(F.col("_hi")))
    last = F.floor((F.col("_hi") + 2 * F.col("_width")) / F.col("_width"))
    zero_based = F.when(
        last >= 0, F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: (i * F.col("_width")).cast("double"))
    ).otherwise(F.array().cast("array<double>"))
    edges = F.when(F.col("_lo") <= 0, F.concat(F.array("_lo"), zero_based)).otherwise(zero_based)
    bins = (
        bounds.withColumn("_edges", edges)
        .withColumn("_spans", F.arrays_zip(F.slice("_edges", 1, F.greatest(F.size("_edges") - 1, F.lit(0))).alias("lower"),
                                           F.slice("_edges", 2, F.greatest(F.size("_edges") - 1, F.lit(0))).alias("upper")))
        .select(*by, F.posexplode("_spans").alias("bin", "_span"))
        .select(*by, "bin", F.col("_span.lower").alias("lower"), F.col("_span.upper").alias("upper"))
    )
    scaled = _beside(counts, bounds.select(*by, "_lo", "_width"), by)
    lower = F.when(F.col("alt") < 0, F.col("_lo")).otherwise(F.floor(F.col("alt") / F.col("_width")) * F.col("_width")).cast("double")
    filled = scaled.groupBy(*by, lower.alias("lower")).agg(F.sum("cases").alias("cases"))
    degenerate = F.col("lower") == F.col("upper")
    joined = bins.join(filled, [*by, "lower"], "left")
    return joined.select(
        *by, "bin", "lower", "upper",
        F.when(degenerate, 0).otherwise(F.coalesce("cases", F.lit(0))).cast("bigint").alias("cases"),
    )


def histogram_colours(bins: DataFrame, scheme: str, factors: tuple[Column, Column] | None = None) -> DataFrame:
    """Bar colour of each bin, from its lower edge."""
    edge = F.col("lower")
    land, water = land_colour(scheme, edge, factors), water_colour(scheme, edge)
    rgb = [F.when(edge >= 0, a).otherwise(b) for a, b in zip(land, water)]
    return bins.withColumn("hex", hex_colour(*rgb))


def scheme_colours(rows: DataFrame, scheme: str, alt: str) -> DataFrame:
    """Land ``r, g, b`` and ``water_r, water_g, water_b`` of rows that name their scheme in a column.

    An unknown name is the standard scheme, which ``scheme`` then shows. Each row meets its segment of
    the fixed table of schemes; the numeric scheme is a formula and its water is coloured like land.
    """
    table = colour_schemes(rows.sparkSession).withColumnRenamed("scheme", "_scheme")
    segments = F.broadcast(table.filter("altitude IS NOT NULL").select("_scheme", "altitude", "next_altitude", *[F.col(c).alias(f"_{c}") for c in ("r", "g", "b", "next_r", "next_g", "next_b")]))
    waters = F.broadcast(table.select(F.col("_scheme").alias("_water"), "water_r", "water_g", "water_b").distinct())
    known = rows.withColumn("scheme", F.when(F.col(scheme).isin([*LAND_RAMPS, NUMERIC]), F.col(scheme)).otherwise("standard"))
    a = F.col(alt)
    inside = (F.col("scheme") == F.col("_scheme")) & (a >= F.col("altitude")) & ((a < F.col("next_altitude")) | F.col("next_altitude").isNull())
    joined = known.join(segments, inside, "left").join(waters, F.col("scheme") == F.col("_water"))
    share = (a - F.col("altitude")) / (F.col("next_altitude") - F.col("altitude"))
    top = F.col("next_altitude").isNull() & (a == F.col("altitude"))
    numbers = land_colour(NUMERIC, a)

    def land(i: int, name: str) -> Column:
        ramp = F.when(F.col("next_altitude").isNotNull(), F.col(f"_{name}") - (F.col(f"_{name}") - F.col(f"_next_{name}")) * share).when(top, (255.0, 0.0, 0.0)[i])
        return F.when(F.col("scheme") == NUMERIC, numbers[i]).otherwise(F.coalesce(ramp, F.lit(0.0)).cast("int")).alias(name)

    lands = [land(i, name) for i, name in enumerate("rgb")]
    water = [F.when(F.col("scheme") == NUMERIC, n).otherwise(F.col(f"water_{c}")).alias(f"water_{c}") for n, c in zip(numbers, "rgb")]
    return joined.select(*rows.columns, *(["scheme"] if "scheme" not in rows.columns else []), *lands, *water)
