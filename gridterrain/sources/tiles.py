"""Terrain tile text to header row and cells, with validation, all in built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.text import strip
from gridterrain.schemas import TILE_HEADER

# A whole number, and a text with a token that is not a decimal number.
_WHOLE = r"^[+-]?[0-9]+$"
_NOT_DECIMAL = r"(?i)(?<!\S)(?![+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan)(?!\S))\S"

_HEAD = len(TILE_HEADER)


def _lines(text: Column) -> Column:
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.split(F.regexp_replace(unix, r"\n\z", ""), "\n")


def _tokens(line: Column) -> Column:
    return F.split(strip(line), r"\s+")


def _width(line: Column) -> Column:
    """Values on a line; a blank line has none."""
    return F.when(strip(line) == "", 0).otherwise(F.size(_tokens(line)))


def tile_headers(tiles: DataFrame) -> DataFrame:
    """Header values and first fault of each tile ``(tile, text)``; a good tile has a null fault.

    Everything is decided inside the tile's own row, so nothing is shuffled. A null text is fault
    ``unreadable``; an empty one is ``empty`` and counts as sea. Other columns are kept.
    """
    kept = [c for c in tiles.columns if c != "text"]
    headers = F.transform(F.slice("_lines", 1, _HEAD), _tokens)

    def value(name: str) -> Column:
        hit = F.filter("_head", lambda h: h[0] == name)
        return F.try_element_at(F.try_element_at(hit, F.lit(-1)), F.lit(2)).try_cast("bigint")

    split = tiles.withColumn("_lines", _lines(F.col("text"))).withColumn("_head", headers)
    bad_form = F.exists(F.slice("_lines", 1, _HEAD), lambda line: _width(line) != 2)
    bad_value = F.exists("_head", lambda h: ~h[1].rlike(_WHOLE) | h[1].try_cast("bigint").isNull())
    names = F.transform("_head", lambda h: h[0])
    lacking = reduce(lambda a, b: a | b, [~F.array_contains(names, n) for n in TILE_HEADER])
    shaped = (
        F.when(F.col("text").isNull(), "unreadable")
        .when(F.length("text") == 0, "empty")
        .when(F.size("_lines") < _HEAD, "too few lines")
        .when(bad_form, "header form")
        .when(bad_value, "header value")
        .when(lacking, "header field")
    )
    known = split.withColumn("_fault", shaped)
    sized = known.select(
        *kept, "_fault", F.slice("_lines", _HEAD + 1, F.greatest(F.size("_lines") - _HEAD, F.lit(0))).alias("_rows"),
        *[F.when(F.col("_fault").isNull(), value(n)).alias(n) for n in TILE_HEADER],
    )
    bad_width = F.exists("_rows", lambda line: _width(line) != F.col("ncols"))
    bad_number = F.array_join("_rows", "\n").rlike(_NOT_DECIMAL)
    fault = (
        F.when(F.col("_fault").isNotNull(), F.col("_fault"))
        .when(F.size("_rows") != F.col("nrows"), "row count")
        .when(bad_width, "row width")
        .when(bad_number, "number")
    )
    return sized.select(*kept, *TILE_HEADER, "_rows", fault.alias("fault"))


def tile_cells(headers: DataFrame, *keep: str) -> DataFrame:
    """Cells of the good tiles, row 0 at the south edge and column 0 at the west edge.

    A faulty tile gives no lines instead of being filtered out: a filter would be pushed into the
    scan and repeat the whole validation there.
    """
    good = F.when(F.col("fault").isNull(), F.col("_rows"))
    return _spread(headers, good, F.col("nrows"), *keep)


def placed_cells(tiles: DataFrame, nrows: Column, *keep: str) -> DataFrame:
    """Cells of tiles already known to be good."""
    return _spread(tiles, F.col("_rows"), nrows, *keep)


def _spread(tiles: DataFrame, lines: Column, nrows: Column, *keep: str) -> DataFrame:
    rows = tiles.select("tile", *keep, nrows.alias("_nrows"), F.posexplode_outer(lines).alias("_file_row", "_line"))
    cells = rows.select(
        "tile", *keep, (F.col("_nrows") - F.col("_file_row") - 1).alias("row"),
        F.posexplode(_tokens(F.col("_line"))).alias("_col", "_value"),
    )
    return cells.select(
        "tile", *keep, "row", F.col("_col").cast("bigint").alias("col"), F.col("_value").cast("double").alias("alt")
    )
