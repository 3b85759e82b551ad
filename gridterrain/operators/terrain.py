"""Tile requests, statuses, the mosaic and its colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.colour import land_colour, water_colour
from gridterrain.operators.place import square_reached
from gridterrain.operators.skew import join_unique
from gridterrain.schemas import NO_ALTITUDE
from gridterrain.sources.tiles import placed_cells


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))


def requested_tiles(requests: DataFrame) -> DataFrame:
    """Every 10 km square of the requests ``(request_id, gridsquare, east, north, ew, ns)``.

    Gives ``(request_id, east, north, tile)`` with offsets from the corner; the tile is null off the
    grid. A request spans at most 200 x 200 squares (P15).
    """
    spread = requests.withColumn("e_step", F.explode(_steps(F.col("ew")))).withColumn("n_step", F.explode(_steps(F.col("ns"))))
    return spread.select(
        "request_id", F.col("e_step").alias("east"), F.col("n_step").alias("north"),
        square_reached(F.col("gridsquare"), F.col("east"), F.col("north"), F.col("e_step"), F.col("n_step")).alias("tile"),
    )


def tile_statuses(wanted: DataFrame, headers: DataFrame) -> DataFrame:
    """``(request_id, east, north, tile, status, shape)`` of each wanted tile.

    ``headers`` has one row per tile with a file (S14), plus ``files``. The first parsed tile of a
    request in (east, north) order sets the shape the others must have. Tile text stays out of this,
    off-grid tiles stay out of the join, and no request is gathered in one task.
    """
    parsed = (F.col("files") == 1) & F.col("fault").isNull()
    light = headers.select(
        "tile", "files", "fault", F.when(parsed, F.struct("cellsize", "ncols", "nrows")).alias("_shape")
    )
    found = wanted.filter("tile IS NOT NULL").join(light, "tile", "left").select(*wanted.columns, "files", "fault", "_shape")
    joined = found.unionByName(wanted.filter("tile IS NULL"), allowMissingColumns=True)
    placed = F.struct("east", "north")
    shapes = joined.groupBy("request_id").agg(
        F.min_by(F.col("_shape"), F.when(F.col("_shape").isNotNull(), placed)).alias("shape"), F.count("*").alias("_tiles")
    )
    shaped = join_unique(joined, shapes, ["request_id"], "_tiles")
    status = (
        F.when(F.col("tile").isNull(), "offgrid")
        .when(F.col("files").isNull() | ((F.col("files") == 1) & F.col("fault").eqNullSafe("empty")), "sea")
        .when(F.col("_shape").isNull() | (F.col("_shape") != F.col("shape")), "error")
        .otherwise("ok")
    )
    return shaped.select("request_id", "east", "north", "tile", status.alias("status"), "shape")


def request_status(statuses: DataFrame) -> DataFrame:
    """Per request, tiles by status and the overall one: ok with any data, else sea or error."""
    counted = statuses.groupBy("request_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "sea", "offgrid", "error")],
        F.count("shape").alias("_parsed"),
    )
    overall = F.when(F.col("_parsed") > 0, "ok").when(F.col("error") == 0, "sea").otherwise("error")
    return counted.withColumn("status", overall).drop("_parsed")


def mosaic(statuses: DataFrame, headers: DataFrame) -> DataFrame:
    """``(request_id, row, col, alt, real)``: each request's tiles in a frame of its own, gaps filled.

    Requests that overlap share a tile's checked lines, not its cells. Each tile text meets its placement once, before it is spread into cells, and each gap makes its
    own fill, so cells are neither joined nor shuffled. A request without any data gives no cells.
    """
    shift = ["request_id", "east", "north", "shape"]
    placed = headers.select("tile", "_rows").join(statuses.filter("status = 'ok'").select("tile", *shift), "tile")
    data = placed_cells(placed, F.col("shape.nrows"), *shift).select(
        "request_id", (F.col("row") + F.col("north") * F.col("shape.nrows")).alias("row"),
        (F.col("col") + F.col("east") * F.col("shape.ncols")).alias("col"), "alt", F.lit(True).alias("real"),
    )
    gaps = statuses.filter("status <> 'ok' and shape is not null").select(*shift)
    fill = gaps.withColumn("r", F.explode(_steps(F.col("shape.nrows")))).withColumn("c", F.explode(_steps(F.col("shape.ncols"))))
    return data.unionByName(
        fill.select(
            "request_id", (F.col("r") + F.col("north") * F.col("shape.nrows")).alias("row"),
            (F.col("c") + F.col("east") * F.col("shape.ncols")).alias("col"), F.lit(NO_ALTITUDE).alias("alt"),
            F.lit(False).alias("real"),
        )
    )


def altitude_ranges(cells: DataFrame) -> DataFrame:
    """``(request_id, lowest, highest, cells)``: altitudes of the cells that come from tiles, and the number of all."""
    real = lambda c: F.when(F.col("real"), F.col(c))
    return cells.groupBy("request_id").agg(F.min(real("alt")).alias("lowest"), F.max(real("alt")).alias("highest"), F.count("*").alias("cells"))


def terrain_pixels(marked: DataFrame, scheme: str, factors: tuple[Column, Column] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, row, col, r, g, b)``: land by the ramp, marked cells as water."""
    alt, land = F.col("alt"), F.col("water") == 0
    both = zip(land_colour(scheme, alt, factors), water_colour(scheme, alt), "rgb")
    return marked.select(*by, "row", "col", *[F.when(land, a).otherwise(b).alias(n) for a, b, n in both])
