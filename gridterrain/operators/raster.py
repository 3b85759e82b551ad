"""Area colours, point rasters, key highlight and the hit index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.colour import SOFT_PALETTE, WHITE, pack, packed_palette, unpack
from gridterrain.operators.rows import number_rows
from gridterrain.operators.spatial import Canvas, area_column, area_extents

# Radius of the highlight disc; a point covers 3 x 3 pixels.
DISC_RADIUS = 30
BLOCK = 3


def area_colours(df: DataFrame, kind: str = "pa") -> DataFrame:
    """``(area, colour_group)``, groups dealt out by ascending west edge.

    A kind can have as many values as rows, so all are numbered in parallel.
    """
    extents = area_extents(df, area_column(kind)).select("area", "Min_E")
    ranked = number_rows(extents, "Min_E", "area", name="rank")
    return ranked.select("area", (F.col("rank") % len(SOFT_PALETTE)).cast("int").alias("colour_group"))


def with_colours(df: DataFrame, colours: DataFrame, kind: str = "pa") -> DataFrame:
    """Packed colour of each row's area, grey when it has none.

    The join is left to the optimiser, which broadcasts colours below its size threshold and else splits hot keys.
    """
    named = colours.withColumnRenamed("area", "_area")
    joined = df.join(named, df[f"`{area_column(kind)}`"] == named["_area"], "left")
    return joined.withColumn("rgb", packed_palette(F.col("colour_group"))).drop("_area", "colour_group")


def _last_per_anchor(points: DataFrame, *values: str) -> DataFrame:
    """Last row per scaled position. Only whole numbers are carried, so this stays a hash aggregate."""
    return points.groupBy("e_scaled", "n_scaled").agg(
        F.max("row_id").alias("row_id"), *[F.max_by(v, "row_id").alias(v) for v in values]
    )


def _offsets(low: int) -> Column:
    return F.array(*[F.lit(v) for v in range(low, low + BLOCK)])


def point_raster(points: DataFrame, canvas: Canvas) -> DataFrame:
    """``(x, y, rgb, row_id)`` of the pixels covered by points, the last row winning.

    ``points`` has ``e_scaled, n_scaled, row_id, rgb``. Rows at the same position cover the same
    block, so they are reduced to their last one before the blocks are spread out; at most one row
    per canvas position is ever exploded.
    """
    anchors = _last_per_anchor(points, "rgb")
    spread = (
        anchors.withColumn("_dx", F.explode(_offsets(0)))
        .withColumn("_dy", F.explode(_offsets(0)))
        .select(
            (F.col("e_scaled") + F.col("_dx")).alias("x"),
            (F.lit(canvas.height) - F.col("n_scaled") + F.col("_dy")).alias("y"), "row_id", "rgb",
        )
    )
    on_canvas = spread.filter((F.col("x") < canvas.width) & (F.col("y") < canvas.height))
    return on_canvas.groupBy("x", "y").agg(F.max_by("rgb", "row_id").alias("rgb"), F.max("row_id").alias("row_id"))


def pixels(raster: DataFrame) -> DataFrame:
    """Pixel table ``(x, y, r, g, b)``; pixels without a row are white."""
    return raster.select("x", "y", *unpack(F.col("rgb")))


def hit_index(points: DataFrame, canvas: Canvas) -> DataFrame:
    """``(x, ns, row_id)``: every position within one step of a point names its last row."""
    anchors = _last_per_anchor(points.select("e_scaled", "n_scaled", "row_id"))
    spread = (
        anchors.withColumn("_dx", F.explode(_offsets(-1)))
        .withColumn("_dy", F.explode(_offsets(-1)))
        .select((F.col("e_scaled") + F.col("_dx")).alias("x"), (F.col("n_scaled") + F.col("_dy")).alias("ns"), "row_id")
    )
    inside = spread.filter(F.col("x").between(F.lit(0), canvas.width + 1) & F.col("ns").between(0, canvas.height + 1))
    return inside.groupBy("x", "ns").agg(F.max("row_id").alias("row_id"))


def hits(index: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of the table under each indexed pixel. One row per pixel, so one side is canvas-sized."""
    return index.join(table, "row_id")


def highlight(raster: DataFrame, key: DataFrame, canvas: Canvas) -> DataFrame:
    """R2: raster with a half-transparent disc in the area's colour around the key row.

    ``key`` is the key postcode's scaled row, or empty when it fell off the canvas.
    """
    span = F.sequence(F.lit(-DISC_RADIUS), F.lit(DISC_RADIUS))
    disc = (
        key.select("e_scaled", "n_scaled", F.col("rgb").alias("disc_rgb"), F.explode(span).alias("_dx"))
        .withColumn("_dy", F.explode(span))
        .filter(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") <= DISC_RADIUS * DISC_RADIUS)
        .select(
            (F.col("e_scaled") + F.col("_dx")).alias("x"),
            (F.lit(canvas.height) - F.col("n_scaled") + F.col("_dy")).alias("y"), "disc_rgb",
        )
        .filter((F.col("x") >= 0) & (F.col("x") < canvas.width) & F.col("y").between(0, canvas.height - 1))
    )
    both = raster.select("x", "y", "rgb").join(disc, ["x", "y"], "full")
    under = F.coalesce("rgb", F.lit(pack(WHITE)))

    def blended(shift: int) -> Column:
        parts = [F.shiftright(c, shift).bitwiseAND(255) for c in (under, F.col("disc_rgb"))]
        return F.bround((parts[0] + parts[1]) / 2).cast("int")

    mixed = F.shiftleft(blended(16), 16) + F.shiftleft(blended(8), 8) + blended(0)
    return both.select("x", "y", F.when(F.col("disc_rgb").isNull(), F.col("rgb")).otherwise(mixed).alias("rgb"))
