"""Q11, Q12: terrain maps and terrain statistics, for any number of requests or tiles at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.functions.colour import NUMERIC, ramp_factors, scheme_or_default
from gridterrain.operators import altitudes, terrain
from gridterrain.operators.flat import BLOCK, grow_regions
from gridterrain.operators.place import map_requests
from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut
from gridterrain.sources.archives import tile_archive_texts
from gridterrain.sources.tiles import tile_cells, tile_headers

_BY = ["request_id"]


@dataclass
class TerrainMap:
    """Finished terrain requests: statuses per tile, mosaic cells, cells with their water mark, all by ``request_id``."""

    statuses: DataFrame
    cells: DataFrame
    marked: DataFrame
    scheme: str

    def pixels(self) -> DataFrame:
        """``(request_id, row, col, r, g, b)``; each request's own range of altitudes is stretched to the ramp."""
        rows, factors = self._stretched(self.marked)
        return terrain.terrain_pixels(rows, self.scheme, factors, _BY)

    def statistics(self) -> dict[str, DataFrame]:
        """Q12 on the filled mosaics, so filler counts as an altitude."""
        counts = cut(altitudes.altitude_counts(self.cells, *_BY), "counts")
        parts = statistics_of(counts, *_BY)
        bins, factors = self._stretched(parts["histogram"])
        coloured = altitudes.histogram_colours(bins, self.scheme, factors)
        return {**parts, "histogram": coloured.select(*parts["histogram"].columns, "hex")}

    def _stretched(self, rows: DataFrame) -> tuple[DataFrame, tuple[Column, Column] | None]:
        if self.scheme == NUMERIC:
            return rows, None
        ranges = terrain.altitude_ranges(self.cells).withColumnRenamed("cells", "_cells")
        return join_unique(rows, ranges, _BY, "_cells"), ramp_factors(self.scheme, F.col("lowest"), F.col("highest"))


def terrain_map(requests: DataFrame, tiles: DataFrame, scheme: str = "", block: int = BLOCK) -> TerrainMap:
    """Q11: requests ``(request_id, name, dims)`` over tiles ``(tile, files, text)``; requests that are not valid give nothing."""
    return assemble(_wanted(requests), tile_headers(tiles), scheme, block)


def terrain_map_from_archives(requests: DataFrame, archives: DataFrame, scheme: str = "", block: int = BLOCK) -> TerrainMap:
    """Q11 from request texts and listed tile archives (S13). Only archives of tiles that a request reaches are opened."""
    wanted = cut(_wanted(requests), "wanted")
    return assemble(wanted, tile_headers(tile_archive_texts(archives, wanted)), scheme, block)


def _wanted(requests: DataFrame) -> DataFrame:
    return terrain.requested_tiles(map_requests(requests).filter("valid"))


def assemble(wanted: DataFrame, headers: DataFrame, scheme: str = "", block: int = BLOCK) -> TerrainMap:
    """Q11 from wanted tiles ``(request_id, east, north, tile)`` and parsed headers.

    The lines of wanted tiles are checked and written once, as are the placed cells; later steps read them several times.
    """
    asked = wanted.filter("tile IS NOT NULL").select("tile").distinct()
    headers = cut(headers.join(asked, "tile", "left_semi"), "headers")
    statuses = cut(terrain.tile_statuses(wanted, headers), "statuses")
    cells = cut(terrain.mosaic(statuses, headers), "mosaic")
    marked = grow_regions(cells.select(*_BY, "row", "col", "alt"), block, _BY)
    return TerrainMap(statuses, cells, marked, scheme_or_default(scheme))


def statistics_of(counts: DataFrame, *by: str) -> dict[str, DataFrame]:
    """Q12: summary, commonest altitude, notable altitudes and histogram of counted altitudes, per group with ``by``."""
    return {
        "summary": altitudes.altitude_summary(counts, *by), "commonest": altitudes.commonest_altitude(counts, *by),
        "notable": altitudes.notable_altitudes(counts, *by), "histogram": altitudes.histogram(counts, *by),
    }


def terrain_statistics(
    cells: DataFrame, scheme: str, factors: tuple[Column, Column] | None = None, exclude_fill: bool = False, by: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """Q12 with a coloured histogram; of all cells, or of each group."""
    counts = cut(altitudes.altitude_counts(altitudes.without_filler(cells) if exclude_fill else cells, *by), "counts")
    parts = statistics_of(counts, *by)
    return {**parts, "histogram": altitudes.histogram_colours(parts["histogram"], scheme, factors)}


def tile_statistics(headers: DataFrame, scheme: str = "", exclude_fill: bool = False) -> dict[str, DataFrame]:
    """Q12 for every good tile at once, each with a histogram of its own width and edges."""
    return terrain_statistics(tile_cells(headers), scheme_or_default(scheme), None, exclude_fill, ("tile",))
