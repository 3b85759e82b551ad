"""DataFrame operators: quality checks, spatial joins, reports, rasters and terrain."""
