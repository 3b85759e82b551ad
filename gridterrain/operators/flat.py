"""3 x 3 stencils, flat seeds and region growing over a dense mosaic.

A mosaic is ``(row, col, alt)``, one row per cell; with ``by``, the names of its key columns, a table holds many mosaics
side by side, which never touch. A mosaic is cut into square blocks, so every group a
task sees has a fixed size however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridterrain.functions.numeric import same_altitude
from gridterrain.operators.components import connected_components
from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut
from gridterrain.schemas import NO_ALTITUDE

BLOCK = 128
SEED_NEIGHBOURS = 6

# Neighbours as (row step, column step); bit i of a link mask stands for entry i.
STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
# One of each pair of opposite steps: every link between two cells is seen once.
FORWARD = [i for i, step in enumerate(STEPS) if step > (0, 0)]


def _block(c: Column, block: int) -> Column:
    return F.floor(c / block)


def neighbours(cells: DataFrame, *values: str, block: int = BLOCK, by: Sequence[str] = ()) -> DataFrame:
    """Cells with an array ``near`` of their eight neighbours' ``values``, in the order of STEPS.

    Missing neighbours are null. Cells on a block's rim are also sent to the block across it (about
    three per cent more rows); one shuffle by block then serves both the row and the column window.
    """

    def blocks(c: str) -> Column:
        return F.sequence(_block(F.col(c) - 1, block), _block(F.col(c) + 1, block))

    spread = (
        cells.withColumn("br", F.explode(blocks("row")))
        .withColumn("bc", F.explode(blocks("col")))
        .repartition(*by, "br", "bc")
    )
    along = Window.partitionBy(*by, "br", "bc", "row").orderBy("col")
    across = Window.partitionBy(*by, "br", "bc", "col").orderBy("row")
    here = F.struct(*values)
    triple = F.struct(F.lag(here).over(along).alias("w"), here.alias("c"), F.lead(here).over(along).alias("e"))
    rows = spread.withColumn("_here", triple)
    near = rows.withColumn("_south", F.lag("_here").over(across)).withColumn("_north", F.lead("_here").over(across))
    own = near.filter((F.col("br") == _block(F.col("row"), block)) & (F.col("bc") == _block(F.col("col"), block)))
    return own.withColumn(
        "near",
        F.array("_south.w", "_south.c", "_south.e", "_here.w", "_here.e", "_north.w", "_north.c", "_north.e"),
    ).drop("_here", "_south", "_north")


def _near(i: int, value: str) -> Column:
    return F.get("near", F.lit(i))[value]


def _is_filler(alt: Column) -> Column:
    return alt == NO_ALTITUDE


def _seed() -> Column:
    same = [F.coalesce(same_altitude(F.col("alt"), _near(i, "alt")), F.lit(False)).cast("int") for i in range(len(STEPS))]
    flat = sum(same[1:], same[0]) >= SEED_NEIGHBOURS
    return F.when(_is_filler(F.col("alt")) | flat, 1).otherwise(0)


def flat_seeds(cells: DataFrame, block: int = BLOCK, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, row, col, alt, seed)``; 1 for filler cells and for cells equal to six or more neighbours."""
    return neighbours(cells, "alt", block=block, by=by).select(*by, "row", "col", "alt", _seed().alias("seed"))


def next_to_marked(cells: DataFrame, mask: str, block: int = BLOCK) -> DataFrame:
    """``(row, col, alt, next_to_marked)``: an equal neighbour has a mask above 0."""
    hit = F.lit(False)
    for i in range(len(STEPS)):
        hit = hit | F.coalesce(same_altitude(F.col("alt"), _near(i, "alt")) & (_near(i, mask) > 0), F.lit(False))
    return neighbours(cells, "alt", mask, block=block).select("row", "col", "alt", hit.alias("next_to_marked"))


def _links() -> Column:
    """Mask of the neighbours a region can grow to or from."""
    mask = F.lit(0)
    for i in range(len(STEPS)):
        other = _near(i, "alt")
        joined = same_altitude(F.col("alt"), other) & ~_is_filler(other) & ~_is_filler(F.col("alt"))
        mask = mask + F.when(joined, 1 << i).otherwise(0)
    return mask


def _label_block(cells: pd.DataFrame, by: Sequence[str]) -> pd.DataFrame:
    """Regions inside one block: hook the larger root to the smaller one, then shorten the paths."""
    r, c = (cells[n].to_numpy() - cells[n].min() + 1 for n in ("row", "col"))
    n, links = len(cells), cells["links"].to_numpy()
    index = np.full((r.max() + 2, c.max() + 2), -1)
    index[r, c] = np.arange(n)
    pairs, leaves = [], np.zeros(n, bool)
    for bit, (dr, dc) in enumerate(STEPS):
        linked = np.flatnonzero(links >> bit & 1)
        other = index[r[linked] + dr, c[linked] + dc]
        leaves[linked[other < 0]] = True
        pairs.append(np.stack([linked, other])[:, other >= 0])
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(n)
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    seeded, open_ = np.zeros(n, bool), np.zeros(n, bool)
    np.logical_or.at(seeded, root, cells["seed"].to_numpy() == 1)
    np.logical_or.at(open_, root, leaves)
    name = cells["row"].to_numpy() * 2**31 + cells["col"].to_numpy()
    region = pd.Series(name[root], dtype="Int64").mask(~open_[root])
    out = cells[[*by, "row", "col", "alt", "seed", "links"]].reset_index(drop=True)
    return out.assign(region=region, grown=seeded[root] & (links != 0))


def _crossing(labelled: DataFrame, block: int, by: Sequence[str]) -> DataFrame:
    """Pairs of regions in different blocks that touch: links that leave a block, joined cell by cell."""
    edge = [F.pmod(F.col(c), F.lit(block)).isin(0, block - 1) for c in ("row", "col")]
    rim = labelled.filter(F.col("region").isNotNull() & (edge[0] | edge[1]))
    steps = F.array(
        *[
            F.when(F.col("links").bitwiseAND(1 << i) != 0, F.struct((F.col("row") + STEPS[i][0]).alias("nr"), (F.col("col") + STEPS[i][1]).alias("nc")))
            for i in FORWARD
        ]
    )
    out = (
        rim.select(*by, "row", "col", F.col("region").alias("a"), F.explode(steps).alias("to"))
        .filter(
            F.col("to").isNotNull()
            & ((_block(F.col("to.nr"), block) != _block(F.col("row"), block)) | (_block(F.col("to.nc"), block) != _block(F.col("col"), block)))
        )
        .select(*by, "a", F.col("to.nr").alias("row"), F.col("to.nc").alias("col"))
    )
    target = rim.select(*by, "row", "col", F.col("region").alias("b"))
    return out.join(target, [*by, "row", "col"]).select("a", "b").distinct()


def grow_regions(cells: DataFrame, block: int = BLOCK, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, row, col, alt, water)``: 1 filler or seed, 2 reached from a real seed, 0 land.

    Growth is reachability over links between equal neighbours, so a cell is reached when its region
    holds a seed. Regions are labelled inside each block; only regions that leave their block enter
    the region graph, whose components are found across blocks, for all mosaics at once: a region's name holds the key of its
    mosaic. Cells of regions that hold a seed of
    their own, or that stay inside a block, are settled in place; only the rest is joined back. Keys are not null.
    """
    stencil = neighbours(cells, "alt", block=block, by=by).select(
        *by, "br", "bc", "row", "col", "alt", _seed().alias("seed"), _links().alias("links")
    )
    schema = T.StructType([f for f in stencil.schema if f.name not in ("br", "bc")]).add("region", T.LongType()).add("grown", T.BooleanType())
    labelled = cut(stencil.groupBy(*by, "br", "bc").applyInPandas(lambda _, cells: _label_block(cells, by), schema), "regions")
    if by:
        labelled = labelled.withColumn("region", F.when(F.col("region").isNotNull(), F.struct(*by, "region")))
    regions = labelled.filter(F.col("region").isNotNull()).groupBy("region").agg(F.max("grown").alias("grown"))
    roots = connected_components(_crossing(labelled, block, by))
    member = regions.join(roots, regions["region"] == roots["node"], "left").select(
        "region", "grown", F.coalesce("root", "region").alias("root")
    )
    seeded = member.groupBy("root").agg(F.max("grown").alias("reached"), F.count("*").alias("regions"))
    reached = join_unique(member, seeded, ["root"], "regions").filter("reached and not grown").select("region", F.lit(True).alias("reached"))

    pending = F.col("region").isNotNull() & ~F.col("grown")
    water = F.when(F.col("seed") == 1, 1).when(F.col("reached"), 2).otherwise(0)
    settled = labelled.filter(~pending).withColumn("reached", F.col("grown"))
    joined = labelled.filter(pending).join(reached, "region", "left")
    columns = [*by, "row", "col", "alt", water.alias("water")]
    return settled.select(*columns).unionByName(joined.select(*columns))


def water_counts(marked: DataFrame) -> DataFrame:
    """Seeds (filler included) and all marked cells."""
    return marked.agg(
        F.count_if(F.col("water") == 1).alias("seeds"), F.count_if(F.col("water") > 0).alias("total")
    )
