"""Joining many rows to one row per key when a key may hold a large share of the many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.scratch import cut

# A key is hot when it holds more than one row in this many; fewer than this many keys can be.
HOT_SLOTS = 1_000


def join_unique(many: DataFrame, one: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``many`` with ``one``, unique on ``keys``; ``weight`` is its row count in ``many``.

    ``one`` is written first, as it is read several times. The weights add up to the row count, so
    fewer than ``HOT_SLOTS`` keys can exceed their share. Those are broadcast and their rows are never
    shuffled; no remaining key is large enough to load a task.
    """
    one = cut(one, "one")
    return join_written(many, one, keys, weight, *one.agg(*shares(weight)).first())


def shares(weight: str) -> list[Column]:
    """What ``join_written`` has to know of its unique side: keys, sum and maximum of the weights."""
    return [F.count("*"), F.sum(weight), F.max(weight)]


def join_written(many: DataFrame, one: DataFrame, keys: list[str], weight: str, size: int, total: int, top: int) -> DataFrame:
    """``join_unique`` with a table that is written already and whose ``shares`` are known."""
    w = F.col(weight)
    if size <= HOT_SLOTS:
        return many.join(F.broadcast(one), keys)
    if top * HOT_SLOTS <= total:
        return many.join(one, keys)
    hot = F.broadcast(one.filter(w * HOT_SLOTS > total))
    rest = many.join(hot.select(*keys), keys, "left_anti").join(one, keys)
    return many.join(hot, keys).unionByName(rest)
