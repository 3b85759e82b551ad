"""Properties on random inputs, checked against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridterrain.operators import components, flat, rows, skew, spatial
from tests.test_goldens import grid


def frontier(values):
    """Seeds and growth cell by cell."""
    height, width = len(values), len(values[0])

    def near(r, c):
        return [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and 0 <= r + a < height and 0 <= c + b < width]

    def same(p, q):
        return abs(values[p[0]][p[1]] - values[q[0]][q[1]]) < 0.01

    cells = [(r, c) for r in range(height) for c in range(width)]
    mark = {p: int(values[p[0]][p[1]] == -1000 or sum(same(p, q) for q in near(*p)) >= 6) for p in cells}
    todo = [p for p in cells if mark[p] and values[p[0]][p[1]] != -1000]
    while todo:
        p = todo.pop()
        for q in near(*p):
            if not mark[q] and same(p, q):
                mark[q] = 2
                todo.append(q)
    return mark


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 5), (3, 64)])
def test_growth_equals_frontier(spark, seed, block):
    pick = random.Random(seed)
    values = [[pick.choice([1.0, 1.0, 1.006, 1.012, 2.0, -1000.0]) if pick.random() < 0.35 else 1.0 + c // 9 for c in range(23)] for _ in range(19)]
    ours = {(r.row, r.col): r.water for r in flat.grow_regions(grid(spark, values).repartition(3), block=block).collect()}
    assert ours == frontier(values)


def test_long_snake(spark):
    """A region much longer than a block, reached from one seed at its end."""
    side = 21
    values = [[5.0 if r % 4 == 0 or (c == (side - 1 if r % 8 < 4 else 0)) else 10.0 + (r * 31 + c * 17) % 7 for c in range(side)] for r in range(side)]
    for r in range(3):
        for c in range(3):
            values[r][c] = 5.0
    ours = {(r.row, r.col): r.water for r in flat.grow_regions(grid(spark, values), block=3).collect()}
    assert ours == frontier(values)


@pytest.mark.parametrize("slots", [2, 1000])
def test_components(spark, monkeypatch, slots):
    """A star that holds most edges, a long path and small groups; few slots force the split of hot nodes."""
    monkeypatch.setattr(skew, "HOT_SLOTS", slots)
    edges = [(500, n) for n in range(501, 560)] + [(n, n + 1) for n in range(100, 140)] + [(1, 3), (3, 2), (7, 9), (560, 100)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {n: 500 for n in range(501, 560)} | {n: 100 for n in range(101, 141)} | {560: 100, 2: 1, 3: 1, 9: 7}
    assert got == want


@pytest.mark.parametrize("slots", [2, 4, 1000])
def test_join_unique(spark, monkeypatch, slots):
    monkeypatch.setattr(skew, "HOT_SLOTS", slots)
    many = [(i, 0 if i % 3 else i % 20) for i in range(300)]
    df = spark.createDataFrame(many, "i int, k int")
    one = df.groupBy("k").count().selectExpr("k", "count as w", "k * 10 as v")
    got = sorted((r.i, r.k, r.v) for r in skew.join_unique(df, one, ["k"], "w").collect())
    assert got == sorted((i, k, k * 10) for i, k in many)


def test_row_numbers(spark):
    keys = random.Random(5).sample(range(10_000), 1_000)
    df = spark.createDataFrame([(k % 7, k) for k in keys], "g int, k int").repartition(6)
    got = {(r.g, r.k): r.row_id for r in rows.number_rows(df, "g", "k").collect()}
    assert got == {key: i for i, key in enumerate(sorted((k % 7, k) for k in keys))}


def test_around_counts_and_rows(spark):
    pick = random.Random(8)
    places = [(i, pick.choice([0, 5000, 10_000, pick.randrange(30_000)]), pick.choice([0, 4999, pick.randrange(30_000)])) for i in range(400)]
    points = spark.createDataFrame(places, "row_id int, Eastings int, Northings int")
    centres = points.selectExpr("row_id as centre_id", "Eastings", "Northings")
    got = {r.centre_id: r.points for r in spatial.around_counts(points, centres).collect()}

    def close(p, q):
        return abs(p[1] - q[1]) <= 5000 and abs(p[2] - q[2]) <= 5000

    assert got == {p[0]: sum(close(p, q) for q in places) for p in places}
    spots = Counter(p[1:] for p in places)
    pairs = {(r.centre_e, r.centre_n, r.centres, r.Eastings, r.Northings, r.points) for r in spatial.around_rows(points, centres).collect()}
    assert pairs == {(*p, spots[p], *q, spots[q]) for p in spots for q in spots if close((0, *p), (0, *q))}


def test_around_counts_of_a_crowded_cell(spark):
    """A hundred thousand places in one cell, boxes with edges and corners on every side of it, against sums of a grid."""
    side, base = 320, 10 * spatial.CELL + 300
    places = spark.range(side * side).selectExpr(
        f"cast({base} + id % {side} as int) as Eastings", f"cast({base} + id div {side} as int) as Northings", "id % 3 as n"
    )
    points = places.withColumn("again", F.explode(F.sequence(F.lit(0), F.col("n")))).select("Eastings", "Northings")
    weights = (np.arange(side * side) % 3 + 1).reshape(side, side)  # by northing, easting
    pick = random.Random(3)
    half = spatial.NEIGHBOURHOOD // 2
    steps = [-half - 1, -half, -half + 1, 0, half - 1, half, half + 1]
    spots = [(base + e, base + n) for e in steps for n in steps]
    spots += [(base + pick.randrange(-6000, 6000), base + pick.randrange(-6000, 6000)) for _ in range(300)]
    spots += [(base + side - 1 + e, base + side - 1 + n) for e in steps for n in steps]
    spots += spots[:5] + [(None, 7), (7, None), (0, 0)]
    centres = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "centre_id int, Eastings int, Northings int")
    got = {r[0]: tuple(r)[1:] for r in spatial.around_counts(points, centres).collect()}
    want = {}
    for i, (e, n) in enumerate(spots):
        if e is None or n is None:
            continue
        lo_e, hi_e = max(e - half, base), min(e + half, base + side - 1)
        lo_n, hi_n = max(n - half, base), min(n + half, base + side - 1)
        if lo_e > hi_e or lo_n > hi_n:
            want[i] = (0, None, None, None, None)
        else:
            total = int(weights[lo_n - base:hi_n - base + 1, lo_e - base:hi_e - base + 1].sum())
            want[i] = (total, lo_e, hi_e, lo_n, hi_n)
    assert got == want
    none = points.limit(0)
    assert {tuple(r)[1:] for r in spatial.around_counts(none, centres).collect()} == {(0, None, None, None, None)}
    assert spatial.around_counts(points, centres.limit(0)).count() == 0


def test_random_rows_are_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    first = [r.row_id for r in rows.random_rows(df, 10, 3).collect()]
    again = [r.row_id for r in rows.random_rows(df.repartition(7), 10, 3).collect()]
    other = [r.row_id for r in rows.random_rows(df, 10, 4).collect()]
    assert first == again and len(set(first)) == 10 and first != other
