"""Operator 4: exact top-k inner products by three phases with a uniform threshold.

Vectors are split into slices of their components, and a slice of a block of rows is one node with a list of
partial scores for each query. A score is the sum of its partial scores, as in the classic setting of
the method, so its phases hold:

1. A node sends each query's greatest partial score. The nodes of a slice that a task holds send their best ``SENT``
   partial scores together (``k`` if that is more). The best ``PROBES`` of a query and slice are asked for in the other
   slices too; the k-th largest of these totals is safe.
2. In a block, a row falls short of the sum of the greatest partial scores by some amount in each slice. If its
   total is to reach the safe one, then in some slice it falls short by no more than an equal part of what
   may be missing in all. These cutoffs go to the nodes, which send every entry that reaches its cutoff.
3. The k-th largest complete total now bounds better what entries and cutoffs allow a row at most. Missing
   partial scores of the rows that are left are asked for, and the best ``k`` are taken.

Equal vectors form one class with its smallest ids, ``k`` and as many more as a query's id has vectors, as no other
member can be in a result, and equal queries are answered once. Blocks of queries are written once, by block and slice, to
the shared folder, which must be one that ``pyarrow.fs`` opens by URI; a node reads them one after the other, so no matrix is
copied for a pair of blocks. What nodes are told and send is packed by blocks: a message has the entries of a block of queries
in a block of rows, by their places in both. Phases 2 and 3 take ``WAVE`` blocks of queries at a time and drop their entries
before the next, so their disk grows with the rows and not with the pairs. Scores are integers and must fit in 64 bits; partial scores
beyond 2^53 are added as Python integers.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridterrain.llm.warc import _open
from gridterrain.llm.workers import sorted_groups, worker_cache
from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut, materialise, release, scratch_path

BLOCK_ROWS, QUERY_ROWS, SLICES, PROBES, SENT = 4096, 1024, 2, 64, 16
# Blocks of queries whose entries are kept at a time, as a share of all pairs does not fit the disk of a large table.
WAVE = 4
# Query matrices that a worker keeps between nodes, and entries that are worked out at a time.
CACHE_BYTES, _STEP = 32 << 20, 1 << 15
_NODE = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("matrix", pa.binary())])
# Entries of a block of queries and a block of rows: places in both and the sum of the partial scores of the slices in the bits of ``known``.
# Totals below their query's ``bar`` are not sent, where one is told.
_ENTRIES = pa.schema([("qb", pa.int32()), ("block", pa.int32()), ("known", pa.int32()), ("q", pa.binary()), ("pos", pa.binary()), ("value", pa.binary()), ("bar", pa.binary())])
_ENTRY_DDL = "qb int, block int, known int, q binary, pos binary, value binary, bar binary"
# Greatest partial scores by node (``block`` is set), or a task's best entries of a slice as matrices by query.
_LISTS = pa.schema([("qb", pa.int32()), ("slice", pa.int32()), ("block", pa.int32()), ("tops", pa.binary()), ("n", pa.int32()), ("at", pa.binary()), ("pos", pa.binary()), ("value", pa.binary())])
_LISTS_DDL = "qb int, slice int, block int, tops binary, n int, at binary, pos binary, value binary"
_NEVER = 2**63 - 1


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component; null if the vector, a component or its product is null or not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(scaled, lambda x: F.floor(x)))


def _narrow(values: np.ndarray) -> bytes:
    """Integers in the least of 2, 4 or 8 bytes that holds all, behind a byte with that number."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + np.ascontiguousarray(values, f"<i{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def _batch(schema: pa.Schema, *row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def _pack(rows: DataFrame, block_rows: int, slices: int, size: int) -> tuple[DataFrame, int]:
    """One row per block and slice: ``n`` vectors, their ``ids`` and the matrix as bytes; and the number of blocks."""
    blocks = max(1, -(-rows.count() // block_rows))
    bounds = [size * s // slices for s in range(slices + 1)]

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("v").combine_chunks()
        lengths, values = pc.list_value_length(vectors).to_numpy(), vectors.flatten()
        if values.null_count:
            raise ValueError("a vector has a null component")
        matrix = np.zeros((len(vectors), size), np.int64)
        within = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        matrix[np.repeat(np.arange(len(vectors)), lengths), within] = values.to_numpy()
        block, ids = table.column("block")[0].as_py(), table.column("id").to_pylist()
        out = []
        for s in range(slices):
            packed = _narrow(matrix[:, bounds[s] : bounds[s + 1]])
            out.append({"block": block, "slice": s, "n": len(ids), "ids": ids, "kind": f"<i{packed[0]}", "matrix": packed[1:]})
        return pa.Table.from_pylist(out, schema=_NODE)

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return dealt.groupBy("block").applyInArrow(pack, "block int, slice int, n int, ids array<long>, kind string, matrix binary"), blocks


def _matrix(node: dict) -> np.ndarray:
    return np.frombuffer(node["matrix"], node["kind"]).reshape(node["n"], -1)


def _asked(folder: str, block: int, slice_: int) -> np.ndarray | None:
    """The matrix of a block of queries in a slice, kept for the next nodes of this worker; None where no query fell into the block."""
    held: OrderedDict[str, np.ndarray | None] = worker_cache("topk_queries", OrderedDict)
    path = f"{folder}/block={block}/slice={slice_}"
    if path not in held:
        fs, root = _open(path)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet")]
        found = []
        for f in files:
            with fs.open_input_file(f) as source:
                found += pq.ParquetFile(source).read(["n", "kind", "matrix"]).to_pylist()
        held[path] = _matrix(found[0]) if found else None
        while len(held) > 1 and sum(m.nbytes for m in held.values() if m is not None) > CACHE_BYTES:
            held.popitem(last=False)
    held.move_to_end(path)
    return held[path]


def _exact(q: np.ndarray, r: np.ndarray):
    """The fastest kind of numbers in which products of the rows of both are exact."""
    top = lambda x: max(-int(x.min()), int(x.max())) if x.size else 0
    most = top(q) * top(r) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Partial scores, queries by rows; whole numbers, whatever their type."""
    kind = _exact(q, r)
    parts = q.astype(kind) @ r.astype(kind).T
    return parts.astype(np.int64) if kind is object else parts


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _top(parts: np.ndarray, kept: int, width: int = 64) -> np.ndarray:
    """Places of the ``kept`` greatest numbers of each row; they lie in the ``kept`` runs of greatest maxima."""
    n = parts.shape[1]
    if n <= kept:
        return np.broadcast_to(np.arange(n), parts.shape)
    whole = n // width * width
    if n // width <= 2 * kept:
        return np.argpartition(-parts, kept - 1, axis=1)[:, :kept]
    maxima = parts[:, :whole].reshape(len(parts), -1, width).max(axis=2)
    runs = np.argpartition(-maxima, kept - 1, axis=1)[:, :kept]
    places = (runs[:, :, None] * width + np.arange(width)).reshape(len(parts), -1)
    places = np.hstack([places, np.broadcast_to(np.arange(whole, n), (len(parts), n - whole))])
    best = np.argpartition(-np.take_along_axis(parts, places, 1), kept - 1, axis=1)[:, :kept]
    return np.take_along_axis(places, best, 1)


def _lists(folder: str, n_queries: int, sent: int):
    """Phase 1 over nodes: greatest partial scores of each, and the best of all of a task's nodes by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list[np.ndarray]] = {}
        for node in _rows_of(batches):
            rows, s = _matrix(node), node["slice"]
            for qb in range(n_queries):
                if (queries := _asked(folder, qb, s)) is None:
                    continue
                parts = _products(queries, rows)
                pos = _top(parts, sent)
                value = np.take_along_axis(parts, pos, 1).astype(np.int64)
                yield _batch(_LISTS, qb, s, node["block"], _narrow(value.max(axis=1)), None, None, None, None)
                new = [np.full(pos.shape, node["block"], np.int32), pos.astype(np.int32), value]
                if (qb, s) in best:
                    new = [np.hstack(x) for x in zip(best[qb, s], new, strict=True)]
                    place = _top(new[2], sent)
                    new = [np.take_along_axis(x, place, 1) for x in new]
                best[qb, s] = new
        for (qb, s), found in best.items():
            yield _batch(_LISTS, qb, s, None, None, len(found[0]), *map(_narrow, found))

    return run


def _merged(qb: int, block: int, messages: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Messages ``(known, q, pos, value)`` about one pair of blocks put together by entry: one for each set of known slices."""
    messages = list(messages)
    keys = [q << 32 | pos for _, q, pos, _ in messages]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    known, total, first = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), 0
    for bits, q, _, value in messages:
        here = at[first : first + len(q)]
        known[here] |= bits
        total[here] += value
        first += len(q)
    for bits in np.unique(known).tolist():
        of = known == bits
        yield _batch(_ENTRIES, qb, block, bits, _narrow(key[of] >> 32), _narrow(key[of] & 0xFFFFFFFF), _narrow(total[of]), None)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["qb", "block"]):
        rows = group.to_pylist()
        yield from _merged(rows[0]["qb"], rows[0]["block"], ((x["known"], _wide(x["q"]), _wide(x["pos"]), _wide(x["value"])) for x in rows))


def _probe(kept: int):
    """The best ``kept`` listed entries of each query and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["qb"]):
            lists, entries = group.to_pylist(), []
            for s in sorted({x["slice"] for x in lists}):
                at, pos, value = (np.hstack([_wide(x[c]).reshape(x["n"], -1) for x in lists if x["slice"] == s]) for c in ("at", "pos", "value"))
                place = _top(value, kept)
                at, pos, value = (np.take_along_axis(x, place, 1).ravel() for x in (at, pos, value))
                q, order = np.repeat(np.arange(len(place)), place.shape[1]), np.argsort(at, kind="stable")
                blocks, starts = np.unique(at[order], return_index=True)
                for block, some in zip(blocks.tolist(), np.split(order, starts[1:]), strict=True):
                    entries.append((block, (1 << s, q[some], pos[some], value[some])))
            for block in sorted({b for b, _ in entries}):
                yield from _merged(lists[0]["qb"], block, (x for b, x in entries if b == block))

    return run


def _by(messages: DataFrame, *keys: str) -> DataFrame:
    return messages.repartition(*keys).sortWithinPartitions(*keys)


def _at_nodes(packed: DataFrame, told: DataFrame, content: list[str], run) -> DataFrame:
    """``run`` over the nodes that get messages ``(block, slice, qb, ...)``, each with its own in ``told``."""
    messages = told.groupBy("block", "slice").agg(F.collect_list(F.struct("qb", *content)).alias("told"))
    return packed.drop("ids").join(messages, ["block", "slice"]).mapInArrow(run, _ENTRY_DDL)


def _reaching(folder: str):
    """Phase 2 at nodes: entries that reach their query's cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in _rows_of(batches):
            rows, s = _matrix(node), node["slice"]
            for message in node["told"]:
                queries = _asked(folder, message["qb"], s)
                cuts = _wide(message["cuts"]).reshape(-1, len(queries))[s]
                some = np.flatnonzero(cuts != _NEVER)
                if not len(some):
                    continue
                parts = _products(queries[some], rows)
                q, pos = np.nonzero(parts >= cuts[some].astype(parts.dtype)[:, None])
                if len(q):
                    yield _batch(_ENTRIES, message["qb"], node["block"], 1 << s, _narrow(some[q]), _narrow(pos), _narrow(parts[q, pos].astype(np.int64)), None)

    return run


def _adding(folder: str, everything: int):
    """Entries with a node's own partial score added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in _rows_of(batches):
            rows, s = _matrix(node), node["slice"]
            for message in node["told"]:
                queries = _asked(folder, message["qb"], s)
                q, pos, value = (_wide(message[c]) for c in ("q", "pos", "value"))
                kind = _exact(queries, rows)
                for a in range(0, len(q), _STEP):
                    of = slice(a, a + _STEP)
                    value[of] += (queries[q[of]].astype(kind) * rows[pos[of]].astype(kind)).sum(axis=1).astype(np.int64)
                known = message["known"] | 1 << s
                if message["bar"] is not None and known == everything:
                    of = value >= _wide(message["bar"])[q]
                    q, pos, value = q[of], pos[of], value[of]
                if len(q):
                    yield _batch(_ENTRIES, message["qb"], node["block"], known, _narrow(q), _narrow(pos), _narrow(value), message["bar"])

    return run


def _answered(entries: DataFrame, packed: DataFrame, folder: str, slices: int) -> DataFrame:
    """Incomplete entries with their missing partial scores, asked for at one slice after the other."""
    everything = (1 << slices) - 1
    first = F.coalesce(*[F.when(F.col("known").bitwiseAND(F.lit(1 << s)) == 0, F.lit(s)) for s in range(slices)])
    done = entries.filter("false")
    for step in range(1, slices):
        entries = _at_nodes(packed, entries.withColumn("slice", first), ["known", "q", "pos", "value", "bar"], _adding(folder, everything))
        if step < slices - 1:
            entries = cut(entries, "answered")
        done = done.unionByName(entries.filter(F.col("known") == everything))
        entries = entries.filter(F.col("known") != everything)
    return done


def _best_of(q: np.ndarray, value: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``kept`` greatest values of each query, and their ranks."""
    order = np.lexsort((-value, q))
    rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
    return order[rank < kept], rank[rank < kept]


def _bars(entries: DataFrame, kept: int) -> DataFrame:
    """``(qb, bar)``: the kept-th largest total of each query, in the order of their places; none is the least number."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            q, value = _wide(x["q"]), _wide(x["value"])
            best, _ = _best_of(q, value, kept)
            yield _batch(pa.schema([_ENTRIES.field(c) for c in ("qb", "q", "value")]), x["qb"], _narrow(q[best]), _narrow(value[best]))

    def bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["qb"]):
            q, value = (np.concatenate([_wide(x) for x in group.column(c).to_pylist()]) for c in ("q", "value"))
            best, rank = _best_of(q, value, kept)
            bar = np.full(int(q.max(initial=-1)) + 1, -_NEVER, np.int64)
            last = best[rank == kept - 1]
            bar[q[last]] = value[last]
            yield _batch(pa.schema([("qb", pa.int32()), ("bar", pa.binary())]), group.column("qb")[0].as_py(), _narrow(bar))

    return _by(entries.select("qb", "q", "value").mapInArrow(thin, "qb int, q binary, value binary"), "qb").mapInArrow(bars, "qb int, bar binary")


def _bar_of(row: dict, n: int) -> np.ndarray:
    """The best bar that is known for each of ``n`` queries."""
    out = np.full(n, -_NEVER, np.int64)
    for c in ("bar", "better"):
        if row.get(c) is not None:
            bar = _wide(row[c])[:n]
            out[: len(bar)] = np.maximum(out[: len(bar)], bar)
    return out


def _cutoffs(slices: int):
    """Cutoffs of every slice of a block, slice by slice; a query that no row of the block can serve has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            tops = np.stack([_wide(x[f"top{s}"]) for s in range(slices)])
            bar = _bar_of(x, tops.shape[1])
            spare = np.where(bar == -_NEVER, 0, tops.sum(axis=0) - bar)
            cuts = np.where(bar == -_NEVER, -_NEVER, np.where(spare < 0, _NEVER, tops - spare // slices))
            if (spare >= 0).any():
                yield _batch(pa.schema([("qb", pa.int32()), ("block", pa.int32()), ("cuts", pa.binary())]), x["qb"], x["block"], _narrow(cuts))

    return run


def _possible(slices: int):
    """Incomplete entries that may still reach the bar, as what is missing stayed below the cutoffs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows_of(batches):
            cuts = _wide(x["cuts"]).reshape(slices, -1)
            q, pos, value = (_wide(x[c]) for c in ("q", "pos", "value"))
            every = _bar_of(x, cuts.shape[1])
            bar = every[q]
            below = sum(cuts[s] - 1 for s in range(slices) if not x["known"] >> s & 1)[q]
            of = (bar == -_NEVER) | (value + below >= bar)
            if of.any():
                yield _batch(_ENTRIES, x["qb"], x["block"], x["known"], _narrow(q[of]), _narrow(pos[of]), _narrow(value[of]), _narrow(every))

    return run


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries that reach the bar as rows ``(qb, q, block, pos, score)``."""
    for x in _rows_of(batches):
        q, pos, value = (_wide(x[c]) for c in ("q", "pos", "value"))
        of = value >= _bar_of(x, int(q.max(initial=-1)) + 1)[q]
        n = int(of.sum())
        columns = [np.full(n, x["qb"], np.int32), q[of].astype(np.int32), np.full(n, x["block"], np.int32), pos[of].astype(np.int32), value[of]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["qb", "q", "block", "pos", "score"])


def _best(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def top_inner_products(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", slices: int = SLICES, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest integer inner product with each query, ties to smaller ids.

    ``vector`` holds integers (see ``quantised``); missing components of shorter vectors count as zero. Rows with a
    null id or vector take no part, and a query never finds its own id. Rows that repeat an id with other vectors all
    count, and the ``k`` best of all vectors of a query's id are its result; rows that repeat both are one. Queries
    without any other row, and empty tables, give no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("asks")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = cut(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")), "vectors")
    spark, result = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    size = rows.agg(F.max(F.size("v"))).first()[0]
    if not size and rows.isEmpty():
        return spark.createDataFrame([], result)
    # A query's own id is left out at the end, with every vector it has.
    kept = k + (rows.filter("asks").groupBy("id").count().agg(F.max("count")).first()[0] or 1)
    members = _best(rows.select("id", "v"), ["v"], [F.col("id")], kept)
    counts = rows.groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n_rows"), F.count_if("asks").alias("n_asks"))
    # Classes are numbered in the order of their least ids, which decides between equal scores.
    classes = members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("members")).join(counts, "v").orderBy("least", "v")
    classes = cut(classes.select(F.monotonically_increasing_id().alias("class"), "v", "members", "n_asks"), "classes")
    asking = classes.filter("n_asks > 0")
    if asking.isEmpty():
        return spark.createDataFrame([], result)
    slices = max(1, min(slices, size or 1))
    packed = cut(_pack(classes.select(F.col("class").alias("id"), "v"), block_rows, slices, size or 0)[0], "blocks")
    asked, n_queries = _pack(asking.select(F.col("class").alias("id"), "v"), query_rows, slices, size or 0)
    folder = scratch_path(spark, "queries")
    asked.write.partitionBy("block", "slice").parquet(folder)
    asked = spark.read.schema(asked.schema).parquet(folder)

    lists = cut(packed.drop("ids").mapInArrow(_lists(folder, n_queries, max(SENT, kept)), _LISTS_DDL), "phase1")
    probes = _by(lists.filter("block IS NULL").drop("block", "tops"), "qb").mapInArrow(_probe(max(PROBES, kept)), _ENTRY_DDL)
    whole = F.col("known") == (1 << slices) - 1
    probes = cut(probes, "probes")
    safe = cut(_bars(probes.filter(whole).unionByName(_answered(probes.filter(~whole), packed, folder, slices)), kept), "safe")

    tops = lists.filter("block IS NOT NULL").groupBy("qb", "block").agg(*[F.max(F.when(F.col("slice") == s, F.col("tops"))).alias(f"top{s}") for s in range(slices)])
    cuts = cut(tops.join(safe, "qb", "left").mapInArrow(_cutoffs(slices), "qb int, block int, cuts binary"), "cutoffs")
    scored = None
    for first in range(0, n_queries, WAVE):
        mine = F.col("qb").between(first, first + WAVE - 1)
        told = cuts.filter(mine).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        found, path = materialise(_by(_at_nodes(packed, told, ["cuts"], _reaching(folder)), "qb", "block").mapInArrow(_merge, _ENTRY_DDL), "phase2")
        bars = cut(safe.filter(mine).join(_bars(found.filter(whole), kept).withColumnRenamed("bar", "better"), "qb", "full"), "bars")
        left = found.drop("bar").filter(~whole).join(cuts.filter(mine).join(bars, "qb", "left"), ["qb", "block"]).mapInArrow(_possible(slices), _ENTRY_DDL)
        complete = found.drop("bar").filter(whole).join(bars, "qb", "left")
        reached = complete.unionByName(_answered(left, packed, folder, slices), allowMissingColumns=True)
        reached = cut(reached.mapInArrow(_reached, "qb int, q int, block int, pos int, score long"), "reached")
        release(spark, path)
        scored = reached if scored is None else scored.unionByName(reached)
        if first + WAVE < n_queries:
            # Spark's cleaner drops the shuffle files of a wave when its plans are collected.
            spark.sparkContext._jvm.System.gc()
    names = lambda nodes, block, place, name: nodes.filter("slice = 0").select(F.col("block").alias(block), F.posexplode("ids").alias(place, name))
    scored = scored.join(names(asked, "qb", "q", "query"), ["qb", "q"]).join(names(packed, "block", "pos", "row"), ["block", "pos"])

    best = _best(scored, ["query"], [F.col("score").desc(), F.col("row")], kept).join(classes.select(F.col("class").alias("row"), "members"), "row")
    hits = best.select("query", "score", F.explode("members").alias("id")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "id"))), 1, kept).alias("hits"))
    sizes = asking.select(F.col("class").alias("query"), "v", "n_asks")
    queries = rows.filter("asks").select(F.col("id").alias("query_id"), "v")
    answered = join_unique(queries, hits.join(sizes, "query").select("v", "hits", "n_asks"), ["v"], "n_asks")
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    ranked = answered.select("query_id", F.explode(others).alias("hit")).select("query_id", F.col("hit.id").alias("vec_id"), (-F.col("hit.below")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
