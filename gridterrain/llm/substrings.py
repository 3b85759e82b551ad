"""Operator 1: removal of repeated windows of words, found level by level with doubled lengths.

Level ``size / 2`` looks at windows chosen by their own content: of the windows inside each window of ``size``
words, the one of least hash (the leftmost of equals). Equal longer windows choose at equal places, so a
window of ``size`` words can only repeat if its chosen half does. Windows repeated there, and they alone, are
extended to ``size`` words, those repeated again to twice that, and so on until no candidates survive.
Removal needs the level of ``size`` words only: each word of an occurrence that is not the first goes.

A task hashes the words of a slice of documents and keeps one entry for each different window, the first;
the others are decided on the spot. So an entry's bucket gets at most one row's worth of it from each
slice, however often a window occurs. Entries travel packed by bucket, decisions packed by
groups of documents, where they meet the texts again. Windows are equal if two independent hashes agree, one of
64 bits and one of 32 and the bucket number; others agree in both with a chance below 2^-96 a pair. The order of occurrences is (id, hash of the text, place): rows of equal
id and text count as one document, a null id comes first. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridterrain.llm.words import hashed_words, inside, windows
from gridterrain.llm.workers import blob, small_slices as slices, sorted_groups, utf8

SIZE = 20
_ENTRIES = "bucket int, decided boolean, hashes binary, others binary, ids binary, marks binary, places binary, many binary"
_DECISIONS = "part int, ids binary, marks binary, places binary, later binary"
_ENTRY_SCHEMA = pa.schema([("bucket", pa.int32()), ("decided", pa.bool_()), ("hashes", pa.binary()), ("others", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()), ("places", pa.binary()), ("many", pa.binary())])
_DECISION_SCHEMA = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("places", pa.binary()), ("later", pa.binary())])
_FLUSH = 1 << 20


def _chosen(words: np.ndarray, firsts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``size`` words that lie in one text, and for each the place of its chosen half."""
    halves = windows(words, size // 2)
    n = max(0, len(words) - size + 1)
    starts = np.flatnonzero(inside(firsts, n, size)) if n else np.zeros(0, np.int64)
    if not len(starts):
        return starts, starts
    # A running minimum, as a view of all halves side by side would be copied whole.
    least, at = halves[:n].copy(), np.zeros(n, np.int32)
    for i in range(1, size - size // 2 + 1):
        lower = halves[i : i + n] < least
        np.copyto(least, halves[i : i + n], where=lower)
        at[lower] = i
    return starts, starts + at[starts]


def _part_of(ids: np.ndarray, marks: np.ndarray, parts: int) -> np.ndarray:
    """Group of each document; ``_part_column`` is the same."""
    return ((ids ^ marks) % parts).astype(np.int32)


def _part_column(parts: int):
    return F.pmod(F.col("_id").bitwiseXOR(F.col("_mark")), F.lit(parts)).cast("int")


def _entries(words: np.ndarray, firsts: np.ndarray, places: np.ndarray, length: int, ids: np.ndarray, marks: np.ndarray, buckets: int) -> list[dict]:
    """Packed entries of the windows of ``length`` words at ``places``; texts are in the order of (id, mark)."""
    if not len(places):
        return []
    hashes, other = windows(words, length)[places], windows(words, length, other=True)[places]
    text = np.searchsorted(firsts, places, "right") - 1
    within, k, m = (places - firsts[text]).astype(np.uint32), ids[text], marks[text]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (other[order][1:] != other[order][:-1])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    repeat = np.zeros(len(order), bool)
    repeat[order] = (k[order] != k[head]) | (m[order] != m[head]) | (within[order] != within[head])
    many = np.zeros(len(order), bool)
    many[head[repeat[order]]] = True
    heads = np.sort(order[new])
    tails = (other >> np.uint64(32)).astype(np.uint32)
    out = []

    def pack(rows: np.ndarray, bucket: np.ndarray, decided: bool) -> None:
        by = np.argsort(bucket[rows], kind="stable")
        rows, at = rows[by], bucket[rows][by]
        edges = np.flatnonzero(at[1:] != at[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
            r = rows[a:b]
            if len(r):
                out.append({"bucket": int(at[a]), "decided": decided, "hashes": b"" if decided else blob(hashes[r]), "others": b"" if decided else blob(tails[r]), "ids": blob(k[r]), "marks": blob(m[r]), "places": blob(within[r]), "many": b"" if decided else blob(many[r])})

    pack(heads, (other % np.uint64(buckets)).astype(np.int32), False)
    pack(np.flatnonzero(repeat), _part_of(k, m, buckets), True)
    return out


def _decide(buckets: int, parts: int, firsts_too: bool):
    """A function over entries sorted by bucket that gives the repeated windows, packed by groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            k, m, p, later = (np.concatenate(x) for x in zip(*held, strict=True))
            part = _part_of(k, m, parts)
            order = np.lexsort((p, m, k, part))
            k, m, p, later, part = k[order], m[order], p[order], later[order], part[order]
            edges = np.flatnonzero(part[1:] != part[:-1]) + 1
            rows = [{"part": int(part[a]), "ids": blob(k[a:b]), "marks": blob(m[a:b]), "places": blob(p[a:b]), "later": blob(later[a:b])} for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True)]
            return pa.RecordBatch.from_pylist(rows, schema=_DECISION_SCHEMA)

        for group in sorted_groups(batches, ["bucket"]):
            rows = group.to_pylist()
            read = lambda rows, name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
            sure = [r for r in rows if r["decided"]]
            if sure:
                k = read(sure, "ids", np.int64)
                held.append((k, read(sure, "marks", np.int64), read(sure, "places", np.uint32), np.ones(len(k), bool)))
                size += len(k)
            rows = [r for r in rows if not r["decided"]]
            hashes, others, k, m, p, many = read(rows, "hashes", np.uint64), read(rows, "others", np.uint32), read(rows, "ids", np.int64), read(rows, "marks", np.int64), read(rows, "places", np.uint32), read(rows, "many", bool)
            order = np.argsort(hashes, kind="stable")
            h = hashes[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group_of = np.cumsum(new) - 1
            alone = np.bincount(group_of, minlength=1)[group_of] == 1 if len(h) else np.zeros(0, bool)
            kept = order[~alone | many[order]]  # the few that need a full order
            order = kept[np.lexsort((p[kept], m[kept], k[kept], others[kept], hashes[kept]))]
            h, o, k, m, p, many = hashes[order], others[order], k[order], m[order], p[order], many[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            head, group_of = np.flatnonzero(new), np.cumsum(new) - 1
            first = head[group_of]
            later = (k != k[first]) | (m != m[first]) | (p != p[first])
            repeated = np.logical_or.reduceat(later | many, head)[group_of] if len(h) else later
            out = repeated if firsts_too else later
            if out.any():
                held.append((k[out], m[out], p[out], later[out]))
                size += int(out.sum())
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


class _Found:
    """Decisions for one group of documents, by document."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        read = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        k, m, p, later = read("ids", np.int64), read("marks", np.int64), read("places", np.uint32).astype(np.int64), read("later", bool)
        order = np.lexsort((p, m, k))
        k, m, self.places, self.later = k[order], m[order], p[order], later[order]
        edges = np.flatnonzero((k[1:] != k[:-1]) | (m[1:] != m[:-1])) + 1
        bounds = zip([0, *edges.tolist()], [*edges.tolist(), len(k)], strict=True)
        self.of = {(int(k[a]), int(m[a])): (a, b) for a, b in bounds if b > a}

    def get(self, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.of.get(key, (0, 0))
        return self.places[a:b], self.later[a:b]


def _ordered(table) -> tuple:
    """Texts in the order of (id, mark): the table, its ids and marks."""
    k, m = (np.asarray(table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy(), np.int64) for c in ("_id", "_mark"))
    order = np.lexsort((m, k))
    return table.take(pa.array(order)), k[order], m[order]


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about a slice of texts at a time, so that no more than that is put in order and copied."""
    for a, b in slices(utf8(batch.column(column))[1]):
        yield batch.slice(a, b - a)


def _sliced(table, column: str) -> Iterator[tuple]:
    """Slices of texts: first and last row, bytes, word hashes, word starts, word ends, each text's first word and bounds."""
    data, bounds = utf8(table.column(column))
    for a, b in slices(bounds):
        own, part = bounds[a : b + 1] - bounds[a], data[bounds[a] : bounds[b]]
        yield a, b, part, own, *hashed_words(part, own)


def _decided(entries: DataFrame, buckets: int, parts: int, firsts_too: bool) -> DataFrame:
    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_decide(buckets, parts, firsts_too), _DECISIONS)


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with an id that is not null and a hash of the text, which together name a document."""
    least = F.lit(-(2**63)).cast("long")
    return docs.withColumns({"_id": F.coalesce(F.col(key).cast("long"), least), "_mark": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})


def find_repeats(docs: DataFrame, key: str, text: str, size: int, longest: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Marked documents with their group ``part``, and the repeated windows of ``size`` words by group.

    With ``longest`` the third result has one more level for each doubling until no candidates survive;
    every level is written, as the next depends on whether it is empty.
    """
    from gridterrain.scratch import cut

    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = 2 * width, width + width // 2
    marked = _marked(docs, key, text)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in _pieces(batch, text)):
            piece, ids, marks = _ordered(piece)
            for a, b, _, _, words, _, _, firsts in _sliced(piece, text):
                places = np.unique(_chosen(words, firsts, size)[1])
                rows = _entries(words, firsts, places, size // 2, ids[a:b], marks[a:b], buckets)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY_SCHEMA)

    placed = marked.withColumn("part", _part_column(parts))

    def wholes(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids, marks = _ordered(texts)
        known, rows = _Found(found), []
        for a, b, _, _, words, _, _, firsts in _sliced(texts, text):
            good = np.zeros(len(words) + 1, bool)
            for i in range(a, b):
                good[known.get((int(ids[i]), int(marks[i])))[0] + firsts[i - a]] = True
            starts, chosen = _chosen(words, firsts, size)
            rows += _entries(words, firsts, starts[good[chosen]], size, ids[a:b], marks[a:b], buckets)
        return pa.Table.from_pylist(rows, schema=_ENTRY_SCHEMA)

    half = _decided(marked.select("_id", "_mark", F.col(f"`{text}`")).mapInArrow(halves, _ENTRIES), buckets, parts, True)
    entries = placed.groupBy("part").cogroup(half.groupBy("part")).applyInArrow(wholes, _ENTRIES)
    repeats = _decided(entries, buckets, parts, longest)
    levels = []
    length = size
    if longest:
        repeats = cut(repeats, "repeats")
        level = repeats
        while not level.isEmpty():
            levels.append(level)
            level = cut(_decided(placed.groupBy("part").cogroup(level.groupBy("part")).applyInArrow(_doubled(text, length, buckets), _ENTRIES), buckets, parts, True), "repeats")
            length *= 2
    return placed, repeats, levels


def _doubled(text: str, length: int, buckets: int):
    """Entries of the windows of twice ``length`` words both of whose halves are repeated."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids, marks = _ordered(texts)
        known, rows = _Found(found), []
        for a, b, _, _, words, _, _, firsts in _sliced(texts, text):
            good = np.zeros(len(words) + 2 * length, bool)
            for i in range(a, b):
                good[known.get((int(ids[i]), int(marks[i])))[0] + firsts[i - a]] = True
            n = max(0, len(words) - 2 * length + 1)
            places = np.flatnonzero(good[:n] & good[length : length + n] & inside(firsts, n, 2 * length)) if n else np.zeros(0, np.int64)
            rows += _entries(words, firsts, places, 2 * length, ids[a:b], marks[a:b], buckets)
        return pa.Table.from_pylist(rows, schema=_ENTRY_SCHEMA)

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the words of repeated windows, with ``n_words``, ``n_removed`` and ``removed``.

    A word goes if a window of ``size`` words covers it whose words also start earlier: in a document of smaller id
    or earlier in the same one. ``removed`` holds the removed runs as ``(start, end)`` word numbers of the input.
    The white space after a removed word goes with it; other texts stay as they are. Every row of the
    input gives one row; columns of the three new names are replaced.
    """
    added = ["n_words", "n_removed", "removed"]
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    names, numbers = kept, {c: f"c{i}" for i, c in enumerate(kept)}  # no name of the input can meet one of ours
    docs, kept, key, text = docs.toDF(*numbers.values()), list(numbers.values()), numbers[key], numbers[text]
    placed, repeats, _ = find_repeats(docs, key, text, size)
    span = "array<struct<start: bigint, end: bigint>>"
    empty = F.array().cast(span)
    schema = docs.withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "removed": empty}).schema
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(texts: pa.Table, found: pa.Table) -> pa.Table:
        texts, ids, marks = _ordered(texts)
        known = _Found(found)
        out, counts, gone, runs = texts.column(text).to_pylist(), [], [], []
        for a, b, data, bounds, _, starts, _, firsts in _sliced(texts, text):
            for i in range(a, b):
                n = int(firsts[i - a + 1] - firsts[i - a])
                places, later = known.get((int(ids[i]), int(marks[i])))
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, places[later], 1)
                np.add.at(edge, places[later] + size, -1)
                cover = np.concatenate([[0], (np.cumsum(edge)[:n] > 0).astype(np.int8), [0]])
                change = np.flatnonzero(np.diff(cover))
                cuts = change.reshape(-1, 2).tolist()
                counts.append(n)
                gone.append(sum(e - s for s, e in cuts))
                runs.append([{"start": s, "end": e} for s, e in cuts])
                if cuts:
                    at = np.append(starts[firsts[i - a] : firsts[i - a + 1]], bounds[i - a + 1])
                    edges = [int(bounds[i - a]), *at[change].tolist(), int(bounds[i - a + 1])]
                    out[i] = b"".join(data[s:e].tobytes() for s, e in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8")
        columns = [pa.array(out, pa.string()) if c == text else texts.column(c).combine_chunks() for c in kept]
        return pa.Table.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, spans)], names=[*kept, *added])

    return placed.groupBy("part").cogroup(repeats.groupBy("part")).applyInArrow(apply, schema).toDF(*names, *added)


def longest_repeats(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, length, windows)``: for each document with repeats the greatest of the lengths ``size``, ``2 size``, ...
    at which it still has repeated windows, and their number. Ids are integers; null ids appear as the least one."""
    _, _, levels = find_repeats(docs.select(key, text), key, text, size, longest=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n = np.unique(np.frombuffer(row["ids"], np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64())], names=["id", "windows"])

    spark = docs.sparkSession
    found = spark.createDataFrame([], "id long, windows long, length int")
    for i, level in enumerate(levels):
        found = found.unionByName(level.mapInArrow(count, "id long, windows long").withColumn("length", F.lit(size << i)))
    sums = found.groupBy("id", "length").agg(F.sum("windows").alias("windows"))
    return sums.groupBy("id").agg(F.max(F.struct("length", "windows")).alias("top")).select("id", "top.length", "top.windows")
