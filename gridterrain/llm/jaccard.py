"""Operator 3: join of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Chosen paths: a set is embedded as ``HASHES`` min-hash values, one token for each coordinate. At a node of the
recursion a few coordinates are sampled, ``1 / threshold`` on average, and the node's sets are split by their
tokens there. The samples depend on the node's path alone, so each row finds its paths by itself and only
counts are shuffled. Buckets of up to ``BUCKET`` sets are compared by brute force. Larger ones are compared with
one of their sets, the pivot; what is close to the pivot is tied to it and the others split further, until
none is left. Runs with other samples are repeated until the chance to miss a pair is below ``1 - recall``.

These comparisons use short sketches and a lower bar, and only tie sets into candidate groups; close copies
that would fill every bucket are thus neither split for ever nor emitted as pairs. All pairs within a
group are then compared exactly, on whole shingle sets, in blocks of bounded size; counts, not pairs,
leave a block. Equal sets are one set with a weight from the start.

Texts with fewer words than an n-gram are one n-gram; texts without words and null texts have none and are linked
to nothing. A null id is replaced by the greatest integer inside and comes back as null. Ids may repeat and may be
null: inside, a set goes by a number of its own, and a text by its id and hash. Ids only name the classes at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridterrain.llm.words import hashed_words, mix, shingles
from gridterrain.llm.workers import blob, small_slices as slices, sorted_groups, utf8
from gridterrain.operators.components import connected_components
from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.999
HASHES, BUCKET, DEPTH = 128, 1024, 3
# Estimated similarity from which sets are tied in a small bucket and to a pivot, and from which a set needs no other
# pivot: distances obey the triangle inequality, so what is similar to such a set is itself near enough to be tied.
TIE, PIVOT_TIE, PIVOT_ENOUGH = 0.62, 0.44, 0.74
BLOCK_SETS, BLOCK_SHINGLES = 1024, 400_000
_NO_ID = 2**63 - 1
_FACTORS = np.random.default_rng(71).integers(0, 2**63, HASHES, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_DENSE = 32


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold that is split ``depth`` times has met with probability ``recall``.

    Each split keeps a pair by one Poisson number of common tokens with mean 1, a critical branching process.
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _samples(paths: np.ndarray, threshold: float) -> np.ndarray:
    """Which coordinates each path splits by: a matrix of paths by coordinates."""
    drawn = mix(paths[:, None] + (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
    return drawn < np.uint64(int(2**64 / (threshold * HASHES)))


def _children(paths: np.ndarray, signatures: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths one split further: the index of the row and the new path."""
    rows, at = np.nonzero(_samples(paths, threshold))
    return rows, mix(mix(paths[rows] ^ (at.astype(np.uint64) << np.uint64(48))) + signatures[rows, at].astype(np.uint64))


def _root_splits(runs: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    run, at = np.nonzero(_samples(roots, threshold))
    return roots[run], at


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """The 64-bit min-hash of each coordinate. Sets keep 16 bits of it; only the first split, of all sets, needs more."""
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for start in range(0, len(grams), 4096):
        np.minimum(least, (_FACTORS[:, None] * grams[None, start : start + 4096]).min(axis=1), out=least)
    return mix(least)


def _sketch(signatures: np.ndarray) -> np.ndarray:
    low = (signatures & 15).astype(np.uint8)
    return low[..., ::2] << 4 | low[..., 1::2]


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches from the share of equal four-bit values."""
    apart = a ^ b
    equal = ((apart & 15) == 0).sum(axis=-1) + ((apart >> 4) == 0).sum(axis=-1)
    return (equal / HASHES - 1 / 16) / (15 / 16)


def _signatures(docs: DataFrame, words: int, runs: int, threshold: float) -> DataFrame:
    """``(id, mark, n, f1, f2, sig, paths)`` of each text with words; ``f1, f2`` fingerprint its set of n-grams."""
    roots, at = _root_splits(runs, threshold)
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "mark"))
            data, bounds = utf8(batch.column("text"))
            for a, b in slices(bounds):
                own = bounds[a : b + 1] - bounds[a]
                hashes, _, _, firsts = hashed_words(data[bounds[a] : bounds[b]], own)
                out = []
                for i in range(a, b):
                    grams = shingles(hashes[firsts[i - a] : firsts[i - a + 1]], words)
                    if not len(grams):
                        continue
                    least = min_hashes(grams)
                    paths = mix(mix(roots ^ (at.astype(np.uint64) << np.uint64(48))) + least[at])
                    f1, f2 = (int(f) for f in _fingerprint(grams))
                    out.append({"id": int(ids[i]), "mark": int(marks[i]), "n": len(grams), "f1": f1, "f2": f2, "sig": blob((least >> np.uint64(48)).astype(np.uint16)), "paths": np.unique(paths.view(np.int64))})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.mapInArrow(run, "id long, mark long, n int, f1 long, f2 long, sig binary, paths array<long>")


def _fingerprint(grams: np.ndarray) -> np.ndarray:
    return np.array([mix(grams).sum(dtype=np.uint64), mix(grams ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)], np.uint64).view(np.int64)


def _labels(close: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric matrix: the least index in it."""
    label = np.arange(len(close))
    while True:
        low = np.minimum(label, np.where(close, label[None, :], len(close)).min(axis=1, initial=len(close)))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _tie_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force in buckets sorted by path: each set is tied to the least set of its component in the bucket."""
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for group in _whole_buckets(batches):
        path, rep = group.column("path").to_numpy(), group.column("rep").to_numpy()
        sketches = _sketch(np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(rep), HASHES))
        edges = np.flatnonzero(path[1:] != path[:-1]) + 1
        starts, stops = np.r_[0, edges], np.r_[edges, len(path)]
        size = stops - starts
        pairs = []
        for shift in range(1, 4):  # buckets of up to four sets, all at once
            rows = np.flatnonzero(np.repeat(size <= 4, size)[:-shift] & (path[shift:] == path[:-shift])) if len(path) > shift else np.zeros(0, np.int64)
            rows = rows[_likeness(sketches[rows], sketches[rows + shift]) >= TIE]
            pairs.append(np.stack([rep[rows], rep[rows + shift]]))
        for a, b in zip(starts[size > 4].tolist(), stops[size > 4].tolist(), strict=True):
            part = sketches[a:b]
            close = np.stack([_likeness(part, one[None, :]) >= TIE for one in part])
            label = _labels(close | close.T)
            tied = np.flatnonzero(label != np.arange(b - a))
            pairs.append(np.stack([rep[a:b][tied], rep[a:b][label[tied]]]))
        found = np.unique(np.concatenate(pairs, axis=1), axis=1)
        if found.size:
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=links)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches put together so that no bucket is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("path").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(path, path[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _tie_pivot(threshold: float):
    """Members of large buckets: a tie to the pivot where close, and paths one split further where that is not enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, pivot, path = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "pivot", "path"))
            sig, of_pivot = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(rep), HASHES) for c in ("sig", "pivot_sig"))
            like = _likeness(_sketch(sig), _sketch(of_pivot))
            tied = np.flatnonzero((like >= PIVOT_TIE) & (rep != pivot))
            left = np.flatnonzero((like < PIVOT_ENOUGH) & (rep != pivot))
            rows, paths = _children(path[left].astype(np.int64).view(np.uint64), sig[left], threshold)
            none = pa.nulls(len(tied), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(rep[tied]), pa.array(pivot[tied])], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(rep[left][rows]), pa.nulls(len(rows), pa.int64())], schema=schema)

    return run


def _candidate_ties(sets: DataFrame, threshold: float) -> DataFrame:
    """Ties ``(a, b)`` of sets that may be similar, whose components hold every similar pair found by the paths."""
    signed = sets.select("rep", "sig")
    rows = sets.select("rep", F.explode("paths").alias("path"))
    live, ties = [], []
    while True:
        counts = rows.groupBy("path").agg(F.count("*").alias("n_sets"), F.min("rep").alias("pivot")).filter("n_sets > 1")
        counts = cut(counts, "buckets")
        live.append(join_unique(rows, counts.filter(F.col("n_sets") <= BUCKET).select("path", "n_sets"), ["path"], "n_sets").select("path", "rep"))
        hot = counts.filter(F.col("n_sets") > BUCKET)
        if hot.isEmpty():
            break
        pivots = hot.join(signed.select(F.col("rep").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
        large = join_unique(rows, pivots, ["path"], "n_sets").join(signed, "rep")
        step = cut(large.select("path", "rep", "sig", "pivot", "pivot_sig").mapInArrow(_tie_pivot(threshold), "path long, a long, b long"), "paths")
        ties.append(step.filter("path IS NULL").select("a", "b"))
        # A set's new paths differ, as paths name all their splits.
        rows = step.filter("path IS NOT NULL").select(F.col("a").alias("rep"), "path")
    # Buckets of all levels meet their sets in one pass.
    small = reduce(DataFrame.unionByName, live).join(signed, "rep").select("path", "rep", "sig").repartition("path").sortWithinPartitions("path", "rep")
    return reduce(DataFrame.unionByName, ties, small.mapInArrow(_tie_small, "a long, b long"))


def _common(grams: np.ndarray, owner: np.ndarray, n: int, split: int | None) -> np.ndarray:
    """Sizes of intersections of ``n`` sets with each other, or of the sets before ``split`` with those from it on."""
    left, right = (slice(0, n), slice(0, n)) if split is None else (slice(0, split), slice(split, n))
    out = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.r_[True, grams[1:] != grams[:-1]] if len(grams) else np.zeros(0, bool)
    token = np.cumsum(new) - 1
    often = np.bincount(token, minlength=1)
    flat = np.zeros(out.size, np.float64)
    few = often[token] <= _DENSE if len(token) else np.zeros(0, bool)
    rare_token, rare_owner = token[few], owner[few]
    for shift in range(1, min(_DENSE, int(often.max(initial=0)))):
        same = np.flatnonzero(rare_token[shift:] == rare_token[:-shift]) if len(rare_token) > shift else np.zeros(0, np.int64)
        if not len(same):
            break
        a, b = rare_owner[same], rare_owner[same + shift]
        if split is None:
            flat += np.bincount(np.r_[a * n + b, b * n + a], minlength=out.size)
        else:
            a, b = np.minimum(a, b), np.maximum(a, b)
            across = (a < split) & (b >= split)
            flat += np.bincount(a[across] * (n - split) + b[across] - split, minlength=out.size)
    out += flat.reshape(out.shape).astype(np.float32)
    many = np.flatnonzero(often > _DENSE)
    column = np.full(len(often), -1)
    column[many] = np.arange(len(many))
    at, who = column[token[~few]], owner[~few]
    for start in range(0, len(many), 2048):
        part = (at >= start) & (at < start + 2048)
        held = np.zeros((n, min(2048, len(many) - start)), np.float32)
        held[who[part], at[part] - start] = 1
        out += held[left] @ held[right].T
    if split is None:
        np.fill_diagonal(out, 0)
    return out


def _similar(sets: list[np.ndarray], split: int | None, threshold: float) -> np.ndarray:
    size = np.array([len(s) for s in sets])
    common = _common(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets), split)
    left, right = (size, size) if split is None else (size[:split], size[split:])
    return common / (left[:, None] + right[None, :] - common).astype(np.float64) >= threshold


_VERIFIED = "grp long, block int, blocks int, rep long, class long, links long, ids binary, weights binary, sizes binary, grams binary"
_VERIFIED_SCHEMA = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("rep", pa.int64()), ("class", pa.int64()), ("links", pa.int64()), ("ids", pa.binary()), ("weights", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])


def _grams_of(words: int):
    """Shingle sets of the members' texts, once a task for rows that repeat; a text whose set is not the member's is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "block", "blocks", "rep", "copies"]
        seen: set[int] = set()
        for batch in batches:
            rep, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "n_rows"))
            new = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(rows > 1).tolist():
                new[i] = rep[i] not in seen
                seen.add(rep[i])
            batch = batch if new.all() else batch.filter(pa.array(new))
            data, bounds = utf8(batch.column("text"))
            want = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("f1", "f2")], axis=1) if batch.num_rows else np.zeros((0, 2))
            for a, b in slices(bounds):
                own = bounds[a : b + 1] - bounds[a]
                hashes, _, _, firsts = hashed_words(data[bounds[a] : bounds[b]], own)
                grams = [shingles(hashes[firsts[i] : firsts[i + 1]], words) for i in range(b - a)]
                good = np.array([(_fingerprint(g) == want[a + i]).all() for i, g in enumerate(grams)], bool)
                part = batch.slice(a, b - a).select(names).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([blob(g) for g, k in zip(grams, good, strict=True) if k], pa.binary())], names=[*names, "grams"])

    return run


def _verify(threshold: float):
    """Groups of one block are decided; blocks of larger groups are packed for the comparison in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for group in sorted_groups(batches, ["grp", "block"]):
            rep, first = np.unique(group.column("rep").to_numpy(), return_index=True)
            weight = group.column("copies").to_numpy()[first]
            packed = group.column("grams").to_pylist()
            sets = [np.frombuffer(packed[i], np.uint64) for i in first.tolist()]
            grp, block, blocks = (group.column(c)[0].as_py() for c in ("grp", "block", "blocks"))
            if blocks == 1:
                close = _similar(sets, None, threshold)
                links, label = close @ weight, _labels(close)
                out += [{"rep": r, "class": c, "links": n} for r, c, n in zip(rep.tolist(), rep[label].tolist(), links.tolist(), strict=True)]
            else:
                row = {"grp": grp, "block": block, "blocks": blocks, "ids": blob(rep), "weights": blob(weight.astype(np.int64)), "sizes": blob(np.array([len(s) for s in sets])), "grams": b"".join(map(blob, sets))}
                out.append(row)
                size += len(row["grams"])
            if len(out) >= 5000 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema=_VERIFIED_SCHEMA)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_VERIFIED_SCHEMA)

    return run


def _pair_blocks(threshold: float):
    """One or two packed blocks of a group: weights of links by set, and ties that span the components of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("ids", pa.binary()), ("links", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])
        for unit in sorted_groups(batches, ["grp", "low", "high"]):
            rows = sorted(unit.to_pylist(), key=lambda r: r["block"])
            ids, weights, sizes = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("ids", "weights", "sizes"))
            sets = [s for r, n in zip(rows, sizes, strict=True) for s in np.split(np.frombuffer(r["grams"], np.uint64), np.cumsum(n)[:-1])]
            split = len(ids[0]) if len(rows) == 2 else None
            close = _similar(sets, split, threshold)
            every = np.concatenate(ids)
            if split is None:
                links, whole = [close @ weights[0]], close
            else:
                links = [close @ weights[1], close.T @ weights[0]]
                whole = np.zeros((len(every), len(every)), bool)
                whole[:split, split:], whole[split:, :split] = close, close.T
            label = _labels(whole)
            tied = np.flatnonzero(label != np.arange(len(every)))
            for i, r in enumerate(rows):
                mine = tied if not i else tied[:0]
                yield pa.RecordBatch.from_pylist([{"grp": r["grp"], "block": r["block"], "ids": r["ids"], "links": blob(links[i].astype(np.int64)), "a": every[mine], "b": every[label[mine]]}], schema=schema)

    return run


def _add_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a block's link weights over its pairs."""
    for group in sorted_groups(batches, ["grp", "block"]):
        rows = group.to_pylist()
        total = sum(np.frombuffer(r["links"], np.int64) for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows[0]["ids"], np.int64)), pa.array(total)], names=["rep", "links"])


def _exact(docs: DataFrame, signed: DataFrame, sets: DataFrame, ties: DataFrame, words: int, threshold: float) -> DataFrame:
    """``(rep, class, links)`` of the sets in candidate groups: exact classes, and the weight of each set's links."""
    found = connected_components(ties)
    groups = found.select(F.col("node").alias("rep"), F.col("root").alias("grp")).unionByName(found.select(F.col("root").alias("rep"), F.col("root").alias("grp")).distinct())
    members = cut(groups.join(sets.select("rep", "id", "mark", "n", "f1", "f2", "copies"), "rep"), "members")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n_sets"), F.sum("n").alias("n_grams"))
    blocks = F.greatest(F.ceil(F.col("n_sets") / BLOCK_SETS), F.ceil(F.col("n_grams") / BLOCK_SHINGLES)).cast("int")
    members = join_unique(members, sizes.withColumn("blocks", blocks), ["grp"], "n_sets").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    repeated = signed.groupBy("id", "mark").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    sources = members.join(repeated, ["id", "mark"], "left").select("id", "mark", "grp", "block", "blocks", "rep", "copies", "f1", "f2", F.coalesce("n_rows", F.lit(1).cast("long")).alias("n_rows"))
    # Sorted and merged at any size; what repeats a row is split as a skewed partition and dropped in its task.
    texts = docs.join(sources.hint("merge"), ["id", "mark"])
    grams = texts.select("grp", "block", "blocks", "rep", "copies", "f1", "f2", "n_rows", "text").mapInArrow(_grams_of(words), "grp long, block int, blocks int, rep long, copies long, grams binary")
    dealt = grams.repartition("grp", "block").sortWithinPartitions("grp", "block")
    verified = cut(dealt.mapInArrow(_verify(threshold), _VERIFIED), "verified")
    decided = verified.filter("blocks IS NULL").select("rep", "class", "links")
    large = verified.filter("blocks IS NOT NULL")
    if large.isEmpty():
        return decided
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = large.select("grp", "block", "ids", "weights", "sizes", "grams", other.alias("_other"))
    units = units.select("grp", "block", "ids", "weights", "sizes", "grams", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"))
    units = units.repartition("grp", "low", "high").sortWithinPartitions("grp", "low", "high")
    paired = cut(units.mapInArrow(_pair_blocks(threshold), "grp long, block int, ids binary, links binary, a array<long>, b array<long>"), "pairs")
    links = paired.select("grp", "block", "ids", "links").repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(_add_links, "rep long, links long")
    across = connected_components(paired.select(F.explode(F.arrays_zip("a", "b")).alias("t")).select("t.a", "t.b"))
    classed = links.join(across.select(F.col("node").alias("rep"), F.col("root").alias("class")), "rep", "left")
    return decided.unionByName(classed.select("rep", F.coalesce("class", "rep").alias("class"), "links"))


def _classed(docs: DataFrame, words: int, threshold: float, recall: float, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed texts; ``(f1, f2, copies, class_id, class_mark, n_links)`` of each set, where ``class_id, class_mark`` are the id
    and hash of the first text of its class; and ``(id, mark)`` of the texts without words."""
    least = F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID))
    rows = docs.select(least.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    signed = cut(_signatures(rows, words, runs_for(recall, threshold), threshold), "signatures")
    by = ["f1", "f2"]
    sets = signed.groupBy(*by).agg(F.min(F.struct("id", "mark")).alias("source"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("paths").alias("paths"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("rep"), "source.id", "source.mark", *by, "copies", "n", "sig", "paths"), "sets")
    exact = _exact(rows, signed, sets, _candidate_ties(sets, threshold), words, threshold)
    exact = cut(exact.join(sets.select("rep", "id", "mark"), "rep"), "classes")
    first = exact.groupBy("class").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n_sets"))
    first = first.select("class", F.col("first.id").alias("class_id"), F.col("first.mark").alias("class_mark"), "n_sets")
    named = join_unique(exact.select("rep", "class", "links"), first, ["class"], "n_sets").select("rep", "class_id", "class_mark", "links")
    classed = sets.select(*by, "rep", "id", "mark", "copies").join(named, "rep", "left").select(
        *by, "copies", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_mark", "mark").alias("class_mark"),
        (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
    )
    return signed, classed, rows.filter(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", "mark")


def jaccard_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``class_id`` (least id of its similar documents, directly or through others) and
    ``n_links`` (how many other documents are similar to it directly, copies included). Classes of null ids alone have a
    null ``class_id``, and different classes may share the id of rows that repeat it with other texts."""
    signed, classed, wordless = _classed(docs, words, threshold, recall, key, text)
    found = join_unique(signed.select("id", "f1", "f2"), classed, ["f1", "f2"], "copies").select("id", "class_id", "n_links")
    wordless = wordless.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return found.unionByName(wordless).select(back("id").alias(key), back("class_id").alias("class_id"), "n_links")


def without_near_copies(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class: that of the least id, and of its texts one. Texts without words all stay, repeated rows once."""
    _, classed, wordless = _classed(docs, words, threshold, recall, key, text)
    kept = classed.select("class_id", "class_mark").distinct().unionByName(wordless.toDF("class_id", "class_mark").distinct())
    # One key for the join and for repeated rows, so that texts are shuffled once. No name of the input can meet one of ours.
    names = [f"c{i}" for i in range(len(docs.columns))]
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("class_id"), F.xxhash64(F.col(text)).alias("class_mark"))
    return marked.join(kept, ["class_id", "class_mark"], "left_semi").dropDuplicates(["class_id", "class_mark"]).select(*names).toDF(*docs.columns)
