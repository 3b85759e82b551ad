"""Operator 10: token ids in one wavelet-matrix file per shard, in ascending order of documents.

Documents are range-partitioned and sorted by id, encoded, closed by an end id and gathered into shards of
about ``shard_tokens`` ids, each of whole documents. A task writes its shards as it goes; only files of
committed tasks are in the manifest. Reading deals out the files, takes the ids back from the bit-planes and
adds up the offsets: within a partition by a window, over partitions by a table with one row for each.

Null texts are empty, null ids come first, rows of one id are ordered by their text. An empty table has
no shards and no rows. One document is never split, so a shard is at least as large as its longest.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window, functions as F

from gridterrain.llm.bpe import CACHED_LENGTH, is_awkward
from gridterrain.llm.wavelet import Wavelet, build
from gridterrain.llm.workers import worker_cache
from gridterrain.scratch import cut

SHARD_TOKENS = 2 << 20
# Runs kept with their ids in a worker, besides those of the texts at hand.
CACHED_RUNS = 650_000
_MANIFEST = "part int, seq int, path string, tokens long, docs long"


def open_file(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class Library:
    """The ``tokenizers`` library behind tables of what it has encoded before.

    No word of byte-level BPE crosses a blank or a line end that stands alone. So a text is put together
    from its runs between blanks, and only new runs go to the library, many in one text: each begins with
    its blank, and only there can a token begin with one. Other texts are encoded as a whole. Full
    tables become the old ones, from which runs still in use are taken over.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # what comes here is new, so the library's own table of words costs more than it saves
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        split = spec["pre_tokenizer"] or {}
        self.by_runs = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        top = max(self.tokenizer.get_vocab().values())
        self.kind = "<u2" if top < 1 << 16 else "<u4"
        self.blank = np.zeros(top + 1, bool)
        self.blank[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.line = b"".join(self._encode_all(["\n"]))
        # Runs after a blank, and at the start of a text or line.
        self.runs: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of printable runs, each with the blank before it."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(runs)], add_special_tokens=False)[0].ids, self.kind)
        at = np.flatnonzero(self.blank[ids])
        if len(at) != len(runs):
            return self._encode_all([" " + r for r in runs])
        packed, width = ids.tobytes(), ids.itemsize
        edges = [*(at * width).tolist(), len(packed)]
        return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _learn(self, missing: set[str], starts: set[str]) -> None:
        """Encode new runs and starts. Printable runs hold no white space; others are parted at line ends or stay unknown."""
        plain = []
        lines: dict[str, list[str]] = {}
        for run in missing:
            known = self.old.get(run)
            if known is not None:
                self.runs[run] = known
            elif run.isprintable():
                if run:
                    plain.append(run)
            else:
                parts = run.split("\n")
                if all(p and p.isprintable() for p in parts):
                    lines[run] = parts
        plain += {p[0] for p in lines.values() if p[0] not in self.runs}.difference(plain)
        new = [s for s in starts.union(*(p[1:] for p in lines.values())) if s not in self.starts]
        self.starts.update(zip(new, self._encode_all(new), strict=True))
        for start in range(0, len(plain), 8192):
            part = plain[start : start + 8192]
            self.runs.update(zip(part, self._encode_runs(part), strict=True))
        for run, parts in lines.items():
            self.runs[run] = self.line.join([self.runs[parts[0]], *map(self.starts.__getitem__, parts[1:])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, little-endian with the width of ``kind``."""
        out: list[bytes | None] = [None] * len(texts)
        known = self.runs
        split: list[tuple[int, str, list[str], list[bytes | None], list[int]]] = []
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if self.by_runs and not any(s in text for s in self.special):
                start, *runs = text.split(" ")
                if not runs or not is_awkward(start):
                    found = [*map(known.get, runs)]
                    holes = [j for j, ids in enumerate(found) if ids is None]
                    split.append((i, start, runs, found, holes))
                    missing.update([runs[j] for j in holes])
        self._learn(missing, {s[1] for s in split})
        for i, start, runs, found, holes in split:
            for j in holes:
                found[j] = known.get(runs[j])
            with contextlib.suppress(TypeError):  # a run that has no ids of its own
                out[i] = b"".join([self.starts[start], *found])
        whole = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(whole, self._encode_all([texts[i] for i in whole]), strict=True):
            out[i] = ids
        for run in missing:
            if len(run) > CACHED_LENGTH:
                self.runs.pop(run, None)
        if len(self.runs) > CACHED_RUNS:
            self.old, self.runs = self.runs, {}
        if len(self.starts) > CACHED_RUNS // 4 or any(len(s[1]) > CACHED_LENGTH for s in split):
            self.starts.clear()
        return out


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents; the manifest ``(part, seq, path, tokens, docs)``, itself a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        library = worker_cache(f"library:{path}", lambda: Library(path))
        fs, root = open_file(folder)
        fs.create_dir(root, recursive=True)
        part, end, seq = TaskContext.get().partitionId(), np.array([end_id], library.kind).tobytes(), 0
        width = len(end)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def done() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.wvmx"
            known = np.array([k is not None for k in keys], np.uint8)
            tables = {"keys": np.array([k or 0 for k in keys], "<i8"), "known": known, "ends": np.cumsum([len(i) // width for i in ids]).astype("<i8")}
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(build(np.frombuffer(b"".join(ids), library.kind), tables))
            row = {"part": part, "seq": seq, "path": f"{folder}/{name}", "tokens": held, "docs": len(keys)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("docs", pa.int64())]))

        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                piece = batch.slice(start, 200)
                packed = library.encode([t or "" for t in piece.column(1).to_pylist()])
                for k, i in zip(piece.column(0).to_pylist(), packed, strict=True):
                    keys.append(k)
                    ids.append(i + end)
                    held += len(i) // width + 1
                    if held >= shard_tokens:
                        yield done()
                        keys, ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield done()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")
    return cut(ordered.mapInArrow(write, _MANIFEST), "shards")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``: the ids of all shards before."""
    before = lambda order, *by: F.coalesce(F.sum("tokens").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before("part").alias("_parts"))
    return manifest.withColumn("_shards", before("seq", "part")).join(F.broadcast(parts), "part").withColumn("start", F.col("_parts") + F.col("_shards")).drop("_parts", "_shards")


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of every document from its file; ``ids`` are little-endian unsigned 32-bit, with the end id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                fs, path = open_file(shard["path"])
                with fs.open_input_file(path) as file:
                    wave = Wavelet(lambda at, n: file.read_at(n, at))  # noqa: B023
                    data = wave.values().astype("<u4", copy=False)
                    keys, known, ends = wave.table("keys"), wave.table("known"), wave.table("ends")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for a in range(0, len(keys), 500):
                    b = min(a + 500, len(keys))
                    offsets = np.concatenate([starts[a : a + 1], ends[a:b]]) * 4
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                    columns = [pa.array(keys[a:b], pa.int64(), mask=known[a:b] == 0), pa.array(starts[a:b] + shard["start"], pa.int64()), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids"])

    dealt = with_starts(manifest).repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))
    return dealt.mapInArrow(read, "doc_id long, start long, ids binary")


def find_token(manifest: DataFrame, token: int) -> DataFrame:
    """``(path, start, count, first)`` of each shard: how often a token occurs and where first, without reading whole files."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard in batch.to_pylist():
                fs, path = open_file(shard["path"])
                with fs.open_input_file(path) as file:
                    wave = Wavelet(lambda at, n: file.read_at(n, at))  # noqa: B023
                    n = wave.count(token)
                    rows.append({"path": shard["path"], "start": shard["start"], "count": n, "first": shard["start"] + wave.select(token, 0) if n else None})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("count", pa.int64()), ("first", pa.int64())]))

    return with_starts(manifest).mapInArrow(find, "path string, start long, count long, first long")
