"""Zip archives, read where their entries lie.

An archive is listed by its path alone. One task reads the directory at its end; each entry then is a row
``(archive, entry, offset, packed bytes)`` of its own, so the entries of one large archive are read by many tasks and no archive is
ever held whole. ZIP64 directories are read alike.
"""

from __future__ import annotations

import io
import itertools
import lzma
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridterrain.scratch import cut

# The only folders a postcode archive may hold.
ALLOWED_FOLDERS = ["Data/", "Doc/"]
# What reading a damaged, encrypted, unknown or undecodable entry, or one behind the end of its archive, raises.
_DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, UnicodeDecodeError, lzma.LZMAError, pa.ArrowInvalid)
# Lines handed on at a time.
LINES = 20_000


# Packed bytes that a task should read.
TASK_BYTES = 64 << 20
_DIRECTORY = "archive string, entry string, bad_entries bigint, offset bigint, packed bigint, size bigint, method int, flags int, crc bigint"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zip files below a path as ``(archive, length)``; nothing of them is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("archive"), "length")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path that Arrow reaches, and the path in it; Spark writes local ones as ``file:/...`` or without a scheme."""
    local = path.removeprefix("file:")
    return (fs.LocalFileSystem(), local) if local.startswith("/") and not local.startswith("//") else fs.FileSystem.from_uri(path)


class _File(io.RawIOBase):
    """A file of a store; places before its start are refused as in ordinary files."""

    def __init__(self, raw: pa.NativeFile):
        self._raw = raw

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._raw.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        place = offset + (0, self._raw.tell(), self._raw.size())[whence]
        if place < 0:
            raise OSError("a place before the start")
        return self._raw.seek(place)

    def read(self, n: int = -1) -> bytes:
        return self._raw.read(None if n is None or n < 0 else n)

    def close(self) -> None:
        self._raw.close()
        super().close()


def open_file(path: str) -> _File:
    store, inner = store_of(path)
    return _File(store.open_input_file(inner))


def _stray(names: list[str]) -> int:
    """Entries outside the allowed folders, or that climb out of them."""
    return sum(not name.startswith(tuple(ALLOWED_FOLDERS)) or ".." in name.replace("\\", "/").split("/") for name in names)


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "entry", "bad_entries", "offset", "packed", "size", "method", "flags", "crc"]
    for batch in batches:
        for archive in batch["archive"]:
            try:
                with open_file(archive) as raw, zipfile.ZipFile(raw) as opened:
                    infos = opened.infolist()
            except (zipfile.BadZipFile, pa.ArrowInvalid):
                yield pd.DataFrame([(archive, None, 1, 0, 0, 0, 0, 0, 0)], columns=columns)
                continue
            stray = _stray([i.filename for i in infos])
            files = [i for i in infos if not i.is_dir()] or infos[:1]
            rows = [(archive, None if i.is_dir() else i.filename, stray, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC) for i in files]
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def archive_entries(archives: DataFrame) -> DataFrame:
    """The files of every archive: ``(archive, entry, bad_entries, offset, packed, size, method, flags, crc)``.

    ``bad_entries`` is the archive's number of entries outside the allowed folders. An archive whose directory cannot be
    read has one row without an entry and counts as bad, one that holds folders alone has one row without an entry. Only directories are read.
    """
    return archives.mapInPandas(_directories, _DIRECTORY)


def _dealt(entries: DataFrame) -> DataFrame:
    """Entries written once and dealt to as many tasks as their packed bytes ask for, at least one for each core."""
    entries = cut(entries, "entries")
    total = entries.agg(F.sum("packed")).first()[0] or 0
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return entries.repartition(tasks, "archive", "offset")


def _open_entry(raw, row) -> zipfile.ZipExtFile:
    """The text of an entry as a stream that starts at its place in the archive and checks its sum at the end."""
    if row.flags & 1:
        raise RuntimeError("encrypted")
    raw.seek(row.offset)
    head = raw.read(30)
    if len(head) < 30 or not head.startswith(b"PK\3\4"):
        raise zipfile.BadZipFile("no entry here")
    raw.seek(row.offset + 30 + sum(struct.unpack("<HH", head[26:])))
    info = zipfile.ZipInfo(row.entry)
    info.compress_type, info.compress_size, info.file_size, info.CRC = row.method, row.packed, row.size, row.crc
    return zipfile.ZipExtFile(raw, "r", info)


def _whole_text(row) -> str | None:
    """Text of an entry; none if it is damaged, encrypted, packed in an unknown way or not UTF-8."""
    try:
        with open_file(row.archive) as raw, _open_entry(raw, row) as data:
            found = data.read()
            # A stream that ends early leaves no sum to check.
            return found.decode("utf-8") if len(found) == row.size else None
    except _DAMAGED:
        return None


def _readable(row) -> bool:
    """Whether an entry can be read to its end; it is not held."""
    try:
        with open_file(row.archive) as raw, _open_entry(raw, row) as data:
            text = io.TextIOWrapper(data, "utf-8")
            while text.read(1 << 20):
                pass
            return data.tell() == row.size
    except _DAMAGED:
        return False


def entry_texts(archives: DataFrame, pattern: str = "") -> DataFrame:
    """Whole text of every small file in every readable archive, one row per entry whose name has the pattern.

    ``bad_entries`` is the archive's count of entries outside the allowed folders. An entry that cannot
    be read has a null text.
    """
    return _texts(archive_entries(archives).filter(F.col("entry").rlike(pattern)))


def _texts(entries: DataFrame) -> DataFrame:
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({"archive": [row.archive], "entry": [row.entry], "bad_entries": [row.bad_entries], "text": [_whole_text(row)]})

    return _dealt(entries).mapInPandas(texts, "archive string, entry string, bad_entries bigint, text string")


def entry_lines(archives: DataFrame, pattern: str = "") -> DataFrame:
    """``(archive, entry, line)`` of the archives that pass, for entries whose name has the pattern.

    An entry is read through once to check it and then streamed in batches of lines, so a task never holds
    a whole text. A damaged entry gives no lines; ``unreadable_entries`` names it.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if not _readable(row):
                    continue
                with open_file(row.archive) as raw, _open_entry(raw, row) as data:
                    text = io.TextIOWrapper(data, "utf-8")
                    while part := [line.removesuffix("\n") for line in itertools.islice(text, LINES)]:
                        yield pd.DataFrame({"archive": [row.archive] * len(part), "entry": [row.entry] * len(part), "line": part})

    passed = archive_entries(archives).filter((F.col("bad_entries") == 0) & F.col("entry").rlike(pattern))
    return _dealt(passed).mapInPandas(lines, "archive string, entry string, line string")


def rejected_archives(archives: DataFrame) -> DataFrame:
    """Unreadable archives, and archives with entries outside the allowed folders, with their number."""
    return archive_entries(archives).filter("bad_entries > 0").groupBy("archive").agg(F.max("bad_entries").alias("bad_entries"))


def unreadable_entries(archives: DataFrame) -> DataFrame:
    """Entries of readable archives whose text cannot be read: ``(archive, entry)``."""

    def damaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = [not _readable(row) for row in batch.itertuples(index=False)]
            yield batch.loc[bad, ["archive", "entry"]]

    return _dealt(archive_entries(archives).filter("entry IS NOT NULL")).mapInPandas(damaged, "archive string, entry string")


def unpack_archives(archives: DataFrame, pattern: str = "") -> DataFrame:
    """Entries of the archives that pass; one bad entry rejects its whole archive."""
    return entry_texts(archives, pattern).filter("bad_entries = 0").select("archive", "entry", "text")


def tile_of_archive(path: Column, width: int = 4) -> Column:
    """Upper-case 10 km square in front of a tile archive's file name; ``width`` letters and digits name it."""
    return F.upper(F.substring(F.element_at(F.split(path, "/"), -1), 1, width))


def tile_inventory(archives: DataFrame, width: int = 4) -> DataFrame:
    """Archives per tile name, and one of them; nothing is opened."""
    return archives.groupBy(tile_of_archive(F.col("archive"), width).alias("tile")).agg(F.count("*").alias("files"), F.min("archive").alias("archive"))


def tile_archive_texts(archives: DataFrame, wanted: DataFrame | None = None, width: int = 4) -> DataFrame:
    """``(tile, files, text)`` of every tile with an archive; with ``wanted``, of the tiles in its column ``tile`` alone.

    ``text`` is null when the tile has several archives or its archive lacks ``<TILE>.asc``. Tiles are found by
    the names of archives, so an archive is opened only if its tile is wanted and has no other.
    """
    inventory = tile_inventory(archives, width)
    if wanted is not None:
        inventory = inventory.join(wanted.select("tile").distinct(), "tile", "left_semi")
    inventory = cut(inventory, "inventory")
    entries = archive_entries(inventory.filter("files = 1").select("archive"))
    own = F.concat(tile_of_archive(F.col("archive"), width), F.lit(".asc"))
    texts = _texts(entries.filter(F.col("entry") == own)).select("archive", "text")
    return inventory.join(texts, "archive", "left").select("tile", "files", "text")
