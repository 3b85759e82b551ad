"""Operator 12: how quality filters overlap, from one incremental pass over files.

A text's failed filters are a mask. Whether it repeats a text of a smaller id is not known until all files
have been seen, so files stream through Spark in micro-batches that take what is available: keyed state holds each
text's smallest id and the rows that carry it. A row counts as first until a smaller id arrives;
then its former mask is retracted from the counters and counted again with the filter for copies. The stream
appends signed counts, exactly once, to a table; their sum is right after any number of batches and in any order
of files.

Texts are known to the state by their SHA-256 and held in buckets, so Python is called once a bucket and batch. Before
the shuffle every task keeps the smallest id of a text among a batch of rows; the others have a smaller one
and are dealt out by their id, not by their text, so a text that a third of all rows share loads no task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridterrain.scratch import scratch_path

FILTERS = "ABCDE"
COPY_BIT = 16
# State beyond this many bytes goes to RocksDB; below, the session's store (by default the executors' memory) holds it.
# An entry of the state has a digest of 32 bytes, an id, a count, a mask and a part.
MEMORY_STATE, _ENTRY = 1 << 30, 64
# The state of this many rows makes one value of the state store.
ROWS_PER_BUCKET = 4_000
# Files are dealt into about this many micro-batches.
BATCHES = 4
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_GAP = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_STATE = "texts binary"
_LARGEST = 2**63 - 1
_DELTA = "doc_id long, known boolean, part string, mask int, n long"
_ROWS = "bucket long, " + _DELTA + ", digest binary, settled boolean"
_OUT = ["doc_id", "known", "part", "mask", "n"]


def filter_mask(text: Column) -> Column:
    """Bits of the first four filters that a text fails: 1 short, 2 few different words, 4 capitals, 8 symbols."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    # Words are split once for both of their filters.
    by_words = F.transform(F.array(words), lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)).cast("long") < 50 * F.size(w).cast("long"), 2).otherwise(0))
    length = F.length(text).cast("long")
    capitals = length - F.length(F.translate(text, _UPPER, "")).cast("long")
    return F.get(by_words, F.lit(0)) + F.when(100 * capitals > 3 * length, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def _settle(buckets: int):
    """Per batch of rows: one row for each text, id and part; those above the text's smallest id are settled copies.

    Rows of unknown id are settled too, as they are no copies and make none.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.groupby(["bucket", "doc_id", "known", "part", "mask", "digest"], as_index=False).size().rename(columns={"size": "n"})
            first = rows["doc_id"].where(rows["known"], _LARGEST).groupby(rows["digest"]).transform("min")
            late = rows["known"] & (rows["doc_id"] > first)
            rows["mask"] = rows["mask"] + late * COPY_BIT
            rows["settled"] = late | ~rows["known"]
            spread = (rows["doc_id"] % buckets).where(rows["known"], rows["bucket"])
            rows["bucket"] = rows["bucket"].where(~rows["settled"], -1 - spread)
            yield rows[["bucket", *_OUT, "digest", "settled"]]

    return run


_HELD = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("digest", pa.binary())])


def _pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(pa.Table.from_pandas(rows[_HELD.names], _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _retract(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed counts that a batch's rows add, and those of rows that are no longer the first of their text."""
    if key[0] < 0:
        for rows in batches:
            yield rows[_OUT]
        return
    # Tasks have settled all but one id of a text for each batch of rows, so the new rows are about as few as the texts.
    both = pd.concat([rows.assign(old=False) for rows in batches], ignore_index=True)
    if state.exists:
        held = pa.ipc.open_stream(state.get[0]).read_pandas()
        both = pd.concat([held.assign(old=True, known=True), both], ignore_index=True)
    late = both["doc_id"] > both.groupby("digest")["doc_id"].transform("min")
    copies = both.assign(mask=both["mask"] + COPY_BIT)
    fallen = both[late & both["old"]]
    yield pd.concat([both[~both["old"] & ~late][_OUT], copies[late][_OUT], fallen.assign(n=-fallen["n"])[_OUT]])
    state.update((_pack(both[~late].groupby(["doc_id", "part", "mask", "digest"], as_index=False)["n"].sum()),))


def stream_masks(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Signed counts ``(doc_id, known, part, mask, n)`` of the Parquet files at ``path``; sums of ``n`` are numbers of rows.

    A null text is an empty one, a null part an empty string. Rows without an id (``known`` is false) are no copies and make none; rows
    that repeat an id and a text are all first or all copies. An empty table gives no rows. Other columns do not
    matter. The query ends when every file has been processed; its state and progress are in the shared folder, so
    a lost executor repeats a part of one batch and counts nothing twice.
    """
    table = spark.read.parquet(path)
    files, size = len(table.inputFiles()), table.count()
    buckets = max(16, -(-size // ROWS_PER_BUCKET))
    # Streams read folders; written as a pattern of one name, the path may be that of a file too.
    path = path.rstrip("/")
    only = f"{path[:-1]}[{path[-1]}]"
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = (
        spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(only)
        .select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"), F.col(key).isNotNull().alias("known"), F.coalesce(F.col(part), F.lit("")).alias("part"), whole.alias("text"))
        .select(
            F.pmod(F.xxhash64("text"), F.lit(buckets)).cast("long").alias("bucket"), "doc_id", "known", "part",
            filter_mask(F.col("text")).cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"),
        )
        .mapInPandas(_settle(buckets), _ROWS)
    )
    deltas = rows.groupBy("bucket").applyInPandasWithState(_retract, _DELTA, _STATE, "append", GroupStateTimeout.NoTimeout)
    found = scratch_path(spark, "masks")
    store = _STORE if size * _ENTRY > MEMORY_STATE else {}
    before = {name: spark.conf.get(name, None) for name in store}
    for name, value in store.items():
        spark.conf.set(name, value)
    try:
        query = deltas.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start(found)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(_DELTA).parquet(found)


def part_counters(deltas: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by part, mask and label: ``(part, mask, good, toxic, n)``, a few hundred for each part.

    An id is good, or toxic, if any row of ``labels`` says so; ids without a label are neither.
    """
    known = labels.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.filter("_id IS NOT NULL").groupBy("_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    summed = deltas.groupBy(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "part", "mask").agg(F.sum("n").alias("n")).filter("n <> 0")
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    joined = summed.join(known, F.col("doc_id") == F.col("_id"), "left")
    return joined.groupBy("part", "mask", *marks).agg(F.sum("n").alias("n"))


def interactions(counters: DataFrame) -> DataFrame:
    """What each filter removes at each step of every order of the filters, by part; zeros included."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    steps = [
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(i + 1).alias("step"), F.lit(bit[name]).alias("own"), F.lit(sum(bit[x] for x in order[:i])).alias("earlier"))
        for order in permutations(FILTERS) for i, name in enumerate(order)
    ]
    rows = counters.select("*", F.explode(F.array(*steps)).alias("s")).select("*", "s.*")
    fails, passed = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) == 0
    # A filter comes first among those that a row fails in an equal share of all orders.
    first_in = F.lit(len(steps) // len(FILTERS)) / F.bit_count("mask")
    of = lambda condition, value="n": F.coalesce(F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value)), F.lit(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        of(passed & ~fails).alias("kept"), of(passed & fails).alias("removed"), of(~passed & fails).alias("redundant"),
        of(F.col("mask") == F.col("own")).alias("unique_fails"), of(passed & fails & F.col("good")).alias("good_lost"),
        of(passed & fails & F.col("toxic")).alias("toxic_lost"), of(fails, F.col("n") * first_in).alias("shapley"),
    )
