"""Operator 5: mix sources to target weights by Poisson replication.

A source's rate is ``total * weight / rows``. A document's number of copies inverts the Poisson distribution
with that mean at a uniform number hashed from the seed and the document's id, so a run can be
repeated or recovered without a stored random state. Documents are exploded by their count and
shuffled globally by a second hash. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut

# Hashes keep this many bits, which a double holds exactly.
_BITS = 52


def _hash52(*parts: Column | str | int) -> Column:
    """The first 13 hexadecimal digits of an MD5 as a number; a null part reads ``-``."""
    text = [F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *text)), 1, 13), 16, 10).cast("long")


def source_counts(docs: DataFrame, source: str = "source") -> DataFrame:
    """``(source, n_docs)``; null is a source of its own."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))


def tempered_weights(counts: DataFrame, exponent: float) -> DataFrame:
    """``(source, weight)`` with weights in proportion to ``n_docs ** exponent``: below 1, small sources gain."""
    return counts.select("source", F.pow(F.col("n_docs").cast("double"), F.lit(exponent)).alias("weight"))


def _steps(rate: Column) -> Column:
    """Values of the Poisson distribution function for 0, 1, 2, ... up to where a 52-bit number can reach.

    The tail beyond ``rate + 12 sqrt(rate) + 40`` is below 2^-52 for every rate. Probabilities are taken
    from their logarithms, so large rates do not vanish.
    """
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, i: Column) -> Column:
        log = s["log"] + F.log(rate) - F.log(i.cast("double"))
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(s["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, step)["all"]).otherwise(F.array(F.lit(1.0)))


def poisson_count(uniform: Column, steps: Column) -> Column:
    """Number of copies: how many values of the distribution function the uniform number has reached."""
    return F.size(F.filter(steps, lambda c: uniform >= c))


def mix_sources(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``copy`` (from 0) and ``shuffle_key``, in the global order of ``shuffle_key``.

    ``weights`` has one ``(source, weight)`` row for each source to keep; others get no copies. ``total`` is the
    expected number of rows (default: as many as in ``docs``). Rows with the same id and source
    get the same count. An empty table stays empty. Only two numbers reach the driver. Columns of the two
    new names are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    named = docs.columns
    inner = [f"c{i}" for i in range(len(named))]  # no name of the input can meet one of ours
    docs, source, key = docs.toDF(*inner), inner[named.index(source)], inner[named.index(key)]
    counts = source_counts(docs, source)
    known = counts.join(weights, counts["source"].eqNullSafe(weights["source"])).select(counts["source"].alias("s"), "n_docs", F.col("weight").cast("double"))
    known = cut(known, "weights")
    weight_sum, rows = known.agg(F.sum("weight"), F.sum("n_docs")).first()
    wanted = float(rows or 0) if total is None else float(total)
    rate = F.lit(wanted) * F.col("weight") / F.lit(weight_sum or 1.0) / F.col("n_docs")
    rates = known
    rates = rates.select(_source_key(F.col("s")).alias("_mix_key"), "n_docs", _steps(rate).alias("_mix_steps"))
    uniform = _hash52(seed, "copies", F.col(key)).cast("double") / float(1 << _BITS)
    counted = join_unique(docs.withColumn("_mix_key", _source_key(F.col(source))), rates.withColumnRenamed("n_docs", "_mix_docs"), ["_mix_key"], "_mix_docs")
    counted = counted.withColumn("_mix_copies", poisson_count(uniform, F.col("_mix_steps"))).filter("_mix_copies > 0")
    copies = counted.select(*inner, F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)).alias("copy"))
    shuffled = copies.withColumn("shuffle_key", _hash52(seed, "order", F.col(key), F.col("copy")))
    return shuffled.repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key").toDF(*named, "copy", "shuffle_key")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))
