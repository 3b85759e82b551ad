"""Operator 9: document fingerprints as a homomorphic hash of the multiset of paragraphs.

Every paragraph (line) is hashed to a wide vector and a document's fingerprint is the sum of the vectors,
component by component, modulo powers of two:

* ``exact``: 16 components modulo 2^32 over whole paragraphs. Two texts with the same paragraphs, in any
  order, have the same sums, and a paragraph is inserted or deleted by adding or subtracting its vector.
* ``near``: 64 components modulo 2^40 over the paragraphs cut into runs of eight words, with odd values of
  mean zero. The squared length of the difference of two such sums estimates how many runs differ.

Only built-in functions run here, inside a projection; nothing is shuffled for a fingerprint. A null text is
an empty text, whose one paragraph is empty. Repeated paragraphs count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT_PARTS, EXACT_BITS = 16, 32
NEAR_PARTS, NEAR_BITS = 64, 40
_RUN = r"[^\S\n]*(?:\S+[^\S\n]*){1,8}"


def _modulo(total: Column, bits: int) -> Column:
    return total.bitwiseAND(F.lit((1 << bits) - 1))


def _hashes(part: Column, n: int) -> Column:
    """``n`` independent 64-bit hashes of a string."""
    return F.array(*[F.xxhash64(F.lit(k), part) for k in range(n)])


def _summed(parts: Column, n_hashes: int, components: int, value, bits: int) -> Column:
    """Component sums over the parts; ``value(hashes, i)`` is component ``i`` of one part."""
    zero = F.array_repeat(F.lit(0).cast("long"), components)
    add = lambda total, hashes: F.transform(total, lambda t, i: _modulo(t + value(hashes, i), bits))
    return F.aggregate(F.transform(parts, lambda p: _hashes(p, n_hashes)), zero, add)


def _shift(bits: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, by)


def _exact_value(hashes: Column, i: Column) -> Column:
    return _modulo(_shift(F.get(hashes, F.shiftright(i, 1)), i.bitwiseAND(F.lit(1)) * 32), 32)


def _near_value(hashes: Column, i: Column) -> Column:
    return _modulo(_shift(F.get(hashes, F.shiftright(i, 3)), i.bitwiseAND(F.lit(7)) * 8), 8) * 2 - 255


def fingerprint(text: Column) -> Column:
    """``struct(exact, near)`` of a text."""
    text = F.coalesce(text, F.lit(""))
    exact = _summed(F.split(text, "\n"), EXACT_PARTS // 2, EXACT_PARTS, _exact_value, EXACT_BITS)
    near = _summed(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0)), NEAR_PARTS // 8, NEAR_PARTS, _near_value, NEAR_BITS)
    return F.struct(exact.alias("exact"), near.alias("near"))


def add_fingerprints(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of the paragraphs of both; with ``sign=-1`` of those of ``a`` without those of ``b``."""
    add = lambda part, bits: F.zip_with(a[part], b[part], lambda x, y: _modulo(x + y * sign, bits)).alias(part)
    return F.struct(add("exact", EXACT_BITS), add("near", NEAR_BITS))


def _signed(x: Column) -> Column:
    return F.when(x >= 1 << (NEAR_BITS - 1), x - (1 << NEAR_BITS)).otherwise(x).cast("double")


def _length(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + _signed(x) * _signed(x))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, about the share of common runs of words otherwise."""
    apart = _length(F.zip_with(a["near"], b["near"], lambda x, y: _modulo(x - y, NEAR_BITS)))
    size = _length(a["near"]) + _length(b["near"])
    common = F.when(size > 0, F.greatest(F.lit(0.0), 1 - apart / size)).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(common, F.lit(1.0)))


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as one string of hexadecimal digits."""
    digits = lambda part, bits: F.array_join(F.transform(fp[part], lambda x: F.lower(F.lpad(F.hex(x), bits // 4, "0"))), "")
    return F.concat(digits("exact", EXACT_BITS), digits("near", NEAR_BITS))


def with_next(docs: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """Rows with ``next``: a struct of ``columns`` of the row that follows by ``key``; after the last, the first.

    The rows are cut into blocks at quantiles of the key, eight for each shuffle partition, and shuffled
    once. The first row of a block also goes to the block before it as a guest, so each block is
    complete. What is broadcast has one row for each block. Null keys come first; rows of one
    key follow each other in the order of ``columns``.
    """
    spark = docs.sparkSession
    blocks = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = docs.agg(F.array_sort(F.array_distinct(F.percentile_approx(key, shares, 10 * blocks))).alias("c")).first()["c"] or []
    root = max(1, int(len(cuts) ** 0.5))
    fine = F.lit([cuts[i : i + root] for i in range(0, len(cuts), root)]) if cuts else None
    coarse = F.lit([cuts[i] for i in range(0, len(cuts), root)]) if cuts else None
    if cuts:
        at = F.size(F.filter(coarse, lambda c: c <= F.col(key)))
        block = F.when(at > 0, (at - 1) * root + F.size(F.filter(F.get(fine, at - 1), lambda c: c <= F.col(key)))).otherwise(0)
        block = F.coalesce(block, F.lit(0))
    else:
        block = F.lit(0)
    placed = docs.select("*", block.cast("int").alias("_block"))
    order = Window.orderBy("_block")
    heads = placed.groupBy("_block").agg(F.min(F.struct(F.col(key).isNotNull().alias("known"), F.col(key).alias("id"))).alias("head"))
    heads = heads.select(F.col("head.id").alias("_head"), F.lag("_block").over(order).alias("_before"), F.max("_block").over(Window.partitionBy()).alias("_last"))
    heads = heads.select("_head", F.coalesce("_before", "_last").alias("_host"), F.col("_before").isNull().alias("_wraps"))
    host = F.struct(F.col("_block"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_host").alias("_block"), F.when(F.col("_wraps"), 2).otherwise(1).alias("guest"))
    dealt = (
        placed.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("_head")), "left")
        .withColumn("_seat", F.explode(F.when(F.col("_host").isNotNull(), F.array(host, guest)).otherwise(F.array(host))))
        .select(*docs.columns, "_seat._block", "_seat.guest")
        .repartition("_block")
        .select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_self"))
    )
    by = Window.partitionBy("_block").orderBy("guest", F.col(key).asc_nulls_first(), "_self")
    return dealt.withColumn("next", F.lead("_self").over(by)).filter("guest = 0").drop("guest", "_block")


def half_edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many first code points of ``following``, or all of them."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its half-edited text, and how alike they are.

    Columns: the key, ``n_chars`` (code points), ``edited``, ``fp``, ``edited_fp``, ``near_edited``,
    ``near_next``. Other columns of the input do not matter, whatever their names. The only
    document follows itself; an empty table gives no rows.
    """
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    followed = with_next(texts, "_key", {"text": F.col("_text"), "fp": fingerprint(F.col("_text"))})
    edited = followed.select("*", half_edited(F.col("_text"), F.col("next.text")).alias("edited"))
    edited = edited.select("_key", F.length("_text").cast("long").alias("n_chars"), "edited", F.col("_self.fp").alias("fp"), F.col("next.fp").alias("next_fp"), fingerprint(F.col("edited")).alias("edited_fp"))
    return edited.select(
        F.col("_key").alias(key), "n_chars", "edited", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
