"""Operator 13: quality rules and robust multivariate outliers per language and source, in built-in functions only.

Base statistics of a text fail it outright or become a vector of five logarithms in whole steps of 1/256. For
each language and source the location and scatter of the vectors are estimated by the minimum covariance
determinant: from medians and median deviations on, rows are ordered by Mahalanobis distance and the closest three
quarters give the next estimate; a last estimate takes all rows within ``INNER``. Rows beyond ``OUTER`` are rejected.

Every step is one aggregation: rows are counted and summed by group and distance class, so what is shuffled has
at most a few hundred rows for each group, however many rows it has. Sums of whole steps are exact, so results do
not depend on how rows are dealt. A class of distances belongs to the closest three quarters as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut

STEP = 256
# Statistics of a vector, and the least standard deviation taken for each: most texts have no symbol, no repeated
# line and no repeated words at all, which leaves no scatter to measure.
VECTOR = {"length": 0.5, "word_length": 0.1, "symbols": 0.5, "dup_lines": 0.7, "repeats": 0.9}
COVERAGE = 0.75
CONCENTRATIONS = 6
# Squared distances: the 0.975 and the 0.99999 quantile of chi-squared with five degrees of freedom.
INNER, OUTER = 12.83, 30.86
# Classes for each doubling of 1 + 16 times a squared distance.
_CLASSES = 16
_GAPS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_NAMES = list(VECTOR)
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i, len(_NAMES))]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, "")).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more.

    Windows are sorted with their positions, so equal ones are neighbours; the sorted positions of the repeated ones
    each cover three words, or fewer up to the next position.
    """
    window = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k")
    seats = lambda w: F.sequence(F.lit(0), F.size(w) - 3)
    by_text = lambda w: F.sort_array(F.transform(seats(w), lambda i: F.struct(window(w, i), i.alias("i"))))
    same = lambda s, x, at: F.coalesce(F.get(s, at)["k"] == x["k"], F.lit(False))
    repeated = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, at: same(s, x, at - 1) | same(s, x, at + 1)), lambda x: x["i"]))
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, at: F.least(F.lit(3), F.coalesce(F.get(p, at + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda total, x: total + x
    )
    count = _let(by_text(words), lambda s: _let(repeated(s), covered))
    return F.when(F.size(words) >= 3, count).otherwise(F.lit(0).cast("long"))


def base_statistics(text: Column) -> Column:
    """``struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)`` of a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    word_chars = _without(text, _GAPS)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _GAPS, "")) > 0)
    return F.struct(
        F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated_words(w).alias("r"))), F.lit(0)).alias("w"),
        word_chars.alias("word_chars"), (F.length(text).cast("long") - _without(text, _SYMBOLS)).alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def _vector() -> dict[str, Column]:
    """The transformed statistics in whole steps."""
    share = lambda name, scale: F.log1p(F.lit(float(scale)) * F.col(name) / F.col("n_words"))
    values = {
        "length": F.log(F.col("n_words").cast("double")), "word_length": F.log(F.col("word_chars") / F.col("n_words")),
        "symbols": share("n_symbols", 100), "dup_lines": share("n_dup_lines", 1000), "repeats": share("n_repeat_words", 100),
    }
    return {name: F.floor(value * STEP).cast("long") for name, value in values.items()}


def statistics_of(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    """Per row the base statistics, ``base_failed``, the name of its group and, unless failed, its vector."""
    group = F.to_json(F.struct(F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s")))
    rows = docs.select(F.col(key).alias("_key"), group.alias("_group"), base_statistics(F.col(text)).alias("b"))
    rows = rows.select("_key", "_group", F.col("b.w.n").alias("n_words"), "b.word_chars", "b.n_symbols", "b.n_dup_lines", F.col("b.w.r").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).select("*", *[F.when(~F.col("base_failed"), v).alias(f"_{k}") for k, v in _vector().items()])


def _medians(values: DataFrame) -> DataFrame:
    """Lower median of ``v`` for each group and statistic, from counts of equal whole steps."""
    counts = values.groupBy("_group", "_stat", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("_group", "_stat")
    up_to = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select("*", up_to.alias("up_to"), F.sum("n").over(by).alias("total"))
    return ranked.groupBy("_group", "_stat").agg(F.min(F.when(2 * F.col("up_to") >= F.col("total"), F.col("v"))).alias("m"), F.max("total").alias("total"))


def _start(rows: DataFrame) -> DataFrame:
    """First estimate of each group: medians, and median deviations as a diagonal scatter."""
    stats = F.explode(F.array(*[F.struct(F.lit(i).alias("_stat"), F.col(f"_{n}").alias("v")) for i, n in enumerate(_NAMES)]))
    wide = lambda found, name: found.groupBy("_group").agg(F.max("total").alias("_n"), *[F.max(F.when(F.col("_stat") == i, F.col("m"))).alias(f"{name}{i}") for i in range(len(_NAMES))])
    long = rows.select("_group", stats.alias("s")).select("_group", "s.*")
    centres = cut(wide(_medians(long), "c"), "centres")
    away = join_unique(rows, centres, ["_group"], "_n")
    gaps = F.explode(F.array(*[F.struct(F.lit(i).alias("_stat"), F.abs(F.col(f"_{n}") - F.col(f"c{i}")).alias("v")) for i, n in enumerate(_NAMES)]))
    spreads = wide(_medians(away.select("_group", gaps.alias("s")).select("_group", "s.*")), "d").drop("_n")
    both = centres.join(spreads, "_group")
    sds = [F.greatest(F.col(f"d{i}") * 1.4826, F.lit(floor * STEP)) for i, floor in enumerate(VECTOR.values())]
    inverse = [F.array(*[1 / (sd * sd) if i == j else F.lit(0.0) for j in range(len(_NAMES))]) for i, sd in enumerate(sds)]
    return both.select("_group", "_n", F.array(*[F.col(f"c{i}").cast("double") for i in range(len(_NAMES))]).alias("_centre"), F.array(*inverse).alias("_inverse"))


def _inverted(groups: DataFrame, matrix: str) -> DataFrame:
    """The inverse of a symmetric positive matrix column, by one elimination after the other."""
    for k in range(len(_NAMES)):
        pivot = F.transform(F.col(matrix)[k], lambda x, j: F.when(j == k, F.lit(1.0)).otherwise(x) / F.col(matrix)[k][k])  # noqa: B023
        groups = groups.withColumn("_pivot", pivot)
        rest = lambda row, i: F.when(i == k, F.col("_pivot")).otherwise(F.zip_with(
            F.transform(row, lambda x, j: F.when(j == k, F.lit(0.0)).otherwise(x)), F.col("_pivot"), lambda x, p: x - row[k] * p))  # noqa: B023
        groups = groups.withColumn(matrix, F.transform(matrix, rest))
    return groups.drop("_pivot")


def _squared_distance() -> Column:
    gaps = [F.col(f"_{n}") - F.col("_centre")[i] for i, n in enumerate(_NAMES)]
    terms = [(1.0 if i == j else 2.0) * F.col("_inverse")[i][j] * gaps[i] * gaps[j] for i, j in _PAIRS]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _estimate(rows: DataFrame, groups: DataFrame, within: float | None = None) -> DataFrame:
    """Next estimate of each group from its closest rows: three quarters, or all up to a squared distance.

    Rows are summed by group and distance class before the classes are chosen, so this reads the rows once.
    """
    near = join_unique(rows, groups, ["_group"], "_n").withColumn("_d2", _squared_distance())
    ring = F.floor(F.log2(1 + 16 * F.col("_d2")) * _CLASSES).cast("int") if within is None else (F.col("_d2") > within).cast("int")
    sums = [F.sum(f"_{n}").alias(f"s{i}") for i, n in enumerate(_NAMES)] + [F.sum(F.col(f"_{_NAMES[i]}") * F.col(f"_{_NAMES[j]}")).alias(f"p{i}{j}") for i, j in _PAIRS]
    rings = near.groupBy("_group", ring.alias("_ring")).agg(F.count("*").alias("k"), *sums)
    before = F.sum("k").over(Window.partitionBy("_group").orderBy("_ring").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("k").over(Window.partitionBy("_group"))
    rings = rings.select("*", F.coalesce(before, F.lit(0)).alias("before"), total.alias("_n"))
    # At least one row more than half the group and the number of statistics, as the method needs.
    wanted = F.greatest(F.lit(COVERAGE) * F.col("_n"), (F.col("_n") + len(_NAMES) + 1) / 2)
    # With a bound, the inner class counts; a group that has none keeps all of its rows.
    chosen = rings.filter(F.col("before") < wanted) if within is None else rings.filter(F.col("before") == 0)
    names = ["k", *[f"s{i}" for i in range(len(_NAMES))], *[f"p{i}{j}" for i, j in _PAIRS]]
    kept = chosen.groupBy("_group").agg(F.max("_n").alias("_n"), *[F.sum(n).cast("double").alias(n) for n in names])
    mean = [F.col(f"s{i}") / F.col("k") for i in range(len(_NAMES))]
    floors = [(f * STEP) ** 2 for f in VECTOR.values()]
    cov = lambda i, j: F.col(f"p{min(i, j)}{max(i, j)}") / F.col("k") - mean[i] * mean[j]
    matrix = F.array(*[F.array(*[F.greatest(cov(i, i), F.lit(floors[i])) + floors[i] / 16 if i == j else cov(i, j) for j in range(len(_NAMES))]) for i in range(len(_NAMES))])
    return _inverted(kept.select("_group", "_n", F.array(*mean).alias("_centre"), matrix.alias("_inverse")), "_inverse")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """``(_group, _n, _centre, _inverse)``: location and inverse scatter of each group's vectors."""
    groups = _start(rows)
    for _ in range(CONCENTRATIONS):
        groups = _estimate(rows, groups)
    return _estimate(rows, groups, INNER)


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row the key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and ``distance``.

    ``distance`` is the squared Mahalanobis distance, null where the base rules fail. A null text has no words and fails. Null languages
    and sources are groups of their own. In a group of few rows all of them make the estimate, so none is far
    from it. Texts are taken whole; rows that repeat are judged each. An empty table gives no rows.
    Other columns do not matter, whatever their names.
    """
    rows = cut(statistics_of(docs, key, text, lang, source), "statistics")
    passed = rows.filter("NOT base_failed")
    judged = join_unique(passed, robust_estimates(passed), ["_group"], "_n").withColumn("distance", _squared_distance())
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    fallen = rows.filter("base_failed").select(F.col("_key").alias(key), *shown, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.select(F.col("_key").alias(key), *shown, (F.col("distance") <= OUTER).alias("kept"), "distance").unionByName(fallen)
