"""Operator 11: a Merkle manifest of documents, with a proof for every document.

Rows are the leaves of one tree for each part (language), in the order of the key; the subroots of the parts, in the
order of the parts, are the leaves of one more tree. Runs of ``FANOUT`` consecutive nodes are hashed into their
parent, the last run of a level as it is, until one node is left.

No task sees a tree or a level. Each level is a table of (tree, position, digest). Lag and lead columns of the
fixed offsets 1 to ``FANOUT - 1``, masked by the slot within the run and by the length of the run, hold the siblings; the first
child of each run hashes its parent. Windows are dealt by run, so every window has ``FANOUT`` rows at most, however
large a part is. Paths go down again from the roots, one join a level on the same runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridterrain.operators.rows import number_rows
from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut

FANOUT = 8
# A tree is named by whether its part is known and by the part; a run by its tree and number.
_TREE = ["_known", "_name"]


def digest(data: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    """Digest of a row's values in their order."""
    return digest(F.concat(*[field(v) for v in values]))


def hex_text(digests: Column) -> Column:
    """One or more digests as lowercase hexadecimal text."""
    return F.lower(F.hex(digests))


def _parent(digests: Column) -> Column:
    return digest(hex_text(digests))


def _shrunk(n: Column) -> Column:
    """Number of nodes of the next level; one node stays as it is."""
    return F.ceil(n / F.lit(FANOUT)).cast("long")


def _with_siblings(level: DataFrame) -> DataFrame:
    """Nodes with ``_left`` and ``_right``: the digests before and after them in their run, joined."""
    slot = F.col("_pos") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("_n") - (F.col("_pos") - slot))
    by = Window.partitionBy(*_TREE, "_run").orderBy("_pos")
    none = F.lit(b"")
    before = [F.when(slot >= k, F.lag("_digest", k).over(by)).otherwise(none) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("_digest", k).over(by)).otherwise(none) for k in range(1, FANOUT)]
    runs = level.withColumn("_run", F.floor(F.col("_pos") / FANOUT).cast("long"))
    return runs.select("*", F.concat(*before).alias("_left"), F.concat(*after).alias("_right"))


def _parents(level: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes the run. A tree with one node keeps it."""
    first = _with_siblings(level).filter(F.col("_pos") % FANOUT == 0)
    hashed = F.when(F.col("_n") > 1, _parent(F.concat("_digest", "_right"))).otherwise(F.col("_digest"))
    return first.select(*_TREE, F.col("_run").alias("_pos"), _shrunk(F.col("_n")).alias("_n"), hashed.alias("_digest"))


def _own_step() -> Column:
    """A node's step of a path: none where the tree has no other node."""
    step = F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
    return F.when(F.col("_n") > 1, step).otherwise(F.slice(step, 1, 0))


def _levels(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Tables of all levels from the leaves to the roots; ``most`` is the size of the largest tree."""
    levels = [leaves]
    while most > 1:
        levels.append(cut(_parents(levels[-1]), "merkle"))
        most = -(-most // FANOUT)
    return levels


def _with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Leaves with their path to the top; ``above`` has a row ``(tree, _up, subroot, root)`` for each tree."""
    above = above.withColumn("_run", F.lit(0).cast("long"))
    for level in reversed(levels):
        joined = _with_siblings(level).join(above, [*_TREE, "_run"]).withColumn("_up", F.concat(_own_step(), F.col("_up")))
        above = joined.select(*_TREE, F.col("_pos").alias("_run"), "_up", "subroot", "root")
    return joined


def _numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """Leaves with their position and number in their tree. The sizes of the trees decide how they are joined."""
    rows = number_rows(leaves, *_TREE, *order, name="_row")
    trees = rows.groupBy(*_TREE).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    return join_unique(rows, trees, _TREE, "_n").withColumn("_pos", F.col("_row") - F.col("_first")).drop("_row", "_first")


def _largest(numbered: DataFrame) -> int:
    return numbered.agg(F.max("_n")).first()[0] or 0


def merkle_proofs(leaves: DataFrame, key: str, part: str, leaf: str, held: str) -> DataFrame:
    """Per leaf its subroot, root, path and the root that its ``held`` digest gives along the original path.

    ``leaf`` and ``held`` are digests of 32 bytes, ``held`` of the row as it is now. Returns the key,
    ``leaf``, ``held``, ``subroot``, ``root``, ``path`` (an array of ``(left, right)`` digests from the leaf's run up to the root's) and
    ``folded_root``. Leaves ascend by key, nulls first, then by digest; a null part is a tree of its own, the
    first one, and parts ascend bytewise. Rows that repeat are leaves each. An empty table gives no rows.
    Other columns of the input do not matter, whatever their names.
    """
    rows = cut(
        leaves.select(
            F.col(part).isNotNull().alias("_known"), F.coalesce(F.col(part), F.lit("")).alias("_name"), F.col(key).alias("_key"),
            F.col(leaf).alias("_digest"), F.col(held).alias("_held"), F.monotonically_increasing_id().alias("_copy"),
        ),
        "leaves",
    )
    numbered = _numbered(rows, "_key", "_digest", "_copy")
    levels = _levels(numbered, _largest(numbered))
    subroots = levels[-1].select(F.lit(True).alias("_known"), F.lit("").alias("_name"), F.struct(*_TREE).alias("_tree"), "_digest")
    top = cut(_numbered(subroots, "_tree"), "merkle")
    tops = _levels(top, _largest(top))
    root = tops[-1].select(*_TREE, F.array().cast("array<struct<left:binary,right:binary>>").alias("_up"), F.lit(b"").alias("subroot"), F.col("_digest").alias("root"))
    above = _with_paths(tops, root).select("_tree.*", "_up", F.col("_digest").alias("subroot"), "root")
    folded = F.aggregate("path", F.col("_held"), lambda node, step: _parent(F.concat(step["left"], node, step["right"])))
    proofs = _with_paths(levels, above).withColumnRenamed("_up", "path")
    return proofs.select(F.col("_key").alias(key), F.col("_digest").alias("leaf"), F.col("_held").alias("held"), "subroot", "root", "path", folded.alias("folded_root"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: hex_text(F.concat(s["left"], s["right"]))), ""))
