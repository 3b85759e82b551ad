"""The corpus pipeline: language, near copies, repeated passages, source mix and token ids, one stage after the other.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last have the columns of ``documents``.
``run`` writes what each stage returns to the shared folder and reads it again as input of the next, so
a lost executor costs a part of one stage. Stages take every row and every whole text of what the
stage before kept. Repeated rows, nulls and empty tables are treated as the operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridterrain.llm.bpe import add_encoding
from gridterrain.llm.jaccard import without_near_copies
from gridterrain.llm.language import UNKNOWN, fit, label_languages
from gridterrain.llm.mixing import mix_sources, source_counts, tempered_weights
from gridterrain.llm.queries import MIX_EXPONENT, MIX_SEED, tokenizer_path
from gridterrain.llm.substrings import remove_repeats
from gridterrain.scratch import cut

# A text whose best language has a lower mean probability is rejected, as is one without letters. Four
# languages leave 0.25 to a guess; texts of one language are far above this bound.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a missing ``lang`` gets it."""
    labelled = label_languages(docs, fit(docs)).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return labelled.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that of the smallest id; of rows that repeat it, one."""
    return without_near_copies(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; ``n_chars`` follows the text. Texts left empty stay."""
    left = remove_repeats(docs)
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate, in a global random order."""
    return mix_sources(docs, tempered_weights(source_counts(docs), MIX_EXPONENT), seed=MIX_SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, packed and counted, besides the document's other columns."""
    coded = add_encoding(docs, tokenizer_path())
    return coded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long")).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_to_weights),
    ("bpe_encode", encode),
]

# A trained network and recursive sampling are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
