"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Rows are told apart by ``_row_key``, which the first stage gives to each row and writes (a column
of that name in the input is replaced): rows without a ``doc_id`` and rows that repeat one are
judged each on its own, and only near-dedup removes copies.  Extra columns are carried along to
the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.llm.decontamination import find_contamination
from tablewash.llm.minhash import near_duplicates
from tablewash.llm.pieces import encode_texts
from tablewash.llm.quality import quality
from tablewash.llm.queries import piece_model
from tablewash.llm.store import written
from tablewash.llm.suffix import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ROW_KEY = "_row_key"
# Shorter than a passage of 50 words, which has about 310 bytes.
PASSAGE = 272


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    docs = written(docs.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed")
    good = quality(docs, ROW_KEY).where("kept").select(ROW_KEY)
    return docs.join(good, ROW_KEY, "left_semi").select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    An id counts before none; of rows that share the id the smallest hash of the text decides, then the row key.
    """
    groups = near_duplicates(docs, ROW_KEY).select(ROW_KEY, "component_id")
    names = docs.select(ROW_KEY, F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("hash"))
    first = groups.join(names, ROW_KEY).groupBy("component_id").agg(F.min(F.struct("unnamed", "doc_id", "hash", ROW_KEY)).alias("first"))
    return docs.join(first.select(f"first.{ROW_KEY}"), ROW_KEY, "left_semi").select(docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte in a string of ``PASSAGE`` bytes that stands anywhere else too is removed; all documents stay."""
    left = remove_repeats(docs, ROW_KEY, length=PASSAGE, rounds=1).select(ROW_KEY, F.col("kept_text").alias("text"))
    out = docs.drop("text").join(left, ROW_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ROW_KEY).select(ROW_KEY).distinct()
    return docs.join(found, ROW_KEY, "left_anti").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the best segmentation of each text, scores of the N best, and whether decoding gives the text back."""
    return encode_texts(docs, piece_model()).select("doc_id", "n_pieces", "scores", "digests", "decoded_equal", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good_texts),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("sentence_pieces", encode_pieces),
]

# The estimates, the sketches, the suffix order, the walks and the piece lattice cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
