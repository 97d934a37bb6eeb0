"""A training-data pipeline over ``documents``: classify, dedup lines, dedup near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet into the shared
folder and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm import bpe, linededup, mixing, quality_cnn, simhash
from lumenlake.llm.common import materialise, scratch, spent
from lumenlake.llm.queries import PATTERN, RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 0 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_cnn.classify_quality(docs, labels).where("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came earlier go; a document that had lines and keeps none goes too."""
    out = linededup.dedup_lines(docs).where("n_removed < n_lines OR n_lines = 0")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: 0.8 or more of their shingles of five words are shared. The
    thin op9 query keeps its contract's three words and three bits; this stage takes five words and that similarity."""
    return simhash.near_copy_dedup(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix reads it."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the checksum of what they decode to. part and row keep the order in which the
    mixed documents lie in their files: sorted by both, rows come as training reads them."""
    try:
        docs.select("_metadata.row_index")
        place = [F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("row")]
    except AnalysisException:  # docs are no files, and in no order
        place = [F.lit(None).cast("string").alias("part"), F.lit(None).cast("long").alias("row")]
    out = bpe.encode_documents(docs.select("doc_id", "source", "text", *place), RANKS, PATTERN)
    return out.select("doc_id", "source", "part", "row", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier's network and the tokeniser cannot be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch() as kept:  # what a stage has written for itself goes when its result stands
            out = materialise(stage(spark, docs, sf_dir), f"stage{k}")
            kept.append(out)
        if k:
            spent(docs)
        docs = out
    return docs
