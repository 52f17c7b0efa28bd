"""A training corpus from raw documents: good texts, no near copies, no benchmark passages, mixed, as token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and reread for the next
one. All but the last return the columns of ``documents``. ``run`` applies the stages to the table ``documents``.

Defined results: null texts count as empty in every stage; an empty text is scored like others, is a copy of every other
empty text, shares no benchmark passage, and is drawn like others; null ids are no training rows and are kept, after
documents with ids where one of several copies stays; equal rows are copies; null sources are a source of their own; an
empty table passes every stage and gives no rows; further columns, whatever their names, are carried up to the last stage.
Texts of any length are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.llm import mixing, pu_quality, simhash_rings, spaced_seeds, token_files
from slicegrad.llm.common import fresh, saved
from slicegrad.llm.queries import table, tokenizer

SHINGLE = 5


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and the trusted labels, accepts."""
    return pu_quality.good_documents(docs, pu_quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, over shingles of five words."""
    return simhash_rings.keep_one(docs, shingle=SHINGLE)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return spaced_seeds.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    copies = mixing.mix(docs, mixing.source_rates(docs))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def token_id_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as token files in a shuffled order, copies apart; one row per document as read back.

    The order is a hash of the text and a number among equal texts, which is drawn from the row itself, so copies of one
    document do not follow each other.
    """
    order, twin = fresh(docs, "sg_order", "sg_twin")
    numbered = docs.withColumn(twin, F.monotonically_increasing_id())
    ordered = numbered.withColumn(order, F.xxhash64("doc_id", "text", twin)).drop(twin)
    read = token_files.token_file_digest(ordered, tokenizer("word_bpe_49k.json"), order_by=[order, "doc_id"])
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


STAGES = [
    ("quality classifier", good_texts),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("mixing sources", mixed),
    ("token files", token_id_files),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
