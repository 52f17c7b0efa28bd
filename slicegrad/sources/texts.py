"""Edge lists, plain text files and row-wise feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.operators.sampling import merge_partitions, round_robin, sample_rows
from slicegrad.session import stored_bytes

#: Text of the vectors in a partition. A trainer that keeps them as vectors or stacked blocks needs some 25 times as much.
VECTOR_TEXT_BYTES = 8 << 20


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge list text ``src dst``, separated by blanks; empty lines and # comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    ends = F.split("line", r"\s+")
    edges = lines.where("line <> '' and not startswith(line, '#')")
    return edges.select(ends[0].cast("bigint").alias("src"), ends[1].cast("bigint").alias("dst"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string"))).write.text(path)


def sample_text(
    spark: SparkSession, source: str, target: str, fraction: float, seed: int = 42, keyed: bool = False
) -> None:
    """Copy a sample of the lines of a text; ``keyed`` by the line itself, every run copies the same lines."""
    sample_rows(spark.read.text(source), fraction, seed, ["value"] if keyed else None).write.text(target)


def rewrite_files(spark: SparkSession, source: str, target: str, n: int = 8) -> None:
    """Rewrite a text as ``n`` files of even size."""
    round_robin(spark.read.text(source), n).write.text(target)


def load_vectors(
    spark: SparkSession,
    path: str,
    num_features: int | None = None,
    partitions: int | None = None,
    shuffle: bool = True,
) -> DataFrame:
    """Row-wise ``(label, features VECTOR)`` for the row-partitioned trainers.

    With ``shuffle`` the rows are spread evenly over ``partitions``, or over more if these would be large; without it,
    existing splits are only merged. The caller keeps and frees them if they are read more than once.
    """
    reader = spark.read.format("libsvm")
    if num_features:
        reader = reader.option("numFeatures", str(num_features))
    rows = reader.load(path)
    if partitions and shuffle:
        return round_robin(rows, max(partitions, -(-stored_bytes(spark, path) // VECTOR_TEXT_BYTES)))
    return merge_partitions(rows, partitions) if partitions else rows
