"""Mini-batch draws, row samples and repartitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.functions.hashing import draw_index, poisson, unit


def draw_slots(
    spark: SparkSession,
    n_rows: int,
    batch_size: int,
    iterations: int = 1,
    seed: int = 42,
    first: int = 0,
) -> DataFrame:
    """Mini-batch draws with replacement: ``slots(t, slot, row_id)``.

    Each slot of each iteration draws one row number out of ``0..n_rows-1``. A row drawn twice fills two
    slots and so counts twice. The draw depends only on ``(seed, t, slot)``, so every rerun agrees.
    """
    if n_rows <= 0:
        raise ValueError("cannot draw a batch from an empty table")
    ids = spark.range(first * batch_size, (first + iterations) * batch_size)
    t = F.expr(f"cast(id div {batch_size} as int)")
    slot = (F.col("id") % batch_size).cast("int")
    return ids.select(t.alias("t"), slot.alias("slot")).select(
        "t", "slot", draw_index(n_rows, seed, F.col("t"), F.col("slot")).alias("row_id")
    )


def minibatch_slots(
    spark: SparkSession, n_rows: int, batch_size: int, t: int = 0, seed: int = 42
) -> DataFrame:
    """The draw of a single iteration: ``slots(slot, row_id)``."""
    return draw_slots(spark, n_rows, batch_size, 1, seed, t).select("slot", "row_id")


def batch_labels(labels: DataFrame, slots: DataFrame) -> DataFrame:
    """Labels of the drawn rows, one row per slot. Spark sizes ``slots`` itself and picks the join."""
    return slots.join(labels, "row_id").select("slot", "row_id", "label")


def batch_cells(feats: DataFrame, slots: DataFrame) -> DataFrame:
    """Cells of the drawn rows: ``feats`` joined with the slots; duplicates are kept."""
    return slots.join(feats, "row_id").select("slot", "label", "feature", "value")


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Bernoulli sample without replacement.

    With ``key`` a row's fate depends only on the seed and its key, whatever the partitioning, so every rerun agrees; rows
    of equal keys share their fate. Without it Spark's own generator draws for each row.
    """
    if key is None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    return df.where(unit(seed, *_key(key)) < fraction)


def resample(df: DataFrame, fraction: float, seed: int = 42, key: list[str] | None = None) -> DataFrame:
    """Down- or over-sample with replacement: a Poisson number of copies of mean ``fraction`` per row.

    A fraction of exactly one keeps the rows as they are, zero keeps none. ``key`` as in :func:`sample_rows`.
    """
    if fraction == 1.0:
        return df
    if fraction <= 0.0:
        return df.limit(0)
    if key is None:
        return df.sample(withReplacement=True, fraction=fraction, seed=seed)
    copies = F.explode(F.array_repeat(F.lit(0), poisson(fraction, seed, *_key(key))))
    return df.select("*", copies.alias("_sg_copy")).drop("_sg_copy")


def _key(names: list[str]) -> list:
    return [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("null")) for name in names]


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """Even redistribution over ``n`` partitions."""
    return df.repartition(n)


def merge_partitions(df: DataFrame, n: int) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(n)
