"""PageRank by propagating rank changes until none exceeds the tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicegrad.operators.statistics import HOT_PER_PARTITION
from slicegrad.session import cut_lineage, loop_settings, written

#: What a round sends is summed per partition and vertex first, so it grows with the partitions up to the edges' number. A
#: partition therefore holds many pairs, 240 MB as columns, of which a round keeps only the sums.
EDGES_PER_PARTITION = 10_000_000
#: Rounds planned as one job. The second reads the first twice, but both reads share its shuffle.
ROUNDS_PER_JOB = 2


def count_pairs(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``pairs(src, dst, n)`` of the edges, ``degrees(src, degree, fan)`` and the number of pairs.

    Parallel edges count separately in ``degree`` and are folded into one pair, so later rounds read each pair once. Edges
    are read once; both sums are combined before they are shuffled, so a hub is a few rows when its degree is summed. Pairs
    are by far the most rows, so they are written as columns, which take a fraction of a checkpoint's bytes.
    """
    pairs = written(edges.groupBy("src", "dst").agg(F.count("*").alias("n")), "pairs")
    fan = F.count("*").alias("fan")
    degrees = cut_lineage(pairs.groupBy("src").agg(F.sum("n").alias("degree"), fan))
    return pairs, degrees, degrees.agg(F.sum("fan")).first()[0] or 0


def weigh_edges(edges: DataFrame) -> DataFrame:
    """``(src, dst, share)``: the share of a vertex's rank that flows along its edges to ``dst``."""
    pairs, degrees, _ = count_pairs(edges)
    return _shares(pairs, degrees)


def _shares(pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    return pairs.join(degrees, "src").select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))


def pagerank(
    edges: DataFrame,
    tol: float = 0.001,
    reset: float = 0.15,
    max_rounds: int | None = None,
    normalize: bool = True,
    check_every: int = 4,
    partitions: int | None = None,
) -> DataFrame:
    """Ranks ``(id, rank)`` of all vertices of ``edges(src, dst)``.

    A vertex starts at ``reset``. In every round, each vertex whose last change exceeds ``tol`` passes
    ``1 - reset`` times that change on along its out-edges; the others stay silent, so the work of a round
    shrinks with the number of moving vertices. Rank that reaches a vertex without out-edges stays there.
    With ``normalize`` the ranks are scaled to sum to the number of vertices.

    Convergence is looked up only every ``check_every`` rounds, since a round after convergence changes
    nothing. After every ``ROUNDS_PER_JOB`` rounds the state is cut into the checkpoint folder.
    """
    spark = edges.sparkSession
    pairs, degrees, n_edges = count_pairs(edges)
    partitions = partitions or max(
        min(spark.sparkContext.defaultParallelism, n_edges // 20_000 + 1), n_edges // EDGES_PER_PARTITION + 1
    )
    with loop_settings(spark, partitions):
        cold, hot = weigh_pairs(pairs, degrees, n_edges, partitions)
        # Read in every round: from memory, or made anew from the written pairs where a cached part was lost.
        edges_kept = [cold.persist()] + ([hot[0].persist()] if hot else [])
        ids = degrees.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id")))
        state = ids.distinct().select(
            "id", F.lit(float(reset)).alias("rank"), F.lit(float(reset)).alias("delta")
        )
        state = cut_lineage(state.repartition(partitions, "id"))
        done = 0
        while max_rounds is None or done < max_rounds:
            fused = ROUNDS_PER_JOB if max_rounds is None else min(ROUNDS_PER_JOB, max_rounds - done)
            for _ in range(fused):
                state = _round(state, cold, hot, tol, 1.0 - reset)
            state = cut_lineage(state)
            done += fused
            if done % check_every == 0 and state.agg(F.max(F.abs("delta"))).first()[0] <= tol:
                break
        for kept in edges_kept:
            kept.unpersist()
    ranks = state.select("id", "rank")
    if not normalize:
        return ranks
    total = state.agg((F.count("*") / F.sum("rank")).alias("scale")).first()[0]
    return ranks.select("id", (F.col("rank") * total).alias("rank"))


def weigh_pairs(pairs: DataFrame, degrees: DataFrame, n_pairs: int, partitions: int):
    """Weighted pairs ``(src, dst, share)``: those of ordinary vertices by source, and ``(those of hubs, hubs)`` or None.

    A hub holds more than ``1 / (4 * partitions)`` of all pairs and would overload the partition of its source; there are
    at most four per partition, so their degrees and changes are safe to broadcast, and their pairs stay spread. Hubs are
    known before the degrees are joined, and ordinary pairs keep the partitioning of that join in every round. Nothing is
    written: the caller keeps what it reads more than once.
    """
    limit = HOT_PER_PARTITION * partitions
    found = degrees.where(F.col("fan") * limit > n_pairs).select("src", "degree").take(limit) if partitions > 1 else []
    weights = degrees.select("src", "degree").repartition(partitions, "src")
    if not found:
        return _shares(pairs.repartition(partitions, "src"), weights), None
    hubs = F.broadcast(pairs.sparkSession.createDataFrame([tuple(row) for row in found], "src bigint, degree bigint"))
    cold = pairs.join(hubs, "src", "left_anti").repartition(partitions, "src")
    hot = _shares(pairs, hubs).repartition(partitions)
    return _shares(cold, weights), (hot, hubs.select("src"))


def _round(state: DataFrame, cold: DataFrame, hot, tol: float, damping: float) -> DataFrame:
    moving = state.where(F.abs("delta") > tol).select(F.col("id").alias("src"), "delta")
    # Cold edges and the state are partitioned alike, so this join moves neither side.
    sent = cold.join(moving.hint("shuffle_hash"), "src").select(
        F.col("dst").alias("id"), (F.col("delta") * F.col("share")).alias("part")
    )
    if hot is not None:
        hub_edges, hubs = hot
        changes = F.broadcast(moving.join(F.broadcast(hubs), "src", "left_semi"))
        sent = sent.union(
            hub_edges.join(changes, "src").select(
                F.col("dst").alias("id"), (F.col("delta") * F.col("share")).alias("part")
            )
        )
    received = sent.groupBy("id").agg((F.sum("part") * damping).alias("change"))
    return state.join(received.hint("shuffle_hash"), "id", "left").select(
        "id",
        (F.col("rank") + F.coalesce("change", F.lit(0.0))).alias("rank"),
        F.coalesce("change", F.lit(0.0)).alias("delta"),
    )


def top_ranks(ranks: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest ranks; ties go to the smaller id. A distributed top-n, not a full sort."""
    return ranks.orderBy(F.desc("rank"), "id").limit(n)
