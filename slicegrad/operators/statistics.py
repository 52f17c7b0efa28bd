"""Per-sample statistics and per-feature gradient sums, the two aggregations of an iteration.

A batch for a small model, or a whole data set to score, is row-wise: ``(t, slot, label, features)``. A batch for a large
model is a :class:`SplitBatch`, whose cells already lie where their weights lie. ``weights`` has one row per feature.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicegrad.session import BROADCAST_BYTES, BROADCAST_ROW, bounded_broadcast, fits_broadcast


@dataclass
class Placement:
    """How cells meet weights.

    ``hot`` is None when the whole model is small enough to be sent to every task; the cells then stay
    where they are. Otherwise cells are shuffled to the model's partitions, except the cells of the few
    features listed in ``hot``: those stay in place and their weight rows come to them, so a feature that
    occurs in most samples cannot overload one partition.
    """

    partitions: int
    hot: DataFrame | None = None

    @property
    def small(self) -> bool:
        return self.hot is None


@dataclass
class SplitBatch:
    """A batch split by feature.

    ``cold(t, slot, feature, value)`` is stored in the model's partitions, by the same hash of the feature, so neither it
    nor the model is shuffled; ``hot`` has the same columns, spread evenly; ``samples(slot, label)`` has every slot.
    """

    samples: DataFrame
    cold: DataFrame
    hot: DataFrame


HOT_PER_PARTITION = 4
#: Counters of a task per feature that can be hot.
SKETCH_FACTOR = 16


def plan_placement(
    num_features: int, columns: int, partitions: int, points: DataFrame | None = None
) -> Placement:
    """Choose the placement for a model of ``num_features`` features with ``columns`` numbers each.

    A feature is hot when it holds more than ``1 / limit`` of all cells, so there are fewer than ``limit``
    such features. The limit is four per partition, or less if their weights would not fit a broadcast.
    """
    if fits_broadcast(num_features, columns):
        return Placement(partitions)
    if points is None:
        raise ValueError("a model too large to broadcast needs the points, to find its hot features")
    return split_placement(points, columns, partitions)


def heavy_features(points: DataFrame, limit: int) -> tuple[list[int], int]:
    """Features that may hold more than ``1 / limit`` of all cells, at most ``limit`` of them, and the number of cells.

    Every task keeps ``SKETCH_FACTOR * limit`` counters, whatever the number of features, and summaries are merged in two
    steps, so no count per feature is shuffled. Counts are never too low and too high by less than a quarter of that share:
    all heavy features are found, and with them perhaps some that are nearly so.
    """
    counters = min(1_000_000, SKETCH_FACTOR * limit)
    group = F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")
    summaries = points.select(group, F.inline("features")).groupBy("part").agg(
        F.expr(f"approx_top_k_accumulate(feature, {counters})").alias("summary"), F.count("*").alias("n")
    )
    one = (F.col("part") * 0).alias("one")  # a key, since the function cannot combine what an empty partition has
    merged = summaries.groupBy(one).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"), F.sum("n").alias("n"))
    found = merged.select(F.expr(f"approx_top_k_estimate(summary, {limit})").alias("top"), "n").first()
    if found is None:
        return [], 0
    return [item for item, count in found["top"] if count * limit > found["n"]], found["n"]


def split_placement(points: DataFrame, columns: int, partitions: int) -> Placement:
    """The placement for a large model: finds the hot features of these points in one aggregation over the cells."""
    limit = min(HOT_PER_PARTITION * partitions, BROADCAST_BYTES // (columns * 8 + BROADCAST_ROW))
    heavy, _ = heavy_features(points, limit)
    # a table of Spark's own: one made of Python rows would start Python workers wherever it is read, so in every iteration
    return Placement(partitions, points.sparkSession.createDataFrame(pa.table({"feature": pa.array(heavy, pa.int32())})))


def split_cells(batch: DataFrame, placement: Placement, *extra: str) -> tuple[DataFrame | None, DataFrame]:
    """``(cold, hot)`` cells of a batch. Cold cells are shuffled to the model's partitions."""
    cells = batch.select("slot", *extra, F.inline("features"))
    if placement.small:
        return None, cells
    mark = F.broadcast(placement.hot.withColumn("is_hot", F.lit(True)))
    marked = cells.join(mark, "feature", "left")
    cold = marked.where("is_hot is null").drop("is_hot").repartition(placement.partitions, "feature")
    return cold, marked.where("is_hot").drop("is_hot")


def hot_weights(weights: DataFrame, placement: Placement) -> DataFrame:
    """The weight rows sent to the hot cells; all of them when the model is small."""
    if placement.small:
        return F.broadcast(weights)
    return F.broadcast(weights.join(F.broadcast(placement.hot), "feature", "left_semi"))


class SampleStats:
    """Sum ``terms`` per slot: ``(slot, label, <stats>)``, with zeros for a sample without cells.

    What is exchanged is one partial row per (task, slot), whatever the size of the model. The column
    expressions are built once and reused by every iteration. The terms may refer to ``known`` statistics, one row per
    slot, of an earlier pass; these go to the cells, and are returned with the new ones.
    """

    def __init__(self, terms: dict[str, Column], placement: Placement, batch_size: int | None = None):
        self.placement, self.batch_size = placement, batch_size
        zeros = [F.lit(0.0).alias(name) for name in terms]
        self._filled = [F.coalesce(term, F.lit(0.0)).alias(name) for name, term in terms.items()]
        self._met = [F.lit(None).cast("double").alias("label")] + [t.alias(n) for n, t in terms.items()]
        self._own = ["slot", "label", *zeros]
        self._totals = [F.max("label").alias("label")] + [F.sum(name).alias(name) for name in terms]
        self._cells = ["slot", "label", F.inline_outer("features")]

    def __call__(self, batch: DataFrame | SplitBatch, weights: DataFrame, known: DataFrame | None = None) -> DataFrame:
        sums = self._summed(batch, weights, known)
        return sums if known is None else known.join(sums.drop("label"), "slot")

    def _informed(self, cells: DataFrame, known: DataFrame | None) -> DataFrame:
        """Cells, or rows of cells, with the known statistics of their slots."""
        if known is None:
            return cells
        known = known.drop("label")
        if self.batch_size:  # of a batch, whose size is known
            known = bounded_broadcast(known, self.batch_size, len(known.columns))
        return cells.join(known, "slot")

    def _summed(self, batch: DataFrame | SplitBatch, weights: DataFrame, known: DataFrame | None) -> DataFrame:
        placement = self.placement
        if isinstance(batch, SplitBatch):
            # A batch is smaller than a large model: hash its cells and stream the model past them, unsorted.
            cold, hot = (self._informed(cells, known) for cells in (batch.cold, batch.hot))
            samples, cold, model = batch.samples, cold.hint("shuffle_hash"), weights
        elif placement.small:
            rows = self._informed(batch, known)
            names = [] if known is None else [c for c in known.columns if c not in ("slot", "label")]
            cells = rows.select(*names, *self._cells).join(F.broadcast(weights), "feature", "left")
            return cells.select("slot", "label", *self._filled).groupBy("slot").agg(*self._totals)
        else:
            # Rows of any number: hash the model, whose partitions are of a known size, and stream the cells past it.
            cold, hot = (self._informed(cells, known) for cells in split_cells(batch, placement))
            samples, model = batch, weights.hint("shuffle_hash")
        parts = samples.select(*self._own)
        for cells, table in ((cold, model), (hot, hot_weights(weights, placement))):
            parts = parts.unionByName(cells.join(table, "feature").select("slot", *self._met))
        return parts.groupBy("slot").agg(*self._totals)


class FeatureSums:
    """Sum ``sums`` per feature over the batch: ``(feature, t, <sums>)``, as one table or as one of cold and one of hot features.

    The coefficients, one row per slot, are broadcast while the batch is small enough for that. Cold cells already lie in
    their feature's partition, and so do their sums; hot ones are summed per task before they move, to one row per hot feature.
    Sums that refer to the weights get them where the cells lie.
    """

    def __init__(
        self, coefs: dict[str, Column], sums: dict[str, Column], placement: Placement, batch_size: int,
        see_weights: bool = False,
    ):
        self.placement, self.batch_size, self.width, self.see_weights = placement, batch_size, len(coefs) + 1, see_weights
        self._coefs = ["slot", *[c.alias(name) for name, c in coefs.items()]]
        self._addends = ["feature", "t", *[c.alias(name) for name, c in sums.items()]]
        self._totals = [F.max("t").alias("t")] + [F.sum(name).alias(name) for name in sums]

    def _grouped(self, cells: DataFrame, coefs: DataFrame, weights: DataFrame | None) -> DataFrame:
        met = cells.join(coefs, "slot")
        if self.see_weights:
            met = met.join(weights, "feature")
        return met.select(*self._addends).groupBy("feature").agg(*self._totals)

    def _factors(self, stats: DataFrame) -> DataFrame:
        return bounded_broadcast(stats.select(*self._coefs), self.batch_size, self.width)

    def __call__(self, batch: DataFrame, stats: DataFrame, weights: DataFrame | None = None) -> DataFrame:
        near = F.broadcast(weights) if self.see_weights else None
        return self._grouped(batch.select("slot", "t", F.inline("features")), self._factors(stats), near)

    def split(self, batch: SplitBatch, stats: DataFrame, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Sums of the cold and of the hot features."""
        coefs, cold, near = self._factors(stats), batch.cold, None
        if self.see_weights:
            cold, near = cold.hint("shuffle_hash"), hot_weights(weights, self.placement)
        return self._grouped(cold, coefs, weights), self._grouped(batch.hot, coefs, near)


def sample_stats(batch: DataFrame, weights: DataFrame, terms: dict, placement: Placement) -> DataFrame:
    return SampleStats(terms, placement)(batch, weights)


def long_weights(weights: DataFrame, names: list[str], state: bool = False) -> DataFrame:
    """Wide weight rows as ``(feature, k, w[, m, v])``, one row per weight."""
    def cell(k: int, name: str):
        fields = [F.lit(k).alias("k"), F.col(name).alias("w")]
        if state:
            fields += [F.col(f"m_{name}").alias("m"), F.col(f"v_{name}").alias("v")]
        return F.struct(*fields)

    return weights.select("feature", F.inline(F.array(*[cell(k, name) for k, name in enumerate(names)])))
