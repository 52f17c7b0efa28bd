"""A column split of the points that is stored once and drawn from by any number of runs.

The cells lie in a table bucketed by feature into the model's partitions and sorted, in every bucket, by (chunk, row). A
chunk is a range of rows with a bounded number of cells. A group of mini-batches is drawn by sending its slots to the
cells, range by range of rows: they are met in their bucket and written to the batch's own bucketed table without a shuffle,
and where the slots hit only some chunks, the chunk statistics of the files skip the rest. So no run reads the row-wise
points again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicegrad.operators.columns import DEFAULT_CHUNK_CELLS, cell_chunks
from slicegrad.operators.sampling import draw_slots
from slicegrad.operators.statistics import Placement, SplitBatch, split_placement
from slicegrad.plans.batches import SLOT_COLUMNS, Profile, SplitReader, profile_points
from slicegrad.session import BROADCAST_BYTES, BROADCAST_ROW, cut_lineage, delete_path, scratch_path

#: Most chunks that a scan names; a draw that hits more reads them all.
CHUNKS_NAMED = 2000


def pieces_of(n_slots: int) -> int:
    """Ranges of rows so that the slots of each, drawn evenly, stay below three quarters of a broadcast."""
    return max(1, -(-4 * n_slots * (SLOT_COLUMNS * 8 + BROADCAST_ROW) // (3 * BROADCAST_BYTES)))


@dataclass
class ColumnStore:
    """``cold(feature, chunk, row_id, value)`` in its buckets, ``hot`` alike but spread by chunk, ``rows(row_id, label, chunk)``."""

    cold: DataFrame
    hot: DataFrame
    rows: DataFrame
    profile: Profile
    placement: Placement
    name: str
    paths: list[str] = field(default_factory=list)

    @property
    def sparkSession(self):  # noqa: N802 - as of a DataFrame
        return self.rows.sparkSession

    def drawn(self, slots: DataFrame, n_slots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``samples(t, slot, label)`` and the cold and hot cells ``(t, slot, feature, value)`` of ``slots(t, slot, row_id)``."""
        samples, cells = self.pieces(slots, n_slots)
        if len(cells) == 1:
            return samples, *cells[0]
        cut = zip(*[(cut_lineage(cold), cut_lineage(hot)) for cold, hot in cells])
        return samples, *[reduce(DataFrame.unionByName, tables) for tables in cut]

    def pieces(self, slots: DataFrame, n_slots: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
        """The samples, and the cold and hot cells in pieces, as in :meth:`drawn`.

        The cells come in pieces, one per range of rows whose slots a broadcast takes. A piece reads the chunks of its range,
        so all of them read the cells about once; each is to be a job of its own, which leaves its broadcast behind.
        """
        pieces = pieces_of(n_slots)
        width = -(-self.profile.n_rows // pieces)
        piece = F.expr(f"cast(row_id div {width} as int)")
        met = self.rows.join(F.broadcast(slots) if pieces == 1 else slots.hint("shuffle_hash"), "row_id")
        if pieces == 1:
            hit = [r.chunk for r in met.select("chunk").distinct().limit(CHUNKS_NAMED + 1).collect()]
            reach = [F.col("chunk").isin(hit) if len(hit) <= CHUNKS_NAMED else F.lit(True)]
        else:  # a drawn range has slots in nearly all of its chunks
            ends = self.rows.groupBy(piece.alias("piece")).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
            reach = [F.col("chunk").between(r.low, r.high) for r in ends.orderBy("piece").collect()]
        cells = []
        for k, chunks in enumerate(reach):
            near = F.broadcast(slots.where(piece == k) if pieces > 1 else slots)
            cells.append(tuple(
                table.where(chunks).join(near, "row_id").select("t", "slot", "feature", "value") for table in (self.cold, self.hot)
            ))
        return met.select("t", "slot", "label"), cells

    def reader(self, batch_size: int, iterations: int, seed: int) -> StoredReader:
        return StoredReader(self, batch_size, iterations, seed)

    def sampled(self, size: int, seed: int) -> SplitBatch:
        """Rows sampled with replacement, for a loss."""
        slots = draw_slots(self.sparkSession, self.profile.n_rows, size, 1, seed)
        samples, cold, hot = self.drawn(slots, size)
        return SplitBatch(samples.drop("t"), cold, hot)

    def close(self) -> None:
        """Delete the stored split."""
        self.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        while self.paths:
            delete_path(self.sparkSession, self.paths.pop())


def store_columns(
    points: DataFrame, *, classes: int = 2, num_features: int | None = None, columns: int = 16, partitions: int | None = None,
    profile: Profile | None = None, max_cells: int = DEFAULT_CHUNK_CELLS,
) -> ColumnStore:
    """Check and split ``points`` once. ``columns`` bounds the numbers per feature of the models to be trained.

    ``partitions`` are the models' partitions; by default as many as the session runs tasks, and more for many features.
    """
    from slicegrad.plans.train import model_partitions

    spark = points.sparkSession
    profile = profile or profile_points(points, classes, num_features)
    cores = spark.sparkContext.defaultParallelism
    partitions = partitions or max(cores, model_partitions(spark, profile.num_features, columns))
    placement = split_placement(points, columns, partitions)
    placed = points.join(cell_chunks(points, max_cells), "row_id")
    cells = placed.select("row_id", "chunk", F.inline("features"))
    near = F.broadcast(placement.hot)
    paths = [scratch_path(spark, name) for name in ("stored-cells", "stored-hot", "stored-rows")]
    name = f"sg_store_{uuid.uuid4().hex}"
    cold = cells.join(near, "feature", "left_anti").repartition(partitions, "feature").select("feature", "chunk", "row_id", "value")
    cold.write.option("path", paths[0]).bucketBy(partitions, "feature").sortBy("chunk", "row_id").saveAsTable(name)
    hot = cells.join(near, "feature", "left_semi").select("feature", "chunk", "row_id", "value")
    hot.repartition(partitions, "chunk").sortWithinPartitions("chunk", "row_id").write.parquet(paths[1])
    rows = placed.select("row_id", "label", "chunk").repartition(partitions, "chunk").sortWithinPartitions("row_id")
    rows.write.parquet(paths[2])
    read = [spark.read.schema(df.schema).parquet(path) for df, path in ((hot, paths[1]), (rows, paths[2]))]
    return ColumnStore(spark.table(name), *read, profile, placement, name, paths)


class StoredReader(SplitReader):
    """Split mini-batches drawn from a :class:`ColumnStore`; neither points nor cells are shuffled."""

    def __init__(self, store: ColumnStore, batch_size: int, iterations: int, seed: int):
        super().__init__(store, store.profile.n_rows, batch_size, iterations, seed, store.placement)

    def _write(self, first: int) -> None:
        store, spark, parts = self.points, self.points.sparkSession, self.placement.partitions
        count = min(self.group, self.iterations - first)
        slots = draw_slots(spark, self.n_rows, self.batch_size, count, self.seed, first)
        samples, cells = store.pieces(slots, count * self.batch_size)
        self.close()
        self._table = self._by_iteration(samples, "batches", "slot int, label double, t int", count)
        paths, name = [scratch_path(spark, kind) for kind in ("hot-cells", "cells")], f"sg_cells_{uuid.uuid4().hex}"
        self._paths += paths
        self._name = name
        for cold, hot in cells:
            self._add(hot, paths[0], count)
            cold.write.mode("append").option("path", paths[1]).bucketBy(parts, "feature").sortBy("t").saveAsTable(name)
        self._hot = spark.read.schema("feature int, slot int, value double, t int").parquet(paths[0])
        self._cold, self._first = spark.table(name), first
