"""Drawing many mini-batches with one pass over the data."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicegrad.operators.sampling import draw_slots
from slicegrad.operators.statistics import Placement, SplitBatch
from slicegrad.session import delete_path, fits_broadcast, scratch_path

#: Samples drawn per pass over the data, or as many as the data has rows. A pass costs a scan and, for more slots than a
#: broadcast takes, a shuffle of the rows; it leaves about as many rows as it draws.
SLOTS_PER_PASS = 1_500_000
#: Columns of a slot.
SLOT_COLUMNS = 3
#: Slots and points that one task of a shuffled draw should hold.
SLOTS_PER_TASK = 500_000
ROWS_PER_TASK = 1_000_000
ROWS_PER_FILE = 100_000


@dataclass
class Profile:
    """Facts about a set of points, from one aggregation."""

    n_rows: int
    num_features: int


def profile_points(points: DataFrame, classes: int, num_features: int | None = None) -> Profile:
    """Count the rows and check ids and labels; find the feature count if it was not given.

    Row ids must be exactly ``0..N-1`` for the draw to be uniform. Labels must be ``0..classes-1``.
    """
    label = F.col("label")
    bad = (label < 0) | (label >= classes) | (label != F.floor(label)) | label.isNull()
    facts = [
        F.count("*").alias("n"),
        F.count_if(bad).alias("bad"),
        F.min("row_id").alias("low"),
        F.max("row_id").alias("high"),
    ]
    indices = F.col("features")["feature"]  # of all cells
    facts += [F.max(F.array_max(indices)).alias("top"), F.min(F.array_min(indices)).alias("bottom")]
    found = points.agg(*facts).first()
    if not found["n"]:
        raise ValueError("no rows to train on")
    if found["bad"]:
        raise ValueError(f"{found['bad']} labels are not one of 0..{classes - 1}")
    if found["low"] != 0 or found["high"] != found["n"] - 1:
        raise ValueError("row ids must be dense, from 0 to the row count minus one")
    if found["bottom"] is not None and found["bottom"] < 0:
        raise ValueError(f"feature {found['bottom']} is negative")
    if num_features is not None and found["top"] is not None and found["top"] >= num_features:
        raise ValueError(f"feature {found['top']} does not fit into {num_features} features")
    if num_features is None:
        num_features = (found["top"] if found["top"] is not None else 0) + 1
    return Profile(found["n"], num_features)


def gather(points: DataFrame, slots: DataFrame, n_slots: int, n_rows: int) -> DataFrame:
    """Fetch the drawn rows: ``(t, slot, label, features)``.

    Slots that a broadcast takes go to the points, which are scanned where they lie
    and only drawn rows move. A larger draw is joined by row id, which is unique in the points, over
    partitions sized by both sides, whatever the setting a loop has made for its model; the slots of a
    partition are hashed, and the points stream past them unsorted.
    """
    if fits_broadcast(n_slots, SLOT_COLUMNS):
        slots = F.broadcast(slots)
    else:
        cores = points.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, n_slots // SLOTS_PER_TASK + 1, n_rows // ROWS_PER_TASK + 1)
        points, slots = points.repartition(parts, "row_id"), slots.repartition(parts, "row_id").hint("shuffle_hash")
    return points.join(slots, "row_id").select("t", "slot", "label", "features")


class BatchReader:
    """Mini-batches ``0..iterations-1``, materialised a group at a time.

    Scanning all points for every iteration would make an iteration as dear as a pass over the data. The
    rows of a whole group of iterations are therefore fetched by one join and written, one folder per
    iteration, to the shared checkpoint folder; an iteration then reads only its own rows. The written
    table also survives the loss of executors.
    """

    def __init__(
        self, points: DataFrame, n_rows: int, batch_size: int, iterations: int, seed: int,
        rows_per_file: int = ROWS_PER_FILE,
    ):
        self.points, self.n_rows, self.batch_size = points, n_rows, batch_size
        self.iterations, self.seed = iterations, seed
        self.files = -(-batch_size // rows_per_file)
        self.group = max(1, min(iterations, max(SLOTS_PER_PASS, n_rows) // batch_size))
        self._first, self._table, self._paths = None, None, []

    def _tasks(self, count: int) -> int:
        """Write tasks of ``count`` iterations: enough for the rows, and never more than there are files."""
        cores = self.points.sparkSession.sparkContext.defaultParallelism
        return min(count * self.files, cores + count * self.batch_size // ROWS_PER_FILE)

    def _write(self, first: int) -> None:
        spark = self.points.sparkSession
        count = min(self.group, self.iterations - first)
        slots = draw_slots(spark, self.n_rows, self.batch_size, count, self.seed, first)
        rows = gather(self.points, slots, count * self.batch_size, self.n_rows)
        self.close()
        schema = "slot int, label double, features array<struct<feature:int,value:double>>, t int"
        self._table = self._by_iteration(rows, "batches", schema, count)
        self._first = first

    def _by_iteration(self, rows: DataFrame, name: str, schema: str, count: int) -> DataFrame:
        """Write ``rows`` with a folder per iteration and read them back."""
        spark = self.points.sparkSession
        path = scratch_path(spark, name)
        self._paths.append(path)
        self._add(rows, path, count)
        return spark.read.schema(schema).parquet(path)

    def _add(self, rows: DataFrame, path: str, count: int) -> None:
        placed = rows.repartition(self._tasks(count), "t", F.col("slot") % self.files)
        placed.write.mode("append").partitionBy("t").parquet(path)

    def close(self) -> None:
        """Delete the written rows; the caller keeps nothing that still reads them."""
        while self._paths:
            delete_path(self.points.sparkSession, self._paths.pop())

    def batch(self, t: int) -> DataFrame:
        first = t - t % self.group
        if first != self._first:
            self._write(first)
        return self._table.where(F.col("t") == t)


class SplitReader(BatchReader):
    """Mini-batches split by feature once per group, for models too large to broadcast.

    The cells of a group are stored as a table bucketed by feature into the model's partitions, one file per bucket with
    its cells sorted by iteration, so that an iteration reads only its own pages. Every iteration of the group then joins
    cells and model where both lie: what moves is one partial row per (task, slot), and a factor per slot on the way back.
    The cells of hot features stay spread by slot.
    """

    def __init__(
        self, points: DataFrame, n_rows: int, batch_size: int, iterations: int, seed: int, placement: Placement
    ):
        super().__init__(points, n_rows, batch_size, iterations, seed)
        self.placement = placement
        self._cold = self._hot = self._name = None

    def _write(self, first: int) -> None:
        super()._write(first)
        spark, parts = self.points.sparkSession, self.placement.partitions
        count = min(self.group, self.iterations - first)
        cells = self._table.select("t", "slot", F.inline("features"))
        hot = cells.join(F.broadcast(self.placement.hot), "feature", "left_semi")
        self._hot = self._by_iteration(hot, "hot-cells", "feature int, slot int, value double, t int", count)
        cold = cells.join(F.broadcast(self.placement.hot), "feature", "left_anti").repartition(parts, "feature")
        path, name = scratch_path(spark, "cells"), f"sg_cells_{uuid.uuid4().hex}"
        self._paths.append(path)
        self._name = name
        cold.write.option("path", path).bucketBy(parts, "feature").sortBy("t").saveAsTable(name)
        self._cold = spark.table(name)

    def group_end(self, t: int) -> int:
        """The first iteration after the group of ``t``."""
        return min(self.iterations, t - t % self.group + self.group)

    def touched(self, first: int, end: int) -> DataFrame:
        """``feature``: the cold features with cells in the iterations from ``first`` to before ``end``, in the model's partitions."""
        self.batch(first)
        return self._cold.where((F.col("t") >= first) & (F.col("t") < end)).select("feature").dropDuplicates()

    def close(self) -> None:
        if self._name:
            self.points.sparkSession.sql(f"DROP TABLE IF EXISTS {self._name}")
            self._name = None
        super().close()

    def batch(self, t: int) -> SplitBatch:
        samples = super().batch(t).select("slot", "label")
        mine = F.col("t") == t
        return SplitBatch(samples, self._cold.where(mine), self._hot.where(mine))
