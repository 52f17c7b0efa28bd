"""From row-wise points to column-partitioned cells.

Three shapes are used throughout:

``points(row_id, label, features ARRAY<STRUCT<feature, value>>)``
    one row per sample; the training input.
``feats(row_id, label, feature, value)``
    one row per non-zero cell.
``cells(part, chunk, local, row_id, label, feature, value)``
    feats split vertically: a feature belongs to slice ``feature % P`` under local id ``feature div P``.

A slice is further divided into row chunks: ranges of rows of a fixed number, or with a bounded number of cells. The unit
that travels to one task is (slice, chunk), so its size is bounded even when a single feature occurs in every row of the
data, and with a bound on cells also when single rows are very long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicegrad.session import bounded_broadcast, cut_lineage, written

FEATURES_TYPE = "array<struct<feature:int,value:double>>"
DEFAULT_CHUNK_ROWS = 65_536
#: Cells of a chunk that is bounded by its cells, and rows of a range in which they are summed.
DEFAULT_CHUNK_CELLS, RANGE_ROWS = 4_000_000, 4096


def make_features(*cells: tuple[Column, Column]) -> Column:
    """Build a ``features`` array from (feature, value) column pairs."""
    return F.array(
        *[F.struct(f.cast("int").alias("feature"), v.cast("double").alias("value")) for f, v in cells]
    )


def to_feats(points: DataFrame) -> DataFrame:
    """One row per cell. A narrow step: nothing is shuffled.

    Outer, since for the plain form Spark derives a filter on the array's size and moves it to the scan, with all that
    computes the array in it.
    """
    return points.select("row_id", "label", F.inline_outer("features")).where("feature is not null")


def labels_of(points: DataFrame) -> DataFrame:
    """Labels with their row ids, taken before the vertical split; features are never read."""
    return points.select("row_id", "label")


def count_labels(labels: DataFrame) -> DataFrame:
    """Number of labelled rows in total and per label value."""
    return labels.groupBy("label").agg(F.count("*").alias("n_rows"))


def feature_partition(feats: DataFrame, partitions: int) -> DataFrame:
    """Add the slice (``part``) and the id inside the slice (``local``) of every cell."""
    return feats.withColumns(
        {
            "part": F.expr(f"cast(pmod(feature, {partitions}) as int)"),
            "local": F.expr(f"cast(feature div {partitions} as int)"),
        }
    )


def cell_chunks(points: DataFrame, max_cells: int = DEFAULT_CHUNK_CELLS) -> DataFrame:
    """``row_id, chunk``: ranges of rows, in row order, that hold at most ``max_cells`` cells each.

    A row of more cells has a chunk of its own. Running sums are taken in ranges of ``RANGE_ROWS`` rows and carried from
    range to range in two levels, so no task sees more than some thousand rows of either kind per billion rows.
    """
    sizes = written(points.select("row_id", F.size("features").cast("bigint").alias("n")), "row-sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    room = max(1, max_cells - largest + 1)  # a chunk's last row begins below it
    sized = sizes.withColumn("range", F.expr(f"row_id div {RANGE_ROWS}"))
    sums = sized.groupBy("range").agg(F.sum("n").alias("total")).withColumn("group", F.expr("range div 1024"))
    before = (Window.unboundedPreceding, -1)
    in_group = Window.partitionBy("group").orderBy("range").rowsBetween(*before)
    over_groups = Window.partitionBy(F.lit(0)).orderBy("group").rowsBetween(*before)
    groups = sums.groupBy("group").agg(F.sum("total").alias("total"))
    groups = groups.select("group", F.coalesce(F.sum("total").over(over_groups), F.lit(0)).alias("base"))
    starts = sums.withColumn("inner", F.coalesce(F.sum("total").over(in_group), F.lit(0))).join(groups, "group")
    starts = starts.select("range", (F.col("base") + F.col("inner")).alias("start"))
    in_range = Window.partitionBy("range").orderBy("row_id").rowsBetween(*before)
    placed = sized.withColumn("own", F.coalesce(F.sum("n").over(in_range), F.lit(0))).join(starts, "range")
    return placed.select("row_id", F.expr(f"cast((start + own) div {room} as int)").alias("chunk"))


def to_columns(
    points: DataFrame,
    partitions: int,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    tasks: int | None = None,
    max_cells: int | None = None,
) -> DataFrame:
    """Split every row over ``partitions`` feature slices and co-locate the cells of a (slice, chunk).

    A chunk is ``chunk_rows`` rows or, given ``max_cells``, a range of rows with at most so many cells.
    """
    if max_cells:
        cells = points.join(cell_chunks(points, max_cells), "row_id").select("row_id", "label", "chunk", F.inline("features"))
        cells = feature_partition(cells, partitions)
    else:
        chunk = F.expr(f"cast(row_id div {chunk_rows} as int)")
        cells = feature_partition(to_feats(points), partitions).withColumn("chunk", chunk)
    cells = cells.select("part", "chunk", "local", "row_id", "label", "feature", "value")
    keys = ["part", "chunk"]
    return cells.repartition(tasks, *keys) if tasks else cells.repartition(*keys)


def to_blocks(
    points: DataFrame, partitions: int, chunk_rows: int = DEFAULT_CHUNK_ROWS, max_cells: int | None = None
) -> DataFrame:
    """The same split packed into one compressed sparse row block per (slice, chunk).

    ``offsets[i]`` is the end of row ``row_ids[i]`` in ``local`` and ``value``. A block never holds more
    than ``chunk_rows`` rows or, given ``max_cells``, no more cells than that unless one row does; rows without cells in
    a slice are absent from its block. All three steps run on the partitioning of ``to_columns``, so its shuffle is the
    only one of cells.
    """
    slices = (
        to_columns(points, partitions, chunk_rows, max_cells=max_cells)
        .groupBy("part", "chunk", "row_id", "label")
        .agg(F.sort_array(F.collect_list(F.struct("local", "value"))).alias("cells"))
    )
    in_block = Window.partitionBy("part", "chunk").orderBy("row_id")
    ended = slices.withColumn("offset", F.sum(F.size("cells")).over(in_block).cast("int"))
    rows = F.sort_array(F.collect_list(F.struct("row_id", "label", "offset", "cells")))
    packed = ended.groupBy("part", "chunk").agg(rows.alias("rows"))
    cells = F.flatten(F.col("rows.cells"))
    return packed.select(
        "part",
        "chunk",
        F.col("rows.row_id").alias("row_ids"),
        F.col("rows.label").alias("labels"),
        F.col("rows.offset").alias("offsets"),
        cells["local"].alias("local"),
        cells["value"].alias("value"),
    )


def with_dense_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows ``0..N-1`` without sorting them or passing them through one task.

    The rows are written as a columnar table first, so the numbering cannot change between the counting pass, which
    reads one column, and the numbering pass, and later readers read only the columns they name. Only one count per partition enters the running total, which
    is itself taken in two levels of at most about a thousand rows each per million partitions.
    """
    fixed = written(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    fixed = fixed.withColumn("_part", F.shiftright("_at", 33))
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = cut_lineage(counts.withColumn("_group", F.expr("_part div 1024")))
    before = (Window.unboundedPreceding, -1)
    in_group = Window.partitionBy("_group").orderBy("_part").rowsBetween(*before)
    over_groups = Window.partitionBy(F.lit(0)).orderBy("_group").rowsBetween(*before)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_total"))
    groups = groups.select("_group", F.coalesce(F.sum("_total").over(over_groups), F.lit(0)).alias("_base"))
    starts = counts.withColumn("_inner", F.coalesce(F.sum("_n").over(in_group), F.lit(0))).join(groups, "_group")
    starts = starts.select("_part", (F.col("_base") + F.col("_inner")).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    # One row per partition of the data: far below the broadcast bound for any real partition count.
    starts = bounded_broadcast(starts, counts.count(), 2)
    numbered = fixed.join(starts, "_part").withColumn(name, F.col("_start") + within)
    return numbered.select(name, *[c for c in df.columns if c != name])
