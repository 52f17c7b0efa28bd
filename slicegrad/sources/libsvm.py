"""libsvm text: scan and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.operators.columns import FEATURES_TYPE, with_dense_ids


def scan_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """Parse libsvm text into ``(label, features)`` with zero-based feature ids.

    Every cell of a line is kept, also one of value zero, which Spark's own reader drops. Blank lines and lines starting
    with # are skipped; unless the one-based indices of a line ascend strictly, an error is raised. Nothing is shuffled and
    nothing is written.
    """
    line = F.regexp_replace("value", r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias("line")
    lines = spark.read.text(path).select(line).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    words = lines.select("line", F.split("line", " +").alias("words"))

    def cell(word: Column) -> Column:
        pair = F.split(word, ":")
        return F.struct((F.get(pair, F.lit(0)).cast("int") - 1).alias("feature"), F.get(pair, F.lit(1)).cast("double").alias("value"))

    items = F.slice("words", F.lit(2), F.size("words"))
    rows = words.select("line", F.get("words", F.lit(0)).cast("double").alias("label"), F.transform(items, cell).alias("cells"))
    message = F.concat(F.lit("indices should be one-based and in ascending order, all with a value; line: "), "line")

    def checked(one: Column, at: Column) -> Column:
        before = F.coalesce(F.get("cells", at - 1)["feature"], F.lit(-1))
        return F.when((one["feature"] > before) & one["value"].isNotNull(), one).otherwise(F.raise_error(message))

    label = F.coalesce("label", F.raise_error(F.concat(F.lit("no label; line: "), "line")).cast("double"))
    return rows.select(label.alias("label"), F.transform("cells", checked).cast(FEATURES_TYPE).alias("features"))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``points(row_id, label, features)`` with dense row ids, ready for training."""
    return with_dense_ids(scan_libsvm(spark, path))


def format_line(label: Column, features: Column) -> Column:
    """One libsvm line with one-based, ascending indices."""
    ordered = F.sort_array(features)
    cells = F.transform(
        ordered, lambda c: F.concat_ws(":", (c["feature"] + 1).cast("string"), _number(c["value"]))
    )
    return F.concat_ws(" ", _number(label), F.array_join(cells, " "))


def _number(value: Column) -> Column:
    """Whole numbers without a decimal part, everything else in full double precision."""
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def write_libsvm(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write points as libsvm text, one narrow pass."""
    lines = points.select(F.rtrim(format_line(F.col("label"), F.col("features"))).alias("value"))
    lines.write.mode(mode).text(path)
