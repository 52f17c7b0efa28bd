"""Small helpers that several corpus operators share."""

from __future__ import annotations

import math
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.session import delete_path, scratch_path

#: White space of the token rules: space and U+0009 to U+000D.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to ``names`` that ``df`` does not have, whatever the case of its own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def unit_hash(*parts) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by '|'; nulls count as 'null'.

    Fifty-two bits are used, so the number is exact in a double and the same in every SQL engine.
    """
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def saved(df: DataFrame, name: str, **options) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared scratch folder; return it reread, and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_saved(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        delete_path(spark, path)


def shuffle_width(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for ``rows`` rows; never fewer than the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_task))


def process_memory() -> dict:
    """What a worker process keeps from task to task. Functions arrive by value, so their globals do not last."""
    return sys.modules.setdefault("sg_process_memory", types.ModuleType("sg_process_memory")).__dict__
