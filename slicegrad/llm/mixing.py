"""Mixing sources to target weights by Poisson replication. Columns only.

Every source gets a repetition rate: its share of the wanted corpus over its size. A document's number of copies is a
Poisson draw with that mean. The draw inverts the distribution at a number in [0, 1) taken from a hash of seed, id and
source, so it never depends on partitions or retries. A mean above ``STEP`` is the sum of independent draws, each of at most ``STEP``,
which keeps the cumulative table short and its first entry above zero. Documents are exploded by their counts and the
copies are sorted by a hash over the whole corpus.

Sizes are code points, summed per task before the shuffle. Rates have one row per source and are broadcast while that
is proven small; otherwise they are joined by a shuffle whose large side Spark splits.

Defined results: a null source is a source of its own, a null id is drawn by its text; null or empty texts have size
zero and are drawn like others; equal rows get equal draws; a source of size zero keeps a rate of one; an empty table
stays empty; other columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicegrad.llm.common import fresh, saved, text_of, unit_hash
from slicegrad.session import bounded_broadcast

#: Largest mean of one inverted draw.
STEP = 8.0
#: Entries of a cumulative table; what a mean of ``STEP`` leaves beyond is below the resolution of the draws.
TABLE = 48


def source_rates(docs: DataFrame, *, source: str = "source", text: str = "text", alpha: float = 0.7, max_rate: float | None = None, weights: dict | None = None) -> DataFrame:
    """``src, size, rate``: repetition rates that keep the corpus's size and give source ``s`` its target weight.

    Targets are ``weights`` (sources not named get none) or proportional to ``size ** alpha``. A ``max_rate``
    caps the rates; what it cuts off is missing from the source and from the corpus.
    """
    sizes = docs.groupBy(F.col(f"`{source}`").alias("src")).agg(F.sum(F.char_length(text_of(text))).alias("size"))
    if weights is None:
        wanted = F.pow(F.col("size").cast("double"), F.lit(alpha))
    else:
        named = [F.when(F.col("src").cast("string") == str(name), F.lit(float(w))) for name, w in weights.items()]
        wanted = F.coalesce(*named, F.lit(0.0))
    sizes, _ = saved(sizes, "sizes")
    sized = sizes.withColumn("wanted", wanted)
    total = sized.agg(F.sum("size").cast("double").alias("total"), F.sum("wanted").alias("all_wanted"))
    rate = F.col("wanted") / F.col("all_wanted") * F.col("total") / F.col("size")
    if max_rate is not None:
        rate = F.least(F.lit(float(max_rate)), rate)
    both = sized.crossJoin(F.broadcast(total))  # one row of totals
    return both.select("src", "size", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def cumulative(mean: Column) -> Column:
    """The Poisson distribution function of ``mean`` at 0, 1, ..., ``TABLE - 1``."""
    zero = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / (k + 1)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + acc["p"])).alias("all")
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(TABLE - 1)), zero, step, lambda acc: acc["all"])


def mix(docs: DataFrame, rates: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 1) -> DataFrame:
    """Each document as often as its draw says, in an order that mixes the corpus.

    Returns the columns of ``docs`` and two more: ``copy`` (from 0) and ``shuffle_key``, by which rows are sorted across
    and within partitions.
    """
    copy, order, tag, src, cdf, parts, copies = fresh(docs, "copy", "shuffle_key", "sg_tag", "sg_src", "sg_cdf", "sg_parts", "sg_copies")
    rates, _ = saved(rates.select(F.col("src").alias(src), F.greatest(F.col("rate"), F.lit(0.0)).alias("rate")), "rates")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(STEP)).cast("int"))
    tables = rates.select(src, draws.alias(parts), cumulative(F.col("rate") / draws).alias(cdf))
    identity = F.coalesce(F.col(f"`{key}`").cast("string"), F.md5(text_of(text)))
    tagged = docs.withColumn(tag, F.concat_ws("|", F.lit(str(seed)), identity, F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("null"))))
    joined = tagged.join(bounded_broadcast(tables, rates.count(), TABLE + 2), F.col(f"`{source}`").eqNullSafe(F.col(src)))
    # the number of table entries at or below the draw is the smallest count whose distribution function exceeds it
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)),
        F.lit(0),
        lambda acc, k: acc + F.size(F.filter(cdf, lambda c: c <= unit_hash(F.col(tag), k))),
    )
    counted = joined.withColumn(copies, drawn).filter(F.col(copies) > 0)
    names = [F.col(f"`{c}`") for c in docs.columns]
    exploded = counted.select(*names, tag, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias(copy))
    keyed = exploded.select(*names, copy, F.md5(F.concat_ws("|", F.lit("order"), tag, copy)).alias(order))
    return keyed.repartitionByRange(F.col(order), F.col(copy)).sortWithinPartitions(order, copy)


def expected_steps(rate: float) -> int:
    """Independent draws behind one document of this rate."""
    return max(1, math.ceil(rate / STEP))
