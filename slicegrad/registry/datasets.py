"""Training sets derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.operators.columns import FEATURES_TYPE, make_features
from slicegrad.session import written
from slicegrad.sources.clicklog import CATEGORIES, INTEGERS, N_INTEGERS, criteo_features

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EVENT_FEATURES = 75
EMBEDDING_SIZE, EMBEDDING_CLASSES = 64, 10
CLICK_BUCKETS = 4096
CLICK_FEATURES = N_INTEGERS + CLICK_BUCKETS
CUSTOMER_OFFSET = 1_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str, multiclass: bool = False) -> DataFrame:
    """One point per event: its value, its user's group and its hour; label: an error, or the event type."""
    kind = F.col("event_type")
    if multiclass:
        label = F.array_position(F.array(*[F.lit(name) for name in EVENT_TYPES]), kind) - 1
    else:
        label = F.when(kind == "error", 1).otherwise(0)
    features = make_features(
        (F.lit(0), F.col("value") / 100),
        (F.col("user_id") % 50 + 1, F.lit(1.0)),
        (F.hour("ts") + 51, F.lit(1.0)),
    )
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("row_id"), label.cast("double").alias("label"), features.alias("features")
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense points with ten classes."""
    cells = F.transform(
        "embedding", lambda x, i: F.struct(i.alias("feature"), x.cast("double").alias("value"))
    )
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("double").alias("label"),
        cells.cast(FEATURES_TYPE).alias("features"),
    )


def order_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the shape of a click log, with missing integers and categories, and their row id."""
    known = {
        "i1": F.floor(F.col("o_totalprice") / 100000).cast("int"),
        "i2": F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 5 - 2).cast("int")),
        "i3": F.dayofmonth("o_orderdate") % 4,
        "c1": F.col("o_custkey").cast("string"),
        "c2": F.col("o_orderstatus"),
        "c3": F.when(F.col("o_custkey") % 3 != 0, F.year("o_orderdate").cast("string")),
        "c26": F.month("o_orderdate").cast("string"),
    }
    missing = {name: F.lit(None).cast("int") for name in INTEGERS}
    missing.update({name: F.lit(None).cast("string") for name in CATEGORIES})
    columns = {**missing, **known}
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(urgent, 1).otherwise(0).alias("label"),
        *[columns[name].alias(name) for name in INTEGERS + CATEGORIES],
    )


def hashed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed orders, computed where they are read."""
    return criteo_features(order_clicks(spark, sf_dir), CLICK_BUCKETS)


def click_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed orders: 13 integers and 4,096 buckets. Most categories are missing, so some buckets are in
    every row while a customer's bucket is rare: heavily skewed features. Hashing costs more than reading
    its result, and training passes over the points more than once, so they are written first."""
    return written(hashed_orders(spark, sf_dir), "points")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to customer for every item sold, and back for returned items; parallel edges are kept."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("s"), (F.col("o_custkey") + CUSTOMER_OFFSET).alias("c"), "l_returnflag"
    )
    forth = F.struct(F.col("s").alias("src"), F.col("c").alias("dst"))
    back = F.struct(F.col("c").alias("src"), F.col("s").alias("dst"))
    both = F.when(F.col("l_returnflag") == "R", F.array(forth, back)).otherwise(F.array(forth))
    return sold.select(F.inline(both))


def formula_weight(feature: Column, position: int) -> Column:
    """Weight of a fixed model, given by a formula over the feature and the position."""
    return F.sqrt(((feature * 7 + 3 * position) % 11 + 2).cast("double")) - F.lit(2.5)
