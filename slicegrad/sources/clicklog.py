"""Tab separated click logs: one label, 13 integers, 26 categories; hashed into sparse points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.functions.hashing import hash_bucket, hash_sign, hash_word, signed_word
from slicegrad.operators.columns import FEATURES_TYPE
from slicegrad.sources.libsvm import format_line

# Fixed values of the click-log format.
N_INTEGERS = 13
N_CATEGORIES = 26

INTEGERS = [f"i{n}" for n in range(1, N_INTEGERS + 1)]
CATEGORIES = [f"c{n}" for n in range(1, N_CATEGORIES + 1)]
RAW_SCHEMA = ", ".join(
    ["label int"] + [f"{name} int" for name in INTEGERS] + [f"{name} string" for name in CATEGORIES]
)


def read_criteo(spark: SparkSession, path: str) -> DataFrame:
    """Scan a click log; a missing integer is 0 and a missing category is the empty string."""
    raw = spark.read.schema(RAW_SCHEMA).csv(path, sep="\t", quote="", mode="FAILFAST")
    return raw.select(
        "label",
        *[F.coalesce(F.col(name), F.lit(0)).alias(name) for name in INTEGERS],
        *[F.coalesce(F.col(name), F.lit("")).alias(name) for name in CATEGORIES],
    )


def write_clicks(clicks: DataFrame, path: str) -> None:
    """Write rows of the click-log schema as tab separated text."""
    clicks.select("label", *INTEGERS, *CATEGORIES).write.csv(path, sep="\t", quote="", emptyValue="")


def category_tokens(names: list[str], hash_missing: bool = True) -> list[Column]:
    """Categories tagged with their position, so equal values of different columns hash apart.

    A missing category still gives the token ``position:``; with ``hash_missing`` off it gives null.
    """
    tokens = []
    for position, name in enumerate(names):
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        token = F.concat(F.lit(f"{position}:"), value)
        tokens.append(token if hash_missing else F.when(value != "", token))
    return tokens


def hash_features(
    df: DataFrame, row_id: str, tokens: list[Column], n_buckets: int, method: str = "md5", shift: int = 0
) -> DataFrame:
    """Signed feature hashing: ``(row_id, bucket, value)`` with the sum of signs per bucket of a row.

    Buckets whose signs cancel are dropped. One narrow pass: sums stay inside a row, so nothing is shuffled.
    """
    rows = hash_in_row(df, [F.col(row_id).alias("row_id")], "_cells", tokens, n_buckets, method, shift)
    # outer: for the plain form Spark derives a filter on the array's size, which it moves to the scan with all hashes in it
    cells = rows.select("row_id", F.inline_outer("_cells")).where("feature is not null")
    return cells.select("row_id", F.col("feature").alias("bucket"), F.col("value").cast("bigint").alias("value"))


def hash_in_row(
    df: DataFrame, keep: list[Column], name: str, tokens: list[Column], n_buckets: int, method: str = "md5",
    shift: int = 0,
) -> DataFrame:
    """The columns ``keep`` and the ``features`` array ``name`` of the same hashing, without any shuffle.

    Every token is hashed once, in a projection of its own; what follows reads the hashes as columns. Bucket and sign of a
    token are folded into one number and the numbers of a row are sorted. In most rows no two tokens share a bucket and
    every number is a cell already; otherwise one pass over the numbers sums the signs of equal buckets. Numbers and
    bucket count are again a projection, used more than once by the next one, so Spark computes them once per row.
    """
    words = [f"_sg_word{i}" for i in range(len(tokens))]
    hashed = df.select(*keep, *[F.when(t.isNotNull(), hash_word(t, method)).alias(w) for t, w in zip(tokens, words)])
    buckets, codes = [], []
    for word in words:
        h = signed_word(F.col(word), method)
        bucket = F.when(F.col(word).isNotNull(), hash_bucket(h, n_buckets)).otherwise(F.lit(-1))
        buckets.append(bucket)
        codes.append(bucket * 2 + F.when(h >= 0, 1).otherwise(0))
    coded = hashed.select(
        *[F.col(f"`{c}`") for c in hashed.columns if c not in words],
        F.sort_array(F.array(*codes)).alias("_codes"),
        F.size(F.array_distinct(F.array(*buckets))).alias("_distinct"),
    )
    names = [c for c in coded.columns if c not in ("_codes", "_distinct")]

    def cell(bucket: Column, value: Column) -> Column:
        return F.struct((bucket + shift).alias("feature"), value.cast("double").alias("value"))

    def sign(code: Column) -> Column:
        return code.bitwiseAND(F.lit(1)) * 2 - 1

    def closed(acc: Column) -> Column:
        kept = (acc["total"] != 0) & (acc["bucket"] >= 0)
        return F.when(kept, F.concat(acc["done"], F.array(cell(acc["bucket"], acc["total"])))).otherwise(acc["done"])

    def merge(acc: Column, code: Column) -> Column:
        bucket = F.shiftright(code, 1)
        same = bucket == acc["bucket"]
        return F.struct(
            F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"),
            bucket.alias("bucket"),
            F.when(same, acc["total"] + sign(code)).otherwise(sign(code)).alias("total"),
        )

    nothing = F.array().cast(FEATURES_TYPE)
    start = F.struct(nothing.alias("done"), F.lit(-1).alias("bucket"), F.lit(0).alias("total"))
    summed = F.aggregate("_codes", start, merge, closed)
    each = [F.get("_codes", F.lit(i)) for i in range(len(tokens))]  # as generated code; a lambda would be interpreted per cell
    plain = F.array(*[cell(F.shiftright(code, 1), sign(code)) for code in each])
    unshared = (F.col("_distinct") == len(tokens)) & (F.get("_codes", F.lit(0)) >= 0)
    return coded.select(*names, F.when(unshared, plain).otherwise(summed).cast(FEATURES_TYPE).alias(name))


def binary_label(label: Column) -> Column:
    return F.when(label <= 0, F.lit(0.0)).otherwise(F.lit(1.0))


def criteo_features(
    clicks: DataFrame, n_buckets: int, method: str = "md5", hash_missing: bool = True
) -> DataFrame:
    """``(label, features)`` of a click log; other columns of ``clicks`` such as a row id are kept.

    Features 0..12 are the integers, present even when 0; features from 13 on are the hashed categories.
    One narrow pass over the log.
    """
    integers = F.array(
        *[
            F.struct(
                F.lit(position).alias("feature"),
                F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias("value"),
            )
            for position, name in enumerate(INTEGERS)
        ]
    ).cast(FEATURES_TYPE)
    kept = [F.col(c) for c in clicks.columns if c not in {"label", *INTEGERS, *CATEGORIES}]
    keep = [*kept, binary_label(F.col("label")).alias("label"), integers.alias("_integers")]
    tokens = category_tokens(CATEGORIES, hash_missing)
    hashed = hash_in_row(clicks, keep, "_hashed", tokens, n_buckets, method, N_INTEGERS)
    return hashed.select(*kept, "label", F.concat("_integers", "_hashed").alias("features"))


def clicks_to_libsvm(
    spark: SparkSession,
    source: str,
    target: str,
    n_buckets: int,
    fraction: float = 1.0,
    method: str = "md5",
) -> None:
    """Click log in, hashed libsvm text out, optionally resampled with replacement."""
    from slicegrad.operators.sampling import resample

    clicks = resample(read_criteo(spark, source), fraction)
    points = criteo_features(clicks, n_buckets, method)
    points.select(format_line(F.col("label"), F.col("features")).alias("value")).write.text(target)
