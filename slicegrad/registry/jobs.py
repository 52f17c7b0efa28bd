"""The registered queries as Spark jobs: each takes the session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.functions.hashing import gaussian
from slicegrad.functions.scalars import log1pexp, logistic_coef, signed_label, staged
from slicegrad.operators import columns as co
from slicegrad.operators import sampling as sa
from slicegrad.operators import statistics as st
from slicegrad.operators.pagerank import pagerank, top_ranks
from slicegrad.plans import mlp
from slicegrad.plans.baselines import baseline, coefficients, predictions
from slicegrad.plans.batches import profile_points
from slicegrad.plans.objectives import Adam, Factorization, Hinge, Logistic, Objective, Softmax
from slicegrad.plans.store import store_columns
from slicegrad.plans.train import evaluate, train, train_all
from slicegrad.registry import datasets as ds
from slicegrad.session import scratch_path
from slicegrad.sources import clicklog, libsvm, texts

REG, STEP = 0.01, 0.5
ITERATIONS = 4
BATCH_SHARE = 20
SAMPLE_SHARE, RESAMPLE_RATE = 0.1, 1.5

Query = Callable[[SparkSession, str], DataFrame]


def rounded(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


# ----------------------------------------------------------------------------------- sources and sinks


def read_libsvm(spark, sf):
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(ds.event_points(spark, sf), path)
    points = libsvm.read_libsvm(spark, path)
    return co.to_feats(points).groupBy("label", "feature", "value").agg(F.count("*").alias("n"))


def write_libsvm(spark, sf):
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(ds.hashed_orders(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def to_columns(spark, sf):
    cells = co.to_columns(ds.event_points(spark, sf), 4, chunk_rows=1000)
    return cells.select("part", "chunk", "local", "row_id", "label", "feature", "value")


def to_blocks(spark, sf):
    return _described(co.to_blocks(ds.event_points(spark, sf), 4, chunk_rows=1000))


def _described(blocks):
    total = F.aggregate("value", F.lit(0.0), lambda acc, x: acc + x)
    return blocks.select(
        "part",
        "chunk",
        F.size("row_ids").cast("bigint").alias("n_rows"),
        F.size("local").cast("bigint").alias("n_cells"),
        F.element_at("offsets", -1).cast("bigint").alias("last_offset"),
        rounded(total).alias("total"),
    )


def to_blocks_bounded(spark, sf):
    """Blocks whose chunks hold at most 2,500 cells, of points with a growing number of them."""
    points = ds.event_points(spark, sf)
    kept = F.filter("features", lambda cell, i: i <= F.col("row_id") % 4)
    return _described(co.to_blocks(points.withColumn("features", kept), 4, max_cells=2500))


def feature_partition(spark, sf):
    feats = co.to_feats(ds.event_points(spark, sf))
    per_feature = feats.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    placed = co.feature_partition(per_feature, 4)
    return placed.groupBy("part").agg(
        F.count("*").alias("n_features"),
        F.sum("n").alias("n_cells"),
        rounded(F.sum("total")).alias("total"),
    )


def read_criteo(spark, sf):
    path = scratch_path(spark, "clicks")
    clicklog.write_clicks(ds.order_clicks(spark, sf), path)
    return clicklog.read_criteo(spark, path)


def criteo_features(spark, sf):
    return co.to_feats(ds.hashed_orders(spark, sf))


def hash_features(spark, sf):
    tokens = clicklog.category_tokens(["p_brand", "p_type", "p_name"])
    return clicklog.hash_features(ds.table(spark, sf, "part"), "p_partkey", tokens, 64)


def hash_present(spark, sf):
    """Hashing that leaves missing categories out."""
    tokens = clicklog.category_tokens(["c1", "c2", "c3", "c26"], hash_missing=False)
    return clicklog.hash_features(ds.order_clicks(spark, sf), "row_id", tokens, 64)


def read_edges(spark, sf):
    path = scratch_path(spark, "edges")
    texts.write_edges(ds.trade_edges(spark, sf), path)
    return texts.read_edges(spark, path).groupBy("src", "dst").agg(F.count("*").alias("n"))


def rewrite_files(spark, sf):
    source, target = scratch_path(spark, "lines"), scratch_path(spark, "lines")
    keys = ds.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"))
    keys.write.text(source)
    texts.rewrite_files(spark, source, target, 8)
    return _files(spark, target)


def merge_files(spark, sf):
    """Eight partitions merged to three without a shuffle, one file each."""
    target = scratch_path(spark, "lines")
    keys = ds.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"))
    sa.merge_partitions(keys.repartition(8), 3).write.text(target)
    return _files(spark, target)


def _files(spark, target):
    lines = spark.read.text(target).select("value", F.input_file_name().alias("file"))
    return lines.agg(
        F.count("*").alias("n_lines"),
        F.count_distinct("file").cast("int").alias("n_files"),
        F.sum(F.col("value").cast("bigint")).alias("total"),
    )


def click_vectors(spark, sf):
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(ds.hashed_orders(spark, sf), path)
    return texts.load_vectors(spark, path, ds.CLICK_FEATURES, spark.sparkContext.defaultParallelism)


def load_vectors(spark, sf):
    rows = click_vectors(spark, sf).select("label", F.unwrap_udt("features").alias("v"))
    total = F.aggregate("v.values", F.lit(0.0), lambda acc, x: acc + x)
    return rows.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.max("v.size").alias("width"), F.sum(total).alias("total")
    )


def sample_rows(spark, sf):
    return sa.sample_rows(ds.table(spark, sf, "orders"), SAMPLE_SHARE, key=["o_orderkey"]).select("o_orderkey")


def sample_text(spark, sf):
    """A sample of text lines, from text to text."""
    source, target = scratch_path(spark, "lines"), scratch_path(spark, "lines")
    ds.table(spark, sf, "part").select(F.concat_ws(" ", "p_partkey", "p_name").alias("value")).write.text(source)
    texts.sample_text(spark, source, target, SAMPLE_SHARE, keyed=True)
    return spark.read.text(target).select(F.col("value").alias("line"))


def resample(spark, sf):
    return sa.resample(ds.table(spark, sf, "orders"), RESAMPLE_RATE, key=["o_orderkey"]).select("o_orderkey")


# ------------------------------------------------------------------------------------------- batches


def _all_slots(spark, sf):
    n_rows = ds.table(spark, sf, "events").count()
    return sa.minibatch_slots(spark, n_rows, n_rows)


def minibatch_slots(spark, sf):
    return _all_slots(spark, sf)


def batch_labels(spark, sf):
    return sa.batch_labels(co.labels_of(ds.event_points(spark, sf)), _all_slots(spark, sf))


def batch_cells(spark, sf):
    return sa.batch_cells(co.to_feats(ds.event_points(spark, sf)), _all_slots(spark, sf))


def label_counts(spark, sf):
    return co.count_labels(co.labels_of(ds.event_points(spark, sf)))


# ------------------------------------------------------------------------- statistics, losses, gradient


def _fixed_model(spark: SparkSession, objective: Objective, features: int) -> DataFrame:
    ids = spark.range(features).select(F.col("id").cast("int").alias("feature"))
    names = objective.weights()
    return ids.select(
        "feature", *[ds.formula_weight(F.col("feature"), k).alias(name) for k, name in enumerate(names)]
    )


def _fixed_stats(spark, sf, objective: Objective, multiclass: bool = False) -> DataFrame:
    """Statistics of all events under a model given by a formula."""
    batch = ds.event_points(spark, sf, multiclass).withColumnRenamed("row_id", "slot")
    model = _fixed_model(spark, objective, ds.EVENT_FEATURES)
    placement = st.plan_placement(ds.EVENT_FEATURES, len(model.columns), 8, batch)
    return st.sample_stats(batch, model, objective.terms(), placement)


def _stats_query(objective: Objective, multiclass: bool = False) -> Query:
    def query(spark, sf):
        stats = _fixed_stats(spark, sf, objective, multiclass)
        cells = [
            F.struct(F.lit(k).alias("k"), rounded(F.col(name)).alias("s"))
            for k, name in enumerate(objective.stats())
        ]
        return stats.select("slot", F.inline(F.array(*cells)))

    return query


def _loss_query(objective: Objective, multiclass: bool = False) -> Query:
    def query(spark, sf):
        stats = staged(_fixed_stats(spark, sf, objective, multiclass), objective.stages())
        return stats.agg(F.count("*").alias("n"), rounded(F.avg(objective.loss())).alias("loss"))

    return query


def batch_grad(spark, sf):
    objective = Logistic()
    batch = ds.event_points(spark, sf).withColumnRenamed("row_id", "slot").withColumn("t", F.lit(0))
    stats = _fixed_stats(spark, sf, objective)
    n_rows = batch.count()
    placement = st.plan_placement(ds.EVENT_FEATURES, 2, 8, batch)
    sums = st.FeatureSums(objective.coefs(), objective.sums(), placement, n_rows)(batch, stats)
    return sums.select("feature", rounded(F.col("g0")).alias("g"))


def gaussian_init(spark, sf):
    """Initial factors of a model with one feature per part."""
    parts = ds.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("feature"))
    factors = [
        F.struct(F.lit(k).alias("k"), rounded(gaussian(42, F.col("feature"), F.lit(k))).alias("w"))
        for k in range(1, 5)
    ]
    return parts.select("feature", F.inline(F.array(*factors)))


# ------------------------------------------------------------------------------------------ training


def _fit(points: DataFrame, model, k=None, share: int = BATCH_SHARE, **settings):
    classes = k if model in ("mlr", "mlp", "adammlp") else 2
    profile = profile_points(points, classes or 2, settings.pop("num_features", None))
    defaults = {"step": STEP, "reg": REG, "iterations": ITERATIONS, "history": False}
    return train(
        points, model, k=k, batch_size=profile.n_rows // share, profile=profile, **{**defaults, **settings}
    )


def _weights(model, moments: bool = False) -> DataFrame:
    columns = ["w", "m", "v"] if moments else ["w"]
    return model.weights(moments).select("feature", "k", *[rounded(F.col(c)).alias(c) for c in columns])


def train_lr(spark, sf):
    return _weights(_fit(ds.event_points(spark, sf), "lr", num_features=ds.EVENT_FEATURES))


def train_svm(spark, sf):
    return _weights(_fit(ds.event_points(spark, sf), "svm", num_features=ds.EVENT_FEATURES))


def train_mlr(spark, sf):
    return _weights(_fit(ds.event_points(spark, sf, True), "mlr", 5, num_features=ds.EVENT_FEATURES))


def train_mlr_dense(spark, sf):
    points = ds.embedding_points(spark, sf)
    return _weights(_fit(points, "mlr", ds.EMBEDDING_CLASSES, num_features=ds.EMBEDDING_SIZE))


def train_fm(spark, sf):
    return _weights(_fit(ds.event_points(spark, sf), "fm", 4, num_features=ds.EVENT_FEATURES))


def train_adamlr(spark, sf):
    model = _fit(ds.event_points(spark, sf), "adamlr", num_features=ds.EVENT_FEATURES, step=0.05)
    return _weights(model, moments=True)


def train_adamsvm(spark, sf):
    model = _fit(ds.event_points(spark, sf), "adamsvm", num_features=ds.EVENT_FEATURES, step=0.05)
    return _weights(model, moments=True)


def train_lr_clicks(spark, sf):
    """Click log to weights: hashing, drawing and training."""
    return _weights(_fit(ds.click_points(spark, sf), "lr", num_features=ds.CLICK_FEATURES, step=0.1))


def _partitioned(spark, sf, model, k=None, **settings):
    """Train as for a model too large to broadcast: cells travel to the model's partitions."""
    points = ds.click_points(spark, sf)
    partitions = spark.sparkContext.defaultParallelism
    placement = st.split_placement(points, 1 + (k or 0), partitions)
    return _weights(
        _fit(points, model, k, num_features=ds.CLICK_FEATURES, partitions=partitions, placement=placement, **settings)
    )


def train_lr_partitioned(spark, sf):
    return _partitioned(spark, sf, "lr", step=0.1)


def train_fm_partitioned(spark, sf):
    return _partitioned(spark, sf, "fm", 4, step=0.01)


def _from_store(spark, sf, model, k=None, **settings):
    """Two runs from one stored split, of different seeds; the second one's weights."""
    points = ds.click_points(spark, sf)
    profile = profile_points(points, 2, ds.CLICK_FEATURES)
    store = store_columns(points, profile=profile, columns=1 + (k or 0), partitions=spark.sparkContext.defaultParallelism, max_cells=200_000)
    batch = profile.n_rows // BATCH_SHARE
    train(store, model, k=k, step=0.1, reg=REG, batch_size=batch, iterations=1, seed=7, history=False)
    trained = train(store, model, k=k, reg=REG, batch_size=batch, iterations=ITERATIONS, history=False, **settings)
    store.close()
    return _weights(trained)


def train_lr_stored(spark, sf):
    return _from_store(spark, sf, "lr", step=0.1)


def train_fm_stored(spark, sf):
    return _from_store(spark, sf, "fm", 4, step=0.01)


class Squares(Objective):
    """Least squares, as a user would define a model of their own."""

    name = "squares"

    def weights(self):
        return ["w0"]

    def stats(self):
        return ["s0"]

    def terms(self):
        return {"s0": F.col("w0") * F.col("value")}

    def loss(self):
        return F.pow(F.col("s0") - F.col("label"), 2) / 2

    def coefs(self):
        return {"c0": F.col("s0") - F.col("label")}

    def sums(self):
        return {"g0": F.col("c0") * F.col("value")}

    def gradient(self):
        return {"w0": F.col("g0")}

    def scores(self):
        return {"score": F.col("s0")}


class Gated(Objective):
    """Logistic regression whose features compete, as a user would define a model of two passes.

    The first pass sums a sample's gate level from the gates ``w1``. The second one sees it in every cell: the cell counts as
    far as its own gate exceeds the level. On the way back, one more sum carries the gradient through the level to all gates.
    """

    name = "gated"

    def touched_only(self):
        return True

    def weights(self):
        return ["w0", "w1"]

    def stats(self):
        return ["level", "s0"]

    def initial(self, feature, seed):
        return {"w0": F.lit(0.0), "w1": gaussian(seed, feature, scale=0.5)}

    def _gate(self):
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("level") - F.col("w1") * F.col("value")))

    def _slope(self):
        return F.col("w0") * F.col("value") * self._gate() * (1.0 - self._gate())

    def passes(self):
        return [{"level": F.col("w1") * F.col("value")}, {"s0": F.col("w0") * F.col("value") * self._gate()}]

    def loss(self):
        return log1pexp(-signed_label(F.col("label")) * F.col("s0"))

    def returns(self):
        return [{"pull": self._slope()}]

    def coefs(self):
        return {"c0": logistic_coef(F.col("s0"), F.col("label")), "level": F.col("level"), "pull": F.col("pull")}

    def sums_see_weights(self):
        return True

    def sums(self):
        value, c = F.col("value"), F.col("c0")
        return {"g0": c * value * self._gate(), "g1": c * (self._slope() * value - F.col("pull") * value)}

    def gradient(self):
        return {"w0": F.col("g0"), "w1": F.col("g1")}

    def scores(self):
        return {"score": F.col("s0")}


def train_gated(spark, sf):
    """A user-defined model of two passes."""
    return _weights(_fit(ds.event_points(spark, sf), Gated(), num_features=ds.EVENT_FEATURES))


def train_gated_adam(spark, sf):
    """The same under lazy Adam."""
    points = ds.event_points(spark, sf)
    return _weights(_fit(points, Gated(), num_features=ds.EVENT_FEATURES, step=0.05, optimizer=Adam()), moments=True)


def train_gated_partitioned(spark, sf):
    """The same for a model too large to broadcast."""
    return _partitioned(spark, sf, Gated(), 2, step=0.1)


def score_gated(spark, sf):
    """Scores of a two-pass model, split by feature, over all rows."""
    points = ds.click_points(spark, sf)
    partitions = spark.sparkContext.defaultParallelism
    model = _fit(
        points, Gated(), num_features=ds.CLICK_FEATURES, partitions=partitions, step=0.1,
        placement=st.split_placement(points, 3, partitions),
    )
    return model.score(points).select("row_id", "label", rounded(F.col("score")).alias("score"))


def train_own(spark, sf):
    return _weights(_fit(ds.event_points(spark, sf), Squares(), num_features=ds.EVENT_FEATURES, step=0.05))


def train_everything(spark, sf):
    points = ds.event_points(spark, sf)
    n_rows = points.count()
    models = train_all(
        points, "LR-SVM-FM", step=STEP, reg=REG, iterations=ITERATIONS, batch_size=n_rows // BATCH_SHARE,
        num_features=ds.EVENT_FEATURES, k=4, history=False,
    )
    tables = [_weights(model).withColumn("model", F.lit(name)) for name, model in models.items()]
    return reduce(DataFrame.unionByName, tables).select("model", "feature", "k", "w")


def evaluate_model(spark, sf):
    points = ds.event_points(spark, sf)
    model = _fit(points, "lr", num_features=ds.EVENT_FEATURES)
    return evaluate(model, points, valid_ratio=0.5).select("n", rounded(F.col("loss")).alias("loss"))


def history(spark, sf):
    model = _fit(ds.event_points(spark, sf), "lr", num_features=ds.EVENT_FEATURES, history=True)
    losses = [rounded(F.col(c)).alias(c) for c in ("batch_loss", "valid_loss")]
    return model.history.select("iter", *losses)


def score(spark, sf):
    points = ds.event_points(spark, sf)
    scored = _fit(points, "lr", num_features=ds.EVENT_FEATURES).score(points)
    return scored.select(
        "row_id", "label", *[rounded(F.col(c)).alias(c) for c in ("score", "probability")]
    )


def _split_lr(spark, sf):
    """The events and their model, trained and placed as one too large to broadcast."""
    points = ds.event_points(spark, sf)
    partitions = spark.sparkContext.defaultParallelism
    placement = st.split_placement(points, 2, partitions)
    return points, _fit(points, "lr", num_features=ds.EVENT_FEATURES, partitions=partitions, placement=placement)


def evaluate_partitioned(spark, sf):
    points, model = _split_lr(spark, sf)
    return evaluate(model, points, valid_ratio=0.5).select("n", rounded(F.col("loss")).alias("loss"))


def score_partitioned(spark, sf):
    points, model = _split_lr(spark, sf)
    columns = [rounded(F.col(c)).alias(c) for c in ("score", "probability")]
    return model.score(points).select("row_id", "label", *columns)


# ---------------------------------------------------------------------------------------- perceptron

MLP_HIDDEN, MLP_ITERATIONS, MLP_SHARE = 4, 2, 5
DEEP_HIDDEN, SPLIT_HIDDEN = [18, 5], [4, 3]


def _initial_shares(spark, sf):
    shape = mlp.Shape(ds.EMBEDDING_SIZE, MLP_HIDDEN, ds.EMBEDDING_CLASSES)
    batch = ds.embedding_points(spark, sf).withColumnRenamed("row_id", "slot")
    return mlp.mlp_forward(batch, mlp.mlp_init(spark, shape), shape)


def mlp_forward(spark, sf):
    cells = [
        F.struct(F.lit(k).alias("k"), rounded(F.col(f"p{k}")).alias("p")) for k in range(ds.EMBEDDING_CLASSES)
    ]
    return _initial_shares(spark, sf).select(F.col("slot").alias("row_id"), F.inline(F.array(*cells)))


def mlp_metrics(spark, sf):
    seen = mlp.mlp_metrics(_initial_shares(spark, sf), ds.EMBEDDING_CLASSES)
    return seen.select(*[rounded(F.col(c)).alias(c) for c in ("loss", "accuracy")])


def train_mlp(spark, sf):
    points = ds.embedding_points(spark, sf)
    model = _fit(
        points, "mlp", ds.EMBEDDING_CLASSES, MLP_SHARE, num_features=ds.EMBEDDING_SIZE, reg=0.0,
        iterations=MLP_ITERATIONS, hidden=MLP_HIDDEN,
    )
    return model.weights().select("layer", "i", "j", rounded(F.col("w")).alias("w"))


def history_mlp(spark, sf):
    """Batch loss, sampled loss and accuracy of a perceptron's iterations."""
    model = _fit(
        ds.embedding_points(spark, sf), "mlp", ds.EMBEDDING_CLASSES, MLP_SHARE, num_features=ds.EMBEDDING_SIZE, reg=0.0,
        iterations=MLP_ITERATIONS, hidden=MLP_HIDDEN, history=True, valid_every=1, valid_ratio=0.5,
    )
    seen = [rounded(F.col(c)).alias(c) for c in ("batch_loss", "valid_loss", "accuracy")]
    return model.history.select("iter", *seen)


def _layer_weights(model, moments: bool = False) -> DataFrame:
    columns = ["w", "m", "v"] if moments else ["w"]
    return model.weights(moments).select("layer", "i", "j", *[rounded(F.col(c)).alias(c) for c in columns])


def train_mlp_deep(spark, sf):
    """Two hidden layers, of which the first has several blocks."""
    points = ds.embedding_points(spark, sf)
    return _layer_weights(_fit(
        points, "mlp", ds.EMBEDDING_CLASSES, MLP_SHARE, num_features=ds.EMBEDDING_SIZE, reg=0.0, iterations=MLP_ITERATIONS, hidden=DEEP_HIDDEN,
    ))


def train_mlp_adam(spark, sf):
    """A perceptron under lazy Adam, with shrinking weights."""
    points = ds.embedding_points(spark, sf)
    return _layer_weights(_fit(
        points, "adammlp", ds.EMBEDDING_CLASSES, MLP_SHARE, num_features=ds.EMBEDDING_SIZE, step=0.05, iterations=MLP_ITERATIONS, hidden=MLP_HIDDEN,
    ), moments=True)


def _split_mlp(spark, sf, **settings):
    """A perceptron on the click log whose first layer and cells are split by feature, as for a large model."""
    points = ds.click_points(spark, sf)
    partitions = spark.sparkContext.defaultParallelism
    placement = st.split_placement(points, 3 + max(SPLIT_HIDDEN), partitions)
    return _fit(
        points, "mlp", 2, num_features=ds.CLICK_FEATURES, partitions=partitions, placement=placement, step=0.1, reg=0.0,
        iterations=MLP_ITERATIONS, hidden=SPLIT_HIDDEN, **settings,
    )


def train_mlp_partitioned(spark, sf):
    return _layer_weights(_split_mlp(spark, sf))


def history_mlp_partitioned(spark, sf):
    """Batch loss and accuracy while a split perceptron with two hidden layers is trained."""
    seen = [rounded(F.col(c)).alias(c) for c in ("batch_loss", "accuracy")]
    return _split_mlp(spark, sf, history=True, valid_ratio=0).history.select("iter", *seen)


# --------------------------------------------------------------------------------------------- graph


def ranks(spark, sf):
    return pagerank(ds.trade_edges(spark, sf)).select("id", rounded(F.col("rank")).alias("rank"))


def top(spark, sf):
    best = top_ranks(pagerank(ds.trade_edges(spark, sf)), 10)
    return best.select("id", rounded(F.col("rank")).alias("rank"))


# ----------------------------------------------------------------------------------------- baselines


def _event_vectors(spark, sf, multiclass=False):
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(ds.event_points(spark, sf, multiclass), path)
    return texts.load_vectors(spark, path, ds.EVENT_FEATURES, spark.sparkContext.defaultParallelism)


def _baseline_query(name: str, multiclass: bool = False) -> Query:
    def query(spark, sf):
        data = _event_vectors(spark, sf, multiclass)
        classes = len(ds.EVENT_TYPES) if multiclass else 2
        model = baseline(
            data, name, num_features=ds.EVENT_FEATURES, iterations=10, reg=REG, step=STEP, fraction=0.1,
            classes=classes,
        )
        if name == "mlp":
            return predictions(model, data)
        rows = coefficients(model)
        return spark.createDataFrame(rows, "feature int, k int, w double")

    return query


def all_queries() -> dict[str, Query]:
    return {
        "read_libsvm": read_libsvm,
        "write_libsvm": write_libsvm,
        "to_columns": to_columns,
        "to_blocks": to_blocks,
        "to_blocks_bounded": to_blocks_bounded,
        "feature_partition": feature_partition,
        "read_criteo": read_criteo,
        "criteo_features": criteo_features,
        "hash_features": hash_features,
        "hash_present": hash_present,
        "minibatch_slots": minibatch_slots,
        "batch_labels": batch_labels,
        "batch_cells": batch_cells,
        "batch_dot": _stats_query(Logistic()),
        "batch_dot_k": _stats_query(Softmax(5), True),
        "fm_stats": _stats_query(Factorization(3)),
        "batch_grad": batch_grad,
        "log_loss": _loss_query(Logistic()),
        "hinge_loss": _loss_query(Hinge()),
        "softmax_loss": _loss_query(Softmax(5), True),
        "fm_loss": _loss_query(Factorization(3)),
        "label_counts": label_counts,
        "gaussian_init": gaussian_init,
        "train_lr": train_lr,
        "train_svm": train_svm,
        "train_mlr": train_mlr,
        "train_mlr_dense": train_mlr_dense,
        "train_fm": train_fm,
        "train_adamlr": train_adamlr,
        "train_adamsvm": train_adamsvm,
        "train_lr_clicks": train_lr_clicks,
        "train_lr_partitioned": train_lr_partitioned,
        "train_lr_stored": train_lr_stored,
        "train_fm_stored": train_fm_stored,
        "train_fm_partitioned": train_fm_partitioned,
        "mlp_forward": mlp_forward,
        "mlp_metrics": mlp_metrics,
        "train_mlp": train_mlp,
        "history_mlp": history_mlp,
        "train_mlp_deep": train_mlp_deep,
        "train_mlp_adam": train_mlp_adam,
        "train_mlp_partitioned": train_mlp_partitioned,
        "history_mlp_partitioned": history_mlp_partitioned,
        "evaluate": evaluate_model,
        "history": history,
        "score": score,
        "evaluate_partitioned": evaluate_partitioned,
        "score_partitioned": score_partitioned,
        "train_own": train_own,
        "train_gated": train_gated,
        "train_gated_adam": train_gated_adam,
        "train_gated_partitioned": train_gated_partitioned,
        "score_gated": score_gated,
        "train_all": train_everything,
        "read_edges": read_edges,
        "pagerank": ranks,
        "top_ranks": top,
        "rewrite_files": rewrite_files,
        "merge_files": merge_files,
        "sample_text": sample_text,
        "load_vectors": load_vectors,
        "sample_rows": sample_rows,
        "resample": resample,
        "baseline_svm": _baseline_query("svm"),
        "baseline_lr": _baseline_query("lr"),
        "baseline_mlr": _baseline_query("mlr", True),
        "baseline_svm_sgd": _baseline_query("svm_sgd"),
        "baseline_lr_sgd": _baseline_query("lr_sgd"),
        "baseline_mlp": _baseline_query("mlp", True),
    }
